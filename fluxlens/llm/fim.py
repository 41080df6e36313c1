"""Fill-in-the-middle: texts cut at two places and put together in another order."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import by_texts

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a text whose characters are classed together.
PIECE = 1 << 20

# The class of a character is its number of bytes; bytes within a character have none.
_WIDTH = np.zeros(256, np.uint8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4


@dataclass
class ClassRuns:
    """Maximal runs of characters of one class: where each starts, in units and in bytes, and its bytes a unit."""

    unit: np.ndarray
    byte: np.ndarray
    width: np.ndarray
    units: int

    @classmethod
    def of(cls, raw: bytes) -> ClassRuns:
        """The runs of a text in UTF-8; memory grows with the runs and one piece, not with the text."""
        starts, widths, units, last = [], [], 0, 0
        for at in range(0, len(raw), PIECE):
            found = _WIDTH[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - at), at)]
            found = found[found > 0]
            if not len(found):
                continue
            change = np.flatnonzero(np.diff(found, prepend=last))
            starts.append(units + change)
            widths.append(found[change])
            units, last = units + len(found), found[-1]
        unit = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        width = np.concatenate(widths).astype(np.int64) if widths else np.zeros(0, np.int64)
        sizes = np.diff(np.append(unit, units)) * width
        return cls(unit, np.cumsum(sizes) - sizes, width, units)

    def offset(self, units: int) -> int:
        """Bytes before a cut: the run that holds it by binary search, the rest by arithmetic."""
        if not len(self.unit):
            return 0
        at = int(np.searchsorted(self.unit, units, side="right")) - 1
        return int(self.byte[at] + (units - self.unit[at]) * self.width[at])


def cuts(key: bytes, units: int) -> tuple[int, int, int, int]:
    """The two cuts, the smaller first, and the two draws from 0 to 99 of a text of so many units."""
    h = [int.from_bytes(hashlib.sha256(key).digest()[k : k + 4], "big") for k in (0, 4, 8, 12)]
    low, high = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    return low, high, h[2] % 100, h[3] % 100


def transformed(raw: bytes, key: bytes, *, marks: tuple[bytes, bytes, bytes], plain_percent: int, spm_percent: int) -> tuple[bytes, str, int, int | None, int | None, int]:
    """Output, form, units, units of prefix and middle (none if plain) and number of class runs."""
    runs = ClassRuns.of(raw)
    low, high, plain, spm = cuts(key, runs.units)
    if not raw or plain >= 100 - plain_percent or any(m in raw for m in marks):
        return raw, "plain", runs.units, None, None, len(runs.unit)
    a, b = runs.offset(low), runs.offset(high)
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    first, second, third = marks
    if spm < spm_percent:
        return b"".join((second, suffix, first, prefix, third, middle)), "spm", runs.units, low, high - low, len(runs.unit)
    return b"".join((first, prefix, second, suffix, third, middle)), "psm", runs.units, low, high - low, len(runs.unit)


def restored(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> bytes:
    """The text that gave the output.  Marks are found from the left: no text that holds one was cut."""
    if form == "plain":
        return output
    first, second, third = marks
    start, between = (second, first) if form == "spm" else (first, second)
    one, rest = output[len(start) :].split(between, 1)
    two, middle = rest.split(third, 1)
    return two + middle + one if form == "spm" else one + middle + two


def _overlaps(mark: str) -> bool:
    return any(mark[:k] == mark[-k:] for k in range(1, len(mark)))


def fill_in_middle(docs: DataFrame, *, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, keep_output: bool = False) -> DataFrame:
    """Cuts every whole text at two code points drawn by its id, and orders the parts anew.

    Texts are stored as maximal runs of characters of one class (bytes a
    character) with cumulative counts; a cut finds its run by binary search
    and its offset by arithmetic.

    Returns doc_id, n (code points), form (plain, psm or spm), prefix_chars,
    middle_chars (null if plain), output_sha256, restored_sha256 (of the text
    rebuilt from output and form), runs, and with ``keep_output`` output.
    Null texts count as empty; empty texts and those that hold a mark stay
    plain.  A null id draws as an empty one; rows of one id are cut by the same
    draws, each at its own length; every row gets its own row.  An empty table
    gives no rows; other columns play no part.  No shuffle.
    """
    if len(set(marks)) != 3 or any(not m or _overlaps(m) for m in marks) or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must differ, not overlap themselves, and not hold one another")
    coded = tuple(m.encode() for m in marks)

    def cut(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "runs", "output")}
        for key, raw in zip(batch.column(2).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            output, form, n, prefix, middle, runs = transformed(raw or b"", f"{seed}:{key or ''}".encode(), marks=coded, plain_percent=plain_percent, spm_percent=spm_percent)
            back = hashlib.sha256(restored(output, form, coded)).hexdigest()
            for name, value in zip(out, (n, form, prefix, middle, hashlib.sha256(output).hexdigest(), back, runs, output if keep_output else None)):
                out[name].append(value)
        if keep_output:
            out["output"] = pa.array(out["output"], pa.binary()).cast(pa.string())
        return out | {"doc_id": batch.column(0)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, runs int" + (", output string" if keep_output else "")
    return by_texts(docs, ["doc_id", "text", F.col("doc_id").cast("string").alias("key")], cut, schema)


def restored_texts(outputs: DataFrame, *, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id and text of rows that have doc_id, output and form; null outputs give null."""
    coded = tuple(m.encode() for m in marks)

    def back(batch: pa.RecordBatch) -> dict:
        texts = [None if o is None else restored(o, f, coded) for o, f in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist())]
        return {"doc_id": batch.column(0), "text": pa.array(texts, pa.binary()).cast(pa.string())}

    return by_texts(outputs, ["doc_id", "output", "form"], back, f"doc_id {outputs.schema['doc_id'].dataType.simpleString()}, text string")
