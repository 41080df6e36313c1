"""Near-duplicate documents: b-bit MinHash candidates, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import by_texts, quoted, texts_of, written
from fluxlens.llm.graph import components
from fluxlens.llm.words import chained, word_codes

#: Bands and rows of a band.  Of pairs at similarity 0.8 all but 5 in 10^8 share a band.
BANDS, ROWS = 32, 4
#: Low bits kept of each of the BANDS * ROWS minima.
BITS = 2
#: Members of a bucket, and of a family with their sets, that make up a cell, and shingles of such; a task compares two cells at a time.
#: Buckets hold a few bytes of each member; smaller cells would hand on more edges of their forests.
BUCKET_CELL = 2048
CELL = 512
CELL_SHINGLES = 4_000_000
#: Size up to which the sets of two cells are compared as rows of bits.
MATRIX_BYTES = 64 << 20

_rng = np.random.default_rng(20240229)
_TIMES = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_AGAIN = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """64-bit hashes of the distinct shingles of so many words of each text, sorted; A-Z lower-cased."""
    codes, first = word_codes(texts)
    padded = np.append(codes, np.zeros(words, np.uint64))
    chains = chained([np.full(len(codes), words, np.uint64), *[padded[k : k + len(codes)] for k in range(words)]])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(chains[a : b - words + 1]))
        else:  # all words are one shingle
            out.append(chained([np.array([b - a], np.uint64), *[codes[k : k + 1] for k in range(a, b)]]) if b > a else np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of the shingles under each hash function."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    own = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    for k in range(0, len(own), 2048):
        y = own[k : k + 2048, None] * _TIMES
        y ^= y >> np.uint32(15)
        y *= _AGAIN
        y ^= y >> np.uint32(13)
        np.minimum(low, y.min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The low bits of the minima, four to a byte."""
    two = (low & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def estimated(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity by equal pairs of bits, corrected for those equal by chance."""
    differ = others ^ one
    differ = (differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)
    unequal = np.bitwise_count(differ).sum(axis=1)
    return 1.0 - unequal / (BANDS * ROWS) / (1.0 - 0.5**BITS)


def cutoff(similarity: float) -> float:
    """Five standard errors of the estimate below the similarity."""
    chance = 0.5**BITS
    equal = chance + (1 - chance) * similarity
    return similarity - 5 * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def _spanning(n: np.ndarray, bits: np.ndarray, percent: int, least: float) -> list[tuple[int, int]]:
    """A maximum spanning forest of the members of a cell by estimated similarity (Prim)."""
    count, found = len(n), []
    best, by = np.full(count, -1.0), np.full(count, -1)
    out = np.ones(count, bool)
    at = 0
    while True:
        out[at] = False
        fits = out & (np.minimum(n, n[at]) * 100 >= np.maximum(n, n[at]) * percent)
        e = np.where(fits, estimated(bits[at], bits), -1.0)
        nearer = out & (e > best)
        best[nearer], by[nearer] = e[nearer], at
        if not out.any():
            return found
        at = int(np.where(out, best, -2.0).argmax())
        if best[at] >= least:
            found.append((int(by[at]), at))
        best[at] = -1.0


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict]:
    """Columns of consecutive rows with equal first columns, of which the first is 64-bit; rows arrive sorted."""
    held: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        columns = [part.column(k).to_numpy() for k in range(keys)]
        ends = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1 if len(part) else []
        at = 0
        for end in [*ends, len(part)]:
            piece = part.slice(at, end - at)
            if held and any(held[0].column(k)[0] != piece.column(k)[0] for k in range(keys)):
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
            at = end
    if held:
        yield pa.concat_tables(held)


def _bits(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(table), -1)


def _in_cells(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows by group and cell; a group of several cells is laid out as all pairs of its cells."""
    own = F.pmod(F.xxhash64("class"), "cells")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    pairs = rows.withColumn("own", own).withColumn("other", other)
    return pairs.select(key, (F.least("own", "other") * F.col("cells") + F.greatest("own", "other")).alias("cell"), *columns)


def _links(rows: DataFrame, key: str, function: Callable[[pa.Table], Iterator[tuple[bytes, bytes]]], name: str) -> DataFrame:
    """Distinct pairs of classes that the function finds in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple[bytes, bytes], None] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.binary()) for k in (0, 1)], names=["u", "v"])
            done.clear()
            return out

        for table in _grouped(batches, 2):
            for a, b in function(table):
                done[(a, b) if a < b else (b, a)] = None
            if len(done) > 100_000:
                yield flush()
        if done:
            yield flush()

    return written(rows.repartition(key, "cell").sortWithinPartitions(key, "cell").mapInArrow(run, "u binary, v binary").distinct(), name)


def _linked(sets: list[np.ndarray], bits: np.ndarray, percent: int, least: float) -> Iterator[tuple[int, int]]:
    """Confirmed links that join up the members of a cell, likeliest first.

    Pairs whose estimate is too low are left out, and pairs that are in one
    component by now; every other pair is confirmed.
    """
    sizes = np.array(list(map(len, sets)))
    names, counts = np.unique(np.concatenate(sets), return_counts=True)
    names = names[counts > 1]  # what only one holds is in no intersection
    matrix = None
    if len(sets) * len(names) <= 8 * MATRIX_BYTES:
        width = -(-max(1, len(names)) // 64) * 64
        matrix = np.zeros((len(sets), width // 64), np.uint64)
        for k, own in enumerate(sets):
            row = np.zeros(width, bool)
            if len(names):
                at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                row[at[names[at] == own]] = True
            matrix[k] = np.packbits(row).view(np.uint64)
    label = np.arange(len(sets))
    for k in range(1, len(sets)):
        small, large = np.minimum(sizes[:k], sizes[k]), np.maximum(sizes[:k], sizes[k])
        e = estimated(bits[k], bits[:k])
        near = np.flatnonzero((e >= least) & (100 * small >= percent * large))
        near = near[np.argsort(-e[near], kind="stable")]
        while len(near):
            near = near[label[near] != label[k]]
            part, near = near[:64], near[64:]
            if not len(part):
                break
            if matrix is not None:
                shared = np.bitwise_count(matrix[part] & matrix[k]).sum(axis=1).astype(np.int64)
            else:
                shared = np.array([len(np.intersect1d(sets[k], sets[j], assume_unique=True)) for j in part.tolist()])
            for j in part[100 * shared >= percent * (sizes[part] + sizes[k] - shared)].tolist():
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    yield j, k


class NearDuplicates:
    """Classes of equal sets, links between them, components: see :func:`near_duplicates`."""

    def __init__(self, docs: DataFrame, words: int, percent: int, *, id_col: str = "doc_id", text_col: str = "text", sets: Callable[[list[str]], list[np.ndarray]] | None = None):
        self.percent, self.least = percent, cutoff(percent / 100)
        make = sets or (lambda texts: shingle_sets(texts, words))
        text = F.coalesce(F.col(text_col), F.lit(""))
        # 128 bits stand for id and text, so that no two rows share them by chance.
        self.row = F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("\n"), text)))
        self.docs, self.id_col, self.text, self.make = docs, id_col, text, make
        kind = docs.schema[id_col].dataType.simpleString()

        def describe(batch) -> dict:
            out = {"id": batch.column(2), "row": batch.column(0), "class": [], "n": [], "bits": [], "bands": []}
            for own in make(texts_of(batch)):
                out["n"].append(len(own))
                if not len(own):
                    for c in ("class", "bits", "bands"):
                        out[c].append(None)
                    continue
                low = minima(own)
                out["class"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                out["bits"].append(packed(low))
                out["bands"].append([xxhash.xxh3_64_intdigest(low[k : k + ROWS].tobytes(), k) - (1 << 63) for k in range(0, BANDS * ROWS, ROWS)])
            return out

        self.members = written(by_texts(docs, [self.row.alias("row"), text.alias("text"), F.col(id_col).alias("id")], describe, f"id {kind}, row binary, class binary, n long, bits binary, bands array<long>"), "members")
        self.classes = written(
            self.members.where("class is not null").groupBy("class")
            .agg(F.min("id").alias("least_id"), F.min("row").alias("row"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("bands").alias("bands")), "classes")

    # -- candidates --------------------------------------------------------

    def _buckets(self) -> DataFrame:
        """Members of the band buckets that hold several classes.

        A large bucket is worked on in pairs of its cells, so that every two
        members meet in some task and none holds the whole bucket."""
        rows = written(self.classes.select(F.explode("bands").alias("bucket"), "class", "n", "bits"), "bands")
        full = written(rows.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / BUCKET_CELL).alias("cells")), "full")
        return _in_cells(rows.join(full, "bucket"), "bucket", ["class", "n", "bits"])

    def _candidates(self, buckets: DataFrame) -> DataFrame:
        """A spanning forest of each bucket, most similar first, by estimate: it
        connects whatever is connected by estimates above the cutoff."""
        percent, least = self.percent, self.least

        def span(table: pa.Table) -> Iterator[tuple[bytes, bytes]]:
            if len(table) > 1:
                classes = table.column("class").to_pylist()
                for a, b in _spanning(table.column("n").to_numpy(), _bits(table), percent, least):
                    yield classes[a], classes[b]

        return _links(buckets, "bucket", span, "pairs")

    # -- confirmation ------------------------------------------------------

    def _families(self, families: DataFrame) -> DataFrame:
        """Classes of each family of candidates, with the full set of one of their documents."""
        make = self.make
        wanted = written(families.join(self.classes.select(F.col("class").alias("node"), "row", "n", "bits"), "node"), "wanted")
        sizes = written(wanted.groupBy("label").agg(F.count("*").alias("count"), F.sum("n").alias("total")).select("label", F.ceil(F.greatest(F.col("count") / CELL, F.col("total") / CELL_SHINGLES)).alias("cells")), "sizes")
        texts = self.docs.select(self.row.alias("row"), self.text.alias("text")).join(wanted.join(sizes, "label"), "row")

        def sets(batch) -> dict:
            return {"family": batch.column(2), "class": batch.column(3), "n": batch.column(4), "bits": batch.column(5), "cells": batch.column(6), "shingles": [x.tobytes() for x in make(texts_of(batch))]}

        columns = ["row", "text", "label", "node", "n", "bits", "cells"]
        found = by_texts(texts, columns, sets, "family binary, class binary, n long, bits binary, cells long, shingles binary")
        # Equal rows have equal sets; one of them is enough.
        found = written(found.withColumn("bucket", F.xxhash64("family")).dropDuplicates(["class"]), "sets")
        return _in_cells(found, "bucket", ["class", "n", "bits", "shingles"])

    def _confirmed(self, families: DataFrame) -> DataFrame:
        """Links, confirmed on full sets, that connect whatever confirmed links connect in a family."""
        percent, least = self.percent, self.least

        def confirm(table: pa.Table) -> Iterator[tuple[bytes, bytes]]:
            if len(table) > 1:
                classes = table.column("class").to_pylist()
                sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
                for a, b in _linked(sets, _bits(table), percent, least):
                    yield classes[a], classes[b]

        return _links(families, "bucket", confirm, "links")

    def labels(self) -> DataFrame:
        """(node, label) of all classes that have links."""
        families = components(self._candidates(self._buckets()))
        return components(self._confirmed(self._families(families)))

    def result(self) -> DataFrame:
        """A row for each document: id, row, n, label (of its component, null without words), component (its smallest id)."""
        labels = self.labels()
        placed = self.classes.select("class", "least_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        placed = written(placed, "placed")
        roots = written(placed.groupBy("label").agg(F.min("least_id").alias("component")), "roots")
        by_class = written(placed.join(roots, "label").select("class", "component", "label"), "by_class")
        return self.members.select("id", "row", "class", "n").join(by_class, "class", "left").select("id", "row", "n", "label", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose shingle sets are alike: 100 * common >= percent * all.

    Documents of equal sets form a class.  Classes that share a band of their
    MinHash minima are candidates; 2 bits of each of 128 minima estimate the
    similarity of two and leave out pairs five standard errors below the
    limit.  A spanning forest of each bucket joins candidates up to families.
    In each family every pair with a sufficient estimate is confirmed on the
    full sets, likeliest first, unless both are in one component already,
    where a link can't change anything.  Buckets and families beyond a size
    are worked on in pairs of cells; no group is gathered whole in one task,
    and pairs are never laid out as rows: tasks hand on the few links that
    join up components.

    Returns doc_id, n_shingles, component_id (the smallest id reachable),
    kept (the id is the component's).  With fewer words than a shingle all
    words are one shingle; without words (null, empty, blank) a document is
    linked with nothing.  Rows without id can be linked but don't name a
    component unless it has no id at all; repeated rows each keep a row.  Other columns play no
    part; an empty table gives no rows.
    """
    found = NearDuplicates(docs, words, percent, id_col=id_col, text_col=text_col).result()
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group of near duplicates: that of the smallest id.

    Documents without words are in no group and stay; rows that are equal in
    id and text become one.  All columns stay as they are.
    """
    alike = NearDuplicates(docs, words, percent, id_col=id_col, text_col=text_col)
    found = alike.result()
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    keepers = found.where("label is not null").groupBy("label").agg(first).select("first.row")
    keepers = written(keepers.unionAll(found.where("label is null").select("row")).distinct(), "keepers")
    boxed = docs.select(alike.row.alias("row"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("box"))
    return boxed.join(keepers, "row", "left_semi").dropDuplicates(["row"]).select(*[F.col(f"box.{quoted(c)}").alias(c) for c in docs.columns])
