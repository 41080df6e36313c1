"""Exact token counts of every prefix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fluxlens.llm import bpe
from fluxlens.llm.common import by_texts, texts_of


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 512, keep_table: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts the tokens of whole texts through their prefix tables.

    ``tokenizer`` is the file of a byte-level BPE.  For each text the number
    of tokens of every prefix (in code points) is worked out by a dynamic
    program; the total is its last entry, ``limit_chars`` the length of the
    longest prefix of at most ``limit`` tokens.  With ``keep_table`` the table
    comes along as ``prefix_deltas``, the differences of consecutive counts in
    ``table_bits`` (8 or 32) bits each; :func:`read_table` and
    :func:`fluxlens.llm.bpe.longest_prefix` answer truncation and budget
    questions from it without encoding anything again.

    Returns doc_id, n_bytes, n_tokens, over_limit, limit_chars.  Null and empty texts have
    no tokens; null and repeated ids stay as they are, a row for each row;
    other columns play no part; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"

    def count(batch) -> dict:
        texts = texts_of(batch)
        deltas = bpe.load(tokenizer).prefix_deltas(texts)
        totals = [int(d.sum(dtype=np.int64)) for d in deltas]
        out = {
            "doc_id": batch.column(0),
            "n_bytes": [len(t.encode()) for t in texts],
            "n_tokens": totals,
            "over_limit": [n > limit for n in totals],
            "limit_chars": [bpe.longest_prefix(d, limit) if n > limit else len(d) for d, n in zip(deltas, totals)],
        }
        if keep_table:
            out |= {"table_bits": [8 * d.itemsize for d in deltas], "prefix_deltas": [d.tobytes() for d in deltas]}
        return out

    return by_texts(docs, [id_col, text_col], count, schema + ", table_bits int, prefix_deltas binary" * keep_table)


def read_table(prefix_deltas: bytes, table_bits: int) -> np.ndarray:
    """The stored differences as an array."""
    return np.frombuffer(prefix_deltas, np.int8 if table_bits == 8 else np.int32)


def count_at(prefix_deltas: bytes, table_bits: int, length: int) -> int:
    """Tokens of the first ``length`` code points."""
    return int(read_table(prefix_deltas, table_bits)[:length].sum(dtype=np.int64))
