"""Packing documents into token sequences by multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluxlens.llm import bpe
from fluxlens.llm.common import sliced, small_batches, texts_of

#: Sequence ids of one task start at its partition's number times this.
TASK_STRIDE = 1 << 36


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Deals items to so many windows of near-equal sums (Karmarkar-Karp).

    Every item starts as a partition of its own with one filled window.  The
    two partitions of the largest spread between their windows are merged,
    the fullest window of one with the emptiest of the other, until one
    partition is left.  Windows without items are kept as empty lists.
    """
    # A partition: windows as (sum, tree of items), fullest first; empty ones are left out.
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = len(a) + len(b) - ways
        if shared <= 0:
            merged = a + b
        else:
            free = len(a) - shared  # these windows meet an empty one
            merged = a[:free]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free:], reversed(b[len(b) - shared :]))]
            merged += b[: len(b) - shared]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (low - merged[0][0], tie, merged))
        tie += 1
    windows = []
    for _, tree in heap[0][2] if heap else ():
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        windows.append(sorted(items))
    return windows + [[] for _ in range(ways - len(windows))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, counted up from the sum's need, that differencing keeps within capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        found = [w for w in differencing(sizes, ways) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        ways += 1


def cut(length: int, capacity: int, piece: int) -> list[int]:
    """Where a document is cut: full sequences first, the rest in pieces of near-equal length."""
    full, rest = divmod(length, capacity)
    lengths = [capacity] * full
    if rest:
        n = -(-rest // piece)
        lengths += [rest // n + (k < rest % n) for k in range(n)]
    return lengths


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 1, piece: int = 512, group_tokens: int = 1 << 18, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` token ids.

    A document is its ids followed by ``end_id``.  One longer than a sequence
    gives as many full sequences as it can; what is left is cut into pieces of
    at most ``piece`` ids.  About ``group_tokens`` of such pieces at a time,
    in the order of the input partition, are dealt to near-equal windows by
    Karmarkar-Karp differencing; each window is a sequence.  Groups are made
    within a partition, so nothing is shuffled, memory is bounded by the group
    and a lost task repeats its own input only.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and with ``keep_ids`` the piece's ids.  Null and
    empty texts are one ``end_id``; a null or repeated doc_id packs like any
    other row, each row by itself; other columns of the input play no part; an
    empty table gives no pieces.  Sequence ids are unique and, for the same
    partitions of the input, the same in each run.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.load(tokenizer)
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) * TASK_STRIDE
        done: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def deal() -> None:
            nonlocal at, held
            for window in windows_of([x[2] for x in waiting], capacity):
                offset = 0
                for i in window:
                    x = waiting[i]
                    done.append((*x[:5], at, offset, *x[5:]))
                    offset += x[2]
                at += 1
            waiting.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
        types = [None, *[pa.int64()] * 6, pa.list_(pa.int32())]
        for batch in sliced(batches):
            types[0] = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = np.append(own.encode(text), np.uint32(end_id)).astype("<u4")
                start = 0
                for n in cut(len(ids), capacity, piece):
                    part = ids[start : start + n]
                    row = (doc, start, n, zlib.crc32(part.tobytes()), len(ids), *([part.tolist()] if keep_ids else []))
                    if n == capacity:
                        done.append((*row[:5], at, 0, *row[5:]))
                        at += 1
                    else:
                        waiting.append(row)
                        held += n
                        if held >= group_tokens:
                            deal()
                    start += n
            if len(done) >= 20_000 or keep_ids and done:
                yield flush()
        if waiting:
            deal()
        if done:
            yield flush()

    return small_batches(docs.select(id_col, text_col)).mapInArrow(run, schema)
