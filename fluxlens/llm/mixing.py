"""Mixing sources to target weights: blocks of words, drawn by permuted index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fluxlens.llm.common import WORD, by_texts, quoted, texts_of, written

#: Sources up to which their table is sent to every task; beyond, it is joined by shuffles.
SENT_SOURCES = 100_000
#: Rows of a source that one task orders at a time, and such buckets whose sizes are summed together.
BUCKET_ROWS, BUCKETS = 2_000, 2_000
#: Output shards that one task fills for one source.
SHARD_GROUP = 128
#: Slots that a task draws, about.
TASK_SLOTS = 1_000_000


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Places of 0..size-1 in a pseudorandom order that is worked out place by place.

    A Feistel network permutes the next power of four; what falls outside is
    permuted again until it falls inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def rounds(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in range(4):
            mixed = (right + np.uint64((key * 4 + k) & 0xFFFFFFFF) * np.uint64(0x9E3779B9) + np.uint64(0x7F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(31)) & mask)
        return left << np.uint64(half) | right

    with np.errstate(over="ignore"):
        found = rounds(index.astype(np.uint64))
        while (out := found >= np.uint64(size)).any():
            found[out] = rounds(found[out])
    return found.astype(np.int64)


def dealt(count: int, parts: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Parts that get some of ``count`` draws, and how many: a multinomial of equal shares."""
    if count < parts:
        return np.unique(rng.integers(0, parts, count), return_counts=True)
    counts = rng.multinomial(count, np.full(parts, 1 / parts))
    return np.flatnonzero(counts), counts[counts > 0]


def numbered(sources: DataFrame) -> DataFrame:
    """The rows with ``sid``, their place by source (code points, null last), from 0.

    Sorted in ranges; the ranges' sizes, a row for each partition, give where each starts.
    """
    mine = F.monotonically_increasing_id()
    ordered = sources.withColumn("absent", F.col("source").isNull())
    ordered = written(ordered.repartitionByRange("absent", "source").sortWithinPartitions("absent", "source").withColumn("mine", mine).drop("absent"), "numbered")
    part = F.shiftright("mine", 33).alias("part")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("count"))
    starts = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("start"))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("sid", F.col("start") + F.col("mine").bitwiseAND((1 << 33) - 1)).drop("part", "start", "mine")


def with_targets(sources: DataFrame, share: float, most: int, cycle: tuple[float, ...]) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by weight, at most ``most`` times a source's size.

    What a source can't give is dealt again to the others by weight, until
    none is above: each turn sums up sizes and weights, of which there are
    few turns, as a source that is above once is so for good.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("sid") % len(cycle) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    unit, closed = 0.0, -1
    while True:
        above = F.col("weight") * unit > most * F.col("size")
        sums = sources.agg(F.sum("size").alias("all"), F.count_if(above).alias("closed"), F.sum(F.when(above, F.col("size"))).alias("given"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if sums["closed"] == closed or not sums["open"]:
            break
        closed = sums["closed"]
        unit = (share * sums["all"] - most * (sums["given"] or 0)) / sums["open"]
    if closed < 0 or not sums["open"]:  # no sources, or none that can give more
        return sources.withColumn("target", (most * F.col("size")).cast("double")).drop("weight")
    return sources.withColumn("target", F.least(F.col("weight") * unit, (most * F.col("size")).cast("double"))).drop("weight")


def _block_at(word: Column) -> Column:
    """The block that holds a word of a source; the first ``longer`` blocks have a word more than the others."""
    edge = F.col("longer") * (F.col("length") + 1)
    return F.when(word < edge, F.floor(word / (F.col("length") + 1))).otherwise(F.col("longer") + F.floor((word - edge) / F.greatest(F.col("length"), F.lit(1))))


def _block_start(block: Column) -> Column:
    return block * F.col("length") + F.least(block, F.col("longer"))


@dataclass
class Mix:
    """docs: row, doc_id, size, sid, source_size, target, and ``box`` if it was
    carried along.  slots:
    output shard, order in it, sid, block, epoch, limit (the words that the
    slot takes of its block).  spans: slots with the rows in their blocks: row,
    epoch, start and length in the row's words."""

    docs: DataFrame
    slots: DataFrame
    spans: DataFrame


def mix(docs: DataFrame, *, share: float = 1.5, most: int = 2, cycle: tuple[float, ...] = (5, 2, 1), block_words: int = 64, shard_slots: int = 65_536, seed: int = 0, box: Column | None = None) -> Mix:
    """Mixes the words of sources to their target weights.

    The words of each source, its documents one after the other in the order
    of a hash, are packed into blocks of one length, ``block_words`` or one
    less (in a small source, less).  A source's share is a number of slots;
    each source deals them to the output shards, of about ``shard_slots``
    slots, by a multinomial draw, first to groups of shards, then within each.
    The j-th slot of a source takes the block at place j
    of a pseudorandom permutation of its blocks, a new one each time all are
    used up, and the last slot only the words that are left of the target;
    slots and blocks are joined by index.

    Null texts are empty; documents without words are in no block; null is a
    source of its own, the last.  Rows are numbered, so repeated and missing
    ids do no harm.  An empty table gives an empty mix.  Any number of sources
    will do: they are a table.  Offsets are summed in buckets, so that no task
    orders a whole source.
    """
    sized = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), *([box.alias("box")] if box is not None else []),
        ), "sized")
    plain = sized.drop("box")
    by_source = numbered(plain.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    sources = with_targets(by_source.withColumnRenamed("source_size", "size"), share, most, cycle).withColumnRenamed("size", "source_size")
    wanted = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    blocks = F.greatest(F.round(F.col("source_size") / block_words).cast("long"), F.lit(1))
    sources = sources.withColumn("blocks", blocks).withColumn("length", F.floor(F.col("source_size") / F.col("blocks"))).withColumn("longer", F.col("source_size") - F.col("length") * F.col("blocks"))
    # Whole passes, then as many slots as the rest needs, of which the last may take a part of its block.
    sources = sources.withColumn("passes", F.floor(wanted / F.greatest("source_size", F.lit(1)))).withColumn("rest", wanted - F.col("passes") * F.col("source_size"))
    mean = F.col("source_size") / F.col("blocks")
    sources = sources.withColumn("more", F.least(F.ceil(F.col("rest") / F.greatest(mean, F.lit(1.0))), F.col("blocks")))
    sources = sources.withColumn("last", F.greatest(F.col("rest") - F.round((F.col("more") - 1) * mean).cast("long"), F.lit(1)))
    sources = written(sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("more")).withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)), "sources")
    total = sources.agg(F.count("*").alias("sources"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).first()

    columns = sources.select(F.col("source").alias("name"), "sid", "source_size", "target", "buckets", "blocks", "length", "longer")
    columns = F.broadcast(columns) if total["sources"] <= SENT_SOURCES else columns.hint("merge")
    placed = plain.join(columns, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    worded = placed.where("size > 0").withColumn("bucket", F.pmod("h", "buckets")).withColumn("many", F.floor(F.col("bucket") / BUCKETS))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "row")
    # What lies before a bucket: sums over its neighbours, and over groups of them.
    sums = worded.groupBy("sid", "many", "bucket").agg(F.sum("size").alias("held"))
    groups = sums.groupBy("sid", "many").agg(F.sum("held").alias("group")).withColumn("earlier", F.sum("group").over(Window.partitionBy("sid").orderBy("many")) - F.col("group"))
    near = F.sum("held").over(Window.partitionBy("sid", "many").orderBy("bucket")) - F.col("held")
    starts = sums.withColumn("near", near).join(groups, ["sid", "many"]).select("sid", "bucket", (F.col("near") + F.col("earlier")).alias("before"))
    within = worded.withColumn("own", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    offsets = within.join(starts, ["sid", "bucket"]).withColumn("offset", F.col("before") + F.col("own")).drop("before", "own", "bucket", "many")

    last = F.col("offset") + F.col("size") - 1
    pieces = (
        offsets.select("sid", "row", "offset", "size", "length", "longer", F.explode(F.sequence(_block_at(F.col("offset")), _block_at(last))).alias("block"))
        .withColumn("begin", _block_start(F.col("block")))
        .select("sid", "block", "row", F.greatest(F.col("begin") - F.col("offset"), F.lit(0)).alias("start"),  # in the row
                F.greatest(F.col("offset") - F.col("begin"), F.lit(0)).alias("skip"),  # in the block
                (F.least(F.col("offset") + F.col("size"), _block_start(F.col("block") + 1)) - F.greatest("offset", "begin")).alias("words"))
    )
    slots = _slots(sources, total["slots"], shard_slots, seed)
    # The engine takes the slots for as few as the rows they are made from, and would send them everywhere.
    joined = slots.hint("merge").join(pieces, ["sid", "block"])
    spans = joined.select("shard", "order", "row", "epoch", "start", F.least(F.col("words"), F.col("limit") - F.col("skip")).alias("length")).where("length > 0")
    rows = placed.drop("h", "buckets", "blocks", "length", "longer")
    if box is not None:
        rows = rows.join(sized.select("row", "box").hint("merge"), "row")
    return Mix(rows, slots, spans)


def _slots(sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """The slots of all output shards: shard, order, sid, block, epoch, limit."""
    shards = max(1, -(-total // shard_slots))
    groups = max(1, -(-shards // SHARD_GROUP))
    whole = np.iinfo(np.int32).max

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, slots, blocks, more, last in zip(*(c.to_pylist() for c in batch.columns)):
                found, counts = dealt(slots, groups, np.random.default_rng([seed, 0, sid]))
                n = len(found)
                yield pa.RecordBatch.from_pydict({
                    "sid": np.full(n, sid), "group": found, "first": np.cumsum(counts) - counts, "count": counts,
                    "blocks": np.full(n, blocks), "cut": np.full(n, slots - 1 if more else -1), "last": np.full(n, last),
                })

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, g, first, count, blocks, cut, last in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([seed, 1, sid, g])
                low, high = g * shards // groups, (g + 1) * shards // groups
                for shard, n in zip(*(x.tolist() for x in dealt(count, high - low, rng))):
                    j = np.arange(first, first + n)
                    first += n
                    epoch, block = j // blocks, np.empty(n, np.int64)
                    for e in np.unique(epoch).tolist():
                        block[epoch == e] = permuted(j[epoch == e] % blocks, blocks, hash((seed, sid, e)) & 0xFFFFFFF)
                    yield pa.RecordBatch.from_pydict({
                        "shard": np.full(n, low + shard), "order": rng.integers(0, 1 << 62, n), "sid": np.full(n, sid), "block": block, "epoch": epoch,
                        "limit": np.where(j == cut, last, whole),
                    })

    groups_of = sources.where("slots > 0").select("sid", "slots", "blocks", "more", "last").mapInArrow(deal, "sid long, group long, first long, count long, blocks long, cut long, last long")
    tasks = max(1, -(-total // TASK_SLOTS))
    return groups_of.repartition(tasks, "sid", "group").mapInArrow(fill, "shard long, order long, sid long, block long, epoch long, limit long")


def taken_words(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    taken = mixed.spans.groupBy("row").agg(F.sum("length").alias("taken"))
    joined = mixed.docs.join(taken.hint("merge"), "row", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each pass over a document, with the words that it takes.

    A pass that takes a document whole keeps its text as it is; otherwise the
    stretches it takes are kept, each on lines of its own.  The other columns
    stay, of whatever name and type; n_chars, where it is one, is counted again.
    """
    columns = [quoted(c) for c in docs.columns]
    mixed = mix(docs, box=F.struct(*columns), **options)
    spans = mixed.spans.groupBy("row", "epoch").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    rows = mixed.docs.where("size > 0").select("row", "size", "box").join(spans.hint("merge"), "row")

    def cut(batch) -> dict:
        texts = []
        for text, size, spans_ in zip(texts_of(batch), batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            merged = []
            for s in spans_:
                if merged and merged[-1][1] == s["start"]:
                    merged[-1][1] += s["length"]
                else:
                    merged.append([s["start"], s["start"] + s["length"]])
            texts.append(text if merged == [[0, size]] else _stretches(text, merged))
        return {"text": texts, "chars": [len(t) for t in texts], "rest": batch.column(3)}

    others = [c for c in docs.columns if c not in ("text", "n_chars")] or ["text"]
    rest = F.struct(*[F.col(f"box.{quoted(c)}") for c in others])
    done = by_texts(rows, ["size", F.col("box.text").alias("text"), "spans", rest.alias("rest")], cut, StructType([StructField("text", StringType()), StructField("chars", LongType()), StructField("rest", rows.select(rest).schema[0].dataType)]))
    n_chars = {"n_chars": F.col("chars").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return done.select(*[F.col("text") if c == "text" else n_chars[c].alias(c) if c in n_chars else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns])


def _stretches(text: str, spans: list[list[int]]) -> str:
    raw = text.encode()
    starts, ends, at = [], [], 0
    for word in raw.split():
        at = raw.index(word, at)
        starts.append(at)
        at += len(word)
        ends.append(at)
    return b"\n".join(raw[starts[a] : ends[b - 1]] for a, b in spans).decode()
