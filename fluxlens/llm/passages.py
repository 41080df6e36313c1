"""Substring dedup: repeated passages by MinHash banding of paragraphs cut by content."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from fluxlens.llm.common import by_texts, small_batches, texts_of, written
from fluxlens.llm.graph import Forest, components
from fluxlens.llm.neardup import CELL, _grouped
from fluxlens.llm.words import ODD, chained, odd_numbers, ranges, scrambled, word_codes

#: A paragraph starts where a word trigram's hash is the smallest among so many on either side.
REACH = 4
SHINGLE = 5
#: A cut that lies so far inside a passage doesn't depend on what is around the passage.
MARGIN = REACH + 4
#: Most words between two runs of a near-equal passage.
GAP = 64
#: Empty places between two texts, so that no window or shingle sees the next text.
APART = 2 * REACH
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def tune_bands(similarity: float, recall: float, units: int) -> tuple[int, int]:
    """(bands, rows) with the fewest bands, then the most rows, at which of passages of
    ``units`` paragraphs that similar at least ``recall`` share a band in one of them."""
    for bands in range(1, 4):
        for rows in (4, 3, 2, 1):
            if 1 - (1 - similarity**rows) ** (bands * units) >= recall:
                return bands, rows
    return 3, 1


class Paragraphs:
    """The words of texts cut into paragraphs, with their shingles and band keys.

    The cuts depend on the words near them alone, so a passage that is found
    in two texts is cut alike in both, wherever it stands, up to a few words
    at its ends.  ``text``, ``start`` and ``end`` tell a paragraph's text and
    its words, which are counted over all texts; ``first`` has each text's
    first word.
    """

    def __init__(self, texts: list[str], bands: int, rows: int):
        self.codes, self.first = codes, first = word_codes(texts)
        count = np.diff(first)
        text = np.repeat(np.arange(len(texts)), count)
        place = np.arange(len(codes))
        at = place + APART * (text + 1)
        spread = np.zeros(len(codes) + APART * (len(texts) + 1), np.uint64)
        spread[at] = codes
        whole = place + 3 <= first[1:][text]
        trigram = np.full(len(spread), _LAST)
        there = at[whole]
        trigram[there] = chained([spread[:-2], spread[1:-1], spread[2:]])[there]
        two = np.minimum(trigram[:-1], trigram[1:])
        four = np.minimum(two[:-2], two[2:])
        own = trigram[there]
        cut = np.zeros(len(codes), bool)
        cut[place[whole]] = (own < four[there - REACH]) & (own <= four[there + 1])
        cut[first[:-1][count > 0]] = True
        self.start = np.flatnonzero(cut)
        self.end = np.append(self.start[1:], len(codes))
        self.text = text[self.start]
        self.shingles = chained([spread[k : len(spread) - SHINGLE + 1 + k] for k in range(SHINGLE)])
        # Shingles that lie in the paragraph; of one that is too short, the one that starts with it.
        self.low = at[self.start]
        self.high = np.maximum(self.low + 1, self.low + self.end - self.start - SHINGLE + 1)
        spans = np.column_stack((self.low, self.high)).ravel()
        keys = []
        for k in range(bands):
            parts = []
            for r in range(rows):
                turned = (self.shingles ^ np.uint64(0x5851F42D4C957F2D * (k * rows + r + 1) & 0xFFFFFFFFFFFFFFFF)) * ODD
                turned ^= turned >> np.uint64(31)
                parts.append(np.minimum.reduceat(turned, spans)[::2] if len(spans) else np.empty(0, np.uint64))
            keys.append(chained(parts) ^ np.uint64(k + 1))
        self.keys = np.column_stack(keys).view(np.int64)

    def classes(self, on: np.ndarray) -> np.ndarray:
        """128 bits of the words of each of some paragraphs, in order."""
        low, high = self.start[on], self.end[on]
        if not len(low):
            return np.empty((0, 2), np.uint64)
        size = high - low
        words = self.codes[ranges(low, high)]
        first = np.cumsum(size) - size
        place = np.arange(len(words)) - np.repeat(first, size)
        by_place = odd_numbers(2 * int(size.max()), 5).reshape(-1, 2)
        return np.column_stack([scrambled(np.add.reduceat(words * by_place[place, k], first) + size.astype(np.uint64)) for k in (0, 1)])


def _binaries(data: np.ndarray, sizes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Binary values of so many items each, one after the other."""
    ends = np.append(0, np.cumsum(sizes * data.itemsize)).astype(np.int32)
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [valid, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def grown(contexts: list[bytes], ids: list, first: list[int], last: list[int]) -> list[list[tuple]]:
    """For each of the sorted contexts (4 bytes a word), pieces (from, upto, smallest id) that another row has too.

    ``first`` and ``last`` are the smallest and largest row with the context.
    The words are walked as a trie: a piece is as long as the same contexts
    share it, and ends where they part.
    """
    out: list[list[tuple]] = [[] for _ in contexts]
    stack = [(0, len(contexts), 0)]
    while stack:
        low, high, depth = stack.pop()
        if min(first[low:high]) == max(last[low:high]):
            continue
        a, b, end = contexts[low], contexts[high - 1], depth
        most = min(len(a), len(b))
        while end < most and a[end : end + 4] == b[end : end + 4]:
            end += 4
        if end > depth:
            piece = (depth // 4, end // 4, min((x for x in ids[low:high] if x is not None), default=None))
            for k in range(low, high):
                out[k].append(piece)
        at = low
        while at < high:
            word, upto = contexts[at][end : end + 4], at + 1
            while upto < high and contexts[upto][end : end + 4] == word:
                upto += 1
            if word and (upto - at > 1 or first[at] != last[at]):
                stack.append((at, upto, end))
            at = upto
    return out


def merged(claims: list[tuple], percent: int, min_words: int) -> list[tuple]:
    """Pieces (start, end, holder) of the stretches that a document's claims (start, end, holder, partner) cover.

    A claim with a partner is a gap between two runs, of so many words in
    another document.  Runs are joined over such gaps where the whole aligned
    stretch has 100 * common >= percent * all shingles.  Stretches under
    ``min_words`` words are left out, the others broken where the holder
    changes; words of several claims go to the smallest holder.
    """
    exact = sorted((c for c in claims if c[3] is None), key=lambda c: c[:2])
    gaps = sorted((c for c in claims if c[3] is not None), key=lambda c: c[:2])
    runs: list[list[int]] = []
    for start, end, *_ in exact:
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    # Words of the other document between a run and the next, less those by which the runs have grown into the gap.
    between: list[int | None] = [None] * len(runs)
    starts = [r[0] for r in runs]
    for start, end, _, partner in gaps:
        k, m = bisect_left(starts, start) - 1, bisect_right(starts, end) - 1
        if 0 <= k < m and start <= runs[k][1] and end < runs[m][1]:
            open_words = [runs[j + 1][0] - runs[j][1] for j in range(k, m)]
            left = max(0, partner - (end - start) + sum(open_words))
            for j in range(k, m):
                between[j] = left if between[j] is None else min(between[j], left)
                left = 0
    ranks = {w: k for k, w in enumerate(sorted({c[2] for c in claims}, key=lambda w: (w is None, w)))}
    names = list(ranks)
    out, at = [], 0
    while at < len(runs):
        common = words = other = 0
        upto = at
        for k in range(at, len(runs)):
            size = runs[k][1] - runs[k][0]
            common, words = common + max(0, size - SHINGLE + 1), words + size
            if k > at and 100 * common >= percent * (runs[k][1] - runs[at][0] + words + other - 2 * (SHINGLE - 1) - common):
                upto = k
            if between[k] is None:
                break
            other += between[k]
        start, end = runs[at][0], runs[upto][1]
        at = upto + 1
        if end - start < min_words:
            continue
        holder = np.full(end - start, len(names), np.int64)
        for source in (gaps, exact):
            found = np.full(end - start, len(names), np.int64)
            for s, e, who, _ in source[bisect_left(source, start - GAP, key=lambda c: c[0]) :]:
                if s >= end:
                    break
                part = found[max(0, s - start) : max(0, e - start)]
                np.minimum(part, ranks[who], out=part)
            holder = np.where(found < len(names), found, holder)
        breaks = [0, *(np.flatnonzero(np.diff(holder)) + 1).tolist(), end - start]
        out += [(start + a, start + b, names[holder[a]]) for a, b in zip(breaks, breaks[1:])]
    return out


def _few(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows: lists of structures are many times as large as Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def repeated_passages(docs: DataFrame, *, percent: int = 80, min_words: int = 25, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds passages that more than one document holds, wherever they stand in it.

    Paragraphs of about nine words are cut by content; their MinHash bands are
    tuned so that of passages of five such paragraphs ``recall`` collide.  Paragraphs that share
    a band with one of another document are compared on their whole shingle
    sets: 100 * common >= percent * all links them.  Linked paragraphs form
    components; those of a component that spans documents are repeated, and
    neighbours among them make a run.  Each run is grown word by word at both
    ends as far as any other document that has the paragraph at its end word
    for word goes on with the same words, so that cuts cost a passage nothing.  Runs with at most
    ``GAP`` words between them are joined where another document has the same
    two paragraphs in that order and the whole aligned stretch agrees by
    ``percent``, so that changed words don't break a passage.  What then has
    ``min_words`` words is returned.

    Returns doc_id, start_word, end_word, n_words, component_id (the smallest
    doc_id that has these words too), kept (this is that document).  A stretch
    is broken where component_id changes, so every part keeps a holder; a part
    may have fewer words than its stretch.  Words are
    those between ASCII white space, A-Z lower-cased.  Texts without words
    hold no passage; rows that are equal in id and text count as one
    document; other columns play no part; an empty table gives no rows.
    """
    bands, rows = tune_bands(percent / 100, recall, 5)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.xxhash64(F.col(id_col), text)
    base = docs.select(row.alias("row"), text.alias("text"), F.col(id_col).alias("id"))

    def band_keys(batch) -> dict:
        own = Paragraphs(texts_of(batch), bands, rows)
        counts = np.bincount(own.text, minlength=len(batch)) * bands
        ends = np.append(0, np.cumsum(counts)).astype(np.int32)
        return {"row": batch.column(0), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(own.keys.ravel()))}

    # Texts are cut once for their keys, and those that share some once more for their words.
    keyed = written(by_texts(base, ["row", "text"], band_keys, "row long, keys array<long>"), "keys").select("row", F.explode("keys").alias("key"))
    shared = written(keyed.groupBy("key").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("key"), "shared")
    wanted = keyed.hint("merge").join(shared.hint("merge"), "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("keys"))
    chosen = base.hint("merge").join(wanted.hint("merge"), "row")

    def units(batch) -> dict:
        own = Paragraphs(texts_of(batch), bands, rows)
        # A key that some text of the batch shares is shared wherever it stands.
        hit = np.flatnonzero(np.isin(own.keys, batch.column(3).flatten().to_numpy()).any(axis=1))
        text = own.text[hit]
        begin, end = own.first[:-1][text], own.first[1:][text]
        head = np.searchsorted(own.text, np.arange(len(batch)))
        # The words in reach of the paragraphs, in stretches that go with their first paragraph.
        low = np.maximum(np.where(own.start[hit] > begin, own.start[np.maximum(hit - 1, 0)], begin) - MARGIN, begin)
        high = np.minimum(np.where(own.end[hit] < end, own.end[np.minimum(hit + 1, len(own.end) - 1)], end) + MARGIN, end)
        heads = np.flatnonzero(np.append(True, (low[1:] > high[:-1]) | (text[1:] != text[:-1]))) if len(hit) else hit
        upto = high[np.append(heads[1:], len(hit)) - 1] if len(hit) else hit
        rest = np.ones(len(hit), bool)
        rest[heads] = False
        sizes = np.zeros(len(hit), np.int64)
        sizes[heads] = upto - low[heads]
        members = own.high[hit] - own.low[hit]
        classes = own.classes(hit)
        ends = np.arange(len(hit) + 1, dtype=np.int32) * bands
        of = pa.array(text)
        return {
            "row": batch.column(0).take(of), "id": batch.column(2).take(of), "place": pa.array(hit - head[text]),
            "start": pa.array(own.start[hit] - begin), "end": pa.array(own.end[hit] - begin), "before": pa.array(low - begin), "after": pa.array(high - begin),
            "class": _binaries(classes.ravel(), np.full(len(hit), 2)), "code": pa.array(classes[:, 0].view(np.int64)), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(own.keys[hit].ravel())),
            "shingles": _binaries(own.shingles[ranges(own.low[hit], own.high[hit])], members),
            "base": pa.array(low - begin, mask=rest), "words": _binaries(own.codes[ranges(low[heads], upto)].astype(np.uint32), sizes, rest),
        }

    found = written(by_texts(chosen, ["row", "text", "id", "keys"], units, f"row long, id {kind}, place int, start int, end int, class binary, code long, shingles binary, keys array<long>, before int, after int, base int, words binary"), "units")
    # Buckets that hold paragraphs of different words are few: most share a band because they are equal.
    hits = found.select(F.explode(F.array_distinct("keys")).alias("bucket"), "class", "code")
    mixed = hits.groupBy("bucket").agg(F.min("code").alias("a"), F.max("code").alias("b")).where("a <> b").select("bucket")
    of_mixed = written(hits.hint("merge").join(mixed.hint("merge"), "bucket", "left_semi").select("bucket", "class").distinct(), "mixed")
    sets = found.select("class", "shingles").hint("merge").join(of_mixed.select("class").distinct().hint("merge"), "class", "left_semi").groupBy("class").agg(F.min("shingles").alias("shingles"))
    full = of_mixed.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / CELL).alias("cells"))
    placed = of_mixed.hint("merge").join(full.hint("merge"), "bucket").hint("merge").join(sets.hint("merge"), "class").withColumn("cell", F.pmod(F.xxhash64("class", "bucket"), "cells"))
    # Every cell of a large bucket meets every cell, so that no pair is left out.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("other")
    meeting = placed.select("bucket", "cells", "cell", "class", "shingles", other).select(
        "bucket", (F.least("cell", "other") * F.col("cells") + F.greatest("cell", "other")).alias("cell"), "class", "shingles")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            names = table.column("class").to_pylist()
            sets = [np.unique(np.frombuffer(x, np.uint64)) for x in table.column("shingles").to_pylist()]
            sizes, forest, links = np.array(list(map(len, sets))), Forest(), []
            # Members by shingle, to count what each later one has in common with the earlier ones.
            holders: dict[int, list[int]] = {}
            for k, own in enumerate(sets):
                shared_with: dict[int, int] = {}
                for s in own.tolist():
                    earlier = holders.setdefault(s, [])
                    for e in earlier:
                        shared_with[e] = shared_with.get(e, 0) + 1
                    earlier.append(k)
                for e, common in shared_with.items():
                    if 100 * common >= percent * (sizes[k] + sizes[e] - common) and forest.join(e, k):
                        links.append((names[e], names[k]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["u", "v"])

    links = written(meeting.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(link, "u binary, v binary").distinct(), "links")
    labels = components(links).withColumnRenamed("node", "class")
    # Runs are grown from paragraphs that another document has word for word, as only those end alike.
    exact = found.groupBy("class").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("class", F.lit(True).alias("exact"))
    labelled = written(
        found.select("row", "id", "place", "start", "end", "before", "after", "class").join(labels.hint("merge"), "class", "left")
        .join(exact.hint("merge"), "class", "left").withColumn("label", F.coalesce("label", "class")).withColumn("exact", F.col("exact").isNotNull()), "labelled")
    groups = written(labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("label", "component_id"), "groups")
    repeated = labelled.join(groups.hint("merge"), "label")
    order = Window.partitionBy("row").orderBy("place")
    once = repeated.groupBy("row", "place").agg(*[F.min(c).alias(c) for c in ("id", "start", "end", "before", "after", "class", "exact", "component_id")])
    once = written(once, "once")
    alike = once.where("exact")
    runs = written(
        alike.withColumn("first", F.coalesce(F.lag("place").over(order) < F.col("place") - 1, F.lit(True)))
        .withColumn("last", F.coalesce(F.lead("place").over(order) > F.col("place") + 1, F.lit(True))), "runs")
    # All documents that have a paragraph at which a run ends somewhere tell how they go on there.
    ending = runs.where("first or last").groupBy("class").agg(F.max("first").alias("leftward"), F.max("last").alias("rightward"))
    asked = runs.join(ending.hint("merge"), "class").groupBy("row").agg(
        F.min("id").alias("id"), F.sort_array(F.collect_list(F.struct("place", "start", "end", "before", "after", "class", "first", "last", "leftward", "rightward"))).alias("units"))
    reach = found.where("words is not null").groupBy("row").agg(F.collect_set(F.struct("base", "words")).alias("reach"))

    ends_columns = f"side int, class binary, other binary, gap int, row long, id {kind}, start int, end int, edge boolean"
    ends_arrow = to_arrow_schema(_parse_datatype_string(ends_columns))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ends_arrow
        for batch in _few(batches):
            out = {c: [] for c in wanted.names}

            def add(*values) -> None:
                for c, v in zip(wanted.names, values):
                    out[c].append(v)

            for r, i, members, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                stretches = sorted((x["base"], np.frombuffer(x["words"], np.uint32)) for x in stretches)
                bases = [x[0] for x in stretches]
                for n, u in enumerate(members):
                    base, words = stretches[bisect_right(bases, u["start"]) - 1]
                    if u["leftward"] and u["before"] < u["start"]:
                        add(0, u["class"], words[u["before"] - base : u["start"] - base][::-1].tobytes(), None, r, i, u["start"], u["start"], u["first"])
                    if not u["rightward"]:
                        continue
                    if u["end"] < u["after"]:
                        add(1, u["class"], words[u["end"] - base : u["after"] - base].tobytes(), None, r, i, u["end"], u["end"], u["last"])
                    own = u["last"]
                    for v in members[n + 1 :]:
                        if v["start"] - u["end"] > GAP:
                            break
                        if v["leftward"]:
                            add(2, u["class"], v["class"], v["start"] - u["end"], r, i, u["end"], v["start"], own and v["first"])
                            own = own and not v["first"]
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in wanted], schema=wanted)

    ends = written(small_batches(asked.hint("merge").join(reach.hint("merge"), "row").select("row", "id", "units", "reach")).mapInArrow(contexts, ends_columns), "ends")
    # Equal contexts count once; those with the same first word meet.
    apart = ends.where("side < 2").groupBy("side", "class", "other").agg(F.min("id").alias("id"), F.min("row").alias("a"), F.max("row").alias("b"), F.max("edge").alias("edge"))
    keyed_ends = apart.select(F.xxhash64("side", "class", F.expr("substring(other, 1, 4)")).alias("key"), "other", "id", "a", "b", "edge", "side", "class")

    grown_columns = f"side int, class binary, other binary, from int, upto int, who {kind}"
    grown_arrow = to_arrow_schema(_parse_datatype_string(grown_columns))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = grown_arrow
        held: list[tuple] = []
        for table in _grouped(batches, 1):
            _, other, ids, a, b, edge, side, own = (table.column(k).to_pylist() for k in range(8))
            for k, pieces in enumerate(grown(other, ids, a, b)):
                if edge[k]:
                    held += [(side[k], own[k], other[k], *piece) for piece in pieces]
            if len(held) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), wanted)], schema=wanted)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), wanted)], schema=wanted)

    pieces = written(keyed_ends.repartition("key").sortWithinPartitions("key", "other").mapInArrow(grow, grown_columns), "grown")
    none = F.lit(None).cast("int").alias("partner")
    sides = ends.where("side < 2 and edge").select("side", "class", "other", "row", "start").hint("merge").join(pieces.hint("merge"), ["side", "class", "other"])
    left = F.col("side") == 0
    more = sides.select(
        "row", F.when(left, F.col("start") - F.col("upto")).otherwise(F.col("start") + F.col("from")).alias("start"),
        F.when(left, F.col("start") - F.col("from")).otherwise(F.col("start") + F.col("upto")).alias("end"), "who", none)
    # Of the other documents' gaps between two paragraphs, the one nearest in length.
    pairs = ends.where("side = 2")
    widths = pairs.groupBy("class", "other", "gap").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("id").alias("who"))
    known = widths.groupBy("class", "other").agg(F.min("who").alias("who"), F.collect_list(F.struct("gap", "a", "b")).alias("gaps"))
    partner = F.expr("array_min(transform(filter(gaps, x -> x.gap <> gap or x.a <> x.b), x -> struct(abs(x.gap - gap) as off, x.gap as gap))).gap")
    bridges = pairs.where("edge").hint("merge").join(known.hint("merge"), ["class", "other"]).select("row", "start", "end", "who", partner.alias("partner")).where("partner is not null")
    claims = once.select("row", "start", "end", F.col("component_id").alias("who"), none).unionAll(more).unionAll(bridges)
    named = once.groupBy("row").agg(F.min("id").alias("id"))
    by_row = claims.groupBy("row").agg(F.collect_list(F.struct("start", "end", "who", "partner")).alias("claims")).hint("merge").join(named.hint("merge"), "row")

    out_columns = f"doc_id {kind}, start_word long, end_word long, n_words long, component_id {kind}"
    out_arrow = to_arrow_schema(_parse_datatype_string(out_columns))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = out_arrow
        for batch in _few(batches):
            found = []
            for i, claims in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found += [(i, a, b, b - a, who) for a, b, who in merged([(c["start"], c["end"], c["who"], c["partner"]) for c in claims], percent, min_words)]
            columns = zip(*found) if found else [[]] * len(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, wanted)], schema=wanted)

    parts = small_batches(by_row.select("id", "claims")).mapInArrow(stretches, out_columns)
    return parts.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
