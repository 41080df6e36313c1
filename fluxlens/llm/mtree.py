"""Exact top-k inner products by best-first search in M-trees."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.llm.common import small_batches, written

#: Vectors of one tree, and queries that are searched in it together.
SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: A tile: trees that one task searches in turn, and bytes of queries that it holds meanwhile.
TILE_TREES = 16
TILE_BYTES = 48 << 20
#: Entries of a leaf page, and of the pages above.
LEAF, FANOUT = 64, 16
#: Products up to which floating point is exact.
EXACT = float(1 << 53)


def _distance(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    away = points - to
    return np.sqrt(np.einsum("ij,ij->i", away, away))


class MTree:
    """Pages of vectors under a metric that orders them as the inner product does.

    With M the greatest norm, each vector x gets one more component,
    sqrt(M^2 - |x|^2), and a query q gets 0; then |q-x|^2 = |q|^2 + M^2 - 2qx,
    so the nearest vectors are those of the largest inner product.  A page has
    a routing vector, a covering radius and, for each entry, its distance from
    the routing vector (the parent distance).  All pages of a level have the
    same height above the vectors.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        own = vectors.astype(np.float64)
        square = (own * own).sum(axis=1)
        self.most = float(square.max(initial=0.0))
        points = np.column_stack((own, np.sqrt(np.maximum(self.most - square, 0.0))))
        order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
        while todo:  # halves by the distance to two far vectors, cut at a page's end
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            part = points[order[a:b]]
            far = part[_distance(part, part[0]).argmax()]
            other = part[_distance(part, far).argmax()]
            half = -(-(b - a) // (2 * LEAF)) * LEAF
            by = np.argpartition(_distance(part, far) - _distance(part, other), half - 1)
            order[a:b] = order[a:b][by]
            todo += [(a + half, b), (a, a + half)]
        self.vectors, self.ids, points = vectors[order], ids[order], points[order]
        # Pages by number: span of entries (of vectors, or of the level below), router, radius, entries' parent distances.
        self.levels: list[dict[str, np.ndarray]] = []
        spans = covers = leaves
        below: np.ndarray | None = None
        while True:
            routers, radii, parents = [], [], []
            for (a, b), (low, high) in zip(spans, covers):
                part = points[low:high]
                entries = part if below is None else below[a:b]
                router = entries[_distance(entries, part.mean(axis=0)).argmin()] if len(part) else np.zeros(points.shape[1])
                routers.append(router)
                radii.append(_distance(part, router).max(initial=0.0))
                parents.append(_distance(entries, router))
            self.levels.append({"span": np.array(spans), "router": np.array(routers), "radius": np.array(radii), "parent": np.concatenate(parents)})
            if len(spans) <= 1:
                break
            below = np.array(routers)
            groups = [(k, min(k + FANOUT, len(spans))) for k in range(0, len(spans), FANOUT)]
            covers = [(covers[a][0], covers[b - 1][1]) for a, b in groups]
            spans = groups
        self.computed = 0

    def packed(self) -> bytes:
        """The pages as bytes."""
        out = io.BytesIO()
        arrays = {"vectors": self.vectors, "ids": self.ids, "most": np.array(self.most), "height": np.array(len(self.levels))}
        np.savez(out, **arrays, **{f"{name}{k}": x for k, level in enumerate(self.levels) for name, x in level.items()})
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> MTree:
        held, tree = np.load(io.BytesIO(data)), MTree.__new__(MTree)
        tree.vectors, tree.ids, tree.most, tree.computed = held["vectors"], held["ids"], float(held["most"]), 0
        tree.levels = [{name: held[f"{name}{k}"] for name in ("span", "router", "radius", "parent")} for k in range(int(held["height"]))]
        return tree

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and ids (queries x k) of the largest scores, ties to smaller ids, without each query's own id; how many there are.

        ``known`` are the scores and ids that other trees have given: what
        can't be among the best with them isn't looked at.

        Best first for all queries together: the page that may be nearest to
        one of them comes next, with the queries it is still in reach of.
        Stored parent distances leave out entries that no such query can
        reach; what is left is computed for all of them in a matrix product.
        """
        count = len(queries)
        least = np.iinfo(np.int64).min
        none = np.iinfo(np.int64).max
        scores, found = (known[0].copy(), known[1].copy()) if known else (np.full((count, k), least), np.full((count, k), none))
        if not len(self.ids) or not count:
            return scores, found, (found != none).sum(axis=1)
        asked = queries.astype(np.float64)
        square = (asked * asked).sum(axis=1)
        base = square + self.most
        # Products of up to the norms' product are whole numbers in floating point.
        exact = np.sqrt(square.max() * self.most) < EXACT
        vectors, asking = (self.vectors.astype(np.float64), asked) if exact else (self.vectors, queries)
        # Slack for what floating point loses in distances; scores themselves are exact.
        slack = 1e-6 * (1.0 + np.sqrt(self.most + square.max()))
        reach = np.where(found[:, -1] != none, np.sqrt(np.maximum(base - 2.0 * scores[:, -1].astype(np.float64), 0.0)), np.inf)  # distance of the k-th best so far

        def distances(points: np.ndarray, which: np.ndarray) -> np.ndarray:
            self.computed += len(points) * len(which)
            return np.sqrt(np.maximum(base[which, None] - 2.0 * (asked[which] @ points[:, :-1].T), 0.0))

        top, every = len(self.levels) - 1, np.arange(count)
        root = distances(self.levels[top]["router"], every)[:, 0]
        bound = np.maximum(root - self.levels[top]["radius"][0], 0.0)
        heap, pushed = [(float(bound.min()), 0, top, 0, every, root, bound)], 1
        while heap:
            _, _, level, page, which, to_router, bound = heapq.heappop(heap)
            near = bound <= reach[which] + slack
            which, to_router = which[near], to_router[near]
            if not len(which):
                continue
            pages = self.levels[level]
            a, b = pages["span"][page]
            gap = np.abs(to_router[:, None] - pages["parent"][None, a:b])  # no distance is below this
            limit = (reach[which] + slack)[:, None]
            if level:
                under = self.levels[level - 1]
                entries = a + np.flatnonzero((gap - under["radius"][None, a:b] <= limit).any(axis=0))
                if not len(entries):
                    continue
                to = distances(under["router"][entries], which)
                bounds = np.maximum(np.maximum(to - under["radius"][None, entries], bound[near][:, None]), 0.0)
                for at, entry in enumerate(entries.tolist()):
                    own = np.flatnonzero(bounds[:, at] <= limit[:, 0])
                    if len(own):
                        heapq.heappush(heap, (float(bounds[own, at].min()), pushed, level - 1, entry, which[own], to[own, at], bounds[own, at]))
                        pushed += 1
                continue
            entries = a + np.flatnonzero((gap <= limit).any(axis=0))
            if not len(entries):
                continue
            self.computed += len(entries) * len(which)
            got = (asking[which] @ vectors[entries].T).astype(np.int64)
            ids = self.ids[entries]
            # Queries that the page has something for: better than the k-th, or as good with a smaller id.
            better = (got > scores[which, -1:]) | ((got == scores[which, -1:]) & (ids[None, :] < found[which, -1:]))
            better &= ids[None, :] != own_ids[which, None]
            rows = np.flatnonzero(better.any(axis=1))
            if not len(rows):
                continue
            them = which[rows]
            all_scores = np.concatenate((scores[them], np.where(better[rows], got[rows], least)), axis=1)
            all_ids = np.concatenate((found[them], np.where(better[rows], ids[None, :], none)), axis=1)
            order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[them], found[them] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)
            full = found[them, -1] != none
            reach[them[full]] = np.sqrt(np.maximum(base[them[full]] - 2.0 * scores[them[full], -1].astype(np.float64), 0.0))
        return scores, found, (found != none).sum(axis=1)


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group; repeated rows once."""
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    both = np.unique(np.column_stack((ids, flat.reshape(len(ids), -1))), axis=0)
    return both[:, 0], both[:, 1:]


def _packed(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, vectors=vectors)
    return out.getvalue()


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0) -> DataFrame:
    """For each query row the ``k`` other rows of the largest integer inner product.

    ``vectors`` has vec_id and embedding; components become floor(scale * x).
    The rows are dealt by a hash of vec_id and vector to trees of about ``SHARD_ROWS``
    vectors, and the stated queries to blocks of about ``QUERY_ROWS``; each
    tree is built once and each block packed once.  Every block meets every
    tree, in tiles of ``TILE_TREES`` trees and ``TILE_BYTES`` of queries: a
    task holds a tile's queries and takes its trees one by one, and what a
    tree gave bounds the search of the next.  Each search is exact, and so is
    the best of all tiles' answers.

    Returns query_id, rank (from 1), vec_id, score.  Rows without vec_id, and
    vectors that are null, empty or hold null or non-finite components, take no
    part; vectors of different lengths don't meet; equal rows count once; a
    query with fewer than k candidates gets those; ties go to smaller vec_id.
    Products that floating point can't hold are computed in 64-bit integers.
    Other columns play no part.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
        .select("vec_id", is_query.alias("asks"), F.size("embedding").alias("length"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    )
    sizes = whole.groupBy("length").agg(F.count("*").alias("rows"), F.count_if("asks").alias("queries"))
    parts = written(sizes.where("queries > 0").select("length", F.ceil(F.col("rows") / SHARD_ROWS).alias("shards"), F.ceil(F.col("queries") / QUERY_ROWS).alias("blocks")), "parts")
    # A row for each length of vector.
    dealt = whole.join(F.broadcast(parts), "length").withColumn("own", F.xxhash64("vec_id", "vector"))

    def build(group: pa.Table) -> pa.Table:
        ids, own = _rows(group)
        first = group.slice(0, 1)
        return pa.table({"length": first.column("length"), "shard": first.column("shard"), "pages": pa.array([MTree(own, ids).packed()], pa.binary())})

    def pack(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1)
        return pa.table({"length": first.column("length"), "block": first.column("block"), "queries": pa.array([_packed(*_rows(group))], pa.binary())})

    trees = dealt.select("length", F.pmod("own", "shards").alias("shard"), "vec_id", "vector").groupBy("length", "shard").applyInArrow(build, "length int, shard long, pages binary")
    asked = dealt.where("asks").select("length", F.pmod("own", "blocks").alias("block"), "vec_id", "vector").groupBy("length", "block").applyInArrow(pack, "length int, block long, queries binary")
    trees, asked = written(trees, "trees"), written(asked, "blocks")

    # A tile is some neighbouring trees and blocks: a tree is copied once for each strip of blocks, a block for each strip of trees.
    in_strip = F.greatest(F.lit(1), F.lit(TILE_BYTES) / (F.lit(8 * QUERY_ROWS) * F.col("length"))).cast("long")
    strips = F.broadcast(parts.select("length", "shards", "blocks", in_strip.alias("in_strip")))

    def each(n: str, size: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / size)))

    of_trees = trees.join(strips, "length").select(
        "length", F.floor(F.col("shard") / TILE_TREES).alias("trees"), each("blocks", F.col("in_strip")).alias("strip"), F.lit(1).alias("side"), F.col("shard").alias("number"), F.col("pages").alias("data"))
    of_blocks = asked.join(strips, "length").select(
        "length", each("shards", F.lit(TILE_TREES)).alias("trees"), F.floor(F.col("block") / F.col("in_strip")).alias("strip"), F.lit(0).alias("side"), F.col("block").alias("number"), F.col("queries").alias("data"))
    tiles = of_trees.unionAll(of_blocks).repartition("length", "trees", "strip").sortWithinPartitions("length", "trees", "strip", "side", "number")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: tuple | None = None
        held: dict[int, dict[str, np.ndarray]] = {}

        def answers() -> Iterator[pa.RecordBatch]:
            for number, block in held.items():
                at = np.flatnonzero(block["found"].ravel() != np.iinfo(np.int64).max)
                # Queries of one id and several vectors are told apart by their places in the blocks.
                yield pa.RecordBatch.from_pydict({
                    "length": pa.array(np.full(len(at), tile[0], np.int32)), "block": np.full(len(at), number, np.int64), "place": at // k,
                    "query_id": block["ids"][at // k], "vec_id": block["found"].ravel()[at], "score": block["scores"].ravel()[at]})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for row, (*name, side, number) in enumerate(zip(*columns)):
                if tile != tuple(name):
                    yield from answers()
                    tile, held = tuple(name), {}
                data = batch.column(5)[row].as_py()
                if not side:
                    own = np.load(io.BytesIO(data))
                    shape = (len(own["ids"]), k)
                    held[number] = {"ids": own["ids"], "vectors": own["vectors"], "scores": np.full(shape, np.iinfo(np.int64).min), "found": np.full(shape, np.iinfo(np.int64).max)}
                    continue
                tree = MTree.unpacked(data)
                for block in held.values():
                    block["scores"], block["found"], _ = tree.search(block["vectors"], block["ids"], k, (block["scores"], block["found"]))
        yield from answers()

    found = small_batches(tiles).mapInArrow(search, "length int, block long, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("length", "block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
