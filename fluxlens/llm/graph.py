"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import written

#: Links that one task joins up by itself.
LOCAL_LINKS = 500_000


class Forest:
    """Union-find whose roots are the smallest of their set."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        above = self.above
        path = []
        while (y := above.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            above[p] = x
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.above[b] = a
        self.above.setdefault(a, a)
        return True


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (u, v): label is the smallest node it is connected with.

    Tasks first join up ``LOCAL_LINKS`` links each.  What they leave, stars
    around local roots, is settled by taking the smallest label of all
    neighbours and then the label's own label, until nothing changes.
    """
    kind = links.schema["u"].dataType.simpleString()
    tasks = max(1, -(-links.count() // LOCAL_LINKS))

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = list(forest.above)
        for k in range(0, len(nodes), 50_000):
            part = nodes[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, batch.schema.field(0).type), pa.array([forest.root(x) for x in part], batch.schema.field(0).type)], names=["node", "label"])

    stars = written(links.select("u", "v").repartition(tasks).mapInArrow(contract, f"node {kind}, label {kind}"), "stars")
    if tasks == 1:
        return stars
    both = written(stars.where("node <> label").select(F.col("node").alias("u"), F.col("label").alias("v")).unionAll(stars.where("node <> label").select(F.col("label").alias("u"), F.col("node").alias("v"))).distinct(), "both")
    labels = written(stars.groupBy("node").agg(F.min("label").alias("label")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        lower = written(labels.join(near, labels["node"] == near["u"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("label")), "lower")
        own = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(lower.join(own, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = jumped.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        labels = jumped
        if not changed:
            return labels
