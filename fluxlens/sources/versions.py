"""A published history in versions: what didn't change isn't written again, and a version is there as a whole or not at all.

Rows are kept by month.  A version is a manifest: for each month the folder
that holds it, which may be that of an earlier version, and a tree of digests
over years, months and days.  The manifest is written last, under a name that
isn't there yet; until then readers see the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Levels of the tree and the length of the text of a date that names a node.
LEVELS = (("all", 0), ("year", 4), ("month", 7), ("day", 10))


def tree(df: DataFrame, on: str = "date") -> DataFrame:
    """level, node, parent and digest of each day, month and year of the rows, and of all.

    A day's digest is of the number of its rows and sums of their hashes, so
    it doesn't depend on their order; a node's above is of its nodes' in order
    (31 at most below a month, 12 below a year).  Null days are a day called
    'null'.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    # A null and an empty value differ, which a plain hash of columns doesn't tell.
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    hashed = df.select(F.coalesce(F.date_format(on, "yyyy-MM-dd"), F.lit("null")).alias("node"), F.sha2(row, 256).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    days = hashed.groupBy("node").agg(F.sha2(F.concat_ws(":", F.count("*"), *[F.sum(p) for p in parts]), 256).alias("digest"))
    levels, below = [days.select(F.lit("day").alias("level"), "node", "digest")], days
    for name, length in LEVELS[-2::-1]:
        below = below.groupBy(F.substring("node", 1, length).alias("node")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "node", "digest")))), 256).alias("digest"))
        levels.append(below.select(F.lit(name).alias("level"), "node", "digest"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    lengths = dict(LEVELS)
    above = {LEVELS[k][0]: LEVELS[k - 1][0] for k in range(1, len(LEVELS))}
    parent = F.coalesce(*[F.when(F.col("level") == n, F.substring("node", 1, lengths[p])) for n, p in above.items()])
    return found.withColumn("parent", parent)


def differing(old: DataFrame, new: DataFrame, down_to: str = "day") -> list[str]:
    """Nodes of a level that are not the same in both trees.

    Goes down from the top: of each level only what lies below a node that
    differs is looked at.
    """
    nodes = None
    for name, _ in LEVELS:
        a, b = (t.where(F.col("level") == name).select("node", "parent", "digest") for t in (old, new))
        if nodes is not None:
            a, b = (t.where(F.col("parent").isin(nodes)) for t in (a, b))
        both = a.join(b.withColumnsRenamed({"digest": "now", "parent": "p"}), "node", "full_outer").where(~F.col("digest").eqNullSafe(F.col("now")))
        nodes = sorted(r["node"] for r in both.select("node").collect())
        if not nodes or name == down_to:
            return nodes
    return nodes


@dataclass(frozen=True)
class Outcome:
    """What became of a publication: published, unchanged, frozen_changed or date_regression."""

    status: str
    version: int
    rewritten: tuple[str, ...] = ()
    days: tuple[str, ...] = ()


class History:
    """The versions below a folder of a file system that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root.rstrip("/")
        self._system, self._path = pyarrow.fs.FileSystem.from_uri(self._root)

    def versions(self) -> list[int]:
        found = self._system.get_file_info(pyarrow.fs.FileSelector(f"{self._path}/manifests", allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

    def _manifest(self, version: int | None) -> dict | None:
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return None
        with self._system.open_input_stream(f"{self._path}/manifests/{version}.json") as f:
            return json.loads(f.read().decode())

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last if none is named; None if there is none."""
        found = self._manifest(version)
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        folders = [f"{self._root}/{p}" for p in found["months"].values()]
        return self._spark.read.schema(schema).parquet(*folders) if folders else self._spark.createDataFrame([], schema)

    def digests(self, version: int | None = None) -> DataFrame | None:
        found = self._manifest(version)
        return None if found is None else self._spark.read.parquet(f"{self._root}/{found['tree']}")

    def publish(self, rows: DataFrame, *, on: str = "date", mutable: int = 5, frozen: bool = True) -> Outcome:
        """Makes the rows the next version, if they differ and may.

        ``date_regression`` where they end before the version before;
        ``frozen_changed`` where a day differs that isn't of its last
        ``mutable`` sessions (or newer); ``unchanged`` where no digest
        differs.  None of these writes a row.  Else the months that differ are
        written, and the others are taken over.
        """
        before = self._manifest(None)
        name = uuid.uuid4().hex
        # The tree has a row a day, whatever the days hold; it is written once, then compared and kept.
        tree(rows, on).write.parquet(f"{self._root}/trees/{name}")
        now = self._spark.read.parquet(f"{self._root}/trees/{name}")
        version, months = 1, {}
        if before is None:
            days = changed = sorted(r["node"] for r in now.where("level = 'month'").select("node").collect())
        else:
            version = before["version"] + 1
            old = self.digests()
            ends = [t.where("level = 'day' and node <> 'null'").agg(F.max("node")).first()[0] for t in (old, now)]
            if ends[0] is not None and (ends[1] is None or ends[1] < ends[0]):
                return Outcome("date_regression", before["version"])
            days = differing(old, now)
            if not days:
                return Outcome("unchanged", before["version"])
            last = [r["node"] for r in old.where("level = 'day' and node <> 'null'").orderBy(F.desc("node")).limit(mutable).collect()]
            late = [d for d in days if last and d < last[-1]]
            if frozen and late:
                return Outcome("frozen_changed", before["version"], days=tuple(late))
            changed = sorted({d[:7] for d in days})
            months = dict(before["months"])
        there = [r["node"] for r in now.where("level = 'month'").select("node").collect()]
        named = rows.withColumn("__month", F.coalesce(F.date_format(on, "yyyy-MM"), F.lit("null")))
        written = [m for m in changed if m in there]
        if written:
            named.where(F.col("__month").isin(written)).repartition("__month").write.partitionBy("__month").parquet(f"{self._root}/data/{name}")
        months = {m: p for m, p in months.items() if m in there} | {m: f"data/{name}/__month={m}" for m in written}
        text = json.dumps({"version": version, "schema": json.loads(rows.schema.json()), "tree": f"trees/{name}", "months": dict(sorted(months.items()))}, sort_keys=True)
        self._commit(version, text)
        return Outcome("published", version, tuple(written), tuple(days) if before is not None else ())

    def _commit(self, version: int, text: str) -> None:
        folder, beside = f"{self._path}/manifests", f"{self._path}/manifests/.{uuid.uuid4().hex}"
        self._system.create_dir(folder, recursive=True)
        if self._system.get_file_info(f"{folder}/{version}.json").type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(f"version {version} was published meanwhile")
        with self._system.open_output_stream(beside) as f:
            f.write(text.encode())
        self._system.move(beside, f"{folder}/{version}.json")


def refreshed(history: History, fetched: DataFrame, *, keys: Sequence[str] = ("date",), mutable: int = 5) -> Outcome:
    """One incremental run: the published rows are the seed, the fetched ones replace and extend its last sessions, and the result is published.

    Fetched rows of frozen days are compared too, so that a source that
    rewrites its past is told (``frozen_changed``) instead of taken over.
    """
    seed = history.read()
    if seed is None:
        return history.publish(fetched, mutable=mutable)
    fresh = fetched.select(*seed.columns)
    kept = seed.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return history.publish(kept.unionByName(fresh), mutable=mutable)
