"""Incremental refresh: what of a published history may change, and whether it did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed(history: DataFrame, end: str, *, mutable: int = 5, least: int = 252) -> DataFrame:
    """The published rows up to ``end`` with ``is_frozen``: all but the last ``mutable`` sessions.

    Empty where fewer than ``least`` sessions are there to build on.  A day of
    a history is one row; the last ones are taken by a top-k, so no task sorts
    the history.
    """
    usable = history.where(F.col("date") <= F.lit(end).cast("date"))
    last = usable.select("date").orderBy(F.desc("date")).limit(mutable).agg(F.min("date").alias("__open"))
    size = usable.agg(F.count("*").alias("__whole"))
    known = usable.crossJoin(F.broadcast(last)).crossJoin(F.broadcast(size))  # one row each
    return known.where(F.col("__whole") >= least).withColumn("is_frozen", F.coalesce(F.col("date") < F.col("__open"), F.lit(True))).drop("__open", "__whole")


def scale_stability(frozen: DataFrame, fetched: DataFrame, boundary: str, *, anchors: int = 6, least: int = 3, tolerance: float = 0.005) -> DataFrame:
    """By ticker: whether freshly fetched closes continue the frozen scale on the last common days before the boundary."""
    common = frozen.where(F.col("date") < F.lit(boundary).cast("date")).select("ticker", "date", F.col("close").alias("was")).join(fetched.select("ticker", "date", F.col("close").alias("now")), ["ticker", "date"])
    last = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    sound = (F.col("was") > 0) & (F.col("now") > 0)
    found = common.withColumn("back", last).where(F.col("back") <= anchors).groupBy("ticker").agg(
        F.count("*").alias("anchors"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("invalid"), F.max(F.abs(F.try_divide("now", "was") - 1)).alias("drift"))
    state = F.when(F.coalesce("anchors", F.lit(0)) < least, "insufficient").when(F.col("invalid") > 0, "invalid").when(F.col("drift") > tolerance, "drifted").otherwise("stable")
    return frozen.select("ticker").distinct().join(found, "ticker", "left").select("ticker", F.coalesce("anchors", F.lit(0)).alias("anchors"), "drift", state.alias("state"))


def signature(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(signature,): SHA-256 over the rows' values in the order of the key, by months first, so that no value holds all rows.

    Columns that change with every run, such as the time it was made, are left out by not being named.
    """
    row = F.to_json(F.struct(key, *values), {"ignoreNullFields": "false"})
    months = rows.groupBy(F.date_trunc("month", F.col(key).cast("timestamp")).alias("month")).agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("v")))), lambda x: x["v"])), 256).alias("hash"))
    return months.agg(F.sha2(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("month", "hash"))), lambda x: x["hash"])), 256).alias("signature"))


def inherited(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Reports of gap repairs with those that an earlier run had made: ticker, state, filled, sample (of at most three days).

    Only reports that are in order on both sides carry over.
    """
    old = prior.where((F.col("state") == "ok") & (F.col("filled") > 0)).select("ticker", F.col("filled").alias("inherited"), F.col("sample").alias("old_sample"))
    joined = current.join(old, "ticker", "left")
    carried = (F.col("state") == "ok") & F.col("inherited").isNotNull()
    sample = F.slice(F.array_distinct(F.concat(F.coalesce("old_sample", F.array().cast("array<string>")), "sample")), 1, 3)
    return joined.select(
        "ticker", "state", F.when(carried, F.col("filled") + F.col("inherited")).otherwise(F.col("filled")).alias("filled"),
        F.when(carried, F.col("inherited")).otherwise(0).alias("inherited"), F.when(carried, sample).otherwise(F.col("sample")).alias("sample"),
        F.when(carried, "published_history_plus_current").otherwise("current").alias("provenance"))


def ordered_reasons(*reasons: Column) -> Column:
    """The distinct reasons of several lists, in order of their first mention."""
    return F.array_distinct(F.array_compact(F.concat(*reasons)))
