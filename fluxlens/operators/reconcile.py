"""Cross-checks of two price sources, and repair of adjusted histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.operators.asof import neighbours


def latest_close(primary: DataFrame, secondary: DataFrame, *, tolerance: float = 0.005) -> DataFrame:
    """By ticker: whether both sources agree on the close of the primary's last day."""
    last = primary.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("primary_close"))
    other = secondary.select("ticker", "date", F.col("close").alias("secondary_close"))
    gap = F.abs(F.col("primary_close") - F.col("secondary_close")) / F.nullif(F.abs("primary_close"), F.lit(0.0))
    return last.join(other, ["ticker", "date"], "left").select(
        "ticker", "date", "primary_close", "secondary_close", gap.alias("gap"),
        F.when(F.col("secondary_close").isNull() | F.col("primary_close").isNull(), "unavailable").when(gap <= tolerance, "ok").otherwise("mismatch").alias("state"),
    )


def anchors(primary: DataFrame, secondary: DataFrame, *, expected: str | None = None, count: int = 4, least: int = 3, tolerance: float = 0.005) -> DataFrame:
    """By ticker: agreement on evenly spaced common days up to the expected one (halves are rounded to even places).

    Unavailable, with the first reason that holds: duplicate_dates,
    missing_prices, expected_date_not_common (it is not the last day of both),
    insufficient_common_anchors, invalid_close.  Without an expected day it is
    the primary's last.
    """
    sides = []
    for name, prices in (("a", primary), ("b", secondary)):
        days = prices.groupBy("ticker", "date").agg(F.count("*").alias("copies"))
        sides.append(days.groupBy("ticker").agg(F.max("date").alias(f"last_{name}"), F.max("copies").alias(f"copies_{name}")))
    known = sides[0].join(sides[1], "ticker", "full").withColumn("expected", F.lit(expected).cast("date") if expected else F.col("last_a"))
    common = primary.select("ticker", "date", F.col("close").alias("a")).join(secondary.select("ticker", "date", F.col("close").alias("b")), ["ticker", "date"]).join(known.select("ticker", "expected"), "ticker").where("date <= expected").drop("expected")
    whole = Window.partitionBy("ticker")
    placed = common.withColumn("place", F.row_number().over(whole.orderBy("date")) - 1).withColumn("n", F.count("*").over(whole)).withColumn("steps", F.least(F.lit(count), F.col("n")) - 1)
    spots = F.when(F.col("steps") < 1, F.array(F.col("n") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.col("steps"), F.lit(1)).cast("int")), lambda k: F.bround(k * (F.col("n") - 1) / F.greatest(F.col("steps"), F.lit(1)), 0).cast("bigint")))
    chosen = placed.where(F.array_contains(spots, F.col("place").cast("bigint")))
    gap = F.abs(F.try_divide("a", "b") - 1)
    found = chosen.groupBy("ticker").agg(F.count("*").alias("checked"), F.max("n").alias("common"), F.count_if(gap > tolerance).alias("over"), F.max(gap).alias("gap"), F.count_if(~((F.col("a") > 0) & (F.col("b") > 0))).alias("invalid"))
    joined = known.join(found, "ticker", "left")
    not_last = ~(F.col("last_a").eqNullSafe(F.col("expected")) & F.col("last_b").eqNullSafe(F.col("expected")))
    reason = (
        F.when((F.coalesce("copies_a", F.lit(0)) > 1) | (F.coalesce("copies_b", F.lit(0)) > 1), "duplicate_dates").when(F.col("last_a").isNull() | F.col("last_b").isNull(), "missing_prices")
        .when(not_last, "expected_date_not_common").when(F.coalesce("common", F.lit(0)) < min(max(1, least), count), "insufficient_common_anchors").when(F.col("invalid") > 0, "invalid_close")
    )
    usable = reason.isNull()
    return joined.select(
        "ticker", F.when(usable, F.col("checked")).otherwise(0).alias("anchors"), F.when(usable, F.col("over")).otherwise(0).alias("mismatches"), F.when(usable, F.col("gap")).alias("widest"),
        F.when(~usable, "unavailable").when(F.col("over") > 0, "mismatch").otherwise("ok").alias("state"), F.coalesce(reason, F.when(F.col("over") > 0, "historical_anchor_difference_exceeded")).alias("reason"))


def combined(primary: DataFrame, secondary: DataFrame, *, expected: str, tolerance: float = 0.005, zone: str | None = None) -> DataFrame:
    """By ticker: agreement on the latest close and on six anchors, both of what was known at the end of the expected day.

    Times become days (in ``zone``, where they are instants) before anything
    is compared.  The anchors are told beside the latest check, and never
    change its state.
    """
    sides = [as_of(p, expected, zone=zone) for p in (primary, secondary)]
    latest = latest_close(*sides, tolerance=tolerance)
    # A last day before the expected one can't be checked.
    on_day = F.when(F.col("date") == F.lit(expected).cast("date"), F.col("state")).otherwise("unavailable")
    past = anchors(*sides, expected=expected, count=6, least=3, tolerance=tolerance)
    told = past.select("ticker", "anchors", "mismatches", F.col("widest").alias("anchor_gap"), F.col("state").alias("anchor_state"), F.col("reason").alias("anchor_reason"))
    return latest.select("ticker", "date", "gap", on_day.alias("state")).join(told, "ticker", "full")


def as_of(prices: DataFrame, cutoff: str, *, zone: str | None = None, on: str = "date") -> DataFrame:
    """Rows up to the cutoff day; instants become days of the zone first."""
    day = F.to_date(F.from_utc_timestamp(on, zone)) if zone else F.to_date(on)
    return prices.withColumn(on, day).where(F.col(on) <= F.lit(cutoff).cast("date"))


def finite_rows(df: DataFrame, fields: list[str], *, end: str, on: str = "date") -> DataFrame:
    """Rows up to the end day whose named fields are all finite numbers; a field that isn't numeric, truth values included, has none."""
    kinds = dict(df.dtypes)
    numeric = ("double", "float", "tinyint", "smallint", "int", "bigint")
    met = F.col(on) <= F.lit(end).cast("date")
    for c in fields:
        value = F.col(c).cast("double") if kinds[c] in numeric or kinds[c].startswith("decimal") else F.lit(None).cast("double")
        met = met & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return df.where(met)


def chosen_source(history: DataFrame, recent: DataFrame, expected: DataFrame, *, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Prices of one source a ticker, and why: (ticker, date, close, source), (ticker, source, reason).

    The history, unless it has no row of the ticker, or disagrees with the
    recent source on that one's last day; then the recent source, whole.
    ``expected`` has the tickers; one that neither source has gets no prices
    and the source 'none'.
    """
    there = lambda df, name: df.groupBy("ticker").agg(F.count("*").alias(name))
    agrees = latest_close(recent, history, tolerance=tolerance).select("ticker", F.col("state").alias("check"))
    known = expected.join(there(history, "old"), "ticker", "left").join(there(recent, "new"), "ticker", "left").join(agrees, "ticker", "left")
    source = F.when(F.col("old").isNull() & F.col("new").isNull(), "none").when(F.col("old").isNull() | (F.col("check") != "ok"), "recent").otherwise("history")
    reason = F.when(F.col("old").isNull(), "history_unavailable").when(F.col("check") != "ok", "provider_disagreement")
    told = known.select("ticker", source.alias("source"), reason.alias("reason"))
    both = history.select("ticker", "date", "close", F.lit("history").alias("source")).unionByName(recent.select("ticker", "date", "close", F.lit("recent").alias("source")))
    return both.join(told.select("ticker", "source"), ["ticker", "source"], "left_semi"), told


def repair_gaps(official: DataFrame, adjusted: DataFrame, *, tolerance: float = 0.005) -> DataFrame:
    """Fills official sessions that the adjusted history lacks.

    The factor between both sources is taken on the common sessions before and
    after; where the two differ by at most ``tolerance`` (relative to the
    larger) their mean scales the official bar.  A ticker with an unresolved
    session is unavailable as a whole.
    """
    own = adjusted.select("ticker", "date", F.col("close").alias("adjusted_close"))
    common = official.join(own, ["ticker", "date"]).withColumn("factor", F.col("adjusted_close") / F.nullif("close", F.lit(0.0)))
    missing = official.join(own, ["ticker", "date"], "left_anti")
    near = neighbours(missing, common, by=["ticker"], on="date", values=["factor"])
    a, b = F.col("before.factor"), F.col("after.factor")
    fits = a.isNotNull() & b.isNotNull() & (F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b)))
    filled = missing.join(near, ["ticker", "date"]).withColumn("factor", F.when(fits, (a + b) / 2))
    bad = filled.groupBy("ticker").agg(F.count_if(F.col("factor").isNull()).alias("unresolved"))
    rows = filled.select("ticker", "date", (F.col("open") * F.col("factor")).alias("open"), (F.col("close") * F.col("factor")).alias("close"), F.lit(True).alias("filled"))
    whole = adjusted.select("ticker", "date", "open", "close", F.lit(False).alias("filled")).unionByName(rows)
    return whole.join(bad.where("unresolved > 0"), "ticker", "left_anti")


def upsert(frozen: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables, the recent row where a key is in both."""
    return frozen.join(recent, keys, "left_anti").unionByName(recent)


def differing(one: DataFrame, other: DataFrame, keys: list[str], values: dict[str, float]) -> DataFrame:
    """Rows that only one table has, or whose values differ by more than their tolerance."""
    a = one.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = other.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    apart = F.col("in_a").isNull() | F.col("in_b").isNull()
    for v, t in values.items():
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        apart = apart | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > t, F.lit(False))
    return a.join(b, keys, "full_outer").where(apart)
