"""Daily features and paths by the distributed prefix scan: no task holds a whole line.

Their SQL is that of the plain window form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlens.operators import events, scan, selection
from fluxlens.sources import market

#: Sessions of a part: few, so that lines of some thousands have several.
PART = 512
DAY = ["date"]


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _with_returns(daily: DataFrame) -> DataFrame:
    back = {"before": lambda w: F.lag("close").over(w)}
    return scan.framed(daily, [], DAY, back, preceding=1, rows=PART).withColumn("return_1d", F.col("close") / F.nullif("before", F.lit(0.0)) - 1)


def _funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index and two of the funds that follow it, from its first close on."""
    daily = _daily(spark, sf_dir)
    base = daily.agg(F.min_by("close", "date").alias("base"))
    rise, fall = (lambda c: 100 * F.col(c) / F.col("base")), (lambda c: 100 * F.col("base") / F.col(c))
    legs = F.array(*[F.struct(F.lit(t).alias("ticker"), f("open").alias("open"), f("close").alias("close")) for t, f in (("IDX", F.col), ("L1", rise), ("S1", fall))])
    return daily.crossJoin(F.broadcast(base)).select("date", F.explode(legs).alias("leg")).select("leg.ticker", "date", "leg.open", "leg.close")  # one row


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rolling_signals(market.observations(_daily(spark, sf_dir)))


def b1_b7_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, full = (lambda w: w.rowsBetween(-251, 0)), (lambda c, frame, least: F.when(F.count("close").over(frame) >= least, c.over(frame)))
    found = scan.framed(_daily(spark, sf_dir), [], DAY, {
        "before": lambda w: F.lag("close").over(w),
        "mean50": lambda w: full(F.avg("close"), w.rowsBetween(-49, 0), 50),
        "top252": lambda w: full(F.max("close"), year(w), 252),
        "top20": lambda w: full(F.max("close"), year(w), 20),
    }, preceding=251, rows=PART)
    close = F.col("close")
    return found.select(
        "date", F.round(close / F.col("before") - 1, 8).alias("return_1d"), F.round(F.col("ck") * 1e-3 / F.col("trading_value"), 10).alias("flow_share"), F.round(F.col("ck") / 1e12, 14).alias("raw_flow_trillion"),
        F.round(100 * close / F.col("mean50"), 6).alias("disparity50"), F.round(close / F.col("top252") - 1, 8).alias("mdd252"), F.round(close / F.col("top20") - 1, 8).alias("drawdown20"),
    )


def f1_f2_lags_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"before": lambda w: F.lag("close").over(w), "top": lambda w: F.max("close").over(w.rowsBetween(-251, 0))}
    found = scan.framed(_funds(spark, sf_dir), ["ticker"], DAY, columns, preceding=251, rows=PART)
    return found.select("ticker", "date", F.round(F.col("close") / F.nullif("before", F.lit(0.0)) - 1, 8).alias("return_1d"), F.round("top", 8).alias("highest"))


def _drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.running(_funds(spark, sf_dir), ["ticker"], DAY, {"top": ("max", "close")}, rows=PART)
    return found.withColumn("drawdown", F.col("close") / F.col("top") - 1)


def f5_running_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawdowns(spark, sf_dir).select("ticker", "date", F.round("drawdown", 8).alias("drawdown"))


def f6_cumulative_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of each return, as a product: its logarithm is what a sum of logarithms gives."""
    half: Column = 1 + F.coalesce("return_1d", F.lit(0.0)) * 0.5
    found = scan.running(_with_returns(_daily(spark, sf_dir)), [], DAY, {"path": ("product", half)}, rows=PART)
    return found.select("date", F.round(F.ln("path"), 8).alias("log_path"))


def f8_previous_eligible_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = _states(spark, sf_dir).where("trade_eligible").select("channel", "date", "state")
    return scan.framed(eligible, ["channel"], DAY, {"before": lambda w: F.lag("state").over(w)}, preceding=1, rows=PART)


def f9_holding_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = scan.framed(_states(spark, sf_dir).select("channel", "date", "state"), ["channel"], DAY, {"before": lambda w: F.lag("state").over(w)}, preceding=1, rows=PART)
    change = F.when(F.col("state") == F.col("before"), 0).otherwise(1)
    found = scan.running(turned, ["channel"], DAY, {"segment": ("sum", change)}, rows=PART)
    return found.groupBy("channel", "segment", "state").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("sessions"))


def f10_drawdown_to_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.running(_drawdowns(spark, sf_dir).select("ticker", "date", "drawdown"), ["ticker"], DAY, {"deepest": ("min", "drawdown")}, rows=PART)
    return found.select("ticker", "date", F.round("deepest", 8).alias("deepest"))


def f11_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = scan.positions(_daily(spark, sf_dir).select("date", "close"), [], DAY, rows=PART)
    last = placed.agg(F.max("position").alias("last"))
    return placed.crossJoin(F.broadcast(last)).where((F.col("position") % 5 == 0) | (F.col("position") == F.col("last"))).select("date", F.round("close", 8).alias("close"))  # one row


def f12_index_to_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.running(_funds(spark, sf_dir), ["ticker"], DAY, {"base": ("first", "close")}, rows=PART)
    return found.select("ticker", "date", F.round(100 * F.col("close") / F.col("base"), 6).alias("indexed"))


def i1_extreme_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.extreme_entries(_states(spark, sf_dir))
    return found.select("channel", "date", "state", F.col("position").cast("bigint").alias("position"))


QUERIES = {f.__name__: f for f in (
    b1_b7_features, f1_f2_lags_and_frames, f5_running_drawdown, f6_cumulative_product, f8_previous_eligible_state, f9_holding_segments, f10_drawdown_to_date, f11_sampling, f12_index_to_100, i1_extreme_entries,
)}
