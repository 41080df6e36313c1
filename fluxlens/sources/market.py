"""Daily market tables from the order book, and the long price table of derived funds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events".split()
#: Index, and funds that follow it once, twice, inversely and twice inversely.
FUNDS = ("IDX", "L1", "L2", "S1", "S2")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names or TABLES}


def market_daily(orders: DataFrame) -> DataFrame:
    """One bar a day: close, open, trading value, and the sum of customer keys that seeds flows.

    Summed by day before anything else: windows then run over a few thousand rows.
    """
    # Whole cents: their sum doesn't depend on the order.
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (cents / (F.lit(100.0) * F.count("*"))).alias("close"),
        ((F.min("o_totalprice") + F.max("o_totalprice")) / 2).alias("open"),
        (cents / 100.0).alias("trading_value"),
        F.sum("o_custkey").alias("ck"),
    )


def observations(daily: DataFrame) -> DataFrame:
    """Returns and two flow channels in long form: ``main`` follows the return closely, ``noisy`` loosely."""
    whole = Window.partitionBy(F.lit(1)).orderBy("date")
    x = F.col("close") / F.nullif(F.lag("close").over(whole), F.lit(0.0)) - 1
    based = daily.withColumn("return_1d", x)
    channels = F.explode(F.array(*[F.struct(F.lit(name).alias("channel"), F.lit(scale).alias("scale")) for name, scale in (("main", 200.0), ("noisy", 5.0))]))
    return (
        based.withColumn("c", channels)
        .withColumn("flow_share", -0.8 * F.col("return_1d") + (F.col("ck") % 13 - 6) / F.col("c.scale"))
        .select("c.channel", "date", "open", "close", "trading_value", "return_1d", "flow_share")
    )


def prices(daily: DataFrame) -> DataFrame:
    """Long table ticker, date, open, close of the index and four funds derived from it."""
    whole = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.col("base")
    up, down = (lambda c: F.col(c) / base), (lambda c: base / F.col(c))
    rows = [("IDX", F.col), ("L1", lambda c: 100 * up(c)), ("L2", lambda c: 100 * up(c) * up(c)), ("S1", lambda c: 100 * down(c)), ("S2", lambda c: 100 * down(c) * down(c))]
    legs = F.array(*[F.struct(F.lit(t).alias("ticker"), f("open").alias("open"), f("close").alias("close")) for t, f in rows])
    return daily.withColumn("base", F.first("close").over(whole)).withColumn("leg", F.explode(legs)).select("leg.ticker", "date", "leg.open", "leg.close")
