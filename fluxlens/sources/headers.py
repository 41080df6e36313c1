"""Tables under other headers: aliases, rows found by name or code, and days that may occur once only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.functions import states


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def aliased(df: DataFrame, aliases: Mapping[str, Sequence[str]], *, required: Sequence[str]) -> DataFrame:
    """The columns of ``aliases`` under their own names: of each the first alias that the table has.

    A required name without any raises; an optional one is left out.
    """
    found = {name: next((a for a in own if a in df.columns), None) for name, own in aliases.items()}
    lost = [n for n in required if found.get(n) is None]
    if lost:
        raise ValueError(f"no column for {', '.join(lost)}")
    return df.select(*[F.col(_quoted(a)).alias(n) for n, a in found.items() if a is not None])


def typed_flows(df: DataFrame, *, on: str = "date", pattern: str = "yyyyMMdd", required: str = "individual_net_purchase") -> DataFrame:
    """Days and numbers out of text: rows without a day or the required number go, other numbers that can't be read are null."""
    values = [states.parse_number(F.col(c).cast("string")).alias(c) for c in df.columns if c != on]
    return df.select(F.to_date(F.try_to_timestamp(F.col(on), F.lit(pattern))).alias(on), *values).where(F.col(on).isNotNull() & F.col(required).isNotNull())


def once(df: DataFrame, keys: Sequence[str], error: str = "duplicate_dates") -> DataFrame:
    """The rows, if no key occurs twice; reading them fails with the error otherwise."""
    copies = F.count("*").over(Window.partitionBy(*keys))
    checked = F.when(copies > 1, F.raise_error(F.lit(error)).cast("boolean")).otherwise(F.lit(True))
    return df.withColumn("__once", checked).where("__once").drop("__once")


def plain_name(name: Column) -> Column:
    """A name without spaces, in lower case."""
    return F.lower(F.replace(F.trim(name), F.lit(" "), F.lit("")))


def first_named(df: DataFrame, name: str, names: Sequence[str], *, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each group the first row whose plain name is one of ``names``; groups without one have no row."""
    wanted = df.where(plain_name(F.col(name)).isin(*names))
    least = wanted.groupBy(*by).agg(F.min_by(F.struct(*[F.col(_quoted(c)) for c in df.columns]), F.struct(*order)).alias("row"))
    return least.select("row.*")


def code_of(fields: Sequence[str]) -> Column:
    """The first of the fields that isn't null or blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(F.col(f)), F.lit("")) for f in fields])


def last_per_code(df: DataFrame, fields: Sequence[str], wanted: DataFrame, *, order: Sequence[str]) -> DataFrame:
    """Rows whose code is in ``wanted`` (code), the last in the order for each code; with the code."""
    coded = df.withColumn("code", code_of(fields)).join(wanted.select("code").distinct(), "code", "left_semi")
    last = coded.groupBy("code").agg(F.max_by(F.struct(*[F.col(_quoted(c)) for c in df.columns]), F.struct(*order)).alias("row"))
    return last.select("code", "row.*")


def channels(df: DataFrame, *, suffix: str = "_net_purchase", least: int = 200) -> DataFrame:
    """channel, days and status of each column of flows that the table has: active from ``least`` days with a number on, collecting from one on, else planned."""
    names = [c for c in df.columns if c.endswith(suffix)]
    if not names:
        return df.sparkSession.createDataFrame([], "channel string, days long, status string")
    counted = df.agg(*[F.count_if(F.col(_quoted(c)).isNotNull() & ~F.isnan(F.col(_quoted(c)).cast("double"))).alias(_quoted(c).strip("`")) for c in names])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c.removesuffix(suffix)).alias("channel"), F.col(_quoted(c)).alias("days")) for c in names])).alias("c")).select("c.*")
    return rows.withColumn("status", F.when(F.col("days") >= least, "active").when(F.col("days") > 0, "collecting").otherwise("planned"))
