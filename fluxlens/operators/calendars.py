"""Calendars as bitmaps: a bit a day, a row for each name and bucket of 32768 days.

Days are numbered from 1970-01-01; earlier ones have buckets below 1.  A
calendar of a century takes two rows, so any number of them are united,
intersected and counted in one aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket.
BITS = 32_768


def bitmaps(days: DataFrame, by: Sequence[str], on: str = "date") -> DataFrame:
    """``by``, bucket and bitmap of the different days of each name; null days take no part."""
    number = F.unix_date(F.col(on)).cast("long")
    known = days.where(F.col(on).isNotNull()).select(*by, F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return known.groupBy(*by, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def days_of(bits: DataFrame, by: Sequence[str], column: str = "bitmap", on: str = "date") -> DataFrame:
    """A row for each day of the bitmaps: the bytes that aren't zero, then their bits."""
    # bitmap_bit_position gives day - 1 for days from 1 on, and counts down from zero below.
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length(column)), lambda k: F.conv(F.hex(F.substring(F.col(column), k, F.lit(1))), 16, 10).cast("int"))).alias("byte", "value")
    bytes_ = bits.select(*by, "bucket", byte).where("value <> 0")
    found = bytes_.select(*by, "bucket", "byte", "value", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.getbit("value", "k") == 1)
    bit = F.col("byte") * 8 + F.col("k")
    day = F.when(F.col("bucket") >= 1, (F.col("bucket") - 1) * BITS + bit + 1).otherwise(F.col("bucket") * BITS - bit)
    return found.select(*by, F.date_from_unix_date(day.cast("int")).alias(on))


def overlap(bits: DataFrame, names: Sequence[str], by: str = "name") -> DataFrame:
    """One row: days that all the named calendars have, days that any has, and their ratio."""
    some = bits.where(F.col(by).isin(*names))
    # A bucket that a calendar lacks has no common days.
    buckets = some.groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("common"), F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("whole"))
    common = F.coalesce(F.sum(F.when(F.col("n") == len(set(names)), F.col("common")).otherwise(F.lit(0))), F.lit(0))
    whole = F.coalesce(F.sum("whole"), F.lit(0))
    return buckets.agg(common.alias("common"), whole.alias("whole")).withColumn("jaccard", F.col("common") / F.greatest(F.lit(1), F.col("whole")))


def common_days(bits: DataFrame, names: Sequence[str], by: str = "name") -> DataFrame:
    """The days that all the named calendars have."""
    some = bits.where(F.col(by).isin(*names)).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bitmap").alias("bitmap"))
    return days_of(some.where(F.col("n") == len(set(names))), [])


def against_rest(bits: DataFrame, by: str = "name") -> DataFrame:
    """By calendar its number of days, and how many days of all calendars together it lacks: coverage of any number of them in one pass."""
    own = bits.groupBy(by).agg(F.sum(F.bitmap_count("bitmap")).alias("days"))
    whole = bits.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).agg(F.sum(F.bitmap_count("bitmap")).alias("whole"))
    return own.crossJoin(F.broadcast(whole)).select(by, "days", (F.col("whole") - F.col("days")).alias("missing"))  # one row


def differences(bits: DataFrame, one: str, two: str, by: str = "name") -> DataFrame:
    """Days that only one of two calendars has: ``side`` is 'missing' where the second lacks them, 'extra' where the first does.

    Bytes of both bitmaps are laid side by side; only bits that differ become rows.
    """
    def bytes_of(column: str) -> Column:
        return F.when(F.col(column).isNull(), F.array_repeat(F.lit(0), BITS // 8)).otherwise(
            F.transform(F.sequence(F.lit(1), F.lit(BITS // 8)), lambda k: F.coalesce(F.conv(F.hex(F.substring(F.col(column), k, F.lit(1))), 16, 10).cast("int"), F.lit(0))))

    pair = bits.groupBy("bucket").agg(F.max(F.when(F.col(by) == one, F.col("bitmap"))).alias("a"), F.max(F.when(F.col(by) == two, F.col("bitmap"))).alias("b"))
    laid = pair.select("bucket", F.posexplode(F.arrays_zip(bytes_of("a").alias("x"), bytes_of("b").alias("y"))).alias("byte", "p")).select("bucket", "byte", "p.x", "p.y").where("x <> y")
    found = laid.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.getbit("x", "k") != F.getbit("y", "k"))
    bit = F.col("byte") * 8 + F.col("k")
    day = F.when(F.col("bucket") >= 1, (F.col("bucket") - 1) * BITS + bit + 1).otherwise(F.col("bucket") * BITS - bit)
    return found.select(F.date_from_unix_date(day.cast("int")).alias("date"), F.when(F.getbit("x", "k") == 1, "missing").otherwise("extra").alias("side"))
