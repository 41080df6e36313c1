"""Strict as-of alignment and neighbours of missing days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.operators import scan


def strictly_before(left: DataFrame, right: DataFrame, *, by: list[str], on: str, values: list[str], stamp: str, rows: int = scan.ROWS) -> DataFrame:
    """Adds to each left row the last right row of its group strictly before it.

    Both sides are laid into one timeline; on equal times right rows stand
    after left ones, which makes the match strict.  The last right row known
    is carried from part to part of the timeline, so a group may be of any
    length.  ``stamp`` names the matched time.
    """
    keys = [F.col(k) for k in by]
    a = left.withColumn("__side", F.lit(0)).withColumn("__match", F.lit(None).cast(_struct(right, on, values, stamp)))
    b = right.select(*keys, F.col(on), F.lit(1).alias("__side"), F.struct(F.col(on).alias(stamp), *values).alias("__match"))
    both = scan.running(a.unionByName(b, allowMissingColumns=True), by, [on, "__side"], {"__last": ("last", "__match")}, strict=True, rows=rows)
    return both.where("__side = 0").select(*[F.col(c) for c in left.columns], f"__last.{stamp}", *[f"__last.{v}" for v in values])


def _struct(right: DataFrame, on: str, values: list[str], stamp: str) -> str:
    fields = [f"{stamp}:{right.schema[on].dataType.simpleString()}", *[f"`{v}`:{right.schema[v].dataType.simpleString()}" for v in values]]
    return "struct<" + ",".join(fields) + ">"


def neighbours(days: DataFrame, known: DataFrame, *, by: list[str], on: str, values: list[str], rows: int = scan.ROWS) -> DataFrame:
    """For each day of a group the last known row before it and the first after it."""
    keys = [F.col(k) for k in by]
    found = known.select(*keys, F.col(on), F.lit(1).alias("__known"), F.struct(F.col(on).alias("at"), *values).alias("__v"))
    asked = days.select(*keys, F.col(on), F.lit(0).alias("__known"), F.lit(None).cast(found.schema["__v"].dataType).alias("__v"))
    both = scan.running(asked.unionByName(found), by, [on, "__known"], {"before": ("last", "__v")}, strict=True, rows=rows)
    # A known row of the very day counts for neither side: it stands after the asked one on the way there, and before it on the way back.
    both = both.withColumn("__back", -F.col("__known"))
    both = scan.running(both, by, [on, "__back"], {"after": ("last", "__v")}, strict=True, backwards=True, rows=rows)
    return both.where("__known = 0").select(*by, on, "before", "after")
