"""Declared rules about tables, checked together: each table is read once, and all rules share one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

SCHEMA = "rule string, table_name string, violations long, first_key string, last_key string"


@dataclass(frozen=True)
class Rule:
    """``rows``: a condition that each row must meet; ``neighbours``: one on a row and the one before it;
    ``unique``: columns whose values occur once; ``within``: values that another table has too."""

    table: str
    name: str
    kind: str
    holds: Column | None = None
    columns: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    on: tuple[str, ...] = ()
    other: str = ""
    before: dict[str, str] = field(default_factory=dict)


def holds(table: str, name: str, condition: Column) -> Rule:
    """A condition on each row; where it is null it isn't met."""
    return Rule(table, name, "rows", condition)


def present(table: str, column: str) -> Rule:
    return holds(table, f"{column}_present", F.col(column).isNotNull())


def ranged(table: str, column: str, low: float | None = None, high: float | None = None) -> Rule:
    """Bounds, both of them allowed; nulls pass, other than numbers don't."""
    c = F.col(column)
    inside = [~F.isnan(c.cast("double"))] + ([c >= low] if low is not None else []) + ([c <= high] if high is not None else [])
    return holds(table, f"{column}_range", c.isNull() | reduce(Column.__and__, inside))


def positive(table: str, column: str) -> Rule:
    """A finite number above zero; null isn't."""
    c = F.col(column).cast("double")
    return holds(table, f"{column}_positive", (c > 0) & (c < float("inf")))


def one_of(table: str, column: str, values: Sequence[str]) -> Rule:
    return holds(table, f"{column}_known", F.col(column).isin(*values))


def matching(table: str, column: str, pattern: str) -> Rule:
    return holds(table, f"{column}_form", F.col(column).cast("string").rlike(pattern))


def unique(table: str, *columns: str) -> Rule:
    return Rule(table, "_".join(columns) + "_unique", "unique", columns=columns)


def within(table: str, columns: Sequence[str], other: str, name: str) -> Rule:
    """Every value of the columns is one of the other table's columns of the same names."""
    return Rule(table, name, "within", columns=tuple(columns), other=other)


def neighbours(table: str, name: str, by: Sequence[str], on: Sequence[str], columns: Sequence[str], condition: Callable[[dict[str, Column]], Column]) -> Rule:
    """A condition on a row and the row before it in its group (named by its columns); the first row passes."""
    before = {c: f"__before_{name}_{c}" for c in columns}
    met = condition({c: F.col(b).getField("value") for c, b in before.items()})
    first = F.col(next(iter(before.values()))).isNull()
    return Rule(table, name, "neighbours", first | met, by=tuple(by), on=tuple(on), before=before)


def _key(columns: Sequence[str]) -> Column:
    """Values as text, joined; null is told from empty text."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def violations(tables: dict[str, DataFrame], keys: dict[str, Sequence[str]], rules: Sequence[Rule]) -> DataFrame:
    """For each rule how often it is broken, and the least and greatest key of a row that breaks it.

    ``keys`` names the columns of each table that tell its rows apart.  For
    ``unique`` the keys are those that occur more than once, each counted once.
    Rules that hold have a row too.  A row of a table becomes a mark for each
    rule that it breaks, and one for each value that must be unique or is
    looked for; marks are counted by rule and key, map-side first, so neither
    broken rules nor common values gather in one task.  Neighbours need their
    group in one task.
    """
    names = [(r.table, r.name) for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rules of a table must have different names")
    mark = "struct<rule:int,key:string,side:int>"
    all_marks = []
    for table in sorted(tables):
        df, marks = tables[table], []
        for k, r in enumerate(rules):
            if r.table == table and r.kind == "neighbours":
                line = Window.partitionBy(*r.by).orderBy(*r.on)
                # A value that is there and null is not the same as no row before.
                df = df.withColumns({b: F.lag(F.struct(F.col(c).alias("value"))).over(line) for c, b in r.before.items()})
        for k, r in enumerate(rules):
            if r.table == table and r.kind in ("rows", "neighbours"):
                marks.append(F.when(~F.coalesce(r.holds, F.lit(False)), F.struct(F.lit(k), _key(keys[table]), F.lit(0)).cast(mark)))
            elif r.table == table:
                marks.append(F.struct(F.lit(k), _key(r.columns), F.lit(0)).cast(mark))
            if r.other == table:
                marks.append(F.struct(F.lit(k), _key(r.columns), F.lit(1)).cast(mark))
        if marks:
            all_marks.append(df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).select("m.*"))
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(k, r.kind, r.name, r.table) for k, r in enumerate(rules)], "rule int, kind string, name string, table_name string")
    listed = F.broadcast(listed)  # a row for each rule
    counted = reduce(DataFrame.unionByName, all_marks).groupBy("rule", "key").agg(F.count_if(F.col("side") == 0).alias("own"), F.count_if(F.col("side") == 1).alias("others"))
    broken = F.when(F.col("kind") == "unique", (F.col("own") > 1).cast("long")).when(F.col("kind") == "within", F.when(F.col("others") == 0, F.col("own")).otherwise(F.lit(0))).otherwise(F.col("own"))
    told = counted.join(listed, "rule").withColumn("broken", broken).where("broken > 0").groupBy("rule").agg(F.sum("broken").alias("violations"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    return listed.join(told, "rule", "left").select(F.col("name").alias("rule"), "table_name", F.coalesce("violations", F.lit(0)).alias("violations"), "first_key", "last_key")


def watched(df: DataFrame, table: str, rules: Sequence[Rule]) -> tuple[DataFrame, Observation]:
    """The table with its row rules counted along with whatever is done with it next, such as a write."""
    seen = Observation(f"contract-{table}")
    counts = [F.count_if(~F.coalesce(r.holds, F.lit(False))).alias(r.name) for r in rules if r.table == table and r.kind == "rows"]
    return df.observe(seen, F.count("*").alias("rows"), *counts), seen


def input_quality(core: DataFrame, flow: DataFrame, *, expected: str | None = None, freshness: int = 3, least_common: int = 200, least_overlap: float = 0.9) -> DataFrame:
    """One row about two sources by day: counts, ends, overlap, lags and the list of issues, in the order in which they are looked for.

    ``core``: date, open, close, trading_value; ``flow``: date, flow.  Days are
    counted before the sources meet, so neither repeated days nor a source
    without rows change what is told of the other.
    """
    bad_price = ~F.coalesce((F.col("close") > 0) & (F.col("open") > 0), F.lit(False))
    bad_value = ~F.coalesce(F.col("trading_value") > 0, F.lit(False))
    a = core.groupBy("date").agg(F.count("*").alias("a_rows"), F.count_if(bad_price).alias("bad_price"), F.count_if(bad_value).alias("bad_value"))
    b = flow.groupBy("date").agg(F.count("*").alias("b_rows"), F.count_if(F.col("flow").isNull() | F.isnan("flow")).alias("bad_flow"))
    days = a.join(b, "date", "full_outer")
    has_a, has_b = F.col("a_rows").isNotNull(), F.col("b_rows").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    row = days.agg(
        total("a_rows"), total("b_rows"), F.min(F.when(has_a, F.col("date"))).alias("a_first"), F.max(F.when(has_a, F.col("date"))).alias("a_last"),
        F.min(F.when(has_b, F.col("date"))).alias("b_first"), F.max(F.when(has_b, F.col("date"))).alias("b_last"), total("bad_price"), total("bad_value"), total("bad_flow"),
        F.count_if(has_a & has_b).alias("common"), F.count_if(has_a & ~has_b).alias("a_only"), F.count_if(has_b & ~has_a).alias("b_only"),
        F.coalesce(F.bool_or(F.col("a_rows") > 1), F.lit(False)).alias("a_twice"), F.coalesce(F.bool_or(F.col("b_rows") > 1), F.lit(False)).alias("b_twice"),
    )
    overlap = F.col("common") / F.greatest(F.lit(1), F.col("common") + F.col("a_only") + F.col("b_only"))
    both = F.col("a_last").isNotNull() & F.col("b_last").isNotNull()
    wanted = F.lit(expected).cast("date")
    lag = F.datediff(wanted, F.when(both, F.least("a_last", "b_last")))
    issues = [
        (F.col("a_rows") == 0, "missing_core"), (F.col("b_rows") == 0, "missing_flow"), (F.col("a_twice"), "duplicate_core_dates"), (F.col("b_twice"), "duplicate_flow_dates"),
        (F.col("bad_price") > 0, "invalid_price"), (F.col("bad_value") > 0, "invalid_trading_value"), (F.col("bad_flow") > 0, "invalid_flow"),
        (both & (F.col("a_last") != F.col("b_last")), "latest_source_date_mismatch"), (both & (F.col("a_only") + F.col("b_only") > 0), "source_date_gaps"),
        (lag < 0, "source_date_after_expected"), (lag > freshness, "stale_core_sources"),
        (F.col("common") < least_common, "insufficient_common_history"), ((F.col("common") >= least_common) & (overlap < least_overlap), "low_source_date_overlap"),
    ]
    return row.select(
        F.col("a_rows").alias("core_rows"), F.col("b_rows").alias("flow_rows"), F.col("a_first").alias("core_first"), F.col("a_last").alias("core_last"), F.col("b_first").alias("flow_first"), F.col("b_last").alias("flow_last"),
        "bad_price", "bad_value", "bad_flow", "common", "a_only", "b_only", overlap.alias("overlap"), (F.col("common") / F.greatest(F.lit(1), F.col("common") + F.col("a_only"))).alias("flow_coverage"),
        (F.col("common") / F.greatest(F.lit(1), F.col("common") + F.col("b_only"))).alias("core_coverage"), F.abs(F.datediff("a_last", "b_last")).alias("source_lag"), F.greatest(F.lit(0), lag).alias("freshness_lag"),
        F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in issues])).alias("issues"),
    )
