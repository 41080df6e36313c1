"""Windows over long ordered groups, without a task that holds a whole group.

A window orders all rows of a group in one task.  Here the order is cut into
parts at quantiles of its first column; each part is worked on by itself, and
what a row needs from the parts before it (a running maximum, a count, the
last known value) comes from one summary row a part.  Frames of a bounded
number of rows get the rows of their neighbours' edges as well.

The order must be total: rows that tie in it stand in any order, as in any
window.  Groups may have null keys.  A null in the first order column stands
first, as in an ascending order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a part, about.
ROWS = 1 << 18
#: Parts at most; longer tables have longer parts, which a sorted window spills.
MOST = 256

#: How values of one kind are summed up within a part, and put together with what came before: (running, whole, both).
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, F.max, lambda before, own: F.greatest(before, own)),
    "min": (F.min, F.min, lambda before, own: F.least(before, own)),
    "sum": (F.sum, F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "product": (F.product, F.product, lambda before, own: F.coalesce(before * own, before, own)),
    "count": (F.count, F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
    "first": (lambda c: F.first(c, ignorenulls=True), lambda c: F.first(c, ignorenulls=True), lambda before, own: F.coalesce(before, own)),
}


def cuts(df: DataFrame, on: str, rows: int = ROWS, most: int = MOST) -> list:
    """Values of the column that cut the table into parts of about so many rows: one pass over that column, at most ``most`` values."""
    grid = [k / most for k in range(1, most)]
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(on, grid, 20 * most).alias("q")).first()
    parts = min(most, -(-found["n"] // rows))
    if parts < 2 or not found["q"]:
        return []
    return sorted({found["q"][max(0, round(k * most / parts) - 1)] for k in range(1, parts)})


def _total(terms: list[Column]) -> Column:
    """Sum of the terms as a balanced tree, which stays shallow."""
    if len(terms) < 2:
        return terms[0] if terms else F.lit(0)
    half = len(terms) // 2
    return _total(terms[:half]) + _total(terms[half:])


def parted(df: DataFrame, by: Sequence[str], on: str, at: list) -> DataFrame:
    """Adds ``__by``, the group, and ``__part``, the number of cuts up to the row's value."""
    kind = df.schema[on].dataType
    part = _total([F.coalesce((F.lit(x).cast(kind) <= F.col(on)).cast("int"), F.lit(0)) for x in at])
    # A structure is never null, and equal to another with nulls in the same places.
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    return df.withColumns({"__by": group, "__part": part})


def running(df: DataFrame, by: Sequence[str], on: Sequence[str], steps: dict[str, tuple[str, str | Column]], *, strict: bool = False, backwards: bool = False, rows: int = ROWS) -> DataFrame:
    """Adds running values of a group's rows in order: ``{name: (kind, column)}``, kinds as in ``KINDS``.

    Up to the row itself or, ``strict``, up to the one before it; ``backwards``
    from the end.  Nulls are passed over.  ``df`` is read three times: for the
    cuts, for the summaries and for the rows.
    """
    at = cuts(df, on[0], rows)
    values = {name: F.col(c) if isinstance(c, str) else c for name, (_, c) in steps.items()}
    placed = parted(df, by, on[0], at).withColumns({f"__v_{n}": v for n, v in values.items()})
    order = [F.col(c).desc_nulls_last() if backwards else F.col(c).asc_nulls_first() for c in on]
    here = Window.partitionBy("__by", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    own = placed.withColumns({f"__own_{n}": KINDS[kind][0](F.col(f"__v_{n}")).over(here) for n, (kind, _) in steps.items()})
    if not at:
        return own.select(*df.columns, *[F.coalesce(f"__own_{n}", F.lit(0)).alias(n) if kind == "count" else F.col(f"__own_{n}").alias(n) for n, (kind, _) in steps.items()])

    def whole(n: str, kind: str) -> Column:
        v = F.col(f"__v_{n}")
        if kind in ("first", "last"):  # the value of the row that stands first or last, among those with one
            ends = F.max_by if (kind == "last") != backwards else F.min_by
            return ends(v, F.when(v.isNotNull(), F.struct(*on)))
        return F.count(v) if kind == "count" else KINDS[kind][1](v)

    sums = placed.groupBy("__by", "__part").agg(*[whole(n, kind).alias(f"__sum_{n}") for n, (kind, _) in steps.items()])
    # A row for each group and part that has rows: at most MOST a group.
    before = Window.partitionBy("__by").orderBy(F.col("__part").desc() if backwards else F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("__by", "__part", *[KINDS[kind][1](F.col(f"__sum_{n}")).over(before).alias(f"__before_{n}") for n, (kind, _) in steps.items()])
    both = own.join(carried, ["__by", "__part"], "left")
    return both.select(*[own[c] for c in df.columns], *[KINDS[kind][2](F.col(f"__before_{n}"), F.col(f"__own_{n}")).alias(n) for n, (kind, _) in steps.items()])


def positions(df: DataFrame, by: Sequence[str], on: Sequence[str], name: str = "position", *, rows: int = ROWS) -> DataFrame:
    """Adds each row's place in its group, from 0."""
    return running(df, by, on, {name: ("count", F.lit(1))}, strict=True, rows=rows)


def blocks(df: DataFrame, by: Sequence[str], on: Sequence[str], *, preceding: int, following: int = 0, rows: int = ROWS) -> DataFrame:
    """The rows in blocks of equal length, each with the ``preceding`` rows before it and the ``following`` after it.

    Adds ``__by``, ``__block``, ``__position`` and ``__own``, which tells a
    block's own rows from its neighbours'.  A row is copied twice at most.
    """
    size = max(rows, preceding, following, 1)
    placed = positions(df, by, on, "__position", rows=rows)
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("none"))
    block, within = F.floor(F.col("__position") / size), F.col("__position") % size
    goes = F.array_compact(F.array(F.lit(0), F.when(within >= size - preceding, 1), F.when((within < following) & (block > 0), -1)))
    return placed.withColumn("__step", F.explode(goes)).withColumns({"__by": group, "__block": block + F.col("__step"), "__own": F.col("__step") == 0}).drop("__step")


def framed(df: DataFrame, by: Sequence[str], on: Sequence[str], columns: dict[str, Callable[[WindowSpec], Column]], *, preceding: int, following: int = 0, rows: int = ROWS) -> DataFrame:
    """Adds columns of window functions whose frames reach at most so many rows back and ahead.

    Each column is a function of a window, in which it may set its own frame of rows.
    """
    line = Window.partitionBy("__by", "__block").orderBy("__position")
    kept = blocks(df, by, on, preceding=preceding, following=following, rows=rows)
    return kept.withColumns({name: f(line) for name, f in columns.items()}).where("__own").select(*df.columns, *columns)
