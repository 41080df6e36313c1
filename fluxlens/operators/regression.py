"""Past-only rolling regressions and the signals they give."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.functions.states import classify


def ols_by(df: DataFrame, *keys: str) -> DataFrame:
    """Slope, intercept and R2 by group; R2 is 0 where the flow doesn't vary."""
    x, y = F.col("return_1d"), F.col("flow_share")
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"),
        F.when(F.regr_syy(y, x) == 0, 0.0).otherwise(F.regr_r2(y, x)).alias("r2"),
    )


def bound(value: Column, function: Callable[[Column], Column]) -> Column:
    """The function of a value that is worked out once, however often the function names it.

    Plain columns are put in wherever they are named, inside the loop over an
    array too."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def middle(values: Column) -> Column:
    """Median of an array of numbers."""

    def of(ordered: Column) -> Column:
        n = F.size(ordered)
        at = lambda k: F.get(ordered, k.cast("int"))
        return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    return bound(F.array_sort(values), of)


def centred(residuals: Column) -> Column:
    """Residuals with their median and their median absolute deviation from it."""
    return bound(residuals, lambda r: bound(middle(r), lambda c: F.struct(r.alias("residuals"), c.alias("center"), middle(F.transform(r, lambda x: F.abs(x - c))).alias("mad"))))


def rolling_signals(obs: DataFrame, *, window: int = 252, least: int = 200, minimum_fit: float = 0.2, tail: int = 5) -> DataFrame:
    """Scores each complete observation against a least-squares fit of those before it.

    The frame of a channel holds its last ``window`` complete observations
    strictly before the day.  Rows without return or flow are left out first,
    so the frame counts complete rows.  Quality, in this order:
    insufficient_history, invalid_regression (the return doesn't vary),
    zero_mad, low_model_fit (slope not negative, or R2 below the minimum), ok.
    """
    x, y = F.col("return_1d"), F.col("flow_share")
    past = Window.partitionBy("channel").orderBy("date").rowsBetween(-window, -1)
    fitted = obs.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(
        "channel", "date", "return_1d", "flow_share",
        F.count(x).over(past).cast("int").alias("training_count"),
        F.regr_slope(y, x).over(past).alias("b"), F.regr_intercept(y, x).over(past).alias("a"),
        F.when(F.regr_syy(y, x).over(past) == 0, 0.0).otherwise(F.regr_r2(y, x).over(past)).alias("fit"),
        F.collect_list(F.struct(x.alias("x"), y.alias("y"))).over(past).alias("past"),
    )
    usable = (F.col("training_count") >= least) & F.col("b").isNotNull()
    scored = (
        fitted.withColumn("spread", F.when(usable, centred(F.transform("past", lambda p: p["y"] - (F.col("a") + F.col("b") * p["x"])))))
        .withColumn("residual", F.when(usable, y - (F.col("a") + F.col("b") * x)))
        .select("*", "spread.residuals", "spread.center", "spread.mad")
    )
    return grade(scored, least, minimum_fit, tail)


def grade(scored: DataFrame, least: int, minimum_fit: float, tail: int) -> DataFrame:
    """Quality, percentile, state and eligibility of scored rows."""
    valid = (F.col("training_count") >= least) & F.col("b").isNotNull() & (F.col("mad") > 0)
    ranked = F.col("rank") if "rank" in scored.columns else 100.0 * bound(F.col("residual"), lambda own: F.size(F.filter("residuals", lambda r: r <= own))) / F.size("residuals")
    percentile = F.when(valid, ranked)
    good = (F.col("b") < 0) & (F.col("fit") >= minimum_fit)
    quality = (
        F.when(F.col("training_count") < least, "insufficient_history").when(F.col("b").isNull(), "invalid_regression")
        .when(~(F.col("mad") > 0), "zero_mad").when(~good, "low_model_fit").otherwise("ok")
    )
    return scored.select(
        "channel", "date", "return_1d", "flow_share", "training_count",
        F.when(valid, F.col("a")).alias("alpha"), F.when(valid, F.col("b")).alias("beta"), F.when(valid, F.col("fit")).alias("rolling_r2"),
        *([F.when(valid, F.col("weighted_fit")).alias("fit_score")] if "weighted_fit" in scored.columns else []),
        F.when(valid, F.col("residual")).alias("residual"),
        F.when(valid, (F.col("residual") - F.col("center")) / (1.4826 * F.col("mad"))).alias("residual_z"),
        percentile.alias("percentile"), classify(percentile, tail).alias("state"), quality.alias("quality"), (valid & good).alias("trade_eligible"), *(["residuals"] if "residuals" in scored.columns else []),
    )


def huber_line(x: np.ndarray, y: np.ndarray, *, bend: float = 1.345, rounds: int = 50, tolerance: float = 1e-10) -> tuple[float, float, np.ndarray]:
    """Intercept, slope and the last weights of Huber's line by reweighted least squares.

    Residuals are measured from their median, in units of 1.4826 times their
    median absolute deviation from it; where that is zero the line stays as it is."""
    weights = np.ones(len(x))
    a, b = _weighted(x, y, weights)
    for _ in range(rounds):
        residual = y - (a + b * x)
        away = np.abs(residual - np.median(residual))
        scale = 1.4826 * np.median(away)
        if not np.isfinite(scale) or scale <= 0:
            break
        size = away / (bend * scale)
        weights = np.where(size <= 1, 1.0, 1.0 / np.maximum(size, 1e-300))
        new_a, new_b = _weighted(x, y, weights)
        moved = max(abs(new_a - a), abs(new_b - b))
        a, b = new_a, new_b
        if moved <= tolerance * (1 + max(abs(a), abs(b))):
            break
    return a, b, weights


def _weighted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    total = w.sum()
    mx, my = (w @ x) / total, (w @ y) / total
    spread = w @ (x - mx) ** 2
    if not spread > 0:
        raise ZeroDivisionError("the return does not vary")
    b = (w @ ((x - mx) * (y - my))) / spread
    return my - b * mx, b


def _share_explained(y: np.ndarray, residual: np.ndarray, w: np.ndarray | None = None) -> float:
    w = np.ones(len(y)) if w is None else w
    total = w @ (y - (w @ y) / w.sum()) ** 2
    return 0.0 if total == 0 else float(1 - (w @ residual**2) / total)


HUBER = "struct<a:double,b:double,fit:double,weighted_fit:double,residuals:array<double>>"


def huber_fit(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """Huber's line through arrays of returns and flows; nulls where none can be laid."""
    rows = []
    for x, y in zip(xs, ys):
        x, y = np.asarray(x, float), np.asarray(y, float)
        try:
            a, b, w = huber_line(x, y)
            residual = y - (a + b * x)
            rows.append((a, b, _share_explained(y, residual), _share_explained(y, residual, w), residual.tolist()))
        except (ZeroDivisionError, ValueError):
            rows.append((None, None, None, None, []))
    return pd.DataFrame(rows, columns=["a", "b", "fit", "weighted_fit", "residuals"])


def rolling_huber_signals(obs: DataFrame, *, window: int = 252, least: int = 200, minimum_fit: float = 0.2, tail: int = 5) -> DataFrame:
    """As :func:`rolling_signals` with Huber's line; the gate still uses the unweighted R2."""
    x, y = F.col("return_1d"), F.col("flow_share")
    past = Window.partitionBy("channel").orderBy("date").rowsBetween(-window, -1)
    framed = obs.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(
        "channel", "date", "return_1d", "flow_share", F.count(x).over(past).cast("int").alias("training_count"),
        F.collect_list(x).over(past).alias("xs"), F.collect_list(y).over(past).alias("ys"),
    )
    empty = F.array().cast("array<double>")
    ready = F.col("training_count") >= least
    fitted = framed.withColumn("line", F.pandas_udf(huber_fit, HUBER)(F.when(ready, F.col("xs")).otherwise(empty), F.when(ready, F.col("ys")).otherwise(empty)))
    scored = (
        fitted.select("channel", "date", "return_1d", "flow_share", "training_count", "line.a", "line.b", "line.fit", "line.weighted_fit", centred(F.col("line.residuals")).alias("spread"))
        .withColumn("residual", y - (F.col("a") + F.col("b") * x))
        .select("*", "spread.residuals", "spread.center", "spread.mad")
    )
    return grade(scored, least, minimum_fit, tail)
