"""Measures of equity paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxlens.operators import simulate

YEAR_DAYS = 365.2425
YEAR_SESSIONS = 252


def _line() -> Window:
    return Window.partitionBy("scenario_id").orderBy("date")


def _steps(path: str) -> Column:
    """Changes from session to session, 0 for the first."""
    return F.coalesce(F.col(path) / F.lag(path).over(_line()) - 1, F.lit(0.0))


def _drawdown(path: str) -> Column:
    return F.col(path) / F.max(path).over(_line().rowsBetween(Window.unboundedPreceding, 0)) - 1


def _volatility(steps: str) -> Column:
    return F.stddev_samp(steps) * F.sqrt(F.lit(float(YEAR_SESSIONS)))


def path_metrics(ledger: DataFrame) -> DataFrame:
    """Return, growth, risk, exposure, turnover, trades and comparisons, a row for each scenario that has a path."""
    known = ledger.where("position <> 'unavailable'")
    moved = F.abs(F.col("exposure") - F.coalesce(F.lag("exposure").over(_line()), F.lit(0.0)))
    share = {f"{p}_exposure": F.avg((F.col("position") == p).cast("double")).alias(f"{p}_exposure") for p in ("long", "short", "inverse", "cash")}
    found = (
        known.withColumn("step", _steps("equity")).withColumn("drawdown", _drawdown("equity")).withColumn("hold_drawdown", _drawdown("buy_hold")).withColumn("moved", moved)
        .groupBy("scenario_id").agg(
            F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("sessions"), F.max_by("equity", "date").alias("last_equity"),
            _volatility("step").alias("volatility"), F.stddev_samp("step").alias("deviation"), F.avg("step").alias("mean"), F.min("drawdown").alias("max_drawdown"),
            *share.values(), F.avg("exposure").alias("net_exposure"), F.avg(F.abs("exposure")).alias("gross_exposure"), F.sum("moved").alias("moved"), F.sum("sides").alias("sides"), F.sum("cost").alias("cost"),
            (F.max_by("buy_hold", "date") - 1).alias("buy_hold_return"), F.min("hold_drawdown").alias("buy_hold_drawdown"),
            F.count_if(F.col("action") == "reverse").alias("reversals"),
        )
    )
    closed = simulate.trades(ledger).groupBy("scenario_id").agg(
        F.count("*").alias("trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("holding_sessions").alias("mean_holding"),
        *[F.avg(F.when(F.col("side") == s, (F.col("net_return") > 0).cast("double"))).alias(f"{s}_win_rate") for s in ("long", "short", "inverse")],
        *[F.count_if(F.col("exit_reason") == r).alias(r) for r in ("recovery", "max_holding", "opposite_extreme")],
    )
    timing = simulate.zero_cost(ledger).withColumn("drawdown", _drawdown("matched")).groupBy("scenario_id").agg((F.max_by("matched", "date") - 1).alias("zero_cost_return"), F.min("drawdown").alias("zero_cost_drawdown"))
    risk = risk_matched(ledger).where("matched is not null").withColumn("drawdown", _drawdown("matched")).groupBy("scenario_id").agg((F.max_by("matched", "date") - 1).alias("risk_matched_return"), F.min("drawdown").alias("risk_matched_drawdown"), F.max("scale").alias("risk_matched_scale"))
    years = F.datediff("last_date", "first_date") / YEAR_DAYS
    whole = found.join(closed, "scenario_id", "left").join(timing, "scenario_id", "left").join(risk, "scenario_id", "left").withColumn("years", years)
    counts = ("trades", "recovery", "max_holding", "opposite_extreme")
    # Trades of a pair of funds are turned over in sides, of one fund in exposure.
    turned = F.when(F.col("inverse_exposure") > 0, F.col("sides").cast("double")).otherwise(F.col("moved"))
    return whole.select(
        "scenario_id", "first_date", "last_date", "sessions", (F.col("last_equity") - 1).alias("total_return"),
        F.when(F.col("years") > 0, F.pow("last_equity", 1 / F.col("years")) - 1).alias("cagr"), "volatility",
        F.when(F.col("deviation") > 0, F.col("mean") / F.col("deviation") * F.sqrt(F.lit(float(YEAR_SESSIONS)))).alias("sharpe"), "max_drawdown",
        "long_exposure", "short_exposure", "inverse_exposure", "cash_exposure", "gross_exposure", "net_exposure", F.when(F.col("years") > 0, turned / F.col("years")).alias("turnover"), "cost", "reversals",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "win_rate", "long_win_rate", "short_win_rate", "inverse_win_rate", "mean_holding",
        "buy_hold_return", "buy_hold_drawdown", "zero_cost_return", "zero_cost_drawdown", (F.col("last_equity") - 1 - F.col("zero_cost_return")).alias("excess_over_zero_cost"),
        "risk_matched_return", "risk_matched_drawdown", "risk_matched_scale",
    )


def break_even(ledger: DataFrame, grid: DataFrame) -> DataFrame:
    """The cost in basis points at which a strategy's gain is gone, by its scenarios of growing cost.

    0 where it has none without costs; the cost itself where the gain is just
    0; between two costs of a gain and a loss interpolated; null where the
    gain outlasts the grid.  ``grid``: scenario_id, strategy, cost_bps.
    """
    gains = ledger.where("position <> 'unavailable'").groupBy("scenario_id").agg((F.max_by("equity", "date") - 1).alias("gain"))
    line = Window.partitionBy("strategy").orderBy("cost_bps")
    points = grid.join(gains, "scenario_id").withColumn("next_cost", F.lead("cost_bps").over(line)).withColumn("next_gain", F.lead("gain").over(line))
    at = F.when(F.col("next_gain") == 0, F.col("next_cost")).when((F.col("gain") > 0) & (F.col("next_gain") < 0), F.round(F.col("cost_bps") + F.col("gain") / (F.col("gain") - F.col("next_gain")) * (F.col("next_cost") - F.col("cost_bps")), 2))
    return points.withColumn("at", at).groupBy("strategy").agg(F.min_by("gain", "cost_bps").alias("first_gain"), F.min("at").alias("crossing")).select(
        "strategy", F.when(F.col("first_gain") <= 0, 0.0).otherwise(F.col("crossing")).alias("break_even_bps"))


def holding_segments(ledger: DataFrame) -> DataFrame:
    """Stretches of sessions in one position (gaps and islands)."""
    changed = F.when(F.col("position").eqNullSafe(F.lag("position").over(_line())), 0).otherwise(1)
    islands = ledger.withColumn("change", changed).withColumn("segment", F.sum("change").over(_line().rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("scenario_id", "segment", "position").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("sessions"))


def exposure_matched(ledger: DataFrame) -> DataFrame:
    """The path of the same positions without costs; null for an unavailable scenario."""
    return ledger.select("scenario_id", "date").join(simulate.zero_cost(ledger).select("scenario_id", "date", "matched"), ["scenario_id", "date"], "left")


def risk_matched(ledger: DataFrame) -> DataFrame:
    """Buy and hold scaled down to the strategy's volatility, never up; 1 throughout where the index doesn't vary, null for an unavailable scenario."""
    steps = ledger.withColumn("own", _steps("equity")).withColumn("hold", _steps("buy_hold"))
    spread = F.stddev_samp("hold")
    scale = steps.where("position <> 'unavailable'").groupBy("scenario_id").agg(F.when(spread > 0, F.least(F.lit(1.0), F.stddev_samp("own") / spread)).alias("scale"))
    known = F.when(F.col("position") != "unavailable", 1 + F.col("hold") * F.coalesce("scale", F.lit(0.0)))
    return steps.join(scale, "scenario_id", "left").withColumn("factor", known).select(
        "scenario_id", "date", "scale", F.when(F.col("factor").isNotNull(), F.product("factor").over(_line().rowsBetween(Window.unboundedPreceding, 0))).alias("matched"))
