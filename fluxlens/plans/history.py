"""Queries over the analysis frame, event studies and published histories, with SQL written apart from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import events, frame, metrics, reconcile, refresh, regression, selection, simulate
from fluxlens.plans import trading
from fluxlens.plans.trading import rounded
from fluxlens.sources import landing, market
from fluxlens.streaming import live

SAMPLES = 2_000
ASSETS = ("IDX", "L1", "S1")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.market_daily(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def _flows(daily: DataFrame) -> DataFrame:
    """Net purchases that follow the return closely; every fiftieth day has a published hash."""
    line = Window.partitionBy(F.lit(1)).orderBy("date")
    change = F.coalesce(F.col("close") / F.lag("close").over(line) - 1, F.lit(0.0))
    net = (-0.8 * change + (F.col("ck") % 13 - 6) / 200.0) * F.col("trading_value")
    return daily.select("date", net.alias("individual_net_purchase"), F.when(F.col("ck") % 50 == 0, F.concat(F.lit("published-"), F.col("ck").cast("string"))).alias("source_hash_override"))


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    return frame.analysis_frame(daily.select("date", "close", "trading_value"), _flows(daily))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.rolling_signals(market.observations(_daily(spark, sf_dir)))


def b8_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    return frame.features(daily.select("date", "close", "trading_value"), _flows(daily)).select("date", "source_hash")


def b16_residual_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two models' residuals point the same way on the days of the first."""
    found = _signals(spark, sf_dir)
    sides = [found.where(F.col("channel") == c).select("date", F.when(F.col("residual") < 0, "fear").when(F.col("residual") > 0, "greed").alias(c)) for c in ("main", "noisy")]
    state = F.when(F.col("main").isNull() | F.col("noisy").isNull(), "unavailable").when(F.col("main") == F.col("noisy"), "aligned").otherwise("mixed")
    return sides[0].join(sides[1], "date", "left").select("date", state.alias("state"))


def b17_b18_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's signals in full, by model."""
    last = _frame(spark, sf_dir).where("date is not null").orderBy(F.desc("date")).limit(1)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("model"), *[F.col(f"{p}_{c}").alias(c) for c in frame.FIELDS]) for p in ("robust", "scaled", "raw")])).alias("s")
    return rounded(last.select("date", rows).select("date", "s.*"), 6)


def b32_effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, k = F.col("date"), F.col("ck")
    state = F.when(k % 11 == 0, "unavailable").when(k % 7 == 0, "degraded").otherwise("ok")
    expected = F.when(k % 4 == 0, F.date_add(day, 1)).when(k % 4 != 1, day)
    success = F.when(k % 6 != 0, F.timestamp_add("DAY", (k % 9).cast("int"), day.cast("timestamp")))
    status = states.effective_status(state, k % 3 == 0, k % 5 != 0, expected, day, success, F.date_add(day, 10).cast("timestamp"), F.lit(7))
    return _daily(spark, sf_dir).select("date", status.alias("status"))


def d2_d8_huber_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.rolling_huber_signals(market.observations(_daily(spark, sf_dir))).drop("residuals"), 7)


def d11_d13_analysis_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _frame(spark, sf_dir)
    return rounded(found.select(
        "date", "close", "return_1d", "flow_share", "disparity50", "mdd252", *[f"{p}_{c}" for p in ("robust", "scaled", "raw") for c in ("percentile", "state", "quality", "training_count", "trade_eligible")],
        "robust_fit_score", "scaled_expected_flow", "direction_agreement", "trigger_agreement", "model_confidence", "primary_confidence"), 7)


def d15_d17_parameter_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookback = 60
    found = selection.rolling_signals(market.observations(_daily(spark, sf_dir)), window=lookback, least=states.minimum_observations(lookback), minimum_fit=0.4, tail=2)
    return rounded(found.select("channel", "date", "percentile", "state", "quality", "trade_eligible"))


def _studies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Extreme entries, all of them and those that don't overlap, and the forward returns of each asset."""
    entries = landing.stored(events.extreme_entries(_signals(spark, sf_dir)).where("channel = 'main'"), "entries")
    both = entries.withColumn("sample", F.lit("all")).unionByName(events.non_overlapping(entries, 20).withColumn("sample", F.lit("non_overlapping")))
    prices = market.prices(_daily(spark, sf_dir)).where(F.col("ticker").isin(*ASSETS))
    return both.select("sample", "date", "state"), events.forward_returns(prices).withColumnRenamed("ticker", "asset")


def e4_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, returns = _studies(spark, sf_dir)
    values = chosen.where("sample = 'all'").join(returns.where("asset = 'IDX' and value is not null"), "date")
    found = [events.bootstrap(values, ["state", "horizon"], samples=SAMPLES, method=m).withColumn("method", F.lit(m)) for m in ("iid", "moving_block")]
    return rounded(found[0].unionByName(found[1]), 7)


def i4_i5_event_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset and sample, against the asset's mean over all sessions, with intervals."""
    chosen, returns = _studies(spark, sf_dir)
    return rounded(events.summarize(chosen, returns, usual=events.unconditional(returns, "asset"), keys=("sample", "asset"), samples=SAMPLES), 7)


def i6_treatments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, returns = _studies(spark, sf_dir)
    fixed = events.summarize(chosen, returns, usual=events.unconditional(returns, "asset"), keys=("sample", "asset"))
    paired = events.summarize(chosen, returns, paired=returns.where("asset = 'IDX'"), keys=("sample", "asset"))
    return events.one_treatment(fixed, "sample", "asset").withColumn("against", F.lit("mean")).unionByName(events.one_treatment(paired, "sample", "asset").withColumn("against", F.lit("index")))


def e3_paired_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset's returns after each event less the index's after the same day."""
    chosen, returns = _studies(spark, sf_dir)
    return rounded(events.summarize(chosen.where("sample = 'all'").drop("sample"), returns.where("asset = 'S1'").drop("asset"), paired=returns.where("asset = 'IDX'")), 7)


def i5_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve events that don't overlap, with their returns by asset."""
    chosen, returns = _studies(spark, sf_dir)
    last = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("date")))
    wide = chosen.where("sample = 'non_overlapping'").join(returns, "date").groupBy("asset", "date", "state").agg(*[F.max(F.when(F.col("horizon") == h, F.col("value"))).alias(f"return_{h}") for h in events.HORIZONS])
    return rounded(wide.withColumn("back", last).where("back <= 12").drop("back"))


def i7_windowed_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a window, cut to it before overlap is looked at; prices end with it."""
    entries = events.extreme_entries(_signals(spark, sf_dir)).where("channel = 'main'").where("date between date'1996-01-01' and date'1999-06-30'")
    prices = market.prices(_daily(spark, sf_dir)).where("ticker = 'L1' and date <= date'1999-06-30'")
    returns = events.forward_returns(prices)
    return rounded(events.summarize(events.non_overlapping(entries, 20), returns, usual=events.unconditional(returns)), 7)


def f3_rolling_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    made = frame.features(daily.select("date", "close", "trading_value"), _flows(daily))
    found = frame.disparity_filter(made.select("date", F.lit("neutral").alias("state"), F.lit(True).alias("trade_eligible")), made)
    return rounded(found.select("date", "disparity50", "disparity_limit"), 6)


def j10_disparity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    made = frame.features(daily.select("date", "close", "trading_value"), _flows(daily))
    return frame.disparity_filter(_signals(spark, sf_dir).select("channel", "date", "state", "trade_eligible"), made).select("channel", "date", "state", "trade_eligible", "disparity_eligible")


def _two_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Official prices, and others that lack a day in nineteen, are 1 % off for one ticker and lack the last day of another."""
    official = market.prices(_daily(spark, sf_dir)).where("ticker in ('L1', 'L2', 'S1')")
    gone = F.pmod(F.datediff("date", F.lit("1995-01-01")), F.lit(19)) == 7
    off = F.when(F.col("ticker") == "S1", 1.01).otherwise(1.001)
    last = official.agg(F.max("date").alias("last"))
    other = official.where(~gone).crossJoin(F.broadcast(last)).where((F.col("ticker") != "L2") | (F.col("date") < F.col("last"))).drop("last")  # one row
    return official, other.withColumn("close", F.col("close") * off)


def k2_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconcile.anchors(*_two_sources(spark, sf_dir), count=6))


def k6_inherited_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This run's report of filled days by ticker, with those of the published one."""
    official, other = _two_sources(spark, sf_dir)
    missing = official.join(other, ["ticker", "date"], "left_anti")
    recent = F.col("date") >= F.lit("1999-01-01").cast("date")

    def report(part: DataFrame) -> DataFrame:
        days = F.slice(F.transform(F.array_sort(F.collect_list("date")), lambda d: d.cast("string")), 1, 3)
        return part.groupBy("ticker").agg(F.count("*").alias("filled"), days.alias("sample")).withColumn("state", F.when(F.col("ticker") == "L2", "unavailable").otherwise("ok"))

    found = refresh.inherited(report(missing.where(recent)), report(missing.where(~recent)))
    return found.select("ticker", "state", "filled", "inherited", F.concat_ws(",", "sample").alias("sample"), "provenance")


def k8_incremental_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(refresh.seed(_daily(spark, sf_dir).select("date", "close"), "2000-12-31"))


def k11_scale_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(refresh.scale_stability(*_two_sources(spark, sf_dir), "1999-01-01"))


def k12_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a new run's history has the signature of the published one: the same rows anew, and with a changed day."""
    days = _daily(spark, sf_dir).select("date", F.round("close", 6).cast("string").alias("close"))
    changed = days.withColumn("close", F.when(F.col("date") == F.lit("1998-03-02").cast("date"), "0").otherwise(F.col("close")))
    was = refresh.signature(days, "date", ["close"])
    runs = refresh.signature(days.repartition(3), "date", ["close"]).withColumn("run", F.lit("same")).unionByName(refresh.signature(changed, "date", ["close"]).withColumn("run", F.lit("changed")))
    return runs.crossJoin(F.broadcast(was.withColumnRenamed("signature", "published"))).select("run", (F.col("signature") == F.col("published")).alias("is_unchanged"))  # one row


def e14_output_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir).where("channel = 'main'").select("date", "state", "quality")
    return refresh.signature(rows, "date", ["state", "quality"])


def h6_ordered_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct reasons of several checks of each day, in the order of the checks."""
    k = F.col("ck")
    lists = [F.array(F.when(k % a == 0, F.lit(x)), F.when(k % b == 0, F.lit(y))) for a, b, x, y in ((2, 3, "late", "gap"), (3, 5, "gap", "late"), (4, 7, "scale", "late"))]
    return _daily(spark, sf_dir).select("date", F.concat_ws(",", refresh.ordered_reasons(*lists)).alias("reasons"))


def _base_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.ledger_of(spark, sf_dir, trading.scenarios(costs=(10,), exits=(80,), policies=("long_cash", "long_inverse_cash"), pairs=("1x",)))


def l2_history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day: features, three models, agreement, eligibility after the disparity filter, position and fund prices."""
    found = _frame(spark, sf_dir)
    filtered = frame.disparity_filter(found.select("date", F.col("raw_state").alias("state"), F.col("raw_trade_eligible").alias("trade_eligible")), found).select("date", "disparity_eligible")
    position = _base_ledger(spark, sf_dir).where("scenario_id = '1x-long_cash-10-80'").select("date", "position")
    prices = market.prices(_daily(spark, sf_dir)).where("ticker <> 'IDX'").groupBy("date").pivot("ticker", ["L1", "L2", "S1", "S2"]).agg(F.max("open").alias("open"), F.max("close").alias("close"))
    whole = found.join(filtered, "date", "left").join(position, "date", "left").join(prices, "date", "left")
    return rounded(whole.select(
        "date", "close", "return_1d", "flow_share", "disparity50", "mdd252", F.col("robust_expected_flow").alias("expected"), F.col("robust_residual").alias("residual"), F.col("robust_residual_z").alias("residual_z"),
        F.col("robust_percentile").alias("percentile"), F.col("robust_rolling_r2").alias("rolling_r2"), F.col("robust_fit_score").alias("fit_score"), F.col("robust_state").alias("state"), F.col("robust_quality").alias("quality"),
        F.col("robust_trade_eligible").alias("trade_eligible"), *[f"{p}_{c}" for p in ("scaled", "raw") for c in ("percentile", "state", "trade_eligible")], F.coalesce("disparity_eligible", F.lit(False)).alias("disparity_eligible"),
        "direction_agreement", "trigger_agreement", "source_hash", F.coalesce("position", F.lit("unavailable")).alias("position"), *[c for c in prices.columns if c != "date"]), 6)


def l5_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: coverage, the last day's signal, confidence, counts of events and trades, and where the base strategy stands."""
    found = _frame(spark, sf_dir)
    last = found.orderBy(F.desc("date")).limit(1).select(F.col("date").alias("data_as_of"), "close", "robust_state", "robust_percentile", "robust_quality", "primary_confidence", "model_confidence")
    cover = found.agg(F.count("*").alias("sessions"), F.min("date").alias("first_date"), F.count_if("robust_trade_eligible").alias("eligible"))
    entries = events.extreme_entries(found.select(F.lit("robust").alias("channel"), "date", F.col("robust_state").alias("state"), F.col("robust_trade_eligible").alias("trade_eligible"))).agg(F.count("*").alias("events"))
    ledger = _base_ledger(spark, sf_dir).where("scenario_id = '1x-long_cash-10-80'")
    stand = simulate.standing(ledger).select("position", "pending_action", "pending_reason")
    closed = simulate.trades(ledger).agg(F.count("*").alias("trades"))
    out = last
    for one in (cover, entries, stand, closed):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return rounded(out, 6)


def l6_strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs side by side by pair, policy and exit, with each strategy's break-even."""
    ledger = landing_table(spark, trading.ledger_of(spark, sf_dir))
    grid = spark.createDataFrame([(g["scenario_id"], f"{g['pair']}-{g['policy']}-{int(g['long_exit'])}", g["cost_bps"]) for g in trading.GRID], "scenario_id string, strategy string, cost_bps double")
    found = metrics.path_metrics(ledger).join(F.broadcast(grid), "scenario_id")
    wide = found.groupBy("strategy").pivot("cost_bps", [0.0, 5.0, 10.0, 20.0]).agg(F.max("total_return"))
    wide = wide.toDF("strategy", *[f"return_{c}bp" for c in (0, 5, 10, 20)])
    return rounded(wide.join(metrics.break_even(ledger, grid), "strategy", "left"))


def landing_table(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, for queries that read them more than once."""
    path = f"{landing.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def l8_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tone of the evidence: the interval after extreme fear, and both policies' results."""
    chosen, returns = _studies(spark, sf_dir)
    study = events.summarize(chosen, returns.where("horizon = 20"), usual=events.unconditional(returns, "asset"), keys=("sample", "asset"), horizons=(20,), samples=SAMPLES).where("state = 'extreme_fear'")
    found = metrics.path_metrics(_base_ledger(spark, sf_dir))
    both = found.agg(*[F.max(F.when(F.col("scenario_id") == f"1x-{p}-10-80", F.col(c))).alias(f"{p}_{c}") for p in ("long_cash", "long_inverse_cash") for c in ("total_return", "sharpe")])
    joined = study.crossJoin(F.broadcast(both))  # one row
    told = states.tone(F.col("excess_low"), [F.col(f"{p}_total_return") for p in ("long_cash", "long_inverse_cash")], [F.col(f"{p}_sharpe") for p in ("long_cash", "long_inverse_cash")])
    return joined.select("sample", "asset", told.alias("tone"))


def m8_stream_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions carried over a stream of sessions, in two files, by a keyed state."""
    base = f"{landing.shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    days = trading.sessions(spark, sf_dir).where("pair = '1x'")
    settings = spark.createDataFrame([("exit50", 50.0, 20), ("exit80", 80.0, 20), ("short", 80.0, 5)], "scenario_id string, long_exit double, max_holding int")
    rows = days.crossJoin(F.broadcast(settings)).select("scenario_id", "date", F.coalesce("percentile", F.lit(-1.0)).alias("percentile"), "entry", "long_exit", "max_holding")  # three rows
    rows.where("date < date'1998-01-01'").coalesce(1).write.parquet(f"{base}/in")
    rows.where("date >= date'1998-01-01'").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return live.run_positions(spark, f"{base}/in", f"{base}/out", f"{base}/state")


QUERIES = {f.__name__: f for f in (
    b8_source_hash, b16_residual_signs, b17_b18_snapshot, b32_effective_status, d2_d8_huber_signals, d11_d13_analysis_frame, d15_d17_parameter_signals, e4_bootstrap, i4_i5_event_study, i6_treatments, e3_paired_study,
    i5_last_events, i7_windowed_study, f3_rolling_quantile, j10_disparity_filter, k2_anchor_check, k6_inherited_repairs, k8_incremental_seed, k11_scale_stability, k12_unchanged, e14_output_signature, h6_ordered_reasons,
    l2_history_rows, l5_summary, l6_strategy_comparison, l8_conclusion, m8_stream_positions,
)}
