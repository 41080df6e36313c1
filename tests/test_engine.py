"""Operators of the engine on small, hand-made inputs."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import asof, events, metrics, reconcile, refresh, regression, simulate

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def observed(n=260):
    """Flows against the return, with a slow wave and a sawtooth around the line."""
    rows = []
    for i in range(n):
        x = 0.012 * np.sin(1.7 * i) + 0.004 * np.cos(0.37 * i)
        rows.append(("own", day(i), float(x), float(-0.55 * x + 0.0007 * np.sin(0.11 * i) + ((i * i) % 17 - 8) / 30000)))
    return rows


def test_state_boundaries(spark):
    cases = [(5.0, "extreme_fear"), (5.1, "fear"), (20.0, "fear"), (79.9, "neutral"), (80.0, "greed"), (95.0, "extreme_greed"), (None, "unavailable"), (float("nan"), "unavailable")]
    df = spark.createDataFrame(cases, "p double, want string")
    assert df.where(states.classify(F.col("p")) != F.col("want")).count() == 0
    tails = spark.createDataFrame([(2.0, 2, "extreme_fear"), (5.0, 2, "fear"), (95.0, 2, "greed"), (98.0, 2, "extreme_greed")], "p double, t int, want string")
    assert tails.where(states.classify(F.col("p"), F.col("t")) != F.col("want")).count() == 0


def test_minimum_observations():
    assert [states.minimum_observations(n) for n in (20, 60, 196, 252)] == [20, 48, 157, 200]


def test_numbers(spark):
    df = spark.createDataFrame([(" 1,234.5 ",), ("",), ("x",), (None,)], "t string").select(states.parse_number(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [1234.5, None, None, None]


def brute_signal(rows, at, window=252):
    past = [(x, y) for _, d, x, y in rows if d < rows[at][1]][-window:]
    x, y = np.array(past).T
    b, a = np.polyfit(x, y, 1)
    r = y - (a + b * x)
    own = rows[at][3] - (a + b * rows[at][2])
    return b, 100 * np.mean(r <= own), 1 - (r**2).sum() / ((y - y.mean()) ** 2).sum()


def test_rolling_signals_look_back_only(spark):
    rows = observed()
    df = spark.createDataFrame(rows, "channel string, date date, return_1d double, flow_share double")
    found = {r["date"]: r for r in regression.rolling_signals(df).collect()}
    for at in (200, 230, 259):
        b, p, r2 = brute_signal(rows, at)
        got = found[rows[at][1]]
        assert got["beta"] == pytest.approx(b, abs=1e-9) and got["percentile"] == pytest.approx(p, abs=1e-9) and got["rolling_r2"] == pytest.approx(r2, abs=1e-9)
    assert found[rows[199][1]]["quality"] == "insufficient_history" and found[rows[259][1]]["quality"] == "ok"
    changed = [r if k < 255 else (r[0], r[1], r[2] + 1, r[3] - 5) for k, r in enumerate(rows)]
    again = {r["date"]: r for r in regression.rolling_signals(spark.createDataFrame(changed, df.schema)).collect()}
    assert all(again[r[1]] == found[r[1]] for r in rows[:255])


def test_flat_returns_are_an_invalid_regression(spark):
    rows = [("c", day(i), 0.01, 0.1 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "channel string, date date, return_1d double, flow_share double")
    last = regression.rolling_signals(df, window=50, least=40).orderBy(F.desc("date")).first()
    assert last["quality"] == "invalid_regression" and last["state"] == "unavailable" and not last["trade_eligible"]


def test_huber_resists_an_outlier(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 200)
    y = -0.8 * x + rng.normal(0, 0.0005, 200)
    y[7] += 5
    a, b, w = regression.huber_line(x, y)
    assert b == pytest.approx(-0.8, abs=0.02) and w[7] < 0.01
    rows = [("c", day(i), float(x[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "channel string, date date, return_1d double, flow_share double")
    last = regression.rolling_huber_signals(df, window=150, least=100).orderBy(F.desc("date")).first()
    a, b, _ = regression.huber_line(x[49:199], y[49:199])
    assert last["alpha"] == pytest.approx(a, abs=1e-10) and last["beta"] == pytest.approx(b, abs=1e-10)


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, dt.date(2026, 7, d)) for d in (13, 14, 15)], "m int, date date")
    right = spark.createDataFrame([(1, dt.date(2026, 7, d), v) for d, v in ((12, 100.0), (14, 200.0), (15, 300.0))], "m int, date date, v double")
    found = asof.strictly_before(left, right, by=["m"], on="date", values=["v"], stamp="at").orderBy("date").collect()
    assert [r["v"] for r in found] == [100.0, 100.0, 200.0]


def test_entries_and_overlap(spark):
    seq = ["neutral", "extreme_fear", "extreme_fear", "fear", "extreme_fear", "extreme_greed"]
    rows = [("c", day(k), s, k != 3) for k, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "channel string, date date, state string, trade_eligible boolean")
    entries = events.extreme_entries(df)
    assert [r["position"] for r in entries.orderBy("date").collect()] == [1, 5]
    many = spark.createDataFrame([("c", p) for p in (0, 5, 21, 30, 42)], "channel string, position int")
    assert sorted(r["position"] for r in events.non_overlapping(many, 20).collect()) == [0, 21, 42]


def test_huber_weights_count_from_the_median():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.02, 120)
    y = 0.3 * x + rng.exponential(0.01, 120)  # skewed: the residuals' median isn't 0
    a, b, w = regression.huber_line(x, y)

    def line(w):
        slope, at = np.polyfit(x, y, 1, w=np.sqrt(w))
        return at, slope

    own, weights = line(np.ones(120)), None
    for _ in range(50):
        r = y - own[0] - own[1] * x
        d = abs(r - np.median(r)) / (1.4826 * np.median(abs(r - np.median(r))))
        weights = np.minimum(1, 1.345 / np.maximum(d, 1e-12))
        own = line(weights)
    assert a == pytest.approx(own[0], rel=1e-6) and b == pytest.approx(own[1], rel=1e-6) and np.allclose(w, weights, atol=1e-5)


def test_bootstrap(spark):
    rows = [("s", day(k), float(k)) for k in range(30)] + [("one", day(0), 3.0)]
    values = spark.createDataFrame(rows, "k string, date date, value double")
    for method in ("iid", "moving_block"):
        found = {r["k"]: (r["low"], r["high"]) for r in events.bootstrap(values, ["k"], samples=400, method=method).collect()}
        again = {r["k"]: (r["low"], r["high"]) for r in events.bootstrap(values.repartition(3), ["k"], samples=400, method=method).collect()}
        assert found == again and found["one"] == (3.0, 3.0) and found["s"][0] < 14.5 < found["s"][1] and found["s"][1] - found["s"][0] > 3
    with pytest.raises(ValueError):
        events.bootstrap(values, ["k"], method="other")


def test_treatments_of_a_study(spark):
    chosen = spark.createDataFrame([(day(0), "extreme_fear"), (day(2), "extreme_fear")], "date date, state string")
    returns = spark.createDataFrame([(day(k), 1, 0.01 * k) for k in range(4)], "date date, horizon int, value double")
    usual = events.unconditional(returns)
    fixed = {r["state"]: r for r in events.summarize(chosen, returns, usual=usual, paired=returns, horizons=(1,)).collect()}
    assert fixed["extreme_fear"]["treatment"] == "fixed_external_mean" and fixed["extreme_fear"]["excess"] == pytest.approx(0.01 - 0.015) and fixed["extreme_greed"]["n"] == 0
    paired = {r["state"]: r for r in events.summarize(chosen, returns, paired=returns.withColumn("value", F.col("value") / 2), horizons=(1,)).collect()}
    assert paired["extreme_fear"]["treatment"] == "paired_event_returns" and paired["extreme_fear"]["excess"] == pytest.approx(0.005)
    short = {r["state"]: r for r in events.summarize(chosen, returns, paired=returns.where(F.col("date") == F.lit(day(0))), horizons=(1,)).collect()}
    assert short["extreme_fear"]["treatment"] == "unavailable" and short["extreme_fear"]["benchmark"] is None
    mixed = spark.createDataFrame([("fixed_external_mean",), ("paired_event_returns",), ("unavailable",)], "treatment string").withColumn("study", F.lit(1))
    assert events.one_treatment(mixed, "study").first()["treatment"] == "mixed"


def days_of(prices, percentiles, entries, other=100.0):
    return pd.DataFrame({"date": [day(k) for k in range(len(prices))], "open": prices, "close": prices, "other_open": other, "other_close": other, "percentile": percentiles, "entry": entries})


RUN = {"policy": "long_cash", "cost_bps": 0.0, "long_exit": 80.0, "max_holding": 20}


def test_entry_and_exit_at_the_next_open():
    out = simulate.simulate(days_of([50.0, 60.0, 66.0, 72.6], [1.0, 40.0, 85.0, 60.0], ["extreme_fear", None, None, None]), **RUN)
    assert out["action"].tolist() == [None, "enter", None, "exit"] and out["reason"].tolist()[3] == "recovery"
    assert out["equity"].iloc[-1] == pytest.approx(1.21) and out["pending_action"].tolist() == ["enter_next_open", None, "exit_next_open", None]
    assert out["signal_date"].tolist()[3] == day(2) and out["opening_position"].tolist()[3] == "long"


def test_reversal_is_one_action_with_two_sides():
    df = days_of([40.0, 44.0, 42.0, 42.0], [1.0, 99.0, 60.0, 60.0], ["extreme_fear", "extreme_greed", None, None])
    for policy, side in (("long_short_cash", "short"), ("long_inverse_cash", "inverse")):
        out = simulate.simulate(df, **RUN | {"policy": policy, "cost_bps": 25.0})
        assert out["action"].tolist()[:3] == [None, "enter", "reverse"] and out["sides"].tolist()[2] == 2 and out["position"].iloc[2] == side
        assert out["pending_side"].iloc[1] == side and out["cost"].iloc[2] > 0


def test_longest_holding_needs_no_signal():
    out = simulate.simulate(days_of([70.0] * 6, [1.0, None, None, None, None, None], ["extreme_fear"] + [None] * 5), **RUN | {"max_holding": 2})
    assert out["reason"].dropna().tolist() == ["extreme_fear_entry", "max_holding"]


@pytest.mark.parametrize("change", [{"policy": "other"}, {"cost_bps": -1.0}, {"long_exit": 95.0}, {"long_exit": 60.5}, {"max_holding": 0}])
def test_settings_that_are_refused(change):
    with pytest.raises(ValueError):
        simulate.simulate(days_of([70.0] * 3, [None] * 3, [None] * 3), **RUN | change)


def test_failed_scenarios_are_unavailable(spark):
    grid = [{"scenario_id": f"{p}-{k}", "pair": p, "policy": k, "cost_bps": 0.0, "long_exit": 80.0, "max_holding": 20} for p in ("rise", "twice") for k in ("long_cash", "long_short_cash")]
    rise = days_of([90.0, 90.0, 500.0], [99.0, 50.0, 50.0], ["extreme_greed", None, None]).assign(pair="rise")
    twice = pd.concat([rise, rise]).assign(pair="twice")
    out = {}
    for r in simulate.run_scenarios(spark.createDataFrame(pd.concat([rise, twice])), grid).collect():
        out.setdefault(r["scenario_id"], []).append(r)
    assert len(out["rise-long_cash"]) == 3 and all(len(out[s]) == 1 and out[s][0]["position"] == "unavailable" for s in ("rise-long_short_cash", "twice-long_cash", "twice-long_short_cash"))


def plain_path(spark):
    prices = [50.0, 50.0, 55.0, 60.0, 58.0, 54.0, 57.0, 61.0]
    df = days_of(prices, [1.0, 40.0, 85.0, 50.0, 99.0, 40.0, 15.0, 50.0], ["extreme_fear", None, None, None, "extreme_greed", None, None, None]).assign(pair="p")
    grid = [{"scenario_id": "s", "pair": "p", "policy": "long_short_cash", "cost_bps": 10.0, "long_exit": 80.0, "max_holding": 20}]
    return simulate.run_scenarios(spark.createDataFrame(df), grid)


def test_trades_slices_and_paths_without_costs(spark):
    ledger = plain_path(spark).cache()
    closed = simulate.trades(ledger).orderBy("entry_date").collect()
    assert [(r["side"], r["entry_date"], r["exit_date"], r["holding_sessions"], r["exit_reason"]) for r in closed] == [("long", day(1), day(3), 2, "recovery"), ("short", day(5), day(7), 2, "recovery")]
    assert closed[0]["net_return"] == pytest.approx(0.999 * 60 / 50 * 0.999 - 1) and closed[1]["gross_return"] == pytest.approx(-(61 / 54 - 1))
    free = {r["date"]: r["matched"] for r in simulate.zero_cost(ledger).collect()}
    assert free[day(2)] == pytest.approx(1.1) and free[day(4)] == pytest.approx(1.2) and free[day(6)] == pytest.approx(1.2 * (2 - 57 / 54)) and free[day(7)] == pytest.approx(1.2 * (2 - 61 / 54))
    cut = simulate.sliced(ledger, str(day(3)), str(day(6))).orderBy("date").collect()
    assert cut[0]["equity"] == 1 and cut[0]["action"] is None and cut[0]["sides"] == 0 and len(cut) == 4
    assert [r["side"] for r in simulate.trades(simulate.sliced(ledger, str(day(3)), None)).collect()] == ["short"]
    assert simulate.sliced(ledger, str(day(7)), None).count() == 0
    stand = simulate.standing(ledger.where(F.col("date") <= F.lit(day(6)))).first()
    assert stand["position"] == "short" and stand["pending_action"] == "exit_next_open" and stand["pending_reason"] == "recovery" and stand["entry_date"] == day(5)


def test_path_metrics(spark):
    found = metrics.path_metrics(plain_path(spark)).first()
    assert found["trades"] == 2 and found["win_rate"] == 0.5 and found["recovery"] == 2 and found["reversals"] == 0 and found["sessions"] == 8
    assert found["long_exposure"] == 0.25 and found["short_exposure"] == 0.25 and found["buy_hold_return"] == pytest.approx(0.22)
    assert metrics.holding_segments(plain_path(spark)).count() == 5


def test_break_even(spark):
    rows = [(f"{s}{c}", s, float(c)) for s in "abcd" for c in (0, 5, 10, 20)]
    gains = {"a": (0.1, 0.05, -0.05, -0.1), "b": (0.0, -0.1, -0.2, -0.3), "c": (0.3, 0.2, 0.1, 0.05), "d": (0.2, 0.1, 0.0, -0.1)}
    ledger = [(f"{s}{c}", day(1), "cash", 1 + g) for s, gs in gains.items() for c, g in zip((0, 5, 10, 20), gs)]
    found = metrics.break_even(spark.createDataFrame(ledger, "scenario_id string, date date, position string, equity double"), spark.createDataFrame(rows, "scenario_id string, strategy string, cost_bps double"))
    assert {r["strategy"]: r["break_even_bps"] for r in found.collect()} == {"a": 7.5, "b": 0.0, "c": None, "d": 10.0}


def test_three_models(spark):
    cases = [
        (("unavailable", False), ("fear", True), ("fear", True), "ok", "unavailable"), (("fear", False), ("fear", True), ("fear", True), "low_model_fit", "low_model_fit"),
        (("fear", True), ("fear", False), ("unavailable", False), "ok", "scaled_only"), (("fear", True), ("greed", True), ("fear", True), "ok", "mixed"),
        (("extreme_fear", True), ("fear", True), ("fear", False), "ok", "mixed_trigger"), (("fear", True), ("fear", True), ("fear", True), "ok", "high"),
    ]
    df = spark.createDataFrame([(*a, *b, *c, q, want) for a, b, c, q, want in cases], "s1 string, e1 boolean, s2 string, e2 boolean, s3 string, e3 boolean, q string, want string")
    got = states.confidence_of_three(F.col("q"), [(F.col(f"s{k}"), F.col(f"e{k}")) for k in (1, 2, 3)])
    assert df.where(got != F.col("want")).count() == 0


def test_fixed_points(spark):
    values = [150000.12, 0.5, 2.5, 1234567.00005, -987654.32105, 99999.99999999999, 1e15, 3.0000000000499996, 123456.12345678905]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 10):
        assert [r["t"] for r in df.select(states.fixed(F.col("v"), digits).alias("t")).collect()] == [f"{v:.{digits}f}" for v in values]


def test_scale_and_signature(spark):
    old = spark.createDataFrame([(t, day(k), 10.0) for t in "ab" for k in range(9)] + [("c", day(0), 1.0)], "ticker string, date date, close double")
    new = old.withColumn("close", F.when((F.col("ticker") == "b") & (F.col("date") == F.lit(day(7))), 10.2).otherwise(F.col("close")))
    assert {r["ticker"]: r["state"] for r in refresh.scale_stability(old, new, str(day(8))).collect()} == {"a": "stable", "b": "drifted", "c": "insufficient"}
    assert {r["ticker"]: r["state"] for r in refresh.scale_stability(old, new, str(day(7))).collect()} == {"a": "stable", "b": "stable", "c": "insufficient"}
    one = old.where("ticker = 'a'")
    assert refresh.signature(one, "date", ["close"]).first() == refresh.signature(one.repartition(3), "date", ["close"]).first() != refresh.signature(new.where("ticker = 'b'"), "date", ["close"]).first()
    assert refresh.seed(one, str(day(8)), least=9).where("is_frozen").count() == 4 and refresh.seed(one, str(day(8)), least=10).count() == 0


def test_gap_repair(spark):
    official = spark.createDataFrame([("a", day(k), 10.0 + k, 10.0 + k) for k in range(5)], "ticker string, date date, open double, close double")
    whole = official.where(F.col("date") != F.lit(day(2))).withColumn("open", F.col("open") / 2).withColumn("close", F.col("close") / 2)
    fixed = reconcile.repair_gaps(official, whole).where("filled").collect()
    assert len(fixed) == 1 and fixed[0]["close"] == pytest.approx(6.0)
    broken = whole.withColumn("close", F.when(F.col("date") > F.lit(day(2)), F.col("close") * 2).otherwise(F.col("close")))
    assert reconcile.repair_gaps(official, broken).count() == 0


def test_upsert_and_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, 2.5), (3, 3.0)], "k int, v double")
    assert sorted(reconcile.upsert(a, b, ["k"]).collect()) == [(1, 1.0), (2, 2.5), (3, 3.0)]
    assert reconcile.differing(a, b, ["k"], {"v": 0.1}).count() == 3
