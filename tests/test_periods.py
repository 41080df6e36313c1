"""Periods of runs, and features, entries and returns across the borders of parts, against loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fluxlens.operators import events, frame, periods

DAY = datetime.date(2020, 1, 1)
FIELDS = "id int, market string, window string, end_mode string, start date, end date"


def day(k):
    return DAY + datetime.timedelta(k)


def shifted(d, months):
    year, month = divmod(d.year * 12 + d.month - 1 - months, 12)
    for size in (31, 30, 29, 28):
        try:
            return datetime.date(year, month + 1, min(d.day, size))
        except ValueError:
            pass


def brute(window, mode, start, end, days):
    if not days:
        return None, None, None, None, None, "no_sessions"
    mode = mode or "latest"
    if window not in periods.KINDS or mode not in ("latest", "fixed") or (window == "custom" and start is None) or (mode == "fixed" and end is None):
        return None, None, None, None, None, "invalid"
    until = min(end, days[-1]) if mode == "fixed" or (window == "custom" and end) else days[-1]
    since = {"all": None, "custom": start, "ytd": until.replace(month=1, day=1)}[window] if window not in periods.MONTHS else shifted(until, periods.MONTHS[window])
    inside = [d for d in days if (since is None or d >= since) and d <= until]
    return since, until, inside[0] if inside else None, inside[-1] if inside else None, len(inside), "ok" if inside else "empty"


@pytest.mark.parametrize("rows", [7, 1 << 18])
def test_periods_equal_a_loop(spark, rows):
    rnd = random.Random(rows)
    lines = {"a": sorted(rnd.sample(range(1500), 300)), "b": [59, 60, 790], "c": []}
    sessions = [(m, day(k)) for m, ks in lines.items() for k in ks for _ in range(rnd.choice([1, 1, 3]))] + [(None, day(5)), ("c", None)]
    rnd.shuffle(sessions)
    maybe = lambda low, high: day(rnd.randrange(low, high)) if rnd.random() < 0.85 else None
    asked = [(k, rnd.choice(["a", "a", "b", "c", None, "unknown"]), rnd.choice([*periods.KINDS, "custom", "2w", None]), rnd.choice(["latest", "fixed", None, "other"]), maybe(-50, 1600), maybe(-50, 1600)) for k in range(250)]
    found = periods.resolved(spark.createDataFrame(asked, FIELDS), spark.createDataFrame(sessions, "market string, date date"), key="id", market="market", rows=rows)
    got = {r["id"]: tuple(r)[2:] for r in found.collect()}
    assert got == {k: brute(w, mode, start, end, [day(x) for x in lines.get(m, [])]) for k, m, w, mode, start, end in asked}


def test_periods_of_nothing_and_ends_of_months(spark):
    one = spark.createDataFrame([(1, "m", "1m", "latest", None, None), (2, "m", "1y", "fixed", None, datetime.date(2024, 2, 29))], FIELDS)
    sessions = spark.createDataFrame([("m", datetime.date(2024, 3, 31)), ("m", datetime.date(2023, 2, 28))], "market string, date date")
    got = {r["id"]: (r["start"], r["sessions"]) for r in periods.resolved(one, sessions, key="id", market="market").collect()}
    assert got == {1: (datetime.date(2024, 2, 29), 1), 2: (datetime.date(2023, 2, 28), 1)}
    assert {r["state"] for r in periods.resolved(one, sessions.limit(0), key="id", market="market").collect()} == {"no_sessions"}
    assert periods.resolved(one.limit(0), sessions, key="id", market="market").count() == 0


@pytest.fixture(scope="module")
def bars(spark):
    rnd = random.Random(3)
    rows = [(day(k), 0.0 if k == 40 else rnd.uniform(50, 150), rnd.uniform(1e6, 2e6), rnd.uniform(-1e5, 1e5)) for k in range(600)]
    return rows, spark.createDataFrame(rows, "date date, close double, trading_value double, individual_net_purchase double").repartition(3)


def test_features_across_borders(bars):
    rows, df = bars
    cut = frame.features(df.select("date", "close", "trading_value"), df.select("date", "individual_net_purchase"), rows=100)
    got = {r["date"]: r for r in cut.collect()}
    close = [r[1] for r in rows]
    assert len(got) == 600 and not [c for c in cut.columns if c.startswith("__")]
    for k, r in enumerate(rows):
        want = (close[k] / close[k - 1] - 1 if k and close[k - 1] else None, 100 * close[k] / (sum(close[k - 49 : k + 1]) / 50) if k >= 49 else None, close[k] / max(close[k - 251 : k + 1]) - 1 if k >= 251 else None)
        for a, b in zip((got[r[0]][c] for c in ("return_1d", "disparity50", "mdd252")), want):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_returns_across_borders(spark, bars):
    rows, _ = bars
    twice = spark.createDataFrame([("t", r[0], r[1]) for r in rows] + [("t", day(100), 1.0), ("u", day(3), 2.0), ("u", day(4), None)], "ticker string, date date, close double")
    line = [r for r in rows if r[0] != day(100)]
    want = {("t", r[0], h): line[k + h][1] / r[1] - 1 if k + h < len(line) and r[1] else None for k, r in enumerate(line) for h in (1, 20)} | {("u", day(3), h): None for h in (1, 20)}
    for size in (50, 1 << 18):
        got = {(r["ticker"], r["date"], r["horizon"]): r["value"] for r in events.forward_returns(twice, (1, 20), rows=size).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())


def test_entries_across_borders(spark):
    rnd = random.Random(4)
    rows = [(c, day(k), rnd.choice(["extreme_fear", "extreme_greed", "neutral", None]), rnd.random() < 0.7) for c in ("a", None) for k in range(400)]
    df = spark.createDataFrame(rows, "channel string, date date, state string, trade_eligible boolean").repartition(3)
    want = set()
    for c in ("a", None):
        before = None
        for k, (_, d, state, eligible) in enumerate([r for r in rows if r[0] == c]):
            if eligible:
                if state in ("extreme_fear", "extreme_greed") and state != before:
                    want.add((c, d, state, k))
                before = state
    for size in (30, 1 << 18):
        found = events.extreme_entries(df, rows=size)
        assert {(r["channel"], r["date"], r["state"], r["position"]) for r in found.collect()} == want and found.columns == [*df.columns, "position"]
        assert found.where(F.col("channel").isNull()).count() > 0
