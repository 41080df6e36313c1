"""Prefix scans, block selection and greedy chains against plain windows, sorts and folds."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxlens.operators import asof, chains, regression, scan, selection
from fluxlens.plans import ordered

PLAIN = {"max": F.max, "min": F.min, "sum": F.sum, "product": F.product, "count": F.count, "last": lambda c: F.last(c, True), "first": lambda c: F.first(c, True)}


@pytest.fixture(scope="module")
def lines(spark):
    """Three groups, one of them of a null key, in no order, with nulls, and a group of one row."""
    rnd = random.Random(1)
    rows = [(rnd.choice([None, "a", "b"]), k, None if rnd.random() < 0.3 else rnd.uniform(0.5, 1.5)) for k in range(1500)] + [("c", 5, 1.0)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "g string, t int, v double").repartition(3).cache()


def plain(df):
    return sorted((tuple(f"{x:.6g}" if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("backwards", [False, True])
def test_running_values_equal_windows(lines, strict, backwards):
    found = scan.running(lines, ["g"], ["t"], {f"x_{k}": (k, "v") for k in PLAIN}, strict=strict, backwards=backwards, rows=100)
    line = Window.partitionBy("g").orderBy(F.desc("t") if backwards else F.asc("t")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    assert plain(found) == plain(lines.select("*", *[f("v").over(line).alias(f"x_{k}") for k, f in PLAIN.items()]))


def test_one_part_needs_no_summaries(lines):
    found = scan.running(lines, ["g"], ["t"], {"x": ("count", "v")}, strict=True)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert plain(found) == plain(scan.running(lines, ["g"], ["t"], {"x": ("count", "v")}, strict=True, rows=50))
    assert scan.running(lines.limit(0), ["g"], ["t"], {"x": ("sum", "v")}, rows=5).count() == 0


def test_frames_equal_windows(lines):
    columns = {"m": lambda w: F.avg("v").over(w.rowsBetween(-40, 0)), "n": lambda w: F.count("t").over(w.rowsBetween(-40, 3)), "l": lambda w: F.lead("t", 3).over(w)}
    line = Window.partitionBy("g").orderBy("t")
    want = plain(lines.select("*", *[f(line).alias(n) for n, f in columns.items()]))
    for rows in (1, 41, 100, 10_000):
        assert plain(scan.framed(lines, ["g"], ["t"], columns, preceding=40, following=3, rows=rows)) == want


def test_columns_of_the_callers_names(lines):
    clashing = lines.withColumns({c: F.lit(1) for c in ("position", "part", "block", "by", "own", "none")})
    found = scan.framed(clashing, ["g"], ["t"], {"l": lambda w: F.lag("t").over(w)}, preceding=1, rows=100)
    assert found.columns == [*clashing.columns, "l"] and found.count() == lines.count() and found.agg(F.sum("position")).first()[0] == lines.count()


def test_positions_of_tied_and_null_times(spark):
    df = spark.createDataFrame([(None, 1), (3, 1), (3, 2), (None, 2), (7, 1)], "t int, u int")
    assert sorted((r["position"], r["t"]) for r in scan.positions(df, [], ["t", "u"], rows=2).collect()) == [(0, None), (1, None), (2, 3), (3, 3), (4, 7)]


def test_no_exchange_to_a_single_partition(spark, sf_dir):
    for query in (ordered.b1_b7_features, ordered.f5_running_drawdown, ordered.f6_cumulative_product, ordered.f10_drawdown_to_date):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "__part" in plan
        # What meets in one task is the first close and one row of sums a part, never the line.
        for at in [k for k in range(len(plan)) if plan.startswith("Exchange SinglePartition", k)]:
            below = plan[at:].split("\n")[1]
            assert "partial_min_by" in below or "__sum_" in below


def test_as_of_across_parts(spark):
    rnd = random.Random(4)
    left, right = [("k", t) for t in rnd.sample(range(400), 150)], [("k", t, float(t)) for t in rnd.sample(range(400), 60)]
    a, b = spark.createDataFrame(left, "m string, d int"), spark.createDataFrame(right, "m string, d int, v double")
    before = asof.strictly_before(a, b, by=["m"], on="d", values=["v"], stamp="s", rows=16).collect()
    assert len(before) == len(left) and all(r["s"] == max((t for _, t, _ in right if t < r["d"]), default=None) for r in before)
    near = asof.neighbours(a, b, by=["m"], on="d", values=["v"], rows=16).collect()
    assert len(near) == len(left)
    for r in near:
        assert (r["before"]["at"] if r["before"] else None) == max((t for _, t, _ in right if t < r["d"]), default=None)
        assert (r["after"]["at"] if r["after"] else None) == min((t for _, t, _ in right if t > r["d"]), default=None)


def fold(positions, gap):
    kept = []
    for p in sorted(set(positions)):
        if not kept or p >= kept[-1] + gap:
            kept.append(p)
    return kept


def test_greedy_choice_equals_the_fold(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None]), rnd.randrange(6000)) for _ in range(1500)] + [("z", 5), ("z", 5), ("y", None)]
    df = spark.createDataFrame(data, "c string, p int")
    want = {c: fold([p for x, p in data if x == c and p is not None], 21) for c in ("a", "b", None, "z")}
    for rows in (10_000, 64):
        found = {}
        for r in chains.greedy(df, ["c"], "p", 21, rows=rows).collect():
            found.setdefault(r["c"], []).append(r["p"])
        assert {c: sorted(p) for c, p in found.items()} == want
    assert chains.greedy(df.limit(0), ["c"], "p", 21).count() == 0


def test_greedy_choice_among_a_million(spark):
    df = spark.range(1_000_000).select((F.col("id") * 3 + F.pmod(F.xxhash64("id"), F.lit(3))).alias("p"), F.lit("m").alias("c"))
    found = chains.greedy(df, ["c"], "p", 21)
    assert np.array_equal(np.sort(found.toPandas()["p"].to_numpy()), fold(df.toPandas()["p"].tolist(), 21))


def series(n, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.01, n)
    return x, -0.8 * x + rng.normal(0, 0.004, n)


def test_selected_signals_equal_sorted_ones(spark):
    data = []
    for k, c in enumerate(("main", "noisy")):
        x, y = series(500, k)
        x[300:420] = 0.01  # doesn't vary over a short window
        data += [(c, i, None if i % 97 == 5 else float(a), float("nan") if i % 89 == 7 else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "channel string, d int, return_1d double, flow_share double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), "d")).drop("d")
    want = regression.rolling_signals(df, window=60, least=40).drop("residuals")
    for rows in (70, 1 << 14):
        found = selection.rolling_signals(df, window=60, least=40, rows=rows)
        assert found.columns == want.columns and plain(found) == plain(want)
    assert {r["quality"] for r in want.collect()} >= {"insufficient_history", "invalid_regression", "ok"}
    moved = selection.rolling_signals(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in moved


@pytest.mark.parametrize("lookback,quantile", [(1, 0.1), (30, 0.1), (41, 0.5), (20, 1.0)])
def test_sliding_quantile_equals_percentiles(spark, lookback, quantile):
    rng = np.random.default_rng(5)
    data = [(k, None if k % 83 == 3 else float(v)) for k, v in enumerate(rng.integers(0, 40, 300))]
    df = spark.createDataFrame(data, "t int, v double")
    found = {r["t"]: r["q"] for r in selection.sliding_quantile(df, [], ["t"], "v", "q", lookback=lookback, quantile=quantile, rows=50).collect()}
    for t, _ in data:
        past = [v for _, v in data[max(0, t - lookback) : t]]
        if len(past) < lookback or None in past:
            assert found[t] is None
        else:
            assert found[t] == pytest.approx(float(np.quantile(past, quantile)))


def test_tree_of_ranks():
    tree, held, rnd = selection.Ranks(37), [], random.Random(6)
    for _ in range(400):
        if held and rnd.random() < 0.4:
            tree.add(held.pop(rnd.randrange(len(held))), -1)
        else:
            held.append(rnd.randrange(37))
            tree.add(held[-1], 1)
        assert [tree.kth(k) for k in range(len(held))] == sorted(held)
