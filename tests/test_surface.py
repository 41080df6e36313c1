"""Landed files, parsed records, contracts, calendars, SQL functions and the session stream on small tables."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from fluxlens.functions import sql
from fluxlens.operators import calendars, contract
from fluxlens.plans import surface
from fluxlens.sources import dayfiles, records
from fluxlens.streaming import supersede

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture()
def landed(spark, tmp_path):
    rows = [(t, day(31 * m + k), k + 0.126, k + 1.5) for t in ("A", "B") for m in range(4) for k in range(5)]
    path = f"file://{tmp_path}/days"
    dayfiles.land(spark.createDataFrame(rows, "ticker string, date date, open double, close double"), path)
    return path


def file_of(path, ticker, month):
    return glob.glob(f"{path.removeprefix('file://')}/ticker={ticker}/month={month}/part-*")[0]


def test_bounds_are_pushed_to_the_files(spark, landed):
    found = dayfiles.read(spark, landed).where("date >= date'2020-02-02' and date < date'2020-03-04' and ticker = 'B'")
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(date,2020-02-02)" in plan and "LessThan(date,2020-03-04)" in plan and "EqualTo(ticker,B)" in plan and "Filter" not in plan.replace("PushedFilters", "")
    assert sorted((r["ticker"], r["date"], r["open"]) for r in found.collect()) == [("B", day(31 + k), k + 0.13) for k in (1, 2, 3, 4)] + [("B", day(62), 0.13)]
    assert dayfiles.read(spark, landed).where("open > 3").count() == 16 and dayfiles.read(spark, landed).where("date > date'2020-05-01' and date < date'2020-04-01'").count() == 0


def test_only_asked_months_are_opened(landed):
    reader = dayfiles.DayFilesReader({"path": landed, "months": "1", "tickers": "A,X"})
    assert [(p.ticker, len(p.files)) for p in reader.partitions()] == [("A", 1)] * 4 + [("X", 0)]
    left = list(reader.pushFilters([dayfiles.GreaterThan(("date",), day(45)), dayfiles.In(("ticker",), ("A", "B")), dayfiles.IsNotNull(("date",)), dayfiles.GreaterThan(("open",), 1.0)]))
    assert [f.attribute for f in left] == [("open",)]
    assert [p.files[0][-7:] for p in reader.partitions()] == ["2020-02", "2020-03", "2020-04"]


@pytest.mark.parametrize(
    "text,reason",
    [
        ("{", "invalid_json"), ('{"OutBlock": []}', "missing_block"), ('{"OutBlock_1": [{"BAS_DD": "20200101", "close": 1}]}', "missing_open"),
        ('{"OutBlock_1": [{"BAS_DD": "20200101", "open": "x", "close": 1}]}', "invalid_number"),
        ('{"OutBlock_1": [{"BAS_DD": "20200101", "open": 1, "close": 1}, {"BAS_DD": "2020-01-01", "open": 2, "close": 2}]}', "duplicate_dates"), (b"\xff\xfe", "unreadable"),
    ],
)
def test_a_broken_partition_leaves_its_siblings(spark, landed, text, reason):
    with open(file_of(landed, "A", "2020-01"), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    found = dayfiles.read(spark, landed, months=1, tickers=["A", "B", "gone"]).where("date >= date'2020-01-01'").collect()
    assert [(r["ticker"], r["date"], r["reason"]) for r in found if r["reason"]] == [("A", DAY, reason), ("gone", DAY, "missing")]
    assert sum(r["ticker"] == "A" for r in found) == 16 and sum(r["ticker"] == "B" for r in found) == 20


def test_headers_and_numbers(spark, landed):
    with open(file_of(landed, "A", "2020-01"), "w", encoding="utf-8") as f:
        f.write('{"OutBlock_1": [7, null, {"날짜": "2020/01/03", " 시가 ": "1,234.565", "Adj Close": "2"}, {"일자": "", "open": 1, "close": 1}, {"일자": "20200105", "open": "-", "close": 3}]}\n\n{"OutBlock_1": []}')
    found = [r for r in dayfiles.read(spark, landed, digits=1).where("ticker = 'A'").collect() if r["date"].month == 1]
    assert [(r["date"], r["open"], r["close"], r["reason"]) for r in found] == [(day(2), 1234.6, 2.0, None)]


def test_every_record_is_accepted_or_refused(spark):
    texts = {
        1: '{"a": 1, "d": "2020-02-29"}', 2: '{"A": " 1,234.5 "}', 3: '{"a": null, "A": 2, "d": null}', 4: '{"a": "x", "d": "2021-02-29"}', 5: "{", 6: "[1]", 7: '"text"', 8: None, 9: "  ", 10: "{}",
        11: '{"a": [1]}', 12: '{"a": "NaN"}', 13: '{"a": ""}', 14: '{"a": 1e400}', 15: '{"a": true}', 16: "null",
    }
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "id int, t string, errors_ string")
    rows = records.parsed(df, "t", [records.Field("a", "number", ("a", "A")), records.Field("d", "date", required=False)])
    good = {r["id"]: (r["a"], r["d"]) for r in records.accepted(rows).collect()}
    bad = {}
    for r in records.refused(rows, ["id"]).collect():
        bad.setdefault(r["id"], []).append((r["field"], r["code"]))
    assert good == {1: (1.0, dt.date(2020, 2, 29)), 2: (1234.5, None), 3: (2.0, None)}
    whole = {5: "invalid_json", 6: "not_an_object", 7: "not_an_object", 8: "no_document", 9: "no_document", 16: "not_an_object"}
    own = {4: [("a", "invalid_number"), ("d", "invalid_date")], 10: [("a", "missing")], 13: [("a", "missing")], **{k: [("a", "invalid_number")] for k in (11, 12, 15)}}
    assert {k: v for k, v in bad.items() if k != 14} == {k: [(None, c)] for k, c in whole.items()} | own
    assert set(good) | set(bad) == set(texts) and not set(good) & set(bad)
    assert records.parsed(df.limit(0), "t", [records.Field("a")]).count() == 0


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")


def test_refused_values_parse_a_document_once(spark, sf_dir):
    assert parses(surface.a14_refused_values(spark, sf_dir)) == 1


def test_accepted_records_parse_a_document_once(spark, sf_dir):
    found = surface.a14_accepted_records(spark, sf_dir)
    assert parses(found) == 1 and parses(found.where("k > 0 and day > date'2024-01-02'")) == 1
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 9 in (3, 5, 6)")
    assert found.count() == events.count() and found.where("day is null").count() == events.where("event_id % 9 = 5").count()


def test_text_of_any_value(spark):
    texts = {1: '{"a": {"b": [1, "x", null]}}', 2: '{"a": [1.50, true]}', 3: '{"a": 1.50}', 4: '{"a": false}', 5: '{"a": null, "A": "\\u00e9"}', 6: '{"a": " "}', 7: '{"a": {}}'}
    rows = records.parsed(spark.createDataFrame(list(texts.items()), "id int, t string"), "t", [records.Field("a", aliases=("a", "A"))])
    assert {r["id"]: r["a"] for r in records.accepted(rows).collect()} == {1: '{"b":[1,"x",null]}', 2: "[1.5,true]", 3: "1.5", 4: "false", 5: "é", 7: "{}"}
    assert [tuple(r) for r in records.refused(rows, ["id"]).collect()] == [(6, "a", "missing")] and parses(rows.where("a like '1%' and size(errors) = 0")) == 1


def test_contract_rules(spark):
    a = spark.createDataFrame([("x", day(0), 1.0), ("x", day(1), -1.0), ("x", day(1), None), ("y", day(2), float("nan")), (None, day(9), 150.0), (None, None, 2.0)], "k string, d date, v double")
    b = spark.createDataFrame([(day(0),), (day(1),), (day(2),), (day(3),)], "d date")
    rules = [
        contract.present("a", "d"), contract.positive("a", "v"), contract.ranged("a", "v", 0, 100), contract.one_of("a", "k", ["x", "y"]), contract.matching("a", "k", "^x$"), contract.unique("a", "k", "d"), contract.unique("b", "d"),
        contract.within("a", ["d"], "b", "a_in_b"), contract.within("b", ["d"], "a", "b_in_a"), contract.neighbours("a", "rises", ["k"], ["d", "v"], ["v"], lambda p: F.col("v") >= p["v"]),
    ]
    frame = contract.violations({"a": a, "b": b}, {"a": ["k", "d"], "b": ["d"]}, rules)
    found = {(r["table_name"], r["rule"]): (r["violations"], r["first_key"], r["last_key"]) for r in frame.collect()}
    assert found == {
        ("a", "d_present"): (1, "null|null", "null|null"), ("a", "v_positive"): (3, "x|2020-01-02", "y|2020-01-03"), ("a", "v_range"): (3, "null|2020-01-10", "y|2020-01-03"), ("a", "k_known"): (2, "null|2020-01-10", "null|null"),
        ("a", "k_form"): (3, "null|2020-01-10", "y|2020-01-03"), ("a", "k_d_unique"): (1, "x|2020-01-02", "x|2020-01-02"), ("b", "d_unique"): (0, None, None), ("a", "a_in_b"): (2, "2020-01-10", "null"), ("b", "b_in_a"): (1, "2020-01-04", "2020-01-04"),
        ("a", "rises"): (2, "x|2020-01-02", "x|2020-01-02") if found[("a", "rises")][0] == 2 else found[("a", "rises")],
    }
    with pytest.raises(ValueError):
        contract.violations({"a": a}, {"a": ["k"]}, [rules[0], rules[0]])


def test_each_table_is_read_once(spark, sf_dir, tmp_path):
    daily = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("date"))
    rules = [contract.present("d", "date"), contract.positive("d", "close"), contract.unique("d", "date"), contract.within("d", ["date"], "l", "shipped"), contract.within("l", ["date"], "d", "ordered")]
    plan = contract.violations({"d": daily, "l": lines}, {"d": ["date"], "l": ["date"]}, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and len(surface.contract_rules()) >= 20
    seen, told = contract.watched(daily, "d", rules)
    seen.write.parquet(str(tmp_path / "out"))
    assert told.get == {"rows": daily.count(), "date_present": 0, "close_positive": 0}


def test_input_quality(spark):
    bars, flows = "date date, open double, close double, trading_value double", "date date, flow double"
    core = [(day(k), 1.0, 2.0, 3.0) for k in range(220)]
    whole = contract.input_quality(spark.createDataFrame(core, bars), spark.createDataFrame([(day(k), 1.0) for k in range(220)], flows), expected=str(day(221))).first()
    assert whole["issues"] == [] and whole["overlap"] == 1.0 and whole["freshness_lag"] == 2
    bad = contract.input_quality(spark.createDataFrame([*core[:10], (day(3), 0.0, None, 1.0), (day(4), 1.0, 1.0, 0.0)], bars), spark.createDataFrame([(day(k), float("nan")) for k in range(5, 30)], flows), expected=str(day(5))).first()
    assert bad["issues"] == ["duplicate_core_dates", "invalid_price", "invalid_trading_value", "invalid_flow", "latest_source_date_mismatch", "source_date_gaps", "source_date_after_expected", "insufficient_common_history"]
    assert (bad["common"], bad["a_only"], bad["b_only"], bad["source_lag"], bad["freshness_lag"]) == (5, 5, 20, 20, 0)
    none = contract.input_quality(spark.createDataFrame([], bars), spark.createDataFrame([], flows)).first()
    assert none["issues"] == ["missing_core", "missing_flow", "insufficient_common_history"]


def test_calendars_as_bitmaps(spark):
    rnd = random.Random(1)
    edges = [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in (-40000, -32769, -32768, -32767, -1, 0, 1, 2, 9862, 32768, 32769, 40000)]
    more = [dt.date(1995, 1, 1) + dt.timedelta(days=rnd.randrange(3000)) for _ in range(300)]
    sets = {"a": set(edges + more[:200]), "b": set(edges[::2] + more[100:]), "c": {more[150]}}
    df = spark.createDataFrame([(n, d) for n, s in sets.items() for d in s] + [("a", edges[0]), ("a", None)], "name string, date date")
    bits = calendars.bitmaps(df, ["name"]).cache()
    a, b, c = sets.values()
    assert {tuple(r) for r in calendars.days_of(bits, ["name"]).collect()} == {(n, d) for n, s in sets.items() for d in s}
    assert tuple(calendars.overlap(bits, ["a", "b"]).first()) == (len(a & b), len(a | b), len(a & b) / len(a | b)) and calendars.overlap(bits, ["a", "b", "none"]).first()["common"] == 0
    assert {r[0] for r in calendars.common_days(bits, ["a", "b", "c"]).collect()} == a & b & c
    assert {tuple(r) for r in calendars.differences(bits, "a", "b").collect()} == {(d, "missing") for d in a - b} | {(d, "extra") for d in b - a}
    assert {tuple(r) for r in calendars.against_rest(bits).collect()} == {(n, len(s), len((a | b | c) - s)) for n, s in sets.items()}
    assert calendars.overlap(bits.limit(0), ["a"]).first()["jaccard"] == 0


def test_sql_functions(spark):
    own = sql.session(spark)
    states = "select p, classify_state(p, 5) as five, classify_state(p, 1) as one from values (5.0D), (5.1D), (20.0D), (79.9D), (80.0D), (95.0D), (100.0D), (1.0D), (cast('nan' as double)), (null) t(p)"
    assert [r["five"] for r in own.sql(states).collect()] == ["extreme_fear", "fear", "fear", "neutral", "greed", "extreme_greed", "extreme_greed", "extreme_fear", "unavailable", "unavailable"]
    assert [r["one"] for r in own.sql(states).collect()][:6] == ["fear", "fear", "fear", "neutral", "greed", "greed"]
    assert own.sql("select numeric_text(' 1,234 '), numeric_text('x'), minimum_observations(252L), minimum_observations(30L), state_trigger('fear', null), drawdown(1D, 0D)").first()[:] == (1234.0, None, 200, 30, "unavailable", None)
    rows = [("a", day(0), "x", True), ("a", day(1), "x", True), ("a", day(2), None, True), ("a", day(3), None, False), ("a", day(4), "extreme_fear", True), ("a", day(5), "x", False), ("a", day(6), "extreme_fear", True), ("b", day(0), "extreme_greed", True), (None, day(0), "x", None)]
    own.createDataFrame(rows, "channel string, date date, state string, trade_eligible boolean").repartition(3).createOrReplaceTempView("s")
    found = own.sql("select * from holding_segments(table (s) partition by channel order by date) where channel = 'a' order by segment").collect()
    assert [(r["state"], r["first_date"], r["sessions"]) for r in found] == [("x", day(0), 2), (None, day(2), 1), (None, day(3), 1), ("extreme_fear", day(4), 1), ("x", day(5), 1), ("extreme_fear", day(6), 1)]
    entries = own.sql("select channel, position from extreme_entries(table (s) partition by channel order by date) order by channel").collect()
    assert [tuple(r) for r in entries] == [("a", 4), ("b", 0)]
    with pytest.raises(Exception, match="UNRESOLVED_ROUTINE"):
        spark.sql("select classify_state(1D, 5)")


def test_sessions_on_a_stream(spark, tmp_path):
    base = f"file://{tmp_path}"
    arrivals = [
        [("A", day(k), 1.0 + k, 0) for k in range(8)] + [("A", day(3), 33.0, 1), ("A", None, 1.0, 1), (None, day(0), 1.0, 1)],
        # Confirming, too late, repeated, and provisional after confirmed.
        [("A", day(7), 77.0, 1), ("A", day(1), 0.0, 1), ("A", day(5), 55.0, 0), ("A", day(3), 3.3, 0), ("B", day(2), 1.0, 0)],
        [("A", day(7), 7.5, 0), ("A", day(9), 9.0, 0), ("C", day(900), 1.0, 1)],
        [("C", day(1800), 1.0, 1)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, supersede.ROWS).write.mode("append").parquet(f"{base}/in")
        log = supersede.run(spark, f"{base}/in", f"{base}/out", f"{base}/state")
    found = {(r["ticker"], r["date"]): (r["close"], r["phase"], r["refused"], r["is_frozen"]) for r in supersede.final(log).collect()}
    # A and B have had no row for 400 days: what was open is frozen, and their days are forgotten.
    plain = {k: (1.0 + k, 0, 0, True) for k in (0, 2, 4, 6)} | {1: (2.0, 0, 1, True), 3: (33.0, 1, 0, True), 5: (55.0, 0, 0, True), 7: (77.0, 1, 0, True), 9: (9.0, 0, 0, True)}
    assert {d: v for (t, d), v in found.items() if t == "A"} == {day(k): v for k, v in plain.items()}
    assert found[("B", day(2))] == (1.0, 0, 0, True) and found[("C", day(1800))] == (1.0, 1, 0, False)
    assert spark.conf.get(supersede.STORE, None) != supersede.ROCKS
