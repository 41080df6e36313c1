"""Headers, codes, channels, reasons, statuses and filled rows; sources chosen, cut and held against each other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fluxlens.functions import states
from fluxlens.operators import events, reconcile, status
from fluxlens.sources import headers, landing

DAY = dt.date(2020, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def test_aliases(spark):
    df = spark.createDataFrame([("20200101", "1,000", "x", "o`d"), ("bad", "2", "3", ""), (None, "2", "3", ""), ("20200102", "-", "4", ""), ("20200103", "5", None, None)], "`날짜` string, `개인` string, `외국인` string, `odd ``name` string")
    names = {"date": ("date", "날짜"), "individual_net_purchase": ("개인",), "foreigner_net_purchase": ("외국인합계", "외국인"), "institutional_net_purchase": ("기관합계",), "odd": ("odd `name",)}
    named = headers.aliased(df, names, required=["date", "individual_net_purchase"])
    assert named.columns == ["date", "individual_net_purchase", "foreigner_net_purchase", "odd"]
    found = headers.typed_flows(named.drop("odd")).orderBy("date").collect()
    assert [tuple(r) for r in found] == [(DAY, 1000.0, None), (day(2), 5.0, None)]
    with pytest.raises(ValueError, match="institutional"):
        headers.aliased(df, names, required=["institutional_net_purchase"])
    assert headers.once(named, ["date", "odd"]).count() == 5
    with pytest.raises(Exception, match="duplicate_dates"):
        headers.once(named.unionByName(named), ["date"]).collect()


def test_names_and_codes(spark):
    rows = [("a", 1, " KO SPI", None, " ", "x"), ("a", 2, "kospi", "c1", None, None), ("b", 3, None, "", " ", ""), ("b", 4, "other", " c1 ", "c9", "c9"), (None, 5, "코스피", None, "c2", None)]
    df = spark.createDataFrame(rows, "g string, k int, n string, p string, q string, r string")
    assert sorted((str(r["g"]), r["k"]) for r in headers.first_named(df, "n", ["kospi", "코스피"], by=["g"], order=["k"]).collect()) == [("None", 5), ("a", 1)]
    wanted = spark.createDataFrame([("c1",), ("c1",), ("x",), (None,)], "code string")
    assert sorted((r["code"], r["k"]) for r in headers.last_per_code(df, ["p", "q", "r"], wanted, order=["k"]).collect()) == [("c1", 4), ("x", 1)]
    flows = spark.createDataFrame([(1.0, float("nan"), None)] * 3, "a_net_purchase double, b_net_purchase double, c double")
    assert sorted(map(tuple, headers.channels(flows, least=3).collect())) == [("a", 3, "active"), ("b", 0, "planned")] and headers.channels(flows.select("c")).count() == 0


@pytest.mark.parametrize("text,ok", [("2020-02-29", True), ("2021-02-29", False), ("20200229", False), (" 2020-02-29", False), ("2020-2-29", False), ("2020-02-29T00", False), ("0000-01-01", False), ("0001-01-01", True), ("", False), (None, False), ("2020-02-29\n", False), ("２０２０-02-29", False)])
def test_iso_dates(spark, text, ok):
    found = spark.createDataFrame([(text,)], "t string").select(states.iso_date(F.col("t"))).first()[0]
    assert (found is not None) == ok


def test_reasons_and_statuses(spark):
    messages = {"token_1": "token_1", "Another Refresh runs": "refresh_already_running", "KRX_API_KEY: not configured": "krx_open_api_key_missing", "x Credential": "krx_credentials_missing", "": "refresh_provider_failed", None: "refresh_provider_failed", "a b": "refresh_provider_failed", "x" * 81: "refresh_provider_failed", " \nok\t": "ok"}
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    assert {r["m"]: r["r"] for r in df.select("m", status.public_reason(F.col("m")).alias("r")).collect()} == messages
    rows = [(1, DAY, day(2), False, ["a"]), (2, DAY, day(2), True, None), (3, DAY, None, None, ["disk", "a"]), (4, None, day(9), False, []), (5, day(5), day(2), False, ["b"])]
    prior = spark.createDataFrame(rows, "id int, data_as_of date, known_expected date, known_fresh boolean, reasons array<string>")
    found = {r["id"]: (r["state"], r["reasons"], r["known_expected"], r["known_fresh"]) for r in status.after_failure(prior, F.lit("disk"), F.when(F.col("id") == 3, F.lit(day(1)))).collect()}
    assert found == {
        1: ("stale", ["a", "disk"], day(2), False), 2: ("degraded", ["disk"], day(2), True), 3: ("stale", ["disk", "a"], day(1), False), 4: ("degraded", ["disk"], day(9), False), 5: ("degraded", ["b", "disk"], day(2), False),
    }


def test_rebuilt_frames(spark):
    rows = [(DAY, 1.0, 2.0, 0.5, 3.0, 4.0), (day(1), 1.5, None, 0.5, None, None), (day(2), None, 2.0, None, 5.0, 6.0)]
    history = spark.createDataFrame(rows, "date date, close double, trading_value double, flow_share double, pXOpen double, pXClose double")
    bars, flows, prices = landing.rebuilt(history, ["X"])
    assert bars.count() == 2 and [tuple(r) for r in flows.collect()] == [(DAY, 1.0)] and [tuple(r) for r in prices.collect()] == [("X", DAY, 3.0, 4.0), ("X", day(2), 5.0, 6.0)]
    with pytest.raises(Exception, match="half a bar"):
        landing.rebuilt(history.withColumn("pXOpen", F.lit(None).cast("double")), ["X"])[2].collect()


def test_mixed_treatments_fail(spark):
    summary = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "unavailable"), ("c", "unavailable")], "k string, treatment string")
    assert {r["k"]: r["treatment"] for r in events.one_treatment(summary, "k").collect()} == {"a": "mixed", "b": "x", "c": "unavailable"}
    with pytest.raises(Exception, match="mixed treatments"):
        events.one_treatment(summary, "k", strict=True).collect()


def test_filled_rows(spark):
    base = spark.createDataFrame([(DAY, "own", 1), (day(1), None, 2), (day(2), None, 3)], "date date, s string, k int")
    one, two = spark.createDataFrame([(DAY, None), (day(1), "one")], "date date, s string"), spark.createDataFrame([(DAY, "two"), (day(1), "two")], "date date, s string")
    found = status.filled(base, [one, two], ["s"], defaults={"s": "none"})
    assert sorted(map(tuple, found.collect())) == [(DAY, 1, "two"), (day(1), 2, "one"), (day(2), 3, "none")]


def test_reproduced_runs(spark):
    days = [("a", day(k), p) for k, p in enumerate(["long", "long", "cash", "long"])] + [("b", day(k), p) for k, p in enumerate(["cash", "short"])] + [("c", DAY, "cash")]
    reported = spark.createDataFrame([("a", 0.75, 1, True), ("b", 0.0, 0, False), ("c", 0.1, 0, False), ("d", 0.0, 0, False)], "scenario_id string, exposure double, trades int, is_open boolean")
    found = {r["scenario_id"]: r["state"] for r in status.reproduced(spark.createDataFrame(days, "scenario_id string, date date, position string"), reported).collect()}
    assert found == {"a": "ok", "b": "invalid_position", "c": "exposure_differs", "d": "exposure_differs"}


def test_sources_by_fund(spark):
    kind = "ticker string, date date, close double"
    history = spark.createDataFrame([("a", day(k), 10.0) for k in range(3)] + [("b", day(k), 10.0) for k in range(3)] + [("c", DAY, 1.0)], kind)
    recent = spark.createDataFrame([("a", day(2), 10.04), ("b", day(2), 11.0), ("d", DAY, 5.0), ("c", day(1), 1.0)], kind)
    prices, told = reconcile.chosen_source(history, recent, spark.createDataFrame([(t,) for t in "abcdef"], "ticker string"))
    assert {r["ticker"]: (r["source"], r["reason"]) for r in told.collect()} == {
        "a": ("history", None), "b": ("recent", "provider_disagreement"), "c": ("recent", "provider_disagreement"), "d": ("recent", "history_unavailable"), "e": ("none", "history_unavailable"), "f": ("none", "history_unavailable"),
    }
    assert {r["ticker"]: r["count"] for r in prices.groupBy("ticker").count().collect()} == {"a": 3, "b": 1, "c": 1, "d": 1}


def test_cuts_and_checks(spark):
    kind = "ticker string, date timestamp, close double"
    at = lambda k, h=20: dt.datetime(2020, 1, 1, h) + dt.timedelta(days=k)
    one = spark.createDataFrame([(t, at(k), 10.0 + k) for t in "ab" for k in range(9)], kind)
    two = spark.createDataFrame([("a", at(k), 10.0 + k + (k == 2)) for k in range(9)] + [("b", at(k), 10.0 + k) for k in range(5)], kind)
    # 20 o'clock is the next day there.
    assert reconcile.as_of(one, "2020-01-04", zone="Asia/Seoul").count() == 6 and reconcile.as_of(one, "2020-01-04").count() == 8
    found = {r["ticker"]: r for r in reconcile.combined(one, two, expected="2020-01-08", zone="Asia/Seoul").collect()}
    # Six of seven common days are anchors, the third among them; that doesn't change the state.
    assert tuple(found["a"])[1:6] == (day(7), 0.0, "ok", 6, 1) and found["a"]["anchor_state"] == "mismatch"
    assert (found["b"]["state"], found["b"]["anchor_state"], found["b"]["anchor_reason"]) == ("unavailable", "unavailable", "expected_date_not_common")
    rows = [(DAY, 1.0, 1, True), (DAY, float("nan"), 1, True), (DAY, float("-inf"), 1, True), (DAY, 1.0, None, True), (day(9), 1.0, 1, True), (None, 1.0, 1, True)]
    df = spark.createDataFrame(rows, "date date, v double, n int, f boolean")
    assert reconcile.finite_rows(df, ["v", "n"], end="2020-01-05").count() == 1 and reconcile.finite_rows(df, ["f"], end="2020-01-05").count() == 0
