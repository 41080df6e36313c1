"""Landing zones, sinks and settings."""

import datetime
import json

import pytest

from fluxlens.plans import controls
from fluxlens.sources import landing


def test_day_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"OutBlock_1": [{"name": "x", "close": 1.5}, {"name": "y", "close": 2.5}]}))
    assert sorted(landing.read_day_files(spark, str(tmp_path), "name string, close double").collect()) == [("x", 1.5), ("y", 2.5)]


def test_day_cache_keeps_old_days(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    days = lambda v: spark.createDataFrame([("2024-01-01", v), ("2024-01-02", v)], "date string, v int").selectExpr("to_date(date) as date", "v")
    landing.write_day_cache(days(1), path, "2024-01-02")
    landing.write_day_cache(days(2), path, "2024-01-02")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_csv_quotes(spark, tmp_path):
    landing.write_csv(spark.createDataFrame([('a "b"', 1)], "t string, n int").coalesce(1), f"file://{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text == '"\ufefft","n"\n"a ""b""","1"\n'


def test_json_is_whole_or_not_at_all(tmp_path):
    path = str(tmp_path / "d.json")
    assert landing.write_json_whole({"b": 1, "a": 2}, path) == 13
    with pytest.raises(ValueError):
        landing.write_json_whole({"a": float("nan")}, path)
    assert json.loads(open(path).read()) == {"a": 2, "b": 1}
    assert landing.within_limits({"x": 5, "y": 1}, {"x": 4, "y": 4}) == ["x"]


def test_documents_are_moved_together(tmp_path):
    one, two = str(tmp_path / "1.json"), str(tmp_path / "2.json")
    assert landing.write_documents_whole({one: {"a": 1}, two: {"b": [1, 2]}}) == {one: 7, two: 11}
    with pytest.raises(ValueError):
        landing.write_documents_whole({one: {"a": 2}, two: {"b": float("inf")}})
    assert json.loads(open(one).read()) == {"a": 1} and len(list(tmp_path.iterdir())) == 2


def test_columns_are_encoded_in_order_and_decoded(spark):
    df = spark.createDataFrame([("x", 1.123456789, 7)], "zeta string, close double, alpha int")
    names, rows = landing.encode_columns(df, ["close", "absent"])
    assert names == ["close", "alpha", "zeta"] and rows.first()["row"] == ["1.12345679", "7", "x"]
    assert landing.decode_columns(rows, names, {"close": "double", "alpha": "int"}).first().asDict() == {"close": 1.12345679, "alpha": 7, "zeta": "x"}
    for bad in ([], ["a", "a", "b"]):
        with pytest.raises(ValueError):
            landing.decode_columns(rows, bad, {})
    with pytest.raises(Exception, match="another width"):
        landing.decode_columns(rows, ["a", "b"], {}).collect()


def test_settings():
    whole = controls.DEFAULTS
    assert controls.identity(whole) == controls.identity(dict(reversed(list(whole.items())))) != controls.identity(whole | {"model": "scaled"})
    assert controls.normalized(whole | {"backtestCost": 5.0})["backtestCost"] == 5
    bad = [{"nope": 1}, {"model": "tukey"}, {"signalExtremeTail": 0}, {"signalLookback": 757}, {"backtestCost": 7}, {"longExitPercentile": 95}, {"signalMinimumR2": 0.42}, {"signalMinimumR2": 0.85}, {"window": "custom"},
           {"window": "custom", "historyStart": "2024-02-01", "historyEnd": "2024-01-01"}, {"historyEndMode": "fixed"}, {"historyStart": "2024-1-1"}, {"backtestCost": float("nan")}]
    for change in bad:
        with pytest.raises(ValueError):
            controls.normalized(whole | change)
    for change in ({"signalLookback": True}, {"signalMaxHolding": 2.0}, {"historyEnd": None}, {"signalMinimumR2": "0.4"}):
        with pytest.raises(TypeError):
            controls.normalized(whole | change)
    with pytest.raises(ValueError):
        controls.normalized({k: v for k, v in whole.items() if k != "window"})


def test_bounds():
    latest = datetime.date(2024, 3, 31)
    at = lambda **change: controls.bounds(controls.DEFAULTS | change, latest)
    assert at() == (datetime.date(2024, 1, 1), latest) and at(window="all") == (None, latest)
    assert at(window="1m") == (datetime.date(2024, 2, 29), latest) and at(window="3y") == (datetime.date(2021, 3, 31), latest)
    assert at(window="custom", historyStart="2023-01-05", historyEnd="2030-01-01") == (datetime.date(2023, 1, 5), latest)
    assert at(window="6m", historyEndMode="fixed", historyEnd="2024-02-29") == (datetime.date(2023, 8, 29), datetime.date(2024, 2, 29))
    assert at(window="1y", historyEndMode="fixed", historyEnd="2024-02-29")[0] == datetime.date(2023, 2, 28)
