"""Versions of a published history, and the digests that tell what differs."""

import datetime as dt
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from fluxlens.sources.versions import History, Outcome, differing, refreshed, tree

KIND = "date date, ticker string, close double"


def frame(spark, n=70, changes=(), start=0):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=k), t, None if k % 17 == 3 else float(k)) for k in range(start, n) for t in ("A", "B")]
    rows = [(d, t, dict(changes).get((d.isoformat(), t), c)) for d, t, c in rows]
    random.Random(n).shuffle(rows)
    return spark.createDataFrame(rows, KIND)


def files(base):
    return sorted(glob.glob(f"{base}/data/*/*/part-*"))


@pytest.fixture()
def store(spark, tmp_path):
    history = History(spark, f"file://{tmp_path}")
    assert history.read() is None and history.digests() is None and history.versions() == []
    assert history.publish(frame(spark)) == Outcome("published", 1, ("2020-01", "2020-02", "2020-03"))
    return history, str(tmp_path)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_an_unchanged_run_writes_no_row(spark, store):
    history, base = store
    before = files(base)
    assert history.publish(frame(spark).repartition(5).select("close", "date", "ticker")) == Outcome("unchanged", 1)
    assert files(base) == before and history.versions() == [1] and plain(history.read()) == plain(frame(spark))


def test_one_changed_day_rewrites_its_month(spark, store):
    history, base = store
    before = files(base)
    new = frame(spark, changes={("2020-03-09", "B"): 1.5}.items())
    assert history.publish(new) == Outcome("published", 2, ("2020-03",), ("2020-03-09",))
    assert {f.split("__month=")[1][:7] for f in set(files(base)) - set(before)} == {"2020-03"}
    assert plain(history.read()) == plain(new) and plain(history.read(1)) == plain(frame(spark))
    held = json.load(open(f"{base}/manifests/2.json"))["months"]
    assert held["2020-01"] == json.load(open(f"{base}/manifests/1.json"))["months"]["2020-01"] != held["2020-03"]


def test_what_may_not_change(spark, store):
    history, base = store
    late, old = {("2020-03-04", "A"): 0.0}.items(), {("2020-01-05", "A"): None}.items()
    assert history.publish(frame(spark, changes=late)).status == "frozen_changed"
    assert history.publish(frame(spark, changes=old)) == Outcome("frozen_changed", 1, days=("2020-01-05",))
    assert history.publish(frame(spark, 60)) == Outcome("date_regression", 1) and history.publish(frame(spark).limit(0)) == Outcome("date_regression", 1)
    assert history.publish(frame(spark, changes=old), frozen=False) == Outcome("published", 2, ("2020-01",), ("2020-01-05",))
    assert len(files(base)) == len(set(files(base))) and history.versions() == [1, 2]


def test_a_failure_leaves_the_version_before(spark, store, monkeypatch):
    history, base = store

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(History, "_commit", fail)
        with pytest.raises(OSError):
            history.publish(frame(spark, 75))
    assert history.versions() == [1] and plain(history.read()) == plain(frame(spark))
    assert history.publish(frame(spark, 75)).status == "published" and plain(History(spark, f"file://{base}").read()) == plain(frame(spark, 75))
    with pytest.raises(FileExistsError):
        history._commit(2, "{}")


def test_incremental_runs(spark, store):
    history, _ = store
    assert refreshed(history, frame(spark, 70, start=66), keys=["date", "ticker"]) == Outcome("unchanged", 1)
    assert refreshed(history, frame(spark, 73, start=66), keys=["date", "ticker"]) == Outcome("published", 2, ("2020-03",), ("2020-03-11", "2020-03-12", "2020-03-13"))
    assert plain(history.read()) == plain(frame(spark, 73))


def test_digests(spark):
    one = tree(frame(spark)).cache()
    assert {r["level"]: r["count"] for r in one.groupBy("level").count().collect()} == {"all": 1, "year": 1, "month": 3, "day": 70}
    other = frame(spark, 75, changes={("2020-02-01", "A"): 9.0}.items()).unionByName(spark.createDataFrame([(None, "A", 1.0)], KIND))
    assert differing(one, tree(frame(spark))) == []
    assert differing(one, tree(other)) == ["2020-02-01", *[f"2020-03-{k}" for k in range(11, 16)], "null"] and differing(one, tree(other), "month") == ["2020-02", "2020-03", "null"]
    # Null and empty, repeated rows, and values that have changed places differ.
    values = [[("x", None)], [("x", "")], [("x", ""), ("x", "")], [("", "x")]]
    roots = {tree(spark.createDataFrame([(dt.date(2020, 1, 1), *r) for r in v], "date date, a string, b string")).where("level = 'all'").first()["digest"] for v in values}
    assert len(roots) == 4 and tree(frame(spark).limit(0)).where(F.col("level") == "day").count() == 0
