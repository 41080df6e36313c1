"""Periods that runs evaluate: requests resolved against the sessions of their market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.operators import asof, scan
from fluxlens.sources.landing import stored

#: Months that a window goes back from its last day.
MONTHS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "3y": 36}
KINDS = ("all", "custom", "ytd", *MONTHS)


def last_day(window: Column, mode: Column, asked: Column, latest: Column) -> Column:
    """The last day of a period: the market's latest one, or one asked for by a fixed end or a custom window, up to it."""
    own = (mode == "fixed") | ((window == "custom") & asked.isNotNull())
    return F.when(F.coalesce(own, F.lit(False)), F.least(asked, latest)).otherwise(latest)


def first_day(window: Column, asked: Column, end: Column) -> Column:
    """The first day of a period that ends so; null for all there is.  Months go back to the same day, or the last of a shorter month."""
    day = F.when(window == "custom", asked).when(window == "ytd", F.trunc(end, "year"))
    for name, months in MONTHS.items():
        day = day.when(window == name, F.add_months(end, -months))
    return day


def resolved(requests: DataFrame, sessions: DataFrame, *, key: str, market: str, rows: int = scan.ROWS) -> DataFrame:
    """For each request its period's days, its first and last session and how many sessions it has.

    ``requests``: a unique ``key``, ``market``, window (see ``KINDS``),
    end_mode ('latest' or 'fixed'), start and end (days, or null).
    ``sessions``: market and date; repeated ones count once, null ones not.

    Returns key, market, start, end, first_session, last_session, sessions and
    state: 'no_sessions' where the market has none, 'invalid' where the window
    is unknown, a custom one has no start or a fixed end no day, 'empty' where
    no session lies in the period, else 'ok'.  Of the first three all else is
    null, and of an empty one the sessions are 0.

    Every bound looks up the last session before it, all in one timeline by
    market (see :mod:`fluxlens.operators.asof`): neither requests meet all
    sessions nor does a market's line gather in one task.
    """
    days = stored(sessions.where(F.col(market).isNotNull() & F.col("date").isNotNull()).select(F.col(market).alias("market"), "date").distinct(), "sessions")
    placed = scan.positions(days, ["market"], ["date"], "place", rows=rows)
    line = scan.framed(placed, ["market"], ["date"], {"next": lambda w: F.lead("date").over(w)}, preceding=0, following=1, rows=rows)
    ends = days.groupBy("market").agg(F.min("date").alias("earliest"), F.max("date").alias("latest"))
    asked = requests.select(F.col(key).alias("key"), F.col(market).alias("market"), "window", F.coalesce("end_mode", F.lit("latest")).alias("mode"), F.col("start").alias("own_start"), F.col("end").alias("own_end")).join(ends, "market", "left")
    wrong = ~F.coalesce(F.col("window").isin(*KINDS) & F.col("mode").isin("latest", "fixed"), F.lit(False))
    wrong = wrong | ((F.col("window") == "custom") & F.col("own_start").isNull()) | ((F.col("mode") == "fixed") & F.col("own_end").isNull())
    end = last_day(F.col("window"), F.col("mode"), F.col("own_end"), F.col("latest"))
    checked = asked.withColumn("refused", F.when(F.col("latest").isNull(), "no_sessions").when(wrong, "invalid")).withColumn("until", end)
    periods = stored(checked.withColumn("since", first_day(F.col("window"), F.col("own_start"), F.col("until"))), "periods")
    # Two bounds a request: the last session before its first day, and that before the day after its last one.
    bounds = F.array(F.struct(F.lit("low").alias("bound"), F.col("since").alias("at")), F.struct(F.lit("high").alias("bound"), F.date_add("until", 1).alias("at")))
    looked = periods.where("refused is null").select("key", "market", F.explode(bounds).alias("b")).select("key", "market", F.col("b.bound").alias("bound"), F.col("b.at").alias("date")).where("date is not null")
    found = asof.strictly_before(looked, line, by=["market"], on="date", values=["place", "next"], stamp="session", rows=rows)
    pick = lambda bound, c: F.max(F.when(F.col("bound") == bound, F.col(c)))
    both = found.groupBy("key").agg(pick("low", "session").alias("low"), pick("low", "place").alias("low_place"), pick("low", "next").alias("next"), pick("high", "session").alias("high"), pick("high", "place").alias("high_place"))
    count = F.greatest(F.lit(0), F.coalesce("high_place", F.lit(-1)) - F.coalesce("low_place", F.lit(-1)))
    known = periods.join(both, "key", "left").withColumn("n", F.when(F.col("refused").isNull(), count))
    some = F.col("n") > 0
    return known.select(
        F.col("key").alias(key), F.col("market").alias(market), *[F.when(F.col("refused").isNull(), F.col(a)).alias(b) for a, b in (("since", "start"), ("until", "end"))],
        F.when(some, F.when(F.col("low").isNull(), F.col("earliest")).otherwise(F.col("next"))).alias("first_session"), F.when(some, F.col("high")).alias("last_session"),
        F.col("n").alias("sessions"), F.coalesce("refused", F.when(some, "ok").otherwise("empty")).alias("state"))
