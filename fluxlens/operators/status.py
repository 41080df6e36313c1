"""What is told when a run fails, and rows that are filled from other tables by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.operators import scan

# Reasons as they are published, each with the words that a message must hold (in lower case); the first that fits counts.
REASONS = (
    ("refresh_already_running", ("another refresh",)),
    ("krx_open_api_key_missing", ("krx_api_key", "not configured")),
    ("krx_login_credentials_missing", ("krx login credentials", "not configured")),
    ("krx_credentials_missing", ("credential",)),
    ("krx_credentials_missing", ("not configured",)),
    ("krx_open_api_unavailable", ("krx open api",)),
    ("authenticated_pykrx_unavailable", ("pykrx",)),
    ("yfinance_unavailable", ("yfinance",)),
)
OTHER_REASON = "refresh_provider_failed"


def public_reason(message: Column) -> Column:
    """The reason to publish for a message: itself if it is a token already, else what its words tell."""
    text = F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", "")
    lowered = F.lower(text)
    found = F.when(text.rlike("^[a-z0-9_]{1,80}$"), text)
    for reason, words in REASONS:
        held = F.lit(True)
        for w in words:
            held = held & F.contains(lowered, F.lit(w))
        found = found.when(held, reason)
    return found.otherwise(OTHER_REASON)


def after_failure(prior: DataFrame, reason: Column, expected: Column) -> DataFrame:
    """The status rows after a failed run.

    ``prior``: data_as_of, known_expected, known_fresh, reasons (array), and
    whatever else, which stays.  A run that failed is ``stale`` where a later
    session than the data's was expected, now or (where that one was told to
    be missing) before; else ``degraded``.  The reason is put behind those
    that were there, once; what was expected is kept where it isn't passed.
    """
    missed = F.when(~F.coalesce("known_fresh", F.lit(True)), F.col("known_expected"))
    effective = F.greatest(expected, missed)  # passes over nulls
    late = F.coalesce(effective > F.col("data_as_of"), F.lit(False))
    return prior.withColumns({
        "state": F.when(late, "stale").otherwise("degraded"),
        "reasons": F.array_distinct(F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array(public_reason(reason)))),
        "known_expected": F.when(late, effective).otherwise(F.col("known_expected")),
        "known_fresh": F.when(late, F.lit(False)).otherwise(F.col("known_fresh")),
    })


def filled(base: DataFrame, sources: Sequence[DataFrame], fields: Sequence[str], *, on: Sequence[str] = ("date",), defaults: dict[str, object] | None = None) -> DataFrame:
    """The base's rows with fields from the first source that has them on the row's keys, then the base's own, then a default.

    Sources have a row a key at most; a null in one passes on to the next.
    """
    out = base
    for k, s in enumerate(sources):
        own = [f for f in fields if f in s.columns]
        out = out.join(s.select(*on, *[F.col(f).alias(f"__{k}_{f}") for f in own]), list(on), "left")
    values = {}
    for f in fields:
        there = [F.col(f"__{k}_{f}") for k, s in enumerate(sources) if f in s.columns] + ([F.col(f)] if f in base.columns else [])
        values[f] = F.coalesce(*there, *([F.lit(defaults[f])] if defaults and f in defaults else []))
    return out.select(*[c for c in base.columns if c not in fields], *[v.alias(f) for f, v in values.items()])


def reproduced(sessions: DataFrame, reported: DataFrame) -> DataFrame:
    """Whether exposure and runs that are counted from sessions are those that were reported, by scenario.

    ``sessions``: scenario_id, date, position; ``reported``: scenario_id,
    exposure, trades, is_open.  A run is a stretch of days in the market; the
    last one may still be open.  The states: invalid_position, exposure_differs,
    trades_differ, ok.
    """
    turned = scan.framed(sessions, ["scenario_id"], ["date"], {"before": lambda w: F.lag("position").over(w)}, preceding=1)
    held = F.col("position") == "long"
    found = turned.groupBy("scenario_id").agg(
        F.avg(held.cast("double")).alias("counted_exposure"), F.count_if(held & ~F.col("before").eqNullSafe("long")).alias("runs"), F.count_if(~F.coalesce(F.col("position").isin("cash", "long"), F.lit(False))).alias("odd"))
    close = F.abs(F.col("counted_exposure") - F.col("exposure")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("counted_exposure"))
    closed = F.col("runs") - F.when(F.col("is_open"), 1).otherwise(0)
    state = F.when(F.col("odd") > 0, "invalid_position").when(~F.coalesce(close, F.lit(False)), "exposure_differs").when(~F.col("trades").eqNullSafe(closed), "trades_differ").otherwise("ok")
    return reported.join(found, "scenario_id", "left").select("scenario_id", "counted_exposure", "runs", state.alias("state"))
