"""States, directions, triggers and agreement of signals."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify(percentile: Column, tail: Column | int = 5) -> Column:
    """State of a percentile; ``tail`` bounds the extremes, 20 and 80 the others.  Null or NaN: unavailable."""
    tail = tail if isinstance(tail, Column) else F.lit(tail)
    return (
        F.when(percentile.isNull() | F.isnan(percentile), "unavailable")
        .when(percentile <= tail, "extreme_fear")
        .when(percentile <= 20, "fear")
        .when(percentile < 80, "neutral")
        .when(percentile < 100 - tail, "greed")
        .otherwise("extreme_greed")
    )


def direction(state: Column) -> Column:
    return F.when(state.isin("fear", "extreme_fear"), "fear").when(state.isin("greed", "extreme_greed"), "greed").otherwise("neutral")


def trigger(state: Column, eligible: Column) -> Column:
    """What a signal triggers: its extreme state, nothing, or unavailable."""
    return F.when((state == "unavailable") | ~F.coalesce(eligible, F.lit(False)), "unavailable").when(state.isin("extreme_fear", "extreme_greed"), state).otherwise("none")


def agreed_direction(a: Column, b: Column) -> Column:
    return F.when((a == "unavailable") | (b == "unavailable"), "unavailable").when(direction(a) == direction(b), "agree").otherwise("mixed")


def agreed_trigger(a: Column, b: Column) -> Column:
    """Both, neither, one model alone, or a conflict of two triggers (a: scaled, b: raw)."""
    return (
        F.when((a == "unavailable") | (b == "unavailable"), "unavailable")
        .when(a == b, F.when(a == "none", "neither").otherwise("both"))
        .when(a == "none", "raw_only")
        .when(b == "none", "scaled_only")
        .otherwise("conflict")
    )


def confidence(state_a: Column, eligible_a: Column, state_b: Column, eligible_b: Column) -> Column:
    """Confidence in the first model, given the second."""
    a, b = trigger(state_a, eligible_a), trigger(state_b, eligible_b)
    agreed = agreed_trigger(a, b)
    return (
        F.when(state_a == "unavailable", "unavailable")
        .when(~F.coalesce(eligible_a, F.lit(False)), "low_model_fit")
        .when((state_b == "unavailable") | ~F.coalesce(eligible_b, F.lit(False)), "scaled_only")
        .when(agreed_direction(state_a, state_b) != "agree", "mixed")
        .when(agreed.isin("scaled_only", "raw_only", "conflict"), "mixed_trigger")
        .otherwise("high")
    )


def confidence_of_three(first_quality: Column, models: list[tuple[Column, Column]]) -> Column:
    """Confidence in the first of several (state, eligible) models, given the others that can be used."""
    usable = [F.coalesce((state != "unavailable") & eligible, F.lit(False)) for state, eligible in models]

    def distinct(of) -> Column:
        return F.size(F.array_distinct(F.array_compact(F.array(*[F.when(u, of(state)) for u, (state, _) in zip(usable, models)]))))

    extreme = lambda state: F.when(state.isin("extreme_fear", "extreme_greed"), state).otherwise("none")
    return (
        F.when(models[0][0] == "unavailable", "unavailable")
        .when(first_quality != "ok", "low_model_fit")
        .when(sum((u.cast("int") for u in usable), F.lit(0)) < 2, "scaled_only")
        .when(distinct(direction) > 1, "mixed")
        .when(distinct(extreme) > 1, "mixed_trigger")
        .otherwise("high")
    )


def effective_status(state: Column, official: Column, fresh: Column, expected: Column, data_as_of: Column, last_success: Column, now: Column, allowed_days: Column) -> Column:
    """Status of published data: stale where an official check failed, the expected day isn't there or its age is above what is allowed.

    The age counts whole days from the last success, or without one from the data's day.
    """
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce(last_success, data_as_of.cast("timestamp")))) / 86_400)
    return (
        F.when(state == "unavailable", "unavailable")
        .when(official & ~F.coalesce(fresh, F.lit(True)), "stale")
        .when(expected.isNotNull() & (expected != data_as_of), "stale")
        .when(age > allowed_days, "stale")
        .otherwise(state)
    )


def tone(interval_low: Column, total_returns: list[Column], sharpes: list[Column]) -> Column:
    """Supportive where the event's interval lies above 0 and every strategy gained with a positive ratio; mixed without events or strategy."""
    gains = [F.coalesce((r > 0) & (s > 0), F.lit(False)) for r, s in zip(total_returns, sharpes)]
    good = F.coalesce(interval_low > 0, F.lit(False))
    for g in gains:
        good = good & g
    missing = interval_low.isNull()
    for r in total_returns:
        missing = missing | r.isNull()
    return F.when(good, "supportive").when(missing, "mixed").otherwise("caution")


def minimum_observations(lookback: int) -> int:
    """Fewest observations of a window that a fit may rest on."""
    return min(lookback, max(40, min(200, ceil(0.8 * lookback))))


def public_number(value: Column, digits: int = 10) -> Column:
    """Rounded, or null where it isn't finite."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(F.round(value, digits))


def parse_number(text: Column) -> Column:
    """A number written with thousands separators, or null."""
    return F.nullif(F.replace(F.trim(text), F.lit(",")), F.lit("")).try_cast("double")


def fixed(value: Column, digits: int) -> Column:
    """The number written with so many decimals, rounded from its exact binary value, halves to even.

    The engine's own formatting rounds the shortest decimal that stands for
    the number, which now and then gives another last digit.
    """
    size = F.abs(value)
    whole = F.floor(size)
    parts = ((size - whole) * float(1 << 52)).cast("bigint").cast("decimal(38,0)") * F.lit(10**digits).cast("decimal(20,0)")
    unit = F.lit(1 << 52).cast("decimal(20,0)")
    return F.get(F.transform(F.array(parts), lambda p: F.get(F.transform(F.array(F.floor(p / unit).cast("decimal(20,0)")), lambda q: _written(value, whole, q, (p - q * unit) * 2, unit, digits)), F.lit(0))), F.lit(0))


def _written(value: Column, whole: Column, q: Column, twice: Column, unit: Column, digits: int) -> Column:
    up = (twice > unit) | ((twice == unit) & (q % 2 == 1))
    last = q + F.when(up, 1).otherwise(0)
    carried = last >= 10**digits
    text = F.concat((whole + F.when(carried, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad(F.when(carried, F.lit(0)).otherwise(last).cast("bigint").cast("string"), digits, "0"))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def iso_date(text: Column) -> Column:
    """The day of a text of the form yyyy-mm-dd, ten characters of which eight are ASCII digits; null for others and for days that don't exist, the year 0 among them."""
    sound = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.length(text) == 10) & ~F.startswith(text, F.lit("0000"))
    return F.when(sound, text.try_cast("date"))
