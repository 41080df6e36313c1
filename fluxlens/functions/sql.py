"""SQL functions of the engine: scalar ones written in SQL, and table functions over an ordered, partitioned table argument."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

#: Name, parameters, type and body; registered in this order, as later ones use earlier ones.
SCALAR = (
    ("classify_state", "percentile DOUBLE, tail INT", "STRING", """case when percentile is null or isnan(percentile) or tail is null then 'unavailable' when percentile <= tail then 'extreme_fear'
        when percentile <= 20 then 'fear' when percentile < 80 then 'neutral' when percentile < 100 - tail then 'greed' else 'extreme_greed' end"""),
    ("state_direction", "state STRING", "STRING", "case when state in ('fear', 'extreme_fear') then 'fear' when state in ('greed', 'extreme_greed') then 'greed' else 'neutral' end"),
    ("state_trigger", "state STRING, eligible BOOLEAN", "STRING", """case when state = 'unavailable' or not coalesce(eligible, false) then 'unavailable'
        when state in ('extreme_fear', 'extreme_greed') then state else 'none' end"""),
    ("minimum_observations", "lookback BIGINT", "BIGINT", "cast(least(lookback, greatest(40, least(200, ceil(0.8 * lookback)))) as bigint)"),
    ("numeric_text", "value STRING", "DOUBLE", "try_cast(replace(trim(value), ',', '') as double)"),
    ("drawdown", "close DOUBLE, highest DOUBLE", "DOUBLE", "close / nullif(highest, 0) - 1"),
)


@udtf(returnType="channel string, segment bigint, state string, first_date date, last_date date, sessions bigint")
class HoldingSegments:
    """Runs of equal states: ``holding_segments(TABLE (select channel, date, state ...) PARTITION BY channel ORDER BY date)``.

    Holds one run at a time, whatever the length of a partition.
    """

    def __init__(self):
        self._run = None

    def eval(self, row: Row) -> Iterator[tuple]:
        channel, day, state = row["channel"], row["date"], row["state"]
        if self._run is not None and self._run[2] == state and state is not None:
            self._run[4], self._run[5] = day, self._run[5] + 1
            return
        number = 1 if self._run is None else self._run[1] + 1
        if self._run is not None:
            yield tuple(self._run)
        self._run = [channel, number, state, day, day, 1]

    def terminate(self) -> Iterator[tuple]:
        if self._run is not None:
            yield tuple(self._run)


@udtf(returnType="channel string, date date, state string, position bigint")
class ExtremeEntries:
    """Eligible rows that turn extreme: ``extreme_entries(TABLE (select channel, date, state, trade_eligible ...) PARTITION BY channel ORDER BY date)``."""

    def __init__(self):
        self._before, self._position = None, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["trade_eligible"]:
            if row["state"] in ("extreme_fear", "extreme_greed") and row["state"] != self._before:
                yield row["channel"], row["date"], row["state"], self._position
            self._before = row["state"]
        self._position += 1

    def terminate(self) -> Iterator[tuple]:
        return iter(())


def register(session: SparkSession) -> SparkSession:
    """Makes all functions known to a session, as temporary ones."""
    for name, parameters, kind, body in SCALAR:
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    session.udtf.register("holding_segments", HoldingSegments)
    session.udtf.register("extreme_entries", ExtremeEntries)
    return session


def session(spark: SparkSession) -> SparkSession:
    """A session of its own with the functions; the caller's settings that it has changed are kept."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        own.conf.set(name, spark.conf.get(name))
    return register(own)
