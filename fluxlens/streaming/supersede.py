"""Sessions on a stream: confirmed rows replace provisional ones, the last five sessions may change, older ones are frozen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROWS = "ticker string, date date, close double, phase int"
OUT = "ticker string, date date, close double, phase int, status string, turn int"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class Sessions(StatefulProcessor):
    """A ticker's sessions that may still change, by day: close and phase (0 provisional, 1 confirmed)."""

    def __init__(self, mutable: int, expires_days: int):
        self._mutable, self._expires = mutable, expires_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getMapState("open", "date date", "close double, phase int")
        # The batches a ticker had rows in, the day up to which it is closed, and the timer that is set.
        self._about = handle.getValueState("about", "turn int, closed date, timer long")

    def _read(self) -> tuple[dict[dt.date, tuple[float, int]], int, dt.date | None, int | None]:
        held = {k[0]: tuple(v) for k, v in self._open.iterator()} if self._open.exists() else {}
        return held, *(self._about.get() if self._about.exists() else (0, None, None))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, turn, closed, timer = self._read()
        out, first = [], min(held) if len(held) >= self._mutable else None
        for r in pd.concat(list(rows)).sort_values(["date", "phase", "close"]).itertuples(index=False):
            # Judged by what earlier batches have brought: as many later sessions were known, or the ticker had been closed.
            if (first is not None and r.date < first) or (closed is not None and r.date <= closed):
                out.append((r.date, r.close, r.phase, "refused"))
            elif r.date not in held or r.phase >= held[r.date][1]:
                held[r.date] = (float(r.close), int(r.phase))
        for d in sorted(held)[: max(0, len(held) - self._mutable)]:
            out.append((d, *held.pop(d), "frozen"))
            if self._open.containsKey((d,)):
                self._open.removeKey((d,))
        for d, v in held.items():
            self._open.updateValue((d,), v)
            out.append((d, *v, "open"))
        if held:
            due = int(dt.datetime.combine(max(held), dt.time(), dt.timezone.utc).timestamp() * 1000) + self._expires * DAY_MS
            if due != timer:
                if timer is not None:
                    self._handle.deleteTimer(timer)
                self._handle.registerTimer(due)
                timer = due
        self._about.update((turn + 1, closed, timer))
        yield self._frame(key, out, turn)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No row for long: what was open is final, and the days aren't kept any more."""
        held, turn, closed, _ = self._read()
        self._open.clear()
        self._about.update((turn + 1, max(held, default=closed), None))
        yield self._frame(key, [(d, *v, "frozen") for d, v in sorted(held.items())], turn)

    @staticmethod
    def _frame(key, out: list[tuple], turn: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r, turn) for r in out], columns=["ticker", "date", "close", "phase", "status", "turn"])

    def close(self) -> None:
        pass


def superseded(rows: DataFrame, *, mutable: int = 5, expires_days: int = 400) -> DataFrame:
    """What each batch makes of the sessions: open ones as they stand, frozen ones once, refused rows.

    A session is frozen when ``mutable`` later ones were known before the
    batch; a row for it is refused.  Of the rows for an open session the one
    of the higher phase counts, and of equal phases the later (within a batch
    the larger close).  A ticker without rows for ``expires_days`` of event
    time has its sessions frozen and its days forgotten.  Rows without ticker,
    date or close take no part.  State is at most ``mutable`` days a ticker.
    """
    known = rows.where("ticker is not null and date is not null and close is not null and phase is not null").withColumn("at", F.col("date").cast("timestamp"))
    return known.withWatermark("at", f"{expires_days} days").groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=Sessions(mutable, expires_days), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def final(log: DataFrame) -> DataFrame:
    """ticker, date, close, phase and refused rows, from the log of :func:`superseded`: the last word on each session."""
    stands = F.col("status") != "refused"
    return log.groupBy("ticker", "date").agg(
        F.max_by("close", F.when(stands, F.struct("turn", F.col("status") == "frozen"))).alias("close"), F.max_by("phase", F.when(stands, F.struct("turn", F.col("status") == "frozen"))).alias("phase"),
        F.count_if(~stands).alias("refused"), F.coalesce(F.bool_or(F.col("status") == "frozen"), F.lit(False)).alias("is_frozen"),
    )


@contextmanager
def _state_store(spark: SparkSession):
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, **options) -> DataFrame:
    """Takes what has arrived in the source since the last run as one batch, and returns the log so far."""
    with _state_store(spark):
        stream = spark.readStream.schema(ROWS).parquet(source)
        superseded(stream, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(OUT).parquet(sink)
