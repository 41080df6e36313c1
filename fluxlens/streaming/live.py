"""Provisional same-day rows scored against a static history, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LIVE = "channel string, date date, observed_at timestamp, close double, previous_date date, previous_close double, flow_share double"


def in_capture_window(observed: Column, day: Column, zone: str = "Asia/Seoul") -> Column:
    """Whether a row was captured from 15:40 to before 16:00 of its own session's day."""
    local = F.from_utc_timestamp(observed, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.to_date(local) == day) & (minute >= 15 * 60 + 40) & (minute < 16 * 60)


def score_live(rows: DataFrame, fits: DataFrame, *, continuity: float = 0.005) -> DataFrame:
    """Scores provisional rows with a fit of the history of their channel; the history is never changed.

    A row is held against the fit of its channel or, where ``fits`` has a
    ``date`` too, against that of its own day: then the history moves on from
    session to session, as each day's confirmed row joins it.

    ``fits``: channel, last_date, closes (of the last 251 sessions, in order),
    alpha, beta, residuals of the fit to the last complete sessions; a row for
    each channel.  Rows tell the session that their source has before them.
    The first that holds is a row's phase: superseded (the history has the
    day), outside_window, session_gap (the session before isn't the history's
    last), discontinuous (its close there is another), provisional.
    """
    last_close = F.element_at("closes", -1)
    change = F.col("close") / F.nullif(last_close, F.lit(0.0)) - 1
    residual = F.col("flow_share") - (F.col("alpha") + F.col("beta") * change)
    recent, year = F.slice("closes", -F.least(F.size("closes"), F.lit(49)), 49), F.concat("closes", F.array("close"))
    mean = (F.aggregate(recent, F.lit(0.0), lambda a, b: a + b) + F.col("close")) / (F.size(recent) + 1)
    phase = (
        F.when(F.col("date") <= F.col("last_date"), "superseded").when(~in_capture_window(F.col("observed_at"), F.col("date")), "outside_window")
        .when(~F.col("previous_date").eqNullSafe(F.col("last_date")), "session_gap").when(F.abs(F.col("previous_close") / last_close - 1) > continuity, "discontinuous").otherwise("provisional")
    )
    by_day = "date" in fits.columns
    scored = rows.join(fits if by_day else F.broadcast(fits), ["channel", "date"] if by_day else "channel").withColumn("phase", phase)  # else a row a channel
    known = F.col("phase") == "provisional"
    percentile = 100.0 * F.get(F.transform(F.array(residual), lambda own: F.size(F.filter("residuals", lambda r: r <= own))), F.lit(0)) / F.size("residuals")
    return scored.select(
        *rows.columns, "last_date", "phase", F.when(known, change).alias("return_1d"), F.when(known, residual).alias("residual"), F.when(known, percentile).alias("percentile"),
        F.when(known, 100 * F.col("close") / mean).alias("disparity50"), F.when(known, F.col("close") / F.array_max(year) - 1).alias("mdd252"))


def stream_scores(spark, source: str, fits: DataFrame, sink: str, checkpoint: str):
    """Reads live rows as they arrive, drops repeats and late ones, and appends their scores."""
    rows = spark.readStream.schema(LIVE).parquet(source).withWatermark("observed_at", "5 days").dropDuplicatesWithinWatermark(["channel", "date", "observed_at"])
    return score_live(rows, fits).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


class PositionProcessor(StatefulProcessor):
    """Order and position of each scenario, carried from session to session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("position", "position string, pending string, held int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        position, pending, held = self.state.get() if self.state.exists() else ("cash", "", 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("date").itertuples(index=False):
            if pending:
                position, held, pending = ("long", 0, "") if pending == "enter" else ("cash", 0, "")
            if position == "long":
                held += 1
                if row.percentile >= row.long_exit or held >= row.max_holding:
                    pending = "exit"
            elif row.entry == "extreme_fear":
                pending = "enter"
            out.append((key[0], row.date, position, pending, held))
        self.state.update((position, pending, held))
        yield pd.DataFrame(out, columns=["scenario_id", "date", "position", "pending", "held"])

    def close(self) -> None:
        pass


def stream_positions(rows: DataFrame) -> DataFrame:
    """Positions of long/cash scenarios over a stream of sessions (scenario_id, date, percentile, entry, long_exit, max_holding)."""
    return rows.groupBy("scenario_id").transformWithStateInPandas(
        statefulProcessor=PositionProcessor(), outputStructType="scenario_id string, date date, position string, pending string, held int", outputMode="Append", timeMode="None")


POSITIONS = "scenario_id string, date date, percentile double, entry string, long_exit double, max_holding int"


def run_positions(spark, source: str, sink: str, checkpoint: str) -> DataFrame:
    """Reads sessions file by file as they come, carries positions from one to the next, and returns what was appended."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema(POSITIONS).option("maxFilesPerTrigger", 1).parquet(source)
        stream_positions(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("scenario_id string, date date, position string, pending string, held int").parquet(sink)
