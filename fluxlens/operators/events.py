"""Extreme entries, forward returns after them, and their summaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fluxlens.operators import chains, scan
from fluxlens.sources.landing import stored

HORIZONS = (1, 5, 10, 20)


def extreme_entries(signals: DataFrame, *, rows: int = scan.ROWS) -> DataFrame:
    """Rows where an eligible signal turns extreme: its state differs from that of the eligible row before.

    ``position`` is the row's place in its channel.  The signals are written
    once; a channel is worked on in parts of about so many ``rows``.
    """
    placed = scan.positions(stored(signals, "signals"), ["channel"], ["date"], rows=rows)
    eligible = scan.framed(placed.where("trade_eligible"), ["channel"], ["date"], {"__before": lambda w: F.lag("state").over(w)}, preceding=1, rows=rows)
    return eligible.where(F.col("state").isin("extreme_fear", "extreme_greed") & ~F.col("state").eqNullSafe(F.col("__before"))).drop("__before")


def non_overlapping(events: DataFrame, horizon: int = 20) -> DataFrame:
    """Greedily keeps events that start after the last kept one's horizon, by channel.

    Whether an event is kept depends on the one kept before it; see
    :mod:`fluxlens.operators.chains`.
    """
    events = stored(events, "events")
    chosen = chains.greedy(events, ["channel"], "position", horizon + 1)
    return events.join(chosen, ["channel", "position"], "left_semi")


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = HORIZONS, *, rows: int = scan.ROWS) -> DataFrame:
    """Per ticker and session the returns over so many of its own sessions; days that occur twice are left out altogether.

    Days are counted map-side and written once; a ticker is worked on in parts
    of about so many ``rows``, each with the sessions that follow it.
    """
    once = prices.where(F.col("close").isNotNull()).groupBy("ticker", "date").agg(F.count("*").alias("copies"), F.max("close").alias("close")).where("copies = 1").drop("copies")
    ahead = {f"__ahead_{h}": lambda w, h=h: F.lead("close", h).over(w) for h in horizons}
    found = scan.framed(stored(once, "closes"), ["ticker"], ["date"], ahead, preceding=0, following=max(horizons), rows=rows)
    legs = [F.struct(F.lit(h).alias("horizon"), (F.col(f"__ahead_{h}") / F.nullif("close", F.lit(0.0)) - 1).alias("value")) for h in horizons]
    return found.select("ticker", "date", F.explode(F.array(*legs)).alias("leg")).select("ticker", "date", "leg.horizon", "leg.value")


def unconditional(returns: DataFrame, *keys: str) -> DataFrame:
    """Mean return over all sessions by horizon."""
    known = returns.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return known.groupBy(*keys, "horizon").agg(F.avg("value").alias("usual"))


def summarize(events: DataFrame, returns: DataFrame, *, usual: DataFrame | None = None, paired: DataFrame | None = None, keys: tuple[str, ...] = (), horizons: tuple[int, ...] = HORIZONS, samples: int = 0) -> DataFrame:
    """Count, mean, median and share of gains by state and horizon, rows without events kept.

    Gains are held against ``usual``, a mean by horizon, where there is one;
    else against ``paired``, another asset's returns after the same days,
    where every event has one; else against nothing, as ``treatment`` tells.
    With ``samples`` there are 95 % intervals of both means (see
    :func:`bootstrap`).  ``keys`` are columns of both tables that tell studies
    apart, such as the asset.
    """
    spark = events.sparkSession
    grid = spark.createDataFrame([(s, h) for s in ("extreme_fear", "extreme_greed") for h in horizons], "state string, horizon int")
    on_events, on_returns = [k for k in keys if k in events.columns], [k for k in keys if k in returns.columns]
    both = [k for k in on_events if k in on_returns]
    values = events.select(*on_events, "date", "state").join(returns.where(F.col("value").isNotNull()).select(*on_returns, "date", "horizon", "value"), ["date", *both])
    if paired is not None:
        values = values.join(paired.select("date", "horizon", F.col("value").alias("pair")), ["date", "horizon"], "left")
    else:
        values = values.withColumn("pair", F.lit(None).cast("double"))
    if usual is not None:
        usual_keys = [k for k in keys if k in usual.columns]
        values = values.join(F.broadcast(usual), ["horizon", *usual_keys], "left")  # a row for each key and horizon
    else:
        values = values.withColumn("usual", F.lit(None).cast("double"))
    by = [*keys, "state", "horizon"]
    found = values.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.avg((F.col("value") > 0).cast("double")).alias("positive_rate"),
        F.max("usual").alias("usual"), F.count("pair").alias("pairs"), F.avg("pair").alias("pair_mean"))
    found = found.withColumn("treatment", F.when(F.col("usual").isNotNull(), "fixed_external_mean").when(F.col("pairs") == F.col("n"), "paired_event_returns").otherwise("unavailable"))
    found = found.withColumn("benchmark", F.when(F.col("usual").isNotNull(), F.col("usual")).when(F.col("pairs") == F.col("n"), F.col("pair_mean")))
    intervals = []
    if samples:
        whole = values.join(found.select(*by, "treatment"), by)
        against = F.when(F.col("treatment") == "fixed_external_mean", F.col("usual")).when(F.col("treatment") == "paired_event_returns", F.col("pair"))
        found = found.join(bootstrap(values, by, samples=samples), by, "left")
        excess = bootstrap(whole.withColumn("value", F.col("value") - against).where("value is not null"), by, samples=samples)
        found = found.join(excess.select(*by, F.col("low").alias("excess_low"), F.col("high").alias("excess_high")), by, "left")
        intervals = ["low", "high", "excess_low", "excess_high"]
    studies = events.select(*on_events).distinct().crossJoin(F.broadcast(returns.select(*[k for k in on_returns if k not in both]).distinct())) if keys else None
    # Eight rows for each study; studies are named by hand.
    whole_grid = grid if studies is None else studies.crossJoin(F.broadcast(grid))
    return whole_grid.join(found, by, "left").select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), "mean", "median", "positive_rate", "benchmark", (F.col("mean") - F.col("benchmark")).alias("excess"),
        F.coalesce("treatment", F.lit("unavailable")).alias("treatment"), (F.coalesce("n", F.lit(0)) < 20).alias("small_sample"), *intervals)


def one_treatment(summary: DataFrame, *keys: str, strict: bool = False) -> DataFrame:
    """The treatment that a study's rows share, those without events aside; 'mixed' is for the caller to refuse or, ``strict``, fails."""
    told = F.collect_set(F.when(F.col("treatment") != "unavailable", F.col("treatment")))
    mixed = F.raise_error(F.lit("mixed treatments")).cast("string") if strict else F.lit("mixed")
    return summary.groupBy(*keys).agg(F.when(F.size(told) > 1, mixed).otherwise(F.coalesce(F.get(told, F.lit(0)), F.lit("unavailable"))).alias("treatment"))


def bootstrap(values: DataFrame, keys: list[str], *, samples: int = 10_000, seed: int = 20260715, method: str = "moving_block", block: int | None = None) -> DataFrame:
    """95 % intervals of the mean value by key: samples of single values (``iid``), or of blocks of the values in a circle.

    Values stand in the order of their dates; blocks are about the root of
    their number long, and the last of a sample is cut so that it has as many
    values.  Where a block starts is the hash of seed, keys, sample and block,
    so every engine and every rerun draws alike.  A study's events are few
    hundreds; their running sums are held once, and the draws are differences
    of them.
    """
    if method not in ("iid", "moving_block"):
        raise ValueError("method is 'iid' or 'moving_block'")
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    rows = values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "value"))).getField("value").alias("v"), F.first(name).alias("name"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [interval(np.array(v, float), n, samples, 1 if method == "iid" else block) for v, n in zip(batch.column("v").to_pylist(), batch.column("name").to_pylist())]
            ends = [pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ends], names=["of", "low", "high"])

    boxed = rows.select(F.struct(*keys).alias("of"), "v", "name")
    found = boxed.mapInArrow(draw, StructType([boxed.schema["of"], StructField("low", DoubleType()), StructField("high", DoubleType())]))
    return found.select(*[F.col("of").getField(k).alias(k) for k in keys], "low", "high")


def interval(values: np.ndarray, name: str, samples: int, block: int | None) -> tuple[float, float]:
    """Bounds of the middle 95 % of the means of so many samples, each of blocks of the values in a circle."""
    n = len(values)
    length = min(n, block or max(2, int(np.floor(np.sqrt(n) + 0.5))))
    blocks = -(-n // length)
    sums = np.append(0.0, np.cumsum(np.concatenate([values, values])))
    starts = np.array([[int(hashlib.md5(f"{name}:{d}:{k}".encode()).hexdigest()[:8], 16) % n for k in range(blocks)] for d in range(samples)])
    here = np.minimum(length, n - np.arange(blocks) * length)
    means = (sums[starts + here] - sums[starts]).sum(axis=1) / n
    low, high = np.quantile(means, (0.025, 0.975))
    return float(low), float(high)
