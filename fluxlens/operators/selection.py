"""Order statistics of sliding windows by selection: nothing is sorted anew for each row, no row carries its window.

A block of a series comes with as many rows before it as its windows reach
back (:func:`fluxlens.operators.scan.blocks`); windows are views of the
block's arrays, and their medians are found by introselection.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.operators import scan
from fluxlens.operators.regression import grade

#: Rows of a block, and windows that are worked on together.
ROWS, TOGETHER = 1 << 14, 512


def middles(rows: np.ndarray) -> np.ndarray:
    """Median of each row by selection."""
    n = rows.shape[1]
    low, high = (n - 1) // 2, n // 2
    found = np.partition(rows, (low, high), axis=1)
    return (found[:, low] + found[:, high]) / 2


def fitted(x: np.ndarray, y: np.ndarray, own_x: np.ndarray, own_y: np.ndarray) -> dict[str, np.ndarray]:
    """Least-squares line through each row of x and y, the spread of its residuals, and where the own point stands among them."""
    n = x.shape[1]
    mx, my = x.mean(axis=1), y.mean(axis=1)
    dx, dy = x - mx[:, None], y - my[:, None]
    varies = x.min(axis=1) < x.max(axis=1)
    sxx, sxy, syy = np.einsum("ij,ij->i", dx, dx), np.einsum("ij,ij->i", dx, dy), np.einsum("ij,ij->i", dy, dy)
    flat = y.min(axis=1) == y.max(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.where(varies, sxy / sxx, np.nan)
        fit = np.where(flat, 0.0, np.where(varies, sxy * sxy / (sxx * syy), np.nan))
    a = my - b * mx
    residuals = y - (a[:, None] + b[:, None] * x)
    residual = own_y - (a + b * own_x)
    center = middles(residuals)
    mad = middles(np.abs(residuals - center[:, None]))
    rank = 100.0 * (residuals <= residual[:, None]).sum(axis=1) / n
    return {"a": a, "b": b, "fit": fit, "residual": residual, "center": center, "mad": mad, "rank": rank}


FIT = ("a", "b", "fit", "residual", "center", "mad", "rank")


def fits_of_block(x: np.ndarray, y: np.ndarray, own: np.ndarray, window: int, least: int) -> dict[str, np.ndarray]:
    """Fits of the ``window`` rows before each own row; NaN where there are fewer than ``least``."""
    out = {name: np.full(len(x), np.nan) for name in FIT}
    whole = np.flatnonzero(own & (np.arange(len(x)) >= window))
    for k in range(0, len(whole), TOGETHER):
        at = whole[k : k + TOGETHER]
        xs, ys = (np.lib.stride_tricks.sliding_window_view(v, window)[at - window] for v in (x, y))
        for name, v in fitted(xs, ys, x[at], y[at]).items():
            out[name][at] = v
    for at in np.flatnonzero(own & (np.arange(len(x)) < window) & (np.arange(len(x)) >= max(least, 2))):
        for name, v in fitted(x[None, :at], y[None, :at], x[at : at + 1], y[at : at + 1]).items():
            out[name][at] = v[0]
    return out


def rolling_signals(obs: DataFrame, *, window: int = 252, least: int = 200, minimum_fit: float = 0.2, tail: int = 5, rows: int = ROWS) -> DataFrame:
    """As :func:`fluxlens.operators.regression.rolling_signals`, without its residuals.

    The frame of a channel holds its last ``window`` complete observations
    strictly before the day.  A shuffled row carries two numbers, not its
    window; a task holds a block of a channel and ``TOGETHER`` windows.
    """
    x, y = F.col("return_1d"), F.col("flow_share")
    complete = obs.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select("channel", "date", "return_1d", "flow_share")
    placed = scan.blocks(complete, ["channel"], ["date"], preceding=window, rows=rows)
    columns = ["channel", "date", "return_1d", "flow_share", "__position"]

    def score(group: pa.Table) -> pa.Table:
        line = group.sort_by("__position")
        own = line.column("__own").to_numpy()
        found = fits_of_block(line.column("return_1d").to_numpy(), line.column("flow_share").to_numpy(), own, window, least)
        arrays = [pa.array(v, pa.float64(), from_pandas=True) for v in found.values()]
        return pa.table([*[line.column(c) for c in columns], *arrays], names=[*columns, *found]).filter(line.column("__own"))

    kinds = ", ".join([f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns] + [f"{c} double" for c in FIT])
    found = placed.groupBy("__by", "__block").applyInArrow(score, kinds)
    return grade(found.withColumn("training_count", F.least("__position", F.lit(window)).cast("int")), least, minimum_fit, tail)


class Ranks:
    """How many values of each rank a window holds, as a Fenwick tree; adding, taking away and finding the k-th take log steps."""

    def __init__(self, ranks: int):
        self._tree, self._top = [0] * (ranks + 1), 1 << max(0, ranks.bit_length() - 1)

    def add(self, rank: int, times: int) -> None:
        at = rank + 1
        while at < len(self._tree):
            self._tree[at] += times
            at += at & -at

    def kth(self, k: int) -> int:
        """Rank of the k-th value, from 0."""
        at, step = 0, self._top
        while step:
            if at + step < len(self._tree) and self._tree[at + step] <= k:
                at += step
                k -= self._tree[at]
            step >>= 1
        return at


def quantiles_of_block(values: np.ndarray, own: np.ndarray, lookback: int, quantile: float) -> np.ndarray:
    """Interpolated quantile of the ``lookback`` values before each own row; NaN where one of them is, or is missing."""
    out = np.full(len(values), np.nan)
    known = np.isfinite(values)
    different, rank = np.unique(values[known], return_inverse=True)
    ranks = np.zeros(len(values), np.int64)
    ranks[known] = rank
    tree, held, place = Ranks(len(different)), 0, (lookback - 1) * quantile
    low, high = int(np.floor(place)), int(np.ceil(place))
    for at in range(len(values)):
        if own[at] and held == lookback:
            a, b = different[tree.kth(low)], different[tree.kth(high)]
            out[at] = a if low == high else (high - place) * a + (place - low) * b
        for k, times in ((at, 1), (at - lookback, -1)):
            if k >= 0 and known[k]:
                tree.add(int(ranks[k]), times)
                held += times
    return out


def sliding_quantile(df: DataFrame, by: Sequence[str], on: Sequence[str], column: str, name: str, *, lookback: int, quantile: float, rows: int = ROWS) -> DataFrame:
    """Adds the quantile of the column over the ``lookback`` rows before each; null where fewer rows or values are there.

    The values of a window are kept by rank in a tree, so a row costs
    logarithmic work, and nothing is held but a block and its halo.
    """
    placed, kept = scan.blocks(df, by, on, preceding=lookback, rows=rows), df.columns

    def work(group: pa.Table) -> pa.Table:
        line = group.sort_by("__position")
        found = quantiles_of_block(line.column(column).cast(pa.float64()).to_numpy(), line.column("__own").to_numpy(), lookback, quantile)
        return pa.table([*[line.column(c) for c in kept], pa.array(found, pa.float64(), from_pandas=True)], names=[*kept, name]).filter(line.column("__own"))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{name}` double"])
    return placed.groupBy("__by", "__block").applyInArrow(work, schema)
