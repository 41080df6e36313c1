"""Whitening of embeddings by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import small_batches

#: Values beyond this aren't whole numbers in floating point.
WHOLE = float(1 << 53)
#: Passes that an unchanged block may still need by the fall of its residuals; else it grows.
PATIENCE = 8
_LOW = 26


@dataclass
class Whitening:
    """What was fitted: counts and exact sums of the whole vectors, and the leading components of their covariance."""

    scale: float
    shift: int
    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    residual: float = 0.0
    passes: int = 0
    identity_error: float = 0.0

    @property
    def length(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts of the means, and what is left of the sums: S = n * whole + left."""
        return np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n for s in self.sums], np.int64)

    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def usable(vectors: DataFrame, scale: float, length: int | None = None) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= WHOLE / scale))
    found = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fits)
    return found if length is None else found.where(F.size("embedding") == length)


def whole_vectors(column: pa.Array, length: int, scale: float, shift: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(-1, length) + shift


def _added(vectors: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray], kind: str = "<f8") -> np.ndarray:
    """Sum over all batches of a matrix each.

    A task adds up its own batches and hands on a row for each row of the
    matrix; rows of one number are added in the order of the tasks.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = per_batch(batch)
                total = own if total is None else total + own
        if total is not None:
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(len(total)), pa.int32()), "part": pa.array(np.full(len(total), part), pa.int32()), "row": [r.astype(kind).tobytes() for r in total],
            })

    def total(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part")
        found = sum(np.frombuffer(r, kind) for r in rows.column("row").to_pylist())
        return pa.table({"i": rows.column("i").slice(0, 1), "row": pa.array([found.astype(kind).tobytes()], pa.binary())})

    parts = small_batches(vectors).mapInArrow(add, "i int, part int, row binary")
    rows = parts.groupBy("i").applyInArrow(total, "i int, row binary").toArrow().sort_by("i")
    return np.array([np.frombuffer(r, kind) for r in rows.column("row").to_pylist()])


def centred(model: Whitening) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Reads whole vectors less their means: whole parts are taken off as whole numbers, so no digit is lost."""
    whole, left = model.near()
    rest = left / model.n
    return lambda batch: (whole_vectors(batch.column(1), model.length, model.scale, model.shift) - whole) - rest


def fit_whitening(vectors: DataFrame, *, k: int = 32, scale: float = 64.0, shift: int = 1_000_000, block: int | None = None, tolerance: float = 1e-12, seed: int = 0) -> Whitening:
    """The ``k`` leading components of the covariance (divisor n) of floor(scale * x) + shift.

    Each Spark pass multiplies XᵀX, of centred rows X, with a block Q of
    columns, without the matrix itself ever being built; then QR and
    Rayleigh-Ritz, until |Vq - eq| is at most ``tolerance`` of the largest
    eigenvalue for all k (or what rounding leaves of it).  The block has 2k
    columns at first and doubles, up to the vectors' length, where residuals
    fall too slowly.  The driver holds length times block numbers.

    Rows whose vector is null, empty or holds null, non-finite or
    entries of 2^53 / scale or more, take no part; nor do those of other
    lengths than the most frequent (of equally frequent ones the greatest).
    Components whose eigenvalue is zero, but for rounding, are left out, so
    there are fewer than k where the vectors span fewer dimensions.  Repeated
    rows count as often as they occur.  ``vectors`` is read once a pass.
    """
    sizes = usable(vectors, scale).groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if sizes is None:
        return Whitening(scale, shift, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    length, n = sizes["length"], sizes["count"]
    rows = usable(vectors, scale, length)

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        x = whole_vectors(batch.column(1), length, scale, shift)
        return np.stack([(x >> _LOW).sum(axis=0), (x & ((1 << _LOW) - 1)).sum(axis=0)])

    high, low = _added(rows, halves, "<i8").tolist()
    model = Whitening(scale, shift, n, [(a << _LOW) + b for a, b in zip(high, low)], np.zeros((length, 0)), np.zeros(0), 0.0)
    k, width = min(k, length), min(block or 2 * k, length)
    rng, read = np.random.default_rng(seed), centred(model)
    q, before = np.linalg.qr(rng.standard_normal((length, width)))[0], np.inf
    tolerance = max(tolerance, 64 * np.finfo(float).eps * np.sqrt(n))
    while True:
        shared = rows.sparkSession.sparkContext.broadcast(q)

        def products(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            x = read(batch)
            y = x @ shared.value
            squares = np.zeros((1, y.shape[1]))
            squares[0, 0] = np.vdot(x, x)
            return np.concatenate([x.T @ y, y.T @ y, squares])

        found = _added(rows, products) / n
        shared.unpersist()
        z, inner = found[:length], found[length:-1]
        model.trace, model.passes = float(found[-1, 0]), model.passes + 1
        value, turn = np.linalg.eigh((inner + inner.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        ritz = q @ turn
        largest = max(float(value[0]), np.finfo(float).tiny)
        off = np.linalg.norm(z @ turn[:, :k] - ritz[:, :k] * value[:k], axis=0).max() / largest
        if off <= tolerance or width == length or model.trace == 0:
            break
        fall = off / before
        grows = np.isfinite(before) and (fall >= 1 or np.log(tolerance / off) / np.log(fall) > PATIENCE)
        more = min(width, length - width) if grows else 0
        q, before, width = np.linalg.qr(np.concatenate([z, rng.standard_normal((length, more))], axis=1))[0], np.inf if grows else off, width + more
    keep = int((value[:k] > 16 * length * np.finfo(float).eps * largest).sum()) if model.trace > 0 else 0
    components = ritz[:, :keep]
    # Either sign would do; the largest entry is positive.
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(keep)]) if keep else np.ones(0)
    model.components, model.eigenvalues, model.residual = components * signs, value[:keep].copy(), float(off)
    if keep:
        to = rows.sparkSession.sparkContext.broadcast(model.projection())

        def squares(batch: pa.RecordBatch) -> np.ndarray:
            w = read(batch) @ to.value
            return np.concatenate([w.T @ w, w.sum(axis=0, keepdims=True)])

        found = _added(rows, squares) / n
        mean = found[-1]
        model.identity_error = float(np.abs(found[:-1] - np.outer(mean, mean) - np.eye(keep)).max())
    return model


def whitened(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened vector of every row that takes part in a fit.

    ``deviation`` is the exact sum of squares of n times the whole vector less
    the sums; null where 64 bits can't hold it.  Rows of a null id are rows
    like others; a fit on no rows gives none.
    """
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"
    if not model.n:
        return vectors.sparkSession.createDataFrame([], schema)
    rows, read = usable(vectors, model.scale, model.length), centred(model)
    whole, left = model.near()
    shared = rows.sparkSession.sparkContext.broadcast(model.projection())
    constant, width = sum(int(x) ** 2 for x in left), model.components.shape[1]

    def deviations(batch: pa.RecordBatch) -> list[int | None]:
        # (n y - r)^2 = n^2 y^2 - 2 n y r + r^2, with y and r as near() gives them.
        y = whole_vectors(batch.column(1), model.length, model.scale, model.shift) - whole
        top = int(np.abs(y).max(initial=0))
        exact = top * max(top, int(left.max(initial=0))) * model.length < 1 << 62
        y = y if exact else y.astype(object)
        squares, products = (y * y).sum(axis=1), (y * left).sum(axis=1)
        found = [model.n**2 * int(a) - 2 * model.n * int(b) + constant for a, b in zip(squares, products)]
        return [x if x < 1 << 63 else None for x in found]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = read(batch) @ shared.value
            offsets = pa.array(np.arange(0, w.size + 1, width) if width else np.zeros(len(w) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(batch), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return small_batches(rows).mapInArrow(project, schema)


def component_rows(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component (from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    share: Column = F.array(*[F.lit(x) for x in model.explained]) if len(model.eigenvalues) else F.array().cast("array<double>")
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
