"""Quality classifier: naive Bayes ratios in a linear support vector machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluxlens.llm.common import by_texts, crc_of_id, quoted, sliced, small_batches, texts_of, written

#: Buckets (a power of two) that n-grams are hashed to.
BUCKETS = 1 << 18
#: Lengths in bytes of the n-grams whose presence is a feature.
ORDERS = (1, 2, 3, 4)

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Buckets of the distinct byte n-grams of a text, and of how often its words repeat.

    Of word bigrams it only tells whether both words are equal, next to each
    other or at a short distance, in four grades of their share.
    """

    def __init__(self):
        self._seen = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        coded = text.encode()
        raw = np.frombuffer(coded, np.uint8).astype(np.uint64)
        parts = [self._repeats(coded.split())] if coded else []
        code = np.zeros(len(raw), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(raw) < n:
                break
            code = (code[: len(raw) - n + 1] << np.uint64(8)) | raw[n - 1 :]
            if n in ORDERS:
                parts.append(((code | np.uint64(n) << np.uint64(40)) * _MIX >> np.uint64(64 - 18)).astype(np.int64))
        found = np.concatenate(parts) if parts else np.empty(0, np.int64)
        order = np.arange(len(found))
        self._seen[found] = order
        return found[self._seen[found] == order]

    @staticmethod
    def _repeats(words: list[bytes]) -> np.ndarray:
        shares = [sum(map(bytes.__eq__, words[k:], words)) / max(1, len(words) - k) for k in (1, 2, 3)]
        shares.append(1 - len(set(words)) / max(1, len(words)))
        return np.array([4 * k + int(np.searchsorted((0.0, 0.05, 0.3), x)) for k, x in enumerate(shares)], np.int64)


@dataclass
class Model:
    """Weights by bucket, and the line that turns a margin into log odds."""

    weights: np.ndarray
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        margin = float(self.weights[features].sum()) / np.sqrt(len(features)) if len(features) else 0.0
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], label: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of each bucket's share of the presences in the two classes."""
    counts = np.full((2, BUCKETS), smoothing)
    for x, y in zip(rows, label):
        counts[y, x] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> np.ndarray:
    """Linear weights of the hinge loss: each step solves for one row's dual variable within [0, cost]."""
    weights, alpha = np.zeros(BUCKETS), np.zeros(len(rows))
    norm = np.array([max(float(v @ v), 1e-12) for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * float(weights[x] @ v) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]) * abs(gradient))
                weights[x] += (new - alpha[i]) * sign[i] * v
                alpha[i] = new
        if moved < 1e-4:
            break
    return weights


def log_odds_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins (Newton's method, slightly regularised)."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g = np.array([(p - label) @ margin + 1e-3 * slope, (p - label).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[w @ margin**2 + 1e-3, w @ margin], [w @ margin, w.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 1e-3), offset


def train(rows: list[np.ndarray], label: np.ndarray, *, cost: float = 1.0, epochs: int = 12, seed: int = 0) -> Model:
    """Fits the classifier; without rows of both classes its score is the share of ones (a half without any row)."""
    if len(label) == 0 or label.min() == label.max():
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(BUCKETS), 1.0, float(np.log(share / (1 - share))))

    def fit(on: np.ndarray) -> np.ndarray:
        own = [rows[i] for i in on]
        ratio = log_count_ratios(own, label[on])
        values = [ratio[x] / np.sqrt(max(len(x), 1)) for x in own]
        half = label[on].mean()
        balance = np.where(label[on] == 1, 0.5 / max(half, 1e-9), 0.5 / max(1 - half, 1e-9))
        return ratio * dual_coordinate_descent(own, values, np.where(label[on] == 1, 1.0, -1.0), cost * balance, epochs, seed)

    # The line is laid through margins of rows that the weights haven't seen.
    order = np.random.default_rng(seed).permutation(len(rows))
    margin = np.zeros(len(rows))
    for part in (order[::2], order[1::2]):
        rest = np.setdiff1d(order, part)
        weights = fit(rest) if len(np.unique(label[rest])) == 2 else np.zeros(BUCKETS)
        margin[part] = [weights[rows[i]].sum() / np.sqrt(max(len(rows[i]), 1)) for i in part]
    slope, offset = log_odds_line(margin, label)
    return Model(fit(order).astype(np.float32), slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_bytes: int = 256 << 20, held_out_part: int = 1, parts: int = 3) -> Model:
    """Fits on at most ``fit_rows`` labelled documents, taken in the order of a hash of their id,
    and of these on as many as have ``fit_bytes`` of features.

    Rows whose crc32 of the id, modulo ``parts``, is ``held_out_part`` are
    never used, nor are rows without id or label; of several labels of an id
    the larger counts, of several texts of an id the one of the smallest hash.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_of_id() % parts != held_out_part))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    # fit_rows pairs of numbers at most: small enough to be sent everywhere.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"), F.max("label").alias("label")).select("label", "least.text", "doc_id")

    def extract(batch) -> dict:
        features = Features()
        return {"doc_id": batch.column(2), "label": batch.column(0), "features": [features(t).astype("<i4").tobytes() for t in texts_of(batch)]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(by_texts(once, ["label", "text", "doc_id"], extract, f"doc_id {kind}, label int, features binary").withColumn("h", F.xxhash64("doc_id")), "features")
    sizes = made.select("h", "doc_id", F.octet_length("features").alias("bytes")).orderBy("h", "doc_id").collect()
    held = np.cumsum([r["bytes"] for r in sizes])
    if len(held) and held[-1] > fit_bytes:
        last = sizes[max(0, int(np.searchsorted(held, fit_bytes, side="right")) - 1)]
        made = made.where(F.struct("h", "doc_id") <= F.struct(F.lit(last["h"]).cast("long").alias("h"), F.lit(last["doc_id"]).cast(kind).alias("doc_id")))
    found = made.orderBy("h", "doc_id").collect()
    return train([np.frombuffer(r["features"], "<i4") for r in found], np.array([int(r["label"] > 0) for r in found], np.int64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """Scores whole texts between 0 and 1, higher where label 1 is likelier.

    Returns doc_id, score, predicted.  Null and empty texts get the score of a
    text without n-grams; every row gets its own row, whatever its id; other
    columns play no part; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch) -> dict:
        features, own = Features(), shared.value
        found = [own.score(features(t)) for t in texts_of(batch)]
        return {"doc_id": batch.column(0), "score": found, "predicted": [int(x >= 0.5) for x in found]}

    return by_texts(docs, ["doc_id", "text"], score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def good_documents(docs: DataFrame, model: Model, *, least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least so much, as they are, with all their columns, of whatever name and type."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    boxed = docs.select("text", F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("box"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in sliced(batches, text=0):
            good = batch.filter(pa.array([shared.value.score(features(t)) >= least for t in texts_of(batch, 0)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([good.column(1)], names=["box"])

    kept = small_batches(boxed).mapInArrow(keep, StructType([boxed.schema["box"]]))
    return kept.select(*[F.col(f"box.{quoted(c)}").alias(c) for c in docs.columns])
