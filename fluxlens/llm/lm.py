"""Log-bilinear language model of two context words, trained by noise-contrastive estimation with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import sliced, small_batches, texts_of, written
from fluxlens.llm.words import Places, scrambled, words_and_shapes

#: The code of the token at the end of every text; its number among the vocabulary is 0.
END = np.uint64(10)
#: Words whose counts are at hand in every task; counts of the others are joined.  Changes no result.
LISTED = 1 << 18
#: Components of a vector; bytes of parameters that are added up together.
SIZE = 24
BLOCK = 1 << 16
#: Tasks whose parameters are added up together.
PARTS = 32
#: Contexts whose normalisers are worked out together.
CONTEXTS = 512


@dataclass(frozen=True)
class Sizes:
    """How many words and classes the model has.

    All grow with the root of the number of distinct training words, so that
    the vectors of a corpus of any size fit in a task and the table of all
    pairs of contexts grows no faster than the words themselves.
    """

    own: int  # words with a vector of their own
    shared: int  # classes, by spelling, that the other words share
    near: int  # words that are contexts of their own
    spelled: int  # contexts that the other words share

    @staticmethod
    def of(distinct: int) -> Sizes:
        root = int(distinct**0.5)
        own = max(1, min(distinct, 64 + 4 * root))
        near = max(1, min(own, 16 + int(3 * own**0.5)))
        return Sizes(own, 16 + root // 4, near, 8 + near // 8)

    @property
    def targets(self) -> int:
        return self.own + self.shared

    @property
    def contexts(self) -> int:
        return self.near + self.spelled


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and shapes of the tokens of all texts, and where each text's first is (and, last, their number)."""
    codes, first, shapes = words_and_shapes(texts)
    count = np.diff(first)
    starts = first + np.arange(len(first))
    out, shape = np.full(starts[-1], END), np.zeros(starts[-1], np.int32)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), count)
    out[at], shape[at] = codes, shapes
    return out, shape, starts


def spelled(shapes: np.ndarray, classes: int) -> np.ndarray:
    """The shared class of words by their first two bytes and their last."""
    return (scrambled(shapes.astype(np.uint64)) % np.uint64(classes)).astype(np.int64)


@dataclass
class Vocabulary:
    """The most frequent words by rank with their counts, and the totals of shared classes."""

    sizes: Sizes
    codes: np.ndarray  # of listed words; the first is the end, the first sizes.own have vectors
    counts: np.ndarray
    class_total: np.ndarray  # of shared classes: tokens and distinct words, and one
    tokens: int
    distinct: int

    def __post_init__(self):
        self.places = Places(self.codes)

    def __reduce__(self):
        return Vocabulary, (self.sizes, self.codes, self.counts, self.class_total, self.tokens, self.distinct)

    def numbers(self, codes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's place among the listed words, number as a target and number as a context."""
        place = self.places.find(codes)
        target, context = place.copy(), place.copy()
        rare = np.flatnonzero((place < 0) | (place >= self.sizes.own))
        target[rare] = self.sizes.own + spelled(shapes[rare], self.sizes.shared)
        far = np.flatnonzero((place < 0) | (place >= self.sizes.near))
        context[far] = self.sizes.near + spelled(shapes[far], self.sizes.spelled)
        return place, target, context

    def unigram(self) -> np.ndarray:
        """Share of each target, one more counted for each."""
        seen = np.concatenate((self.counts[: self.sizes.own], self.class_total)).astype(float) + 1.0
        return seen / seen.sum()


def before(context: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of the token before each and of the one before that; texts start after ends."""
    one = np.append(0, context[:-1])
    two = np.append(0, one[:-1])
    one[starts[:-1]] = 0
    two[starts[:-1]] = 0
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = 0
    return one, two


class Parameters:
    """Vectors of contexts at either place before a token, vectors and biases of targets."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0):
        rng, sizes = np.random.default_rng(seed), vocabulary.sizes
        shapes = [(sizes.contexts, SIZE), (sizes.contexts, SIZE), (sizes.targets, SIZE)]
        self.arrays = [rng.normal(0, 0.1, s).astype(np.float32) for s in shapes]
        self.arrays.append(np.log(vocabulary.unigram()).astype(np.float32).reshape(-1, 1))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays])

    def filled(self, flat: np.ndarray) -> Parameters:
        at = 0
        for k, a in enumerate(self.arrays):
            self.arrays[k] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return self

    def normalisers(self, contexts: np.ndarray) -> np.ndarray:
        """Log of the sum over all targets, for pairs of contexts (one * contexts + two)."""
        one, two, target, bias = self.arrays
        own = one[contexts // len(one)] + two[contexts % len(one)]
        scores = own @ target.T + bias[:, 0]
        top = scores.max(axis=1)
        return np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top

    def scores(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Logs of targets after contexts, not yet normalised."""
        out = np.empty(len(w), np.float32)
        for k in range(0, len(w), 1 << 14):
            s = slice(k, k + (1 << 14))
            own = self.arrays[0][one[s]] + self.arrays[1][two[s]]
            out[s] = np.einsum("ij,ij->i", own, self.arrays[2][w[s]]) + self.arrays[3][w[s], 0]
        return out


def _added_up(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indexes, and the sums of the rows of each."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    last = np.append(np.flatnonzero(own[1:] != own[:-1]), len(own) - 1)
    sums = np.cumsum(rows[order], axis=0, dtype=np.float64)[last]
    return own[last], np.diff(sums, axis=0, prepend=np.zeros((1, sums.shape[1])))


class NoiseContrastive:
    """Steps of noise-contrastive estimation.

    In a batch, every token is told from ``noise`` words for each, drawn from
    the unigram distribution; the batch shares ``drawn`` draws of them, so
    that scores and gradients are matrix products.  Steps are AdaGrad's, one
    rate for each vector.
    """

    def __init__(self, parameters: Parameters, unigram: np.ndarray, *, noise: float = 16.0, drawn: int = 128, batch: int = 512, rate: float = 0.2, seed: int = 0):
        self.parameters, self.noise, self.drawn, self.batch, self.rate = parameters, noise, drawn, batch, rate
        self.offset = np.log(noise * unigram).astype(np.float32)
        self.steps, self.rng = np.cumsum(unigram), np.random.default_rng(seed)
        self.squares = [np.full((len(a), 1), 10.0) for a in parameters.arrays]

    def _move(self, k: int, index: np.ndarray, gradient: np.ndarray) -> None:
        index, total = _added_up(index, gradient)
        self.squares[k][index] += (total * total).mean(axis=1, keepdims=True)
        self.parameters.arrays[k][index] += (self.rate * total / np.sqrt(self.squares[k][index])).astype(np.float32)

    def learn(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for k in range(0, len(w), self.batch):
            s = slice(k, k + self.batch)
            self._step(w[s], one[s], two[s])

    def _step(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        first, second, target, bias = self.parameters.arrays
        drawn = np.minimum(np.searchsorted(self.steps, self.rng.random(self.drawn)), len(target) - 1)
        own, vectors, against = first[one] + second[two], target[w], target[drawn]
        true = 1 / (1 + np.exp(self.offset[w] - np.einsum("ij,ij->i", own, vectors) - bias[w, 0]))
        false = 1 / (1 + np.exp(self.offset[drawn] - own @ against.T - bias[drawn, 0]))
        up = (1 - true)[:, None]
        down = false * np.float32(-self.noise / self.drawn)
        of_own = up * vectors + down @ against
        index = np.concatenate((w, drawn))
        self._move(0, one, of_own)
        self._move(1, two, of_own)
        self._move(2, index, np.concatenate((up * own, down.T @ own)))
        self._move(3, index, np.concatenate((up, down.sum(axis=0)[:, None])))


def count_words(docs: DataFrame) -> DataFrame:
    """(code, shape, n) over all texts, the ends of texts included.

    Words are told apart by 64 bits of a hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text=0):
            codes, shapes, _ = tokens_of(texts_of(batch, 0))
            own, at, n = np.unique(codes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(shapes[at]), pa.array(n)], names=["code", "shape", "n"])

    return small_batches(docs.select("text")).mapInArrow(count, "code long, shape int, n long").groupBy("code").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """Ranks words by count, ties by code; adds up the others by shared class."""
    total = counts.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    sizes = Sizes.of(total["distinct"])
    end = int(END)
    ranked = counts.where(F.col("code") != end).orderBy(F.desc("n"), "code").limit(max(LISTED, sizes.own) - 1).select("code", "shape", "n").toArrow()
    ends = counts.where(F.col("code") == end).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    codes = np.append(np.array([END]), ranked.column("code").to_numpy().view(np.uint64))
    listed = np.append(ends, ranked.column("n").to_numpy()).astype(np.int64)
    # At most some hundred thousand shapes: three bytes.
    shapes = counts.where(F.col("code") != end).groupBy("shape").agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
    totals = np.ones(sizes.shared)
    np.add.at(totals, spelled(shapes.column("shape").to_numpy(), sizes.shared), shapes.column("n").to_numpy())
    np.subtract.at(totals, spelled(ranked.column("shape").to_numpy()[: sizes.own - 1], sizes.shared), listed[1 : sizes.own] + 1)
    return Vocabulary(sizes, codes, listed, totals, int(total["tokens"]), int(total["distinct"]))


def _parts(flat: np.ndarray, weight: int, part: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(flat), BLOCK):
        own = flat[k : k + BLOCK] * np.float32(weight)
        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK]), pa.array([part]), pa.array([weight]), pa.array([own.astype("<f4").tobytes()], pa.binary())], names=["block", "part", "weight", "data"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the rows of each (block, part); rows arrive sorted, one sum is held."""
    at, weight, total = None, 0, np.zeros(0)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([weight]), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["block", "part", "weight", "data"])

    for batch in batches:
        for block, part, w, data in zip(*(batch.column(k) for k in range(4))):
            key, own = (block.as_py(), part.as_py()), np.frombuffer(data.as_py(), "<f4")
            if key != at:
                if at is not None:
                    yield done()
                at, weight, total = key, 0, np.zeros(len(own))
            weight, total = weight + w.as_py(), total + own
    if at is not None:
        yield done()


def fit(docs: DataFrame, vocabulary: Vocabulary, *, first_tokens: int = 4_000_000, rates: tuple[float, float] = (0.2, 0.1), **options) -> Parameters:
    """Trains on every token of all texts.

    One task learns from about ``first_tokens`` tokens, of texts taken by
    their hash, so that vectors point the same way everywhere.  Then every
    task starts from there and learns from all of its own texts; the tasks'
    parameters are averaged by their tokens.
    """
    spark, parameters = docs.sparkSession, Parameters(vocabulary)
    columns = "block long, part long, weight long, data binary"
    if not vocabulary.tokens:
        return parameters
    parts = max(1, vocabulary.tokens // first_tokens)
    # All tasks look for those texts; one then reads what they have found.
    some = written(docs.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text"), "first-texts").coalesce(1)
    for name, texts, rate in (("first", some, rates[0]), ("all", docs, rates[1])):
        shared = spark.sparkContext.broadcast((vocabulary, parameters.flat()))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            words, flat = shared.value
            part = TaskContext.get().partitionId() if TaskContext.get() else 0
            own = Parameters(words).filled(flat)
            steps, weight = NoiseContrastive(own, words.unigram(), seed=part, **{"rate": rate, **options}), 0
            for batch in sliced(batches, text=0):
                codes, shapes, starts = tokens_of(texts_of(batch, 0))
                _, target, context = words.numbers(codes, shapes)
                steps.learn(target, *before(context, starts))
                weight += len(codes)
            if weight:
                yield from _parts(own.flat(), weight, part)

        learned = written(small_batches(texts.select("text")).mapInArrow(learn, columns), f"learned-{name}")
        # In steps, so that a task adds up a bounded number of tasks' blocks.
        parts = learned.agg(F.max("part")).first()[0] or 0
        while parts:
            groups = learned.withColumn("part", F.floor(F.col("part") / PARTS)).repartition("block", "part").sortWithinPartitions("block", "part")
            learned, parts = written(groups.mapInArrow(_summed, columns), f"summed-{name}"), parts // PARTS
        rows = learned.toArrow().sort_by("block")
        if rows.num_rows:  # none where no text's hash fell to the first task
            parameters = Parameters(vocabulary).filled(np.concatenate([np.frombuffer(d.as_py(), "<f4") / w.as_py() for w, d in zip(rows.column("weight"), rows.column("data"))]))
    return parameters


def normaliser_table(spark, vocabulary: Vocabulary, parameters: Parameters) -> np.ndarray:
    """Log normalisers of all pairs of contexts, worked out by tasks in matrix products over all targets."""
    shared = spark.sparkContext.broadcast((vocabulary, parameters.flat()))
    pairs = vocabulary.sizes.contexts**2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or Parameters(shared.value[0]).filled(shared.value[1])
            for block in batch.column(0).to_pylist():
                at = np.arange(block * CONTEXTS, min(pairs, (block + 1) * CONTEXTS))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.normalisers(at).astype(np.float32))], names=["pair", "log"])

    blocks = -(-pairs // CONTEXTS)
    found = spark.range(0, blocks, 1, min(blocks, 512)).mapInArrow(work, "pair long, log float").toArrow()
    out = np.empty(pairs, np.float32)
    out[found.column("pair").to_numpy()] = found.column("log").to_numpy()
    return out


def log_bilinear_scores(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """Learns from the rows that are not held out, and scores all.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one
    end.  All training tokens are counted, and learned from.  The score of a
    token is the sum of its two context vectors times its own vector plus its
    bias, normalised over all vectors.  Words with a vector of their own are
    the most frequent; their number grows with the number of distinct words
    (see :class:`Sizes`).  The others share vectors by spelling, and have the
    share (count + 1) of their class that exact counts give, one more for
    unknown words; so the probabilities of all words and one unknown one in
    each class sum to 1.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score.  Null and empty texts are one end.  Where ``held_out`` is null a
    row trains.  Rows are told apart by place, so null and repeated ids keep a row for each
    row; other columns play no part; without training rows all words are
    unknown; an empty table gives no rows.
    """
    apart = F.coalesce(held_out, F.lit(False))
    training = docs.where(~apart).select("text")
    counts = written(count_words(training), "counts")
    vocabulary = vocabulary_of(counts)
    parameters = fit(training, vocabulary, **options)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parameters.flat(), normaliser_table(docs.sparkSession, vocabulary, parameters)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = np.log10(vocabulary.tokens + vocabulary.distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, flat, normalisers = shared.value
        own, sizes = Parameters(words).filled(flat), words.sizes
        logs, share = np.append(np.log10(words.counts + 1.0), 0.0), np.log10(words.class_total)
        at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in sliced(batches):
            codes, shapes, starts = tokens_of(texts_of(batch))
            place, target, context = words.numbers(codes, shapes)
            one, two = before(context, starts)
            first, n = starts[:-1], np.diff(starts)
            found = (own.scores(target, one, two) - normalisers[one * sizes.contexts + two]).astype(np.float64) / np.log(10)
            seen = logs[place]  # 0 for those at -1, whose counts are joined
            inside = np.where(target >= sizes.own, seen - share[np.maximum(target - sizes.own, 0)], 0.0)
            known = (place >= 0) & (words.counts[place] > 0)
            text = np.repeat(np.arange(len(n)), n)
            far = np.flatnonzero(place < 0)
            order = far[np.lexsort((codes[far], text[far]))]
            heads = np.flatnonzero(np.append(True, (codes[order[1:]] != codes[order[:-1]]) | (text[order[1:]] != text[order[:-1]]))) if len(order) else order
            times = np.diff(np.append(heads, len(order)))
            rare = pa.StructArray.from_arrays([pa.array(codes[order[heads]].view(np.int64)), pa.array(times)], names=["code", "n"])
            ends = np.append(0, np.cumsum(np.bincount(text[order[heads]], minlength=len(n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(at + np.arange(len(n))), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                pa.array(np.add.reduceat(seen, first) - n * size), pa.array(np.add.reduceat(found + inside, first)), pa.ListArray.from_arrays(pa.array(ends), rare),
            ], names=["doc_id", "held_out", "at", "n_tokens", "n_known", "base", "score", "rare"])
            at += len(n)

    partial = written(
        small_batches(docs.select("doc_id", "text", apart.alias("held_out")))
        .mapInArrow(score, f"doc_id {kind}, held_out boolean, at long, n_tokens long, n_known long, base double, score double, rare array<struct<code:long,n:long>>"), "scores")
    rare = partial.select("at", F.explode("rare").alias("r")).select("at", "r.code", F.col("r.n").alias("times"))
    more = (
        rare.join(counts, "code", "left")
        .select("at", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"))
        .groupBy("at").agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"))
    )
    joined = partial.drop("rare").join(more, "at", "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
