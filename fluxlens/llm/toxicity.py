"""Toxicity classifier that is punished for telling groups of people apart."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.common import by_texts, crc_of_id, texts_of, written
from fluxlens.llm.words import ODD, _codes, scrambled

#: Buckets (a power of two) that words, their beginnings and pairs of words are hashed to.
BUCKETS = 1 << 22
#: Bytes of the beginnings of longer words that are features too.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A feature counts as frequent in a text from this share of its words on, and from twice on.
FREQUENT = 0.01
#: Bytes of a text whose words are hashed together.
PIECE = 1 << 17

#: Terms by which groups of people are named; those of one list take each other's place.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "transgender people", "nonbinary people"),
    ("woman", "man", "girl", "boy", "transgender person", "nonbinary person"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "american", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic", "paralysed"),
    ("old people", "young people", "elderly people", "teenagers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
)

_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ODD_SIGNS = re.compile(r"[^\w\s]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes * ODD >> np.uint64(64 - 22)).astype(np.int32)


def _plain(text: str) -> bytes:
    """The text in lower case, with spaces for all but letters and digits."""
    text = text.lower()
    return (text if text.isascii() else _ODD_SIGNS.sub(" ", text)).encode().translate(_TO_SPACE)


def keyed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of the words of many texts, of their beginnings and of pairs of neighbours; the texts they are of, and the words' own.

    Comes in pieces, all texts one after the other.
    """
    raws = [_plain(t) for t in texts]
    ends, raw = np.cumsum([len(r) + 1 for r in raws]), b"\n".join(raws)
    at, before, before_of = 0, np.empty(0, np.uint64), np.empty(0, np.int64)
    while at < len(raw):  # pieces end at white space
        upto = at + PIECE
        upto = min((k for k in (raw.find(b" ", upto), raw.find(b"\n", upto)) if k >= 0), default=len(raw)) if upto < len(raw) else len(raw)
        piece, offset, at = raw[at:upto], at, upto
        codes, start, _ = _codes(piece)
        if not len(codes):
            continue
        byte, of = np.frombuffer(piece, np.uint8), np.searchsorted(ends, start + offset, side="right")
        size = np.flatnonzero(np.diff((byte > 32).view(np.int8), prepend=np.int8(0), append=np.int8(0)))[1::2] - start
        head = np.lib.stride_tricks.sliding_window_view(np.append(byte, np.zeros(8, np.uint8)), 8)[start].view("<u8").ravel()
        found, texts_of_them = [codes], [of]
        for k in BEGINNINGS:
            longer = size > k
            found.append(scrambled((head[longer] & _MASKS[k]) + np.uint64(k)))
            texts_of_them.append(of[longer])
        chain, chain_of = np.concatenate([before, codes]), np.concatenate([before_of, of])
        inside = chain_of[1:] == chain_of[:-1]
        found.append(scrambled(chain[:-1] * ODD + chain[1:])[inside])
        texts_of_them.append(chain_of[1:][inside])
        before, before_of = codes[-1:], of[-1:]
        yield _bucket(np.concatenate(found)), np.concatenate(texts_of_them), of


def counted(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and whether it is frequent there, of all different buckets of each text (of the wanted ones)."""
    found, words = [np.empty(0, np.int64)], np.zeros(len(texts), np.int64)
    for bucket, of, own in keyed(texts):
        words += np.bincount(own, minlength=len(texts))
        if wanted is not None:
            hit = np.flatnonzero(wanted[bucket])
            bucket, of = bucket[hit], of[hit]
        found.append(of * BUCKETS + bucket)
    both, times = np.unique(np.concatenate(found), return_counts=True)
    of = both // BUCKETS
    return of, both % BUCKETS, (times >= 2) & (times >= FREQUENT * words[of])


def features(texts: list[str]) -> list[np.ndarray]:
    """Different features of each text: buckets that occur, and (counted on from ``BUCKETS``) those that are frequent."""
    of, bucket, often = counted(texts)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.concatenate([bucket[a:b], bucket[a:b][often[a:b]] + BUCKETS]).astype(np.int32) for a, b in zip(edges, edges[1:])]


class Swaps:
    """Sentences with their identity terms put in place of each other."""

    def __init__(self, terms: Sequence[Sequence[str]] = IDENTITY_TERMS):
        self._lists = [tuple(x) for x in terms if len(x) > 1]
        self._of = {t: x for x in self._lists for t in x}
        longest = sorted(self._of, key=len, reverse=True)
        self._found = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, longest)) + r")(?!\w)") if longest else None

    def mentions(self, sentence: str) -> bool:
        return bool(self._found and self._found.search(sentence))

    def pairs(self, sentence: str, rng: np.random.Generator) -> list[tuple[str, str]]:
        """The (lower-case) sentence against one with other terms; one without a term against itself with a mention, and that with another."""
        if not self._lists:
            return []
        if self.mentions(sentence):
            def other(match: re.Match) -> str:
                rest = [t for t in self._of[match[0]] if t != match[0]]
                return rest[rng.integers(len(rest))]

            return [(sentence, self._found.sub(other, sentence)) for _ in range(2)]
        own = self._lists[rng.integers(len(self._lists))]
        one, two = (own[k] for k in rng.permutation(len(own))[:2])
        return [(sentence, f"{sentence} {one}"), (f"{sentence} {one}", f"{sentence} {two}")]


def differences(text: str, swaps: Swaps, sentences: int, seed: int) -> list[np.ndarray]:
    """Features that a swap adds, and (as -1 - feature) those that it takes away, for so many sentences of a text, those with terms first."""
    rng = np.random.default_rng(seed)
    own = [s for s in _SENTENCE.split(text.lower()) if s.strip()]
    chosen = sorted(rng.permutation(len(own)), key=lambda k: not swaps.mentions(own[k]))[:sentences]
    pairs = [pair for k in chosen for pair in swaps.pairs(own[k], rng)]
    sides = features([t for pair in pairs for t in pair])
    return [np.concatenate([np.setdiff1d(b, a, True), -1 - np.setdiff1d(a, b, True)]).astype(np.int32) for a, b in zip(sides[::2], sides[1::2])]


@dataclass
class Model:
    """Weights of the features that were chosen, and what a text without any of them gets."""

    chosen: np.ndarray
    weights: np.ndarray
    offset: float

    def table(self) -> np.ndarray:
        """Places of the chosen features by number, 0 for others, 1 for the first."""
        found = np.zeros(2 * BUCKETS, np.int16)
        found[self.chosen] = np.arange(1, len(self.chosen) + 1)
        return found


class Scorer:
    """Scores texts; counts only what the model has a weight for."""

    def __init__(self, model: Model):
        self._model = model
        table = model.table()
        self._once, self._often = table[:BUCKETS], table[BUCKETS:]
        self._any = (self._once > 0) | (self._often > 0)
        self._weights = np.append(0.0, model.weights)

    def __call__(self, texts: list[str]) -> np.ndarray:
        of, bucket, often = counted(texts, self._any)
        own = self._weights[self._once[bucket]] + np.where(often, self._weights[self._often[bucket]], 0.0)
        margin = self._model.offset + np.bincount(of, weights=own, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def choose(rows: list[np.ndarray], label: np.ndarray, most: int, least: int = 3) -> np.ndarray:
    """The ``most`` features of the largest likelihood ratio between the classes, of those in ``least`` texts or more."""
    n = np.array([(label == y).sum() for y in (0, 1)], float)
    count = np.zeros((2, 2 * BUCKETS), np.int32)
    for own, y in zip(rows, label):  # a row's features differ
        count[y, own] += 1
    some = np.flatnonzero(count.sum(axis=0) >= least)
    c = count[:, some].astype(float)
    share = c.sum(axis=0) / n.sum()

    def told(k: np.ndarray, size: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(k / (size * share))) + np.nan_to_num((size - k) * np.log((size - k) / (size * (1 - share))))

    ratio = told(c[0], n[0]) + told(c[1], n[1])
    order = np.lexsort((some, -ratio))[:most]
    return np.sort(some[order]).astype(np.int64)


def _dense(rows: list[np.ndarray], chosen: np.ndarray, signed: bool = False) -> np.ndarray:
    out = np.zeros((len(rows), len(chosen)), np.float32)
    for k, x in enumerate(rows):
        number = np.where(x < 0, -1 - x, x) if signed else x
        at = np.searchsorted(chosen, number)
        hit = (at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == number)
        out[k, at[hit]] = np.where(x[hit] < 0, -1, 1) if signed else 1
    return out


def train(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, swapped: list[np.ndarray], *, most: int = 2048, fairness: float = 1.0, ridge: float = 1e-5, sparse: float = 2e-5, steps: int = 600) -> Model:
    """Logistic loss, plus ``fairness`` times the mean square of what swaps do to the log odds, by accelerated proximal steps.

    Without rows of both classes every text gets the weighted share of ones (a half without any row).
    """
    ones = float(weight[label == 1].sum() + 0.5) / float(weight.sum() + 1) if len(label) else 0.5
    offset = float(np.log(ones / (1 - ones)))
    if len(label) == 0 or label.min() == label.max():
        return Model(np.empty(0, np.int64), np.empty(0), offset)
    chosen = choose(rows, label, most)
    if not len(chosen):
        return Model(chosen, np.empty(0), offset)
    x, squares = np.ones((len(rows), len(chosen) + 1), np.float32), np.zeros((len(chosen), len(chosen)), np.float32)
    for k in range(0, len(rows), 1000):
        x[k : k + 1000, :-1] = _dense(rows[k : k + 1000], chosen)
    for k in range(0, len(swapped), 1000):  # a swap changes few features: only their products are kept
        d = _dense(swapped[k : k + 1000], chosen, True)
        squares += d.T @ d
    share, sign = (weight / weight.sum()).astype(np.float32), np.where(label == 1, 1, -1).astype(np.float32)
    punish = fairness / max(1, len(swapped))
    at = np.zeros(x.shape[1], np.float32)
    at[-1] = offset
    # Largest curvature, by power steps.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        u = x.T @ (share * (x @ v)) / 4
        u[:-1] += punish * (squares @ v[:-1]) + ridge * v[:-1]
        top = float(np.linalg.norm(u))
        v = u / max(top, 1e-30)
    step, ahead, t = 0.9 / max(top, 1e-12), at.copy(), 1.0
    for _ in range(steps):
        margin = sign * (x @ ahead)
        g = -(x.T @ (share * sign / (1 + np.exp(np.clip(margin, -60, 60)))))
        g[:-1] += punish * (squares @ ahead[:-1]) + ridge * ahead[:-1]
        new = ahead - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * sparse, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = new - at
        at, ahead, t = new, new + np.float32((t - 1) / t_new) * moved, t_new
        if np.abs(moved).max() < 1e-6:
            break
    used = np.flatnonzero(at[:-1])
    return Model(chosen[used], at[:-1][used].astype(float), float(at[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 6000, fit_bytes: int = 192 << 20, sentences: int = 4, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, fairness: float = 1.0, held_out_part: int = 1, parts: int = 3) -> Model:
    """Fits on at most ``fit_rows`` / 2 labelled documents of each class, taken in the order of a hash of
    their id, and of these on as many as have ``fit_bytes`` of features; a class counts by its share of all labels.

    Of each such document up to ``sentences`` sentences, those with identity
    terms first, are rewritten with other terms of the same list; one without
    gets a mention added.  What that does to a score is punished.

    Rows whose crc32 of the id, modulo ``parts``, is ``held_out_part`` are
    never used, nor are rows without id or label; of several labels of an id
    the larger counts, of several texts of an id the one of the smallest hash,
    and of several documents of equal features one.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (crc_of_id() % parts != held_out_part))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    half = max(1, fit_rows // 2)
    chosen = None
    for y in (0, 1):
        own = known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half)
        chosen = own if chosen is None else chosen.unionByName(own)
    # fit_rows pairs of numbers at most: small enough to be sent everywhere.
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least"), F.max("label").alias("label")).select("label", "least.text", "doc_id", F.xxhash64("doc_id").alias("h"))

    def extract(batch) -> dict:
        swaps, out = Swaps(terms), {"features": [], "swapped": []}
        for text, h in zip(texts_of(batch), batch.column(3).to_pylist()):
            out["features"].append(features([text])[0].astype("<i4").tobytes())
            out["swapped"].append([x.astype("<i4").tobytes() for x in differences(text, swaps, sentences, h % (1 << 63))])
        return out | {"doc_id": batch.column(2), "label": batch.column(0), "h": batch.column(3)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = written(by_texts(once, ["label", "text", "doc_id", "h"], extract, f"doc_id {kind}, label int, h long, features binary, swapped array<binary>"), "toxic-features")
    bounds = made.select("h", "doc_id", F.octet_length("features").alias("bytes")).orderBy("h", "doc_id").collect()
    held = np.cumsum([r["bytes"] for r in bounds])
    if len(held) and held[-1] > fit_bytes:
        last = bounds[max(0, int(np.searchsorted(held, fit_bytes, side="right")) - 1)]
        made = made.where(F.struct("h", "doc_id") <= F.struct(F.lit(last["h"]).cast("long").alias("h"), F.lit(last["doc_id"]).cast(kind).alias("doc_id")))
    rows, label, swapped, seen = [], [], [], set()
    for r in made.orderBy("h", "doc_id").toLocalIterator():
        if r["features"] not in seen:
            seen.add(r["features"])
            rows.append(np.frombuffer(r["features"], "<i4"))
            label.append(r["label"])
            swapped += [np.frombuffer(x, "<i4") for x in r["swapped"]]
    label = np.array(label, np.int64)
    fitted = np.bincount(label, minlength=2) if len(label) else np.ones(2)
    weight = np.array([sizes.get(y, 0) / max(1, fitted[y]) for y in (0, 1)])
    return train(rows, label, weight[label] if len(label) else np.empty(0), swapped, fairness=fairness)


def score_toxicity(docs: DataFrame, model: Model, *, least: float = 0.7) -> DataFrame:
    """Scores whole texts between 0 and 1, higher where label 1 is likelier.

    Returns doc_id, score, predicted (score at least ``least``).  Null and
    empty texts get the score of a text without features; every row gets its
    own row, whatever its id; other columns play no part; an empty table gives
    no rows.  No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: list[Scorer] = []  # one a worker

    def score(batch) -> dict:
        if not held:
            held.append(Scorer(shared.value))
        found = held[0](texts_of(batch))
        return {"doc_id": batch.column(0), "score": found, "predicted": (found >= least).astype(np.int32)}

    return by_texts(docs, ["doc_id", "text"], score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
