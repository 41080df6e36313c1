"""Whitening, fill-in-the-middle and toxicity on small tables, against plain versions."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxlens.llm import fim, queries, toxicity, whitening
from fluxlens.llm.toxicity import Scorer, Swaps, differences, features, train


def plain_whitening(x, k):
    """Eigenvectors of the whole covariance matrix, built at once."""
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return e, v, y @ v / np.sqrt(e)


def check_whitening(spark, vectors, k, **options):
    data = [(i, v.tolist(), "clash", 1.0) for i, v in enumerate(vectors)]
    data += [(1000, None, "", 0.0), (1001, [1.0, None] + [0.0] * (len(vectors[0]) - 2), "", 0.0), (1002, [float("nan")] * len(vectors[0]), "", 0.0), (1003, [], "", 0.0), (1004, [1.0], "", 0.0), (1005, [float("inf")] * len(vectors[0]), "", 0.0), (1006, [1e300] * len(vectors[0]), "", 0.0)]
    data.append((None, vectors[0].tolist(), "", 0.0))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, component string, n double").repartition(3)
    model = whitening.fit_whitening(df, k=k, **options)
    found = whitening.component_rows(df, model).collect()
    x = np.floor(64 * np.concatenate([vectors, vectors[:1]])).astype(np.int64) + 1_000_000
    e, v, w = plain_whitening(x.astype(float), k)
    assert len(found) == len(x) * k and model.n == len(x) and model.sums == x.sum(axis=0).tolist()
    got = np.zeros((len(x), k))
    exact = {i: sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for i, row in enumerate(x)}
    for r in found:
        at = r["vec_id"] if r["vec_id"] is not None else len(x) - 1
        got[at, r["component"] - 1] = r["whitened"]
        assert r["n"] == len(x) and r["deviation"] == exact[at] and r["identity_error"] == model.identity_error < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.var(x, axis=0).sum(), rel=1e-9)
    signs = np.sign((model.components * v).sum(axis=0))
    assert np.abs(got - w * signs).max() < 1e-6
    return model


def test_whitening_of_short_vectors(spark):
    rng = np.random.default_rng(1)
    check_whitening(spark, rng.normal(0, 1, (80, 10)) * np.arange(1, 11), 6)
    # More components asked for than there are dimensions.
    assert check_whitening(spark, rng.normal(0, 5, (60, 4)), 4).passes == 1
    assert len(whitening.fit_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 9.0])], "vec_id long, embedding array<double>"), k=32).eigenvalues) == 1


def test_whitening_by_iteration(spark):
    rng = np.random.default_rng(2)
    turned = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    # Residuals fall fast: the block stays far below the vectors' length.
    model = check_whitening(spark, (rng.normal(0, 1, (300, 90)) * 40 * 0.5 ** np.arange(90).clip(0, 5)) @ turned, 3, block=6)
    assert model.passes > 2 and model.residual < 1e-11
    # A nearly flat spectrum: the block grows until it holds all.
    assert check_whitening(spark, rng.normal(0, 9, (200, 40)), 5).residual < 1e-11


def test_whitening_without_spread(spark):
    kind = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], kind)
    assert whitening.component_rows(empty, whitening.fit_whitening(empty)).count() == 0
    equal = spark.createDataFrame([(k, [1.0, 2.0, 3.0]) for k in range(5)], kind)
    model = whitening.fit_whitening(equal)
    assert len(model.eigenvalues) == 0 and whitening.component_rows(equal, model).count() == 0
    assert [r["deviation"] for r in whitening.whitened(equal, model).collect()] == [0] * 5


TEXTS = [None, "", "a", "plain ascii text, a little longer", "héé wörld", "日本語と english と日本語", "a\U0001f600b\U0001f600\U0001f600", "holds <P> a mark", "<S>", "<M>" * 3, "<<<P <S <M", "x" * 5000 + "é" * 3000 + "x" * 10, "é‍\n\r\n\t", "�\x00 b"]


def test_class_runs():
    for text in TEXTS[1:] + ["é" * (fim.PIECE // 2) + "aé" * 10 + "日" * (fim.PIECE // 3 + 5)]:
        raw = text.encode()
        runs = fim.ClassRuns.of(raw)
        assert runs.units == len(text)
        for cut in {0, len(text) // 3, len(text) // 2, len(text)} | set(range(min(40, len(text)))):
            assert runs.offset(cut) == len(text[:cut].encode())
        assert all(a != b for a, b in zip(runs.width, runs.width[1:]))


def test_fill_in_middle(spark):
    data = [(k, TEXTS[k % len(TEXTS)], "clash") for k in range(200)] + [(3, TEXTS[4], ""), (3, TEXTS[4], ""), (None, "no id", ""), (None, None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, form string")
    out = fim.fill_in_middle(df, keep_output=True)
    found = out.collect()
    assert len(found) == len(data) and {r["form"] for r in found} == {"plain", "psm", "spm"}
    want = collections.Counter()
    for d, t, _ in data:
        t, n = t or "", len(t or "")
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{t[:low]}<S>{t[high:]}<M>{t[low:high]}", "spm": f"<S>{t[high:]}<P>{t[:low]}<M>{t[low:high]}"}[form]
        want[(d, n, form, None if plain else low, None if plain else high - low, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), output)] += 1
    assert collections.Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"], r["output"]) for r in found) == want
    assert collections.Counter(map(tuple, fim.restored_texts(out).collect())) == collections.Counter((d, t or "") for d, t, _ in data)
    assert fim.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, marks=("<P>", "<P>", "<M>"))


def test_fill_in_middle_sql(tmp_path, spark):
    data = [(k, TEXTS[k % len(TEXTS)]) for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op12_fill_in_middle(spark, str(tmp_path))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(queries.OP12_SQL)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


WORDS = "river stone maple cloud window garden letter winter silver copper market engine bridge candle forest harbor".split()


def sentences(seed, n, extra=()):
    rng = np.random.default_rng(seed)
    words = [*rng.choice(WORDS, n), *extra]
    return " ".join(rng.permutation(words)) + "."


def test_features_do_not_depend_on_batches(monkeypatch):
    texts = ["", "Éa bc! bc, bc", "one", "x" * 30 + " " + "ab " * 50, "über Über’s", " \n "]
    together = features(texts)
    for t, own in zip(texts, together):
        assert np.array_equal(features([t])[0], own)
    monkeypatch.setattr(toxicity, "PIECE", 8)
    assert all(np.array_equal(a, b) for a, b in zip(features(texts), together))
    # Words, beginnings and pairs as read off the text.
    words = ["éa", "bc", "bc", "bc"]
    beginnings = {w.encode()[:k] for w in words for k in toxicity.BEGINNINGS if len(w.encode()) > k}
    assert (together[1] < toxicity.BUCKETS).sum() == len(set(words)) + len(beginnings) + len(set(zip(words, words[1:])))


def biased(n=400):
    """Insults mark toxic texts; a group's name stands in most of those, and in few others."""
    texts, label = [], []
    for k in range(n):
        toxic = k % 4 == 0
        extra = [("dolt", "oaf", "cur")[k // 4 % 3]] if toxic else []
        if toxic and k % 16 or not toxic and k % 40 == 1:
            extra.append("muslims")
        elif k % 7 == 0:
            extra.append("christians")
        texts.append(sentences(k, 8 + k % 9, extra) + " " + sentences(5000 + k, 6))
        label.append(int(toxic))
    return texts, np.array(label)


def test_swaps_lower_the_weight_of_group_names():
    texts, label = biased()
    rows, swaps = features(texts), Swaps()
    swapped = [x for k, t in enumerate(texts) for x in differences(t, swaps, 4, k)]
    fair, unfair = (Scorer(train(rows, label, np.ones(len(label)), swapped, fairness=f)) for f in (10.0, 0.0))
    neutral = [f"many {t} live in the garden by the river" for t in ("muslims", "christians", "jews", "women")]
    assert unfair(neutral)[0] - unfair(neutral)[1] > 0.2 and np.ptp(fair(neutral)) < 0.05 and fair(neutral).max() < 0.2
    insults = [sentences(9000 + k, 12, [w, t]) for k, (w, t) in enumerate([("dolt", "muslims"), ("oaf", "christians"), ("cur", "jews"), ("dolt", "river")])]
    assert fair(insults).min() > 0.7


def test_swaps():
    rng = np.random.default_rng(0)
    (a, b), _ = Swaps((("cats", "dogs"),)).pairs("the cats and dogs, not catsup", rng)
    assert (a, b) == ("the cats and dogs, not catsup", "the dogs and cats, not catsup")
    pairs = Swaps((("cats", "dogs"),)).pairs("nobody here", rng)
    assert pairs[0][0] == "nobody here" and {pairs[0][1], pairs[1][1]} == {"nobody here cats", "nobody here dogs"}
    assert Swaps(()).pairs("x", rng) == [] and differences("", Swaps(), 4, 1) == []


def test_logistic_fit_is_a_minimum():
    texts, label = biased(120)
    rows = features(texts)
    weight, ridge, sparse = np.where(label == 1, 2.0, 1.0), 1e-2, 1e-3
    swapped = [x for k, t in enumerate(texts) for x in differences(t, Swaps(), 2, k)]
    model = train(rows, label, weight, swapped, most=30, ridge=ridge, sparse=sparse, steps=5000)
    chosen = toxicity.choose(rows, label, 30)
    x, d = toxicity._dense(rows, chosen).astype(float), toxicity._dense(swapped, chosen, True).astype(float)
    full = np.zeros(len(chosen))
    full[np.searchsorted(chosen, model.chosen)] = model.weights

    def loss(w, b):
        z = x @ w + b
        return (weight @ np.log1p(np.exp(-np.where(label == 1, z, -z)))) / weight.sum() + ((d @ w) ** 2).sum() / len(swapped) / 2 + ridge * w @ w / 2 + sparse * np.abs(w).sum()

    best, rng = loss(full, model.offset), np.random.default_rng(3)
    for _ in range(300):
        assert loss(full + rng.normal(0, 0.02, len(full)) * (rng.random(len(full)) < 0.3), model.offset + rng.normal(0, 0.02)) > best - 1e-6


def test_toxicity(spark):
    texts, label = biased(600)
    data = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (2000, None), (2001, ""), (2002, "river " * 20000), (2003, "river " * 20000 + "dolt"), (None, "x"), (None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)).repartition(5)
    labels = spark.createDataFrame([(k, 1, int(y)) for k, y in enumerate(label)] + [(None, 1, 1), (5, 1, None), (9, 0, int(label[9]))], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, labels)
    found = toxicity.score_toxicity(df, model).collect()
    assert len(found) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([by_id[k]["predicted"] == label[k] for k in held]) > 0.95
    assert by_id[2000]["score"] == by_id[2001]["score"] < 0.5 and by_id[2002]["predicted"] == 0 and by_id[2003]["score"] > by_id[2002]["score"]
    # Held-out labels change nothing; nor does a smaller sample than there is crash.
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, toxicity.fit_toxicity(df, turned)).collect()}
    assert again == {d: r["score"] for d, r in by_id.items()}
    small = toxicity.fit_toxicity(df, labels, fit_rows=20, fit_bytes=4000)
    assert toxicity.score_toxicity(df.limit(0), small).count() == 0
    nothing = toxicity.fit_toxicity(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(df, nothing).collect()} == {0.5}


def test_toxicity_of_held_out_documents(spark, sf_dir):
    found = queries.op13_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] for r in found if not r["toxic"]) == 0
    assert np.mean([r["predicted"] for r in found if r["toxic"] and not r["held_out"]]) >= 0.5
