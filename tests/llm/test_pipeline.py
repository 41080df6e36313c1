"""The pipeline's stages one by one, each on what the one before returned, and on odd tables."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from fluxlens.llm import bpe
from fluxlens.llm.common import written

STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def groups_of(docs):
    """Groups of near duplicates by comparing all pairs that share a shingle."""
    sets, holders, group = [shingles(d["text"]) for d in docs], collections.defaultdict(list), list(range(len(docs)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, own in enumerate(sets):
        seen = collections.Counter(j for s in own for j in holders[s])
        for j, common in seen.items():
            if 100 * common >= 80 * (len(own) + len(sets[j]) - common):
                group[max(root(j), root(k))] = min(root(j), root(k))
        for s in own:
            holders[s].append(k)
    return [root(k) for k in range(len(docs))], sets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, sf_dir), name)
        after = docs.collect()
        sizes.append(len(after))
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            kept = {r["doc_id"] for r in after}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) >= 0.95 * len(good)
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "lines":
            held = collections.Counter()
            for r in after:
                held.update({k for k in (x.strip().lower() for x in r["text"].split("\n")) if k})
            assert max(held.values()) < 10
        if name == "near_duplicates":
            groups, sets = groups_of(before)
            want = {}
            for r, g, own in zip(before, groups, sets):
                if own:
                    want[g] = min(r["doc_id"], want.get(g, r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted([*want.values(), *[r["doc_id"] for r, own in zip(before, sets) if not own]])
        if name == "mixing":
            sources = collections.Counter()
            for r in before:
                sources[r["source"]] += len(r["text"].split())
            names = sorted(sources)
            weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
            full = set()
            while True:
                unit = (1.5 * sum(sources.values()) - sum(2 * sources[s] for s in full)) / sum(weights[s] for s in names if s not in full)
                more = {s for s in names if s not in full and unit * weights[s] > 2 * sources[s]}
                if not more:
                    break
                full |= more
            taken, own = collections.Counter(), {r["doc_id"]: r["text"].split() for r in before}
            for r in after:
                taken[r["source"]] += len(r["text"].split())
                assert set(r["text"].split()) <= set(own[r["doc_id"]]) and r["n_chars"] == len(r["text"])
            assert all(abs(taken[s] - min(2 * sources[s], unit * weights[s])) <= max(2, 0.01 * sources[s]) for s in names)
            per_doc = collections.Counter()
            for r in after:
                per_doc[r["doc_id"]] += len(r["text"].split())
            assert all(n <= 2 * len(own[d]) for d, n in per_doc.items())
        if name == "packing":
            library = bpe.library(public_tokenizers.path("byte_bpe_50k.json"))
            want = collections.Counter((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids) + 1) for r in before)
            # Several passes over a document are packed one by one; its pieces add up to all of them.
            total, tokens = collections.Counter(), collections.Counter()
            for r in after:
                total[r["doc_id"]] += r["length"]
            for (d, n), times in want.items():
                tokens[d] += n * times
            assert total == tokens
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2]
    sequences = collections.defaultdict(list)
    for r in after:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Documents with nulls, repeated rows, and columns of other operators' names and of a map type."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    more = spark.createDataFrame([(None, None, None, None, None), (7000, "", "en", "src0", 0), (7001, None, "en", None, None), (7002, " \n\t ", "en", "src1", 4)], base.schema)
    copies = base.where("doc_id < 5")
    docs = base.unionByName(more).unionByName(copies).unionByName(copies)
    clashing = {c: F.lit(k) for k, c in enumerate(("score", "predicted", "label", "row", "__row", "keys", "box", "rest", "n_lines", "n_dropped", "kept_sha256", "size", "sid", "start", "length", "h", "epoch", "_"))}
    return docs.withColumns(clashing).withColumn("tags", F.create_map(F.lit("a"), F.col("n_chars"))).withColumn("odd `name`, dear", F.lit("x")).withColumn("a.b", F.lit("y")).cache()


@pytest.mark.parametrize("name", ["quality", "lines", "near_duplicates", "mixing"])
def test_stages_keep_odd_columns(spark, sf_dir, odd, name):
    out = written(STAGES[name](spark, odd, sf_dir).withColumnRenamed("odd `name`, dear", "odd"), name)
    assert out.columns == [c if c != "odd `name`, dear" else "odd" for c in odd.columns] and "a.b" in out.columns and isinstance(out.schema["tags"].dataType, T.MapType)
    rows = out.collect()
    assert rows and all(r["score"] == 0 and r["__row"] == 4 and r["odd"] == "x" and r["tags"]["a"] is not None for r in rows if r["doc_id"] is not None and r["doc_id"] < 60)
    if name == "near_duplicates":
        assert len(rows) == len({(r["doc_id"], r["text"]) for r in rows})


def test_packing_of_odd_columns(spark, sf_dir, odd):
    found = STAGES["packing"](spark, odd.drop("odd `name`, dear", "a.b"), sf_dir).collect()
    assert sum(r["start"] == 0 for r in found) == odd.count()


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, sf_dir, odd, name):
    assert STAGES[name](spark, odd.drop("odd `name`, dear", "a.b").limit(0), sf_dir).count() == 0
