"""Operators on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fluxlens.llm import bpe, lines, lm, media, mixing, mtree, neardup, packing, passages, quality, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, class string, size int, target int"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def rows():
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    texts = [base, base, " ".join(near), prose(2, 80), None, "", " \n\t", "one", "one", prose(3, 5000), "common line\n" + prose(4, 20)]
    texts += ["common line\n" + prose(10 + k, 20) for k in range(10)]
    out = [(k, t, "en", None if k % 5 == 4 else f"s{k % 3}", len(t or ""), 7, "x", 1, 2) for k, t in enumerate(texts)]
    return [*out, (3, texts[3], "en", "s0", 1, 7, "x", 1, 2), (None, "no id here", "en", "s1", 1, 7, "x", 1, 2), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, empty):
    own = bpe.library(PATH)
    found = tokens.token_counts(docs, PATH, keep_table=True).collect()
    assert len(found) == len(rows())
    texts = collections.defaultdict(set)
    for r in rows():
        texts[r[0]].add(r[1] or "")
    for r in found:
        assert r["n_tokens"] in {len(own.encode(t, add_special_tokens=False).ids) for t in texts[r["doc_id"]]}
        assert tokens.count_at(r["prefix_deltas"], r["table_bits"], r["limit_chars"]) <= 512
    assert tokens.token_counts(empty, PATH).count() == 0


def test_packing(docs, empty):
    own = bpe.library(PATH)
    found = packing.pack(docs, PATH, keep_ids=True).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    for d, t in [(k, t) for k, t, *_ in rows()[:3]]:
        ids = [i for r in sorted(pieces[d], key=lambda r: r["start"]) for i in r["ids"]]
        assert ids == [*own.encode(t, add_special_tokens=False).ids, 1]
    assert sum(r["length"] for r in found) == sum(len(own.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    assert packing.pack(empty, PATH).count() == 0


def test_audio(docs, empty):
    found = media.audio_columns(docs, keep_media=True).collect()
    assert len(found) == len(rows())
    for r in found:
        data = media.read_wav(r["media"])[2]
        assert hashlib.sha256(data).hexdigest() == r["payload_sha256"] and zlib.crc32(data[-16:]) == r["tail_crc32"] and len(data) == r["payload_bytes"]
        assert len(media.read_wav(r["pcm"])[2]) == 4 * r["payload_bytes"]
    texts = collections.defaultdict(set)
    for r in rows():
        texts[r[0]].add((r[1] or "").encode())
    by_text = collections.defaultdict(set)
    for r in found:
        payloads = {len(raw): raw + b" " * (192 if not raw else -len(raw) % 192) for raw in texts[r["doc_id"]]}
        payload = payloads[r["n_bytes"]]
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-16:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        by_text[payload].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in by_text.values()) and len({next(iter(x)) for x in by_text.values()}) == len(by_text)
    assert media.audio_columns(empty).count() == 0


def test_line_dedup(docs, empty):
    counts = collections.Counter()
    for r in rows():
        counts.update({k for k in map(lines.key_of, (r[1] or "").encode().split(b"\n")) if k})
    found = lines.drop_lines(docs, min_docs=10, keep_text=True).collect()
    assert len(found) == len(rows())
    want = collections.Counter()
    for r in rows():
        all_lines = (r[1] or "").encode().split(b"\n")
        kept = [x for x in all_lines if counts[lines.key_of(x)] < 10 or not lines.key_of(x)]
        want[(r[0], len(all_lines), len(all_lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in found) == want
    first = lines.drop_lines(docs, min_docs=10, keep_first=True, keep_text=True).collect()
    assert sum("common line" in r["text"] for r in first) == 1
    assert lines.drop_lines(empty).count() == 0


def test_line_runs(spark):
    key = lambda *x: spark.createDataFrame([(bytearray([k]),) for k in x], "key binary")
    runs = lines.LineRuns(spark, min_docs=4, fanout=2, buckets=3)
    for k in range(3):
        runs.add(key(k, 9, 9))
    assert [len(x) for x in runs.levels] == [1, 1] and len(runs.frequent) == 1
    assert [r["key"][0] for r in runs.unseen(key(9, 7, 7, 0)).collect()] == [7]
    # The third batch has lost the key that was frequent by then.
    assert {(r["key"][0], r["docs"]) for r in spark.table(runs.levels[0][0]).collect()} == {(2, 1)}
    assert {(r["key"][0], r["docs"]) for r in spark.table(runs.levels[1][0]).collect()} == {(0, 1), (1, 1)}
    joined = runs._without_frequent(spark.table(runs.levels[0][0]))._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in joined and "Exchange" not in joined
    merged = runs._merged([runs.levels[0][0], runs.levels[1][0]])._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in merged and "Exchange" not in merged
    runs.add(key(*[5] * 9, 2, 2, 2))
    assert sorted(r["key"][0] for r in runs.keys().collect()) == [2, 5, 9]
    assert lines.LineRuns(spark, buckets=2).keys().count() == 0


def test_frequent_runs_are_levelled_and_names_dropped(spark):
    runs = lines.LineRuns(spark, min_docs=2, fanout=2, buckets=2)
    for k in range(8):  # every compaction of level 0 finds new frequent keys
        runs.add(spark.createDataFrame([(bytearray([k]),)] * 2, "key binary"))
    assert [len(x) for x in runs.settled if x] and len(runs.frequent) <= 3
    found = [r["key"][0] for run in runs.frequent for r in spark.table(run).collect()]
    assert sorted(found) == list(range(8))
    made = runs._name
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(made)]


def test_no_table_is_left_after_a_failure(docs, monkeypatch):
    made = []
    inner = lines.LineRuns._run

    def failing(self, counts):
        made.append(self._name)
        if len(made) > 2:
            raise RuntimeError("lost")
        return inner(self, counts)

    monkeypatch.setattr(lines.LineRuns, "_run", failing)
    with pytest.raises(RuntimeError):
        lines.drop_lines(docs, min_docs=3)
    assert not [t for t in docs.sparkSession.catalog.listTables() if t.name.startswith(made[0])]


def test_more_keys_than_a_batch_holds(docs, monkeypatch):
    whole = sorted(map(str, lines.drop_lines(docs, min_docs=3).collect()))
    added, inner = [], lines.LineRuns.add
    monkeypatch.setattr(lines, "BATCH_KEYS", 4)
    monkeypatch.setattr(lines.LineRuns, "add", lambda self, keys: (added.append(1), inner(self, keys))[1])
    assert sorted(map(str, lines.drop_lines(docs, min_docs=3).collect())) == whole and len(added) > 4


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_frequent_lines_do_not_depend_on_batches(docs, batches, fanout):
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"])
    found = [sorted(map(key, lines.drop_lines(docs, min_docs=3, batches=b, fanout=f).collect()), key=str) for b, f in ((4, 2), (batches, fanout))]
    assert found[0] == found[1] and sum(r[3] for r in found[0]) > 0


def brute_components(docs, words, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        if not w:
            return frozenset()
        return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) or frozenset([tuple(w)])

    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(docs, group):
        if d is not None:
            least[g] = min(d, least.get(g, d))
    return collections.Counter((d, len(s), d if not s else least.get(g)) for (d, _), s, g in zip(docs, sets, group))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(docs, empty, words):
    found = neardup.near_duplicates(docs, words=words).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components([(r[0], r[1]) for r in rows()], words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_across_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = prose(50, 60).split()
    data = []
    for k in range(60):
        own = list(base)
        for at in rng.choice(60, int(rng.integers(1, 9)), replace=False):
            own[at] = f"w{k}x{at}"
        data.append((k, " ".join(own)))
    monkeypatch.setattr(neardup, "CELL", 8)
    monkeypatch.setattr(neardup, "BUCKET_CELL", 8)
    df = spark.createDataFrame(data, "doc_id long, text string")
    found = neardup.near_duplicates(df, words=2).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(data, 2)


def test_one_of_each(docs):
    kept = neardup.one_of_each(docs).collect()
    ids = [r["doc_id"] for r in kept]
    assert 0 in ids and 1 not in ids and 8 not in ids and ids.count(3) == 1 and set(kept[0].asDict()) == set(docs.columns)


def test_passages(spark, empty):
    p = prose(9, 60)
    data = [(0, prose(20, 40) + " " + p), (1, p + "\n" + prose(21, 50)), (2, prose(22, 200)), (3, None), (4, ""), (5, "short"), (6, "short"), (None, prose(23, 30) + " " + p)]
    found = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {0, 1, None} and all(r["component_id"] == 0 for r in found)
    assert passages.repeated_passages(empty).count() == 0


def test_near_equal_passages(spark):
    data, passage_words, doc = [], {}, 0
    for n, edits in ((55, 1), (60, 1), (80, 1), (100, 2), (120, 2)):
        for k in range(8):
            p = prose(1000 + 10 * n + k, n).split()
            q = list(p)
            for e in range(edits):
                q[(e + 1) * n // (edits + 1) + k - 4] = f"edit{e}"
            for words in (p, q):
                data.append((doc, prose(5000 + doc, 40) + " " + " ".join(words) + " " + prose(9000 + doc, 40)))
                passage_words[doc] = n
                doc += 1
    found = {}
    for r in passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect():
        found.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"]))
    assert set(found) == set(passage_words)
    covered = {d: sum(b - a for a, b in x) for d, x in found.items()}
    # A paragraph at an end may agree by 80 % only, and have a few words too many.
    assert all(25 <= covered[d] <= n + 6 for d, n in passage_words.items())
    # Most passages are found whole, over their changed words.
    assert sum(covered[d] >= n for d, n in passage_words.items()) >= 0.8 * len(passage_words)


def test_exact_passages_to_their_ends(spark):
    data = []
    for k in range(60):
        p = prose(200 + k, 51)
        data += [(2 * k + s, prose(3000 + 2 * k + s, 20 + k) + " " + p + " " + prose(6000 + 2 * k + s, 30)) for s in (0, 1)]
    found = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(120))
    # A paragraph at an end may agree by 80 % only, and have a word or two too many.
    assert all(18 <= r["start_word"] - r["doc_id"] // 2 <= 20 and 71 <= r["end_word"] - r["doc_id"] // 2 <= 73 for r in found)
    assert sum(r["n_words"] == 51 for r in found) >= 110


def test_adjoining_passages_keep_a_holder_each(spark):
    header, body = prose(71, 40), prose(72, 60)
    data = [(2, header + " " + prose(73, 50)), *[(10 + k, header + " " + body + " " + prose(80 + k, 30)) for k in range(4)]]
    found = passages.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    parts = sorted((r["doc_id"], r["start_word"], r["end_word"], r["component_id"], r["kept"]) for r in found)
    # The paragraph across the joint is the copies' own.
    joint = parts[1][2]
    assert 25 <= joint <= 40
    assert parts == [(2, 0, 40, 2, True), *[x for k in range(4) for x in ((10 + k, 0, joint, 2, False), (10 + k, joint, 100, 10, k == 0))]]


def test_grown_and_merged():
    words = lambda *x: np.array(x, np.uint32).tobytes()
    contexts = [words(1, 2), words(1, 2, 3), words(7)]
    assert passages.grown(contexts, [5, None, 1], [1, 2, 3], [1, 2, 3]) == [[(0, 2, 5)], [(0, 2, 5)], []]
    assert passages.grown([words(4, 4)], [None], [1], [2]) == [[(0, 2, None)]]
    # A changed word of 61 joins two runs; the shorter pair doesn't agree by 80 %, alone it is too short.
    assert passages.merged([(0, 30, 1, None), (31, 61, 1, None), (30, 31, 1, 1)], 80, 25) == [(0, 61, 1)]
    assert passages.merged([(0, 20, 1, None), (31, 51, 1, None), (20, 31, 1, 9)], 80, 25) == []
    # A gap that starts in an earlier run than the stretch that it helps to join.
    assert passages.merged([(0, 5, 1, None), (9, 40, 2, None), (42, 80, 2, None), (5, 42, 2, 60), (40, 42, 3, 2)], 80, 25) == [(9, 80, 2)]
    assert passages.merged([(0, 30, 1, None), (20, 60, 4, None), (90, 100, 1, None)], 80, 25) == [(0, 30, 1), (30, 60, 4)]


def plain_targets(sizes, share=1.5, most=2):
    """Water-filling source by source."""
    weights = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    full = set()
    while True:
        rest = share * sum(sizes) - sum(most * sizes[k] for k in full)
        held = sum(w for k, w in enumerate(weights) if k not in full)
        more = {k for k in range(len(sizes)) if k not in full and rest * weights[k] / held > most * sizes[k]}
        if not more:
            return [most * n if k in full else rest * weights[k] / held for k, n in enumerate(sizes)]
        full |= more


def test_mixing(docs, empty):
    found = mixing.taken_words(mixing.mix(docs, block_words=8)).collect()
    assert len(found) == len(rows()) and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows():
        size[r[3]] += len((r[1] or "").encode().split())
    names = sorted(size, key=lambda x: (x is None, x or ""))
    want = dict(zip(names, plain_targets([size[x] for x in names])))
    by_doc = {(r[0], len((r[1] or "").encode().split())): r[3] for r in rows()}
    for r in found:
        source = by_doc[(r["doc_id"], r["size"])]
        assert r["source_size"] == size[source] and r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    assert all(abs(taken[x] - want[x]) <= max(2, 0.05 * want[x]) for x in want)
    again = mixing.taken_words(mixing.mix(docs.repartition(7), block_words=8)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(again, key=key) == sorted(found, key=key)
    assert mixing.taken_words(mixing.mix(empty)).count() == 0


@pytest.mark.parametrize("sent", [100_000, 0])
def test_mixing_of_many_small_sources(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT_SOURCES", sent)
    data = [(k, prose(k, 2 + k % 9), f"s{k % 60:02}") for k in range(180)] + [(1000 + k, prose(k, 300), "huge") for k in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, text, source in data:
        sizes[source] += len(text.split())
    names = sorted(sizes)
    want = dict(zip(names, plain_targets([sizes[x] for x in names])))
    mixed = mixing.mix(df, block_words=16, shard_slots=40)
    found = mixing.taken_words(mixed).collect()
    taken, source_of = collections.Counter(), {d: s for d, _, s in data}
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[x] - want[x]) <= max(1, 0.03 * want[x]) for x in names)
    # Every slot is in one shard; shards hold about as many slots as asked for, and all sources' shares.
    slots = mixed.slots.groupBy("shard").count().collect()
    assert sum(r["count"] for r in slots) == mixed.slots.select("sid", "block", "epoch").distinct().count() and max(r["count"] for r in slots) < 120
    by_source = mixed.slots.groupBy("sid", "block", "epoch").count().where("count > 1").count()
    assert by_source == 0


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.schema == docs.schema or mixed.columns == docs.columns
    sizes = {(r["doc_id"], r["text"]): 0 for r in docs.collect()}
    assert sum(len(r["text"].split()) for r in mixed.collect()) == mixing.taken_words(mixing.mix(docs, block_words=8)).agg(F.sum("taken")).first()[0] and sizes
    whole = {r[1] for r in rows()}
    for r in mixed.collect():
        assert r["text"] in whole or set(r["text"].split()) <= {w for t in whole if t for w in t.split()}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    data = [(k, rng.normal(0, 1, 8).round(3).tolist()) for k in range(120)]
    data += [(200, data[0][1]), (201, data[0][1]), (150, data[5][1]), (150, data[5][1]), (300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8), (None, data[1][1]), (450, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    found = collections.defaultdict(list)
    for r in mtree.top_k(df, F.col("vec_id") % 50 == 0, scale=256.0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {d: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for d, v in data if d is not None and d not in (300, 350, 400, 450)}
    assert set(found) == {d for d in whole if d % 50 == 0}
    for q, got in found.items():
        want = sorted((-int(whole[q] @ v), d) for d, v in whole.items() if d != q)[:5]
        assert got == [(k + 1, d, -s) for k, (s, d) in enumerate(want)]
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    whole = rng.integers(-4, 5, (400, 6))  # few values, so ties within and across trees
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(whole)], "vec_id long, embedding array<double>")
    for name, value in {"SHARD_ROWS": 40, "QUERY_ROWS": 10, "TILE_TREES": 3, "TILE_BYTES": 8 * 10 * 6 * 4}.items():
        monkeypatch.setattr(mtree, name, value)
    found = collections.defaultdict(list)
    for r in mtree.top_k(df, F.col("vec_id") % 3 == 0, scale=1.0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    products = whole @ whole.T
    assert len(found) == 134 and all(got == sorted((-int(products[q, d]), d) for d in range(400) if d != q)[:5] for q, got in found.items())


def test_top_k_of_one_id_with_two_vectors(spark):
    # Whole components of -1 and -2, which Python's hash takes for equal.
    data = [(0, [-0.5 / 256, 0.5]), (0, [-1.5 / 256, 0.5]), *[(k, [k / 64, -k / 32]) for k in range(1, 9)]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("length", F.lit("clash")).withColumn("block", F.lit(1))
    found = mtree.top_k(df, F.col("vec_id") == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(0, k) for k in (1, 1, 2, 2, 3, 3, 4, 4, 5, 5)]


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(5)
    good = [(k, prose(100 + k, 40)) for k in range(90)]
    data = [(k, t if k % 3 else t.upper().replace(" ", "!! ")) for k, t in good] + [(1000, None), (1001, ""), (None, "x")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(90)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("clash"))
    model = quality.fit_quality(df, labels)
    found = {r["doc_id"]: r for r in quality.score_quality(df, model).collect()}
    held = [k for k in range(90) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([found[k]["predicted"] == int(k % 3 > 0) for k in held]) > 0.9 and 0 <= found[1000]["score"] <= 1
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.score_quality(df, quality.fit_quality(df, turned)).collect()} == {d: r["score"] for d, r in found.items()}
    assert quality.score_quality(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0
    assert quality.score_quality(df, quality.fit_quality(df, labels, fit_bytes=20_000)).count() == df.count()
    assert rng is not None


def test_scores_are_a_plain_softmax(docs, monkeypatch):
    made, inner = {}, lm.fit
    monkeypatch.setattr(lm, "fit", lambda training, vocabulary, **o: made.setdefault("fitted", (vocabulary, inner(training, vocabulary, **o)))[1])
    unique = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = lm.log_bilinear_scores(unique, held).join(unique, "doc_id").collect()
    vocabulary, model = made["fitted"]
    counts = collections.Counter(w for r in found if not r["held_out"] for w in [*(r["text"] or "").encode().lower().split(), None])
    one, two, target, bias = (a.astype(float) for a in model.arrays)
    for r in found:
        codes, shapes, starts = lm.tokens_of([r["text"] or ""])
        words = [*(r["text"] or "").encode().lower().split(), None]
        _, number, context = vocabulary.numbers(codes, shapes)
        total = 0.0
        for k, w in enumerate(words):
            before = [context[k - back] if k >= back else 0 for back in (1, 2)]
            logits = target @ (one[before[0]] + two[before[1]]) + bias[:, 0]
            p = np.exp(logits[number[k]] - logits.max()) / np.exp(logits - logits.max()).sum()
            if number[k] >= vocabulary.sizes.own:  # one of a class, by its exact count
                p *= (counts[w] + 1) / vocabulary.class_total[number[k] - vocabulary.sizes.own]
            total += np.log10(p)
        assert r["score"] == pytest.approx(total, abs=2e-3 * len(words)), r["doc_id"]


def test_language_model(docs, empty, monkeypatch):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    found = lm.log_bilinear_scores(docs, held).collect()
    assert len(found) == len(rows())
    counts, texts = collections.Counter(), collections.defaultdict(set)
    for r in rows():
        texts[r[0]].add(r[1])
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update([*(r[1] or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        if r["doc_id"] is None or len(texts[r["doc_id"]]) > 1:
            continue
        words = [*(next(iter(texts[r["doc_id"]])) or "").encode().lower().split(), None]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), abs=1e-6)
        assert r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == n and r["score"] < 0
    assert lm.log_bilinear_scores(empty, held).count() == 0
    # Rare words are joined; their counts are the same when few are listed.
    monkeypatch.setattr(lm, "LISTED", 4)
    again = lm.log_bilinear_scores(docs, held).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3))
    assert sorted(map(key, again), key=str) == sorted(map(key, found), key=str)


def test_language_model_beats_its_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = lm.log_bilinear_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).where("held_out")
    sums = found.agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert (sums["score"] - sums["base"]) / sums["n"] > 0.02
