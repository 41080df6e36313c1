"""Parts that need no cluster: tokens, trees, packing, audio, drawing, shingles."""

import json
import random

import numpy as np
import public_tokenizers
import pytest

from fluxlens.llm import bpe, lm, media, mixing, mtree, neardup, packing, passages, quality, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a   b\n\n c", "don't we'll  they're 'tis", "x\n\ny\n \nz ", "<|endoftext|>a <|endoftext|>", "日本語 text ½²x    é", "a\x1c b \x85c", " \n", "'" * 50 + "ll", "aaaa" * 60, "\n\n<|endoftext|>s'\t\tthe", "=-" * 70, "word" * 400]


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    parts = ["a", "'", "ll", "s", " ", "  ", "\n", "\n\n", "1", "é", "the", "日", "!", " ", "<|endoftext|>", "re", "\t", "ing", "Ñandú"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25))) for _ in range(n)]


def test_ids_and_prefix_counts_equal_the_library():
    own, library = bpe.load(PATH), bpe.library(PATH)
    for text in ODD + random_texts(300):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert own.prefix_counts(text).tolist() == want


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"type": "Unigram"}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.ByteBPE(str(tmp_path / "t.json"))


def test_longest_prefix():
    own = bpe.load(PATH)
    text = "the quick brown fox jumps over the lazy dog"
    deltas = own.prefix_deltas([text])[0]
    k = bpe.longest_prefix(deltas, 4)
    assert len(own.encode(text[:k])) <= 4 and len(own.encode(text[: k + 1])) > 4
    assert bpe.longest_prefix(deltas, 0) == 0


def test_differencing_deals_every_item_once_and_evenly():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 512, 400).tolist()
    windows = packing.differencing(sizes, 50)
    assert sorted(i for w in windows for i in w) == list(range(400))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) < 60
    fitted = packing.windows_of(sizes, 2048)
    assert all(sum(sizes[i] for i in w) <= 2048 for w in fitted) and len(fitted) * 2048 < 1.05 * sum(sizes)
    assert packing.windows_of([], 2048) == []


def test_cut():
    assert packing.cut(5000, 2048, 512) == [2048, 2048, 452, 452] and packing.cut(1, 2048, 512) == [1]


def brute_top(vectors, ids, query, own, k):
    scores = sorted(((-int(v @ query), i) for v, i in zip(vectors, ids) if i != own))
    return [(-s, i) for s, i in scores[:k]]


@pytest.mark.parametrize("n,scale", [(1, 1), (3, 1), (64, 1), (65, 1), (1500, 1), (500, 1 << 22)])
def test_m_tree_is_exact(n, scale):
    rng = np.random.default_rng(n)
    centers = rng.integers(-200, 200, (8, 16)) * scale
    vectors = centers[rng.integers(0, 8, n)] + rng.integers(-15, 15, (n, 16))
    vectors[: n // 3] = vectors[0]  # many ties
    tree = mtree.MTree.unpacked(mtree.MTree(vectors, np.arange(n)).packed())
    asks = np.arange(0, n, max(1, n // 20))
    scores, ids, count = tree.search(vectors[asks], asks, 5)
    for row, q in enumerate(asks.tolist()):
        assert list(zip(scores[row].tolist(), ids[row].tolist()))[: count[row]] == brute_top(vectors, range(n), vectors[q], q, 5)


def test_trees_carry_what_others_gave():
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 1000, (40, 8)).round()
    vectors = (centers[rng.integers(0, 40, 3000)] + rng.integers(-5, 5, (3000, 8))).astype(np.int64)
    vectors[2000:2100] = vectors[:100]  # ties across trees
    trees = [mtree.MTree(vectors[k::3], np.arange(3000)[k::3]) for k in range(3)]
    asks, known, alone = np.arange(0, 3000, 97), None, mtree.MTree(vectors[2::3], np.arange(3000)[2::3])
    for tree in trees:
        scores, ids, count = tree.search(vectors[asks], asks, 5, known)
        known = scores, ids
    for row, q in enumerate(asks.tolist()):
        assert list(zip(scores[row].tolist(), ids[row].tolist())) == brute_top(vectors, range(3000), vectors[q], q, 5)
    alone.search(vectors[asks], asks, 5)
    assert trees[2].computed < alone.computed


def test_m_tree_avoids_computations():
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1000, (40, 8)).round()
    vectors = (centers[rng.integers(0, 40, 4000)] + rng.integers(-5, 5, (4000, 8))).astype(np.int64)
    tree = mtree.MTree(vectors, np.arange(4000))
    tree.search(vectors[:20], np.arange(20), 5)
    assert tree.computed < 20 * 2000


def test_wave_files_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.payload_of(bytes(k % 256 for k in range(n)))
        assert len(payload) % 192 == 0 and payload
        assert media.read_wav(media.wav(payload)) == (media.MU_LAW, 8000, payload)


def test_law_tables():
    mu, a = media.mu_law_table(), media.a_law_table()
    assert mu[0xFF] == 0 and mu[0x80] == 32124 and mu[0x00] == -32124
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256


def plain_adpcm(block):
    value, at = ((block[0] | block[1] << 8) + 32768) % 65536 - 32768, min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[at])
            diff = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            at = max(0, min(88, at + int(media.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_equals_a_plain_decoder():
    blocks = np.random.default_rng(2).integers(0, 256, (3, media.BLOCK_BYTES), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [plain_adpcm([int(x) for x in b]) for b in blocks]


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_permutation(size):
    assert sorted(mixing.permuted(np.arange(size), size, 12345).tolist()) == list(range(size))


def test_draws_are_dealt_whole():
    rng = np.random.default_rng(0)
    for count, parts in ((0, 3), (2, 50), (1000, 7), (5, 5)):
        found, counts = mixing.dealt(count, parts, rng)
        assert counts.sum() == count and (counts > 0).all() and len(set(found.tolist())) == len(found) and (found < parts).all()


def test_shingle_sets_of_a_batch():
    texts = ["", "a", "a b", "A b\nc", "a b a b a b", "x y z a b c"]
    sets = neardup.shingle_sets(texts, 2)
    assert [len(x) for x in sets] == [0, 1, 1, 2, 2, 5] and sets[2][0] in sets[3] and sets[1][0] not in sets[2]
    assert [x.tolist() for x in sets] == [neardup.shingle_sets([t], 2)[0].tolist() for t in texts]


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    for shared in (0.95, 0.8, 0.5):
        n = int(2 * len(base) * shared / (1 + shared))
        other = np.unique(np.concatenate((base[:n], rng.integers(0, 1 << 63, len(base) - n).astype(np.uint64))))
        true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        bits = [np.frombuffer(neardup.packed(neardup.minima(x)), np.uint64) for x in (base, other)]
        assert abs(neardup.estimated(bits[0], bits[1][None])[0] - true) < 0.2


def test_paragraphs_are_cut_alike_wherever_a_passage_stands():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(55))
    one = passages.Paragraphs([" ".join(word() for _ in range(40)) + " " + passage], 2, 1)
    two = passages.Paragraphs(["", passage + "\n" + " ".join(word() for _ in range(30))], 2, 1)
    assert len(set(one.keys[:, 0]) & set(two.keys[:, 0])) >= 2
    assert passages.Paragraphs([""], 2, 1).keys.shape == (0, 2) and len(passages.Paragraphs(["one two", ""], 2, 1).keys) == 1
    # A text is cut alike whatever stands before and after it in the batch.
    texts = ["", " ".join(word() for _ in range(300)), "a b", " ".join(word() for _ in range(77)), " \n"]
    together = passages.Paragraphs(texts, 2, 3)
    alone = [passages.Paragraphs([t], 2, 3) for t in texts]
    assert together.keys.tolist() == [k for x in alone for k in x.keys.tolist()]
    assert together.classes(np.arange(len(together.start))).tolist() == [c for x in alone for c in x.classes(np.arange(len(x.start))).tolist()]


def test_word_codes():
    rnd = random.Random(5)
    texts = ["", " \t\n", "One one ONE", "é Éa\x0bb\x85c x", *["".join(rnd.choice("ab é\n\t") for _ in range(rnd.randint(0, 60))) for _ in range(200)], "w" * 300_000 + " w"]
    codes, first, shapes = words.words_and_shapes(texts)
    plain = [w for t in texts for w in t.encode().lower().split()]
    assert np.diff(first).tolist() == [len(t.encode().split()) for t in texts] and len(codes) == len(plain) == len(shapes)
    assert len(set(codes.tolist())) == len(set(plain)) == len(set(zip(codes.tolist(), plain)))
    assert shapes.tolist() == [w[0] | w[min(1, len(w) - 1)] << 8 | w[-1] << 16 for w in plain]
    assert [words.word_codes([t])[0].tolist() for t in texts] == [codes[a:b].tolist() for a, b in zip(first, first[1:])]


def test_places():
    codes = words.scrambled(np.arange(1, 5000, dtype=np.uint64))
    places = words.Places(codes)
    assert places.find(codes).tolist() == list(range(len(codes)))
    assert (places.find(words.scrambled(np.arange(5000, 9000, dtype=np.uint64))) == -1).all()
    assert words.Places(codes[:0]).find(codes[:3]).tolist() == [-1, -1, -1]


def test_classifier_learns():
    f = quality.Features()
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    good = [" ".join(word() for _ in range(30)) for _ in range(60)]
    bad = [t.upper() + "!!" for t in good]
    rows, label = [f(t) for t in good + bad], np.array([1] * 60 + [0] * 60)
    model = quality.train(rows, label)
    assert all(model.score(x) >= 0.5 for x in rows[:60]) and all(model.score(x) < 0.5 for x in rows[60:])
    assert 0 <= model.score(f("")) <= 1
    assert quality.train([], np.array([], int)).score(f("x")) == 0.5


def small_vocabulary(texts, **sizes):
    codes, shapes, starts = lm.tokens_of(texts)
    own, at, n = np.unique(codes, return_index=True, return_counts=True)
    order = np.lexsort((own, -n, own != lm.END))
    own, at, n, sizes = own[order], at[order], n[order], lm.Sizes(**sizes)
    totals = np.ones(sizes.shared)
    np.add.at(totals, lm.spelled(shapes[at[sizes.own :]], sizes.shared), n[sizes.own :] + 1)
    return lm.Vocabulary(sizes, own, n, totals, len(codes), len(own))


def test_noise_contrastive_model_is_normalised_and_learns():
    # Every word tells the next one but one.
    rnd = random.Random(3)
    names = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(30)]
    follow = {(a, b): rnd.choice(names) for a in names for b in names[:3]}
    texts = []
    for _ in range(60):
        own = [rnd.choice(names), rnd.choice(names)]
        while len(own) < 150:
            own.append(follow[own[-2], names[names.index(own[-1]) % 3]] if rnd.random() < 0.8 else rnd.choice(names))
        texts.append(" ".join(own))
    vocabulary = small_vocabulary(texts, own=20, shared=4, near=15, spelled=3)
    model = lm.Parameters(vocabulary)
    steps = lm.NoiseContrastive(model, vocabulary.unigram(), batch=256)
    codes, shapes, starts = lm.tokens_of(texts)
    place, target, context = vocabulary.numbers(codes, shapes)
    one, two = lm.before(context, starts)
    assert one[starts[:-1]].tolist() == [0] * 60 and one[1] == context[0] and two[2] == context[0]
    for _ in range(15):
        steps.learn(target, one, two)
    contexts = vocabulary.sizes.contexts
    logs = model.scores(target, one, two) - model.normalisers(one * contexts + two)
    assert logs.mean() > np.log(vocabulary.unigram())[target].mean() + 0.2
    # After any two contexts, all words and one unknown one in each class have a probability of 1 together.
    for pair in (0, 5 * contexts + 2, contexts**2 - 1):
        every = np.arange(vocabulary.sizes.targets)
        p = np.exp(model.scores(every, np.full(len(every), pair // contexts), np.full(len(every), pair % contexts)) - model.normalisers(np.array([pair]))[0])
        rare_codes = vocabulary.codes[20:]
        rare = [np.flatnonzero(codes == c)[0] for c in rare_codes]
        classes = target[rare] - 20
        shares = (vocabulary.counts[20:] + 1) / vocabulary.class_total[classes]
        unknown = 1 / vocabulary.class_total
        assert p[:20].sum() + (p[20 + classes] * shares).sum() + (p[20:] * unknown).sum() == pytest.approx(1, abs=1e-4)


def test_sizes_grow_with_the_words():
    sizes = [lm.Sizes.of(n) for n in (0, 1, 100, 10**4, 10**6, 10**8, 10**10)]
    assert all(a.own <= b.own and a.shared <= b.shared and a.near <= b.near for a, b in zip(sizes, sizes[1:])) and sizes[0].own == 1
    assert sizes[-1].own > 100 * sizes[3].own / 2 and all(s.near <= s.own for s in sizes)


def test_dual_coordinate_descent_reaches_the_optimum():
    # The hinge loss of 30 rows in six buckets, against projected ascent on the whole dual problem.
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(6, rng.integers(1, 5), replace=False)) for _ in range(30)]
    values = [rng.normal(0, 1, len(x)) for x in rows]
    dense = np.zeros((30, 6))
    for k, (x, v) in enumerate(zip(rows, values)):
        dense[k, x] = v
    sign = np.where(dense @ rng.normal(0, 1, 6) + rng.normal(0, 0.5, 30) > 0, 1.0, -1.0)
    cost = np.where(sign > 0, 0.7, 1.3)
    found = quality.dual_coordinate_descent(rows, values, sign, cost, 3000, 0)[:6]
    signed = dense * sign[:, None]
    gram, alpha = signed @ signed.T, np.zeros(30)
    rate = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha + rate * (1 - gram @ alpha), 0, cost)
    best = signed.T @ alpha
    loss = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - signed @ w)
    assert loss(found) == pytest.approx(loss(best), rel=1e-3) and np.abs(found - best).max() < 0.02


def test_log_count_ratios_by_hand():
    rows, label = [np.array([0, 1]), np.array([1]), np.array([1, 2])], np.array([1, 1, 0])
    counts = {0: {0: 1, 1: 2, 2: 2}, 1: {0: 2, 1: 3, 2: 1}}  # presences and one each
    total = {y: sum(counts[y].values()) + quality.BUCKETS - 3 for y in (0, 1)}
    got = quality.log_count_ratios(rows, label)
    for b in range(3):
        assert got[b] == pytest.approx(np.log(counts[1][b] / total[1] / (counts[0][b] / total[0])))
