import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from voltlake.llm import maxent as M

SCHEMA = "doc_id bigint, text string, held_out string, word string, c string, row string"


def tokens(t):
    return (t or "").encode().lower().split() + [b""]


def out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def fixture():
    rng = random.Random(8)
    langs = [["".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(60)] for letters in ("abcd", "wxyz", "éèñü")]
    docs = []
    for i in range(150):
        words = rng.choice(langs)
        docs.append((i, " ".join(rng.choices(words, k=rng.choice([1, 30, 120])))))
    return [*docs, (500, None), (501, ""), (502, " \t\n"), (None, "abba no key"), (3, docs[3][1]), (504, "LONGWORD" * 20 + " a b"), (505, "LONGWORD" * 20)]


@pytest.mark.parametrize("shared", [M.SHARED, 40])
def test_counts_and_base_score_equal_brute_force_and_held_out_texts_score_better(spark, shared):
    docs = fixture()
    counts = Counter()
    for i, t in docs:
        if i is not None and not out(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    frame = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in docs], SCHEMA).repartition(3)
    rows = M.score(frame, shared=shared).collect()

    def want(i, t):
        w = tokens(t)
        return i is None, i or 0, out(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)

    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == sorted(want(*d) for d in docs)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def model(spark):
    training = spark.createDataFrame([(t,) for _, t in fixture()], "text string").repartition(3)
    words = M.count_words(training)
    vocabulary = M.learn_vocabulary(words)
    return training, {bytes(r.word): r.c for r in words.collect()}, vocabulary


def test_leaves_are_a_distribution_and_spark_counts_them(spark):
    training, counts, vocabulary = model(spark)
    totals = np.ones_like(vocabulary.leaf_total)
    for w, c in counts.items():
        totals[vocabulary.leaf_of(w)] += c + 1
    assert np.array_equal(totals, vocabulary.leaf_total)
    weights = M.train(training, vocabulary, epochs=2)
    assert np.abs(weights.to_class).max() > 0.1 and np.abs(weights.to_branch).max() > 0.1
    lexicon = M.Lexicon(vocabulary)
    numbers = lexicon.of([M.tokens(b"ab ba abba dada"), M.tokens("é ñü".encode())])
    found = [f[6:7] for f in M.features(lexicon.hash[numbers], np.array([5, 3]))]
    leaves = np.arange(len(totals))
    chance = np.exp(weights.log_leaves([np.repeat(f, len(leaves)) for f in found], leaves))
    assert abs(chance.sum() - 1) < 1e-3
    # Known words of a leaf and one unknown word make up the whole of it.
    assert abs(sum((c + 1) / totals[vocabulary.leaf_of(w)] for w, c in counts.items()) + (1 / totals).sum() - len(totals)) < 1e-6


def test_scores_equal_brute_force(spark):
    """Word by word, with loops over features, classes and branches."""
    training, counts, vocabulary = model(spark)
    weights = M.train(training, vocabulary)
    inside, levels = (M.CLASSES - M.SINGLE) << vocabulary.levels, vocabulary.levels

    def mix(x):
        for _ in range(2):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return x ^ x >> 32

    def chance(history, word):
        three, two, one = map(M.word_hash, history)
        gram, far = mix((two * 0x9E3779B97F4A7C15 + one) % 2**64), three * 0xC2B2AE3D27D4EB4F % 2**64
        features = [mix(x % 2**64) for x in (one + 1, gram + 2, two + 4, far ^ (gram + 3) % 2**64, far + one + 5)]
        leaf = vocabulary.leaf_of(word)
        k = leaf - inside if leaf >= inside else M.SINGLE + (leaf >> levels)
        logits = [float(weights.classes[c]) + sum(float(weights.to_class[f >> (64 - M.CLASS_BITS)][c]) for f in features) for c in range(M.CLASSES)]
        p = math.exp(logits[k]) / sum(map(math.exp, logits))
        if leaf < inside:
            at = 1
            for level in range(levels):
                branch = (leaf >> levels << levels) + at
                logit = float(weights.branches[branch]) + sum(float(weights.to_branch[level][(f ^ mix(branch + 1)) * 0xD6E8FEB86659FD93 % 2**64 >> (64 - M.LEVEL_BITS)]) for f in features[: M.WITHIN])
                second = leaf >> (levels - 1 - level) & 1
                p *= 1 / (1 + math.exp(-logit if second else logit))
                at = 2 * at + second
        return p * (counts.get(word, 0) + 1) / vocabulary.leaf_total[leaf]

    for text in (b"", b"abba da ab ab ca d", "éñ wx nowhere zz zz".encode(), b"ab " * 9):
        lexicon = M.Lexicon(vocabulary)
        found, leaf, numbers, _ = M._numbered([text], lexicon)
        got = weights.log_leaves(found, leaf) + np.log((lexicon.known[numbers] + 1) / vocabulary.leaf_total[leaf])
        padded = [M.END] * 3 + M.tokens(text)
        want = [math.log(chance(padded[i : i + 3], padded[i + 3])) for i in range(len(padded) - 3)]
        assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_tables_of_many_tasks_are_merged_by_how_far_each_went(spark):
    w, moved = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), np.array([[1.0, 0.0], [3.0, 0.0], [0.0, 2.0]])
    full = lambda x: np.tile(x, M.CELLS // 2).astype(np.float16).tobytes()
    rows = spark.createDataFrame([(7, full(a), full(b), i) for i, (a, b) in enumerate(zip(w, moved, strict=True))], "block int, w binary, moved binary, part int")
    (r,) = M._merged(rows, 3).collect()
    assert r.block == 7 and np.frombuffer(r.w, np.float16)[:2].tolist() == [2.5, 6.0]


def test_empty_table_and_nothing_to_train_on(spark):
    assert M.score(spark.createDataFrame([], SCHEMA)).collect() == []
    i = next(i for i in range(99) if out(i))
    (r,) = M.score(spark.createDataFrame([(i, "a b", "a", "b", "c", "d")], SCHEMA)).collect()
    assert (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_words_are_found_and_looked_up_by_the_slice_and_not_one_by_one_in_python(spark, monkeypatch):
    rng = random.Random(5)
    odd = ["", " ", "  a", "a ", "A\tÀB\x0b\x0cc\r\n\r\nd", "e\x1cf\x1d\x1e\x1fg\x00h", "x\x85y z w　v", " \t", "Ünü ÜNÜ", "K k"]
    texts = [t.encode() for t in odd + ["".join(rng.choices("aBé\t\n\x0b\x0c\r\x1c\x85  ", k=rng.randrange(30))) for _ in range(300)]] + [b"\xff \xfe a"]
    want = [M.tokens(t) for t in texts]
    _, counts, vocabulary = model(spark)
    lexicon, flat = M.Lexicon(vocabulary), [w for t in want for w in t]
    monkeypatch.setattr(M, "tokens", None)
    _, leaf, numbers, sizes = M._numbered(texts, lexicon)
    assert [lexicon.words[i].as_py() for i in numbers.tolist()] == flat and sizes.tolist() == [len(t) for t in want]
    assert len(lexicon.words) == len(set(flat)) and leaf.tolist() == [vocabulary.leaf_of(w) for w in flat]
    assert lexicon.hash[numbers].tolist() == [M.word_hash(w) for w in flat] and lexicon.known[numbers].tolist() == [counts.get(w, 0) for w in flat]


def test_one_update_equals_plain_loops(spark):
    _, _, vocabulary = model(spark)
    lexicon = M.Lexicon(vocabulary)
    found, leaf, _, _ = M._numbered([b"abba da ab ab ca d ab ab", b"", "éñ wx nowhere zz zz".encode()], lexicon)
    tables = np.zeros((1 << M.CLASS_BITS, M.CLASSES), np.float32), np.zeros((vocabulary.levels, 1 << M.LEVEL_BITS), np.float32)
    trainer = M.Trainer(M.Weights(*tables, *vocabulary.priors()))
    trainer.update(found, leaf)
    inside, levels = (M.CLASSES - M.SINGLE) << vocabulary.levels, vocabulary.levels
    to_class, to_branch = np.zeros(tables[0].shape), np.zeros(tables[1].shape)
    p = np.exp(trainer.w.classes.astype(float)) / np.exp(trainer.w.classes.astype(float)).sum()
    for i, to in enumerate(leaf.tolist()):
        k = to - inside if to >= inside else M.SINGLE + (to >> levels)
        for f in found:
            to_class[int(f[i]) >> (64 - M.CLASS_BITS)] += (np.arange(M.CLASSES) == k) - p
        at = 1
        for level in range(levels if to < inside else 0):
            branch = (to >> levels << levels) + at
            second = to >> (levels - 1 - level) & 1
            for f in found[: M.WITHIN]:
                cell = (int(f[i]) ^ int(M._BRANCH[branch])) * 0xD6E8FEB86659FD93 % 2**64 >> (64 - M.LEVEL_BITS)
                to_branch[level, cell] += second - 1 / (1 + math.exp(-float(trainer.w.branches[branch])))
            at = 2 * at + second
    for got, gradient in ((trainer.w.to_class, to_class), (trainer.w.to_branch, to_branch)):
        assert np.allclose(got, M.RATE * gradient / np.sqrt(gradient**2 + 1e-6), atol=1e-4) and np.abs(got).max() > 0.01


@pytest.mark.parametrize("apart", [60, 200])
def test_classes_far_apart_keep_their_order_and_finite_logs(spark, apart):
    """The unlikelier class's chance is right as far as single precision goes, and small but no zero beyond."""
    _, _, vocabulary = model(spark)
    to_class = np.zeros((1 << M.CLASS_BITS, M.CLASSES), np.float32)
    to_class[:, 1] = apart / 5
    weights = M.Weights(to_class, np.zeros((vocabulary.levels, 1 << M.LEVEL_BITS), np.float32), *vocabulary.priors())
    found, leaf, _, _ = M._numbered([b""], M.Lexicon(vocabulary))
    (got,) = weights.log_leaves(found, leaf)
    assert abs(got - max(-float(M.SPREAD), weights.classes[0] - weights.classes[1] - apart)) < 1e-2
