import math
import random

import numpy as np
from pyspark.sql import functions as F

from voltlake.llm import quality as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, grade string, key string, keep string"
LABELS = "doc_id bigint, quality int, toxic int, text string, grade string"


def made(n, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.choice([3, 20, 200]))
        grade = i % 3
        if grade == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["Vile,", "nasty", "rotten."]))
        if grade == 1:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "l", "s", 0, "g", "k", "x"))
        labels.append((i, int(grade != 1), int(grade == 0), "t", "g"))
    return docs, labels


def test_held_out_accuracy_and_order_of_thresholds(spark):
    docs, labels = made(900)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    train = spark.createDataFrame([x for x in labels if x[0] < 600], LABELS)
    model = Q.fit(frame, train, Q.grade_of_labels())
    assert model.thresholds[0] < model.thresholds[1]
    out = {r.doc_id: r for r in Q.score(frame, model).where("doc_id >= 600").collect()}
    assert len(out) == 300
    for r in out.values():
        assert r.p_tail[0] >= r.p_tail[1] and abs(r.grade - sum(r.p_tail)) < 1e-9
    right = np.mean([r.keep == (i % 3 == 2) for i, r in out.items()])
    assert right > 0.97
    kept = Q.select(frame, model)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.where("doc_id >= 600").collect()} == {i for i, r in out.items() if r.keep}


def test_the_fit_does_not_depend_on_partitions_and_obeys_its_sample(spark):
    docs, labels = made(120)
    a, b = (Q.fit(spark.createDataFrame(docs, DOCS).repartition(n), spark.createDataFrame(labels, LABELS).repartition(n), Q.grade_of_labels(), sample=60) for n in (1, 4))
    assert np.array_equal(a.features, b.features) and np.array_equal(a.weights, b.weights) and np.array_equal(a.thresholds, b.thresholds)


def test_odd_rows(spark):
    docs = [(1, None, *["x"] * 0, "l", "s", 0, "g", "k", "x"), (2, "", "l", "s", 0, "g", "k", "x"), (2, "", "l", "s", 0, "g", "k", "x"), (None, "!! ??", "l", "s", 0, "g", "k", "x"), (3, "word " * 50000, "l", "s", 0, "g", "k", "x")]
    labels = [(1, 1, 0, "t", "g"), (2, None, None, "t", "g"), (None, 1, 1, "t", "g"), (3, 1, 0, "t", "g"), (3, 0, 0, "t", "g"), (9, 1, 1, "t", "g")]
    frame = spark.createDataFrame(docs, DOCS)
    model = Q.fit(frame, spark.createDataFrame(labels, LABELS), Q.grade_of_labels())
    assert Q.score(frame, model).count() == 5
    empty = spark.createDataFrame([], LABELS)
    none = Q.fit(frame, empty, Q.grade_of_labels())
    assert Q.score(frame, none).where(~F.col("keep")).count() == 0
    assert Q.score(spark.createDataFrame([], DOCS), none).collect() == []


def test_features_are_the_same_in_any_batch():
    docs, _ = made(40)
    raws = [d[1].encode() for d in docs] + [b"", b" ", "é…".encode()]
    alone = [Q.vectors([r])[0].tolist() for r in raws]
    assert [v.tolist() for v in Q.vectors(raws)] == alone


M = (1 << 64) - 1


def plain_mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M
    return h ^ h >> 32


def plain_features(text, bits=Q.BITS):
    """A word at a time, by the definition."""
    raw = (text or "").encode()
    found, again, loud, last = set(), 0, 0, None
    words = raw.split()
    for word in words:
        letters = marks = 0
        marked = False
        for i, c in enumerate(word):
            low = c | 0x20 if 65 <= c <= 90 else c
            if 97 <= low <= 122 or 48 <= low <= 57 or low >= 128:
                letters += plain_mix(low << 32 ^ i)
            else:
                marks += plain_mix(low + 977)
                marked = True
        letters = plain_mix(letters & M)
        found.add(letters >> 64 - bits)
        if marked:
            found.add(plain_mix(marks & M ^ 0xABCDEF) >> 64 - bits)
        again += letters == last
        last = letters
        loud += sum(65 <= c <= 90 for c in word) > 1
    for k, n in enumerate((again, loud)):
        if words and 4 * n // len(words):
            found.add(plain_mix(4 * n // len(words) + 1000 * (k + 1)) >> 64 - bits)
    return found


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_fit(rows, grades, n_grades, epochs):
    """The regression, a row and a weight at a time."""
    used = sorted(f for f in set().union(*rows) if sum(f in r for r in rows) >= Q.LEAST_ROWS)
    w = dict.fromkeys(used, 0.0)
    share = [min(max(sum(g > k for g in grades) / len(rows), 0.01), 0.99) for k in range(n_grades - 1)]
    t = sorted(math.log((1 - x) / x) for x in share)
    weight = [1 / grades.count(g) for g in grades]
    weight = [x / sum(weight) for x in weight]
    names = [*used, *range(-1, -n_grades, -1)]
    m, v = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for step in range(1, epochs + 1):
        grad = dict.fromkeys(names, 0.0)
        for row, g, share in zip(rows, grades, weight):
            s = sum(w.get(f, 0.0) for f in row)
            tail = [1.0, *(sigmoid(s - x) for x in t), 0.0]
            chance = max(tail[g] - tail[g + 1], 1e-9)
            slope = [x * (1 - x) for x in tail]
            for f in row & w.keys():
                grad[f] += (slope[g] - slope[g + 1]) / chance * share
            if g > 0:
                grad[-g] -= slope[g] / chance * share
            if g < n_grades - 1:
                grad[-g - 1] += slope[g + 1] / chance * share
        for f in names:
            m[f] = 0.9 * m[f] + 0.1 * grad[f]
            v[f] = 0.99 * v[f] + 0.01 * grad[f] ** 2
        scale = {f: math.sqrt(v[f] / (1 - 0.99**step)) + 1e-8 for f in names}
        move = {f: Q.RATE * (m[f] / (1 - 0.9**step)) / scale[f] for f in names}
        w = {f: min(w[f] + move[f] + Q.RATE * Q.LASSO / scale[f], 0.0) for f in used}
        t = sorted(x + move[-k - 1] for k, x in enumerate(t))
    return {f: x for f, x in w.items() if x}, t


def test_model_and_scores_equal_brute_force(spark):
    """Features, training and scores by plain Python."""
    docs, labels = made(90)
    texts = {d[0]: d[1] for d in docs} | {200: None, 201: "", 202: "É A!! a? A A A Vile", 203: "VILE, NASTY! VILE"}
    grades = {i: 0 if toxic else 1 if not quality else 2 for i, quality, toxic, *_ in labels}
    rows = [plain_features(texts[i]) for i in sorted(grades)]
    assert [set(v.tolist()) for v in Q.vectors([(texts[i] or "").encode() for i in sorted(texts)])] == [plain_features(texts[i]) for i in sorted(texts)]
    ordered = [grades[i] for i in sorted(grades)]
    w, t = plain_fit(rows, ordered, 3, 25)
    model = Q.fit_rows([np.array(sorted(r), np.int32) for r in rows], np.array(ordered), 3, epochs=25)
    assert dict(zip(model.features.tolist(), model.weights.tolist())).keys() == w.keys()
    assert all(abs(dict(zip(model.features.tolist(), model.weights.tolist()))[f] - x) < 1e-9 for f, x in w.items()) and np.allclose(model.thresholds, t)
    frame = spark.createDataFrame([(i, x, "l", "s", 0, "g", "k", "x") for i, x in texts.items()], DOCS).repartition(3)
    for r in Q.score(frame, model).collect():
        s = sum(w.get(f, 0.0) for f in plain_features(texts[r.doc_id]))
        p = [sigmoid(s - x) for x in t]
        assert np.allclose(r.p_tail, p) and abs(r.grade - sum(p)) < 1e-9 and r.keep == (p[1] > 0.5)
