import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import hardnegatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, x string, tree string, rank string, place string"
ANCHORS = "key % 10 = 0"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA).repartition(parts)


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90):
    ok = {(i, l, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, l in rows if l is not None and v and all(c is not None and np.isfinite(c) for c in v)}
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, l, x in ok:
        if i is None or i % every:
            continue
        each = [(sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in ok if len(y) == len(x) and j != i]
        for ps, pid, _ in sorted((t for t in each if t[2] == l), key=order)[:positives]:
            fit = sorted((t for t in each if t[2] != l and low * ps <= 100 * t[0] <= high * ps), key=order)[:negatives]
            out += [(i, pid, n, t[1], ps, t[0]) for n, t in enumerate(fit, 1)]
    return sorted(map(str, out))


def found(frame):
    return sorted(str(tuple(r)) for r in frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def fixture(n=400, dims=6):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5, dims))
    rows = [(i * 3 % 1000, (centres[rng.integers(5)] + 0.4 * rng.normal(size=dims)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]
    v = rows[0][1]
    # Copies under other keys and labels make ties; the same key twice; coarse vectors make more ties.
    more = [(2000 + i, v, i % 2) for i in range(60)] + [rows[0], rows[0], (0, [1.0] * dims, 1), (None, v, 1), (None, v, 2)]
    more += [(3000 + i, [float(i % 3), 1.0, 0.0, 0.0, 1.0, float(i % 2)], i % 3) for i in range(80)]
    odd = [(10, None, 1), (20, v, None), (30, [], 1), (40, [None, *v[1:]], 1), (50, [float("nan"), *v[1:]], 1), (60, [float("inf"), *v[1:]], 1)]
    other = [(70, [2.0, 1.0], 1), (71, [2.0, 2.0], 1), (72, [1.0, 1.0], 0), (80, [5.0], 9)]
    return rows + more + odd + other


@pytest.mark.parametrize(("tree", "leaf", "group"), [(H.TREE, H.LEAF, H.GROUP), (50, 4, 7)])
def test_equals_brute_force(spark, monkeypatch, tree, leaf, group):
    monkeypatch.setattr(H, "TREE", tree)
    monkeypatch.setattr(H, "GROUP", group)
    monkeypatch.setattr(H.BallTree.__init__, "__defaults__", (leaf,))
    rows = fixture()
    want = brute(rows)
    assert len(want) > 500
    assert found(H.mine(frame(spark, rows), ANCHORS)) == want


def test_a_search_prunes_and_loses_nothing():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.concatenate([rng.normal(size=(400, 5)) * 0.05 + c for c in rng.normal(size=(12, 5)) * 3])).astype(np.int64)
    labels, keys = rng.integers(0, 3, len(x)), rng.permutation(len(x))
    tree = H.BallTree(keys.copy(), labels.copy(), x.copy(), 32)
    seen = []
    plain = tree.scores
    tree.scores = lambda rows, q: seen.append(len(q)) or plain(rows, q)
    some = np.arange(0, len(x), 97)
    got = tree.search(x[some], keys[some], labels[some], np.arange(len(some)), np.full(len(some), 1000), np.full(len(some), 200_000), 10, False)
    leaves = sum(n < 0 for n in tree.left)
    assert sum(seen) < 0.5 * leaves * len(some)
    for n, i in enumerate(some):
        s = x @ x[i]
        ok = np.flatnonzero((labels != labels[i]) & (s >= 1000) & (s <= 200_000))
        want = sorted((-s[j], keys[j]) for j in ok)[:10]
        assert [(-a, b) for a, b in zip(got.score[n], got.key[n]) if a != H._NONE] == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 10**5).astype(np.float32).tolist(), i % 2) for i in range(60)]
    assert found(H.mine(frame(spark, rows), ANCHORS)) == brute(rows)
    huge = [(i, [3e38, -1.0], i % 2) for i in range(12)]
    assert H.mine(frame(spark, huge), ANCHORS, high=100).count() > 0


def test_empty_tables_and_keys(spark):
    assert H.mine(frame(spark, fixture()).where("vec_id < 0"), ANCHORS).collect() == []
    assert H.mine(frame(spark, [(1, [1.0], 1)]), ANCHORS).collect() == []
    with pytest.raises(TypeError):
        H.mine(frame(spark, [(1, [1.0], 1)]).withColumn("vec_id", F.lit("a")), ANCHORS)
    text = frame(spark, fixture()).withColumn("label", F.concat(F.lit("l"), "label"))
    assert found(H.mine(text, ANCHORS)) == brute(fixture())
