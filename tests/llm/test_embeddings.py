import numpy as np
import pyarrow.parquet as pq
import pytest

from voltlake.llm import embeddings as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, class string, times string, home string, id string"


def brute(rows, cosine=0.93):
    ok = [v is not None and l is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    linked = [set() for _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v, _), o in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                linked[i].add(j)
                linked[j].add(i)
    big = 1 << 63
    least = [big if r[0] is None else r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            m = min([least[i], *(least[j] for j in linked[i])])
            changed |= m != least[i]
            least[i] = m
    return sorted(str((r[0], len(linked[i]), None if least[i] == big else least[i], least[i] == (big if r[0] is None else r[0]))) for i, r in enumerate(rows))


def fixture(n=160, dims=10):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, dims))
    rows = [(i * 3 % 400, (centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.25])).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    v = rows[0][1]
    odd = [(500, v, None), (501, None, 1), (502, [], 1), (503, [0.0] * dims, 1), (504, [None, *v[1:]], 1), (505, [float("nan"), *v[1:]], 1), (506, [float("inf"), *v[1:]], 1)]
    more = [(507, [x * 1e18 for x in v], rows[0][2]), (508, v, rows[0][2]), (0, v, rows[0][2]), (None, v, rows[0][2]), (None, [9.0] + [0.0] * (dims - 1), 7), (509, v[:4], rows[0][2]), (510, [2.0], 1), (511, [3.0], 1), (512, [-3.0], 1)]
    return rows + odd + more


def test_links_equal_brute_force(spark, monkeypatch):
    rows = fixture()
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    for block in (E.BLOCK, 3):
        monkeypatch.setattr(E, "BLOCK", block)
        got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in E.link(frame).collect())
        assert got == brute(rows)


def test_recall_on_the_given_table(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(path).to_pylist()]
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in E.link(spark.read.parquet(path)).collect())
    want = brute(rows)
    assert len(set(got) & set(want)) >= 0.99 * len(want)


def test_empty_table(spark):
    assert E.link(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("sample", [E.SAMPLE, 600])
def test_rare_planted_pairs_are_all_found_with_more_vectors_than_probes(spark, sample):
    """With 600 sampled vectors too few have a link to measure anything, and the triangle bound decides."""
    rng = np.random.default_rng(3)
    x = E.unit(rng.normal(size=(2500, 64)))
    cos = rng.uniform(0.935, 0.96, size=(60, 1))
    away = rng.normal(size=(60, 64))
    away = E.unit(away - (away * x[:60]).sum(1, keepdims=True) * x[:60])
    x = np.concatenate((x, cos * x[:60] + np.sqrt(1 - cos**2) * away)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), 1, "a", "b", "c", "d") for i, v in enumerate(x)], SCHEMA).repartition(3)
    got = {(r.vec_id, r.component_id) for r in E.link(frame, sample=sample).collect() if r.n_links}
    y = E.unit(x.astype(np.float64))
    a, b = np.nonzero(np.triu(y @ y.T >= E.COSINE, 1))
    assert len(a) >= 60
    assert got == {(int(i), int(i)) for i in a} | {(int(j), int(i)) for i, j in zip(a, b)}


def test_recall_in_a_table_that_is_larger_than_the_sample(spark):
    """20,000 vectors of four labels, more than codebooks are fitted on, with planted links of both kinds: within a label, and across, which don't count."""
    rng = np.random.default_rng(12)
    n, planted = 20_000, 500
    assert n > E.SAMPLE
    x = E.unit(rng.normal(size=(n - 2 * planted, 64)))
    labels = rng.integers(4, size=len(x))
    at = rng.choice(len(x), size=2 * planted, replace=False)
    cos = rng.uniform(0.93, 0.97, size=(len(at), 1))
    away = rng.normal(size=(len(at), 64))
    away = E.unit(away - (away * x[at]).sum(1, keepdims=True) * x[at])
    x = np.concatenate((x, cos * x[at] + np.sqrt(1 - cos**2) * away)).astype(np.float32)
    labels = np.concatenate((labels, np.where(np.arange(len(at)) < planted, labels[at], (labels[at] + 1) % 4)))
    frame = spark.createDataFrame([(i, v.tolist(), int(l), "a", "b", "c", "d") for i, (v, l) in enumerate(zip(x, labels))], SCHEMA).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(frame).collect() if r.n_links}
    y = E.unit(x.astype(np.float64))
    want = {}
    for a in range(0, n, 2000):
        i, j = np.nonzero((y[a : a + 2000] @ y.T >= E.COSINE) & (labels[a : a + 2000, None] == labels))
        for p, q in zip((i + a).tolist(), j.tolist()):
            if p != q:
                want.setdefault(p, set()).add(q)
    assert len(want) >= 2 * planted * 0.9
    found = sum(got.get(p, (0, 0))[0] for p in want)
    assert found >= 0.99 * sum(map(len, want.values())) and got.keys() <= want.keys()
    assert all(got[p][0] <= len(q) for p, q in want.items() if p in got)
