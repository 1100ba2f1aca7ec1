import numpy as np
import pytest

from voltlake.llm import whitening as W

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, vec string, n string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, components=4):
    """vec_id, component, n, deviation, |whitened|, explained of vectors of one length."""
    ok = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit.astype(float) - (sums / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in ok:
        dev = int(((n * np.array(x, object) - sums) ** 2).sum())
        w = (np.array(x, float) - (sums / n).astype(float)) @ vectors
        for k in range(min(components, len(x))):
            out.setdefault((i, k + 1), []).append((n, dev, abs(w[k]) / np.sqrt(values[k]), values[k] / values.sum()))
    return {k: sorted(v) for k, v in out.items()}


def check(got, want):
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert found.keys() == want.keys()
    for key, rows in want.items():
        mine = sorted(found[key])
        assert [r[:2] for r in mine] == [r[:2] for r in rows]
        assert np.allclose([r[2:] for r in mine], [r[2:] for r in rows], rtol=1e-9, atol=1e-9)


def fixture(n=300, dims=7, shift=0.0):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(n, dims)) * np.linspace(0.2, 3, dims) @ rng.normal(size=(dims, dims)) + shift).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    copies = [(1000 + i, rows[0][1]) for i in range(200)] + [rows[1], (None, rows[2][1])]
    odd = [(2000, None), (2001, []), (2002, [None, *rows[0][1][1:]]), (2003, [float("nan"), *rows[0][1][1:]]), (2004, [float("-inf"), *rows[0][1][1:]])]
    return rows + copies + odd


@pytest.mark.parametrize("shift", [0.0, 30000.0])
def test_equals_brute_force(spark, shift):
    """Also of a mean that is far larger than the spread; copies don't weigh in the fit list."""
    rows = fixture(shift=shift)
    got = W.whiten(frame(spark, rows)).collect()
    check(got, brute(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6


def test_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = W.whiten(table).collect()
    check(got, brute(rows))
    assert len(got) == 4 * len(rows) and got[0].identity_error < 1e-9


def test_one_sign_for_all_rows(spark):
    rows = fixture()
    got = {(r.vec_id, r.component): r.whitened for r in W.whiten(frame(spark, rows, 5)).where("vec_id < 300").collect()}
    x = np.floor(256 * np.array([v for _, v in rows[:300]], np.float32).astype(float))
    for k in range(1, 5):
        w = np.array([got[i, k] for i in range(300)])
        direction = np.linalg.lstsq(x - x.mean(axis=0), w - w.mean(), rcond=None)[0]
        assert np.abs((x - x.mean(axis=0)) @ direction - (w - w.mean())).max() < 1e-6


def test_degenerate_inputs(spark):
    assert W.whiten(frame(spark, [(1, [1.0])]).where("vec_id > 1")).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    # Points on a line, and another length with a model of its own.
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)] + [(100, [1.0]), (101, [3.0])]
    got = W.whiten(frame(spark, line)).collect()
    assert {(r.component, r.whitened is None, round(r.explained, 9)) for r in got if r.vec_id < 100} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert sorted((r.vec_id, r.n, abs(r.whitened)) for r in got if r.vec_id >= 100) == [(100, 2, 1.0), (101, 2, 1.0)]


def test_very_large_components(spark):
    rows = [(i, [3e38 if i == 0 else float(i), float(i % 3)]) for i in range(9)]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 18 and all(r.deviation is None for r in got if r.vec_id == 0)
    assert all(np.isfinite(r.whitened) for r in got if r.component == 1)
    assert W.exact_sums(np.full((5, 1), np.iinfo(np.int64).max)).tolist() == [5 * (2**63 - 1)]
