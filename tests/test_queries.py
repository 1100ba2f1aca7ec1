import math

import numpy as np
import pytest

import __spark_entry__
from tests import oracle
from voltlake.operators import signal, stats
from voltlake.plans import bindings
from voltlake.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    oracle.assert_equal(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, oracle.SF_DIR).count() > 0


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_plan_reads_only_what_it_needs_and_joins_once(spark):
    """Column pruning reaches the scans, and a task delta's sides share one aggregation's keys."""
    plan = QUERIES["feature_table"](spark, oracle.SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "s_name" not in plan and "CartesianProduct" not in plan
    filtered = QUERIES["filter_chain"](spark, oracle.SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert filtered.rfind("Filter") > filtered.find("Aggregate")  # filters on keys go below the aggregation


def test_queries_over_signals_take_all_of_them(spark):
    vectors = spark.read.parquet(f"{oracle.SF_DIR}/embeddings.parquet").count()
    assert QUERIES["psd_treatments"](spark, oracle.SF_DIR).select("channel").distinct().count() == vectors
    assert QUERIES["notebook_long_features"](spark, oracle.SF_DIR).select("filename", "channel").distinct().count() == vectors


def test_ica_takes_out_what_the_eyes_bring(spark):
    """The query's operator on a recording with a blink in frontal channels, against the mixture without it."""
    rng = np.random.default_rng(5)
    n, names = 2048, ["Fp1", "Fp2", "C3", "C4", "O1", "O2"]
    blink = np.zeros(n)
    blink[np.arange(100, n - 60, 300)[:, None] + np.arange(40)] = np.hanning(40)
    clean = np.array([[1, 0.2, 0.1, 0.3], [0.8, 0.5, 0.2, 0.1], [0.1, 1, 0.3, 0.2], [0.2, 0.1, 1, 0.3], [0.3, 0.2, 0.1, 1], [0.1, 0.4, 0.3, 0.9]]) @ rng.laplace(size=(4, n))
    mixed = clean + np.outer([30, 28, 5, 4, 1, 1], blink)
    frame = spark.createDataFrame([("f", 128.0, c, x.tolist()) for c, x in zip(names, mixed)], "filename string, sfreq double, channel string, samples array<double>")
    for muscles in (True, False):
        got = {r.channel: np.array(r.samples) for r in signal.clean_ica(frame, muscles=muscles).collect()}
        before, after = (np.abs(np.corrcoef(x, blink)[0, 1]) for x in (mixed[0], got["Fp1"]))
        assert before > 0.9 and after < 0.2
    kept = {r.channel: np.array(r.samples) for r in signal.clean_ica(frame, detect=False).collect()}
    assert all(np.allclose(kept[c], x) for c, x in zip(names, mixed))


def test_pvalues_equal_plain_ones(spark):
    """Mann-Whitney by its normal approximation, Student's t by numeric integration of its density."""
    rows = QUERIES["compare_pvalues"](spark, oracle.SF_DIR).collect()
    cells = {(r.channel, r.subband, r.feature): r for r in stats.group_statistics(stats.compare_rows(bindings.feature_table(spark, oracle.SF_DIR), "A", "R")).collect()}
    checked = 0
    for r in rows:
        c = cells[r.channel, r.subband, r.feature]
        if c.t is None:
            assert r.p_t is None
            continue
        x = np.linspace(0, abs(c.t), 20001)
        density = math.gamma((c.df + 1) / 2) / (math.sqrt(c.df * math.pi) * math.gamma(c.df / 2)) * (1 + x**2 / c.df) ** (-(c.df + 1) / 2)
        assert abs(r.p_t - (1 - 2 * np.trapezoid(density, x))) < 1e-4
        checked += 1
    assert checked > 5
