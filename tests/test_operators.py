import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.operators import align, charts, delta, features, quality, reshape, signal, stats
from voltlake.sources.path import path_metadata

SAMPLES = "filename string, sample_idx bigint, time double, channel string, value double"
NOTES = "filename string, annot_idx int, onset double, duration double, description string"
TABLE = "filename string, category string, subject string, time string, scenario string, task string, channel string, subband string, mav double, variance double, std double"


def samples(spark, n=10, markers=None):
    rows = [("f", i, float(i), "C3", float(i)) for i in range(n)]
    df = spark.createDataFrame(rows, SAMPLES)
    return df if markers is None else df.join(spark.createDataFrame([("f", i, m) for i, m in enumerate(markers)], "filename string, sample_idx bigint, marker string"), ["filename", "sample_idx"])


def test_markers(spark):
    notes = spark.createDataFrame([("f", 0, 2.0, 3.0, "A"), ("f", 1, 4.0, 2.0, "Thinking and Acting"), ("f", 2, 8.5, 0.0, "B")], NOTES)
    got = [r.marker for r in align.mark(samples(spark), notes).orderBy("sample_idx").collect()]
    assert got == ["none", "none", "A", "A", "Think_Acting", "Think_Acting", "none", "none", "B", "none"]


def test_islands_and_segments(spark):
    marked = samples(spark, 9, "A A n A A A B A A".replace("n", "none").split())
    runs = [(r.start_idx, r.end_idx) for r in align.islands(marked).where("task = 'A'").orderBy("occurrence").collect()]
    assert runs == [(0, 1), (3, 5), (7, 8)]
    own = {(r.task, r.occurrence): r.samples for r in align.segments(marked).collect()}
    assert own == {("A", 1): [0, 1], ("A", 2): [3, 4, 5], ("A", 3): [7, 8], ("B", 1): [6]}
    assert {r.task: r.samples for r in align.segments(marked, by_occurrence=False).collect()} == {"A": [0, 1, 3, 4, 5, 7, 8], "B": [6]}
    assert [(r.task, r.n_samples, r.percent_total) for r in align.task_summary(marked, 2.0).collect()] == [("A", 7, 77.8), ("B", 1, 11.1), ("none", 1, 11.1)]


def test_pairs(spark):
    notes = spark.createDataFrame([("f", i, float(i), 1.0, t) for i, t in enumerate(["R", "T", "R", "T"])], NOTES)
    pairs = lambda compat: {(r.occ_a, r.occ_b) for r in align.occurrence_pairs(notes, "R", "T", compat).collect()}
    assert pairs(False) == {(1, 1), (2, 1), (2, 2)} and pairs(True) == {(1, 1), (2, 2)}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6), st.sampled_from("ABC")), max_size=5))
def test_the_last_annotation_that_covers_a_sample_marks_it(spark, notes):
    frame = spark.createDataFrame([("f", i, a / 1.0, b / 1.0, c) for i, (a, b, c) in enumerate(notes)], NOTES)
    want = ["none"] * 10
    for a, b, c in notes:
        for i in range(a, min(10, a + b)) if b else [min(a, 9)]:
            want[i] = c
    assert [r.marker for r in align.mark(samples(spark), frame).orderBy("sample_idx").collect()] == want


def table(spark):
    rows = []
    for i in range(6):
        for task, mav in (("Resting", 2.0 + i), ("Acting", 1.0), ("Typing", 5.0)):
            if not (i == 5 and task == "Typing"):
                rows.append((f"f{i}", "ALS" if i < 3 else "Normal", f"S{i}", "t", "scenario1", task, "C3", "Alpha", mav, mav * mav, mav / 2))
    return spark.createDataFrame(rows, TABLE)


def test_delta_is_antisymmetric_and_erd_is_relative(spark):
    ft = table(spark)
    forth, back = (delta.task_delta(ft, *pair).orderBy("filename").collect() for pair in (("Resting", "Acting"), ("Acting", "Resting")))
    assert [r.delta_mav for r in forth] == [-r.delta_mav for r in back] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    assert "mav_Resting" in delta.named_after_tasks(delta.task_delta(ft, "Resting", "Acting"), "Resting", "Acting").columns
    bare = delta.task_delta(ft.drop("category", "subject"), "Resting", "Acting").orderBy("filename")
    assert "subject" not in bare.columns and [r.delta_mav for r in bare.collect()] == [r.delta_mav for r in forth]
    erd = {r.task: r.erd_ers_pct for r in delta.erd_ers(ft).where("filename = 'f0'").collect()}
    assert erd == {"Acting": -50.0, "Typing": 150.0}
    zero = ft.withColumn("mav", F.when(F.col("task") == "Resting", 0.0).otherwise(F.col("mav")))
    assert {r.erd_ers_pct for r in delta.erd_ers(zero).collect()} == {0.0}
    none = ft.withColumn("mav", F.when(F.col("task") != "Resting", F.col("mav")))
    assert {r.erd_ers_pct for r in delta.erd_ers(none).collect()} == {None}


def test_transitions_leave_out_subjects_without_both_and_give_a_lone_subject_no_error(spark):
    ft = table(spark).where("subject in ('S0', 'S4', 'S5')")
    got = {r.category: (r["mean"], r["sem"], r.n) for r in delta.group_transitions(ft, "Resting", "Typing", "mav").collect()}
    assert got == {"ALS": (3.0, 0.0, 1), "Normal": (-1.0, 0.0, 1)}
    bands = spark.createDataFrame([("Alpha",), ("Beta",)], "subband string")
    rows = {r.subband: r for r in delta.transition_table(ft, "Resting", "Typing", "mav", bands).collect()}
    assert rows["Beta"].als_mean is None and rows["Beta"].als_n == 0 and rows["Alpha"].als_mean == 3.0


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate([0.01, 0.04, 0.04, 0.5, 0.03, None])], "i int, p double")
    got = [r.p_fdr for r in stats.benjamini_hochberg(p).orderBy("i").collect()]
    assert got[:5] == pytest.approx([0.05, 0.05, 0.05, 0.5, 0.05]) and got[5] is None
    assert stats.benjamini_hochberg(p.limit(1)).first().p_fdr is None


def test_normalize(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 7.0)], "subject string, mav double")
    z = [r.mav for r in stats.normalize(rows, ["mav"]).orderBy("subject", "mav").collect()]
    assert z[:2] == pytest.approx([-0.70710678, 0.70710678]) and z[2] is None
    assert sorted(r.mav for r in stats.normalize(rows, ["mav"], "minmax").collect()) == [0.0, 0.0, 1.0]


def test_comparison_and_pvalues(spark):
    ft = table(spark)
    out = stats.with_pvalues(stats.group_statistics(stats.compare_rows(ft, "Acting"))).where("feature = 'mav'").first()
    assert (out.mean_als, out.mean_normal, out.n_als, out.n_normal, out.u) == (-2.0, -5.0, 3, 3, 9.0)
    assert out.p == pytest.approx(0.1) and out.cohend == pytest.approx(3.0) and out.effect == "Besar" and out.t == pytest.approx(3.6742346)
    assert stats.compare_rows(ft, "Acting", mode="zscore").count() == 18 and stats.compare_rows(ft, "Acting", mode="both").count() == 18


def test_bad_channels(spark):
    rows = [("f", i, float(i), c, v * (-1) ** i) for c, v in (("a", 1.0), ("b", 2**0.5), ("c", 3**0.5), ("d", 10.0)) for i in range(4)]
    verdicts = quality.bad_channels(spark.createDataFrame(rows, SAMPLES))
    assert {r.channel: (r.median, r.mad, r.bad) for r in verdicts.collect()} == {c: (pytest.approx(2.5), pytest.approx(1.0), c == "d") for c in "abcd"}
    kept = quality.exclude_bad_channels(spark.createDataFrame(rows, SAMPLES), verdicts)
    assert {r.channel for r in kept.collect()} == set("abc")
    none_left = verdicts.withColumn("bad", F.lit(True))
    assert quality.exclude_bad_channels(spark.createDataFrame(rows, SAMPLES), none_left).count() == 16


def test_ratios_and_bands(spark):
    rows = spark.createDataFrame([("x", "Alpha", 4.0), ("x", "Beta", 2.0), ("x", "Delta", 1.0)], "channel string, subband string, band_power double")
    assert {r.ratio_name: r.value for r in features.band_ratios(rows, ["channel"]).collect()} == {"alpha_beta": 2.0, "theta_alpha": 0.0, "delta_theta": 0.0}
    again = rows.withColumn("at", F.lit(1)).union(rows.withColumns({"band_power": F.col("band_power") / 4, "at": F.lit(2)}).where("subband = 'Alpha'"))
    assert [{r.ratio_name: r.value for r in features.band_ratios(again, ["channel"], order=o).collect()}["alpha_beta"] for o in (None, "at")] == [2.0, 0.5]
    import numpy as np

    tone = np.sin(2 * np.pi * 10 * np.arange(128) / 128).tolist()
    signals = spark.createDataFrame([("f", 128.0, "C3", tone), ("f", 128.0, "C4", tone[:20])], "filename string, sfreq double, channel string, samples array<double>")
    got = {(r.channel, r.subband): r for r in features.subband_features(signals).collect()}
    assert got["C3", "Alpha"].peak_frequency == got["C3", "Mu"].peak_frequency == 10 and got["C3", "Alpha"].relative_power == pytest.approx(1)
    assert got["C3", "Gamma"].mav < 0.01 < got["C3", "Alpha"].mav and got["C4", "Alpha"].mav is None and "too short" in got["C4", "Alpha"].reason
    clipped = signal.clip_amplitude(signals, 5e5).first().samples
    assert max(clipped) == 0.5 and min(clipped) == -0.5
    with pytest.raises(ValueError):
        signal.pick_channels(signals, ["Cz"])


def test_correlation_is_null_where_nothing_varies(spark):
    rows = [("f", i, 0.0, c, v) for i in range(5) for c, v in (("a", float(i)), ("b", -2.0 * i), ("c", 1.0))]
    r = {(x.channel_a, x.channel_b): x.r for x in charts.correlation(spark.createDataFrame(rows, SAMPLES)).collect()}
    assert r["a", "b"] == pytest.approx(-1) and r["a", "a"] == pytest.approx(1) and r["a", "c"] is None


def test_correlation_of_each_recording_over_samples_that_both_channels_have(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for f, n, off in (("f", 300, 0.0), ("g", 50, 1e6), (None, 20, -5.0)):
        x = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 3)) + off
        there = rng.random(size=x.shape) < 0.8
        rows += [(f, i, i / 10, "abc"[c], float(x[i, c])) for i in range(n) for c in range(3) if there[i, c]]
        rows += [(f, 0, 0.0, "a", None), (f, 1, 0.0, "a", float("nan"))]
        for i in range(3):
            for j in range(3):
                both = there[:, i] & there[:, j]
                want[f, "abc"[i], "abc"[j]] = np.corrcoef(x[both, i], x[both, j])[0, 1]
    frame = spark.createDataFrame(rows, SAMPLES).repartition(7)
    got = {(r.filename, r.channel_a, r.channel_b): r.r for r in charts.correlation(frame).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-7) for k, v in want.items())
    assert charts.correlation(frame.where("filename = ''")).collect() == []


def test_quantiles_are_exact_for_any_values(spark):
    rng = np.random.default_rng(0)
    values = {"a": rng.normal(size=501), "b": np.round(rng.normal(size=300) * 1e300), "c": [7.0], None: [1, 1, 1, -0.0, 0.0, 2], "d": [-5e-324, 5e-324, -1e308, float("inf")], "e": [None, float("nan"), 1.0, 2.0], "f": [None]}
    frame = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    at = {"p25": 0.25, "p50": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    got = {r.g: tuple(r)[1:] for r in charts.quantiles(frame, ["g"], "v", at).collect()}
    assert set(got) == set(values) - {"f"}
    for g, q in got.items():
        v = [float(x) for x in values[g] if x is not None and x == x]
        with np.errstate(invalid="ignore", over="ignore"):
            assert np.allclose(q, np.quantile(v, list(at.values())), rtol=1e-12, equal_nan=True) or g == "d"
    assert got["d"][3:] == (-1e308, float("inf"))
    whole = charts.quantiles(frame.where("g = 'a'"), [], "v", at).collect()
    assert np.allclose(whole[0], np.quantile(values["a"], list(at.values())))
    assert charts.quantiles(frame.where("g = 'f'"), ["g"], "v", at).collect() == []


def test_quantiles_hold_no_values_of_a_group(spark):
    plan = charts.quantiles(spark.createDataFrame([("a", 1.0)], "g string, v double"), ["g"], "v", {"m": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan


def test_small_shapes(spark):
    df = spark.createDataFrame([("a/b.edf/x.EDF.edf", "Think_Acting_12", " 1e3 ", -1.0), ("c.edf", "none", "x", 0.0), (None, None, None, None)], "f string, l string, t string, v double")
    r = df.select(reshape.last_part(F.col("f")), *reshape.decoded(F.col("l")).values(), reshape.to_numeric(F.col("t")), reshape.change_role(F.col("v"))).collect()
    assert [tuple(x) for x in r] == [("x.EDF", "Think_Acting", 12, 1000.0, "ERD"), ("c", "", None, None, None), (None, None, None, None, None)]
    assert reshape.column_roles(["filename", "mav_A", "mav_B", "delta_mav", "x"], "A", "B") == {"filename": "meta", "mav_A": "a", "mav_B": "b", "delta_mav": "delta", "x": ""}


def test_micro_units_and_tops(spark):
    df = spark.createDataFrame([("a", 1e-5, 3.0), ("b", -2e-5, -4.0)], "k string, v double, w double")
    assert reshape.micro_units(df).columns == ["k", "v (µ)", "w"]
    assert reshape.top_abs(df, "w", ["k"], 1).first().k == "b"


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("ALS05/time5/scenario4/EEG.edf", ("ALS", "ALS05", "time5", "scenario4")),
        ("My-ALS Dataset/ALS05/time5/scenario4/EEG.edf", ("ALS", "ALS05", "time5", "scenario4")),
        ("id9/time1/scenario4/EEG.edf", ("Normal", "id9", "time1", "scenario4")),
        ("a\\id9\\time1\\scenario4\\EEG.EDF", ("Normal", "id9", "time1", "scenario4")),
        ("ALS/ALS01_time1_scenario1/EEG.edf", ("ALS", "ALS01_time1_scenario1", "", "")),
        ("Normal/id1_time1_scenario1/EEG.edf", ("Normal", "unknown", "", "")),
        ("id3/ALS7/id4/Time2/EEG.edf", ("ALS", "ALS7", "Time2", "")),
        ("id3/id4/x.edf", ("Normal", "id3", "", "")),
    ],
)
def test_path_metadata(spark, path, want):
    r = spark.createDataFrame([(path,)], "p string").select(*(c.alias(n) for n, c in path_metadata(F.col("p")).items())).first()
    assert (r.category, r.subject, r.time, r.scenario) == want


def test_corrected_p_values_leave_columns_of_any_name(spark):
    rows = [("x", 0.01, 1, 2, 3, 4), ("x", 0.04, 5, 6, 7, 8), ("y", 0.5, 9, 10, 11, 12)]
    df = spark.createDataFrame(rows, "by0 string, p double, whole int, n int, low int, __p int")
    out = stats.benjamini_hochberg(df, by=["by0"])
    assert out.columns == [*df.columns, "p_fdr"]
    assert sorted(map(tuple, out.collect())) == [(*rows[0], 0.02), (*rows[1], 0.04), (*rows[2], None)]


def test_deltas_join_tasks_of_whole_keys_only(spark):
    rows = [("f", "C3", "A", "c", "s", "t1", 3.0), ("f", "C3", "A", "c", "s", "t2", 1.0), ("f", "C4", "A", "c", "s", "t1", None), ("f", "C4", "A", "c", "s", "t2", 1.0), ("f", None, "A", "c", "s", "t1", 3.0), ("f", None, "A", "c", "s", "t2", 3.0), ("g", "C3", "A", "c", "s", "t1", 3.0)]
    df = spark.createDataFrame(rows, "filename string, channel string, subband string, category string, subject string, task string, mav double")
    assert sorted((r.filename, r.channel, r.mav_a, r.mav_b, r.delta_mav) for r in delta.task_delta(df, "t1", "t2").collect()) == [("f", "C3", 3.0, 1.0, 2.0), ("f", "C4", None, 1.0, None)]
