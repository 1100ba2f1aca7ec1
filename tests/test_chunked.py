import numpy as np
import pytest

from voltlake.functions import kernels
from voltlake.operators import chunked, ica
from voltlake.sources import recordings

RATE = 128.0


def signals(spark, lengths=(1000, 37, 5, 1), size=65_536, seed=3):
    rng = np.random.default_rng(seed)
    rows = {(f"f{n}", c): 1e-5 * (rng.normal(size=n).cumsum() * 0.1 + rng.normal(size=n) + k) for n in lengths for k, c in enumerate(("C3", "C4"))}
    frame = spark.createDataFrame([(f, RATE, c, x.tolist()) for (f, c), x in rows.items()], "filename string, sfreq double, channel string, samples array<double>")
    return rows, recordings.chunked(frame, size).repartition(3)


def put_together(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.start):
        out.setdefault((r.filename, r.channel), []).append(r.samples)
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 65_536])
def test_symmetric_filters_equal_plain_convolution(spark, size):
    rows, chunks = signals(spark, (1000, 37, 5, 1) if size > 1 else (37, 5, 1), size)
    h = kernels.fir_bandpass_taps(RATE, 1.0, 40.0)
    got = put_together(chunked.fir_bandpass(chunks, 1.0, 40.0, error=None))
    assert got.keys() == rows.keys()
    for k, x in rows.items():
        half, n = (len(h) - 1) // 2, len(x)
        reach = min(half, n - 1)
        wide = np.concatenate((np.zeros(half - reach), 2 * x[0] - x[1 : reach + 1][::-1], x, 2 * x[-1] - x[-2 : -reach - 2 : -1] if reach else x[:0], np.zeros(half - reach)))
        want = np.convolve(wide, h, "valid")
        assert len(got[k]) == n and np.abs(got[k] - want).max() <= 1e-12 * max(1e-5, np.abs(wide).max()) * 10
        assert np.allclose(got[k], kernels.fir_bandpass(x, RATE, 1.0, 40.0), atol=1e-16)


def test_a_band_that_is_none_leaves_samples_and_says_so(spark):
    rows, chunks = signals(spark, (300,), 64)
    out = chunked.fir_bandpass(chunks, 1.0, 64.0)
    assert all("Nyquist" in r.bandpass_error for r in out.collect())
    got = put_together(out)
    assert all(np.array_equal(got[k], x) for k, x in rows.items())
    notched = put_together(chunked.notch(chunks, 50.0))
    assert all(np.allclose(notched[k], kernels.notch(x, RATE, 50.0), atol=1e-16) for k, x in rows.items())


def cut(spark, lengths, size):
    """Segments of all samples but the first three and the last two, and of the first 40."""
    rows, chunks = signals(spark, lengths, size)
    parts = [(f"f{n}", "all", 3, n - 5) for n in lengths] + [(f"f{n}", "start", 0, 40) for n in lengths]
    own = chunked.pieces(chunks, spark.createDataFrame(parts, "filename string, task string, start_idx bigint, n_samples bigint"))
    wanted = {(f, task, c): x[a : a + m] for (f, c), x in rows.items() for f2, task, a, m in parts if f == f2}
    return wanted, own


@pytest.mark.parametrize("size", [7, 64, 333, 65_536])
@pytest.mark.parametrize(("low", "high", "order"), [(0.5, 4.0, 5), (8.0, 13.0, 4), (30.0, 49.0, 5)])
def test_recursive_filters_equal_the_unsplit_one(spark, size, low, high, order):
    wanted, own = cut(spark, (1000, 200), size)
    rows = sorted(chunked.subband(own, low, high, order).collect(), key=lambda r: r.start)
    got = {}
    for r in rows:
        assert r.filter_error is None
        got.setdefault((r.filename, r.task, r.channel), []).append(r.samples)
    assert got.keys() == wanted.keys()
    for k, x in wanted.items():
        y = np.concatenate(got[k])
        want = kernels.bandpass(x, RATE, low, high, order)
        assert np.abs(y - want).max() <= 1e-9 * np.abs(want).max()


def test_features_equal_those_of_whole_segments(spark):
    wanted, own = cut(spark, (1000, 37), 50)
    bands = {"Delta": (0.5, 4.0), "Beta": (13.0, 30.0), "None": (60.0, 70.0)}
    got = {(r.filename, r.task, r.channel, r.subband): r for r in chunked.subband_moments(own, bands, clamp=False).collect()}
    assert len(got) == 3 * len(wanted)
    for k, x in wanted.items():
        for name, limits in bands.items():
            r = got[(*k, name)]
            try:
                y = kernels.bandpass(x, RATE, *limits, clamp=False)
            except ValueError as e:
                assert (r.mav, r.variance, r.std, r.reason) == (None, None, None, str(e))
                continue
            assert np.allclose((r.mav, r.variance, r.std), (np.abs(y).mean(), y.var(), y.std()), rtol=1e-9) and r.reason is None
    back = {(r.filename, r.task, r.channel): np.array(r.samples) for r in chunked.segments(own).collect()}
    assert all(np.array_equal(back[k], x) for k, x in wanted.items())


def test_empty_input(spark):
    _, chunks = signals(spark)
    none = chunks.where("filename = ''")
    assert chunked.fir_bandpass(none, 1.0, 40.0).collect() == []
    assert chunked.subband_moments(chunked.pieces(none, spark.createDataFrame([], "filename string, task string, start_idx bigint, n_samples bigint"))).collect() == []


def test_a_scan_forgets_what_is_long_past():
    """Far beyond the memory of a filter, states come from the last samples only."""
    b = chunked.Band(RATE, 8.0, 13.0, 5, True)
    x = np.random.default_rng(1).normal(size=(1, 5 * b.memory))
    y, z = b.run(x, b.zeros(1))
    assert np.allclose(b.run(x[:, -b.memory :], b.zeros(1))[1], z, atol=1e-12)
    assert np.array_equal(b.turned(b.memory), b.turned(10 * b.memory))


def mixture(seed, n=3000, names=("Fp1", "F7", "C3", "C4", "T7", "O1", "O2"), eye=300.0):
    rng = np.random.default_rng(seed)
    blink = np.zeros(n)
    blink[np.arange(100, n - 60, 300)[:, None] + np.arange(40)] = np.hanning(40)
    k = len(names)
    sources = rng.laplace(size=(k - 1, n)).cumsum(axis=1) * 0.05 + rng.laplace(size=(k - 1, n))
    return 1e-5 * (rng.normal(size=(k, k - 1)) @ sources + np.outer(np.where([c.startswith("F") for c in names], eye, 0.5), blink))


@pytest.mark.parametrize("muscles", [True, False])
def test_components_by_sums_equal_those_of_one_task(spark, muscles):
    names = ["Fp1", "F7", "C3", "C4", "T7", "O1", "O2"]
    given = {"a": (names, mixture(1)), "b": (names, mixture(2, n=2000)), "c": (["C3", "Cz"], mixture(3)[2:4]), "d": (["C3"], mixture(4)[:1])}
    frame = spark.createDataFrame([(f, RATE, c, x.tolist()) for f, (cs, xs) in given.items() for c, x in zip(cs, xs)], "filename string, sfreq double, channel string, samples array<double>")
    chunks = recordings.chunked(frame, 700)
    by_sums = put_together(ica.clean_long(chunks, muscles=muscles))
    one_task = put_together(ica.clean(chunks, muscles=muscles))
    parted = put_together(ica.clean(chunks, most=7 * 2500, muscles=muscles))
    changed = 0
    for f, (cs, xs) in given.items():
        for c, x in zip(cs, xs):
            changed += not np.allclose(one_task[f, c], x)
            if not muscles:  # the power of sources is looked at in chunks, which are shorter here
                assert np.abs(by_sums[f, c] - one_task[f, c]).max() <= 1e-6 * np.abs(x).max()
                assert np.abs(parted[f, c] - one_task[f, c]).max() <= 1e-6 * np.abs(x).max()
            assert len(by_sums[f, c]) == len(x)
    assert changed >= 7
    untouched = put_together(ica.clean_long(chunks, detect=False))
    assert all(np.array_equal(untouched[f, c], x) for f, (cs, xs) in given.items() for c, x in zip(cs, xs))


def test_outliers_are_looked_for_again():
    scores = np.array([0.0] * 30 + [0.01] * 30 + [0.3, 5.0])
    assert np.flatnonzero(kernels.outliers(scores)).tolist() == [60, 61]
    assert np.flatnonzero(kernels.outliers(scores, rounds=1)).tolist() == [61]
