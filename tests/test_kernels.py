import math

import numpy as np
import pytest

from voltlake.functions import kernels as K
from voltlake.functions import pvalues as P


def tone(freq, sfreq=128.0, n=1024):
    return np.sin(2 * np.pi * freq * np.arange(n) / sfreq)


def gain(y, x):
    middle = slice(len(x) // 4, 3 * len(x) // 4)
    return np.std(y[middle]) / np.std(x[middle])


@pytest.mark.parametrize(("low", "high"), [(0.5, 4), (8, 13), (13, 30), (30, 49)])
@pytest.mark.parametrize("order", [4, 5])
def test_butterworth_passes_its_band_at_unit_gain_and_halves_power_at_the_edges(low, high, order):
    sections = K.butter_sections(order, 2 * low / 128, 2 * high / 128)
    response = lambda f: abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sections for z in [np.exp(2j * np.pi * f / 128)]]))
    assert math.isclose(response(low), math.sqrt(0.5), rel_tol=1e-6)
    assert math.isclose(response(high), math.sqrt(0.5), rel_tol=1e-6)
    assert math.isclose(response(math.sqrt(low * high)), 1, rel_tol=2e-2)
    assert all(abs(r) < 1 for s in sections for r in np.roots(s[3:]))


def test_a_section_equals_its_recursion():
    rng = np.random.default_rng(0)
    (s, *_) = K.butter_sections(5, 0.1, 0.3)
    x, z = rng.normal(size=(3, 300)), rng.normal(size=(3, 2))
    want, z1, z2 = np.empty_like(x), z[:, 0].copy(), z[:, 1].copy()
    for i in range(300):
        want[:, i] = s[0] * x[:, i] + z1
        z1 = s[1] * x[:, i] - s[4] * want[:, i] + z2
        z2 = s[2] * x[:, i] - s[5] * want[:, i]
    got, after = K._run_section(s, x, z)
    assert np.allclose(got, want) and np.allclose(after, np.stack([z1, z2], axis=1))


def test_zero_phase_filters_are_linear_even_and_selective():
    x, y = tone(10), tone(40)
    f = lambda v: K.bandpass(v, 128, 8, 13)
    assert np.allclose(f(2 * x + y), 2 * f(x) + f(y))
    assert np.allclose(f(x[::-1])[200:-200], f(x)[::-1][200:-200], atol=1e-3)
    assert abs(gain(f(x), x) - 1) < 0.02 and gain(f(y), y) < 1e-3
    assert np.allclose(f(np.stack([x, y])), np.stack([f(x), f(y)]))
    with pytest.raises(ValueError):
        f(x[:33])
    with pytest.raises(ValueError):
        K.bandpass(x, 60, 13, 30, clamp=False)


def test_fir_bandpass_and_notch():
    b = lambda v: K.fir_bandpass(v, 128, 1, 40)
    n = lambda v: K.notch(v, 128, 50)
    assert abs(gain(b(tone(10)), tone(10)) - 1) < 0.02 and gain(b(tone(60)), tone(60)) < 0.01 and abs(b(np.ones(1024))[512]) < 0.02
    assert gain(n(tone(50)), tone(50)) < 0.03 and abs(gain(n(tone(40)), tone(40)) - 1) < 0.02 and abs(n(np.ones(1024))[512] - 1) < 1e-6
    assert len(b(tone(10, n=20))) == 20


def test_spectrum_of_a_tone():
    freqs, power = K.spectrum(tone(10, n=128), 128)
    mean, share, peak = K.band_features(freqs, power, 8, 13)
    assert peak == 10 and share > 0.999 and mean > 0
    assert K.band_features(freqs, power, 30.2, 30.4) == (0.0, 0.0, 0.0)
    f, density = K.welch(tone(16, n=4096), 128)
    assert f[density.argmax()] == 16 and abs((density * f[1]).sum() - 0.5) < 0.02


def test_ica_separates_and_takes_out_eye_movements():
    t = np.arange(2000) / 128
    blinks, rhythm = (np.sin(0.7 * t) > 0.97) * 1.0, np.sin(2 * np.pi * 10 * t)
    x = np.stack([blinks * 5 + 0.1 * rhythm, blinks * 0.8 + rhythm, 0.3 * blinks - rhythm * 0.5 + 0.4 * np.sin(2 * np.pi * 17 * t)])
    clean = K.clean_ica(x, ["Fp1", "C3", "O1"])
    assert abs(np.corrcoef(clean[1], blinks)[0, 1]) < 0.15 < abs(np.corrcoef(x[1], blinks)[0, 1])
    assert np.array_equal(K.clean_ica(x[:2], ["Fp1", "C3"]), x[:2])
    assert np.allclose(K.clean_ica(x, ["Fp1", "C3", "O1"], detect=False), x)


def test_pvalues():
    # Exact by listing all arrangements; the t distribution with one and two degrees of freedom has closed forms.
    assert P.mann_whitney(0, 3, 3, 0) == pytest.approx(0.1)
    assert P.mann_whitney(4.5, 3, 3, 6) == 1.0
    assert sum(P._u_counts(4, 6)) == math.comb(10, 4)
    assert P.mann_whitney(10, 20, 20, 0) < 1e-6
    for t in (0.0, 0.5, -2.0, 9.0):
        assert P.student_t(t, 1) == pytest.approx(1 - 2 * math.atan(abs(t)) / math.pi)
        assert P.student_t(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t))
