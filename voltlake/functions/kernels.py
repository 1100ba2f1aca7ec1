"""Signal kernels on NumPy arrays, of one channel or (ICA) one recording; Spark deals them out (`voltlake.operators.signal`)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def butter_sections(order: int, low: float, high: float) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass; edges are fractions of the Nyquist frequency.

    Sections stay stable where the expanded polynomial of a narrow, low band doesn't.
    """
    w1, w2 = (2 * np.tan(np.pi * e / 2) for e in (low, high))
    width, centre = w2 - w1, math.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    analog = np.concatenate((half + root, half - root))
    poles = (2 + analog) / (2 - analog)
    # Pairs of conjugates first, then what is real by twos.
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    denominators = [(1.0, -2 * p.real, abs(p) ** 2) for p in upper] + [(1.0, -(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=True)]
    sections = np.array([[1.0, 0.0, -1.0, *d] for d in denominators])
    z = np.exp(1j * 2 * np.arctan(centre / 2))
    for s in sections:
        gain = abs(np.polyval(s[:3], z) / np.polyval(s[3:], z))
        s[:3] /= gain
    return sections


_BLOCK = 128


@lru_cache(maxsize=512)
def _block(b0: float, b1: float, b2: float, a1: float, a2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a section over up to `_BLOCK` samples: what so many samples make of its states; what a state leaves in each sample; what
    samples make of later ones; and of the states at the end."""
    step, gain = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(_BLOCK):
        powers.append(step @ powers[-1])
    rest = np.array([p[0] for p in powers[:_BLOCK]])
    response = np.concatenate(([b0], rest[:-1] @ gain))
    lag = np.arange(_BLOCK)[:, None] - np.arange(_BLOCK)[None, :]
    within = np.where(lag >= 0, response[np.abs(lag)], 0.0)
    into = np.array([powers[_BLOCK - 1 - j] @ gain for j in range(_BLOCK)])
    return np.array(powers), rest, within, into


def _run_section(s: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section over the last axis of many signals (rows) from the states `z` (two for each), a block of samples at a step;
    and the states after it."""
    powers, rest, within, into = _block(*s[[0, 1, 2, 4, 5]].tolist())
    y = np.empty_like(x)
    for i in range(0, x.shape[1], _BLOCK):
        part = x[:, i : i + _BLOCK]
        n = part.shape[1]
        y[:, i : i + n] = part @ within[:n, :n].T + z @ rest[:n].T
        z = z @ powers[n].T + part @ into[_BLOCK - n :]
    return y, z


def run_sections(sections: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All sections, one after the other, over rows of x from states z (two columns for each section); output and states after it."""
    after = np.empty_like(z)
    for i, s in enumerate(sections):
        x, after[:, 2 * i : 2 * i + 2] = _run_section(s, x, z[:, 2 * i : 2 * i + 2])
    return x, after


def steady_state(sections: np.ndarray) -> np.ndarray:
    """The states that a constant input of 1 leaves unchanged."""
    out, level = [], 1.0
    for s in sections:
        b0, b1, b2, _, a1, a2 = s.tolist()
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * gain
        out += [level * (b1 - a1 * gain + z2), level * z2]
        level *= gain
    return np.array(out)


def odd_extension(x: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """`pad` samples before and after x (last axis), turned about its first and last one."""
    n = x.shape[-1]
    if n <= pad:
        raise ValueError(f"a signal of {n} samples is too short for an extension of {pad}")
    return 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]


def sections_zero_phase(sections: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Forward and backward over the last axis, with an odd extension of `pad` samples and steady initial states."""
    n = x.shape[-1]
    left, right = odd_extension(x, pad)
    y = np.concatenate((left, x, right), axis=-1)
    shape, steady = y.shape, steady_state(sections)
    y = y.reshape(-1, shape[-1])
    for _ in range(2):
        y = run_sections(sections, y, y[:, :1] * steady)[0][:, ::-1]
    return y.reshape(shape)[..., pad : pad + n]


def bandpass(x: np.ndarray, sfreq: float, low: float, high: float, order: int = 5, clamp: bool = True) -> np.ndarray:
    """Zero-phase Butterworth band-pass. `clamp` moves edges into (0, Nyquist); otherwise edges outside raise."""
    return sections_zero_phase(bandpass_sections(sfreq, low, high, order, clamp), x, extension(order))


def extension(order: int) -> int:
    """Samples by which a band-pass of an order extends a signal at each end."""
    return 3 * (2 * order + 1)


def bandpass_sections(sfreq: float, low: float, high: float, order: int = 5, clamp: bool = True) -> np.ndarray:
    a, b = 2 * low / sfreq, 2 * high / sfreq
    if clamp:
        a, b = max(a, 0.001), min(b, 0.999)
    if not 0 < a < b < 1:
        raise ValueError(f"{low}-{high} Hz isn't a band below the Nyquist frequency of {sfreq} Hz")
    return butter_sections(order, a, b)


def firwin(taps: int, edges: list[float], stop: bool = False) -> np.ndarray:
    """Hamming-windowed band-pass (or stop) of odd length; edges are fractions of the Nyquist frequency."""
    k = np.arange(taps) - (taps - 1) / 2
    band = edges[1] * np.sinc(edges[1] * k) - edges[0] * np.sinc(edges[0] * k)
    h = band * np.hamming(taps)
    if stop:
        h = -h
        h[(taps - 1) // 2] += 1
        return h / h.sum()
    return h / abs(np.sum(h * np.exp(-1j * np.pi * k * (edges[0] + edges[1]) / 2)))


def fir_zero_phase(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Symmetric filter over the last axis, its delay removed, the edges extended by reflection as far as there are samples."""
    half = (len(h) - 1) // 2
    reach = min(half, x.shape[-1] - 1)
    left, right = 2 * x[..., :1] - x[..., reach:0:-1], 2 * x[..., -1:] - x[..., -2 : -reach - 2 : -1]
    more = [(0, 0)] * (x.ndim - 1) + [(half - reach, half - reach)]
    y = np.pad(np.concatenate((left, x, right), axis=-1), more)
    size = 1 << (y.shape[-1] + len(h)).bit_length()
    out = np.fft.irfft(np.fft.rfft(y, size) * np.fft.rfft(h, size), size)
    # A view would keep the whole transform.
    return out[..., 2 * half : 2 * half + x.shape[-1]].copy()


def fir_bandpass_taps(sfreq: float, low: float, high: float) -> np.ndarray:
    """Transition widths follow the edges: a quarter of the low one within 2 Hz and itself, likewise up to the Nyquist frequency."""
    if not 0 < low < high < sfreq / 2:
        raise ValueError(f"{low}-{high} Hz isn't a band below the Nyquist frequency of {sfreq} Hz")
    width_low = min(max(low * 0.25, 2.0), low)
    width_high = min(max(high * 0.25, 2.0), sfreq / 2 - high)
    taps = int(math.ceil(3.3 * sfreq / min(width_low, width_high))) | 1
    return firwin(taps, [2 * (low - width_low / 2) / sfreq, 2 * (high + width_high / 2) / sfreq])


def fir_bandpass(x: np.ndarray, sfreq: float, low: float, high: float) -> np.ndarray:
    return fir_zero_phase(fir_bandpass_taps(sfreq, low, high), x)


def notch_taps(sfreq: float, freq: float) -> np.ndarray:
    """A band of a hundredth of its frequency on each side is taken out, transitions of 1 Hz."""
    half = freq / 200 + 0.5
    if not half < freq < sfreq / 2 - half:
        raise ValueError(f"{freq} Hz isn't below the Nyquist frequency of {sfreq} Hz by the width of the notch")
    taps = int(math.ceil(3.3 * sfreq)) | 1
    return firwin(taps, [2 * (freq - half) / sfreq, 2 * (freq + half) / sfreq], stop=True)


def notch(x: np.ndarray, sfreq: float, freq: float) -> np.ndarray:
    return fir_zero_phase(notch_taps(sfreq, freq), x)


def spectrum(x: np.ndarray, sfreq: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and |X|^2 / n of the real transform."""
    n = x.shape[-1]
    return np.fft.rfftfreq(n, 1 / sfreq), np.abs(np.fft.rfft(x)) ** 2 / n


def band_features(freqs: np.ndarray, power: np.ndarray, low: float, high: float) -> tuple[float, float, float]:
    """Mean power, share of all power, and the frequency of most power (the lowest of several) of a band; 0 if it has no bin."""
    inside = (freqs >= low) & (freqs <= high)
    if 2 * (len(freqs) - 1) < 3 or not inside.any():
        return 0.0, 0.0, 0.0
    total = power.sum()
    return float(power[inside].mean()), float(power[inside].sum() / total) if total > 0 else 0.0, float(freqs[inside][power[inside].argmax()])


def welch(x: np.ndarray, sfreq: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and density: Hamming segments without overlap, zero-padded to `size`, their mean removed."""
    own = min(size, x.shape[-1])
    window = np.hamming(own)
    parts = x[: len(x) // own * own].reshape(-1, own)
    density = np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * window, size)) ** 2 / (sfreq * (window**2).sum())
    density[:, 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / sfreq), density.mean(axis=0)


def whitener(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """K and its way back: K @ (x - mean) has unit covariance, of as many leading components as vary. Each direction's largest
    entry is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    keep = min(components, int((values > 1e-20 * values[0]).sum())) if values[0] > 0 else 0
    s, u = np.sqrt(values[:keep]), vectors[:, :keep]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(keep)] < 0, -1.0, 1.0)
    return (u / s).T, u * s


def ica_start(components: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(components, components)))[0]


def ica_moments(w: np.ndarray, white: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a step of symmetric FastICA (tanh) adds up over samples."""
    g = np.tanh(w @ white)
    return g @ white.T, (1 - g**2).sum(axis=1)


def ica_step(w: np.ndarray, products: np.ndarray, slopes: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The next w, and how far it turned."""
    a, _, b = np.linalg.svd(products / n - (slopes / n)[:, None] * w)
    new = a @ b
    return new, float(np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1))) if len(w) else 0.0


def fast_ica(x: np.ndarray, components: int, seed: int = 42, rounds: int = 500, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Sources and the mixing that leads back to (centred) channels, of channels x samples: symmetric FastICA with tanh."""
    centred = x - x.mean(axis=1, keepdims=True)
    k, back = whitener(centred @ centred.T / x.shape[1], components)
    white = k @ centred
    w = ica_start(len(k), seed)
    for _ in range(rounds):
        w, turned = ica_step(w, *ica_moments(w, white), x.shape[1])
        if turned < tolerance:
            break
    return w @ white, back @ w.T


def outliers(scores: np.ndarray, limit: float = 3.0, rounds: int = 2) -> np.ndarray:
    """Which scores are further than `limit` standard deviations from the mean of those that weren't found before."""
    found = np.zeros(len(scores), bool)
    for _ in range(rounds):
        rest = scores[~found]
        if len(rest) < 2 or rest.std() == 0:
            break
        new = ~found & (np.abs(scores - rest.mean()) > limit * rest.std())
        if not new.any():
            break
        found |= new
    return found


#: Samples of a block in which the power of a source is looked at, as many as in a chunk.
POWER_BLOCK = 65_536


def power_above(sources: np.ndarray) -> np.ndarray:
    """Of each source (row) the power in the upper third of frequencies less that in the rest, without a constant."""
    power = np.abs(np.fft.rfft(sources)) ** 2
    cut = power.shape[1] * 2 // 3
    return power[:, cut:].sum(axis=1) - power[:, 1:cut].sum(axis=1)


def artefacts(channels: list[str], correlation: np.ndarray, above: np.ndarray | None, limit: float = 3.0) -> list[int]:
    """Components that go: of eye movement, those whose correlation (components x channels) with a frontal or eye channel stands
    out by `limit` standard deviations, or exceeds 0.9; of muscles, if temporal channels are there and `above` is given, those whose
    power above two thirds of the Nyquist frequency outweighs the rest."""
    found = np.zeros(len(correlation), bool)
    for i, c in enumerate(channels):
        if any(k in c.lower() for k in ("eog", "fp1", "fp2", "f7", "f8")) and len(correlation):
            r = correlation[:, i]
            found |= (np.abs(r) > 0.9) | outliers(r, limit)
    if above is not None and any(c.lower() in ("t7", "t8", "tp9", "tp10") for c in channels):
        found |= above > 0
    return np.flatnonzero(found).tolist()


def clean_ica(x: np.ndarray, channels: list[str], components: int = 15, detect: bool = True, seed: int = 42, muscles: bool = True) -> np.ndarray:
    n = min(components, len(x) - 1)
    if n < 2 or not detect:
        return x
    sources, mixing = fast_ica(x, n, seed)
    spread = x.std(axis=1)
    # Sources have unit variance, so the mixing is their covariance with channels.
    correlation = np.where(spread > 0, mixing.T / np.where(spread > 0, spread, 1), 0.0)
    above = sum(power_above(sources[:, a : a + POWER_BLOCK]) for a in range(0, x.shape[1], POWER_BLOCK)) if muscles else None
    gone = artefacts(channels, correlation, above)
    return x - mixing[:, gone] @ sources[gone] if gone else x
