"""Filters over recordings in chunks: results are those of the whole signal, whatever the size of a chunk.

Chunks: filename, sfreq, n_samples, channel, chunk, start, samples (voltlake.sources.recordings.signals). Pieces of segments,
as `pieces` cuts them: filename, task, channel, sfreq, n_samples (of the segment), piece, start (within it), samples.

Symmetric filters take the samples that they need beyond a chunk from its neighbours (overlap-save). Recursive filters hand
their states over: each piece says how it changes a state that enters it, a scan composes these changes along the
segment, forward and then backward, and each piece is filtered from the states that enter it at both ends. Only states go between
tasks in that scan, some thirty numbers a piece and band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.config import AMPLITUDE_UV, SUBBANDS
from voltlake.functions import kernels
from voltlake.operators.batches import arrays as _arrays
from voltlake.operators.batches import lists as _lists

Taps = Callable[[float], np.ndarray]
_CHUNK = "filename string, sfreq double, n_samples bigint, channel string, chunk bigint, start bigint, samples array<double>"
_CHUNK_COLUMNS = [c.split()[0] for c in _CHUNK.split(", ")]


def overlap_save(window: np.ndarray, begin: int, start: int, length: int, n: int, h: np.ndarray) -> np.ndarray:
    """Output samples [start, start + length) of a symmetric filter over a signal of n samples, of which `window` has those
    from `begin` on that are within half a filter of them. Ends are extended as `kernels.fir_zero_phase` does."""
    half = (len(h) - 1) // 2
    reach, first, last = min(half, n - 1), start - half, start + length + half
    parts = []
    if first < 0:
        p = np.arange(-first, 0, -1)
        parts.append(np.where(p <= reach, 2 * window[0] - window[np.minimum(p, reach) - begin], 0.0))
    parts.append(window[max(first, 0) - begin : min(last, n) - begin])
    if last > n:
        p = np.arange(1, last - n + 1)
        end = n - 1 - begin
        parts.append(np.where(p <= reach, 2 * window[end] - window[end - np.minimum(p, reach)], 0.0))
    x = np.concatenate(parts)
    size = 1 << (len(x) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[2 * half : 2 * half + length]


Reach = Callable[[float], tuple[int, int]]
_WINDOW = "filename string, sfreq double, n_samples bigint, channel string, chunk bigint, size bigint, begin bigint, part array<double>"


def with_neighbours(chunks: DataFrame, reach: Reach) -> DataFrame:
    """filename, sfreq, n_samples, channel, chunk, start, length, begin, window: chunks [start, start + length) with the samples
    before and after them, as many as `reach` says for a sampling rate (as far as there are some); window[0] is sample `begin`.

    Each chunk sends its ends to those that need them, however many these are; no channel is in one task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, to, begins, parts, sizes = [], [], [], [], []
            columns = {c: batch.column(c).to_pylist() for c in ("sfreq", "n_samples", "chunk", "start")}
            for i, x in enumerate(_arrays(batch.column("samples"))):
                sfreq, n, chunk, start = (columns[c][i] for c in ("sfreq", "n_samples", "chunk", "start"))
                before, after = reach(sfreq)
                # A chunk's number times the length of chunks is its start.
                size = start // chunk if chunk else max(1, len(x))
                for t in range(max(0, (start - after) // size), min((n - 1) // size, (start + len(x) - 1 + before) // size) + 1):
                    a, b = max(start, t * size - before), min(start + len(x), (t + 1) * size + after)
                    if a < b:
                        take.append(i)
                        to.append(t)
                        begins.append(a)
                        parts.append(x[a - start : b - start])
                        sizes.append(size)
            own = batch.select(["filename", "sfreq", "n_samples", "channel"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(to, pa.int64()), pa.array(sizes, pa.int64()), pa.array(begins, pa.int64()), _lists(parts)], [c.split()[0] for c in _WINDOW.split(", ")])

    dealt = chunks.select(*_CHUNK_COLUMNS).mapInArrow(deal, _WINDOW)
    ordered = F.array_sort(F.collect_list(F.struct("begin", "part")))
    met = dealt.groupBy("filename", "sfreq", "n_samples", "channel", "chunk", "size").agg(ordered.alias("parts"))
    start = F.col("chunk") * F.col("size")
    return met.select(
        *("filename", "sfreq", "n_samples", "channel", "chunk"),
        start.alias("start"),
        F.least(F.col("size"), F.col("n_samples") - start).alias("length"),
        F.col("parts")[0]["begin"].alias("begin"),
        F.flatten(F.transform("parts", lambda p: p["part"])).alias("window"),
    )


def symmetric(chunks: DataFrame, taps: Taps, error: str | None = None) -> DataFrame:
    """A zero-phase filter, with a symmetric impulse response for each sampling rate, over the whole of each channel.

    Where there is no filter for a rate (ValueError), samples stay as they are, and `error`, if named, says why.
    """
    made: dict[float, tuple[np.ndarray | None, str | None]] = {}

    def filter_of(sfreq: float) -> tuple[np.ndarray | None, str | None]:
        if sfreq not in made:
            try:
                made[sfreq] = taps(sfreq), None
            except ValueError as e:
                made[sfreq] = None, str(e)
        return made[sfreq]

    def reach(sfreq: float) -> tuple[int, int]:
        h, _ = filter_of(sfreq)
        return (0, 0) if h is None else ((len(h) - 1) // 2,) * 2

    def convolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sfreq", "n_samples", "start", "length", "begin")]
            out, why = [], []
            for window, sfreq, n, start, length, begin in zip(_arrays(batch.column("window")), *columns, strict=True):
                h, error_ = filter_of(sfreq)
                why.append(error_)
                out.append(window if h is None else overlap_save(window, begin, start, length, n, h))
            given = [batch.column(c) for c in ("filename", "sfreq", "n_samples", "channel", "chunk", "start")]
            yield pa.RecordBatch.from_arrays([*given, _lists(out), *([pa.array(why, pa.string())] if error else [])], [*_CHUNK_COLUMNS, *([error] if error else [])])

    return with_neighbours(chunks, reach).mapInArrow(convolve, _CHUNK + (f", `{error}` string" if error else ""))


def psd(chunks: DataFrame, fmin: float = 0.0, fmax: float = 60.0, size: int = 256, epsilon: float = 1e-20) -> DataFrame:
    """filename, channel, freq, db: Welch density in decibel (kernels.welch), as sums over the segments that begin in each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("sfreq", "n_samples", "start", "length", "begin")]
            take, freqs, sums, counts = [], [], [], []
            for i, (x, sfreq, n, start, length, begin) in enumerate(zip(_arrays(batch.column("window")), *columns, strict=True)):
                own = min(size, n)
                first = -(-start // own) * own
                last = min((start + length - 1) // own, n // own - 1)
                count = last - first // own + 1
                if count > 0:
                    f, density = kernels.welch(x[first - begin : first - begin + count * own], sfreq, size)
                    keep = (f >= fmin) & (f <= fmax)
                    take += [i] * int(keep.sum())
                    freqs.append(f[keep])
                    sums.append(density[keep] * count)
                    counts.append(np.full(int(keep.sum()), count))
            own_ = batch.select(["filename", "channel"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own_.columns, *(pa.array(np.concatenate([*c, np.zeros(0)]).astype(t)) for c, t in ((freqs, np.float64), (sums, np.float64), (counts, np.int64)))], ["filename", "channel", "freq", "total", "n"])

    parts = with_neighbours(chunks, lambda _: (0, size - 1)).mapInArrow(run, "filename string, channel string, freq double, total double, n bigint")
    db = 10 * F.log10(F.sum("total") / F.sum("n") + F.lit(epsilon))
    return parts.groupBy("filename", "channel", "freq").agg(F.coalesce(db, F.lit(float("-inf"))).alias("db"))


def psd_by_treatment(chunks: DataFrame, low: float = 1.0, high: float = 40.0, freq: float = 50.0, fmin: float = 0.0, fmax: float = 60.0) -> DataFrame:
    """psd of the raw signal, of its band-pass, and of that after a notch, as `treatment`."""
    each = {"raw": chunks, "bandpass": fir_bandpass(chunks, low, high, error=None), "notch_bandpass": fir_bandpass(notch(chunks, freq), low, high, error=None)}
    frames = [psd(s, fmin, fmax, epsilon=0.0).withColumn("treatment", F.lit(name)) for name, s in each.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def fir_bandpass(chunks: DataFrame, low: float, high: float, error: str | None = "bandpass_error") -> DataFrame:
    return symmetric(chunks, lambda sfreq: kernels.fir_bandpass_taps(sfreq, low, high), error)


def notch(chunks: DataFrame, freq: float = 50.0, error: str | None = None) -> DataFrame:
    return symmetric(chunks, lambda sfreq: kernels.notch_taps(sfreq, freq), error)


def clip_amplitude(chunks: DataFrame, max_uv: float = AMPLITUDE_UV) -> DataFrame:
    limit = F.lit(max_uv * 1e-6)
    return chunks.withColumn("samples", F.transform("samples", lambda x: F.greatest(F.least(x, limit), -limit)))


def pieces(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments (filename, task, start_idx, n_samples; one for a recording's task) cut out of chunks; a piece is what one chunk
    holds of a segment. A segment ends with its recording at the latest. Other columns of chunks go along.

    Recordings meet their few segments in a join; no sample is a row.
    """
    more = [c for c in chunks.columns if c not in _CHUNK_COLUMNS]
    cut = segments.select("filename", "task", F.col("start_idx").alias("first"), F.col("n_samples").alias("length"))
    rows = chunks.join(cut, "filename").withColumn("length", F.least("length", F.col("n_samples") - F.col("first")))
    begin, end = F.greatest("start", "first"), F.least(F.col("start") + F.size("samples"), F.col("first") + F.col("length"))
    rows = rows.withColumns({"begin": begin, "end": end}).where("begin < end")
    size = F.col("end") - F.col("begin")
    return rows.select("filename", "task", "channel", "sfreq", F.col("length").alias("n_samples"), F.col("chunk").alias("piece"), (F.col("begin") - F.col("first")).alias("start"), F.slice("samples", (F.col("begin") - F.col("start") + 1).cast("int"), size.cast("int")).alias("samples"), *more)


def segments(own: DataFrame) -> DataFrame:
    """_KEY, sfreq, samples: the pieces of each segment put together, a channel in one row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "samples")))
    return own.groupBy(*_KEY, "sfreq").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


# ---- recursive filters


class Band:
    """A band-pass at one sampling rate, as a linear system: how states change along samples."""

    def __init__(self, sfreq: float, low: float, high: float, order: int, clamp: bool) -> None:
        self.sections = kernels.bandpass_sections(sfreq, low, high, order, clamp)
        self.pad = kernels.extension(order)
        self.states = 2 * len(self.sections)
        self.steady = kernels.steady_state(self.sections)
        self._step = self.run(np.zeros((self.states, 1)), np.eye(self.states))[1].T
        self._powers: dict[int, np.ndarray] = {}
        self._turned: dict[int, np.ndarray] = {}
        # After so many samples nothing is left of a state.
        self.memory = 256
        while np.abs(self.power(self.memory)).max() > 1e-18 and self.memory < 1 << 22:
            self.memory *= 2

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return kernels.run_sections(self.sections, x, z)

    def zeros(self, rows: int) -> np.ndarray:
        return np.zeros((rows, self.states))

    def power(self, n: int) -> np.ndarray:
        """What n samples of silence make of a state."""
        if n not in self._powers:
            self._powers[n] = np.linalg.matrix_power(self._step, n)
        return self._powers[n]

    def turned(self, n: int) -> np.ndarray:
        """The state that a backward run ends with over what a state at the start leaves in n samples."""
        n = min(n, self.memory)
        if n not in self._turned:
            left = self.run(np.zeros((self.states, n)), np.eye(self.states))[0]
            self._turned[n] = self.run(left[:, ::-1], self.zeros(self.states))[1].T
        return self._turned[n]


@lru_cache(maxsize=256)
def band(sfreq: float, low: float, high: float, order: int, clamp: bool) -> Band | str:
    """The filter, or why there is none."""
    try:
        return Band(sfreq, low, high, order, clamp)
    except ValueError as e:
        return str(e)


Bands = dict[str, tuple[float, float]]
_KEY = ["filename", "task", "channel"]


def scan(b: Band, lengths: list[int], forward: np.ndarray, backward: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States that enter each piece from its start, and, in the backward run, from its end.

    forward, backward: the states after each piece from none, of the forward run, and of a backward run over its output;
    head, tail: the first and last pad + 1 samples of the segment, as it is.
    """
    left, right = 2 * head[0] - head[:0:-1], 2 * tail[-1] - tail[-2::-1]
    _, z = b.run(left[None], left[:1, None] * b.steady)
    enter = np.empty((len(lengths), b.states))
    for i, n in enumerate(lengths):
        enter[i] = z[0]
        z = enter[i : i + 1] @ b.power(n).T + forward[i]
    y, _ = b.run(right[None], z)
    _, z = b.run(y[:, ::-1], y[:, -1:] * b.steady)
    back = np.empty_like(enter)
    for i in range(len(lengths) - 1, -1, -1):
        back[i] = z[0]
        z = back[i : i + 1] @ b.power(lengths[i]).T + backward[i] + enter[i] @ b.turned(lengths[i]).T
    return enter, back


def _states(own: DataFrame, bands: Bands, order: int, clamp: bool) -> DataFrame:
    """_KEY, piece, states: of each band those that enter a piece from both ends, or null and `reasons` why not."""
    pad = kernels.extension(order)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, n, start = _arrays(batch.column("samples")), batch.column("n_samples").to_pylist(), batch.column("start").to_pylist()
            rates = batch.column("sfreq").to_pylist()
            changes = [[] for _ in arrays]
            alike: dict[tuple[float, int], list[int]] = {}
            for i, x in enumerate(arrays):
                alike.setdefault((rates[i], len(x)), []).append(i)
            for (sfreq, _), some in alike.items():
                x = np.stack([arrays[i] for i in some])
                for limits in bands.values():
                    f = band(sfreq, *limits, order, clamp)
                    if isinstance(f, str):
                        continue
                    y, forward = f.run(x, f.zeros(len(x)))
                    _, backward = f.run(y[:, ::-1], f.zeros(len(x)))
                    for k, i in enumerate(some):
                        changes[i] += [forward[k], backward[k]]
            heads = [x[: max(0, pad + 1 - s)] for x, s in zip(arrays, start, strict=True)]
            tails = [x[max(0, m - pad - 1 - s) :] for x, s, m in zip(arrays, start, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*_KEY, "sfreq", "n_samples", "piece")), pa.array([len(x) for x in arrays], pa.int64()), _lists([np.concatenate([*c, np.zeros(0)]) for c in changes]), _lists(heads), _lists(tails)],
                [*_KEY, "sfreq", "n_samples", "piece", "length", "changes", "head", "tail"],
            )

    def hand_over(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", ignore_index=True)
        n, sfreq, lengths = int(group["n_samples"][0]), float(group["sfreq"][0]), group["length"].tolist()
        head, tail = (np.concatenate(group[c].tolist()) for c in ("head", "tail"))
        at, states, reasons = 0, [np.zeros((len(group), 0))], []
        for limits in bands.values():
            f = band(sfreq, *limits, order, clamp)
            if isinstance(f, str):
                reasons.append(f)
                continue
            forward, backward = (np.array([c[at + k * f.states : at + (k + 1) * f.states] for c in group["changes"]]) for k in (0, 1))
            at += 2 * f.states
            if n <= pad:
                reasons.append(f"a signal of {n} samples is too short for an extension of {pad}")
                continue
            reasons.append(None)
            states += scan(f, lengths, forward, backward, head, tail)
        out = group[[*_KEY, "piece"]].copy()
        out["states"] = list(np.concatenate(states, axis=1))
        out["reasons"] = [reasons] * len(out)
        return out

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    key = ", ".join(f"{c} {kinds[c]}" for c in _KEY)
    changes = own.select(*_KEY, "sfreq", "n_samples", "piece", "start", "samples").mapInArrow(change, f"{key}, sfreq double, n_samples bigint, piece bigint, length bigint, changes array<double>, head array<double>, tail array<double>")
    return changes.groupBy(*_KEY).applyInPandas(hand_over, f"{key}, piece bigint, states array<double>, reasons array<string>")


def _filtered(own: DataFrame, bands: Bands, order: int, clamp: bool, schema: str, each: Callable, names: list[str]) -> DataFrame:
    """`each` (batch, outputs) over pieces; outputs: of each row and band, the band's filtered samples or None, and the reason."""
    states = _states(own, bands, order, clamp)
    met = own.join(states, [*_KEY, "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, entering, reasons = _arrays(batch.column("samples")), _arrays(batch.column("states")), batch.column("reasons").to_pylist()
            rates = batch.column("sfreq").to_pylist()
            outputs: list[list] = [[None] * len(bands) for _ in arrays]
            alike: dict[tuple, list[int]] = {}
            for i, x in enumerate(arrays):
                alike.setdefault((rates[i], len(x), tuple(reasons[i])), []).append(i)
            for (sfreq, _, why), some in alike.items():
                x, z, at = np.stack([arrays[i] for i in some]), np.stack([entering[i] for i in some]), 0
                for k, limits in enumerate(bands.values()):
                    if why[k] is None:
                        f = band(sfreq, *limits, order, clamp)
                        y, _ = f.run(x, z[:, at : at + f.states])
                        y = f.run(y[:, ::-1], z[:, at + f.states : at + 2 * f.states])[0][:, ::-1]
                        at += 2 * f.states
                        for j, i in enumerate(some):
                            outputs[i][k] = y[j]
            yield from each(batch, outputs, reasons)

    return met.select(*names, "sfreq", "samples", "states", "reasons").mapInArrow(run, schema)


def subband(own: DataFrame, low: float, high: float, order: int = 5, clamp: bool = True, error: str = "filter_error") -> DataFrame:
    """Pieces through a zero-phase Butterworth band-pass of their segments; what is too short stays as it is, and `error` says why."""
    names = [c for c in own.columns if c not in ("samples", "sfreq")]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}

    def each(batch: pa.RecordBatch, outputs: list[list], reasons: list[list]) -> Iterator[pa.RecordBatch]:
        out = [x if o[0] is None else o[0] for x, o in zip(_arrays(batch.column("samples")), outputs, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("sfreq"), _lists(out), pa.array([r[0] for r in reasons], pa.string())], [*names, "sfreq", "samples", error])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", sfreq double, samples array<double>, `{error}` string"
    return _filtered(own, {"": (low, high)}, order, clamp, schema, each, names)


def subband_moments(own: DataFrame, bands: Bands | None = None, order: int = 5, clamp: bool = True) -> DataFrame:
    """_KEY and any column besides those of pieces, subband, mav, variance, std, reason: of each segment's filtered signal, merged from its pieces."""
    bands = bands or SUBBANDS
    more = [c for c in own.columns if c not in (*_KEY, "sfreq", "n_samples", "piece", "start", "samples")]
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    names = [*_KEY, *more]

    def each(batch: pa.RecordBatch, outputs: list[list], reasons: list[list]) -> Iterator[pa.RecordBatch]:
        take, rows = [], []
        for i, (out, why) in enumerate(zip(outputs, reasons, strict=True)):
            for name, y, r in zip(bands, out, why, strict=True):
                take.append(i)
                rows.append((name, len(y), float(np.abs(y).sum()), float(y.mean()), float(((y - y.mean()) ** 2).sum()), None) if y is not None else (name, 0, 0.0, 0.0, 0.0, r))
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(take, pa.int64())) for c in names), *columns], [*names, "subband", "n", "total", "middle", "spread", "reason"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", subband string, n bigint, total double, middle double, spread double, reason string"
    parts = _filtered(own, bands, order, clamp, schema, each, names)
    n, mean = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("middle")), F.sum("n"))
    merged = parts.groupBy(*names, "subband").agg(
        F.try_divide(F.sum("total"), n).alias("mav"),
        # Filtered pieces have means near 0, so nothing is lost in the difference.
        F.when(n > 0, F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col("spread") + F.col("n") * F.col("middle") ** 2), n) - mean**2)).alias("variance"),
        F.max("reason").alias("reason"),
    )
    return merged.select(*names, "subband", "mav", "variance", F.sqrt("variance").alias("std"), "reason")
