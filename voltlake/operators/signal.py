"""Signal operators over (filename, sfreq, channel, samples) rows: kernels run in Arrow batches, a channel each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.config import AMPLITUDE_UV
from voltlake.functions import kernels
from voltlake.operators import batches

Kernel = Callable[[np.ndarray, float], np.ndarray]


def _tried(kernel: Kernel, x: np.ndarray, sfreq: float) -> tuple[np.ndarray, str | None]:
    """What the kernel makes of a signal; or the signal as it is, and why."""
    try:
        return kernel(x, sfreq), None
    except ValueError as e:
        return x, str(e)


def _signals(batch: pa.RecordBatch) -> list[tuple[np.ndarray | None, float]]:
    """Samples (None: null) and rate of each row."""
    column = batch.column("samples")
    rows = [None if null else np.asarray(x, np.float64) for x, null in zip(batches.arrays(column), column.is_null().to_pylist(), strict=True)]
    return list(zip(rows, batch.column("sfreq").to_pylist(), strict=True))


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    made = batches.lists([np.zeros(0) if x is None else x for x in rows])
    return pc.if_else(pa.array([x is not None for x in rows], pa.bool_()), made, pa.scalar(None, made.type))


def _apply(signals: DataFrame, kernel: Kernel, error: str | None = None) -> DataFrame:
    """`samples` through the kernel. What it can't take stays as it is; with `error`, that column says why."""
    names = signals.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema) + (f", `{error}` string" if error else "")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(given):
            done = [(None, None) if x is None else _tried(kernel, x, sfreq) for x, sfreq in _signals(batch)]
            columns = [_lists([x for x, _ in done]) if n == "samples" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([why for _, why in done], pa.string())] if error else columns, [*names, error] if error else names)

    return signals.mapInArrow(run, schema)


def treated(signals: DataFrame, treatments: dict[str, list[Kernel]], name: str) -> DataFrame:
    """Each signal once for each treatment, which `name` tells: `samples` through its kernels, one after the other. What a kernel
    can't take stays as it is. Signals are read once, whatever the number of treatments, by one worker a task."""
    names = signals.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema) + f", `{name}` string"

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(given):
            for treatment, steps in treatments.items():
                out = _treat(_signals(batch), steps)
                columns = [_lists(out) if n == "samples" else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([treatment] * batch.num_rows, pa.string())], [*names, name])

    return signals.mapInArrow(run, schema)


def _treat(rows: list[tuple[np.ndarray | None, float]], steps: list[Kernel]) -> list[np.ndarray | None]:
    for kernel in steps:
        rows = [(x if x is None else _tried(kernel, x, sfreq)[0], sfreq) for x, sfreq in rows]
    return [x for x, _ in rows]


def broad_treatments(low: float, high: float, freq: float) -> tuple[Kernel, Kernel]:
    """The band-pass and the notch."""
    return lambda x, sfreq: kernels.fir_bandpass(x, sfreq, low, high), lambda x, sfreq: kernels.notch(x, sfreq, freq)


def pick_channels(signals: DataFrame, channels: list[str]) -> DataFrame:
    """Unknown names are ignored; if none is known, that is an error."""
    if signals.where(F.col("channel").isin(channels)).select("channel").limit(1).isEmpty():
        raise ValueError(f"none of the channels {channels} is there")
    return signals.where(F.col("channel").isin(channels))


def clip_amplitude(signals: DataFrame, max_uv: float = AMPLITUDE_UV) -> DataFrame:
    """To ± max_uv µV, of samples in Volt."""
    limit = F.lit(max_uv * 1e-6)
    return signals.withColumn("samples", F.transform("samples", lambda x: F.greatest(F.least(x, limit), -limit)))


def fir_bandpass(signals: DataFrame, low: float, high: float, order: int = 5, error: str | None = "bandpass_error") -> DataFrame:
    """Broad zero-phase band-pass. `order` is accepted and has no effect: the filter's length follows from its edges."""
    return _apply(signals, lambda x, sfreq: kernels.fir_bandpass(x, sfreq, low, high), error)


def notch(signals: DataFrame, freq: float = 50.0, quality: float = 30.0) -> DataFrame:
    """`quality` is accepted and has no effect."""
    return _apply(signals, lambda x, sfreq: kernels.notch(x, sfreq, freq))


def subband(signals: DataFrame, low: float, high: float, order: int = 5, clamp: bool = True, error: str | None = "filter_error") -> DataFrame:
    return _apply(signals, lambda x, sfreq: kernels.bandpass(x, sfreq, low, high, order, clamp), error)


def clean_ica(signals: DataFrame, components: int = 15, detect: bool = True, seed: int = 42, muscles: bool = True) -> DataFrame:
    """Artefacts out of each recording; its channels meet in one task, since the components are theirs together. Without
    `detect`, nothing is taken out; without `muscles`, only what comes from the eyes."""
    schema = signals.schema

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel", ignore_index=True)
        x = np.stack(group["samples"].to_numpy())
        group["samples"] = list(kernels.clean_ica(x, group["channel"].tolist(), components, detect, seed, muscles))
        return group

    return signals.groupBy("filename").applyInPandas(run, schema)


def _densities(rows: list[tuple[np.ndarray, float]], size: int, fmin: float, fmax: float, epsilon: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """How many frequencies each signal has in [fmin, fmax]; these, and their density in decibel."""
    counts, freqs, db = [], [], []
    for x, sfreq in rows:
        f, density = kernels.welch(x, sfreq, size)
        keep = (f >= fmin) & (f <= fmax)
        counts.append(int(keep.sum()))
        freqs.append(f[keep])
        with np.errstate(divide="ignore"):
            db.append(10 * np.log10(density[keep] + epsilon))
    return counts, np.concatenate([*freqs, np.zeros(0)]), np.concatenate([*db, np.zeros(0)])


_PSD = "filename string, channel string, freq double, db double"


def psd(signals: DataFrame, fmin: float = 0.0, fmax: float = 60.0, size: int = 256, epsilon: float = 1e-20) -> DataFrame:
    """filename, channel, freq, db: Welch density in decibel."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(given):
            counts, freqs, db = _densities(_signals(batch), size, fmin, fmax, epsilon)
            take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("filename", "channel")), pa.array(freqs), pa.array(db)], ["filename", "channel", "freq", "db"])

    return signals.select("filename", "channel", "samples", "sfreq").mapInArrow(run, _PSD)


def psd_by_treatment(signals: DataFrame, low: float = 1.0, high: float = 40.0, freq: float = 50.0, fmin: float = 0.0, fmax: float = 60.0, size: int = 256) -> DataFrame:
    """psd of the raw signal, of its band-pass, and of that after a notch, as `treatment`. One worker a task makes all three, some
    signals at a time."""
    bandpass, stop = broad_treatments(low, high, freq)
    treatments = {"raw": [], "bandpass": [bandpass], "notch_bandpass": [stop, bandpass]}

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(given):
            rows = _signals(batch)
            for name, steps in treatments.items():
                done = list(zip(_treat(rows, steps), (sfreq for _, sfreq in rows), strict=True))
                counts, freqs, db = _densities(done, size, fmin, fmax, 0.0)
                take = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("filename", "channel")), pa.array(freqs), pa.array(db), pa.array([name] * len(take), pa.string())], ["filename", "channel", "freq", "db", "treatment"])

    return signals.select("filename", "channel", "samples", "sfreq").mapInArrow(run, f"{_PSD}, treatment string")
