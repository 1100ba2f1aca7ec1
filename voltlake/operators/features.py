"""Features of segments, in time and frequency.

Segments: filename, task[, occurrence], channel, samples and sfreq. A segment's spectrum is computed once for all bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.config import FREQUENCY_FEATURES, NO_MARKER, RATIOS, SUBBANDS, ratio_table, subband_table
from voltlake.functions import kernels
from voltlake.operators import align, batches


def time_features(value: Column) -> dict[str, Column]:
    """Population moments, as aggregates over samples."""
    return {
        "mav": F.avg(F.abs(value)),
        "variance": F.var_pop(value),
        "std": F.stddev_pop(value),
        "rms": F.sqrt(F.avg(value * value)),
        "mean": F.avg(value),
        "mean_power": F.avg(value * value),
    }


def aggregate_features(samples: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    own = time_features(F.col("value"))
    return samples.groupBy(*keys).agg(*(own[f].alias(f) for f in features))


def subband_features(segments: DataFrame, subbands: dict[str, tuple[float, float]] | None = None, frequency: bool = True, order: int = 5, clamp: bool = True) -> DataFrame:
    """A row for each segment and subband: mav, variance and std of the filtered signal, and (of the signal as it is) band_power,
    relative_power and peak_frequency. `reason` says why a segment's filtered features are null: it is too short."""
    bands = list((subbands or SUBBANDS).items())
    keys = [c for c in segments.columns if c not in ("samples", "sfreq")]
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    names = ["mav", "variance", "std", *(FREQUENCY_FEATURES if frequency else [])]
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "subband string", *(f"{n} double" for n in names), "reason string"])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches.sliced(given):
            signals = [np.asarray(x, np.float64) for x in batches.arrays(batch.column("samples"))]
            rates = batch.column("sfreq").to_pylist()
            rows: list[list[tuple]] = [[] for _ in signals]
            # Segments of one length go through a filter together.
            alike: dict[tuple[int, float], list[int]] = {}
            for i, (x, sfreq) in enumerate(zip(signals, rates, strict=True)):
                alike.setdefault((len(x), sfreq), []).append(i)
            for (n, sfreq), own in alike.items():
                x = np.stack([signals[i] for i in own])
                spectra = [kernels.spectrum(signals[i], sfreq) if n > 3 else (np.zeros(0), np.zeros(0)) for i in own] if frequency else []
                for name, (low, high) in bands:
                    why = None
                    try:
                        y = kernels.bandpass(x, sfreq, low, high, order, clamp)
                        moments = list(zip(np.abs(y).mean(1).tolist(), y.var(1).tolist(), y.std(1).tolist(), strict=True))
                    except ValueError as e:
                        moments, why = [(None, None, None)] * len(own), str(e)
                    for k, i in enumerate(own):
                        more = kernels.band_features(*spectra[k], low, high) if frequency else ()
                        rows[i].append((name, *moments[k], *more, why))
            rows = [r for own in rows for r in own]
            take = pa.array(np.repeat(np.arange(batch.num_rows), len(bands)))
            columns = [pa.array([r[i] for r in rows], pa.string() if i in (0, len(names) + 1) else pa.float64()) for i in range(len(names) + 2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *columns], [*keys, "subband", *names, "reason"])

    return segments.mapInArrow(run, schema)


def frequency_features(segments: DataFrame, subbands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """The keys of segments (columns besides samples and sfreq), subband, band_power, relative_power, peak_frequency: of the signal as it is."""
    bands = list((subbands or SUBBANDS).items())
    keys = [c for c in segments.columns if c not in ("samples", "sfreq")]
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, sfreq in enumerate(batch.column("sfreq").to_pylist()):
                x = np.asarray(batch.column("samples")[i].values, np.float64)
                freqs, power = kernels.spectrum(x, sfreq) if len(x) > 3 else (np.zeros(0), np.zeros(0))
                rows += [(name, *kernels.band_features(freqs, power, *limits)) for name, limits in bands]
            take = pa.array(np.repeat(np.arange(batch.num_rows), len(bands)))
            columns = [pa.array([r[k] for r in rows], pa.float64() if k else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *columns], [*keys, "subband", *FREQUENCY_FEATURES])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "subband string", *(f"{n} double" for n in FREQUENCY_FEATURES)])
    return segments.mapInArrow(run, schema)


def task_features(marked: DataFrame, sfreq: float, **options) -> DataFrame:  # noqa: ANN003
    """Of all of a task's samples, one after the other."""
    return subband_features(align.segments(marked, by_occurrence=False).withColumn("sfreq", F.lit(float(sfreq))), **options)


def occurrence_features(marked: DataFrame, sfreq: float, least: int = 4, **options) -> DataFrame:  # noqa: ANN003
    """Of each run of at least `least` samples; task_occ names it."""
    own = align.segments(marked).where(F.size("samples") >= least).withColumn("sfreq", F.lit(float(sfreq)))
    return subband_features(own, **options).withColumn("task_occ", F.concat_ws("_", "task", F.col("occurrence").cast("string")))


def aggregated_occurrence_features(by_occurrence: DataFrame, features: list[str]) -> DataFrame:
    return by_occurrence.groupBy("filename", "task", "channel", "subband").agg(*(F.avg(f).alias(f) for f in features))


def first_occurrence_features(marked: DataFrame, sfreq: float, least: int = 4, **options) -> DataFrame:  # noqa: ANN003
    """Of each task's first run; a recording without any marker is one task, full_recording. A first run that is too short
    leaves its task out."""
    own = align.segments(marked).where("occurrence = 1").drop("occurrence").where(F.size("samples") >= least)
    unmarked = marked.groupBy("filename").agg(F.max(F.col("marker") != NO_MARKER).alias("any")).where("not any").select("filename")
    whole = align.segments(marked.join(unmarked, "filename", "left_semi").withColumn("marker", F.lit("full_recording")), by_occurrence=False)
    return subband_features(own.unionByName(whole).withColumn("sfreq", F.lit(float(sfreq))), **options)


def native_spectrum(signals: DataFrame, keys: list[str], n: int, sfreq: float) -> DataFrame:
    """keys, freq, power by a join with the transform's basis: for segments of one length, of 1,024 samples at most (the basis has
    half the square of that rows, and is broadcast); for others use `spectra`."""
    if n > 1024:
        raise ValueError(f"segments of {n} samples are too long for a broadcast basis")
    spark = signals.sparkSession
    angle = F.lit(-2 * np.pi / n) * ((F.col("k") * F.col("i")) % n)
    basis = spark.range(n // 2 + 1).withColumnRenamed("id", "k").crossJoin(F.broadcast(spark.range(n).withColumnRenamed("id", "i")))
    basis = basis.select("k", F.col("i").cast("int").alias("i"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    long = signals.select(*keys, F.posexplode("samples").alias("i", "x"))
    parts = long.join(F.broadcast(basis), "i").groupBy(*keys, "k").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    return parts.select(*keys, (F.col("k") * sfreq / n).alias("freq"), ((F.col("re") ** 2 + F.col("im") ** 2) / n).alias("power"))


def spectra(signals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, freq, power by one real transform for each row's samples."""
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernels.spectrum(np.asarray(x, np.float64), r) if x else (np.zeros(0), np.zeros(0)) for x, r in zip(batch.column("samples").to_pylist(), batch.column("sfreq").to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(f) for f, _ in found]))
            values = [pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)] if found else [pa.array([], pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *values], [*keys, "freq", "power"])

    return signals.select(*keys, "samples", "sfreq").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", freq double, power double")


def band_table(spectrum: DataFrame, keys: list[str], subbands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """keys, subband, band_power, relative_power, peak_frequency; the bands are a few rows, so they are broadcast."""
    bands = F.broadcast(subband_table(spectrum.sparkSession, subbands))
    inside = F.col("freq").between(F.col("low"), F.col("high"))
    of = lambda c: F.when(inside, c)
    rows = spectrum.crossJoin(bands).groupBy(*keys, "subband")
    return rows.agg(
        F.coalesce(F.avg(of(F.col("power"))), F.lit(0.0)).alias("band_power"),
        F.when(F.sum("power") > 0, F.coalesce(F.sum(of(F.col("power"))), F.lit(0.0)) / F.sum("power")).otherwise(0.0).alias("relative_power"),
        F.coalesce(F.max_by("freq", of(F.struct(F.col("power"), -F.col("freq")))), F.lit(0.0)).alias("peak_frequency"),
    )


def band_ratios(features: DataFrame, keys: list[str], ratios: list[tuple[str, str, str]] | None = None, order: str | None = None) -> DataFrame:
    """keys, ratio_name, value of band_power; 0 if the denominator is missing or not above 0. Of several rows of a key and band the last by `order` counts, or the greatest power if rows have no order."""
    names = sorted({b for _, *pair in ratios or RATIOS for b in pair})
    of = lambda c, n: F.when(F.col("subband") == n, F.col(c))
    each_band = [F.max_by("band_power", of(order, n)) if order else F.max(of("band_power", n)) for n in names]
    power = features.groupBy(*keys).agg(F.create_map(*(x for n, p in zip(names, each_band, strict=True) for x in (F.lit(n), p))).alias("power"))
    each = power.crossJoin(F.broadcast(ratio_table(features.sparkSession, ratios)))
    num, den = F.coalesce(F.element_at("power", F.col("num")), F.lit(0.0)), F.coalesce(F.element_at("power", F.col("den")), F.lit(0.0))
    return each.select(*keys, "ratio_name", F.when(den > 0, F.try_divide(num, den)).otherwise(0.0).alias("value"))


def long_features(features: DataFrame, names: list[str]) -> DataFrame:
    """feature and value in place of a column for each feature."""
    return features.unpivot([c for c in features.columns if c not in names], names, "feature", "value")


def pipelines(signals: DataFrame, annotations: DataFrame, channels: list[str], subbands: dict[str, tuple[float, float]], low: float = 1.0, high: float = 40.0, notch_hz: float = 50.0) -> DataFrame:
    """Long features (variance, std) of three treatments of each recording: with_notch, no_notch and raw, as `pipeline`."""
    from voltlake.operators import signal

    bandpass, stop = signal.broad_treatments(low, high, notch_hz)
    own = signals.where(F.col("channel").isin(channels)).select("filename", "sfreq", "channel", "samples")
    each = signal.treated(own, {"with_notch": [stop, bandpass], "no_notch": [bandpass], "raw": []}, "pipeline")
    rows = subband_features(align.sliced_segments(each, annotations, "pipeline"), subbands, frequency=False, order=4, clamp=False)
    return long_features(rows.select("filename", "task", "channel", "subband", "pipeline", "variance", "std"), ["variance", "std"])
