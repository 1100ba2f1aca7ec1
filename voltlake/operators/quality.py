"""Bad channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.config import BAD_CHANNEL_MADS


def channel_variance(samples: DataFrame) -> DataFrame:
    return samples.groupBy("filename", "channel").agg(F.var_pop("value").alias("variance"))


def chunk_variance(chunks: DataFrame) -> DataFrame:
    """The same of recordings in chunks: each chunk's moments, merged; no sample is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moments = [(len(x), x.mean(), x.var() * len(x)) if len(x) else (0, 0.0, 0.0) for x in (np.asarray(c.values, np.float64) for c in batch.column("samples"))]
            columns = [pa.array([m[k] for m in moments], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("filename"), batch.column("channel"), *columns], ["filename", "channel", "n", "mean", "spread"])

    parts = chunks.select("filename", "channel", "samples").mapInArrow(run, "filename string, channel string, n bigint, mean double, spread double").where("n > 0")
    own = Window.partitionBy("filename", "channel")
    middle = F.sum(F.col("n") * F.col("mean")).over(own) / F.sum("n").over(own)
    around = parts.withColumn("around", F.col("spread") + F.col("n") * (F.col("mean") - middle) ** 2)
    return around.groupBy("filename", "channel").agg((F.sum("around") / F.sum("n")).alias("variance"))


def bad_channels(samples: DataFrame, threshold: float = BAD_CHANNEL_MADS) -> DataFrame:
    return judged(channel_variance(samples), threshold)


def judged(variance: DataFrame, threshold: float = BAD_CHANNEL_MADS) -> DataFrame:
    """filename, channel, variance, median, mad, bad: off the recording's median variance by more than `threshold` times the
    median of such distances. Where that median is 0, none is bad."""
    middle = variance.groupBy("filename").agg(F.median("variance").alias("median"))
    off = variance.join(middle, "filename").withColumn("off", F.abs(F.col("variance") - F.col("median")))
    spread = off.groupBy("filename").agg(F.median("off").alias("mad"))
    return off.join(spread, "filename").select("filename", "channel", "variance", "median", "mad", ((F.col("mad") > 0) & (F.col("off") > threshold * F.col("mad"))).alias("bad"))


def exclude_bad_channels(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows without bad channels, but of a recording that has only such, all."""
    gone = verdicts.where("bad").join(verdicts.where("not bad").select("filename").distinct(), "filename", "left_semi")
    return rows.join(gone.select("filename", "channel"), ["filename", "channel"], "left_anti")
