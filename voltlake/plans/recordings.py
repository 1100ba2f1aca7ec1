"""From recordings to the feature table: the whole dataflow of a batch, and of one recording's processing.

A file is parsed once, into a store of chunks; a ledger beside it says which files are in it, so that another run parses only
what is new, has changed or failed.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voltlake.config import SUBBANDS
from voltlake.operators import align, chunked, features, quality, signal
from voltlake.operators import ica as independent
from voltlake.session import shared_path
from voltlake.sources import files, recordings
from voltlake.sources.path import with_path_metadata

LEDGER = "path string, length bigint, modified double, filename string, status string, error string, batch string"


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """path (a file), length, modified, filename (a recording in it), status (ok or failed), error, batch: all that was ever parsed."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{store}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def current(log: DataFrame) -> DataFrame:
    """The last entry of each recording, of the last version of its file."""
    version = F.struct("length", "modified")
    newest = F.max_by(version, "batch").over(Window.partitionBy("path"))
    own = log.withColumn("newest", newest).where(F.col("newest") == version).drop("newest")
    return own.withColumn("last", F.max("batch").over(Window.partitionBy("path", "filename"))).where("batch = last").drop("last")


def ingest(spark: SparkSession, path: str | list[str], store: str, retry: bool = True, **options) -> int:  # noqa: ANN003
    """Parses recordings under a path (or files of a list) that the store doesn't have yet, or has in another version, or (with
    `retry`) failed to read, and appends them; how many files that were.

    Chunks are written to a folder of their own, and count as soon as the ledger names it: a run that breaks off leaves nothing
    that is read, and may be repeated.
    """
    there = files.walk([path] if isinstance(path, str) else path, r"\.(edf|zip)$")
    if not there:
        return 0
    found = spark.createDataFrame([(f.path, f.length, f.modified) for f in there], "path string, length bigint, modified double")
    known = current(ledger(spark, store)).groupBy("path", "length", "modified").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("filename")))).alias("failed"))
    open_ = found.join(known, ["path", "length", "modified"], "left").where(F.col("failed").isNull() | (F.size("failed") > 0) & F.lit(retry))
    # Names of files, as their listing; and of the recordings that failed.
    todo = [(r.path, r.failed) for r in open_.select("path", "failed").collect()]
    fresh, again = [p for p, f in todo if not f], {p: f for p, f in todo if f}
    if not todo:
        return 0
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = []
    if fresh:
        rows.append(recordings.read(spark, fresh, pack="true", **options))
    if again:
        rows.append(recordings.read(spark, list(again), pack="true", only=json.dumps([n for f in again.values() for n in f]), **options))
    parsed = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    parsed.write.parquet(f"{store}/chunks/batch={batch}")
    written = spark.read.schema(recordings.SCHEMAS["chunks"]).parquet(f"{store}/chunks/batch={batch}")
    status = written.groupBy("filename").agg(F.min("error").alias("error"))
    status = status.select(F.split("filename", "!/").getItem(0).alias("path"), "filename", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", F.lit(batch).alias("batch"))
    # An archive without any recording is done as well.
    own = found.join(spark.createDataFrame([(p,) for p, _ in todo], "path string"), "path").join(status, "path", "left")
    own = own.withColumns({"status": F.coalesce("status", F.lit("ok")), "batch": F.coalesce("batch", F.lit(batch))})
    own.select(*(c.split()[0] for c in LEDGER.split(", "))).coalesce(1).write.mode("append").parquet(f"{store}/ledger")
    return len(todo)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of a store, of recordings that were read without an error."""
    good = current(ledger(spark, store)).where("status = 'ok' AND filename IS NOT NULL").select("filename", "batch")
    try:
        chunks = spark.read.schema(recordings.SCHEMAS["chunks"] + ", batch string").option("basePath", f"{store}/chunks").parquet(f"{store}/chunks")
    except AnalysisException:
        return spark.createDataFrame([], recordings.SCHEMAS["chunks"])
    return chunks.join(good, ["filename", "batch"], "left_semi").drop("batch")


def failures(spark: SparkSession, store: str) -> DataFrame:
    """path, filename, error of what couldn't be read, as of the last attempt."""
    return current(ledger(spark, store)).where("status = 'failed'").select("path", "filename", "error")


def process(signals: DataFrame, channels: list[str] | None = None, drop_bad: bool = False, clip_uv: float | None = None, notch_hz: float | None = None, band: tuple[float, float] | None = None, ica: bool = False, eog_only: bool = False) -> DataFrame:
    """Steps that are asked for, in this order: channels, bad channels, clipping, notch, band-pass, ICA; of signals in chunks."""
    if channels:
        signals = signal.pick_channels(signals, channels)
    if drop_bad:
        signals = quality.exclude_bad_channels(signals, quality.judged(quality.chunk_variance(signals)))
    if clip_uv:
        signals = chunked.clip_amplitude(signals, clip_uv)
    if notch_hz:
        signals = chunked.notch(signals, notch_hz)
    if band:
        signals = chunked.fir_bandpass(signals, *band, error=None)
    if ica:
        signals = independent.clean(signals, muscles=not eog_only)
    return signals


def batch_features(spark: SparkSession, path: str, store: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """The feature table of all recordings under a path. `store`: a folder that keeps what was parsed for the next time."""
    store = store or shared_path(spark)
    ingest(spark, path, store)
    return recording_features(stored(spark, store), **options)


def recording_features(
    chunks: DataFrame,
    channels: list[str] | None = None,
    band: tuple[float, float] | None = (0.5, 49.0),
    least: int = 4,
    subbands: dict[str, tuple[float, float]] | None = None,
    frequency: bool = True,
    order: int = 5,
    clamp: bool = True,
) -> DataFrame:
    """filename and its metadata, task, channel, subband, features of each task's first occurrence, bandpass_ok.

    Chunks of recordings without errors. Everything is filtered in chunks, and segments are cut out of chunks, so that a sample is
    never a row and a recording never in one task; but `frequency` features need the spectrum of a whole segment, so with
    them each channel of a segment is put together in one row. Where the band-pass fails, the signal goes on as it is, and
    bandpass_ok says so.
    """
    own = recordings.signals(chunks)
    if channels:
        own = own.where(F.col("channel").isin(channels))
    own = chunked.fir_bandpass(own, *band) if band else own.withColumn("bandpass_error", F.lit(None).cast("string"))
    own = own.select("*", F.col("bandpass_error").isNull().alias("bandpass_ok")).drop("bandpass_error")
    cut = chunked.pieces(own, first_segments(chunks).where(F.col("n_samples") >= least))
    out = chunked.subband_moments(cut, subbands or SUBBANDS, order, clamp)
    if frequency:
        more = features.frequency_features(chunked.segments(cut), subbands)
        out = out.join(more, ["filename", "task", "channel", "subband"])
    return with_path_metadata(out)


def first_segments(chunks: DataFrame) -> DataFrame:
    """filename, task, start_idx, n_samples of each task's first run; a recording without annotations is one task, full_recording."""
    heads, notes = recordings.headers(chunks), recordings.annotations(chunks)
    runs = align.runs(align.disjoint(align.regular_spans(heads, notes)))
    marked = runs.where((F.col("occurrence") == 1) & (F.col("task") != "none")).select("filename", "task", "start_idx", "n_samples")
    bare = heads.join(notes.select("filename").distinct(), "filename", "left_anti")
    return marked.unionByName(bare.select("filename", F.lit("full_recording").alias("task"), F.lit(0).cast("long").alias("start_idx"), "n_samples"))


def batch_tasks(feature_table: DataFrame) -> DataFrame:
    return feature_table.select("task").distinct().orderBy("task")
