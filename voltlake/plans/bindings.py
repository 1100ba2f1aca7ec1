"""The given tables as recordings, annotations, signals and features: no recordings are given, so these stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.operators import features

SFREQ = 128.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as samples: a supplier is a file, return flag, line status and line number are task, channel and subband."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_extendedprice")
    rows = items.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    k = F.col("l_suppkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return rows.select(
        F.concat(name("rec", k), F.lit(".edf")).alias("filename"),
        F.when(F.col("s_nationkey") % 2 == 0, "ALS").otherwise("Normal").alias("category"),
        name("S", k % 50).alias("subject"),
        name("time", k % 3).alias("time"),
        name("scenario", 1 + F.floor(k / 50) % 2).alias("scenario"),
        F.col("l_returnflag").alias("task"),
        F.col("l_linestatus").alias("channel"),
        name("band", F.col("l_linenumber")).alias("subband"),
        (F.col("l_extendedprice") / 997).alias("value"),
    )


META = ["filename", "category", "subject", "time", "scenario", "task", "channel", "subband"]


def feature_table(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("mav", "variance", "std")) -> DataFrame:
    return features.aggregate_features(feature_samples(spark, sf_dir), META, list(names))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a user is a recording, times are seconds from its first event, the event's type is its marker."""
    # Times without a zone are taken as UTC, whatever the session's zone.
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    events = table(spark, sf_dir, "events").select("event_id", micros.alias("ts"), "user_id", "event_type", "value")
    own = Window.partitionBy("user_id")
    return events.select(
        F.col("user_id").alias("filename"),
        (F.row_number().over(own.orderBy("ts", "event_id")) - 1).cast("long").alias("sample_idx"),
        ((F.col("ts") - F.min("ts").over(own)) / 1e6).alias("time"),
        F.lit("C3").alias("channel"),
        (F.col("value") / 9.97).alias("value"),
        F.col("event_type").alias("marker"),
        "event_id",
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event is an annotation of a quarter of a day, every fifth one of no duration."""
    own = Window.partitionBy("filename").orderBy("onset", "event_id")
    rows = samples(spark, sf_dir).where("marker = 'error'").withColumn("onset", F.col("time"))
    kind = F.element_at(F.array(*map(F.lit, ("Resting", "Thinking and Acting", "Typing"))), (F.col("event_id") % 3 + 1).cast("int"))
    return rows.select("filename", (F.row_number().over(own) - 1).alias("annot_idx"), "onset", F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(21600.0).alias("duration"), kind.alias("description"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of 64 samples at 128 Hz; the label is the task."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("filename"), F.lit(SFREQ).alias("sfreq"), F.col("vec_id").cast("string").alias("channel"), F.col("label").cast("string").alias("task"), F.col("embedding").cast("array<double>").alias("samples"), "vec_id")


def regular_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recordings at 128 Hz: filename, sample_idx, time, channel, value; a user is a recording of two channels."""
    rows = samples(spark, sf_dir)
    channels = F.array(F.struct(F.lit("C3").alias("channel"), F.col("value")), F.struct(F.lit("C4").alias("channel"), ((F.col("event_id") * 37) % 101 / 10).alias("value")))
    name = F.concat(F.lit("u"), F.col("filename").cast("string"))
    long = rows.select(name.alias("filename"), "sample_idx", (F.col("sample_idx") / SFREQ).alias("time"), F.explode(channels).alias("c"))
    return long.select("filename", "sample_idx", "time", "c.channel", "c.value")


def regular_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three recordings in four: each error is an annotation of 16 samples, every fifth one of no duration; onsets are a little
    off the samples."""
    rows = samples(spark, sf_dir).where((F.col("marker") == "error") & (F.col("filename") % 4 != 0))
    kind = F.element_at(F.array(*map(F.lit, ("Resting", "Thinking and Acting", "Typing"))), (F.col("event_id") % 3 + 1).cast("int"))
    own = Window.partitionBy("filename").orderBy("sample_idx")
    onset = F.col("sample_idx") / SFREQ + (F.col("event_id") % 3) * 0.002
    return rows.select(F.concat(F.lit("u"), F.col("filename").cast("string")).alias("filename"), (F.row_number().over(own) - 1).alias("annot_idx"), onset.alias("onset"), F.when(F.col("event_id") % 5 == 0, 0.0).otherwise(0.125).alias("duration"), kind.alias("description"))


def chunks(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """The same recordings and annotations as the data source gives them, in small chunks."""
    from voltlake.sources import recordings

    rows = regular_samples(spark, sf_dir).groupBy("filename", "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda s: s["value"]).alias("samples"))
    signals = recordings.chunked(rows.withColumn("sfreq", F.lit(SFREQ)), size)
    heads = signals.where("chunk = 0").groupBy("filename", "sfreq", "n_samples").agg(F.lit(0).cast("long").alias("chunk"))
    note = F.struct(F.lit(0).cast("long").alias("record"), "onset", "duration", "description")
    said = regular_annotations(spark, sf_dir).groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("annot_idx", note.alias("note")))).alias("notes"))
    notes = F.coalesce(F.transform("notes", lambda s: s["note"]), F.array().cast("array<struct<record:bigint,onset:double,duration:double,description:string>>"))
    plain = heads.join(said, "filename", "left").select("filename", "sfreq", "n_samples", "chunk", F.lit(0).cast("long").alias("start"), notes.alias("annotations"))
    return signals.unionByName(plain, allowMissingColumns=True).withColumns({"channel_idx": F.lit(None).cast("int"), "error": F.lit(None).cast("string")})


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles to so many digits, and no negative zeros."""
    return df.select(*((F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))
