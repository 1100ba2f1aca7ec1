"""Recordings as they arrive: the feature table grows by the files that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltlake.plans.recordings import ingest, recording_features, stored

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """path of each file under a folder, once; only names are read."""
    source = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    return source.load(path).select("path").where(F.lower("path").rlike(r"\.(edf|zip)$"))


def append_features(files: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:  # noqa: ANN003
    """Features of each micro-batch, as Parquet in a folder of its own: a batch that is run again replaces what it wrote.

    A micro-batch names its files, as many as a trigger may have; each is parsed once, into a store of the batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        names = [r.path for r in batch.collect()]
        if names:
            store = f"{out}.chunks/batch={epoch}"
            ingest(batch.sparkSession, names, store)
            recording_features(stored(batch.sparkSession, store), **options).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
