"""What several of the text operators share: shared-folder tables, Arrow batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType

#: Bytes of text that a Python worker handles at once, unless one row alone is larger.
SLICE_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one will do, but only if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voltlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Spark's own switch for deleting a query's shuffle files as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run within are deleted as soon as these end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voltlake-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation of it.

    The shuffle files behind it are deleted as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Deletes tables of `stash` that nothing reads any more, as what was made of them is stashed too."""
    for df in stashed:
        remove(df.sparkSession, df._stashed_at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for intermediate values that no column of df has."""
    taken, prefix = {c.lower() for c in df.columns}, "_"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def whole_number(df: DataFrame, column: str) -> None:
    """TypeError, before anything runs, where a column that is ordered and packed as a number isn't one."""
    if not isinstance(df.schema[column].dataType, IntegralType):
        raise TypeError(f"{column} must be a whole number, not {df.schema[column].dataType.simpleString()}")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of `column` (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each row; null: empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h
