"""A session with the settings that the operators rely on: UTC, adaptive execution, Arrow, and a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "voltlake", folder: str | None = None, **conf: str) -> SparkSession:
    """`folder`: where intermediate tables go; driver and executors must share it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **({"spark.checkpoint.dir": folder} if folder else {}),
        **conf,
    }
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; where none is set, in a temporary one, if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="voltlake-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found}/voltlake-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: it is made once, and a lost executor doesn't cost it."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
