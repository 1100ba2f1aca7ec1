"""Tables written out. Whatever a chart or a sheet needs is a data frame; its looks are left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_partitioned_csv(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """A folder for each value of the columns `by`. Rows of a folder meet in few tasks first, so that each has few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).option("header", "true").csv(path)


def write_feature_tree(long_features: DataFrame, path: str) -> None:
    write_partitioned_csv(long_features, path, ["task", "channel", "subband", "feature", "scenario"])


def marked_samples_wide(samples: DataFrame, channels: list[str]) -> DataFrame:
    """time, a column for each channel, marker: the frame of a sample export. Of several values of a channel at a sample the least."""
    of = [F.min(F.when(F.col("channel") == c, F.col("value"))).alias(c) for c in channels]
    return samples.groupBy("filename", "sample_idx", "time", "marker").agg(*of).select("filename", "sample_idx", "time", *channels, "marker")


def workbook(path: str, sheets: dict[str, DataFrame], limit: int = 1_000_000) -> None:
    """Sheets of one workbook, through the driver: for tables of at most `limit` rows, and only where openpyxl is there.

    Without it each sheet is written as CSV under the path.
    """
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        for name, sheet in sheets.items():
            write_csv(sheet, f"{path}/{sheet_name(name)}")
        return
    import pandas as pd

    with pd.ExcelWriter(path) as writer:
        for name, sheet in sheets.items():
            rows = sheet.limit(limit + 1).toPandas()
            if len(rows) > limit:
                raise ValueError(f"{name} has over {limit} rows: write it as CSV")
            rows.to_excel(writer, sheet_name=sheet_name(name), index=False)


def sheet_name(name: str) -> str:
    """Without the characters that a sheet's name can't have, and of at most 31 characters."""
    return name.translate({ord(c): None for c in "\\/*?:[]"})[:31]
