"""Pivots, top rows, unions of tasks, descriptions: shapes of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_mean(df: DataFrame, row: str, column: str, value: str, names: list[str]) -> DataFrame:
    """A row of `row`s by columns of `column` values; they are given, so that no extra job looks for them."""
    return df.groupBy(row).pivot(column, names).agg(F.avg(value))


def feature_by_scenario(features: DataFrame, feature: str, scenarios: list[str]) -> DataFrame:
    """channel, subband, subject by scenarios: the value of the first file (by name) that has one."""
    cells = [F.min_by(feature, F.when((F.col("scenario") == s) & F.col(feature).isNotNull(), F.col("filename"))).alias(s) for s in scenarios]
    return features.groupBy("channel", "subband", "subject").agg(*cells)


def feature_grid(features: DataFrame, feature: str, scenarios: list[str]) -> DataFrame:
    """The grid of an export: category, channel, subband, subject by scenarios, the last file's value where several have one."""
    cells = [F.max_by(feature, F.when((F.col("scenario") == s) & F.col(feature).isNotNull(), F.col("filename"))).alias(s) for s in scenarios]
    return features.groupBy("category", "channel", "subband", "subject").agg(*cells)


def top_abs(df: DataFrame, value: str, by: list[str], n: int = 20) -> DataFrame:
    """The n rows of largest absolute value; `by` settles ties."""
    return df.orderBy(F.abs(F.col(value)).desc(), *by).limit(n)


def top(df: DataFrame, value: str, by: list[str], n: int) -> DataFrame:
    return df.orderBy(F.desc(value), *by).limit(n)


def align_results(frames: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """keys and each frame's value under its name; a key that only some have is kept, avg is over those (full outer)."""
    tagged = [df.select(*keys, F.lit(name).alias("source"), F.col(value).alias("value")) for name, df in frames.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    cells = [F.max(F.when(F.col("source") == name, F.col("value"))).alias(name) for name in frames]
    return rows.groupBy(*keys).agg(*cells, F.avg("value").alias("avg"))


def task_union(features: DataFrame) -> DataFrame:
    return features.select("task").distinct()


def task_intersection(features: DataFrame) -> DataFrame:
    """Tasks that every category has."""
    categories = features.agg(F.countDistinct("category").alias("categories"))
    return features.groupBy("task").agg(F.countDistinct("category").alias("n")).crossJoin(categories).where("n = categories").select("task")


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value of each distinct value, in one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(each.alias("c")).select("c.*").where("value is not null").distinct()


def counts(features: DataFrame) -> DataFrame:
    return features.groupBy("category").agg(F.countDistinct("subject").alias("n_subjects"), F.countDistinct("filename").alias("n_files"))


def focus(delta: DataFrame, feature: str) -> DataFrame:
    """One feature of a delta table: of both tasks and their difference, or the plain column if there are no tasks."""
    meta = [c for c in ("filename", "channel", "subband", "category", "subject") if c in delta.columns]
    own = [c for c in (f"{feature}_a", f"{feature}_b", f"delta_{feature}") if c in delta.columns] or [feature]
    return delta.select(*meta, *own)


def micro_units(df: DataFrame) -> DataFrame:
    """Numeric columns of which the mean absolute value is above 0 and below a thousandth, in millionths, and named so."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    if not numeric:
        return df
    means = df.agg(*(F.avg(F.abs(F.nanvl(c, F.lit(None).cast("double")))).alias(c) for c in numeric)).first()
    small = {c for c in numeric if means[c] is not None and 0 < means[c] < 1e-3}
    return df.select(*((F.col(c) * 1e6).alias(f"{c} (µ)") if c in small else F.col(c) for c in df.columns))


def describe(long_features: DataFrame, by: list[str]) -> DataFrame:
    return long_features.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("count"))


def power_drop(long_features: DataFrame, before: str = "raw", after: str = "with_notch") -> DataFrame:
    """channel, subband, drop: the mean of one treatment less that of the other."""
    of = lambda p: F.avg(F.when(F.col("pipeline") == p, F.col("value")))
    return long_features.groupBy("channel", "subband").agg((of(before) - of(after)).alias("drop"))


def enrich(delta: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """delta with columns of the features table by file; of several rows of a file the least values."""
    own = features.groupBy("filename").agg(*(F.min(c).alias(c) for c in columns))
    return delta.join(own, "filename", "left").withColumn("label", F.concat_ws(" / ", "channel", "subband"))


def short_name(filename: Column) -> Column:
    """Without .edf, in any case, wherever it is."""
    return F.regexp_replace(filename, r"(?i)\.edf", "")


def last_part(filename: Column) -> Column:
    """Without .edf as it is written there, and without folders."""
    return F.element_at(F.split(F.replace(filename, F.lit(".edf"), F.lit("")), "/"), -1)


def decoded(label: Column) -> dict[str, Column]:
    """task and occurrence of a label <task>_<occurrence>; the task may have underscores. No number: null."""
    return {"task": F.regexp_extract(label, r"(?s)^(.*)_[^_]*$", 1), "occurrence": F.substring_index(label, "_", -1).try_cast("int")}


def first_files(df: DataFrame, n: int = 20) -> DataFrame:
    """Rows of the first n files by name."""
    names = df.where("filename is not null").select("filename").distinct().orderBy("filename").limit(n)
    return df.join(names, "filename", "left_semi")


def head(df: DataFrame, by: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def to_numeric(value: Column) -> Column:
    """A number in text; null for what is none."""
    return F.trim(value).try_cast("double")


def column_roles(columns: list[str], a: str, b: str) -> dict[str, str]:
    """What a column of a delta table is: meta, a or b (of a task), delta, or nothing of these."""
    meta = {"filename", "category", "subject", "time", "scenario", "task", "channel", "subband"}
    role = lambda c: "meta" if c in meta else "a" if c.endswith(f"_{a}") else "b" if c.endswith(f"_{b}") else "delta" if c.startswith("delta_") else ""
    return {c: role(c) for c in columns}


def change_role(percent: Column) -> Column:
    """ERD for a fall, ERS for a rise, else null."""
    return F.when(percent < 0, "ERD").when(percent > 0, "ERS")
