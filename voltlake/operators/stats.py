"""Two-group statistics over features, in long form: rows of (category, subject, channel, subband, feature, value)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from voltlake.config import FEATURES, GROUPS
from voltlake.functions import pvalues

CELL = ["channel", "subband", "feature"]


def long(features: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    return features.select(*keys, *(names or FEATURES)).unpivot(keys, names or FEATURES, "feature", "value")


def normalize(features: DataFrame, names: list[str] | None = None, method: str = "zscore", scope: str = "subject") -> DataFrame:
    """Each feature against all rows of its subject (or subject and scenario), whatever their channel, band and task.

    zscore: by mean and sample standard deviation (a deviation of 0 counts as 1; a single row gives null); minmax: into [0, 1].
    """
    w = Window.partitionBy(*(["subject"] if scope == "subject" else ["subject", "scenario"]))
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)

    def of(name: str) -> Column:
        x = F.col(name)
        if method == "zscore":
            return (x - F.avg(x).over(w)) / one(F.stddev_samp(x).over(w))
        if method == "minmax":
            return (x - F.min(x).over(w)) / one(F.max(x).over(w) - F.min(x).over(w))
        raise ValueError(f"no method {method}")

    return features.withColumns({n: of(n) for n in names or FEATURES})


def compare_rows(features: DataFrame, active: str, baseline: str = "Resting", names: list[str] | None = None, mode: str = "delta") -> DataFrame:
    """A value for each category, subject and cell: of the mean of a subject's rows of the active task, less that of the
    baseline (delta); z-scored over the active task's rows (zscore); or z-scored over both tasks' rows, then less (both)."""
    names = names or FEATURES
    keys = ["category", "subject", "channel", "subband"]
    if mode == "zscore":
        rows = normalize(features.where(F.col("task") == active), names)
        return long(rows, keys, names).groupBy(*keys, "feature").agg(F.avg("value").alias("value"))
    if mode not in ("delta", "both"):
        raise ValueError(f"no mode {mode}")
    rows = features.where(F.col("task").isin(active, baseline))
    rows = long(normalize(rows, names) if mode == "both" else rows, [*keys, "task"], names).dropna(subset=keys)
    # Both tasks' rows meet in one aggregation, so features are made once.
    of = lambda task, c: F.when(F.col("task") == task, c)
    both = rows.groupBy(*keys, "feature").agg(F.avg(of(active, F.col("value"))).alias("own"), F.avg(of(baseline, F.col("value"))).alias("base"), F.count(of(active, F.lit(1))).alias("n"), F.count(of(baseline, F.lit(1))).alias("m"))
    return both.where("n > 0 and m > 0").select(*keys, "feature", (F.col("own") - F.col("base")).alias("value"))


def rank_sums(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """CELL, u (of the first group), ties (the sum of t ** 3 - t); ranks are averages among equal values."""
    first = (groups or GROUPS)[0]
    own = Window.partitionBy(*CELL)
    same = Window.partitionBy(*CELL, "value")
    ranked = rows.where(F.col("value").isNotNull() & F.col("category").isin(groups or GROUPS))
    ranked = ranked.withColumns({"t": F.count("*").over(same), "rank": F.rank().over(own.orderBy("value"))})
    rank = F.col("rank") + (F.col("t") - 1) / 2
    of = F.col("category") == first
    n = F.sum(F.when(of, 1).otherwise(0))
    return ranked.groupBy(*CELL).agg((F.sum(F.when(of, rank)) - n * (n + 1) / 2).alias("u"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))


def effect_label(d: Column) -> Column:
    # The labels.
    size = F.abs(d)
    return F.when(d.isNull(), "–").when(size < 0.2, "Sangat Kecil").when(size < 0.5, "Kecil").when(size < 0.8, "Sedang").otherwise("Besar")


def group_statistics(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """CELL, and of each group n, mean and sem (of two or more); t (pooled variance), df, cohend (0 if nothing varies), effect, u, ties."""
    a, b = (g.lower() for g in groups or GROUPS)
    of = lambda g: F.when(F.col("category") == g, F.col("value"))
    aggs = []
    for g in groups or GROUPS:
        n = F.count(of(g))
        aggs += [n.alias(f"n_{g.lower()}"), F.avg(of(g)).alias(f"mean_{g.lower()}"), F.var_samp(of(g)).alias(f"var_{g.lower()}")]
    wide = rows.groupBy(*CELL).agg(*aggs)
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    both = (na >= 2) & (nb >= 2)
    pooled = F.try_divide((na - 1) * F.col(f"var_{a}") + (nb - 1) * F.col(f"var_{b}"), na + nb - 2)
    gap = F.col(f"mean_{a}") - F.col(f"mean_{b}")
    wide = wide.withColumns(
        {
            **{f"sem_{g}": F.when(n >= 2, F.sqrt(F.col(f"var_{g}") / n)) for g, n in ((a, na), (b, nb))},
            "df": F.when(both, na + nb - 2),
            "t": F.when(both, F.try_divide(gap, F.sqrt(pooled * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))))),
            "cohend": F.when(both, F.when(pooled > 0, F.try_divide(gap, F.sqrt(pooled))).otherwise(0.0)),
        }
    )
    out = wide.drop(f"var_{a}", f"var_{b}").withColumn("effect", effect_label(F.col("cohend")))
    return out.join(rank_sums(rows, groups), CELL, "left")


@F.pandas_udf(DoubleType())
def _p_u(u: pd.Series, n: pd.Series, m: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([pvalues.mann_whitney(*x) if x[1] >= 2 and x[2] >= 2 else None for x in zip(u, n.astype(int), m.astype(int), ties, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([pvalues.student_t(*x) if x[1] > 0 and x[0] == x[0] else None for x in zip(t, df, strict=True)], dtype="float64")


def with_pvalues(statistics: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """p (Mann-Whitney, two-sided), p_t (Student), and p_fdr: p corrected over the cells of its feature."""
    a, b = (g.lower() for g in groups or GROUPS)
    rows = statistics.withColumns({"p": _p_u("u", f"n_{a}", f"n_{b}", "ties"), "p_t": _p_t("t", "df")})
    return benjamini_hochberg(rows, "p", ["feature"], "p_fdr")


def benjamini_hochberg(rows: DataFrame, p: str = "p", by: list[str] | None = None, out: str = "p_fdr") -> DataFrame:
    """Of p-values that are there, within each group of `by`: the least of p n / rank from the largest down, at most 1. A group of
    fewer than two has none."""
    by, names = by or [], [c for c in rows.columns if c != out]
    given, whole = F.when(F.isnan(p), None).otherwise(F.col(p)), F.struct(*names)
    # What a row has besides goes along as one column, so that no name of its own is in the way.
    rows = rows.select(*by, whole.alias("whole"), given.alias("p")).toDF(*(f"by{i}" for i in range(len(by))), "whole", "p")
    own = [*(f"by{i}" for i in range(len(by))), F.col("p").isNotNull()]
    n = F.count("p").over(Window.partitionBy(*own))
    rank = F.row_number().over(Window.partitionBy(*own).orderBy("p"))
    rows = rows.withColumn("scaled", F.col("p") * n / rank).withColumn("n", n)
    down = Window.partitionBy(*own).orderBy(F.desc("p"), F.desc("scaled")).rowsBetween(Window.unboundedPreceding, 0)
    # Among equal values the last rank counts: its scaled value is the least.
    rows = rows.withColumn("low", F.min("scaled").over(down))
    same = F.min("low").over(Window.partitionBy(*own, "p"))
    corrected = F.when((F.col("n") >= 2) & F.col("p").isNotNull(), F.least(same, F.lit(1.0)))
    return rows.withColumn("fdr", corrected).select("whole.*", F.col("fdr").alias(out))


def wide(statistics: DataFrame, columns: list[str], features: list[str] | None = None) -> DataFrame:
    """channel, subband, and of each feature each of `columns`, as {column}_{feature}."""
    of = lambda f, c: F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{c}_{f}")
    return statistics.groupBy("channel", "subband").agg(*(of(f, c) for f in features or FEATURES for c in columns))


def star(p: Column) -> Column:
    return F.when(p <= 0.05, "★").otherwise(F.format_string("p=%.3f", p))
