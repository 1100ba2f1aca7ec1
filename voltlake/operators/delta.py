"""Comparisons of tasks: deltas, event-related change, transitions between tasks by group.

features: filename, category, subject, time, scenario, task, channel, subband and a column for each feature, one row for
each (filename, task, channel, subband). A delta is A - B; a transition from A to B is mean(B) - mean(A), the other sign.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from voltlake.config import GROUPS

KEYS = ["filename", "channel", "subband", "category", "subject"]


def feature_columns(features: DataFrame) -> list[str]:
    """Numeric columns that don't say what a row is about."""
    meta = {*KEYS, "task", "time", "scenario", "occurrence"}
    return [f.name for f in features.schema if f.name not in meta and isinstance(f.dataType, NumericType)]


def task_delta(features: DataFrame, a: str, b: str, names: list[str] | None = None) -> DataFrame:
    """KEYS (category and subject only if the features have them) and of each feature (all, if none are named) {f}_a, {f}_b and
    delta_{f}, where both tasks have a row."""
    names = names or feature_columns(features)
    keys = [k for k in KEYS if k in features.columns or k not in ("category", "subject")]
    # Both tasks' rows of a key meet in one aggregation, so features are made once; a key with a null is none.
    side = lambda task, tag: F.max(F.when(F.col("task") == task, F.struct(*names))).alias(tag)
    both = features.where(F.col("task").isin(a, b)).dropna(subset=keys).groupBy(*keys).agg(side(a, "of_a"), side(b, "of_b")).where("of_a is not null and of_b is not null")
    out = both.select(*keys, *(F.col(f"of_{tag}.{f}").alias(f"{f}_{tag}") for tag in "ab" for f in names))
    return out.withColumns({f"delta_{f}": F.col(f"{f}_a") - F.col(f"{f}_b") for f in names})


def named_after_tasks(delta: DataFrame, a: str, b: str) -> DataFrame:
    """{f}_a and {f}_b under the names of the tasks, for export."""
    renamed = {c: f"{c[:-2]}_{t}" for c in delta.columns for tag, t in (("_a", a), ("_b", b)) if c.endswith(tag)}
    return delta.withColumnsRenamed(renamed)


def delta_summary(delta: DataFrame, names: list[str] | None = None) -> DataFrame:
    """channel, subband, and mean and sample standard deviation of each delta (all, if none are named)."""
    names = names or [c.removeprefix("delta_") for c in delta.columns if c.startswith("delta_")]
    of = [(F.avg(f"delta_{f}").alias(f"mean_delta_{f}"), F.stddev_samp(f"delta_{f}").alias(f"std_delta_{f}")) for f in names]
    return delta.groupBy("channel", "subband").agg(*(c for pair in of for c in pair))


def erd_ers(features: DataFrame, baseline: str = "Resting", feature: str = "mav") -> DataFrame:
    """Change of each task against the baseline in percent; 0 where the baseline is 0, null where either value is."""
    keys = ["filename", "channel", "subband"]
    base = features.where(F.col("task") == baseline).select(*keys, F.col(feature).alias("baseline_value"))
    task = features.where(F.col("task") != baseline).select(*keys, "task", F.col(feature).alias("task_value"))
    change = F.when(F.col("baseline_value") == 0, 0.0).otherwise(F.try_divide(100 * (F.col("task_value") - F.col("baseline_value")), F.col("baseline_value")))
    return task.join(base, keys).select(*keys, "task", "baseline_value", "task_value", change.alias("erd_ers_pct"))


def keep(features: DataFrame, **allowed: list | None) -> DataFrame:
    """Rows whose columns have one of the values given; no values: no filter."""
    for column, values in allowed.items():
        if values:
            features = features.where(F.col(column).isin(list(values)))
    return features


def subject_transitions(features: DataFrame, source: str, target: str, feature: str, by: list[str] | None = None) -> DataFrame:
    """category, subject[, by] and `delta`, mean(target) - mean(source), of subjects that have both."""
    mean = lambda task: F.avg(F.when(F.col("task") == task, F.col(feature)))
    rows = features.groupBy("category", "subject", *(by or [])).agg(mean(source).alias("from_mean"), mean(target).alias("to_mean"))
    return rows.where("from_mean is not null and to_mean is not null").withColumn("delta", F.col("to_mean") - F.col("from_mean"))


def group_transitions(features: DataFrame, source: str, target: str, feature: str, by: list[str] | None = None) -> DataFrame:
    """category[, by], mean, sem (0 for a single subject), n, deltas (in the order of subjects)."""
    rows = subject_transitions(features, source, target, feature, by)
    n = F.count("*")
    sem = F.when(n == 1, 0.0).otherwise(F.stddev_samp("delta") / F.sqrt(n))
    deltas = F.transform(F.array_sort(F.collect_list(F.struct("subject", "delta"))), lambda s: s["delta"])
    return rows.groupBy("category", *(by or [])).agg(F.avg("delta").alias("mean"), sem.alias("sem"), n.alias("n"), deltas.alias("deltas"))


def transition_table(features: DataFrame, source: str, target: str, feature: str, subbands: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """A row for each subband, with mean, sem and n of each group; a group without subjects has nulls and 0."""
    groups = groups or GROUPS
    rows = group_transitions(features, source, target, feature, ["subband"])
    pick = lambda g, c: F.max(F.when(F.col("category") == g, F.col(c)))
    cells = [c for g in groups for c in (pick(g, "mean").alias(f"{g.lower()}_mean"), pick(g, "sem").alias(f"{g.lower()}_sem"), F.coalesce(pick(g, "n"), F.lit(0)).alias(f"{g.lower()}_n"))]
    wide = rows.groupBy("subband").agg(*cells)
    out = subbands.select("subband").join(wide, "subband", "left").withColumn("transition", F.lit(f"{source}->{target}"))
    return out.withColumns({f"{g.lower()}_n": F.coalesce(f"{g.lower()}_n", F.lit(0)) for g in groups})


def scenario_pairs(long_features: DataFrame, first: str = "scenario1", second: str = "scenario2") -> DataFrame:
    """Values of two scenarios, side by side, of each subject, session, task, channel, subband and feature; and their distance."""
    keys = ["subject", "time", "task", "channel", "subband", "feature"]
    side = lambda s, tag: long_features.where(F.col("scenario") == s).select(*keys, F.col("value").alias(tag))
    return side(first, "sc1").join(side(second, "sc2"), keys).withColumn("abs_delta", F.abs(F.col("sc1") - F.col("sc2")))


def scenario_spread(pairs: DataFrame) -> DataFrame:
    """How far the scenarios' spreads over subjects are apart: var_delta and std_delta (population), and n_samples."""
    apart = lambda spread: F.abs(spread("sc1") - spread("sc2"))
    return pairs.groupBy("task", "channel", "subband", "feature").agg(apart(F.var_pop).alias("var_delta"), apart(F.stddev_pop).alias("std_delta"), F.count("*").alias("n_samples"))
