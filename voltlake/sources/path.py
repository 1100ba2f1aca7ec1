"""Recording metadata from paths, as column expressions: no file is opened for it, and filters on it prune files early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    # Of a member of an archive, only its own path counts.
    own = F.substring_index(path, "!/", -1)
    parts = F.split(F.translate(own, "\\", "/"), "/")
    return F.filter(parts, lambda p: (p != "") & ~F.lower(p).endswith(".edf"))


def path_metadata(path: Column) -> dict[str, Column]:
    """category, subject, time and scenario.

    The last part that begins with ALS (in any case; digits may follow) is the subject, of category ALS; else the first of
    the form id<digits>, of category Normal; else the subject is unknown. time... and scenario...: the last such part.
    """
    parts = _parts(path)
    is_als = lambda p: F.upper(p).rlike("^ALS[0-9]*")
    last = lambda keep: F.try_element_at(F.filter(parts, keep), F.lit(-1))
    als = last(is_als)
    first_id = F.try_element_at(F.filter(parts, lambda p: F.lower(p).rlike("^id[0-9]+$")), F.lit(1))
    plain = lambda prefix: last(lambda p: F.lower(p).startswith(prefix) & ~is_als(p))
    return {
        "category": F.when(als.isNotNull(), "ALS").otherwise("Normal"),
        "subject": F.coalesce(als, first_id, F.lit("unknown")),
        "time": F.coalesce(plain("time"), F.lit("")),
        "scenario": F.coalesce(plain("scenario"), F.lit("")),
    }


def with_path_metadata(df: DataFrame, path: str = "filename") -> DataFrame:
    return df.withColumns(path_metadata(F.col(path)))


def group_of(subject: Column) -> Column:
    """ALS or Control, by the subject's exact prefix."""
    return F.when(subject.startswith("ALS"), "ALS").otherwise("Control")


def in_scenarios(path: Column, scenarios: list[str]) -> Column:
    """Whether a path is <subject>/time.../<one of the scenarios>/EEG.edf."""
    names = "|".join(scenarios)
    return path.rlike(rf"(^|/)[^/]+/time[^/]*/({names})/EEG\.edf$")
