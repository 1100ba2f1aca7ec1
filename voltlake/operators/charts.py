"""The data of charts: what a figure draws, as a frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators import align, reshape
from voltlake.session import kept


def task_lines(marked: DataFrame, task: str, start: float | None = None, end: float | None = None) -> DataFrame:
    rows = marked.where(F.col("marker") == task)
    return rows if start is None or end is None else align.time_range(rows, start, end)


def histogram(samples: DataFrame, by: str, value: str, bins: int = 80) -> DataFrame:
    """`by`, bin (1-based), n: equal bins from each group's least to its largest value, which is in the last one."""
    ends = samples.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    b = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins), F.floor(F.try_divide((F.col(value) - F.col("low")) * bins, F.col("high") - F.col("low"))).cast("int") + 1)).otherwise(1)
    return samples.join(ends, by).groupBy(by, b.alias("bin")).agg(F.count("*").alias("n"))


_PAIR = "channel_a string, channel_b string, n bigint, mean_a double, mean_b double, spread_a double, spread_b double, product double"


def co_moments(values: np.ndarray, channels: list[str]) -> list[tuple]:
    """_PAIR of each two channels (columns), over the rows that have both (NaN: not there)."""
    there = ~np.isnan(values)
    some = there.astype(np.float64)
    # About the channels' own means, so that nothing is lost in differences; any others would do.
    middle = np.where(there.any(axis=0), np.nansum(values, axis=0) / np.maximum(1, some.sum(axis=0)), 0.0)
    x = np.where(there, values - middle, 0.0)
    n = some.T @ some
    safe = np.maximum(n, 1)
    first = x.T @ some / safe  # [a, b]: mean of a where b is
    spread = (x**2).T @ some - n * first**2
    product = x.T @ x - n * first * first.T
    out = []
    for i, a in enumerate(channels):
        for j, b in enumerate(channels):
            if n[i, j]:
                out.append((a, b, int(n[i, j]), first[i, j] + middle[i], first[j, i] + middle[j], max(0.0, spread[i, j]), max(0.0, spread[j, i]), product[i, j]))
    return out


def _correlated(parts: DataFrame, by: list[str]) -> DataFrame:
    """r of merged parts: a few rows for each task, whatever the number of samples."""
    own = Window.partitionBy(*by, "channel_a", "channel_b")
    over = lambda c: F.sum(F.col("n") * F.col(c)).over(own) / F.sum("n").over(own)
    near = parts.withColumns({"off_a": F.col("mean_a") - over("mean_a"), "off_b": F.col("mean_b") - over("mean_b")})
    n, a, b = F.col("n"), F.col("off_a"), F.col("off_b")
    sums = near.groupBy(*by, "channel_a", "channel_b").agg(F.sum(F.col("spread_a") + n * a * a).alias("va"), F.sum(F.col("spread_b") + n * b * b).alias("vb"), F.sum(F.col("product") + n * a * b).alias("c"))
    vary = (F.col("va") > 0) & (F.col("vb") > 0)
    return sums.select(*by, "channel_a", "channel_b", F.when(vary, F.try_divide("c", F.sqrt("va") * F.sqrt("vb"))).alias("r"))


def correlation(samples: DataFrame, by: str = "filename", at: str = "sample_idx") -> DataFrame:
    """`by`, channel_a, channel_b, r: of each recording, Pearson over the samples that both channels have; null where one doesn't vary.

    Channels of a sample meet in one array, so samples are shuffled once and never joined with themselves; then each task
    keeps one matrix of co-moments for each recording, and these are merged. Samples in chunks need no such shuffle: `chunk_correlation`.
    """
    kind = samples.schema[by].dataType.simpleString()
    rows = samples.where("value is not null and not isnan(value)").groupBy(by, at).agg(F.collect_list(F.struct(F.col("channel").cast("string").alias("channel"), F.col("value").cast("double").alias("value"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("c")
            each, owner = column.flatten(), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            names, values = each.field("channel").dictionary_encode(), each.field("value").to_numpy()
            keys = batch.column(by).dictionary_encode()
            own = keys.indices.fill_null(len(keys.dictionary)).to_numpy()
            codes, known = names.indices.to_numpy(), names.dictionary.to_pylist()
            for k in np.unique(own):
                mine = own[owner] == k
                at_, columns = np.unique(owner[mine], return_inverse=True)[1], np.unique(codes[mine])
                table = np.full((at_.max() + 1, len(columns)), np.nan)
                table[at_, np.searchsorted(columns, codes[mine])] = values[mine]
                pairs = co_moments(table, [known[c] for c in columns])
                key = keys.dictionary[int(k)] if k < len(keys.dictionary) else pa.scalar(None, keys.dictionary.type)
                yield _pairs(key, pairs, by)

    return _correlated(rows.select(by, "c").mapInArrow(run, f"`{by}` {kind}, {_PAIR}"), [by])


def _pairs(key: pa.Scalar, pairs: list[tuple], by: str) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 5)
    columns = [pa.array([p[i] for p in pairs], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(pairs), key.type), *columns], [by, *(c.split()[0] for c in _PAIR.split(", "))])


def chunk_correlation(signals: DataFrame) -> DataFrame:
    """filename, channel_a, channel_b, r of recordings in chunks, all of whose channels have the same samples.

    The channels of a chunk meet in one task: a shuffle by chunk, and none at all in what a matrix is made of.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("channel")
        values = np.stack([np.asarray(x.values, np.float64) for x in group.column("samples")], axis=1)
        return pa.Table.from_batches([_pairs(group.column("filename")[0], co_moments(values, group.column("channel").to_pylist()), "filename")])

    parts = signals.select("filename", "chunk", "channel", "samples").groupBy("filename", "chunk").applyInArrow(run, f"filename string, {_PAIR}")
    return _correlated(parts, ["filename"])


_BITS = 16


def _sortable(value: Column) -> Column:
    """A double as a whole number of the same order (-0.0 counts as 0.0)."""

    @F.pandas_udf("bigint")
    def bits(v: pd.Series) -> pd.Series:
        b = (v.to_numpy(np.float64) + 0.0).view(np.int64)
        return pd.Series(np.where(b < 0, b ^ np.int64((1 << 63) - 1), b))

    return bits(value)


def _double(order: Column) -> Column:
    @F.pandas_udf("double")
    def back(v: pd.Series) -> pd.Series:
        b = v.to_numpy(np.int64)
        return pd.Series(np.where(b < 0, b ^ np.int64((1 << 63) - 1), b).view(np.float64))

    return back(order)


def _matched(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on names, where nulls are equal; b's own names go."""
    other = b.withColumnsRenamed({c: f"__{c}" for c in names})
    met = a.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names], how)
    return met.drop(*(f"__{c}" for c in names))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """`by` and a column for each of `at`: exact quantiles, interpolated linearly between ranks; nulls and NaN don't count.

    Selection by counting: values become whole numbers of the same order, and the ranks that are looked for are followed through
    `_BITS` bits of them at a time, four rounds for any data. A round counts rows by these bits, before they are shuffled, among
    those that agree with a rank's bits so far; so no task ever holds a group's values. Values are written once and read by each
    round; what a round finds is some rows a group.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, _sortable(F.col(value).cast("double")).alias("order"))
    rows = kept(rows)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    places = [f(p) for p in at.values() for f in (lambda p: F.floor((F.col("n") - 1) * p), lambda p: F.ceil((F.col("n") - 1) * p))]
    # rank: how many rows of those that agree so far stand before the one that is looked for.
    sought = counts.select(*by, F.explode(F.array_distinct(F.array(*(p.cast("long") for p in places)))).alias("place")).select("*", F.col("place").alias("rank"), F.lit(None).cast("long").alias("prefix"))
    for shift in range(64 - _BITS, -1, -_BITS):
        step = rows.select(*by, (F.shiftright("order", shift + _BITS) if shift + _BITS < 64 else F.lit(None).cast("long")).alias("prefix"), F.shiftright("order", shift).alias("bits"))
        wanted = sought.select(*by, "prefix").distinct()
        near = _matched(step, wanted, [*by, "prefix"], "left_semi") if shift + _BITS < 64 else step
        bins = near.groupBy(*by, "prefix", "bits").agg(F.count("*").alias("m"))
        below = F.sum("m").over(Window.partitionBy(*by, "prefix").orderBy("bits"))
        bins = bins.withColumn("upto", below)
        met = _matched(sought, bins, [*by, "prefix"]).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
        sought = kept(met.select(*by, "place", (F.col("rank") - (F.col("upto") - F.col("m"))).alias("rank"), F.col("bits").alias("prefix")))
    values = sought.select(*by, "place", _double(F.col("prefix")).alias("v"))
    found = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("found"))
    met = _matched(counts, found, by) if by else counts.crossJoin(found)

    def interpolated(p: float) -> Column:
        place = (F.col("n") - 1) * p
        low, high = (F.element_at("found", f(place).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return met.select(*by, *(interpolated(p).alias(name) for name, p in at.items()))


def box(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 of the quartiles' distance) and how many lie beyond."""
    quartiles = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    rows = df.where(v.isNotNull() & ~F.isnan(v)).join(quartiles, by)
    return rows.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))


def grouped_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"))


def delta_bars(summary: DataFrame, feature: str) -> DataFrame:
    """label and value, the largest changes first."""
    value = F.col(f"mean_delta_{feature}")
    return summary.select(F.concat_ws(" / ", "channel", "subband").alias("label"), value.alias("value")).orderBy(F.abs(value).desc(), "label")


def per_file_bars(delta: DataFrame, feature: str, n: int = 20) -> DataFrame:
    label = F.concat(reshape.short_name(F.col("filename")), F.lit(" | "), F.col("channel"), F.lit("_"), F.col("subband"))
    return reshape.top_abs(delta.select(label.alias("label"), F.col(f"delta_{feature}").alias("value")), "value", ["label"], n)


def significance(p: Column, first: Column, second: Column) -> dict[str, Column]:
    """The mark over a pair of bars, and how high it stands."""
    from voltlake.operators.stats import star

    return {"mark": star(p), "height": 1.15 * F.greatest(F.abs(first), F.abs(second))}
