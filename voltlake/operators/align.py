"""Samples and interval annotations: markers, occurrences, islands, segments.

samples: filename, sample_idx, time, channel, value; annotations: filename, annot_idx, onset, duration, description.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voltlake.config import NO_MARKER


def canonical(description: Column, trim: bool = False) -> Column:
    d = F.trim(description) if trim else description
    return F.when(d == "Thinking and Acting", "Think_Acting").otherwise(d)


#: Seconds of a recording, and samples of it, that meet in one task when values are carried along it.
BUCKET_SECONDS, BUCKET_BITS = 3600.0, 16


def neighbours(times: DataFrame, points: DataFrame, at: str, width: float = BUCKET_SECONDS) -> DataFrame:
    """points (filename, `at` and others) with `before` and `after`: of the last time before `at` and the first one not before it,
    as structs of time, idx and upto (the least and greatest sample_idx of that time). A point without `at` is left out.

    An as-of merge: times and points of a bucket of `width` seconds are sorted together and the last time is carried along;
    times know the next one. What lies beyond a bucket comes from a table of the buckets' first and last times.
    """
    bucket = lambda c: F.floor(F.col(c) / width).alias("bucket")
    ticks = times.groupBy("filename", "time").agg(F.min("sample_idx").alias("idx"), F.max("sample_idx").alias("upto"))
    ticks = ticks.select("filename", bucket("time"), "time", F.struct("time", "idx", "upto").alias("here"))
    ticks = ticks.withColumn("next", F.lead("here").over(Window.partitionBy("filename", "bucket").orderBy("time")))
    asked = points.where(F.col(at).isNotNull()).select("filename", bucket(at), F.col(at).alias("time"), F.struct(*points.columns).alias("point"))
    both = ticks.withColumn("kind", F.lit(1)).unionByName(asked.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy("filename", "bucket").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 1, F.struct("here", "next")), True).over(past)
    met = both.withColumn("last", last).where("kind = 0").select("filename", "bucket", "point", "last")
    buckets = ticks.groupBy("filename", "bucket").agg(F.min("here").alias("first"), F.max("here").alias("final"))
    buckets = buckets.unionByName(asked.select("filename", "bucket").distinct(), allowMissingColumns=True).groupBy("filename", "bucket").agg(F.max("first").alias("first"), F.max("final").alias("final"))
    beside = lambda c, order: F.last(c, True).over(Window.partitionBy("filename").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    around = buckets.select("filename", "bucket", "first", beside("final", F.asc("bucket")).alias("earlier"), beside("first", F.desc("bucket")).alias("later"))
    joined = met.join(around, ["filename", "bucket"])
    after = F.when(F.col("last").isNull(), F.coalesce("first", "later")).otherwise(F.coalesce("last.next", "later"))
    return joined.select("point.*", F.coalesce("last.here", "earlier").alias("before"), after.alias("after"))


def nearest_samples(times: DataFrame, points: DataFrame) -> DataFrame:
    """filename, annot_idx, sample_idx: of each annotation the sample nearest to its onset, the lower index on ties."""
    met = neighbours(times, points.select("filename", "annot_idx", "onset"), "onset")
    from_ = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.time") - F.col("onset")).alias("off"), F.col(f"{c}.idx").alias("idx")))
    return met.select("filename", "annot_idx", F.least(from_("before"), from_("after"))["idx"].alias("sample_idx")).where("sample_idx is not null")


def _named(annotations: DataFrame) -> DataFrame:
    return annotations.withColumn("marker", canonical(F.col("description")))


def sample_spans(times: DataFrame, annotations: DataFrame) -> DataFrame:
    """filename, annot_idx, marker, first, end: the samples [first, end) that each annotation covers, half-open in time as well;
    one without duration covers the nearest sample. Times don't fall along sample_idx."""
    named = _named(annotations)
    ends = named.where("duration > 0").select("filename", "annot_idx", "marker", F.explode(F.array(F.struct(F.lit(True).alias("opens"), F.col("onset").alias("at")), F.struct(F.lit(False).alias("opens"), (F.col("onset") + F.col("duration")).alias("at")))).alias("e"))
    met = neighbours(times, ends.select("filename", "annot_idx", "marker", "e.opens", "e.at"), "at")
    position = F.coalesce(F.col("after.idx"), F.col("before.upto") + 1)
    of = lambda opens: F.max(F.when(F.col("opens") == opens, position))
    spans = met.groupBy("filename", "annot_idx", "marker").agg(of(True).alias("first"), of(False).alias("end"))
    points = named.where("duration <= 0")
    at = nearest_samples(times, points).join(points.select("filename", "annot_idx", "marker"), ["filename", "annot_idx"])
    return spans.where("first < end").unionByName(at.select("filename", "annot_idx", "marker", F.col("sample_idx").alias("first"), (F.col("sample_idx") + 1).alias("end")))


def regular_spans(headers: DataFrame, annotations: DataFrame) -> DataFrame:
    """The same for recordings (filename, sfreq, n_samples) whose sample i is at i / sfreq: by arithmetic, without their samples."""
    rows = _named(annotations).join(headers, "filename").where("n_samples > 0")

    def not_before(t: Column) -> Column:
        """The first i with i / sfreq >= t; a product rounded the other way is put right."""
        i = F.ceil(t * F.col("sfreq"))
        fits = lambda k: k / F.col("sfreq") >= t
        i = F.when(fits(i - 1), i - 1).when(fits(i), i).otherwise(i + 1)
        return F.greatest(F.lit(0), F.least(F.col("n_samples"), i))

    onset = F.col("onset")
    guess = F.floor(onset * F.col("sfreq"))
    near = [F.greatest(F.lit(0), F.least(F.col("n_samples") - 1, guess + k)) for k in (-1, 0, 1, 2)]
    nearest = F.least(*(F.struct(F.abs(i / F.col("sfreq") - onset).alias("off"), i.alias("idx")) for i in near))["idx"]
    long = F.col("duration") > 0
    first = F.when(long, not_before(onset)).otherwise(nearest)
    end = F.when(long, not_before(onset + F.col("duration"))).otherwise(nearest + 1)
    return rows.where("onset is not null and duration is not null").select("filename", "annot_idx", "marker", first.alias("first"), end.alias("end")).where("first < end")


def disjoint(spans: DataFrame) -> DataFrame:
    """filename, bucket, first, end, marker: spans that don't overlap, of the annotation with the greatest annot_idx of those that
    cover them; cut at the borders of buckets of samples, so that a long or crowded recording is dealt out.

    A sweep over spans in the order of their starts; it holds those that are open.
    """
    shift = lambda c: F.shiftright(c, BUCKET_BITS)
    cut = spans.withColumn("bucket", F.explode(F.sequence(shift(F.col("first")), shift(F.col("end") - 1))))
    low = F.shiftleft("bucket", BUCKET_BITS)
    cut = cut.select("filename", "bucket", F.greatest("first", low).alias("first"), F.least("end", low + (1 << BUCKET_BITS)).alias("end"), F.col("annot_idx").cast("long").alias("rank"), "marker")
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at = None, [], 0
        out: list[tuple] = []

        def advance(to: float) -> None:
            """What is covered up to a sample; touching pieces of one marker are one."""
            nonlocal at
            while held and at < to:
                _, end, marker = held[0]
                if end <= at:
                    heappop(held)
                    continue
                upto = min(end, to)
                if out and out[-1][:2] == key and out[-1][3] == at and out[-1][4] == marker:
                    out[-1] = (*key, out[-1][2], upto, marker)
                else:
                    out.append((*key, at, upto, marker))
                at = upto

        for batch in batches:
            for name, bucket, first, end, rank, marker in zip(*(batch.column(c).to_pylist() for c in ("filename", "bucket", "first", "end", "rank", "marker")), strict=True):
                if (name, bucket) != key:
                    advance(math.inf)
                    held.clear()
                    key, at = (name, bucket), first
                advance(first)
                at = max(at, first)
                heappush(held, (-rank, end, NO_MARKER if marker is None else marker))
            if len(out) > 4096:
                yield batch_of(out[:-1])
                del out[:-1]
        advance(math.inf)
        yield batch_of(out)

    types = spans.select("filename").schema

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kind = to_arrow_type(types[0].dataType)
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["filename", "bucket", "first", "end", "marker"])

    own = cut.repartition("filename", "bucket").sortWithinPartitions("filename", "bucket", "first", "rank")
    return own.mapInArrow(run, f"filename {kinds['filename']}, bucket bigint, first bigint, end bigint, marker string")


def mark(samples: DataFrame, annotations: DataFrame) -> DataFrame:
    """samples with `marker`: of the last annotation (by annot_idx) that covers a sample, half-open; one without duration marks
    the nearest sample.

    Annotations become disjoint spans of sample numbers; their ends are sorted among the samples of a bucket and the marker is
    carried along. Times don't fall along sample_idx.
    """
    times = samples.select("filename", "sample_idx", "time").distinct()
    spans = disjoint(sample_spans(times, annotations))
    ends = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("kind"), F.col("marker").alias("event")), F.struct(F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(NO_MARKER).alias("event"))))
    events = spans.select("filename", "bucket", ends.alias("e")).select("filename", "bucket", F.col("e.at").alias("__at"), F.col("e.kind").alias("__kind"), F.col("e.event").alias("__event"))
    events = events.where(F.shiftright("__at", BUCKET_BITS) == F.col("bucket")).withColumnRenamed("bucket", "__bucket")
    names = [c for c in samples.columns if c != "marker"]
    rows = samples.select(*names, F.shiftright(F.col("sample_idx").cast("long"), BUCKET_BITS).alias("__bucket"), F.col("sample_idx").cast("long").alias("__at"), F.lit(2).alias("__kind"))
    past = Window.partitionBy("filename", "__bucket").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = rows.unionByName(events, allowMissingColumns=True).withColumn("marker", F.coalesce(F.last("__event", True).over(past), F.lit(NO_MARKER)))
    return carried.where("__kind = 2").select(*names, "marker")


def runs(spans: DataFrame) -> DataFrame:
    """`islands` of the marked samples, from disjoint spans in place of samples: touching spans of one marker are one run."""
    order = Window.partitionBy("filename").orderBy("first")
    fresh = (F.lag("end").over(order) != F.col("first")) | (F.lag("marker").over(order) != F.col("marker"))
    numbered = spans.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(order))
    whole = numbered.groupBy("filename", "run", F.col("marker").alias("task")).agg(F.min("first").alias("start_idx"), (F.max("end") - 1).alias("end_idx"))
    own = Window.partitionBy("filename", "task").orderBy("start_idx")
    return whole.select("filename", "task", F.row_number().over(own).alias("occurrence"), "start_idx", "end_idx", (F.col("end_idx") - F.col("start_idx") + 1).alias("n_samples"))


def tasks(annotations: DataFrame) -> DataFrame:
    return annotations.select("filename", canonical(F.col("description")).alias("task")).distinct().orderBy("filename", "task")


def occurrences(annotations: DataFrame) -> DataFrame:
    """filename, annot_idx, task, occurrence (1-based, in the order of annotations), onset, duration."""
    order = Window.partitionBy("filename", "task").orderBy("annot_idx")
    return annotations.withColumn("task", canonical(F.col("description"))).select("filename", "annot_idx", "task", F.row_number().over(order).alias("occurrence"), "onset", "duration")


def timeline(annotations: DataFrame) -> DataFrame:
    rows = occurrences(annotations)
    return rows.select("filename", "annot_idx", F.concat_ws("_", "task", F.col("occurrence").cast("string")).alias("task_occ"), F.bround("onset", 2).alias("onset"), F.bround("duration", 2).alias("duration"))


def occurrence_pairs(annotations: DataFrame, a: str, b: str, reference_compat: bool = False) -> DataFrame:
    """filename, occ_a, occ_b of neighbours of tasks a and b, in either order.

    `reference_compat`: for b before a, both numbers are those of a's occurrence, as older results have it.
    """
    order = Window.partitionBy("filename").orderBy("annot_idx")
    rows = occurrences(annotations).where(F.col("task").isin(a, b))
    rows = rows.withColumns({"next_task": F.lead("task").over(order), "next_occ": F.lead("occurrence").over(order)})
    forward, back = (F.col("task") == a) & (F.col("next_task") == b), (F.col("task") == b) & (F.col("next_task") == a)
    pairs = rows.where(forward | back).select(
        "filename",
        F.when(forward, F.col("occurrence")).otherwise(F.col("next_occ")).alias("occ_a"),
        F.when(forward, F.col("next_occ")).otherwise(F.col("next_occ") if reference_compat else F.col("occurrence")).alias("occ_b"),
    )
    return pairs.distinct()


def islands(marked: DataFrame) -> DataFrame:
    """filename, task, occurrence, start_idx, end_idx, n_samples: maximal runs of samples with one marker, numbered from 1.

    The marker counts, not the annotation: annotations side by side are one run, and one in the middle splits a run.
    """
    own = Window.partitionBy("filename", "marker").orderBy("sample_idx")
    runs = marked.select("filename", "sample_idx", "marker").distinct().withColumn("island", F.col("sample_idx") - F.row_number().over(own))
    spans = runs.groupBy("filename", F.col("marker").alias("task"), "island").agg(F.min("sample_idx").alias("start_idx"), F.max("sample_idx").alias("end_idx"), F.count("*").alias("n_samples"))
    order = Window.partitionBy("filename", "task").orderBy("start_idx")
    return spans.select("filename", "task", F.row_number().over(order).alias("occurrence"), "start_idx", "end_idx", "n_samples")


def segments(marked: DataFrame, by_occurrence: bool = True) -> DataFrame:
    """filename, task[, occurrence], channel, samples (in order): each run, or all of a task's samples one after the other."""
    rows = marked.where(F.col("marker") != NO_MARKER)
    keys = ["filename", "task", "channel"]
    if by_occurrence:
        own = Window.partitionBy("filename", "channel", "marker").orderBy("sample_idx")
        rows = rows.withColumn("island", F.col("sample_idx") - F.row_number().over(own))
        keys = ["filename", "task", "island", "channel"]
    ordered = F.array_sort(F.collect_list(F.struct("sample_idx", "value")))
    out = rows.withColumn("task", F.col("marker")).groupBy(*keys).agg(F.transform(ordered, lambda s: s["value"]).alias("samples"))
    if not by_occurrence:
        return out
    order = Window.partitionBy("filename", "task", "channel").orderBy("island")
    return out.select("filename", "task", F.row_number().over(order).alias("occurrence"), "channel", "samples")


def sliced_segments(signals: DataFrame, annotations: DataFrame, *more: str) -> DataFrame:
    """filename, task, channel, samples: pieces [int(onset * rate), int((onset + duration) * rate)) of each annotation with a
    duration, one after the other (what overlaps counts twice); a recording without any is one task, full_recording.
    more: columns that tell signals of one channel apart."""
    named = annotations.where("duration > 0").withColumn("task", canonical(F.col("description"), trim=True))
    start = F.greatest(F.lit(0), F.floor(F.col("onset") * F.col("sfreq"))).cast("int")
    size = F.greatest(F.lit(0), F.floor((F.col("onset") + F.col("duration")) * F.col("sfreq")).cast("int") - start)
    pieces = signals.join(named, "filename").select("filename", "sfreq", "task", "channel", *more, "annot_idx", F.slice("samples", start + 1, size).alias("piece"))
    joined = pieces.groupBy("filename", "sfreq", "task", "channel", *more).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("annot_idx", "piece"))), lambda s: s["piece"])).alias("samples"))
    whole = signals.join(annotations.select("filename").distinct(), "filename", "left_anti").select("filename", "sfreq", F.lit("full_recording").alias("task"), "channel", *more, "samples")
    return joined.unionByName(whole)


def task_summary(marked: DataFrame, sfreq: float) -> DataFrame:
    """filename, task, n_samples, duration_s, percent_total; the unmarked samples too, most frequent first."""
    counts = marked.select("filename", "sample_idx", "marker").distinct().groupBy("filename", F.col("marker").alias("task")).agg(F.count("*").alias("n_samples"))
    whole = F.sum("n_samples").over(Window.partitionBy("filename"))
    return counts.select(
        "filename",
        "task",
        "n_samples",
        F.bround(F.col("n_samples") / sfreq, 2).alias("duration_s"),
        F.bround(100 * F.col("n_samples") / whole, 1).alias("percent_total"),
    ).orderBy("filename", F.desc("n_samples"), "task")


def annotation_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("description").agg(F.count("*").alias("n"))


def time_range(samples: DataFrame, start: float, end: float) -> DataFrame:
    """Both ends belong to it."""
    return samples.where(F.col("time").between(start, end))
