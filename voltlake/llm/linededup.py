"""Line deduplication: a line goes if an equal line, or one within one edit, stands earlier in the corpus.

Earlier means a lower (key, line number), null keys last; the key must be a whole number (else TypeError). Lines are what
'\\n' divides; a line counts without the blanks (U+0020) at its ends. Equal lines count from `exact_chars` characters on (1: all but
blank ones; or from `min_chars`, if that is less), near ones from `min_chars` on: within one edit, a short line is soon another word. An edit is one character inserted,
deleted or replaced. "Earlier" looks at all lines, kept or not, so the result doesn't depend on an order of work.

Lines that share half of themselves with others, and then all but a sixteenth, emit their deletion variants (themselves
without one character, in the part that may differ) as hashed keys. Equal variants meet: a line and what another one becomes by a deletion differ by one insertion; two lines
that become equal by deletions at one place differ by one replacement. Each key keeps its earliest line only, so no
bucket is paired out, and each pair found is verified by its edit distance.

* null text stays null, empty text empty; repeated rows (equal key and text) share their fate
* rows are told apart by key and text: of different texts that share a key, or have none, each loses its own lines; of two
  such lines with equal numbers, a hash of the whole text says which is the earlier
* a long text is as many lines as it has; a long line emits as many variants as it has characters
* columns of any other name are ignored by `marks`, and kept by `clean`, whatever their names; an empty table gives an empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MIN_CHARS, EXACT_CHARS = 20, 1
#: Parts in which a line is searched for the one that an edit stands in, before variants of that part are emitted.
PARTS = 16
#: What tells a line's place; places are compared in this order.
_PLACE = ["id", "no", "same"]
_LAST = (1 << 63) - 1


def _lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """id (the key, null last), same (a hash of the whole text), no, line; of all lines that are long enough."""
    common.whole_number(docs, key)
    split = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("same"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line"))
    return split.withColumn("line", F.trim("line")).where(F.length("line") >= least)


def _halves() -> Column:
    """Keys of which two lines within one edit share one at least.

    Of two such lines, n the length of the shorter: the edit stands behind its first n // 2 characters, which are then
    the same in both, or before the rest, which are then the last ones of both. A line of n characters may be the
    shorter one (class n) or the longer one by one (class n - 1).
    """
    n = F.length("line")
    keys = []
    for size in (n, n - 1):
        half = F.floor(size / 2).cast("int")
        keys += [F.xxhash64(F.lit("p"), size, F.substring(F.col("line"), F.lit(1), half)), F.xxhash64(F.lit("s"), size, F.substring(F.col("line"), n - (size - half) + 1, size - half))]
    return F.array(*keys)


def _again(c: str) -> Column:
    """A bigint under another value of its own: a join on it deals its rows out by itself, so that Spark can split a hot key."""
    return F.bitwise_not(F.col(c))


class Hashes:
    """Hashes of a line and of what is left of it without some of its characters, each at the cost of a few additions."""

    def __init__(self, line: str):
        codes = common.mix(np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        self.n = len(codes)
        power = np.full(self.n + 1, 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        zero = np.zeros(1, np.uint64)
        self.before = np.concatenate((zero, np.add.accumulate(codes * self.power[: self.n])))
        # Of the last characters, as they would be counted at the start of a line.
        self.last = np.concatenate((zero, np.add.accumulate(codes[::-1] * self.power[: self.n])))
        self.shifted = np.concatenate((zero, np.add.accumulate(codes[1:] * self.power[: self.n - 1])))

    def whole(self) -> np.ndarray:
        return common.mix(self.before[-1:] ^ np.uint64(self.n))

    def without(self, at: np.ndarray) -> np.ndarray:
        """Without the character at each place; not mixed yet."""
        return self.before[at] + self.shifted[-1] - self.shifted[at]

    def around(self, size: int) -> np.ndarray:
        """Of each of the parts of a line of `size` characters: what stands before it and, from the end, after it."""
        bounds = part_bounds(size)
        ends = common.mix(self.before[bounds[:-1]] + np.uint64(size)) + np.uint64(3) * self.last[size - bounds[1:]]
        return common.mix(ends + np.arange(PARTS, dtype=np.uint64))


def part_bounds(size: int) -> np.ndarray:
    return size * np.arange(PARTS + 1) // PARTS


def variant_keys(line: str, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Hashed keys of a line by role: 0 itself; 1 without one of its characters; 2 the same with the character's place.

    `places` has classes (the length of the shorter line of a pair) and parts in which the edit may stand. In a class of
    its own length a line can be the shorter one, or as long; in the one below, it is the longer one.
    """
    h = Hashes(line)
    shorter = [np.arange(part_bounds(size)[i], part_bounds(size)[i + 1]) for size, i in places if size == h.n]
    longer = [np.arange(part_bounds(size)[i], part_bounds(size)[i + 1] + 1) for size, i in places if size == h.n - 1]
    none = np.zeros(0, np.int64)
    gone, placed = np.unique(np.concatenate([none, *longer])), np.unique(np.concatenate([none, *shorter]))
    return [
        h.whole(),
        np.unique(common.mix(h.without(gone) ^ np.uint64(h.n - 1))),
        common.mix(h.without(placed) + common.mix(placed.astype(np.uint64) + np.uint64(h.n << 32))),
    ]


def _parts(survivors: DataFrame) -> DataFrame:
    """Place, size, part, around: of each line as the shorter and as the longer one of a pair, each part and what is around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "line", 1 << 18):
            sizes, around = [], []
            for t in batch.column("line").to_pylist():
                h = Hashes(t)
                sizes += [h.n, h.n - 1]
                around += [h.around(h.n), h.around(h.n - 1)]
            take = pa.array(np.repeat(np.arange(batch.num_rows), 2 * PARTS))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(take) for c in _PLACE),
                    pa.array(np.repeat(np.array(sizes, np.int32), PARTS)),
                    pa.array(np.tile(np.arange(PARTS, dtype=np.int32), len(sizes))),
                    pa.array(np.concatenate(around).view(np.int64)),
                ],
                [*_PLACE, "size", "part", "around"],
            )

    return survivors.select(*_PLACE, "line").mapInArrow(run, "id bigint, no int, same bigint, size int, part int, around bigint")


def _variants(lines: DataFrame) -> DataFrame:
    """Place, variant, role of lines with `places`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "line", 1 << 16):
            keys = [variant_keys(t, [(p["size"], p["part"]) for p in places]) for t, places in zip(batch.column("line").to_pylist(), batch.column("places").to_pylist(), strict=True)]
            take = pa.array(np.repeat(np.arange(len(keys)), [sum(map(len, k)) for k in keys]))
            role = np.concatenate([np.repeat(np.arange(3, dtype=np.int8), [len(x) for x in k]) for k in keys])
            values = np.concatenate([x for k in keys for x in k]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in _PLACE), pa.array(values), pa.array(role)], [*_PLACE, "variant", "role"])

    return lines.select(*_PLACE, "line", "places").mapInArrow(run, "id bigint, no int, same bigint, variant bigint, role tinyint")


def near_pairs(lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """Of distinct lines with an earlier one within one edit: its first place, and that one's (other_id, other_no, other_same)."""
    keyed = distinct.select("first", F.explode(F.array_distinct("halves")).alias("half"))
    shared = keyed.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select(_again("half").alias("k"))
    places = keyed.join(shared, _again("half") == F.col("k"), "left_semi").select("first.*").distinct()
    survivors = common.stash(lines.join(places, _PLACE, "left_semi").dropDuplicates(_PLACE))
    parts = _parts(survivors)
    met = parts.groupBy("around").agg(F.count("*").alias("n")).where("n > 1").select(_again("around").alias("k"))
    narrowed = parts.join(met, _again("around") == F.col("k"), "left_semi").groupBy(*_PLACE).agg(F.collect_set(F.struct("size", "part")).alias("places"))
    rows = common.stash(_variants(survivors.join(narrowed, _PLACE)))
    place = F.struct(*_PLACE)
    earliest = rows.groupBy("variant").agg(*(F.min(F.when(F.col("role") == r, place)).alias(f"r{r}") for r in range(3)))
    # A key that only one line has is dropped before anything meets.
    earliest = earliest.where("(r0 is not null and r1 is not null) or r2 is not null").select(_again("variant").alias("k"), "r0", "r1", "r2")
    partner = F.when(F.col("role") == 0, F.col("r1")).when(F.col("role") == 1, F.col("r0")).otherwise(F.col("r2"))
    found = rows.join(earliest, _again("variant") == F.col("k")).withColumn("other", partner).where(F.col("other") < place)
    others = [f"other_{c}" for c in _PLACE]
    pairs = found.select(*_PLACE, *(F.col(f"other.{c}").alias(f"other_{c}") for c in _PLACE)).distinct()
    other = survivors.select(*(F.col(c).alias(f"other_{c}") for c in (*_PLACE, "line")))
    both = pairs.join(survivors, _PLACE).join(other, others)
    return both.where(F.levenshtein("line", "other_line", 1).between(0, 1)).select(*_PLACE, *others)


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """Per document that loses lines: id, same, and their numbers (0-based)."""
    lines = _lines(docs, key, text, max(1, min(min_chars, exact_chars)))
    # Lines that are too short to be near another one have no halves.
    places = lines.select(*_PLACE, F.length("line").alias("n"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), F.when(F.length("line") >= min_chars, _halves()).alias("halves"))
    distinct = common.stash(places.groupBy("h", "g").agg(F.min(F.struct(*_PLACE)).alias("first"), F.max(F.struct(*_PLACE)).alias("last"), F.first("halves").alias("halves"), F.first("n").alias("n")))
    near = near_pairs(lines, distinct).select(*_PLACE).distinct().withColumn("near", F.lit(True))
    verdict = distinct.select("h", "g", "n", "first", "last", "first.*").join(near, _PLACE, "left")
    again = (F.col("first") < F.col("last")) & (F.col("n") >= min(min_chars, exact_chars))
    verdict = verdict.where(F.col("near") | again).select(_again("h").alias("k"), F.col("g").alias("g2"), "first", again.alias("again"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = places.select(*_PLACE, "h", "g").join(verdict, (_again("h") == F.col("k")) & (F.col("g") == F.col("g2"))).where(F.col("near") | F.col("again") & (F.struct(*_PLACE) > F.col("first")))
    return gone.groupBy("id", "same").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def _rebuilt(docs: DataFrame, key: str, text: str, gone_: str, min_chars: int, exact_chars: int) -> DataFrame:
    """All columns of docs and `gone_`, the numbers of lines to drop, with `text` without them."""
    id_, same_ = common.free_names(docs.withColumn(gone_, F.lit(0)), "id", "same")
    gone = dropped(docs, key, text, min_chars, exact_chars).withColumnsRenamed({"id": id_, "same": same_, "gone": gone_})
    joined = docs.join(gone, (F.coalesce(F.col(key).cast("long"), F.lit(_LAST)) == F.col(id_)) & (F.xxhash64(text) == F.col(same_)), "left").drop(id_, same_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            new = []
            for t, out in zip(batch.column(text).to_pylist(), batch.column(gone_).to_pylist(), strict=True):
                if out and t is not None:
                    no = set(out)
                    t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in no)
                new.append(t)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return joined.mapInArrow(run, joined.schema)


def marks(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """Per document row: the key, n_lines, n_removed, removed (line numbers, 0-based), and the text that is left."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"))
    out = _rebuilt(rows, "key", "text", "gone", min_chars, exact_chars).withColumn("removed", F.coalesce("gone", F.array().cast("array<int>")))
    out = out.withColumn("removed", F.filter("removed", lambda i: i < F.col("n_lines")))
    return out.select(F.col("key").alias(key), "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", length_column: str | None = "n_chars", min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """The documents without the lines that go; a document that loses all its words this way goes too."""
    (gone_,) = common.free_names(docs, "gone")
    out = _rebuilt(docs, key, text, gone_, min_chars, exact_chars).where(F.col(gone_).isNull() | (F.length(F.trim(F.translate(text, "\n", " "))) > 0))
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.when(F.col(gone_).isNull(), F.col(length_column)).otherwise(F.length(text)).cast(kind))
    return out.select(docs.columns)
