"""Suffix deduplication: bytes go that a string of `length` bytes covers which also starts anywhere else.

Bucket-pointer refinement over the bytes of all documents. The first bucket identifiers of a place are its next eight
bytes; a place's identifier at twice the depth comes from its own one and that of the place so many bytes later, and so on
until `length`, each depth from the one before. What is sorted and counted across documents is refined step by step:

1. Every string of `length` bytes has an anchor, the place in it with the least identifier at depth `gram` (the leftmost
   of several). Equal strings have the same anchor, so a string can only recur if the bucket of its anchor has another place.
   Only such buckets go on.
2. The strings of an anchor are neighbours. Their first and last one identify them all: where these recur together, all do.
3. Of the anchors left over, which stand at the ends of what recurs, each string is held against those of the same bucket.
   Buckets of over `HOT` anchors are held string by string, as counts, which Spark adds up before it deals them out and
   can split after.

`repeats` reads only the key and the text (columns of any other name are ignored) and returns one row per document row.
Null and empty texts have no bytes; texts shorter than `length` keep all of theirs; matches never cross documents. Repeated
rows are copies of each other, so each loses all that is long enough; null keys are keys like any other. Rows are told apart by
key and content. An empty table gives an empty result. Identifiers have 64 bits; two of them must agree for a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
#: Anchors in a bucket from which it is held string by string.
HOT = 4096
#: Bytes of text that are worked on at once.
SLICE = 1 << 19
#: Distances to the anchor that one row of step 3 holds.
BLOCK = 32
_LAST = (1 << 63) - 1
_U = np.uint64


def _refine(own: np.ndarray, later: np.ndarray) -> np.ndarray:
    h = own ^ (own >> _U(32))
    h *= _U(0x9E3779B97F4A7C15)
    h += later * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(29)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def gram_of(length: int) -> int:
    """The depth of anchors: the largest of 8, 16, 32, ... up to a quarter of the length, but 8 at least."""
    gram = 8
    while gram * 8 <= length:
        gram *= 2
    return gram


def identifiers(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of each place at depth `gram_of(length)` and at depth `length`."""
    n = len(text)
    padded = np.zeros(n + 15, np.uint8)
    padded[:n] = text
    ids = np.zeros(n + 7, np.uint64)
    for k in range(8):
        part = padded[k : k + (n + 7 - k) // 8 * 8].view("<u8")
        ids[k : k + 8 * len(part) : 8] = part
    ids = ids[: max(0, n - 7)]
    depth, gram = 8, gram_of(length)
    at_gram = ids
    while depth < length:
        step = min(depth, length - depth)
        ids = _refine(ids[: max(0, len(ids) - step)], ids[step:])
        depth += step
        if depth == gram:
            at_gram = ids
    return at_gram, ids


def anchors(text: np.ndarray, sizes: np.ndarray, length: int) -> dict[str, np.ndarray] | None:
    """Anchors of documents of `sizes` bytes, one after the other in `text`.

    doc; first: its first string's place in its document; n: how many strings it has; far: its distance from the first;
    gram: its bucket; ends: of its first and last string.
    """
    ends = np.cumsum(sizes)
    at_gram, whole = identifiers(text, length)
    if not len(whole):
        return None
    least = (at_gram & _U(0xFFFFFFFF00000000)) | np.arange(len(at_gram), dtype=np.uint64)
    width, step = length - gram_of(length) + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: step - width], least[width - step :])
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(whole)]
    place = np.flatnonzero(np.arange(len(whole)) + length <= ends[doc])
    if not len(place):
        return None
    anchor, doc = (least[place] & _U(0xFFFFFFFF)).astype(np.int64), doc[place]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(first, len(place)))
    begin, doc, anchor = place[first], doc[first], anchor[first]
    pair = _refine(whole[begin], whole[begin + n - 1] ^ ((anchor - begin) * 65536 + n).astype(np.uint64))
    return {"doc": doc, "first": begin - (ends - sizes)[doc], "n": n, "far": anchor - begin, "gram": at_gram[anchor], "ends": pair}


def _raws(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raws = common.texts(batch, "text")
    return np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _again(c: str) -> Column:
    """A bigint under another value of its own: a join on it deals its rows out by itself, so that Spark can split a hot key."""
    return F.bitwise_not(F.col(c))


_PIECE = "struct<first:int,n:int,far:int,gram:bigint,hot:boolean,single:boolean>"


def _strings(texts: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """The strings of pieces: in rows of up to BLOCK neighbours of one bucket, or (hot: part -1) each one as its own bucket."""
    listed = pieces.groupBy("id", "same").agg(F.collect_list(F.struct("first", "n", "far", "gram", "hot", "single")).alias("pieces"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            raws = common.texts(batch, "text")
            of = batch.column("pieces")
            rows = np.repeat(np.arange(len(raws)), [len(x) for x in of])
            flat = of.flatten()
            first, n, far, gram = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "n", "far", "gram"))
            hot, single = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("hot", "single"))
            cut = b"".join(raws[r][a : a + k + length - 1] for r, a, k in zip(rows.tolist(), first.tolist(), n.tolist(), strict=True))
            ids = identifiers(np.frombuffer(cut, np.uint8), length)[1]
            sizes = n + length - 1
            piece = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
            ids = ids[np.repeat(np.cumsum(sizes) - sizes, n) + step]
            part = np.where(hot[piece], -1 - step, (far[piece] - step) // BLOCK)
            start = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (part[1:] != part[:-1]))))
            size = np.diff(np.append(start, len(piece)))
            p = piece[start]
            is_hot = hot[p]
            own = _refine(gram[p].view(np.uint64), ids[start])
            bucket = np.where(is_hot, own.view(np.int64), gram[p])
            raw, at = ids.tobytes(), (8 * start).tolist()
            held = pa.array([b"" if h else raw[a : a + 8 * s] for a, s, h in zip(at, size.tolist(), is_hot.tolist(), strict=True)], pa.binary())
            take = pa.array(rows[p])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("same").take(take), pa.array(bucket), _int(np.maximum(part[start], -1)), _int(first[p] + step[start]), pa.array(single[p]), held],
                ["id", "same", "bucket", "part", "first", "single", "held"],
            )

    joined = texts.join(listed, ["id", "same"]).select("id", "same", "text", F.col("pieces").cast(f"array<{_PIECE}>").alias("pieces"))
    return joined.mapInArrow(run, "id bigint, same bigint, bucket bigint, part int, first int, single boolean, held binary")


def _recurring(strings: DataFrame) -> DataFrame:
    """id, same, first, n: runs of strings, out of rows of `_strings` that aren't hot, which others of their bucket equal."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        sizes = np.array([len(x) // 8 for x in table.column("held").to_pylist()], np.int64)
        ids = np.frombuffer(b"".join(table.column("held").to_pylist()), np.uint64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bucket = table.column("bucket").to_numpy().astype(np.int64).view(np.uint64)
        key = _refine(ids, bucket[row])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        hit = np.flatnonzero(twice & table.column("single").to_numpy()[row])
        begin = np.flatnonzero(np.concatenate(([True], (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])))) if len(hit) else hit
        n = np.diff(np.append(begin, len(hit)))
        r = row[hit[begin]]
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([table.column("id").combine_chunks().take(take), table.column("same").combine_chunks().take(take), _int(table.column("first").to_numpy()[r] + step[hit[begin]]), _int(n)], ["id", "same", "first", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part = batch.column("bucket").to_numpy(), batch.column("part").to_numpy()
            other = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on in the next batch
            if open_ and (open_[-1].column("bucket")[-1].as_py(), open_[-1].column("part")[-1].as_py()) != (int(bucket[0]), int(part[0])):
                yield found(open_)
                open_ = []
            if whole:
                yield found([*open_, batch.slice(0, whole)])
                open_ = []
            open_.append(batch.slice(whole))
        if open_:
            yield found(open_)

    dealt = strings.repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return dealt.mapInArrow(run, "id bigint, same bigint, first int, n int")


def repeated_strings(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, same, first, n: of each document, runs of n places from `first` on at which a string starts that recurs."""
    gram_rows = texts.select("id", "same", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            found = anchors(*_raws(batch), length)
            if found:
                take = pa.array(found["doc"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("same").take(take), _int(found["first"]), _int(found["n"]), _int(found["far"]), _long(found["gram"]), _long(found["ends"])],
                    ["id", "same", "first", "n", "far", "gram", "ends"],
                )

    every = common.stash(gram_rows.mapInArrow(run, "id bigint, same bigint, first int, n int, far int, gram bigint, ends bigint"))
    several = every.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select(_again("gram").alias("k"))
    shared = common.stash(every.join(several, _again("gram") == F.col("k"), "left_semi"))
    common.discard(every)
    classes = shared.groupBy("gram", "ends").agg(F.count("*").alias("c"), F.min(F.struct("id", "same", "first", "n", "far")).alias("one"))
    classes = common.stash(classes.where("c > 1"))
    met = (_again("gram") == F.col("k")) & (F.col("ends") == F.col("e"))
    keys = classes.select(_again("gram").alias("k"), F.col("ends").alias("e"))
    whole = shared.join(keys, met, "left_semi").select("id", "same", "first", "n")
    single = common.stash(shared.join(keys, met, "left_anti").select("id", "same", "first", "n", "far", "gram", F.lit(True).alias("single")))
    with_single = single.select(_again("gram").alias("k")).distinct()
    one = classes.join(with_single, _again("gram") == F.col("k"), "left_semi").select("one.*", "gram", F.lit(False).alias("single"))
    pieces = single.union(one)
    hot = pieces.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select(_again("gram").alias("k"), F.lit(True).alias("hot"))
    pieces = pieces.join(hot, _again("gram") == F.col("k"), "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    strings = common.stash(_strings(texts, pieces, length))
    cold = _recurring(strings.where("part >= 0"))
    alone = strings.where("part < 0").drop("held")
    twice = alone.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select(_again("bucket").alias("k"))
    split = alone.where("single").join(twice, _again("bucket") == F.col("k"), "left_semi").select("id", "same", "first", F.lit(1).alias("n"))
    runs = common.stash(whole.union(cold).union(split))
    common.discard(shared, classes, single, strings)
    return runs


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document row: the key, n_bytes, spans [start, end) of removed bytes (maximal runs), and `kept`, the other bytes."""
    if length < 16:
        raise ValueError("a string has 16 bytes at least")
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    texts = own.withColumn("same", F.xxhash64("text"))
    runs = repeated_strings(texts, length)
    listed = runs.groupBy("id", "same").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("runs"))
    joined = texts.join(listed, ["id", "same"], "left").select("key", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raws, spans, kept = common.texts(batch, "text"), [], []
            for i, raw in enumerate(raws):
                of = batch.column("runs")[i]
                own: list[list[int]] = []
                if of.is_valid:
                    first, n = (of.values.field(c).to_numpy().tolist() for c in ("first", "n"))
                    for a, k in zip(first, n, strict=True):
                        if own and a <= own[-1][1]:
                            own[-1][1] = max(own[-1][1], a + k - 1 + length)
                        else:
                            own.append([a, a + k - 1 + length])
                spans.append([{"start": a, "end": b} for a, b in own])
                ends = [0, *(x for s in own for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(r) for r in raws], pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                ["key", "n_bytes", "spans", "kept"],
            )

    kind = own.schema["key"].dataType.simpleString()
    return joined.mapInArrow(run, f"key {kind}, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary").withColumnRenamed("key", key)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(
        key,
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
