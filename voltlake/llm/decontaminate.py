"""Benchmark decontamination: a generalised suffix automaton of the benchmark's words is held against each document.

Words are runs of ASCII letters and digits or of any non-ASCII characters, with A-Z lower-cased. A window is
`window` consecutive words of an item; an item of fewer words, but not none, is one window. A document word inside
an occurrence of a window is hit.

`matches` reads only the key and text columns (others of any name are ignored) and returns one row per document
row, repeated rows and null keys included. Null or empty texts have no words; null or empty items have no windows;
items that share an id count as one, and so do those without an id: they hit like others, and are a null among the items
(one of n_items, and not named in items_sha256). Keys and ids may be of any type. An empty benchmark hits nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

WINDOW = 10
#: Benchmark words in one automaton. A larger benchmark is taken in blocks of that size, a pass over the documents each.
BLOCK_WORDS = 100_000
#: Share of hit words from which a document is removed whole, where `clean` removes spans otherwise.
COVERAGE = 0.5

_WORDS = bytes(c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INSIDE = np.frombuffer(_WORDS, np.uint8) != 32


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A suffix automaton of several word sequences, with the items in which each state's words occur."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, sequence in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence]
            coded.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        size = len(self.vocabulary)
        self.pairs = np.unique(np.array([a * size + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)], np.int64))
        self.least = min([window, *(len(ids) for _, ids in coded if ids)])
        self.items: list[set[int]] = [set() for _ in self.go]
        self.whole: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, ids in coded:
            v = 0
            for w in ids:
                u = v = self.go[v][w]
                while u and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if 0 < len(ids) < window:
                self.whole[v].append((len(ids), item))
        # Of each state: its suffix of just `window` words, and the nearest state on the way to the root that ends a short item.
        self.at_window, self.at_whole = [0] * len(self.go), [0] * len(self.go)
        for v in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
            self.at_whole[v] = v if v in self.whole else self.at_whole[up]

    def _extend(self, last: int, w: int) -> int:
        go, link, length = self.go, self.link, self.length
        if w in go[last]:
            q = go[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = link[p]
        if p >= 0:
            q = go[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        go, link, length = self.go, self.link, self.length
        copy = len(go)
        go.append(dict(go[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = copy
            p = link[p]
        return copy

    def match(self, document: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged spans [start, end) of hit words, items with windows in the document, and the longest match."""
        n, none = len(document), ([], set(), 0)
        if n < self.least or not self.vocabulary:
            return none
        ids = np.fromiter(map(self.vocabulary.get, document, repeat(-1)), np.int64, n)
        known = ids >= 0
        if self.least > 1:  # only stretches of which each pair of neighbours stands in an item can hold a window
            pair = np.where(known[:-1] & known[1:], ids[:-1] * len(self.vocabulary) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = np.concatenate(([False], self.pairs[at] == pair, [False]))
            edge = np.flatnonzero(joined[1:] != joined[:-1])
            stretches = [(a, b + 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        else:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
            stretches = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        for a, b in stretches:
            if b - a >= self.least:
                longest = max(longest, self._stream(ids[a:b].tolist(), a, spans, found))
        return spans, found, longest

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> int:
        go, link, length, window = self.go, self.link, self.length, self.window
        v = l = longest = 0
        for j, w in enumerate(ids, base + 1):
            while v and w not in go[v]:
                v = link[v]
                l = length[v]
            if w not in go[v]:
                continue
            v = go[v][w]
            l += 1
            longest = max(longest, l)
            size = 0
            if l >= window:
                found |= self.items[self.at_window[v]]
                size = window
            u = self.at_whole[v]
            while u:
                for words_of_item, item in self.whole[u]:
                    if words_of_item <= l:
                        found.add(item)
                        size = max(size, words_of_item)
                u = self.at_whole[link[u]]
            if size:
                start = j - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, j))
        return longest


def blocks(benchmark: DataFrame, key: str, text: str, window: int, block_words: int) -> Iterator[Automaton]:
    """Automata of at most `block_words` words (or two windows, if that is more), one at a time. A longer item is cut into pieces that
    overlap by a window less a word, so that each of its windows is in one of them."""
    of = benchmark.where(F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text"))
    most = max(block_words, 2 * window)
    block: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in of.orderBy("item", "text").toLocalIterator():
        sequence = words(row.text.encode())
        for at in range(0, max(1, len(sequence) - window + 1), most - window + 1):
            piece = sequence[at : at + most]
            if not piece:
                continue
            if block and size + len(piece) > block_words:
                yield Automaton(block, window)
                block, size = [], 0
            block.append((row["item"], piece))
            size += len(piece)
    yield Automaton(block, window)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document row: n_words, merged spans [start, end) of hit words, item_ids with windows in it (sorted, a null last), the longest match in words (within a piece of an item, see `blocks`).

    The documents stream through the tasks that read them, without a shuffle. Only one bounded automaton is
    broadcast at a time; the results of an earlier block are written out before the next one passes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = rows.schema["key"].dataType.simpleString()
    spans_type = "array<struct<start:int,end:int>>"
    item_type = benchmark.schema[item_key].dataType
    items_type, items_arrow = f"array<{item_type.simpleString()}>", pa.list_(to_arrow_type(item_type))
    result = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(spans_type), "items": F.array().cast(items_type), "longest": F.lit(0)})
    for i, automaton in enumerate(blocks(benchmark, item_key, item_text, window, block_words)):
        if i:
            result = common.stash(result)
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in common.slices(batches, "text"):
                n_words, spans, items, longest = [], [], [], []
                old = zip(*(batch.column(c).to_pylist() for c in ("spans", "items", "longest")), strict=True)
                for raw, (old_spans, old_items, old_longest) in zip(common.texts(batch, "text"), old, strict=True):
                    document = words(raw)
                    own, found, most = automaton.match(document)
                    n_words.append(len(document))
                    spans.append([{"start": a, "end": b} for a, b in (_merged([*own, *((s["start"], s["end"]) for s in old_spans)]) if old_spans else own)])
                    items.append(sorted(found | set(old_items), key=lambda x: (x is None, x if x is not None else 0)))
                    longest.append(max(most, old_longest))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(items, items_arrow), pa.array(longest, pa.int32())],
                    ["key", "text", "n_words", "spans", "items", "longest"],
                )

        result = result.mapInArrow(run, f"key {key_type}, text string, n_words bigint, spans {spans_type}, items {items_type}, longest int")
    return result.withColumnRenamed("key", key)


def digests(matched: DataFrame, key: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return matched.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words [start, end) of each span and what stands between them; a blank takes their place."""
    inside = _INSIDE[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out += [text[at : starts[a]], b" "]
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


def _clean_by_one(docs: DataFrame, automaton: Automaton, text: str, coverage: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in common.slices(batches, text):
            new, keep = [], []
            for raw, null in zip(common.texts(batch, text), batch.column(text).is_null().to_pylist(), strict=True):
                document = words(raw)
                total = len(document)
                gone = 0
                while spans := automaton.match(document)[0]:
                    gone += sum(b - a for a, b in spans)
                    if gone >= coverage * total:
                        break
                    raw = cut(raw, spans)
                    document = words(raw)
                keep.append(not gone or gone < coverage * total)
                new.append(None if null else raw.decode())
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _clean_by_several(docs: DataFrame, automata: Callable[[], Iterator[Automaton]], text: str, coverage: float) -> DataFrame:
    """As by one automaton of all blocks: each round takes the hits of all blocks together, and a document that was cut is in the next."""
    spark = docs.sparkSession
    spans_type = "array<struct<start:int,end:int>>"
    total_, gone_, first_, spans_ = common.free_names(docs, "total", "gone", "first", "spans")
    open_ = docs.withColumns({total_: F.lit(0).cast("long"), gone_: F.lit(0).cast("long"), first_: F.lit(True), spans_: F.array().cast(spans_type)})

    def replaced(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        for name, values in columns.items():
            at = batch.schema.get_field_index(name)
            batch = batch.set_column(at, batch.schema.field(at), values.cast(batch.schema.field(at).type))
        return batch

    def collect(shared: Broadcast):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in common.slices(batches, text):
                old = ([(s["start"], s["end"]) for s in x] for x in batch.column(spans_).to_pylist())
                spans = [_merged([*automaton.match(words(raw))[0], *before]) for raw, before in zip(common.texts(batch, text), old, strict=True)]
                yield replaced(batch, {spans_: pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)})

        return run

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            new, total, gone, spans = [], batch.column(total_).to_pylist(), batch.column(gone_).to_pylist(), batch.column(spans_).to_pylist()
            first, null = batch.column(first_).to_pylist(), batch.column(text).is_null().to_pylist()
            for i, raw in enumerate(common.texts(batch, text)):
                if first[i]:
                    total[i] = len(words(raw))
                if spans[i]:
                    gone[i] += sum(s["end"] - s["start"] for s in spans[i])
                    if gone[i] < coverage * total[i]:
                        raw = cut(raw, [(s["start"], s["end"]) for s in spans[i]])
                new.append(None if null[i] else raw.decode())
            yield replaced(batch, {text: pa.array(new, pa.string()), total_: pa.array(total, pa.int64()), gone_: pa.array(gone, pa.int64())})

    done = []
    while True:
        for automaton in automata():
            before, open_ = open_, common.stash(open_.mapInArrow(collect(spark.sparkContext.broadcast(automaton)), open_.schema))
            if hasattr(before, "_stashed_at"):
                common.discard(before)
        cut_ = common.stash(open_.mapInArrow(apply, open_.schema))
        common.discard(open_)
        again = (F.size(spans_) > 0) & (F.col(gone_) < coverage * F.col(total_))
        done.append(cut_.where(F.size(spans_) == 0).select(docs.columns))
        open_ = cut_.where(again).withColumns({first_: F.lit(False), spans_: F.array().cast(spans_type)})
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS, length_column: str | None = "n_chars") -> DataFrame:
    """The documents with hit spans cut out, all columns kept; one of which `coverage` or more is hit goes whole (with 0, each that is hit at all).

    What stands on both sides of a cut may make a window anew, so a text is held against the benchmark until
    nothing is hit. The number of blocks doesn't change the result. `length_column`, if the table has it, is set to the new number of characters; texts without a
    hit stay as they are.
    """
    columns = docs.columns
    # Items count by their text alone here, so one without an id counts like any other.
    items = benchmark.select(F.xxhash64(item_text).alias("item"), F.col(item_text).alias("text"))
    automata = lambda: blocks(items, "item", "text", window, block_words)
    few = list(islice(automata(), 2))
    result = _clean_by_one(docs, few[0], text, coverage) if len(few) == 1 else _clean_by_several(docs, automata, text, coverage)
    if length_column in columns:
        result = result.withColumn(length_column, F.when(F.col(text).isNull(), F.col(length_column)).otherwise(F.length(text)).cast(docs.schema[length_column].dataType))
    return result.select(columns)
