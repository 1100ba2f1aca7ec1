"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel, stitched where their boundaries meet, then encoded.

`encode` reads only the key and the text column, whatever else the table holds (columns of any other
name are ignored, so none can clash), and returns one row per input row: the key and `ids`.

* null text: encoded as the empty text; empty text: no ids
* a null or repeated key: each row is encoded on its own, repeated rows give repeated results
* a long text: cut into chunks of `chunk_chars`, each reaching `overlap` characters into the next; chunks are
  rows of their own, so one text is spread over tasks
* no common boundary within an overlap (one run of letters longer than it): the chunks are joined again, exactly
* an empty table: an empty result
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_CHARS, OVERLAP = 16384, 512

_built: dict[tuple[int, str], Tokenizer] = {}


class Tokenizer:
    """The encoder of a rank file: tiktoken's merges (built when first asked for), and the pattern for boundaries between chunks."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.encoding = cache(lambda: tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        self.pieces = regex.compile(pattern)
        # All tokens one after the other, by rank, and where each begins.
        by_rank = {rank: token for token, rank in ranks.items()}
        tokens = [by_rank.get(r, b"") for r in range(1 + max(by_rank, default=0))]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return self.encoding().encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The raw bytes of all ids, and where the bytes of each one begin (and at last the end)."""
        sizes = self.sizes[ids]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        take = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], sizes)
        return self.bytes[take].tobytes(), ends

    def cuts(self, text: str, zones: list[range]) -> list[int]:
        """Boundaries of the pre-tokens of `text` in `zones` at which two chunks may be joined.

        Only boundaries between a printing ASCII character and an ASCII blank count: no pre-token
        reaches over such a place, and what is cut off there changes no match before it.
        """
        found = []
        for m in self.pieces.finditer(text):
            p = m.end()
            if p < len(text) and text[p] in " \n" and "!" <= text[p - 1] <= "~" and any(p in z for z in zones):
                found.append(p)
        return found


def tokenizer(ranks: Broadcast) -> Tokenizer:
    """One per Python worker: workers are used again from task to task."""
    rank_file, pattern = ranks.value
    key = (hash(rank_file), pattern)
    if key not in _built:
        _built[key] = Tokenizer(rank_file, pattern)
    return _built[key]


def load_ranks(df: DataFrame, ranks_path: str, pattern: str) -> Broadcast:
    """The rank file (a vocabulary of fixed size, under 64 MB) for all executors, which may not have its path."""
    with open(ranks_path, "rb") as f:
        rank_file = f.read(64 << 20 | 1)
    if len(rank_file) > 64 << 20:
        raise ValueError(f"{ranks_path} is too large to broadcast")
    return df.sparkSession.sparkContext.broadcast((rank_file, pattern))


def _ids(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(r) for r in rows], dtype=np.int32)))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    if not 0 < overlap <= chunk_chars:
        raise ValueError("an overlap is at least one character and at most a chunk")
    ranks = load_ranks(docs, ranks_path, pattern)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = F.length("text") <= chunk_chars
    key_type = rows.schema["key"].dataType.simpleString()

    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks)
        for batch in common.slices(batches, "text"):
            ids = _ids([bpe.encode(t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", 1):
            k, row, t = batch.column("key"), batch.column("row"), batch.column("text")[0].as_py()
            starts = list(range(0, len(t), chunk_chars))
            for i in range(0, len(starts), 64):
                some = starts[i : i + 64]
                same = pa.array([0] * len(some), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [k.take(same), row.take(same), pa.array(some, pa.int64()), pa.array([t[s : s + chunk_chars + overlap] for s in some])],
                    ["key", "row", "start", "text"],
                )

    def encode_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks)
        for batch in common.slices(batches, "text"):
            cuts, counts, ids = [], [], []
            for start, t in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = bpe.cuts(t, [range(1, overlap + 1), range(chunk_chars + 1, len(t))])
                cuts.append([start + p for p in own])
                pieces = [bpe.encode(t[a:b]) for a, b in zip([0, *own], [*own, len(t)], strict=True)]
                counts.append(np.cumsum([len(p) for p in pieces], dtype=np.int32))
                ids.append(np.concatenate(pieces))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("row"), batch.column("start"), pa.array(cuts, pa.list_(pa.int64())), _ids(counts), _ids(ids)],
                ["key", "row", "start", "cuts", "counts", "ids"],
            )

    def stitch(group: pa.Table) -> pa.Table:
        bpe = tokenizer(ranks)
        group = group.sort_by("start")
        chunks = [(*(group.column(c)[i].as_py() for c in ("start", "cuts", "counts")), group.column("ids")[i].values.to_numpy()) for i in range(group.num_rows)]
        out: list[np.ndarray] = []
        # The chunk that is open: its ids from `begin` on, or (joined) the text from `base` on.
        start, cuts, counts, ids = chunks[0]
        begin, joined, base = 0, None, 0
        for nxt in chunks[1:]:
            at = dict(zip(nxt[1], nxt[2], strict=False))
            common_cuts = [p for p in cuts if p in at and p >= nxt[0]]
            if common_cuts:
                p = common_cuts[0]
                out.append(bpe.encode("".join(joined)[: p - base]) if joined is not None else ids[begin : counts[cuts.index(p)]])
                (start, cuts, counts, ids), begin, joined = nxt, at[p], None
                continue
            if joined is None:
                text = bpe.decode(ids[begin:])[0].decode()
                joined, base = [text], start + chunk_chars + overlap - len(text)
            joined.append(bpe.decode(nxt[3])[0].decode()[overlap:])
            start, cuts = nxt[0], nxt[1]
        out.append(bpe.encode("".join(joined)) if joined is not None else ids[begin:])
        return pa.table({"key": group.column("key").slice(0, 1), "ids": _ids([np.concatenate(out)])})

    out = f"key {key_type}, ids array<int>"
    short = rows.where(whole).mapInArrow(encode_whole, out)
    chunks = (
        rows.where(~whole)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, f"key {key_type}, row bigint, start bigint, text string")
        .repartition("row", "start")
        .mapInArrow(encode_chunk, f"key {key_type}, row bigint, start bigint, cuts array<bigint>, counts array<int>, ids array<int>")
    )
    return short.unionAll(chunks.groupBy("row").applyInArrow(stitch, out)).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key, `ids` and their raw bytes, concatenated, as `decoded`; null ids: no bytes."""
    ranks = load_ranks(encoded, ranks_path, pattern)
    rows = encoded.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                data, ends = bpe.decode(some.column("ids").flatten().to_numpy())
                rows = ends[np.concatenate((np.zeros(1, np.int64), np.cumsum(some.column("ids").value_lengths().to_numpy())))].tolist()
                raw = pa.array([data[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("key"), some.column("ids"), raw], ["key", "ids", "decoded"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row: the number of ids, and SHA-256 of the ids (decimal, comma between) and of the decoded bytes."""
    return decoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
