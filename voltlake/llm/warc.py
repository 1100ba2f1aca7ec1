"""WARC archives: pages as records, whole-file gzip made into a member for each record, offsets beside it, and reading by them.

`write` turns pages into records and writes archives whose gzip stream spans the whole file, with DataFrame functions and
Spark's own writer: the two line ends that close a record are the separator of its rows. Of records with equal payloads of
`least` bytes or more, the one with the largest key is a response and the others revisit it; smaller ones are responses.

`normalise` inflates each such stream once, front to back, and writes every record as a gzip member of its own, with a
sidecar file of offsets: a line of JSON for each record. A task holds a piece of a record at a time, however long the record
is. Its rows, the manifest, name the archives that are whole: a task that is run again writes under another name, and what
a lost one left is in no manifest. A row stands for `RANGE` bytes of an archive, or one longer record, so that reading is
dealt out evenly.

`read` looks up each record's offset in the sidecar, inflates that member alone, and holds the payload against its digest.

* null text is an empty payload; a null key is less than any other, and is given back as null; null URLs are left out
* records that tie at the largest key of a payload are all responses; a repeated row gives the same record again
* equal payloads: equal in length, SHA-1 and a 64-bit hash
* control characters and blanks of a URL are written as %20; other columns, of any name, are ignored; an empty table gives no record
* an archive that is cut off or damaged: what stands before the damage is written, and a row of the manifest has `error` and
  no records; the record that was broken off isn't in the index. Archives with a member for each record already, or without
  compression, are taken as well
* a member that isn't what its index says has `verified` false

Archives and sidecars are written through Arrow's file systems (local and mounted folders, HDFS with its client library,
S3, GCS), into a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_plus

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST = 1000
#: Bytes that a task holds of a record, and those of an archive that a task reads.
PIECE, RANGE = 1 << 20, 32 << 20
MOST_HEADER = 1 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "source string, archive string, index string, start bigint, end bigint, index_start bigint, index_end bigint, records bigint, error string"


def _identifier(key: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(" ", F.coalesce(key, F.lit("-")), digest))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if there is no value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """`record`: each page's, without the line ends that close it."""
    payload = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload").cast("long")})
    same = F.concat_ws(":", "digest", "bytes", F.xxhash64("payload").cast("string"))
    # Small payloads have places of their own in the join, not one for all.
    own = own.withColumn("same", F.when(F.col("bytes") >= least, same).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url", "payload").cast("string"))))
    groups = own.where(F.col("bytes") >= least).groupBy("same").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").select("same", "last")
    told = own.join(groups, "same", "left")
    revisit = F.col("last").isNotNull() & ~F.col("key").eqNullSafe(F.col("last"))
    name, last = (F.url_encode(F.col(c).cast("string")) for c in ("key", "last"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    block = F.length(http).cast("long") + F.when(revisit, 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _identifier(name, F.col("digest"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, _PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _identifier(last, F.col("digest")))),
        _line("X-Refers-To-Key", F.when(revisit, last)),
        _line("X-Key", name),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    return told.select(F.concat(header, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame, folder: str, **options) -> None:  # noqa: ANN003
    """The pages' records as archives of one gzip stream each."""
    with common.shuffles_deleted(pages.sparkSession):
        records(pages, **options).write.option("lineSep", _END).option("compression", "gzip").text(folder)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """An Arrow file system and the place there; Hadoop's spelling of paths is taken as well."""
    local = re.match(r"(?:file:)?(/.*)", path)
    if local:
        return fs.LocalFileSystem(), re.sub("^/+", "/", local[1])
    return fs.FileSystem.from_uri(quote(path, safe=":/@?=&+,-._~%"))


class Damaged(ValueError):
    pass


class Inflated:
    """The bytes of a file, inflated a piece at a time; gzip members may follow one another."""

    def __init__(self, file: pa.NativeFile) -> None:
        self._file, self._held, self._raw, self._gzip = file, bytearray(), b"", None
        self._done = False  # not compressed, once that is known

    def _more(self) -> bool:
        if not self._raw:
            self._raw = self._file.read(PIECE)
        if not self._raw:
            if self._gzip and not self._gzip.eof:
                rest = self._gzip.decompress(b"", PIECE)  # what was held back for its size
                if not rest and not self._gzip.eof:
                    raise Damaged("the stream is cut off")
                self._held += rest
                return True
            return False
        if self._gzip is None and not self._done:
            self._gzip = zlib.decompressobj(31) if self._raw[:2] == b"\x1f\x8b" else None
            self._done = self._gzip is None
        if self._done:
            self._held += self._raw
            self._raw = b""
            return True
        if self._gzip.eof:
            self._raw = self._raw.lstrip(b"\x00")  # padding
            if not self._raw:
                return True
            self._gzip = zlib.decompressobj(31)
        try:
            self._held += self._gzip.decompress(self._raw, PIECE)
        except zlib.error as e:
            raise Damaged(str(e)) from e
        self._raw = self._gzip.unused_data if self._gzip.eof else self._gzip.unconsumed_tail
        return True

    def until(self, end: bytes) -> bytes:
        """Through the next `end`; nothing if the file is over."""
        while (at := self._held.find(end)) < 0:
            if len(self._held) > MOST_HEADER:
                raise Damaged("a header has no end")
            if not self._more():
                if self._held.strip():
                    raise Damaged("a header is cut off")
                return b""
        found = bytes(self._held[: at + len(end)])
        del self._held[: at + len(end)]
        return found

    def skip_blank(self) -> None:
        """Line ends between records."""
        while True:
            blank = len(self._held) - len(self._held.lstrip(b"\r\n"))
            del self._held[:blank]
            if self._held or not self._more():
                return

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self._held and not self._more():
                raise Damaged("a record is cut off")
            part = bytes(self._held[: min(n, PIECE)])
            del self._held[: len(part)]
            n -= len(part)
            if part:
                yield part


def fields(header: bytes) -> dict[str, str]:
    """Names in lower case, values as they are."""
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise Damaged("not a WARC record")
    found = {a.strip().lower(): b.strip() for a, _, b in (line.partition(":") for line in lines) if b}
    if not found.get("content-length", "").isdigit():
        raise Damaged("a record has no length")
    return found


def _rewrite(source: str, folder: str) -> Iterator[dict]:
    """Manifest rows of one archive."""
    stem = re.sub(r"(\.warc|\.txt)?(\.gz)?$", "", source.rsplit("/", 1)[-1])
    archive = f"{folder}/{stem}-{uuid.uuid4().hex}.warc.gz"
    index, why = f"{archive}.index", None
    from_, at = open_fs(source)
    to, place = open_fs(archive)
    row = {"source": source, "archive": archive, "index": index}
    begin, lines, count = (0, 0), 0, 0
    with from_.open_input_stream(at, compression=None) as file, to.open_output_stream(place, compression=None) as out, to.open_output_stream(f"{place}.index", compression=None) as sidecar:
        stream, offset = Inflated(file), 0
        try:
            while True:
                stream.skip_blank()
                header = stream.until(_END.encode())
                if not header:
                    break
                known = fields(header)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(member.compress(header))
                try:
                    for part in stream.pieces(int(known["content-length"])):
                        out.write(member.compress(part))
                finally:
                    out.write(member.compress(_END.encode()) + member.flush())
                    length = out.tell() - offset
                entry = {"offset": offset, "length": length, "type": known.get("warc-type"), "id": known.get("warc-record-id"), "uri": known.get("warc-target-uri")}
                line = json.dumps(entry).encode() + b"\n"
                sidecar.write(line)
                offset, lines, count = offset + length, lines + len(line), count + 1
                if offset - begin[0] >= RANGE:
                    yield row | {"start": begin[0], "end": offset, "index_start": begin[1], "index_end": lines, "records": count}
                    begin, count = (offset, lines), 0
        except Damaged as e:
            why = str(e)
    if count:
        yield row | {"start": begin[0], "end": offset, "index_start": begin[1], "index_end": lines, "records": count}
    if why:
        yield row | {"start": offset, "end": offset, "index_start": lines, "index_end": lines, "records": 0, "error": why}


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """path of each file under a folder; nothing of it is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") > 0).select("path")


def normalise(sources: DataFrame, folder: str) -> DataFrame:
    """The manifest of the archives (path), rewritten into a folder."""
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in MANIFEST.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, place = open_fs(folder)
        to.create_dir(place, recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                for row in _rewrite(source, folder):
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return common.stash(sources.select("path").mapInArrow(run, MANIFEST))


RECORD = "archive string, offset bigint, length bigint, record_type string, record_id string, uri string, key string, payload_bytes bigint, payload_digest string, refers_to string, verified boolean"


def _member(file: pa.NativeFile, entry: dict, with_payload: bool) -> dict:
    """The record at a member's offset."""
    row = {"offset": entry["offset"], "length": entry["length"], "record_type": entry["type"], "record_id": entry["id"], "uri": entry["uri"], "verified": False}
    file.seek(entry["offset"])
    stream = Inflated(_Window(file, entry["length"]))
    try:
        known = fields(stream.until(_END.encode()))
        left = int(known["content-length"])
        http = b""
        if known.get("content-type", "").startswith("application/http"):
            http = stream.until(_END.encode())
            left -= len(http)
        digest, kept = hashlib.sha1(), []
        for part in stream.pieces(left):
            digest.update(part)
            if with_payload:
                kept.append(part)
    except Damaged:
        return row
    named = known.get("warc-payload-digest", "").removeprefix("sha1:")
    key = lambda n: unquote_plus(known[n]) if n in known else None
    row |= {"key": key("x-key"), "refers_to": key("x-refers-to-key")}
    if known.get("warc-type") == "revisit":
        size = re.search(rb"(?i)content-length: *(\d+)", http)
        return row | {"payload_bytes": int(size[1]) if size else None, "payload_digest": named or None, "verified": known.get("warc-record-id") == entry["id"] and left == 0}
    row |= {"payload_bytes": left, "payload_digest": digest.hexdigest(), "verified": known.get("warc-record-id") == entry["id"] and named in ("", digest.hexdigest())}
    return row | {"payload": b"".join(kept)} if with_payload else row


class _Window:
    """The next n bytes of a file."""

    def __init__(self, file: pa.NativeFile, n: int) -> None:
        self._file, self._left = file, n

    def read(self, n: int) -> bytes:
        got = self._file.read(min(n, self._left))
        self._left -= len(got)
        return got


def read(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record of the manifest's archives; with `payload`, that as well (null for revisits)."""
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * payload
    types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in RECORD.split(", "))] + [("payload", pa.binary())] * payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, place = open_fs(row["archive"])
                with files.open_input_file(f"{place}.index") as sidecar:
                    sidecar.seek(row["index_start"])
                    lines = sidecar.read(row["index_end"] - row["index_start"]).splitlines()
                rows, size = [], 0
                with files.open_input_file(place) as file:
                    for line in lines:
                        found = _member(file, json.loads(line), payload) | {"archive": row["archive"]}
                        rows.append(found)
                        size += 500 + len(found.get("payload") or b"")
                        if size > PIECE:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    own = manifest.where("records > 0").select("archive", "start", "index_start", "index_end")
    n = own.count()
    return own.repartition(max(1, n)).select("archive", "index_start", "index_end").mapInArrow(run, RECORD + ", payload binary" * payload).select(*names)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", least: int = LEAST) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to of each page, as read back from normalised archives."""
    spark = pages.sparkSession
    whole, own = common.new_path(spark), common.new_path(spark)
    write(pages, whole, key=key, url=url, text=text, least=least)
    manifest = normalise(archives(spark, whole), own)
    if (broken := manifest.where("error is not null").first()) is not None:
        raise OSError(f"{broken.source}: {broken.error}")
    common.remove(spark, whole)
    kind = pages.schema[key].dataType
    given = lambda c: F.col(c).cast(kind)
    return read(manifest).select(given("key").alias(key), "payload_bytes", "payload_digest", "record_type", given("refers_to").alias("refers_to"), "verified")
