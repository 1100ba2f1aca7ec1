"""Recordings as a data source: EDF files and members of ZIP archives, in chunks of samples.

    spark.dataSource.register(Recordings)
    spark.read.format("recordings").load("/data/eeg")

Planning reads names, and of archives their central directories, by ranged reads on some threads. A file, or a member that
is stored, is dealt out by ranges of its bytes; a member that is deflated is one task, which inflates it once, front to back.
A task holds a chunk at a time: no row and no task has a whole recording, and an archive may be of any size.

filename is a file's path, or `<archive>!/<member>`. Option `content`:

* `chunks` (default): CHUNK columns. A row for each channel and chunk, and for each chunk one without a channel that has its
  annotations (so a recording without samples has a row as well)
* `headers`: filename, sfreq, n_samples, channels, error; nothing but headers is read
* `members`: archive, member, length (unpacked) of each EDF member

A file that can't be read as EDF, a damaged, encrypted or oddly compressed member, an archive without a directory: a row with
`error`, and nothing else fails. What stands before the damage has been given out by then, so leave recordings out that have
an error (`sound`). The checksum of a stored member that is dealt out in ranges isn't looked at. Of equal names in an archive the last
counts. Options `chunk_samples`, `range_bytes` and `pack` (true: small files share tasks) set sizes; `paths` is a JSON list of files or folders,
`only` one of filenames that are read of them.
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voltlake.sources import edf
from voltlake.sources.files import open_fs, walk

CHUNK_SAMPLES, RANGE_BYTES = 65_536, 64 << 20
_PIECE, _THREADS = 1 << 20, 16
NOTE = "struct<record:bigint,onset:double,duration:double,description:string>"
SCHEMAS = {
    "chunks": f"filename string, sfreq double, n_samples bigint, channel string, channel_idx int, chunk bigint, start bigint, samples array<double>, annotations array<{NOTE}>, error string",
    "headers": "filename string, sfreq double, n_samples bigint, channels array<string>, error string",
    "members": "archive string, member string, length bigint, error string",
}
_NOTE = pa.struct([("record", pa.int64()), ("onset", pa.float64()), ("duration", pa.float64()), ("description", pa.string())])
_TYPES = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), f"array<{NOTE}>": pa.list_(_NOTE)}


def _schema(content: str) -> pa.Schema:
    names = [c.split(" ", 1) for c in SCHEMAS[content].replace(f"array<{NOTE}>", "notes").split(", ")]
    return pa.schema([(n, _TYPES.get(t, pa.list_(_NOTE))) for n, t in names])


class Damaged(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """A range of bytes [begin, end) of a file's content, or of a member's; `error`: why there is none."""

    path: str
    length: int
    begin: int = 0
    end: int = 0
    member: str | None = None
    method: int = zipfile.ZIP_STORED
    at: int = 0
    packed: int = 0
    checksum: int = 0
    encrypted: bool = False
    error: str | None = None

    @property
    def filename(self) -> str:
        return self.path if self.member is None else f"{self.path}!/{self.member}"


@dataclass
class Part(InputPartition):
    sources: list[Source] = field(default_factory=list)


def members(path: str) -> list[Source]:
    """EDF members of an archive, by name, from its central directory."""
    files, place = open_fs(path)
    try:
        with files.open_input_file(place) as file, zipfile.ZipFile(file) as z:
            own = {i.filename: i for i in z.infolist() if i.filename.lower().endswith(".edf")}
    except (zipfile.BadZipFile, struct.error, ValueError) as e:
        return [Source(path, 0, error=f"{type(e).__name__}: {e}")]
    return [Source(path, i.file_size, 0, i.file_size, n, i.compress_type, i.header_offset, i.compress_size, i.CRC, bool(i.flag_bits & 1)) for n, i in sorted(own.items())]


def plan(paths: list[str], range_bytes: int = RANGE_BYTES) -> list[Source]:
    """What tasks read: ranges of files and stored members, and whole deflated members."""
    found = walk(paths, r"\.(edf|zip)$")
    with ThreadPoolExecutor(_THREADS) as pool:
        each = pool.map(lambda f: members(f.path) if f.path.lower().endswith(".zip") else [Source(f.path, f.length, 0, f.length)], found)
        out = []
        for s in (s for some in each for s in some):
            if s.error or s.method != zipfile.ZIP_STORED or s.encrypted:
                out.append(s)
            else:
                out += [replace(s, begin=a, end=min(s.length, a + range_bytes)) for a in range(0, max(1, s.length), range_bytes)]
    return out


class _Bytes:
    """The content of a source, front to back; `skip` is a seek where the content isn't compressed."""

    def __init__(self, source: Source, file: pa.NativeFile) -> None:
        self._source, self._file, self._at, self._held = source, file, 0, bytearray()
        self._base, self._inflate, self._other, self._left, self._sum = 0, None, None, 0, 0
        if source.member is None:
            return
        if source.encrypted:
            raise Damaged("the member is encrypted")
        file.seek(source.at)
        local = file.read(30)
        if len(local) < 30 or local[:4] != b"PK\x03\x04":
            raise Damaged("the member isn't where the directory says")
        self._base = source.at + 30 + sum(struct.unpack("<HH", local[26:30]))
        file.seek(self._base)
        if source.method == zipfile.ZIP_DEFLATED:
            self._inflate, self._left = zlib.decompressobj(-15), source.packed
        elif source.method != zipfile.ZIP_STORED:
            self._other = zipfile.ZipFile(file).open(source.member)

    @property
    def plain(self) -> bool:
        return self._inflate is None and self._other is None

    def skip(self, to: int) -> None:
        if self.plain:
            self._at, self._held = to, bytearray()
            self._file.seek(self._base + to)
        else:
            while self._at < to and self.read(min(_PIECE, to - self._at)):
                pass

    def _next(self) -> bytes:
        if self._other:
            return self._other.read(_PIECE)
        while not self._inflate.eof:
            raw = self._inflate.unconsumed_tail or self._file.read(min(_PIECE, self._left))
            if not self._inflate.unconsumed_tail:
                self._left -= len(raw)
            out = self._inflate.decompress(raw, _PIECE)
            if out:
                return out
            if not raw:
                raise Damaged("the member is cut off")
        return b""

    def read(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        if self.plain:
            out = self._file.read(max(0, min(n, self._source.length - self._at)))
            self._at += len(out)
            return out
        while len(self._held) < n and (more := self._next()):
            self._sum = zlib.crc32(more, self._sum)
            self._held += more
        out = bytes(self._held[:n])
        del self._held[:n]
        self._at += len(out)
        return out

    def finish(self) -> None:
        """Reads what is left of a member and holds its checksum against the directory's."""
        if self._source.member is None or (self.plain and (self._source.begin, self._source.end) != (0, self._source.length)):
            return
        if self.plain:
            self.skip(0)
            while part := self.read(_PIECE):
                self._sum = zlib.crc32(part, self._sum)
        else:
            while self.read(_PIECE):
                pass
        if self._sum != self._source.checksum:
            raise Damaged("the member's checksum is wrong")


#: Faults of the content; others, such as a store that can't be reached, fail the task, which is then run again.
_FAULTS = (edf.NotEdf, Damaged, zlib.error, zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, struct.error)


def _failed(content: str, name: str, error: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"archive" if content == "members" else "filename": name, "error": error}], schema=_schema(content))


def _chunks(source: Source, content: _Bytes, chunk_samples: int) -> Iterator[pa.RecordBatch]:
    header = edf.read_header(content.read)
    count, schema = header.count(source.length), _schema("chunks")
    per = max(1, chunk_samples // header.rate)
    step = per * header.width
    # Chunks that begin within the range; the first one comes with the header.
    first = 0 if source.begin == 0 else max(1, -(-(source.begin - header.length) // step))
    names, k = header.channels, len(header.own)
    following = b""
    for c in range(first, max(1, -(-count // per))):
        if c and header.length + c * step >= source.end:
            break
        want = min(per, count - c * per) * header.width
        if c == first:
            content.skip(header.length + c * step)
        raw = following + content.read(want - len(following))
        if len(raw) < want:
            raise Damaged("the recording is cut off")
        following = content.read(header.width) if (c + 1) * per < count else b""
        x = edf.decode(header, raw, following)
        n = x.shape[1]
        said = [{"record": c * per + r, "onset": a, "duration": d, "description": t} for r, a, d, t in edf.notes(header, raw)]
        rows = k + 1
        samples = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * n), pa.array(x.reshape(-1)))
        same = lambda v, t: pa.array([v] * rows, t)
        columns = [
            same(source.filename, pa.string()),
            same(header.sfreq, pa.float64()),
            same(count * header.rate, pa.int64()),
            pa.array([*names, None], pa.string()),
            pa.array([*range(k), None], pa.int32()),
            same(c, pa.int64()),
            same(c * per * header.rate, pa.int64()),
            pa.concat_arrays([samples, pa.array([None], pa.list_(pa.float64()))]),
            pa.array([None] * k + [said], pa.list_(_NOTE)),
            pa.array([None] * rows, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
    content.finish()


def read_source(source: Source, content: str = "chunks", chunk_samples: int = CHUNK_SAMPLES) -> Iterator[pa.RecordBatch]:
    if source.error:
        yield _failed(content, source.filename, source.error)
        return
    if content == "members":
        if source.member is not None and source.begin == 0:
            yield pa.RecordBatch.from_pylist([{"archive": source.path, "member": source.member, "length": source.length}], schema=_schema(content))
        return
    if content == "headers" and source.begin:
        return
    files, place = open_fs(source.path)
    with files.open_input_file(place) as file:
        try:
            data = _Bytes(source, file)
            if content == "chunks":
                yield from _chunks(source, data, chunk_samples)
            else:
                h = edf.read_header(data.read)
                yield pa.RecordBatch.from_pylist([{"filename": source.filename, "sfreq": h.sfreq, "n_samples": h.count(source.length) * h.rate, "channels": h.channels}], schema=_schema(content))
        except _FAULTS as e:
            yield _failed(content, source.filename, f"{type(e).__name__}: {e}")


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self._paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self._only = set(json.loads(options["only"])) if "only" in options else None
        self._content = options.get("content", "chunks")
        self._chunk = int(options.get("chunk_samples", CHUNK_SAMPLES))
        self._range = int(options.get("range_bytes", RANGE_BYTES))
        self._pack = options.get("pack", "false").lower() == "true"

    def partitions(self) -> list[Part]:
        parts, size = [], 0
        for s in plan(self._paths, self._range):
            if self._only is not None and s.filename not in self._only:
                continue
            weight = (s.end - s.begin if self._content == "chunks" else 1 << 16) + (1 << 16)
            if parts and (self._pack or self._content != "chunks") and size + weight <= self._range:
                parts[-1].sources.append(s)
                size += weight
            else:
                parts.append(Part([s]))
                size = weight
        for i, p in enumerate(parts):
            p.value = i
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for source in partition.sources:
            yield from read_source(source, self._content, self._chunk)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("content", "chunks")]

    def reader(self, schema: object) -> Reader:
        return Reader(dict(self.options))


def read(spark: SparkSession, path: str | list[str], content: str = "chunks", **options) -> DataFrame:  # noqa: ANN003
    """Recordings under a folder, or of the files in a list."""
    spark.dataSource.register(Recordings)
    reader = spark.read.format("recordings").options(content=content, **options)
    return reader.load(path) if isinstance(path, str) else reader.option("paths", json.dumps(path)).load()


def list_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, length of each EDF member of each archive; `error` of archives that have no directory."""
    return read(spark, path, "members").orderBy("archive", "member")


def failures(chunks: DataFrame) -> DataFrame:
    """filename and error of recordings that couldn't be read, or not to their end; an error may be told by several ranges."""
    return chunks.where("error is not null").groupBy("filename").agg(F.min("error").alias("error"))


def sound(chunks: DataFrame) -> DataFrame:
    """chunks of recordings without an error."""
    return chunks.join(failures(chunks).select("filename"), "filename", "left_anti")


def signals(chunks: DataFrame) -> DataFrame:
    """The rows of samples: filename, sfreq, n_samples, channel, chunk, start, samples."""
    return chunks.where("channel is not null").select("filename", "sfreq", "n_samples", "channel", "chunk", "start", "samples")


def annotations(chunks: DataFrame) -> DataFrame:
    """filename, annot_idx (0-based, in the order of the file), onset, duration, description."""
    from pyspark.sql import Window

    rows = chunks.where("channel is null and error is null").select("filename", "chunk", F.posexplode("annotations").alias("pos", "a"))
    order = Window.partitionBy("filename").orderBy("chunk", "pos")
    return rows.select("filename", (F.row_number().over(order) - 1).alias("annot_idx"), "a.onset", "a.duration", "a.description")


def headers(chunks: DataFrame) -> DataFrame:
    """filename, sfreq, n_samples of the recordings in chunks."""
    return chunks.where("channel is null and error is null and chunk = 0").select("filename", "sfreq", "n_samples")


def headers_with_channels(chunks: DataFrame) -> DataFrame:
    """What content `headers` says, of recordings in chunks; channels by name."""
    own = chunks.where("channel is not null and chunk = 0").groupBy("filename").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    empty = F.array().cast("array<string>")
    return headers(chunks).join(own, "filename", "left").select("filename", "sfreq", "n_samples", F.coalesce("channels", empty).alias("channels"), F.lit(None).cast("string").alias("error"))


def info(headers: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """Of content `headers`: channels, their number, rate, and the time of the last sample, (n - 1) / rate; with annotations, also them."""
    out = headers.where("error is null").select("filename", "channels", F.size("channels").alias("n_channels"), "sfreq", ((F.col("n_samples") - 1) / F.col("sfreq")).alias("duration_s"))
    if annotations is None:
        return out
    each = annotations.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("annot_idx", "onset", "duration", "description"))).alias("annotations"))
    return out.join(each, "filename", "left").withColumn("annotations", F.coalesce("annotations", F.array().cast(each.schema["annotations"].dataType)))


def whole(signals: DataFrame) -> DataFrame:
    """filename, sfreq, channel, samples: chunks put together, a channel of a recording in one row. For recordings that fit there."""
    parts = F.array_sort(F.collect_list(F.struct("start", "samples")))
    return signals.groupBy("filename", "sfreq", "channel").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


def chunked(signals: DataFrame, size: int = CHUNK_SAMPLES) -> DataFrame:
    """The way back: rows of `signals` in chunks."""
    n = F.size("samples").cast("long")
    rows = signals.select("filename", "sfreq", n.alias("n_samples"), "channel", "samples", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((n - 1) / size)))).alias("chunk"))
    start = F.col("chunk") * size
    return rows.select("filename", "sfreq", "n_samples", "channel", "chunk", start.alias("start"), F.slice("samples", (start + 1).cast("int"), F.lit(size)).alias("samples"))


def samples(signals: DataFrame) -> DataFrame:
    """filename, sample_idx, time, channel, value: the long form."""
    long = signals.select("filename", "sfreq", "channel", "start", F.posexplode("samples").alias("i", "value"))
    at = F.col("start") + F.col("i")
    return long.select("filename", at.alias("sample_idx"), (at / F.col("sfreq")).alias("time"), "channel", "value")
