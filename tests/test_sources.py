import io
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.edf_writer import Recording, render
from voltlake.sources import edf, files, recordings

STEP = 2e-3 / 65535


def made(seconds=6, seed=1, rate=128, notes=(), **more):
    rng = np.random.default_rng(seed)
    t = np.arange(rate * seconds) / rate
    return Recording(float(rate), ["C3", "C4"], 1e-5 * np.stack([np.sin(2 * np.pi * 10 * t), rng.normal(size=len(t))]), list(notes), **more)


def assembled(chunks):
    out = {}
    for r in recordings.whole(recordings.signals(chunks)).collect():
        out[r.filename, r.channel] = np.array(r.samples)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("edf")
    notes = [(0.0, 2.0, "Resting"), (2.0, 2.5, "Thinking and Acting"), (5.0, 0.0, "Typing")]
    own = {"ALS01/time1/EEG.edf": made(notes=notes), "id2/EEG.edf": made(seconds=3, seed=2), "id3/EEG.EDF": made(seconds=5, seed=3, slower={"C4": 4})}
    (root / "ALS01/time1").mkdir(parents=True)
    (root / "ALS01/time1/EEG.edf").write_bytes(render(own["ALS01/time1/EEG.edf"]))
    (root / "readme.txt").write_text("not a recording")
    for name, method in (("one.zip", zipfile.ZIP_DEFLATED), ("two.ZIP", zipfile.ZIP_STORED), ("odd.zip", zipfile.ZIP_BZIP2)):
        with zipfile.ZipFile(root / name, "w", method) as z:
            z.writestr("id2/EEG.edf", render(own["id2/EEG.edf"]))
            z.writestr("id3/EEG.EDF", render(own["id3/EEG.EDF"]))
            z.writestr("notes.txt", "x")
    return str(root), own


@pytest.mark.parametrize(("chunk", "size"), [(65536, 64 << 20), (128, 700), (300, 2000), (500, 5000)])
def test_chunks_don_t_depend_on_sizes(spark, folder, chunk, size):
    root, own = folder
    chunks = recordings.read(spark, root, chunk_samples=chunk, range_bytes=size).cache()
    assert recordings.failures(chunks).collect() == []
    got = assembled(chunks)
    names = {f"file:{root}/ALS01/time1/EEG.edf": "ALS01/time1/EEG.edf"} | {f"file:{root}/{a}!/{m}": m for a in ("one.zip", "two.ZIP", "odd.zip") for m in ("id2/EEG.edf", "id3/EEG.EDF")}
    assert set(got) == {(n, c) for n in names for c in ("C3", "C4")}
    for (name, channel), x in got.items():
        r = own[names[name]]
        want = r.signals[r.channels.index(channel)]
        if channel in r.slower:
            at = np.arange(0, len(want), r.slower[channel])
            want = np.interp(np.arange(len(want)), at, want[at])
        assert len(x) == len(want) and np.abs(x - want).max() <= STEP
    assert sorted(r.n for r in chunks.where("channel is not null").groupBy("filename", "channel", "chunk").agg(F.count("*").alias("n")).collect())[-1] == 1
    assert chunks.agg(F.max(F.size("samples"))).first()[0] <= max(chunk, 128)
    notes = [(r.annot_idx, r.onset, r.duration, r.description) for r in recordings.annotations(chunks).orderBy("annot_idx").collect()]
    assert notes == [(i, *n) for i, n in enumerate(own["ALS01/time1/EEG.edf"].annotations)]
    chunks.unpersist()


def test_samples_don_t_depend_on_chunks_at_all(spark, folder):
    root, _ = folder
    a = assembled(recordings.read(spark, root))
    b = assembled(recordings.read(spark, root, chunk_samples=128, range_bytes=3000))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_headers_and_members(spark, folder):
    root, _ = folder
    heads = recordings.read(spark, root, "headers")
    info = {r.filename.removeprefix(f"file:{root}/"): (r.channels, r.n_channels, r.sfreq, r.duration_s) for r in recordings.info(heads).collect()}
    assert info["ALS01/time1/EEG.edf"] == (["C3", "C4"], 2, 128.0, 767 / 128) and info["two.ZIP!/id2/EEG.edf"][3] == 383 / 128 and len(info) == 7
    listed = [(r.archive.rsplit("/", 1)[1], r.member) for r in recordings.list_members(spark, root).collect()]
    assert listed == [(a, m) for a in ("odd.zip", "one.zip", "two.ZIP") for m in ("id2/EEG.edf", "id3/EEG.EDF")]
    full = recordings.info(heads, recordings.annotations(recordings.read(spark, root)))
    assert {r.filename.rsplit("/", 1)[1]: len(r.annotations) for r in full.where("filename like '%ALS01%'").collect()} == {"EEG.edf": 3}


def test_each_fault_is_a_row_and_no_more(spark, tmp_path):
    good = render(made())
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n in ("good.edf", "sum.edf", "cut.edf", "locked.edf"):
            z.writestr(n, good)
        z.writestr("junk.edf", b"junk")
        z.writestr("head.edf", good[:300])
    with zipfile.ZipFile(tmp_path / "s.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("sum.edf", good)
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    infos = {i.filename: i for i in zipfile.ZipFile(io.BytesIO(raw)).infolist()}
    at = infos["cut.edf"].header_offset
    body = at + 30 + sum(struct.unpack("<HH", raw[at + 26 : at + 30]))
    raw[body + 500 : body + 560] = b"\xff" * 60
    central = raw.index(b"PK\x01\x02")
    for name in ("sum.edf", "locked.edf"):
        entry = raw.index(name.encode(), central) - 46
        if name == "sum.edf":
            raw[entry + 16] ^= 255
        else:
            raw[entry + 8] |= 1
    (tmp_path / "a.zip").write_bytes(raw)
    stored = bytearray((tmp_path / "s.zip").read_bytes())
    stored[3000] ^= 255
    (tmp_path / "s.zip").write_bytes(stored)
    (tmp_path / "no.zip").write_bytes(b"PK no archive")
    (tmp_path / "flat.edf").write_bytes(good[: 256 + 6] + good[256 + 6 :].replace(b"32767   ", b"-32768  "))
    (tmp_path / "empty.edf").write_bytes(b"")
    (tmp_path / "none.edf").write_bytes(render(made(seconds=1))[: 256 * 4])
    chunks = recordings.read(spark, str(tmp_path), chunk_samples=128)
    failed = {r.filename.removeprefix(f"file:{tmp_path}/"): r.error for r in recordings.failures(chunks).collect()}
    assert set(failed) == {"a.zip!/sum.edf", "a.zip!/cut.edf", "a.zip!/locked.edf", "a.zip!/junk.edf", "a.zip!/head.edf", "s.zip!/sum.edf", "no.zip", "flat.edf", "empty.edf"}
    assert "checksum" in failed["a.zip!/sum.edf"] and "encrypted" in failed["a.zip!/locked.edf"] and "NotEdf" in failed["a.zip!/junk.edf"] and "digital range" in failed["flat.edf"]
    sound = recordings.sound(chunks)
    assert {r.filename.removeprefix(f"file:{tmp_path}/"): r.n_samples for r in recordings.headers(sound).collect()} == {"a.zip!/good.edf": 768, "none.edf": 0}
    assert [r.error is None for r in recordings.read(spark, str(tmp_path), "headers").where("filename like '%junk%' or filename like '%good%'").orderBy("filename").collect()] == [True, False]
    assert recordings.list_members(spark, str(tmp_path)).where("error is not null").count() == 1


def test_equal_labels_get_numbers_and_missing_paths_are_told(spark, tmp_path):
    r = made(seconds=2)
    r.channels = ["C3", "C3"]
    (tmp_path / "x.edf").write_bytes(render(r))
    assert {c for _, c in assembled(recordings.read(spark, str(tmp_path)))} == {"C3-0", "C3-1"}
    assert recordings.read(spark, [f"{tmp_path}/x.edf"], only='["other"]').collect() == []
    with pytest.raises(Exception, match="FileNotFound"):
        recordings.read(spark, f"{tmp_path}/nowhere").collect()


def test_an_archive_of_3_gb_is_a_task_for_each_member(spark, tmp_path):
    """A sparse file: members are stored, almost all of them holes."""
    one, n, pad = render(made(seconds=4)), 6, 512 << 20
    path, infos = tmp_path / "big.zip", []
    with open(path, "wb") as f:
        for i in range(n):
            name = f"id{i}/EEG.edf".encode()
            crc = zipfile.crc32(one)
            infos.append((name, f.tell(), crc))
            f.write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 20, 0, 0, 0, 33, crc, len(one), len(one), len(name), 0) + name + one)
            f.seek(pad, os.SEEK_CUR)
        begin = f.tell()
        for name, at, crc in infos:
            f.write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 20, 20, 0, 0, 0, 33, crc, len(one), len(one), len(name), 0, 0, 0, 0, 0, at) + name)
        size = f.tell() - begin
        f.write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, n, n, size, begin, 0))
    assert os.path.getsize(path) > 3 << 30
    chunks = recordings.read(spark, str(tmp_path))
    assert chunks.rdd.getNumPartitions() == n
    assert len({r.pid for r in chunks.where("channel = 'C3'").select(F.spark_partition_id().alias("pid")).collect()}) == n
    assert {r.n_samples for r in recordings.headers(recordings.sound(chunks)).collect()} == {512}
    assert recordings.read(spark, str(tmp_path), "members").rdd.getNumPartitions() == 1


def test_long_files_are_dealt_out_by_ranges(spark, tmp_path):
    (tmp_path / "long.edf").write_bytes(render(made(seconds=100)))
    chunks = recordings.read(spark, str(tmp_path), chunk_samples=1024, range_bytes=10_000)
    assert chunks.rdd.getNumPartitions() >= 5
    rows = chunks.where("channel = 'C3'").select("chunk", "start", F.size("samples").alias("n")).orderBy("chunk").collect()
    assert [(r.chunk, r.start, r.n) for r in rows] == [(k, 1024 * k, min(1024, 12800 - 1024 * k)) for k in range(13)]


def test_header_of_any_rate(folder):
    root, _ = folder
    with open(f"{root}/ALS01/time1/EEG.edf", "rb") as f:
        header = edf.read_header(f.read)
    assert (header.sfreq, header.rate, header.channels) == (128.0, 128, ["C3", "C4"])
    assert [f.path.rsplit("/", 1)[1] for f in files.walk([root], r"\.zip$")] == ["odd.zip", "one.zip", "two.ZIP"]
