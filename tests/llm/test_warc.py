import glob
import gzip
import hashlib
import json
import os

import pytest

from voltlake.llm import warc

SCHEMA = "page_id bigint, url string, html string, record string, same string, key string, payload string, last string, archive string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(parts)


def brute(rows, least=1000):
    texts = [(h or "").encode() for _, _, h in rows]
    out = []
    for (i, _, _), t in zip(rows, texts):
        same = [j for (j, _, _), u in zip(rows, texts) if u == t]
        last = max((j for j in same if j is not None), default=None)
        revisit = len(t) >= least and last is not None and i != last
        out.append((i, len(t), hashlib.sha1(t).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(map(str, out))


def found(frame):
    return sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in frame.collect())


LONG = "WARC/1.1\r\n\r\n\r\nWARC-Type: x\r\n" * 60
ROWS = [
    (1, "http://a/1", LONG), (5, "http://a/5", LONG), (3, None, LONG), (None, "http://a/n", LONG), (5, "http://a/5", LONG),
    (7, "http://ä/\r\nX-Key: 9 ", "é" * 600), (8, "u", "é" * 600), (9, "u", None), (10, "u", ""), (11, "u", "short"), (12, "u", "short"),
    (None, "u", "z" * 1000), (None, "v", "z" * 1000), (13, "u", "y" * 999), (14, "u", "y" * 999), (15, "u", "\r\n\r\n" * 500), (16, "u", "0123456789" * 400_000),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip_equals_brute_force(spark, parts, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", 700)
    got = warc.round_trip(frame(spark, ROWS, parts))
    assert found(got) == brute(ROWS)
    assert all(r.verified for r in got.collect())


def test_empty_table_and_string_keys(spark):
    assert warc.round_trip(frame(spark, ROWS).where("page_id < 0")).collect() == []
    own = frame(spark, [(1, "u", "x")]).selectExpr("'a b%:\r\né' AS page_id", "url", "html")
    assert [r.page_id for r in warc.round_trip(own).collect()] == ["a b%:\r\né"]


def test_each_record_is_a_member_at_its_offset(spark, tmp_path):
    whole, own = f"{tmp_path}/whole", f"{tmp_path}/own"
    warc.write(frame(spark, ROWS, 1), whole)
    made = [f for f in glob.glob(f"{whole}/*.gz") if os.path.getsize(f) > 100]
    assert len(made) == 1
    manifest = warc.normalise(warc.archives(spark, f"{whole}"), own)
    archive = manifest.where("records > 0").first().archive
    raw, at = open(archive, "rb").read(), 0
    for line in open(f"{archive}.index"):
        entry = json.loads(line)
        assert entry["offset"] == at
        one = gzip.decompress(raw[at : at + entry["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n") and entry["id"].encode() in one
        at += entry["length"]
    assert at == len(raw)
    assert gzip.decompress(raw) == gzip.decompress(open(made[0], "rb").read())
    # A second pass over what is normalised already changes nothing.
    again = warc.normalise(spark.createDataFrame([(archive,)], "path string"), f"{tmp_path}/again").first().archive
    assert open(again, "rb").read() == raw
    texts = {(r.key, bytes(r.payload)) for r in warc.read(manifest, payload=True).where("record_type = 'response'").collect()}
    assert {("16", b"0123456789" * 400_000), ("5", LONG.encode()), ("15", b"\r\n\r\n" * 500)} <= texts


def test_damaged_archives(spark, tmp_path):
    own = f"{tmp_path}/own"
    record = lambda n: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: {n}\r\n\r\n".encode() + b"x" * n + b"\r\n\r\n"
    good = record(5) + record(3000)
    kinds = {"plain.warc": good, "cut.warc": good[:-2000], "cut.warc.gz": gzip.compress(good)[:-9], "odd.warc": good + b"junk\r\n\r\n", "noise.warc.gz": b"\x1f\x8b" + b"\x07" * 50, "head.warc": good + b"WARC/1.1\r\nCont", "nolength.warc": b"WARC/1.1\r\nA: b\r\n\r\n", "two.warc.gz": gzip.compress(record(5)) + gzip.compress(record(3000)) + b"\x00" * 20}
    for name, raw in kinds.items():
        (tmp_path / name).write_bytes(raw)
    manifest = warc.normalise(spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in kinds], "path string"), own)
    told = {}
    for r in manifest.collect():
        name = r.source.rsplit("/", 1)[-1]
        n, why = told.get(name, (0, None))
        told[name] = (n + r.records, why or r.error)
    assert {n: (k, bool(why)) for n, (k, why) in told.items()} == {"plain.warc": (2, False), "cut.warc": (1, True), "cut.warc.gz": (told["cut.warc.gz"][0], True), "odd.warc": (2, True), "noise.warc.gz": (0, True), "head.warc": (2, True), "nolength.warc": (0, True), "two.warc.gz": (2, False)}
    assert {r.payload_bytes for r in warc.read(manifest).collect()} == {5, 3000}


def test_a_changed_archive_is_told(spark, tmp_path):
    warc.write(frame(spark, ROWS[-2:], 1), f"{tmp_path}/whole")
    manifest = warc.normalise(warc.archives(spark, f"{tmp_path}/whole"), f"{tmp_path}/own")
    archive = manifest.where("records > 0").first().archive
    raw = bytearray(open(archive, "rb").read())
    raw[-20] ^= 255
    open(archive, "wb").write(raw)
    assert sorted(r.verified for r in warc.read(manifest).collect()) == [False, True]
