import shutil
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.edf_writer import Recording, render
from voltlake.functions import kernels
from voltlake.operators import align
from voltlake.plans import recordings as plans
from voltlake.sources import recordings, sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("edf")
    rng = np.random.default_rng(1)
    t = np.arange(128 * 6) / 128
    made = {}
    for name, notes in (("ALS01/time1/scenario1/EEG.edf", [(0.0, 2.0, "Resting"), (2.0, 2.5, "Thinking and Acting"), (5.0, 0.0, "Typing")]), ("id2/time1/scenario2/EEG.edf", [])):
        x = 1e-5 * np.stack([np.sin(2 * np.pi * 10 * t), rng.normal(size=len(t))])
        made[name] = Recording(128.0, ["C3", "C4"], x, notes)
    (root / "ALS01/time1/scenario1").mkdir(parents=True)
    (root / "ALS01/time1/scenario1/EEG.edf").write_bytes(render(made["ALS01/time1/scenario1/EEG.edf"]))
    (root / "readme.txt").write_text("not a recording")
    with zipfile.ZipFile(root / "more.zip", "w") as z:
        z.writestr("id2/time1/scenario2/EEG.edf", render(made["id2/time1/scenario2/EEG.edf"]))
        z.writestr("__MACOSX/._x.EDF", b"junk")
    return str(root), made


@pytest.fixture(scope="module")
def chunks(spark, folder):
    return recordings.sound(recordings.read(spark, folder[0], chunk_samples=128)).cache()


def test_batch_features(spark, folder):
    root, _ = folder
    out = plans.batch_features(spark, root)
    rows = out.collect()
    assert {(r.category, r.subject, r.scenario, r.task) for r in rows} == {("ALS", "ALS01", "scenario1", "Resting"), ("ALS", "ALS01", "scenario1", "Think_Acting"), ("Normal", "id2", "scenario2", "full_recording")}
    assert all(r.bandpass_ok for r in rows) and len(rows) == 3 * 2 * 8
    peaks = {r.peak_frequency for r in rows if r.channel == "C3" and r.subband == "Alpha"}
    assert all(9.5 <= p <= 10.5 for p in peaks)
    assert [r.task for r in plans.batch_tasks(out).collect()] == ["Resting", "Think_Acting", "full_recording"]


@pytest.mark.parametrize("size", [128, 300, 65_536])
def test_features_equal_those_of_unsplit_recordings(spark, folder, size):
    root, _ = folder
    chunks = recordings.sound(recordings.read(spark, root, chunk_samples=size))
    got = {(r.filename.rsplit("/EEG", 1)[0].rsplit("/", 3)[1], r.task, r.channel, r.subband): r for r in plans.recording_features(chunks).collect()}
    whole = {(r.filename.rsplit("/EEG", 1)[0].rsplit("/", 3)[1], r.channel): np.array(r.samples) for r in recordings.whole(recordings.signals(chunks)).collect()}
    spans = {("ALS01", "Resting"): (0, 256), ("ALS01", "Think_Acting"): (256, 576)} | {(k[0], "full_recording"): (0, 768) for k in whole if k[0] != "ALS01"}
    assert len(got) == 3 * 2 * 8
    for (name, task), (a, b) in spans.items():
        for channel in ("C3", "C4"):
            x = kernels.fir_bandpass(whole[name, channel], 128.0, 0.5, 49.0)[a:b]
            freqs, power = kernels.spectrum(x, 128.0)
            for band, limits in plans.SUBBANDS.items():
                r, y = got[name, task, channel, band], kernels.bandpass(x, 128.0, *limits)
                assert np.allclose((r.mav, r.variance, r.std), (np.abs(y).mean(), y.var(), y.std()), rtol=1e-8)
                assert np.allclose((r.band_power, r.relative_power, r.peak_frequency), kernels.band_features(freqs, power, *limits), rtol=1e-8)


def test_runs_without_samples_equal_islands_of_samples(spark):
    rng = np.random.default_rng(7)
    heads, notes = [], []
    for f in range(12):
        sfreq = float(rng.choice([128.0, 100.0, 256.0, 7.3, 3.0]))
        n = int(rng.choice([1, 50, 400]))
        heads.append((f"f{f}", sfreq, n))
        for i in range(int(rng.integers(0, 30))):
            onset = float(np.round(rng.uniform(-1, n / sfreq + 1), int(rng.integers(0, 4))))
            if rng.random() < 0.3:
                onset = float(rng.integers(0, n + 1)) / sfreq
            notes.append((f"f{f}", i, onset, float(rng.choice([0.0, 0.0, 0.5, 1.0, 40.0])), str(rng.choice(["Resting", "Thinking and Acting", "Typing"]))))
    heads = spark.createDataFrame(heads, "filename string, sfreq double, n_samples bigint")
    notes = spark.createDataFrame(notes, "filename string, annot_idx bigint, onset double, duration double, description string")
    times = heads.select("filename", "sfreq", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_samples") - 1)).alias("sample_idx")).select("filename", "sample_idx", (F.col("sample_idx") / F.col("sfreq")).alias("time"))
    want = align.islands(align.mark(times, notes)).where("task <> 'none'")
    for bits in (16, 4):
        align.BUCKET_BITS = bits
        try:
            got = align.runs(align.disjoint(align.regular_spans(heads, notes)))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            # And without any shortcut: the last annotation that covers a sample, or is nearest to it.
            marked = {(r.filename, r.sample_idx): r.marker for r in align.mark(times, notes).collect()}
        finally:
            align.BUCKET_BITS = 16
        plain = {k: "none" for k in marked}
        ticks = {}
        for r in times.collect():
            ticks.setdefault(r.filename, []).append((r.time, r.sample_idx))
        for r in sorted(notes.collect(), key=lambda r: r.annot_idx):
            name = "Think_Acting" if r.description == "Thinking and Acting" else r.description
            if r.duration > 0:
                hit = [i for t, i in ticks[r.filename] if r.onset <= t < r.onset + r.duration]
            else:
                hit = [min((abs(t - r.onset), i) for t, i in ticks[r.filename])[1]]
            plain |= {(r.filename, i): name for i in hit}
        assert marked == plain


def test_processing_and_slices(spark, chunks):
    out = plans.process(recordings.signals(chunks), channels=["C3", "C4", "Cz"], drop_bad=True, clip_uv=5.0, notch_hz=50.0, band=(1.0, 40.0), ica=True, eog_only=True)
    whole = recordings.whole(out)
    assert whole.count() == 4 and {len(r.samples) for r in whole.collect()} == {768}
    cut = {(r.task, r.channel): len(r.samples) for r in align.sliced_segments(recordings.whole(recordings.signals(chunks)), recordings.annotations(chunks)).collect()}
    assert cut[("Resting", "C3")] == 256 and cut[("Think_Acting", "C4")] == 320 and cut[("full_recording", "C3")] == 768 and len(cut) == 6
    with pytest.raises(ValueError, match="none of the channels"):
        plans.process(recordings.signals(chunks), channels=["Cz"])


def test_a_store_parses_only_what_is_new_changed_or_failed(spark, folder, tmp_path):
    root, made = folder
    source, store = f"{tmp_path}/in", f"{tmp_path}/store"
    shutil.copytree(root, source)
    assert plans.ingest(spark, source, store) == 2
    names = lambda: {r.filename.removeprefix(f"file:{source}/") for r in plans.stored(spark, store).select("filename").distinct().collect()}
    all_ = {"ALS01/time1/scenario1/EEG.edf", "more.zip!/id2/time1/scenario2/EEG.edf"}
    assert names() == all_
    assert [r.filename.removeprefix(f"file:{source}/") for r in plans.failures(spark, store).collect()] == ["more.zip!/__MACOSX/._x.EDF"]
    batches = lambda: [{r.filename.removeprefix(f"file:{source}/") for r in spark.read.parquet(f"{store}/chunks").where(F.col("batch") == b.batch).select("filename").distinct().collect()} for b in spark.read.parquet(f"{store}/ledger").select("batch").distinct().orderBy("batch").collect()]
    # Nothing changed: only the member that failed is looked at again, and only if that is wanted.
    assert plans.ingest(spark, source, store, retry=False) == 0
    assert plans.ingest(spark, source, store) == 1
    assert batches()[1] == {"more.zip!/__MACOSX/._x.EDF"} and names() == all_
    # A new file, and one that changed; an archive that lost a member.
    shutil.copy(f"{root}/ALS01/time1/scenario1/EEG.edf", f"{source}/new.edf")
    short = Recording(128.0, ["C3"], made["ALS01/time1/scenario1/EEG.edf"].signals[:1, :256])
    (tmp_path / "in/ALS01/time1/scenario1/EEG.edf").write_bytes(render(short))
    with zipfile.ZipFile(f"{source}/more.zip", "w") as z:
        z.writestr("other.edf", render(short))
    assert plans.ingest(spark, source, store) == 3
    assert batches()[2] == {"ALS01/time1/scenario1/EEG.edf", "new.edf", "more.zip!/other.edf"} == names()
    rows = plans.stored(spark, store).where("channel is not null").groupBy("filename").agg(F.sum(F.size("samples")).alias("n")).collect()
    assert {r.filename.rsplit("/", 1)[1]: r.n for r in rows} == {"EEG.edf": 256, "new.edf": 1536, "other.edf": 256}
    assert plans.failures(spark, store).collect() == []
    # What no ledger names isn't read, such as chunks of a run that broke off.
    shutil.copytree(f"{store}/chunks", f"{tmp_path}/more")
    first = sorted((tmp_path / "more").iterdir())[0]
    shutil.copytree(first, f"{store}/chunks/batch=broken")
    assert names() == {"ALS01/time1/scenario1/EEG.edf", "new.edf", "more.zip!/other.edf"}
    assert plans.ingest(spark, source, store) == 0
    assert plans.stored(spark, f"{tmp_path}/nowhere").collect() == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", "C3", 1.0), ("B", "C4", 2.0)], "task string, channel string, value double")
    sinks.write_partitioned_csv(df, f"{tmp_path}/tree", ["task", "channel"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/tree").where((F.col("task") == "B") & (F.col("channel") == "C4")).count() == 1
    sinks.write_csv(df, f"{tmp_path}/flat")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/flat").count() == 2
    sinks.workbook(f"{tmp_path}/book.xlsx", {"Delta/1": df})
    assert sinks.sheet_name("a/b" + "c" * 40) == "ab" + "c" * 29


def test_a_stream_adds_new_files_once(spark, folder, tmp_path):
    from voltlake.streaming import recordings as streaming

    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    shutil.copytree(f"{folder[0]}/ALS01", f"{source}/ALS01")
    for n in (1, 2, 2):
        streaming.append_features(streaming.stream_files(spark, source), out, f"{tmp_path}/state").awaitTermination()
        assert spark.read.parquet(out).select("filename").distinct().count() == n
        if n == 1:
            shutil.copy(f"{folder[0]}/more.zip", source)
