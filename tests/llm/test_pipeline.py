import random

import pytest

import corpus_pipeline as P
from voltlake.llm import common, simhash
from tests.llm import test_decontaminate, test_linededup, test_simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    line = lambda n=30: " ".join(rng.choices(words, k=n))
    passage = " ".join(f"bench{i}" for i in range(15))
    shared = line()
    docs, labels = [], []
    for i in range(240):
        lines = [line() for _ in range(rng.randrange(1, 6))]
        if i % 4 == 1:
            lines.insert(0, shared if i % 8 == 1 else shared[:-1] + "Z")
        if i % 10 == 3:
            lines.append(f"{line()} {passage} {line(5)}")
        t = "\n".join(lines)
        toxic, poor = i % 6 == 0, i % 6 == 1
        if toxic:
            t = t.replace(" ", " vile, ", 1)
        if poor:
            t = t.upper().replace(" ", "!! ")
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(500 + i, docs[20 + i][1] + " more", "en", "s", 0) for i in range(6)] + [(600, docs[2][1], "en", "s", 0), (601, passage, "en", "s", 0), (602, None, "en", "s", None), (603, "", "en", "s", 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def similar(sets):
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_each_stage_equals_brute_force_on_its_own_input(spark, folder):
    docs = common.read(spark, folder, "documents")
    seen = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name != "quality" else {r.doc_id: r.text for r in docs.collect()}
        docs = common.stash(stage(spark, docs, folder))
        after = docs.collect()
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            after = {r.doc_id: r.text for r in after}
        seen[name] = (before, after)

    before, after = seen["quality"]
    right = [(i in after) == (i % 6 > 1) for i in before if i < 240]
    assert sum(right) >= 0.97 * len(right)

    before, after = seen["line_dedup"]
    gone = test_linededup.brute(list(before.items()))
    assert gone
    want = {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in before.items()}
    assert after == {d: t for d, t in want.items() if t == before[d] or t.strip()}

    before, after = seen["simhash"]
    sets = {d: shingles(t) for d, t in before.items()}
    roots = test_simhash.groups(similar(sets), list(sets))
    assert any(roots[d] != d for d in roots)
    assert after == {d: t for d, t in before.items() if roots[d] == d}

    before, after = seen["decontaminate"]
    items = [(r.item_id, r.text) for r in common.read(spark, folder, "benchmark").collect()]
    hits = {d: test_decontaminate.brute(t, items, 10) for d, t in before.items()}
    assert {d for d in before if d not in after} == {d for d, (n, hit, _) in hits.items() if hit and hit >= 0.5 * n}
    assert all(after[d] == t for d, t in before.items() if not hits[d][1])
    assert all(not test_decontaminate.brute(t, items, 10)[1] for t in after.values())

    before, after = seen["bpe"]
    assert {r.doc_id for r in after} == set(before)
    assert {r.doc_id: r.decoded_sha256 for r in after} == {d: __import__("hashlib").sha256((t or "").encode()).hexdigest() for d, t in before.items()}


def test_run_is_all_stages(spark, folder):
    assert P.run(spark, folder).count() > 100


def test_representatives_of_odd_rows(spark):
    rows = [(1, "a b c d e", "x", "s", 1), (1, "a b c d e", "y", "s", 1), (1, "quite another text here", "x", "s", 1), (None, "a b c d e", "x", "s", 1), (None, "nobody else says this", "x", "s", 1), (5, None, "x", "s", 1), (4, "", "x", "s", 1)]
    kept = simhash.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, "a b c d e"), (1, "quite another text here"), (None, "nobody else says this"), (4, "")]))


def test_simhash_stage_finds_planted_copies_of_similarity_four_fifths(spark, folder):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(60):
        a = [word() for _ in range(rng.choice([80, 200, 400]))]
        b, c = list(a), list(a)
        for j in range(0, len(b), 70):
            b[j + 7] = word()
        for j in range(0, len(c), 20):  # too many changes for the similarity, and only for that
            c[j + 7] = word()
        rows += [(3 * i, " ".join(a)), (3 * i + 1, " ".join(b)), (3 * i + 2, " ".join(c))]
    sets = {d: shingles(t) for d, t in rows}
    near = similar(sets)
    fps = {d: test_simhash.fingerprint(t) for d, t in rows}
    assert len(near) >= 60 and sum((fps[a] ^ fps[b]).bit_count() > 3 for a, b in near) > 30
    roots = test_simhash.groups(near, list(sets))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in P.simhash_stage(spark, frame, folder).collect()} == {d for d in sets if roots[d] == d}


def test_texts_around_one_passage_meet_only_in_what_is_rare(spark, folder):
    """A group that shares most of its shingles without being similar makes no pairs; the similar ones among it are found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    passage = [word() for _ in range(100)]
    rows = []
    for i in range(150):
        own = [word() for _ in range(rng.choice([30, 40, 60]))]
        rows.append((2 * i, " ".join(passage + own)))
        if i % 5 == 0:
            own[-8] = word()
            rows.append((2 * i + 1, " ".join(passage + own)))
    sets = {d: shingles(t) for d, t in rows}
    near = similar(sets)
    roots = test_simhash.groups(near, list(sets))
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in P.simhash_stage(spark, frame, folder).collect()} == {d for d in sets if roots[d] == d}

    hashed = {d: simhash.shingle_set(t.encode()) for d, t in rows}
    about = {d: {"size": len(h), "sketch": simhash.sketch(simhash.least_hashes(h)).view("<i8").tolist()} for d, h in hashed.items()}
    made = spark.createDataFrame([(d, h.view("<i8").tolist(), simhash.parity(h).tolist()) for d, h in hashed.items()], "set bigint, shingles array<bigint>, parity array<bigint>")
    named = spark.createDataFrame([(d, d, about[d]) for d in hashed], "set bigint, root bigint, about struct<size:int,sketch:array<bigint>>")
    pairs = {tuple(sorted((r.a, r.b))) for r in simhash._prefix_pairs(made, named, 0.8).collect()}
    assert set(near) <= pairs and len(pairs) < 2 * len(near) + 10


def test_empty_documents_null_keys_and_other_columns_pass_through_all_stages(spark, folder):
    """Each stage, one after the other, on rows without a key or a text and with columns of other names; and on no rows at all."""
    names = ["gone", "__gone", "_total", "set", "parity", "key", "word"]
    text = "some words of a plain document that nobody else has written so far, and so it stays"
    rows = [(None, text), (None, "another document without a key, whose words are its own as well"), (901, None), (902, ""), (903, "a third one, with a key and with words enough to be kept by all of them")]
    schema = SCHEMA + ", " + ", ".join(f"{n} string" for n in names)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or ""), *names) for d, t in rows], schema)
    docs, none = frame, frame.where("false")
    for name, stage in P.STAGES[:-1]:
        docs, none = common.stash(stage(spark, docs, folder)), common.stash(stage(spark, none, folder))
        assert docs.columns == frame.columns and none.collect() == [], name
        assert all(tuple(r)[5:] == tuple(names) for r in docs.collect())
    kept = docs.collect()
    assert {r.text for r in kept} >= {text, rows[1][1], rows[4][1]}
    last = P.STAGES[-1][1]
    assert last(spark, none, folder).collect() == [] and last(spark, docs, folder).count() == len(kept)


def test_simhash_stage_links_by_fingerprints(spark, folder, monkeypatch):
    """Texts whose fingerprints are near are found by the trees, without any bucket, and only if their sets are similar."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = []
    for i in range(25):
        a = [word() for _ in range(600)]
        for k in range(4):
            b = list(a)
            if k:
                b[rng.randrange(600)] = word()
            rows.append((4 * i + k, " ".join(b)))
    rows += [(200 + i, word()) for i in range(40)] + [(300, ""), (301, None)]
    sets = {d: simhash.shingle_set((t or "").encode()) for d, t in rows}
    fps = {d: int(simhash.majority(x, simhash.np.array([len(x)]))[0]) for d, x in sets.items()}
    near = [(a, b) for a, b in similar({d: shingles(t) for d, t in rows}) if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS]
    assert len(near) > 40
    roots = test_simhash.groups(near, list(sets))
    # No set has a signature, so none has a bucket.
    monkeypatch.setattr(simhash, "signatures", lambda least: simhash.np.zeros(0, simhash.np.uint64))
    frame = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA).repartition(3)
    assert {r.doc_id for r in P.simhash_stage(spark, frame, folder).collect()} == {d for d in sets if roots[d] == d}
