import hashlib
import random
import re

from voltlake.llm import decontaminate as D

DOCS = "doc_id bigint, text string, items string, spans string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), len(hit), sorted(found, key=lambda x: (x is None, x or 0))


def fixture():
    rng = random.Random(2)
    vocabulary = ["a", "B", "ç", "d1", "É", "f"]
    items = [(i % 9, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 13])))) for i in range(2, 12)] + [(1, None), (5, "..."), (None, "a b")]
    docs = [(i, "-".join(rng.choices([*vocabulary, "zz", "q"], k=rng.choice([0, 1, 5, 40])))) for i in range(60)] + [(3, "same"), (3, "same"), (None, "a b ç"), (99, None)]
    return items, docs


def test_matches_equal_brute_force(spark):
    items, docs = fixture()
    for some in (items, [x for x in items if x[1] and len(x[1]) > 8], []):
        benchmark = spark.createDataFrame(some, "item_id bigint, text string")
        frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
        for block in (10**5, 500, 12, 8):
            got = D.matches(frame, benchmark, window=4, block_words=block).collect()
            want = sorted(str((i, *brute(t, some, 4))) for i, t in docs)
            assert sorted(str((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"]))) for r in got) == want


def test_clean_leaves_nothing_of_the_benchmark(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{i}" for i in range(14))
    own = lambda n: " ".join(f"x{rng.random()}" for _ in range(n))
    half = passage.split()[:5]
    docs = [(1, f"{own(30)}. {passage.upper()}! {own(30)}"), (2, own(9)), (3, passage), (4, None), (5, ""), (6, f"{own(40)} {' '.join(half)} {passage} {' '.join(passage.split()[5:])} {own(40)}")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    benchmark = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    out = D.clean(frame, benchmark)
    assert out.columns == frame.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert sorted(kept) == [1, 2, 4, 5, 6]
    assert kept[2].text == docs[1][1] and kept[4].text is None
    assert kept[1].n_chars == len(kept[1].text) < len(docs[0][1])
    assert not any(r.spans for r in D.matches(out, benchmark).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert D.digests(D.matches(docs, benchmark)).collect() == []
    assert D.clean(docs, benchmark).collect() == []


def test_clean_by_blocks_equals_clean_by_one_and_items_without_an_id_count(spark):
    w = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    one, two = w("one", 12), w("two", 12)
    docs = [
        (1, f"{one} {w('own', 16)} {two}"),  # 12 of 40 words by either, so together over the limit
        (2, f"{w('own', 40)} {w('one', 6)} {two} {' '.join(one.split()[6:])} {w('own', 9)}"),  # what one block cuts makes a window of the other
        (3, f"{w('own', 60)} {w('none', 12)}"),
        (4, w("own", 30)),
        (5, None),
    ]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, one), (2, two), (None, w("none", 12))], "item_id bigint, text string")
    whole = {r.doc_id: r.text for r in D.clean(docs, items).collect()}
    assert whole == {r.doc_id: r.text for r in D.clean(docs, items, block_words=12).collect()}
    assert set(whole) == {2, 3, 4, 5} and "none" not in whole[3] and "one" not in whole[2]


def test_items_without_an_id_and_ids_of_other_types(spark):
    docs = spark.createDataFrame([("k1", "x a b c y"), ("k2", "d e f"), (None, "q")], "doc_id string, text string")
    items = spark.createDataFrame([("i1", "a b"), (None, "b c"), (None, "e f")], "item_id string, text string")
    got = {r.doc_id: r for r in D.digests(D.matches(docs, items, window=2)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert {k: (r.n_hit, r.n_items, r.items_sha256) for k, r in got.items()} == {"k1": (3, 2, sha("i1")), "k2": (2, 1, sha("")), None: (0, 0, sha(""))}


def test_clean_is_the_same_for_any_block_and_coverage(spark):
    rng = random.Random(8)
    w = lambda c, n: [f"{c}{i}" for i in range(n)]
    items = [(1, w("one", 30)), (2, w("two", 14)), (None, w("none", 3)), (4, w("four", 25))]
    docs = []
    for i in range(40):
        text = [f"own{rng.random()}" for _ in range(rng.choice([0, 5, 30]))]
        for _, item in items:
            if rng.random() < 0.5:
                a, n = rng.randrange(len(item)), rng.choice([3, 8, 12, 30])
                at = rng.randrange(len(text) + 1)
                text[at:at] = item[a : a + n]
        docs.append((i, " ".join(text), *range(5)))
    names = ["__total", "__gone", "__first", "__spans", "_total"]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, " + ", ".join(f"{n} bigint" for n in names))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id bigint, text string")
    plain = [(i, " ".join(t)) for i, t in items]
    for coverage in (0.0, 0.3, 0.5, 1.0):
        found = []
        for block in (12, 500, 10**5):
            out = D.clean(frame, benchmark, coverage=coverage, block_words=block)
            rows = sorted(map(tuple, out.collect()))
            assert out.columns == frame.columns and all(r[2:] == (0, 1, 2, 3, 4) for r in rows)
            found.append(rows)
        assert found[0] == found[1] == found[2]
        kept = {r[0]: r[1] for r in found[0]}
        for i, t, *_ in docs:
            n, hit, _ = brute(t, plain, 10)
            if hit and hit >= coverage * n:
                assert i not in kept
            if not hit:
                assert kept[i] == t
        assert not any(brute(t, plain, 10)[1] for t in kept.values())
