import random

import pytest

from voltlake.llm import linededup as L

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, __gone string, _same string"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return any(a[p + i :] == b[p + j :] for i, j in ((0, 0), (1, 1), (1, 0), (0, 1)))


def brute(docs, min_chars=L.MIN_CHARS, exact_chars=L.EXACT_CHARS):
    big = 1 << 63
    places = {(big if d is None else d, i): x.strip(" ") for d, t in docs if t is not None for i, x in enumerate(t.split("\n"))}
    near = lambda y, x: min(len(x), len(y)) >= min_chars and within_one(y, x)
    return {p for p, x in places.items() if any(q < p and (y == x and len(x) >= exact_chars or near(y, x)) for q, y in places.items())}


def fixture():
    rng = random.Random(6)
    base = ["".join(rng.choices("ab é", k=n)).strip().ljust(n, "x") for n in (19, 20, 21, 24, 25, 40, 41, 90)]

    def near(t):
        i, how = rng.randrange(len(t)), rng.randrange(4)
        return t[:i] + ("" if how == 0 else "Z" if how == 1 else "Zab"[how] + t[i] if how == 2 else t[i]) + t[i + 1 :]

    docs = [(i, "\n".join([*(near(rng.choice(base)) for _ in range(rng.randrange(6))), "", "short"])) for i in rng.sample(range(300), 60)]
    return [*docs, (400, None), (401, ""), (402, "\n\n"), (None, base[3] + "\n" + "only here, in the row without key"), (403, "a" * 30 + "\n" + "a" * 31 + "\n" + "b" + "a" * 30)]


def test_dropped_lines_equal_brute_force(spark):
    docs = fixture()
    frame = spark.createDataFrame([(i, t, "l", "s", len(t or ""), "a", "b", "c") for i, t in docs], SCHEMA).repartition(3)
    want = brute(docs)
    got = {r.doc_id: r for r in L.marks(frame).collect()}
    assert {((1 << 63) if d is None else d, i) for d, r in got.items() for i in r.removed} == want
    for d, t in docs:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if ((1 << 63) if d is None else d, i) not in want)
        assert got[d].text == left and got[d].n_lines == (0 if t is None else t.count("\n") + 1)
    kept = {r.doc_id: r for r in L.clean(frame).collect()}
    assert {400, 401, 402} <= set(kept)
    assert all(kept[d].text == got[d].text and kept[d].n_chars == len(got[d].text or "") for d in kept)
    assert L.clean(frame).columns == frame.columns


def test_repeated_rows_share_their_fate_and_empty_tables(spark):
    t = "one line that is long enough"
    frame = spark.createDataFrame([(1, t, "l", "s", 1, "a", "b", "c")] * 2 + [(2, t + "\nanother line that is long enough", "l", "s", 1, "a", "b", "c")], SCHEMA)
    assert sorted((r.doc_id, r.n_removed) for r in L.marks(frame).collect()) == [(1, 0), (1, 0), (2, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert L.marks(empty).collect() == [] and L.clean(empty).collect() == []


def test_rows_without_a_key_or_with_a_repeated_one_lose_only_their_own_lines(spark):
    again = "this long line stands in several rows"
    own = ["what only the first of them says here", "and the second one has this to tell", "nobody but the third wrote that down", "words of the fourth row and no other"]
    near = ["a line of the third that differs by x", "a line of the third that differs by y"]
    texts = [(1, again), (None, own[0] + "\n" + again), (None, own[1] + "\n" + own[2]), (None, near[0]), (2, near[1]), (7, own[3]), (7, again)]
    frame = spark.createDataFrame([(i, t, "l", "s", len(t), "a", "b", "c") for i, t in texts], SCHEMA).repartition(3)
    assert sorted(r.text for r in L.clean(frame).collect()) == sorted([again, own[0], own[1] + "\n" + own[2], near[1], own[3]])


@pytest.mark.parametrize(("min_chars", "exact_chars"), [(20, 20), (5, 1), (30, 3), (3, 50)])
def test_lengths_from_which_lines_count(spark, min_chars, exact_chars):
    docs = fixture() + [(500, "short\nshorts\n \n"), (501, " short \n\nother")]
    frame = spark.createDataFrame([(i, t, "l", "s", 1, "a", "b", "c") for i, t in docs], SCHEMA)
    got = {((1 << 63) if r.doc_id is None else r.doc_id, i) for r in L.marks(frame, min_chars=min_chars, exact_chars=exact_chars).collect() for i in r.removed}
    assert got == brute(docs, min_chars, exact_chars)


def test_columns_of_any_name_stay_and_keys_are_numbers(spark):
    frame = spark.createDataFrame([(1, "one line that is long enough", "l", "s", 28, "a", "b", "c"), (2, "one line that is long enough\nmore", "l", "s", 33, "d", "e", "f")], SCHEMA)
    assert {(r["__id"], r["__gone"], r["_same"], r.n_chars) for r in L.clean(frame).collect()} == {("a", "b", "c", 28), ("d", "e", "f", 4)}
    with pytest.raises(TypeError, match="whole number"):
        L.marks(frame.withColumn("doc_id", frame["text"]))
