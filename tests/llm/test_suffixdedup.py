import random
from collections import Counter

import pytest

from voltlake.llm import suffixdedup as S

SCHEMA = "doc_id bigint, text string, id string, same string, kept string"


def brute(docs, length):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(r[p : p + length] for _, r in raws for p in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append(str((i, len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g))))
    return sorted(out)


def fixture(seed, length):
    rng = random.Random(seed)
    own = lambda n: "".join(rng.choices("abcdefghij é", k=n))
    passages = [own(rng.choice([length - 2, length, length + 1, length + 30, 3 * length])) for _ in range(5)]
    docs = []
    for i in range(50):
        t = own(rng.randrange(2 * length))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            t += p[a : len(p) - rng.randrange(len(p) // 3)] + own(rng.randrange(length))
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, "x" * (3 * length)), (63, "xy" * length), (64, own(length - 1)), (5, docs[5][1]), (70, docs[6][1]), (7, docs[8][1]), (None, docs[9][1]), (None, own(length) + "z"), (80, "q" * (length + 1))]
    return docs


@pytest.mark.parametrize(("length", "hot"), [(200, S.HOT), (200, 1), (24, S.HOT), (67, 2)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(S, "HOT", hot)
    docs = fixture(length, length)
    frame = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], SCHEMA).repartition(3)
    rows = S.repeats(frame, length=length).collect()
    got = sorted(str((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))) for r in rows)
    assert got == brute(docs, length)


def test_empty_table(spark):
    assert S.digests(S.repeats(spark.createDataFrame([], SCHEMA))).collect() == []
