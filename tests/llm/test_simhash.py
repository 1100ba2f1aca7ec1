import random

import numpy as np
import xxhash

from voltlake.llm import simhash as S
from voltlake.llm.components import components

SCHEMA = "doc_id bigint, text string, fp string, component_id string, fingerprint string"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs, nodes):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


def test_clusters_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    base = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 300, 301, 400)]
    docs = []
    for t in base:
        for k in range(6):
            w = t.split(" ")
            if k and len(w) > 5:
                w[rng.randrange(len(w))] = word()
            docs.append((len(docs) * 3 % 50, "\t".join(w).upper() if k == 2 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, " \n"), (7, docs[0][1]), (7, docs[0][1]), (None, "only null"), (None, base[5])]
    got = S.cluster(spark.createDataFrame([(*d, "a", "b", "c") for d in docs], SCHEMA)).collect()
    fps = [fingerprint(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = groups(pairs, range(len(docs)))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted(str((d, f"{fps[i]:016x}", least.get(root[i]))) for i, (d, _) in enumerate(docs))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want


def test_links_of_random_fingerprints_and_a_split_shard(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = {0}
    while len(values) < 220:  # walks by few bits: one dense family, and strangers
        x = int(rng.choice(list(values))) if rng.random() < 0.8 else int(rng.integers(0, 1 << 62))
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        values.add(x if x < 1 << 63 else x - (1 << 63))
    nodes = sorted(values)
    frame = spark.createDataFrame([(v,) for v in nodes], "fp bigint")
    want = groups([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3], nodes)
    for shard in (S.SHARD, 5):
        monkeypatch.setattr(S, "SHARD", shard)
        got = {v: v for v in nodes} | {r.node: r.root for r in components(S.links(frame)).collect()}
        assert got == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}


def test_empty_table(spark):
    assert S.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_near_duplicates_of_the_given_documents_equal_an_exact_join(spark):
    """All pairs of distinct sets of five-word shingles that are 0.8 similar, by an inverted index, and what is kept of their groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    sets = {}
    for i, t in rows:
        sets.setdefault(tuple(S.shingle_set(t.encode()).tolist()), []).append(i)
    named = list(sets)
    where = {}
    for n, s in enumerate(named):
        for h in s:
            where.setdefault(h, []).append(n)
    shared = {}
    for own in where.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] = shared.get((own[b], own[a]), 0) + 1
    root = list(range(len(named)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    similar = [(a, b) for (a, b), n in shared.items() if n >= S.SIMILARITY * (len(named[a]) + len(named[b]) - n)]
    for a, b in similar:
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for n, s in enumerate(named):
        k = find(n)
        least[k] = min([least.get(k, 1 << 62), *sets[s]])
    kept = [r.doc_id for r in S.similar_representatives(docs).collect()]
    assert sorted(kept) == sorted(least.values()) and len(kept) < len(rows)


def test_parities_differ_in_no_more_places_than_sets_do():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 200, 3000):
        a = rng.integers(0, 1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
        for gone, more in ((0, 0), (n // 10, n // 10), (n, 7)):
            b = np.concatenate((a[gone:], rng.integers(0, 1 << 63, size=more, dtype=np.uint64)))
            x, y = (S.parity(np.unique(v)).view(np.uint64) for v in (a, b))
            differ = sum(int(v).bit_count() for v in x ^ y)
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert differ <= apart
            if apart < 40:
                assert differ >= apart - 8
