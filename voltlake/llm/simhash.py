"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

`cluster` reads only the key and text columns (others of any name are ignored) and returns one row per document row:
the key, `fingerprint` (16 hex digits) and `component_id`, the least key reachable by links.

* null or empty text: no shingles, fingerprint zero, linked like any other; fewer words than a shingle: one shingle of them all
* repeated rows and exact copies share a fingerprint, hence a component; a null key counts as greater than any other and is given back as null
* a bit set in exactly half of the shingles is 0
* an empty table gives an empty result

Fingerprints of all documents never come to the driver, so the shard trees are not broadcast from there: the 64 bits
are cut into five blocks, and fingerprints that agree in two blocks meet in a shard. Two fingerprints that differ in at
most three bits agree in two blocks at least, so every link is found in some shard. Each shard is a BK-tree of its own,
built in the task that holds it. Copies are one fingerprint before anything is dealt out. A shard of over
`SHARD` fingerprints is split into blocks, and each pair of blocks is a tree.

`similar_representatives` links texts by the Jaccard similarity of their shingles. Their fingerprints are linked first, by the
same trees; each pair that a tree finds is verified on the sets themselves. Texts of similarity 0.8 lie some ten bits apart, which
no radius reaches that divides strangers, so there is an exact way for the rest: `BANDS` hashed signatures of
each set, of `ROWS` least hashes each, name buckets; a pair at the limit of 0.8 shares none with a chance of 6e-7. A
bucket's members are held against its least one if fingerprints haven't joined them. Sets of buckets that aren't one component then meet in their rarest
shingles, so that a large group of texts that are alike but not similar makes few pairs; every pair is verified on the sets
themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS, SHINGLE, SEED = 3, 3, 42
SHARD = 4096
#: Of sets of shingles: words in a shingle, similarity from which two are linked, signatures, and least hashes in each.
SET_SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 3
#: First bit and width of each block.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_LAST = (1 << 63) - 1

#: Byte -> its eight bits in the eight bytes of a word: sums of up to 255 of these words count bits without a carry.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view("<u8").ravel()


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the lower-cased words, which ASCII blanks divide."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents of which `hashes` (uint64) holds `counts` shingles each, one after the other."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts = np.cumsum(sizes) - sizes
    parts = (sizes + 254) // 255
    first = np.cumsum(parts) - parts
    within = np.arange(parts.sum()) - np.repeat(first, parts)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], np.repeat(starts, parts) + 255 * within, axis=0)
    bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    out[full] = np.packbits(2 * bits > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`key`, `same` (a hash of the text) and `fp`, the fingerprint as a signed number."""
    rows = docs.select(F.col(key).cast("long").alias("key"), _same(text).alias("same"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            of = [shingle_hashes(t, size) for t in common.texts(batch, "text")]
            counts = np.array([len(x) for x in of], np.int64)
            hashes = np.fromiter((h for x in of for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("same"), pa.array(majority(hashes, counts).view(np.int64))], ["key", "same", "fp"])

    return rows.mapInArrow(run, "key bigint, same bigint, fp bigint")


class BKTree:
    """Children are keyed by their distance to the parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, x: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.value else []
        while open_:
            at = open_.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return found

    def add(self, x: int) -> int:
        at = 0
        new = len(self.value)
        while new:
            d = (self.value[at] ^ x).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.value.append(x)
        self.children.append({})
        return new


def _forest(values: list[int], radius: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Of one shard: pairs of places within the radius, as many as hold each group together, and each place's root."""
    tree, root, pairs = BKTree(), [], []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in values:
        near = {top(i): i for i in tree.near(x, radius)}
        root.append(tree.add(x))
        for r, i in near.items():
            pairs.append((i, len(root) - 1))
            a, b = sorted((top(r), top(root[-1])))
            root[b] = a
    return pairs, [top(i) for i in range(len(values))]


def tree_edges(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of one shard, as an edge from each value to the root of its group there: links of the group are all implied."""
    return [(values[i], values[r]) for i, r in enumerate(_forest(values, radius)[1]) if r != i]


def tree_pairs(values: list[int], radius: int) -> list[tuple[int, int]]:
    """The same links as pairs that the tree has found within the radius, to be verified one by one."""
    return [(values[i], values[j]) for i, j in _forest(values, radius)[0]]


def _shards() -> Column:
    """The shard of each pair of blocks: the pair's number over the bits of both."""
    bits = lambda first, width: F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.array(*(F.lit(i << 26).cast("long").bitwiseOR(F.shiftleft(bits(*x), 13).bitwiseOR(bits(*y))) for i, (x, y) in enumerate(combinations(BLOCKS, 2))))


def links(distinct: DataFrame, radius: int = RADIUS, of_tree: Callable[[list[int], int], list[tuple[int, int]]] = tree_edges) -> DataFrame:
    """Edges `a`, `b` between distinct fingerprints (`fp`) within `radius` bits, as many as make the same components."""
    if not 0 <= radius <= 3:
        raise ValueError("two of five blocks agree only up to three differing bits")
    rows = distinct.select("fp", F.explode(_shards()).alias("shard"))
    large = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD)
    large = large.select(F.bitwise_not("shard").alias("k"), F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
    dealt = (
        rows.join(large, F.bitwise_not("shard") == F.col("k"), "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .select("shard", "fp", F.explode(pair).alias("pair"))
        .repartition("shard", "pair")
        .sortWithinPartitions("shard", "pair", "fp")
    )

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(shard: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at = np.concatenate(([0], np.flatnonzero(np.any(shard[1:] != shard[:-1], axis=1)) + 1, [len(fp)]))
            found = [e for i in np.flatnonzero(np.diff(at) > 1) for e in of_tree(fp[at[i] : at[i + 1]].view(np.uint64).tolist(), radius)]
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

        shard, fp = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column("shard").to_numpy(), batch.column("pair").to_numpy().astype(np.int64)], axis=1)
            shard, fp = np.concatenate((shard, new)), np.concatenate((fp, batch.column("fp").to_numpy()))
            begin = int(np.flatnonzero(np.any(shard != shard[-1], axis=1))[-1]) + 1 if np.any(shard != shard[-1]) else 0
            yield edges(shard[:begin], fp[:begin])  # the last shard may go on in the next batch
            shard, fp = shard[begin:], fp[begin:]
        yield edges(shard, fp)

    return dealt.mapInArrow(trees, "a bigint, b bigint")


def _same(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def _least(docs: DataFrame, key: str, text: str, size: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all rows; and of each fingerprint the root of its component, with the least (id, same) there; null ids last."""
    of = common.stash(fingerprints(docs, key, text, size))
    first = F.struct(F.coalesce("key", F.lit(_LAST)).alias("id"), "same")
    classes = of.groupBy("fp").agg(F.min(first).alias("first"))
    roots = components(links(classes.select("fp"), radius))
    rooted = common.stash(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("least")).select(F.bitwise_not("root").alias("k"), "least")
    return of, rooted.join(least, F.bitwise_not("root") == F.col("k")).select(F.bitwise_not("fp").alias("k"), "root", "least")


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    of, named = _least(docs, key, text, size, radius)
    return of.join(named, F.bitwise_not("fp") == F.col("k")).select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("least.id") != _LAST, F.col("least.id")).alias("component_id"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with all its columns: that of the least key (of several rows with it, one)."""
    _, named = _least(docs, key, text, size, radius)
    return _kept(docs, named, key, text)


def _kept(docs: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """The rows that `named` tells by (id, same) as `least`; of several with equal key and text the one of the least hash."""
    kept = named.select(F.col("least.id").alias("id"), F.col("least.same").alias("same")).distinct()
    (name,) = common.free_names(docs, "row")
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), _same(text).alias("same"), F.struct(*docs.columns).alias(name), F.xxhash64(*hashable).alias("order"))
    one = rows.join(kept, ["id", "same"], "left_semi").groupBy("id", "same").agg(F.min_by(name, "order").alias(name))
    return one.select(f"{name}.*")


_ODD = common.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))[:, None] | np.uint64(1)


def shingle_set(text: bytes, size: int = SET_SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each of BANDS x ROWS functions."""
    parts = [((hashes[i : i + 8192] ^ (hashes[i : i + 8192] >> np.uint64(29)) ^ _ODD) * _ODD).min(axis=1) for i in range(0, len(hashes), 8192)]
    return np.min(parts, axis=0)


def signatures(least: np.ndarray) -> np.ndarray:
    """A key for each band."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = common.mix(keys ^ row) + np.arange(BANDS, dtype=np.uint64)
    return keys


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each least hash, in four words."""
    nibbles = np.zeros(64, np.uint64)
    nibbles[: len(least)] = common.mix(least) >> np.uint64(60)
    return np.bitwise_or.reduce(nibbles.reshape(4, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64)), axis=1)


#: Bits of a set's parity, sixteen words.
PARITY = 1024


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of PARITY bits, whether an odd number of a set's hashes have it. What two sets share changes the bits of both
    alike, so their bits differ in no more places than the sets have hashes that the other one lacks."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _few_differ(a: str, b: str, size: Column, other: Column, similarity: float) -> Column:
    """Whether the parities of two sets leave it open that they are similar; never passes over a pair that is."""
    differ = F.lit(0)
    for i in range(PARITY // 64):
        differ = differ + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return differ <= (1 - similarity) / (1 + similarity) * (size + other) + 1e-6


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """Whether two sets may be similar, from their sizes (exactly) and their sketches.

    Of n least hashes, those of a similar pair differ in n (1 - similarity) on average; a pair is passed over if more than
    that and five and a half standard deviations differ, which a similar one does with a chance of less than 1e-6.
    """
    ones = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for i in range(4):
        x = F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones)
        differ = differ + F.bit_count(x)
    n, p = BANDS * ROWS, (1 - similarity) * 15 / 16
    size = lambda c: F.col(f"{c}.size")
    return (F.least(size(a), size(b)) >= F.greatest(size(a), size(b)) * similarity) & (differ <= n * p + 5.5 * (n * p * (1 - p)) ** 0.5)


def _sets(asked: DataFrame, of: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """`set`, its `shingles` and their `parity` for the sets of `asked` alone, made again of one text of each."""
    first = of.join(asked.select(F.bitwise_not("set").alias("k")), F.bitwise_not("set") == F.col("k"), "left_semi").groupBy("set").agg(F.min(F.struct("id", "same")).alias("first"))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), _same(text).alias("same"), F.col(text).alias("text"))
    rows = rows.join(first.select("set", "first.id", "first.same"), ["id", "same"]).select("set", "text").dropDuplicates(["set"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [shingle_set(t, size) for t in common.texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("set"), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([parity(x) for x in found], pa.list_(pa.int64()))], ["set", "shingles", "parity"])

    return common.stash(rows.mapInArrow(sets, "set bigint, shingles array<bigint>, parity array<bigint>"))


def _similar(pairs: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs `a`, `b` of sets that are similar."""
    side = lambda c, k: made.select(F.bitwise_not("set").alias(k), F.col("shingles").alias(c))
    both = pairs.join(side("x", "kx"), F.bitwise_not("a") == F.col("kx")).join(side("y", "ky"), F.bitwise_not("b") == F.col("ky")).select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared >= similarity * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return common.stash(both.mapInArrow(compare, "a bigint, b bigint"))


def _prefix_pairs(made: DataFrame, named: DataFrame, similarity: float) -> DataFrame:
    """Pairs `a`, `b` of the sets of `made` that may be similar and have different roots; `named` has `set`, `root`, `about`.

    Shingles are put in order, the rarest of these sets first. If the first one that a pair shares stands at i in one set
    and at j in the other, they share at most min(size - i, size - j): so a similar pair meets in an early one, and what
    many sets have in common stands late. Pairs whose parities differ too much are never made. No similar pair is missed here
    but for the sketches.
    """
    named = named.join(made.select(F.bitwise_not("set").alias("k"), "parity"), F.bitwise_not("set") == F.col("k")).drop("k")
    shingle = made.select("set", F.size("shingles").alias("size"), F.explode("shingles").alias("h"))
    often = shingle.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("h").alias("k"), "n")
    ranked = shingle.join(often, F.bitwise_not("h") == F.col("k")).groupBy("set").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "h"))).alias("shared"))
    # Those that no other set has come first, without being met.
    left = ranked.select("set", "size", F.size("shared").alias("left"), F.posexplode("shared").alias("i", "e")).select("set", "size", "e.h", (F.col("left") - F.col("i")).alias("left"))
    early = left.where(F.col("left") >= similarity * F.col("size") - 1e-6)
    early = common.stash(early.join(named.select(F.bitwise_not("set").alias("k"), "root", "about", "parity"), F.bitwise_not("set") == F.col("k")).drop("k"))
    part = similarity / (1 + similarity)
    small = early.where(F.col("left") >= 2 * part * F.col("size") - 1e-6).select(F.bitwise_not("h").alias("k"), *(F.col(c).alias(f"{c}_b") for c in ("set", "size", "left", "root", "about", "parity")))
    met = early.join(
        small,
        (F.bitwise_not("h") == F.col("k"))
        & (F.struct("size_b", "set_b") < F.struct("size", "set"))
        & (F.col("root") != F.col("root_b"))
        & (F.least("left", "left_b") >= part * (F.col("size") + F.col("size_b")) - 1e-6)
        & _may_be_similar("about", "about_b", similarity)
        & _few_differ("parity", "parity_b", F.col("size"), F.col("size_b"), similarity),
    )
    return met.select(F.col("set").alias("a"), F.col("set_b").alias("b")).distinct()


def _fingerprint_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs `a`, `b` of sets (`set`, `fp`, `about`) that SimHash proposes: a fingerprint's sets with its least one, and the least
    sets of fingerprints that the trees find within RADIUS bits. They may be similar; the sets decide."""
    least = classes.groupBy("fp").agg(F.min(F.struct("set", "about")).alias("b"))
    least = common.stash(least.select(F.bitwise_not("fp").alias("k"), F.col("b.set").alias("one"), F.col("b.about").alias("about_one")))
    side = lambda c: least.select(F.col("k").alias(f"k_{c}"), F.col("one").alias(c), F.col("about_one").alias(f"about_{c}"))
    equal = classes.join(side("b"), F.bitwise_not("fp") == F.col("k_b")).select(F.col("set").alias("a"), F.col("about").alias("about_a"), "b", "about_b")
    near = links(least.select(F.bitwise_not("k").alias("fp")), RADIUS, tree_pairs).distinct().withColumnsRenamed({"a": "x", "b": "y"})
    near = near.join(side("a"), F.bitwise_not("x") == F.col("k_a")).join(side("b"), F.bitwise_not("y") == F.col("k_b")).select("a", "about_a", "b", "about_b")
    return equal.union(near).where("a <> b").where(_may_be_similar("about_a", "about_b", similarity)).select("a", "b")


def similar_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SET_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of texts of which the shingles have at least this Jaccard similarity, as `representatives` does."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), _same(text).alias("same"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = [shingle_set(t, size) for t in common.texts(batch, "text")]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64).view(np.int64)
            least = [least_hashes(x) if len(x) else None for x in found]
            bands = [[] if x is None else signatures(x).view(np.int64) for x in least]
            about = [{"size": len(x), "sketch": [] if y is None else sketch(y).view(np.int64).tolist()} for x, y in zip(found, least, strict=True)]
            fp = majority(np.concatenate([*found, np.zeros(0, np.uint64)]), np.array([len(x) for x in found], np.int64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("same"), pa.array(names), pa.array(fp), pa.array(bands, pa.list_(pa.int64())), pa.array(about, pa.struct([("size", pa.int32()), ("sketch", pa.list_(pa.int64()))]))],
                ["id", "same", "set", "fp", "bands", "about"],
            )

    of = common.stash(rows.mapInArrow(run, "id bigint, same bigint, set bigint, fp bigint, bands array<bigint>, about struct<size:int,sketch:array<bigint>>"))
    verified = lambda pairs: _similar(pairs, _sets(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), of, docs, key, text, size), similarity)
    classes = of.groupBy("set").agg(F.min(F.struct("id", "same")).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("about").alias("about"))
    edges = verified(common.stash(_fingerprint_pairs(classes.select("set", "fp", "about"), similarity)))
    # What fingerprints don't hold together: sets of another component than the least one of a bucket.
    roots = components(edges).select(F.bitwise_not("node").alias("k"), "root")
    member = classes.join(roots, F.bitwise_not("set") == F.col("k"), "left").select("set", "about", F.coalesce("root", "set").alias("root"), F.explode("bands").alias("band"))
    least = member.groupBy("band").agg(F.min(F.struct("set", "about", "root")).alias("b"), F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("band").alias("k"), "b")
    met = common.stash(member.join(least, F.bitwise_not("band") == F.col("k")).select("band", F.col("set").alias("a"), "about", "root", F.col("b.set").alias("b"), F.col("b.about").alias("about_b"), F.col("b.root").alias("root_b")))
    first = met.where("root <> root_b").where(_may_be_similar("about", "about_b", similarity))
    edges = edges.union(verified(common.stash(first.select("a", "b").distinct())))
    # What the least ones don't hold together: sets that share a bucket with one of another component, the least ones left out.
    roots = common.stash(components(edges))
    apart = met.where("a <> b").drop("root").join(roots.select(F.bitwise_not("node").alias("k"), "root"), F.bitwise_not("a") == F.col("k"), "left").select("band", F.col("a").alias("set"), "about", F.coalesce("root", "a").alias("root"))
    open_ = apart.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select(F.bitwise_not("band").alias("k"))
    apart = apart.join(open_, F.bitwise_not("band") == F.col("k"), "left_semi").groupBy("set").agg(F.first("root").alias("root"), F.first("about").alias("about"))
    apart = common.stash(apart)
    made = _sets(apart, of, docs, key, text, size)
    edges = edges.union(_similar(common.stash(_prefix_pairs(made, apart, similarity)), made, similarity))
    roots = components(edges)
    rooted = common.stash(classes.join(roots, classes["set"] == roots["node"], "left").select("first", F.coalesce("root", "set").alias("root")))
    return _kept(docs, rooted.groupBy("root").agg(F.min("first").alias("least")), key, text)
