"""Embedding near-duplicates by an inverted multi-index.

The two halves of the unit vectors have a codebook each; a pair of code words is a cell of the product grid. A vector's
search visits cells in the order of the sum of its squared distances to both code words (multi-sequence traversal) until
the target recall, and verifies every vector in them by cosine in double precision. How far that has to go is measured:
sampled vectors are held against all others, more of them until `LINKED` have a link, and of the links they have, the
target share must lie within the cells that the traversal visits. Where the sample has too few linked vectors and isn't
the whole table, nothing is guessed: larger cells are visited as far as the triangle inequality lets a partner lie, which
misses no link. A link is looked for from both its ends.

`link` compares all rows with equal labels and returns one row per vector row: vec_id, n_links (other vectors linked
directly), component_id (least vec_id reachable) and kept. Columns of any other name are ignored.

* a null label, a null, empty or zero vector, and one with null or non-finite components link with nothing
* vectors are compared with those of their own length only
* exact copies are one class, of which the members are counted, so they need no search; a repeated row is a copy, also of itself
* a null vec_id counts as greater than any other and is given back as null (kept is true then if all it reaches have none)
* ties: components depend on links only; an empty table gives an empty result

The codebooks are fitted on at most `SAMPLE` vectors, chosen by a hash; every vector is indexed. The number of code words
grows with the square root of the vectors per label, so that cells keep their size; a cell of over `BLOCK` vectors
is dealt out in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

COSINE = 0.93
SAMPLE, PROBES, ROUNDS = 16_384, 512, 12
#: Sampled vectors with a link, from which the reach of a search is taken; with fewer, it is the triangle bound.
LINKED = 256
#: Vectors per cell to aim at, code words of a half at most, and vectors of a cell that one task holds at once.
PER_CELL, CODES, BLOCK = 4, 1024, 512
#: Share of the sample's links that the traversal must reach, and by how much further it goes than they need.
RECALL, MARGIN = 1.0, 1.2
_LAST = (1 << 63) - 1


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each code word."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ codes.T + (codes**2).sum(1), 0)


def _beyond(d: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the plane between its nearest code word and each other, given its squared distances to all."""
    own = d.argmin(1)
    apart = np.sqrt(_nearest(codes, codes))[own]
    return (np.where(apart > 0, d - d.min(1, keepdims=True), 0) / np.where(apart > 0, 2 * apart, 1)) ** 2


def codebook(x: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; a code word that nothing is near starts again at the vector that is farthest off."""
    start = np.linspace(0, len(x) - 1, min(size, len(x))).astype(int)
    codes = np.unique(x[start], axis=0)
    for _ in range(rounds):
        d = _nearest(x, codes)
        of = d.argmin(1)
        n = np.bincount(of, minlength=len(codes))
        total = np.zeros_like(codes)
        np.add.at(total, of, x)
        far = np.argsort(-d.min(1), kind="stable")[: (n == 0).sum()]
        codes = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], codes)
        codes[np.flatnonzero(n == 0)[: len(far)]] = x[far]
    return codes


@dataclass
class Index:
    """Codebooks of both halves, and how far beyond its nearest cell a search goes (in squared distance).

    With `bound`, the squared distance of partners at most, a search goes to every cell that may hold one. A partner in the
    cell of another code word lies beyond the plane midway between that word and the nearest; the squared distances to
    these planes, one in each half, add up to `bound` at most.
    """

    left: np.ndarray
    right: np.ndarray
    reach: float = 0.0
    bound: float | None = None

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.left.shape[1]
        return _nearest(x[:, :half], self.left), _nearest(x[:, half:], self.right)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.parts(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def visited(self, x: np.ndarray) -> list[np.ndarray]:
        """Cells of each vector's multi-sequence traversal, nearest first, up to `reach` beyond the nearest."""
        a, b = self.parts(x)
        reach = self.reach
        if self.bound is not None:
            a, b, reach = _beyond(a, self.left), _beyond(b, self.right), self.bound + 1e-9
        first, second = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        out = []
        for i in range(len(x)):
            da, db = a[i][first[i]], b[i][second[i]]
            da, db = da - da[0], db - db[0]
            m, n = np.searchsorted(da, reach, side="right"), np.searchsorted(db, reach, side="right")
            total = da[:m, None] + db[None, :n]
            r, c = np.nonzero(total <= reach)
            order = np.argsort(total[r, c], kind="stable")
            out.append(first[i][r[order]] * len(self.right) + second[i][c[order]])
        return out

    def offsets(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How far beyond the nearest cell of each vector the given cell (one for each) is."""
        a, b = self.parts(x)
        at = np.arange(len(x))
        return (a[at, cells // len(self.right)] - a.min(1)) + (b[at, cells % len(self.right)] - b.min(1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def fit(classes: DataFrame, dims: int, cosine: float, recall: float, sample: int = SAMPLE, probes: int = PROBES) -> Index:
    """Codebooks from a bounded sample of the classes of `dims` components; reach from searches of the sample over all of them, or a bound."""
    spark = classes.sparkSession
    own = classes.where(F.col("dims") == dims)
    sample = min(sample, (32 << 20) // (8 * dims) + 1)  # 32 MB of numbers at most come to the driver
    size, whole = own.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    rows = own.orderBy(F.xxhash64("class"), "class").limit(sample).select("label", "class", "vector").collect()
    x = unit(np.array([r.vector for r in rows], np.float64))
    half = dims // 2

    def codebooks(per_cell: int) -> tuple[np.ndarray, np.ndarray]:
        codes = int(np.clip(np.sqrt(size / per_cell), 1, CODES))
        return codebook(x[:, :half], codes) if half else np.zeros((1, 0)), codebook(x[:, half:], codes)

    index = Index(*codebooks(PER_CELL))
    labels, ids = np.array([r.label for r in rows]), np.array([r["class"] for r in rows])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (q, labels, ids) = shared.value
        found, linked = [], np.zeros(len(q), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                y = unit(_matrix(part.column("vector")))
                near = (q @ y.T >= cosine) & (labels[:, None] == part.column("label").to_numpy()) & (ids[:, None] != part.column("class").to_numpy())
                a, b = np.nonzero(near)
                if len(a):
                    linked[a] = True
                    there = index.offsets(q[a], index.cells(y)[b])
                    back = index.offsets(y[b], index.cells(q)[a])
                    found.append(np.minimum(there, back))
        # A sketch of bounded size: offsets by steps, counted.
        steps, n = np.unique(np.ceil(np.concatenate([*found, np.zeros(0)]) * 200).astype(np.int64), return_counts=True)
        # And the probes that have a link, numbered below 0.
        which = -1 - np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((which, steps))), pa.array(np.concatenate((np.ones_like(which), n)))], ["step", "n"])

    begin, steps, linked = 0, {}, 0
    while begin < len(x) and linked < LINKED:
        some = slice(begin, max(probes, 4 * begin))
        shared = spark.sparkContext.broadcast((index, (x[some], labels[some], ids[some])))
        for r in own.select("label", "class", "vector").mapInArrow(measure, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).collect():
            if r.step < 0:
                linked += 1
            else:
                steps[r.step] = steps.get(r.step, 0) + r.n
        shared.unpersist()
        begin = min(some.stop, len(x))
    if linked < LINKED and begin < whole:
        left, right = codebooks(BLOCK)
        return Index(left, right, bound=2 - 2 * cosine)
    total, held = sum(steps.values()), 0
    for step, n in sorted(steps.items()):
        held += n
        index.reach = MARGIN * step / 200
        if held >= recall * total:
            break
    return index


def _vectors(table: DataFrame, vec: str, vector: str, label: str) -> DataFrame:
    """id (null last), vec (the key as it is), label, vector in double precision, or null if it links with nothing."""
    given = F.col(vector).cast("array<double>")
    bad = F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The largest component scales the vector: its square neither vanishes nor overflows.
    top = F.array_max(F.transform(given, F.abs))
    fit_ = F.col(label).isNotNull() & given.isNotNull() & (F.size(given) > 0) & ~bad & (top > 0)
    return table.select(
        F.col(vec).alias("vec"),
        F.coalesce(F.col(vec).cast("long"), F.lit(_LAST)).alias("id"),
        F.col(label).cast("long").alias("label"),
        F.when(fit_, F.transform(given, lambda x: x / top + 0.0)).alias("vector"),
    )


_KEY = ["label", "dims", "cell", "turn", "block"]


def _compare(rows: pa.Table, cosine: float) -> pa.RecordBatch | None:
    """class, root, n: of each class of one block, its group there and how many vectors it is linked with by this block.

    Two classes may ask for each other; then only the one of the lower number counts the pair, for both.
    """
    asks = rows.column("asks").to_numpy()
    q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(q) or not len(m):
        return None
    x = unit(_matrix(rows.column("vector").combine_chunks()))
    ids, times, home = (rows.column(c).to_numpy() for c in ("class", "times", "home"))
    near = (x[q] @ x[m].T >= cosine) & (ids[q][:, None] != ids[m][None, :])
    a, b = np.nonzero(near)
    if not len(a):
        return None
    asked = {(i, c) for i, cells in zip(ids[m].tolist(), rows.column("cells").take(pa.array(m)).to_pylist(), strict=True) for c in cells}
    homes = np.unique(home[q])
    back = np.array([[(i, c) in asked for c in homes.tolist()] for i in ids[m].tolist()])[b, np.searchsorted(homes, home[q][a])]
    once = ~back | (ids[q][a] < ids[m][b])
    a, b = a[once], b[once]
    if not len(a):
        return None
    near = np.zeros(near.shape, bool)
    near[a, b] = True
    most = np.iinfo(np.int64).max
    root_q, root_m = ids[q].copy(), ids[m].copy()
    while True:
        new_m = np.minimum(root_m, np.where(near, root_q[:, None], most).min(0))
        new_q = np.minimum(root_q, np.where(near, new_m[None, :], most).min(1))
        if (new_m == root_m).all() and (new_q == root_q).all():
            break
        root_q, root_m = new_q, new_m
    n = np.concatenate((near @ times[m], near.T @ times[q]))
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids[q], ids[m]))[some]), pa.array(np.concatenate((root_q, root_m))[some]), pa.array(n[some])], ["class", "root", "n"])


def _linked(classes: DataFrame, indexes: dict[int, Index], cosine: float) -> DataFrame:
    """class, root, n: what each block of each visited cell says of its classes, as rows of `_compare`."""
    shared = classes.sparkSession.sparkContext.broadcast(indexes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dims(batch):
                for at in range(0, part.num_rows, BLOCK):
                    some = part.slice(at, BLOCK)
                    x = unit(_matrix(some.column("vector")))
                    index = shared.value[dims]
                    yield some.append_column("home", pa.array(index.cells(x))).append_column("cells", pa.array(index.visited(x), pa.list_(pa.int64())))

    placed = common.stash(classes.mapInArrow(place, "label bigint, dims int, class bigint, times bigint, vector array<double>, home bigint, cells array<bigint>"))
    cell = ["label", "dims", "cell"]
    members, asking = placed.withColumn("cell", F.col("home")), placed.withColumn("cell", F.explode("cells"))
    blocks = lambda name: F.ceil(F.count("*") / BLOCK).cast("int").alias(name)
    sizes = common.stash(members.groupBy(*cell).agg(blocks("blocks")).join(asking.groupBy(*cell).agg(blocks("turns")), cell))
    pick = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["class", "times", "vector", "home", "cells"]
    left = asking.join(sizes, cell).withColumn("turn", pick("turns")).withColumn("block", every("blocks")).select(*_KEY, *columns, F.lit(True).alias("asks"))
    right = members.join(sizes, cell).withColumn("block", pick("blocks")).withColumn("turn", every("turns")).select(*_KEY, *columns, F.lit(False).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if open_:
                table = pa.Table.from_batches(open_)
                keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _KEY], axis=1)
                edge = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1, [len(keys)]))
                for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    if j - i > 1 and (found := _compare(table.slice(i, j - i), cosine)):
                        yield found
                open_.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _KEY], axis=1)
            if last is not None and tuple(keys[0]) != last:
                yield from close()
            other = np.flatnonzero(np.any(keys != keys[-1], axis=1))
            whole = int(other[-1]) + 1 if len(other) else 0  # the last block may go on in the next batch
            if whole:
                open_.append(batch.slice(0, whole))
                yield from close()
            open_.append(batch.slice(whole))
            last = tuple(keys[-1])
        yield from close()

    return left.unionByName(right).repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, "class bigint, root bigint, n bigint")


def link(table: DataFrame, vec: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    vectors = _vectors(table, vec, vector, label).withColumn("class", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    usable = vectors.where("vector is not null")
    classes = common.stash(usable.groupBy("label", "class", "vector").agg(F.count("*").alias("times"), F.min("id").alias("first")))
    classes = classes.select("label", F.size("vector").alias("dims"), "class", "times", "vector", "first")
    dims = [r.dims for r in classes.select("dims").distinct().collect()]  # lengths of vectors, one or a few
    indexes = {d: fit(classes, d, cosine, recall, sample) for d in dims}
    found = common.stash(_linked(classes.drop("first"), indexes, cosine))
    roots = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("class").agg(F.sum("n").alias("others"))
    named = classes.select("class", "times", "first").join(links, "class", "left").join(roots, F.col("class") == F.col("node"), "left")
    named = common.stash(named.select("class", "times", "first", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "class").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("least")).select(F.bitwise_not("root").alias("k"), "least")
    known = named.join(least, F.bitwise_not("root") == F.col("k")).select(F.bitwise_not("class").alias("same"), (F.col("times") - 1 + F.col("others")).alias("n_links"), "least")
    # Rows that link with nothing have no class; a number of their own keeps them apart in the join.
    out = vectors.select("vec", "id", F.coalesce(F.bitwise_not("class"), F.xxhash64("id")).alias("place"), F.col("class").isNotNull().alias("usable"))
    joined = out.join(known, (F.col("place") == F.col("same")) & F.col("usable"), "left")
    least = F.coalesce("least", "id")
    return joined.select(
        F.col("vec").alias(vec),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(least != _LAST, least).alias("component_id"),
        (F.col("id") == least).alias("kept"),
    )
