"""Hard negatives: rows of another label whose score with an anchor lies within a window below that of the anchor's positives.

Components become whole numbers x = floor(scale * c), and a score is the inner product of two such vectors. Higher scores
come first, ties by smaller key. An anchor's positives are its first `positives` rows of the same label and another key; for
each of them, the first `negatives` rows of another label with low * positive <= 100 * negative <= high * positive are
returned, numbered from 1.

Rows are dealt out by label and hash into partitions of some `TREE` rows, and each is a ball tree: its nodes know their centre,
radius, labels and least key. With |q| the anchor's length, all inner products within a node lie between q . centre - |q| radius
and q . centre + |q| radius. A search for a block of anchors at once goes down to nodes that may matter: not to those whose bounds
miss the window, whose upper bound lies strictly beneath the current last of the anchor's list, or that hold no row of a
label in question. First the positives are searched, in the trees that hold their label; then, of all positives of an anchor
together, the negatives. Anchors are a query set that meets all trees in blocks: they travel through the shuffle, `GROUP` of
them at most with one copy of a tree, and neither they nor the trees come to the driver.

* a null label or vector, an empty vector, a null or non-finite component: the row takes no part
* vectors are compared with those of their own length; no score is defined between others
* rows with equal key, label and x count once; other rows with an anchor's key are not its positives or negatives
* rows with a null key come after all others in ties, are given back as null, and are no anchors
* components are held within +-sqrt(2^63 / (100 * length)), so that scores times 100 fit in a long
* fewer rows than asked for: all of them; no row in the window, or no positive: nothing; an empty table gives an empty result
* the key must be a whole number (else TypeError); labels that aren't are told apart by a 64-bit hash
* columns of any other name are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import common

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Rows of a tree and of its leaves, anchors that meet one copy of a tree, and anchors searched at once.
TREE, LEAF, GROUP, BLOCK = 8192, 256, 16_384, 128
_LAST, _NONE = (1 << 63) - 1, -(1 << 63)


@dataclass
class Lists:
    """Of each query the best `k` (score, key) so far; keys of empty places are the greatest, their scores the least."""

    score: np.ndarray
    key: np.ndarray

    @classmethod
    def empty(cls, n: int, k: int) -> Lists:
        return cls(np.full((n, k), _NONE, np.int64), np.full((n, k), _LAST, np.int64))

    def add(self, query: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        own, k = np.unique(query), self.score.shape[1]
        q = np.concatenate((np.repeat(own, k), query))
        s = np.concatenate((self.score[own].reshape(-1), score))
        i = np.concatenate((self.key[own].reshape(-1), key))
        order = np.lexsort((i, -s.astype(np.float64) if abs(s[s != _NONE]).max(initial=0) < 1 << 52 else ~s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, own)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        kept = rank < k
        at = np.searchsorted(own, q[kept])
        self.score[own[at], rank[kept]], self.key[own[at], rank[kept]] = s[kept], i[kept]


class BallTree:
    """Rows of one vector length, halved until leaves: between labels first, then between two points that are far apart."""

    def __init__(self, keys: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((keys, labels))
        self.keys, self.labels, self.x = keys[order], labels[order], x[order]
        self.most = int(np.abs(x).max(initial=0))
        self.start, self.end, self.left = [], [], []
        self._split(leaf)
        f = self.x.astype(np.float64)
        self.centre = np.array([f[a:b].mean(axis=0) for a, b in zip(self.start, self.end, strict=True)])
        self.radius = np.array([np.sqrt(((f[a:b] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.start, self.end, self.centre, strict=True)])
        spans = list(zip(self.start, self.end, strict=True))
        self.low_label = np.array([self.labels[a:b].min() for a, b in spans])
        self.high_label = np.array([self.labels[a:b].max() for a, b in spans])
        self.least_key = np.array([self.keys[a:b].min() for a, b in spans])
        self.f = f

    def _node(self, a: int, b: int) -> int:
        self.start.append(a)
        self.end.append(b)
        self.left.append(-1)
        return len(self.start) - 1

    def _split(self, leaf: int) -> None:
        todo = [self._node(0, len(self.keys))]
        while todo:
            node = todo.pop()
            a, b = self.start[node], self.end[node]
            if b - a <= leaf:
                continue
            labels = self.labels[a:b]
            edges = np.flatnonzero(labels[1:] != labels[:-1]) + 1
            if len(edges):
                middle = a + int(edges[np.abs(edges - (b - a) / 2).argmin()])
            else:
                y = self.x[a:b].astype(np.float64)
                one = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = y[((y - one) ** 2).sum(axis=1).argmax()]
                order = np.argsort(y @ (other - one), kind="stable")
                for column in (self.keys, self.labels, self.x):
                    column[a:b] = column[a:b][order]
                middle = (a + b) // 2
            self.left[node] = self._node(a, middle)
            todo += [self.left[node], self._node(middle, b)]

    def scores(self, rows: slice, q: np.ndarray) -> np.ndarray:
        """Exact inner products of queries with some rows."""
        if q.shape[1] * self.most * int(np.abs(q).max(initial=0)) < 1 << 53:
            return (q.astype(np.float64) @ self.f[rows].T).astype(np.int64)
        return q @ self.x[rows].T

    def search(self, q: np.ndarray, keys: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> Lists:
        """Of each query the first k rows, of the same or another label, with scores from low to high.

        q, keys, labels: of the anchors; of: each query's anchor.
        """
        found = Lists.empty(len(of), k)
        f = q.astype(np.float64)
        length, middle = np.sqrt((f**2).sum(axis=1)), f @ self.centre.T
        reach = length[:, None] * self.radius
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # rounding
        upper, lower = middle + reach + slack, middle - reach - slack
        own, other = labels[:, None] >= self.low_label, labels[:, None] <= self.high_label
        holds = own & other if same else (self.low_label != labels[:, None]) | (self.high_label != labels[:, None])
        todo = [0]
        while todo:
            node = todo.pop()
            worst, last = found.score[:, -1], found.key[:, -1]
            up = upper[of, node]
            alive = holds[of, node] & (up >= np.maximum(low, worst)) & (lower[of, node] <= high)
            # An upper bound equal to the last score can only bring ties, which a larger key loses.
            alive = np.flatnonzero(alive & ~((up <= worst) & (self.least_key[node] > last)))
            if not len(alive):
                continue
            if self.left[node] >= 0:
                pair = [self.left[node], self.left[node] + 1]
                pair.sort(key=lambda c: float(upper[of[alive], c].sum()))
                todo += pair  # the more promising one is looked at first
                continue
            rows = slice(self.start[node], self.end[node])
            asked, at = np.unique(of[alive], return_inverse=True)
            s = self.scores(rows, q[asked])[at]
            fits = (s >= np.maximum(low, worst)[alive][:, None]) & (s <= high[alive][:, None])
            fits &= (labels[of[alive]][:, None] == self.labels[rows]) == same
            fits &= keys[of[alive]][:, None] != self.keys[rows]
            i, j = np.nonzero(fits)
            if len(i):
                found.add(alive[i], s[i, j], self.keys[rows][j])
        return found


def _rows(table: DataFrame, vec: str, vector: str, label: str, scale: int) -> DataFrame:
    if not isinstance(table.schema[vec].dataType, IntegralType):
        raise TypeError(f"{vec} must be a whole number")
    given = F.col(vector).cast("array<double>")
    whole = F.col(label).isNotNull() & given.isNotNull() & (F.size(given) > 0) & ~F.exists(given, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.floor(F.sqrt(F.lit(9.2e18) / (100 * F.size(given)))).cast("double")
    held = F.transform(given, lambda c: F.greatest(F.least(F.floor(c * scale).cast("double"), most), -most).cast("int"))
    name = F.col(label).cast("long") if isinstance(table.schema[label].dataType, IntegralType) else F.xxhash64(label)
    return table.where(whole).select(F.coalesce(F.col(vec).cast("long"), F.lit(_LAST)).alias("key"), name.alias("label"), held.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


_PLACE = ["tree", "grp"]
_FOUND = "anchor_id bigint, place bigint, positive_id bigint, positive_score bigint, rank int, key bigint, score bigint"


def _searched(members: DataFrame, anchors: DataFrame, groups: int, k: int, low: int, high: int) -> DataFrame:
    """The lists of each anchor in each tree that it is sent to: of its own label if it has no `positives` yet, else of others."""
    first = "positives" not in anchors.columns
    positives = F.lit(None).cast("array<struct<key:bigint,score:bigint,rank:int>>") if first else F.col("positives")
    left = members.select("tree", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(False).alias("asks"), "key", "label", "dims", "x", F.lit(0).cast("long").alias("place"), F.lit(None).cast("array<struct<key:bigint,score:bigint,rank:int>>").alias("positives"))
    right = anchors.select("tree", F.pmod("place", F.lit(groups)).cast("int").alias("grp"), F.lit(True).alias("asks"), "key", "label", "dims", "x", "place", positives.alias("positives"))

    def answers(trees: dict[int, BallTree], block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = block.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            if d not in trees:
                continue
            own = block.filter(pa.array(dims == d))
            q = _matrix(own.column("x"))
            keys, labels, places = (own.column(c).to_numpy() for c in ("key", "label", "place"))
            if first:
                of = np.arange(len(q))
                asked = np.zeros((len(q), 3), np.int64)
                found = trees[d].search(q, keys, labels, of, np.full(len(q), _NONE), np.full(len(q), _LAST), k, True)
            else:
                lists = own.column("positives")
                of = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False))
                each = lists.flatten()
                asked = np.stack([each.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "score", "rank")], axis=1)
                found = trees[d].search(q, keys, labels, of, -((-low * asked[:, 1]) // 100), (high * asked[:, 1]) // 100, k, False)
            i, j = np.nonzero(found.score != _NONE)
            columns = [keys[of[i]], places[of[i]], asked[i, 0], asked[i, 1], asked[i, 2].astype(np.int32), found.key[i, j], found.score[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, trees = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_PLACE, "asks")], axis=1)
            edges = np.concatenate(([0], np.flatnonzero(np.any(kinds[1:] != kinds[:-1], axis=1)) + 1, [len(kinds)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part, at = batch.slice(a, b - a), tuple(kinds[a, :2])
                if at != last:
                    last, held, trees = at, [], None
                if not kinds[a, 2]:
                    held.append(part.select(["key", "label", "dims", "x"]))
                    continue
                if trees is None:
                    trees, rows = {}, pa.Table.from_batches(held)
                    dims = rows.column("dims").to_numpy()
                    for d in np.unique(dims).tolist():
                        own = rows.filter(pa.array(dims == d)).combine_chunks()
                        trees[d] = BallTree(own.column("key").to_numpy(), own.column("label").to_numpy(), _matrix(own.column("x").combine_chunks()))
                    held = []
                for begin in range(0, part.num_rows, BLOCK):
                    yield from answers(trees, part.slice(begin, BLOCK))

    return left.unionByName(right).repartition(*_PLACE).sortWithinPartitions(*_PLACE, "asks").mapInArrow(run, _FOUND)


def mine(
    table: DataFrame,
    anchors: Column | str,
    vec: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `anchors` says by the key, as column `key`, which rows are anchors."""
    rows = _rows(table, vec, vector, label, scale).distinct().withColumn("dims", F.size("x"))
    rows = common.stash(rows)
    count = rows.count()
    near = rows.repartitionByRange(max(1, -(-count // TREE)), "dims", "label", F.xxhash64("key", "x"))
    members = common.stash(near.withColumn("tree", F.spark_partition_id()))
    common.discard(rows)
    asking = members.where(F.col("key") != _LAST).where(anchors).withColumn("place", F.xxhash64("label", "x")).drop("tree")
    groups = max(1, -(-asking.count() // GROUP))

    trees = members.groupBy("dims", "label", "tree").agg(F.count("*").alias("n"))
    sent = asking.join(trees.drop("n"), ["dims", "label"])
    who = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "key")
    best = _searched(members, sent, groups, positives, low, high).withColumn("rank", F.row_number().over(who)).where(F.col("rank") <= positives)
    lists = best.groupBy("anchor_id", "place").agg(F.array_sort(F.collect_list(F.struct("key", "score", "rank"))).alias("positives"))
    known = common.stash(asking.join(lists, (F.col("key") == F.col("anchor_id")) & (asking["place"] == lists["place"])).select("key", "label", "x", "dims", asking["place"], "positives"))

    # Trees of one length stand side by side: lengths are one or a few.
    spans = {r.dims: (r.a, r.b) for r in members.groupBy("dims").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).collect()}
    every = F.explode(F.coalesce(*(F.when(F.col("dims") == d, F.sequence(F.lit(a), F.lit(b))) for d, (a, b) in spans.items()), F.array().cast("array<int>")))
    found = _searched(members, known.withColumn("tree", every), groups, negatives, low, high)
    each = Window.partitionBy("anchor_id", "place", F.col("rank")).orderBy(F.desc("score"), "key")
    found = found.withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= negatives)
    given = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return found.select("anchor_id", given("positive_id").alias("positive_id"), F.col("nth").alias("rank"), given("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
