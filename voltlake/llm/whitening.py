"""Embedding whitening: a two-pass covariance, its eigenvectors, and every vector projected on the leading ones.

`whiten` turns each component c into the whole number x = floor(scale * c). The fit list is each distinct x vector once, so
that copies don't weigh. Its first pass adds x exactly, as whole numbers; the second centres x by the mean and adds outer
products by matrix multiplication in Arrow batches, and tree aggregation merges the partial sums of tasks. LAPACK gives
the eigenvectors of the covariance (divisor n) on the driver: a matrix of dims x dims, whatever the number of rows. A third
pass takes the covariance of what comes out, which says how white it is. The projection is broadcast, of `components`
rows of dims numbers.

Rows: vec, component (from 1, by falling eigenvalue), n (size of the fit list), deviation (sum over dimensions of
(n * x - S)^2, S the sums of the fit list), whitened, explained (eigenvalue / trace), identity_error (the largest absolute
entry of the covariance of `whitened` minus the identity).

* a vector that is null or empty, or holds a null or non-finite component, gives no row
* vectors are whitened among those of their own length, each length with a fit list of its own; there are as many models as lengths
* fewer dimensions than components: a row for each dimension
* a component without variance (an eigenvalue below dims * 2^-52 of the largest) has no scale: whitened is null, explained is 0,
  and identity_error leaves it out (null if none is left); of one distinct vector, that is all of them
* components beyond the range of a long become its nearest end; a deviation beyond it is null
* a null key stays null; repeated rows and keys give their rows as often; columns of any other name are ignored; an empty
  table gives an empty result
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, COMPONENTS = 256, 4
#: Rows of a matrix that a task multiplies at once.
ROWS = 4096
_LOW = np.int64(0xFFFFFFFF)


def _quantised(table: DataFrame, vec: str, vector: str, scale: int) -> DataFrame:
    """vec, x of the rows that count."""
    given = F.col(vector).cast("array<double>")
    whole = given.isNotNull() & (F.size(given) > 0) & ~F.exists(given, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return table.where(whole).select(F.col(vec).alias("vec"), F.transform(given, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (a row each) of every length in a column, at most `ROWS` of them at a time."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        own = np.flatnonzero(sizes == dims)
        for at in range(0, len(own), ROWS):
            some = own[at : at + ROWS]
            yield some, column.take(pa.array(some)).flatten().to_numpy().reshape(len(some), dims)


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of whole numbers by column, as Python's: no sum of halves of 32 bits overflows."""
    low, high = (x & _LOW).sum(axis=0), (x >> np.int64(32)).sum(axis=0)
    return low.astype(object) + high.astype(object) * (1 << 32)


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - sums / n, of which only the last step rounds: whole parts are taken off as whole numbers."""
    whole = [int(s) // n for s in sums]
    rest = np.array([(int(s) - w * n) / n for s, w in zip(sums, whole, strict=True)])
    base = np.array(whole, np.int64)
    near = np.abs(x.astype(np.float64) - base) < 2.0**62
    return np.where(near, (x - base).astype(np.float64), x.astype(np.float64) - base) - rest


def _merged(column: DataFrame, part: object, add: object) -> dict[int, tuple]:
    """Tree aggregation of what `part` makes of each matrix, by number of dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        held: dict[int, tuple] = {}
        for batch in batches:
            for _, x in _matrices(batch.column("x")):
                found = part(x)
                held[x.shape[1]] = add(held[x.shape[1]], found) if x.shape[1] in held else found
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["held"])

    def both(a: dict[int, tuple], b: dict[int, tuple]) -> dict[int, tuple]:
        return a | {d: add(a[d], v) if d in a else v for d, v in b.items()}

    def load(a: dict[int, tuple], row: object) -> dict[int, tuple]:
        import pickle

        return both(a, pickle.loads(row.held))

    partial: RDD = column.mapInArrow(run, "held binary").rdd
    return partial.treeAggregate({}, load, both, depth=2)


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(p + q for p, q in zip(a, b, strict=True))


class Model:
    """Of one length: n, exact sums, the projection to whitened components (a column each), which of them count, and figures."""

    def __init__(self, n: int, sums: np.ndarray, moments: np.ndarray, components: int) -> None:
        dims = len(sums)
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(moments / n)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        self.alive = (values > dims * 2.0**-52 * max(values[0], 0.0)) & (values > 0)
        self.projection = vectors / np.sqrt(np.where(self.alive, values, 1.0))
        trace = float(np.trace(moments)) / n
        self.explained = np.where(self.alive, values / trace if trace > 0 else 0.0, 0.0)
        self.offset = np.zeros(len(values))
        self.error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.sums, self.n) @ self.projection

    def deviation(self, x: np.ndarray) -> list[int | None]:
        n, sums = self.n, [int(s) for s in self.sums]
        reach = max(abs(int(v)) for v in (x.max(), x.min())) * n + max(map(abs, sums))
        if reach * reach * len(sums) < 1 << 63:
            return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = (((n * x.astype(object)) - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length among distinct x vectors."""
    spark = distinct.sparkSession
    firsts = _merged(distinct, lambda x: (len(x), exact_sums(x)), _added)
    if not firsts:
        return {}
    shared = spark.sparkContext.broadcast(firsts)

    def moments(x: np.ndarray) -> tuple:
        n, sums = shared.value[x.shape[1]]
        c = centred(x, sums, n)
        return c.T @ c, c.sum(axis=0)

    seconds = _merged(distinct, moments, _added)
    models = {d: Model(n, sums, seconds[d][0], components) for d, (n, sums) in firsts.items()}
    for d, m in models.items():
        m.offset = seconds[d][1] / m.n @ m.projection
    known = spark.sparkContext.broadcast(models)

    def output(x: np.ndarray) -> tuple:
        m = known.value[x.shape[1]]
        w = m.whitened(x) - m.offset
        return (w.T @ w,)

    for d, (total,) in _merged(distinct, output, _added).items():
        m = models[d]
        off = np.abs(total / m.n - np.eye(len(m.alive)))[np.ix_(m.alive, m.alive)]
        m.error = float(off.max()) if off.size else None
    shared.unpersist()
    known.unpersist()
    return models


def whiten(table: DataFrame, vec: str = "vec_id", vector: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    spark = table.sparkSession
    rows = _quantised(table, vec, vector, scale)
    distinct = common.stash(rows.select("x").distinct())
    models = fit(distinct, components)
    common.discard(distinct)
    shared = spark.sparkContext.broadcast(models)
    kind = rows.schema["vec"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _matrices(batch.column("x")):
                m = shared.value[x.shape[1]]
                k = len(m.alive)
                w = np.where(m.alive, m.whitened(x), np.nan)
                each = pa.array(np.repeat(places, k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec").take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, m.n, np.int64)),
                        pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(w.reshape(-1), from_pandas=True),
                        pa.array(np.tile(m.explained, len(x))),
                        pa.array([m.error] * (len(x) * k), pa.float64()),
                    ],
                    ["vec", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = f"vec {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema).withColumnRenamed("vec", vec)
