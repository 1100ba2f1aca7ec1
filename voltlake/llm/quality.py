"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed words.

One weight vector serves all grades: a text has a score s = w.x, and P(grade > k) = 1 / (1 + exp(t_k - s)) with
thresholds t_0 < t_1 < ... The expected grade and the tail probabilities select documents.

The model is fitted by Spark tasks on at most `SAMPLE` labelled rows, chosen by a hash of the key (a documented
parameter; everything else covers all rows). `score` returns one row per document row: key, `grade` (expected),
`p_tail` (probability of each P(grade > k), k = 0, 1, ...), and `keep`.

* null or empty text: no features, so the score is 0 and the thresholds alone decide
* a row with a null key or null rating trains nothing; repeated labels of a document count once, by their lowest grade; a document row that is repeated counts once in training and is scored each time
* a feature counts once per text, however long
* no labelled rows at all: all weights are 0 and every document is kept
* an empty table gives an empty result; columns of any other name are ignored
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights; 2 ** BITS features.
BITS = 22
#: Labelled rows that train the model, at most.
SAMPLE = 12_000
EPOCHS, RATE, LASSO = 300, 0.05, 3e-4
#: A feature of fewer training rows has no weight.
LEAST_ROWS = 3
#: Bytes of text that are hashed at once: some twenty arrays of as many numbers.
SLICE = 1 << 18
#: A document is kept if it is likelier than this to be above the lowest grade it must pass.
KEEP = 0.5


def words_hashed(raws: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Features, and the text each belongs to.

    Words are what ASCII blanks divide, lower-cased, with marks taken out; the marks of a word are a feature of
    their own, so junk such as '!!' or '|' after each word stands out. Two more are the share (in quarters, from the
    second on) of words that repeat the one before, and of words in capitals.
    """
    given = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    upper = (given >= 65) & (given <= 90)
    text = given | (upper.view(np.uint8) << 5)
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    docs = np.searchsorted(np.cumsum(np.array([len(r) for r in raws], np.int64) + 1), starts, side="right")
    at = np.flatnonzero(~blank)
    offset = at - np.repeat(starts, ends - starts)
    own = text[at]
    kind = ~(((own >= 97) & (own <= 122)) | ((own >= 48) & (own <= 57)) | (own >= 128))
    code = common.mix((own.astype(np.uint64) << np.uint64(32)) ^ offset.astype(np.uint64))
    begin = np.concatenate(([0], np.cumsum(ends - starts)[:-1]))
    letters = common.mix(np.add.reduceat(np.where(kind, np.uint64(0), code), begin))
    marks = common.mix(np.add.reduceat(np.where(kind, common.mix(own.astype(np.uint64) + np.uint64(977)), np.uint64(0)), begin) ^ np.uint64(0xABCDEF))
    has_marks = np.add.reduceat(kind.astype(np.int64), begin) > 0
    again = np.concatenate(([False], (letters[1:] == letters[:-1]) & (docs[1:] == docs[:-1])))
    loud = np.add.reduceat(upper[at].astype(np.int64), begin) > 1
    n = np.maximum(np.bincount(docs, minlength=len(raws)), 1)
    level = [4 * np.bincount(docs[x], minlength=len(raws)) // n for x in (again, loud)]
    some = [np.flatnonzero(x) for x in level]
    shift = np.uint64(64 - bits)
    found = np.concatenate((letters >> shift, marks[has_marks] >> shift, *(common.mix((x[i] + 1000 * (k + 1)).astype(np.uint64)) >> shift for k, (x, i) in enumerate(zip(level, some, strict=True)))))
    return found.astype(np.int64), np.concatenate((docs, docs[has_marks], *some))


def vectors(raws: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """The distinct features of each text. Whether a feature occurs counts, not how often: length alone says nothing."""
    found, of = words_hashed(raws, bits)
    order = np.argsort(of, kind="stable")
    features, ends = found[order], np.searchsorted(of[order], np.arange(len(raws) + 1))
    return [np.unique(features[a:b]).astype(np.int32) for a, b in zip(ends[:-1], ends[1:], strict=True)]


@dataclass
class Model:
    """The features that have a weight (sorted), their weights, and the thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    keep: float = KEEP
    bits: int = BITS

    def tails(self, raws: list[bytes]) -> np.ndarray:
        """P(grade > k) of each text, a column for each k."""
        scores = np.zeros(len(raws))
        if len(self.features):
            found, of = words_hashed(raws, self.bits)
            at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
            known = self.features[at] == found
            once = np.unique(of[known] * len(self.features) + at[known])
            scores = np.bincount(once // len(self.features), self.weights[once % len(self.features)], minlength=len(raws))
        return _sigmoid(scores[:, None] - self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_rows(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, epochs: int = EPOCHS, lasso: float = LASSO, against: bool = True) -> Model:
    """Cumulative-link regression by full-batch gradients with a step per weight (Adam), each followed by a lasso step.

    `against`: a feature can only count against a text. A short text, which has few features of any kind, is then not
    rejected for want of praise.
    """
    rows_with = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=1 << bits)
    rows = [f[rows_with[f] >= LEAST_ROWS] for f in rows]
    used, inverse = np.unique(np.concatenate([*rows, np.zeros(0, np.int32)]), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
    above = grades[:, None] > np.arange(n_grades - 1)
    share = np.clip(above.mean(0) if len(rows) else np.full(n_grades - 1, 0.5), 0.01, 0.99)
    thresholds = np.sort(np.log((1 - share) / share))
    # Each grade weighs the same, so that a rare one is learnt too.
    weight = 1 / np.maximum(np.bincount(grades, minlength=n_grades), 1)[grades] if len(rows) else np.zeros(0)
    weight = weight / max(weight.sum(), 1e-12)
    w = np.zeros(len(used))
    m, v = np.zeros(len(used) + n_grades - 1), np.zeros(len(used) + n_grades - 1)
    for step in range(1, epochs + 1 if len(rows) else 1):
        s = np.bincount(of, w[inverse], minlength=len(rows))
        # The probability of grade g is F(s - t_{g-1}) - F(s - t_g), with F(s - t_{-1}) = 1 and F(s - t_last) = 0.
        tail = np.concatenate((np.ones((len(rows), 1)), _sigmoid(s[:, None] - thresholds), np.zeros((len(rows), 1))), axis=1)
        slope = tail * (1 - tail)
        at = np.arange(len(rows))
        chance = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        to_score = (slope[at, grades] - slope[at, grades + 1]) / chance * weight
        grad_t = np.zeros(n_grades + 1)
        np.add.at(grad_t, grades, -slope[at, grades] / chance * weight)
        np.add.at(grad_t, grades + 1, slope[at, grades + 1] / chance * weight)
        grad_w = np.bincount(inverse, to_score[of], minlength=len(used))
        grad = np.concatenate((grad_w, grad_t[1:-1]))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[: len(used)]
        step_size = RATE * lasso / (np.sqrt(v[: len(used)] / (1 - 0.99**step)) + 1e-8)
        w = np.minimum(w + step_size, 0) if against else np.sign(w) * np.maximum(np.abs(w) - step_size, 0)
        thresholds = np.sort(thresholds + move[len(used) :])
    some = np.flatnonzero(w)
    return Model(used[some].astype(np.int64), w[some], thresholds, bits=bits)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int = 3, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """`grade`: a column over `labels`, 0 the lowest of `n_grades`. The task that trains holds `sample` rows of distinct features."""
    if not sample > 0:
        raise ValueError("the sample needs a size")
    rated = labels.select(F.col(key).alias("key"), grade.cast("int").alias("grade")).where("key is not null and grade is not null")
    rated = rated.groupBy("key").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("key"), "key").limit(sample)  # of fixed size, so it can be broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE):
            of = vectors(common.texts(batch, "text"), bits)
            blob = pa.array([f.tobytes() for f in of], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("grade"), blob], ["key", "grade", "blob"])

    key_type = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(features, f"key {key_type}, grade int, blob binary").dropDuplicates(["key"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.string()), ("grade", pa.int32()), ("blob", pa.binary())])).sort_by("key")
        rows = [np.frombuffer(b, np.int32) for b in table.column("blob").to_pylist()]
        model = fit_rows(rows, np.clip(table.column("grade").to_numpy(), 0, n_grades - 1), n_grades, bits)
        yield pa.RecordBatch.from_pylist([{"at": model.features.tobytes(), "weights": model.weights.tobytes(), "thresholds": model.thresholds.tobytes()}])

    one = made.select(F.col("key").cast("string").alias("key"), "grade", "blob").coalesce(1).mapInArrow(train, "at binary, weights binary, thresholds binary").collect()
    at, weights, thresholds = (np.frombuffer(one[0][c], t) if one else np.zeros(0, t) for c, t in (("at", np.int64), ("weights", np.float64), ("thresholds", np.float64)))
    return Model(at, weights, thresholds if weights.any() else np.full(n_grades - 1, -np.inf), bits=bits)


def _run(model: Model, df: DataFrame, text: str, into, schema) -> DataFrame:  # noqa: ANN001
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text, SLICE):
            yield into(batch, shared.value, shared.value.tails(common.texts(batch, text)))

    return df.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", above: int = 1) -> DataFrame:
    """`above`: the grade that a document must exceed, with a probability of over `model.keep`, to be kept."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def into(batch: pa.RecordBatch, model: Model, tails: np.ndarray) -> pa.RecordBatch:
        p = pa.array(list(tails), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(tails.sum(1)), p, pa.array(tails[:, above] > model.keep)], ["key", "grade", "p_tail", "keep"])

    return _run(model, rows, "text", into, f"key {rows.schema['key'].dataType.simpleString()}, grade double, p_tail array<double>, keep boolean").withColumnRenamed("key", key)


def select(docs: DataFrame, model: Model, text: str = "text", above: int = 1) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def into(batch: pa.RecordBatch, model: Model, tails: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(tails[:, above] > model.keep))

    return _run(model, docs, text, into, docs.schema)


def grade_of_labels() -> Column:
    """Toxic, whatever its quality: 0; else poor: 1, good: 2."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
