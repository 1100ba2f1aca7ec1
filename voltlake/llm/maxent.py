"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax.

P(word | history) = P(class | history) P(leaf | class, history) P(word | leaf). The class of the next word follows a softmax,
and so does its leaf within the class, which is factored once more, a choice of two at each branch of the class's tree.
Both have weights for hashed features of the words before, on top of the log-odds that word counts give without any history:
classes for n-grams (the last word, the last two, three) and skips (the second last alone, the third last with the last), branches
for `WITHIN` of these, the last word, the last two and the second last alone. The frequent words and
the end of a text are classes of their own; other words share a class by their last two letters, and a leaf by their hash.
Words of one leaf, a few or one, follow by their counts in training, with one added to each and one for all unknown words
of the leaf, so that the probabilities of the known words and one unknown word per leaf sum to one.

All that depends on the corpus is gathered from all training documents: word counts and their totals by Spark aggregation,
and the weights by tasks that each go through their documents with gradient updates (steps by the gradients seen so far,
as Adagrad takes them). The tables of all tasks are merged by Spark, at most `FAN` at once, each weight as the mean of those that
have been moved, weighed by how far their gradients went. The merged tables have a fixed size (8 MB) and are broadcast.
Which rows a task holds has a small influence on the weights.

`score` reads the key and the text column only and returns one row per document row.

* null or empty text: one token, its end
* training takes the documents of which crc32(key as text) mod `folds` is not `held_out`; a null key is in no fold, so it is scored but trains nothing (`held_out` is false)
* repeated rows train as often as they occur
* no training documents: no word is known, N and V are 0
* a long text is read in one go by the task that holds its row; an empty table gives an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Classes: the end, FREQUENT single words, and those that words share.
CLASSES, FREQUENT = 32, 15
SINGLE = FREQUENT + 1
#: Levels of a shared class's tree: as many as give each word a leaf, but at most these.
MOST_LEVELS = 12
#: Bits of hashed features with a weight for each class, and of hashed pairs of a feature and a branch, at each level.
CLASS_BITS, LEVEL_BITS = 14, 17
#: How many of a token's features, the first ones, have a say within classes.
WITHIN = 3
RATE = 0.08
#: Tokens in one update, and in one task's training at least, so that its tables are small beside its texts.
UPDATE, TASK_TOKENS = 1 << 15, 3_000_000
#: Tokens whose logits a processor's cache holds.
NEAR = 1 << 12
#: What logits may lie apart so that single precision holds their exponentials.
SPREAD = np.float32(80)
#: Numbers in a block of a table, and blocks that are merged at once.
CELLS, FAN = 1 << 14, 64
#: Words in the broadcast part of the vocabulary, and the length in bytes of the longest of them: at most some 5 MB.
SHARED, SHARED_BYTES = 1 << 17, 40
#: Bytes of text of which the words are numbered together, and of which a task adds up the counts before it hands them on.
TOGETHER, COUNTED = 1 << 21, 1 << 24
#: Of word hashes, as Spark has it.
SEED = 42
END = b""
_U = np.uint64


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words, which ASCII blanks divide, and the end, which is the empty word."""
    found = text.lower().split()
    found.append(END)
    return found


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The `tokens` of several texts, one after the other, and how many each text has."""
    # After a blank at the end of a text stands an empty word, which is the text's end.
    words = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t + b" " for t in texts], pa.binary()).view(pa.string())))
    offsets, flat = words.offsets.to_numpy().astype(np.int64), words.values.view(pa.binary())
    first = offsets[:-1]
    # So does one before a blank at its beginning, and that is none.
    led = pc.equal(pc.binary_length(flat.take(pa.array(first))), 0).to_numpy(zero_copy_only=False)
    if led.any():
        keep = np.ones(len(flat), bool)
        keep[first[led]] = False
        flat = flat.filter(pa.array(keep))
    return flat, np.diff(offsets) - led


def _shape(code):  # noqa: ANN001, ANN202
    """Which of the shared classes, from the last two bytes of a word: of numbers, arrays or columns."""
    return code * 40503 % 65521 % (CLASSES - SINGLE)


def _inside(levels: int) -> int:
    """Leaves of the shared classes; those of single words are numbered after them."""
    return (CLASSES - SINGLE) << levels


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64 has it, but unsigned."""
    return xxhash.xxh64_intdigest(word, SEED)


def held_out(key: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _in_training(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("key").isNotNull() & ~F.col("held_out")).select("text")


def count_words(training: DataFrame) -> DataFrame:
    """word (binary) and c, over all rows of `text`. Each task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            added = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")])
            held.clear()
            yield from pa.table({"word": added.column("word"), "c": added.column("c_sum")}).to_batches()

        for batch in common.slices(batches, "text", TOGETHER):
            texts = common.texts(batch, "text")
            found = split(texts)[0].value_counts()
            held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
            size += sum(map(len, texts))
            if size > COUNTED:
                yield from out()
                size = 0
        if held:
            yield from out()

    return training.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Totals, the leaves' totals (those of shared classes, then a leaf for each single word), and the most frequent words."""

    total: int
    distinct: int
    counts: dict[bytes, int]
    own_class: dict[bytes, int]
    leaf_total: np.ndarray
    levels: int

    def leaf_of(self, word: bytes) -> int:
        k = self.own_class.get(word)
        return _inside(self.levels) + k if k is not None else (_shape(int.from_bytes(word[-2:], "big")) << self.levels) + (word_hash(word) >> (64 - self.levels))

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of classes, and at each branch (class, then numbered as in a heap) of the second way, by counts alone."""
        shared = self.leaf_total[: _inside(self.levels)].reshape(CLASSES - SINGLE, -1)
        totals = np.concatenate((self.leaf_total[_inside(self.levels) :], shared.sum(1)))
        branch = np.zeros(shared.shape)
        for level in range(self.levels):
            ways = shared.reshape(len(shared), 1 << level, 2, -1).sum(3)
            branch[:, 1 << level : 2 << level] = np.log(ways[:, :, 1] / ways[:, :, 0])
        return np.log(totals / totals.sum()).astype(np.float32), branch.ravel().astype(np.float32)


def _leaf_column(word: Column, own: dict[bytes, int], levels: int) -> Column:
    """The leaf in SQL, for totals over all words; the same as `Vocabulary.leaf_of`."""
    n = F.length(word)
    byte = lambda i: F.conv(F.hex(F.substring(word, i, 1)), 16, 10).cast("int")
    code = F.when(n > 1, byte(-2) * 256 + byte(-1)).when(n == 1, byte(-1)).otherwise(0).cast("long")
    leaf = F.shiftleft(_shape(code), levels) + F.shiftrightunsigned(F.xxhash64(word), 64 - levels)
    for w, k in own.items():
        leaf = F.when(word == F.lit(bytearray(w)), _inside(levels) + k).otherwise(leaf)
    return leaf


def learn_vocabulary(words: DataFrame, shared: int = SHARED) -> Vocabulary:
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # Frequencies in logarithmic bins, a few hundred at most; the highest bins that hold up to `shared` words are shared.
    bins = words.where(F.length("word") <= SHARED_BYTES).withColumn("bin", F.floor(F.log2("c") * 8))
    cut, held = 0, 0
    for r in sorted(bins.groupBy("bin").agg(F.count("*").alias("n")).collect(), key=lambda r: -r.bin):
        held += r.n
        if held > shared:
            cut = r.bin + 1
            break
    counts = {bytes(r.word): r.c for r in bins.where(F.col("bin") >= cut).select("word", "c").collect()}
    own = {END: 0}
    for w in sorted(counts, key=lambda w: (-counts[w], w)):
        if len(own) == SINGLE:
            break
        own.setdefault(w, len(own))
    levels = int(np.clip(np.log2(max(totals.v, 1) / (CLASSES - SINGLE)), 1, MOST_LEVELS))
    leaf_total = np.ones(_inside(levels) + SINGLE)
    # A row for each leaf at most.
    for r in words.groupBy(_leaf_column(F.col("word"), own, levels).alias("leaf")).agg(F.sum(F.col("c") + 1).alias("t")).collect():
        leaf_total[r.leaf] += r.t
    return Vocabulary(totals.n, totals.v, counts, own, leaf_total, levels)


class Lexicon:
    """Arrays by a word's number, of the distinct words that were numbered last."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._shared = pa.array(list(vocabulary.counts), pa.binary())
        # The last one is of all other words.
        self._counts = np.array([*vocabulary.counts.values(), 0], np.int64)
        self._own = pa.array(list(vocabulary.own_class), pa.binary())

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """The numbers of all tokens of several texts, one after the other."""
        return self.number(pa.array(list(chain.from_iterable(texts)), pa.binary()))

    def number(self, tokens: pa.Array) -> np.ndarray:
        """The numbers of tokens; the arrays are of their distinct words from now on."""
        levels, digest = self.vocabulary.levels, xxhash.xxh64_intdigest
        found = tokens.dictionary_encode()
        self.words = found.dictionary
        words = self.words.to_numpy(zero_copy_only=False).tolist()
        self.hash = np.array([digest(w, SEED) for w in words], np.uint64)
        ends = np.frombuffer(b"".join([w[-2:].rjust(2, b"\0") for w in words]), ">u2").astype(np.int64)
        own = pc.index_in(self.words, value_set=self._own).fill_null(-1).to_numpy()
        self.leaf = np.where(own < 0, (_shape(ends) << levels) + (self.hash >> _U(64 - levels)).view(np.int64), _inside(levels) + own)
        self.known = self._counts[pc.index_in(self.words, value_set=self._shared).fill_null(-1).to_numpy()]
        self.log_count = np.log10(self.known + 1.0)
        return found.indices.to_numpy().astype(np.int64)


def features(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Of each token of texts of `sizes` tokens, hashes of its five features; before a text's first token stand ends."""
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two, three = (np.where(place >= i, np.concatenate((np.zeros(i, np.uint64), hashes))[: len(hashes)], _U(word_hash(END))) for i in (1, 2, 3))
    gram = common.mix(two * _U(0x9E3779B97F4A7C15) + one)
    far = three * _U(0xC2B2AE3D27D4EB4F)
    # The last word, the last two, and the second last alone; the last three, and the third last with the last.
    return [common.mix(one + _U(1)), common.mix(gram + _U(2)), common.mix(two + _U(4)), common.mix(far ^ (gram + _U(3))), common.mix(far + one + _U(5))]


_BRANCH = common.mix(np.arange((CLASSES - SINGLE) << MOST_LEVELS, dtype=np.uint64) + _U(1))


@dataclass
class Weights:
    """`to_class`: feature x class; `to_branch`: level x the hash of a feature and a branch; and what counts say without them."""

    to_class: np.ndarray
    to_branch: np.ndarray
    classes: np.ndarray
    branches: np.ndarray

    def class_odds(self, found: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Of NEAR tokens at a time, given their features: the odds of each class, a row for each token, and their sums."""
        one = np.ones(CLASSES, np.float32)
        for at in range(0, len(found[0]), NEAR):
            near = slice(at, at + NEAR)
            logits = np.take(self.to_class, _class_cell(found[0][near]), axis=0)
            for f in found[1:]:
                logits += np.take(self.to_class, _class_cell(f[near]), axis=0)
            logits += self.classes
            top = logits.max()
            if top - logits.min() > SPREAD:
                top = logits.max(axis=1, keepdims=True)
            logits -= top
            # Numbers too small for single precision would slow all sums down.
            np.maximum(logits, -SPREAD, out=logits)
            odds = np.exp(logits, out=logits)
            yield near, odds, odds @ one

    def branch_logits(self, found: list[np.ndarray], leaf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """At each level of the way to each token's leaf: the log-odds of the second way, whether that is taken (1 or 0), and the cells of the weights."""
        levels = len(self.to_branch)
        k, path = leaf >> levels << levels, leaf & ((1 << levels) - 1)
        for level in range(levels):
            at = path >> (levels - level)
            at += k
            at += 1 << level
            own, logit = np.take(_BRANCH, at), np.take(self.branches, at)
            cells = []
            for f in found:
                mixed = f ^ own
                mixed *= _U(0xD6E8FEB86659FD93)
                mixed >>= _U(64 - LEVEL_BITS)
                cells.append(mixed.view(np.int64))
                logit += np.take(self.to_branch[level], cells[-1])
            yield level, logit, (path >> (levels - 1 - level) & 1).astype(np.float32), cells

    def log_leaves(self, found: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
        """log P(leaf | history) of each token."""
        shared, k = _classes(leaf, len(self.to_branch))
        out = np.empty(len(leaf))
        for near, odds, total in self.class_odds(found):
            out[near] = np.log(odds[np.arange(len(odds)), k[near]] / total)
        against = np.ones(len(shared))
        for _, logit, second, _ in self.branch_logits([f[shared] for f in found[:WITHIN]], leaf[shared]):
            # Of the way that isn't taken.
            logit *= 1 - 2 * second
            np.exp(np.minimum(logit, np.float32(50), out=logit), out=logit)
            logit += 1
            against *= logit
        out[shared] -= np.log(against)
        return out


def _class_cell(feature: np.ndarray) -> np.ndarray:
    return (feature >> _U(64 - CLASS_BITS)).view(np.int64)


def _classes(leaf: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Where leaves are those of shared classes, and the class of each leaf."""
    shared = np.flatnonzero(leaf < _inside(levels))
    k = leaf - _inside(levels)
    k[shared] = SINGLE + (leaf[shared] >> levels)
    return shared, k


def _step(weights: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
    """Moves weights along a gradient, by the squares of those seen so far; all in place."""
    size = gradient * gradient
    seen += size
    np.sqrt(np.add(seen, np.float32(1e-6), out=size), out=size)
    gradient *= np.float32(RATE)
    gradient /= size
    weights += gradient


class Trainer:
    """Weights on their way, and the sums of their squared gradients."""

    def __init__(self, weights: Weights):
        self.w = Weights(weights.to_class.copy(), weights.to_branch.copy(), weights.classes, weights.branches)
        self.seen_class, self.seen_branch = np.zeros(weights.to_class.shape, np.float32), np.zeros(weights.to_branch.shape, np.float32)

    def update(self, found: list[np.ndarray], leaf: np.ndarray) -> None:
        """One step by the gradient of the likelihood of these tokens."""
        shared, k = _classes(leaf, len(self.w.to_branch))
        off = np.empty((CLASSES, len(leaf)), np.float32)
        for near, odds, total in self.w.class_odds(found):
            odds /= -total[:, None]
            odds[np.arange(len(odds)), k[near]] += 1
            off[:, near] = odds.T
        # A class at a time: its part of the table stays near.
        cells = [_class_cell(f) for f in found]
        gradient = np.zeros((CLASSES, 1 << CLASS_BITS), np.float32)
        for of, weights in zip(gradient, off, strict=True):
            for c in cells:
                np.add.at(of, c, weights)
        _step(self.w.to_class, self.seen_class, np.ascontiguousarray(gradient.T))
        found = [f[shared] for f in found[:WITHIN]]
        for level, logit, second, cells in self.w.branch_logits(found, leaf[shared]):
            np.exp(np.minimum(np.negative(logit, out=logit), SPREAD, out=logit), out=logit)
            logit += 1
            step = (second - 1 / logit).astype(np.float64)
            gradient = np.bincount(np.concatenate(cells), np.tile(step, len(cells)), minlength=1 << LEVEL_BITS).astype(np.float32)
            _step(self.w.to_branch[level], self.seen_branch[level], gradient)

    def blocks(self) -> pa.RecordBatch:
        """Both tables in blocks: each weight, and how far its gradients went, in half precision."""
        w = np.concatenate((self.w.to_class.ravel(), self.w.to_branch.ravel())).astype(np.float16)
        moved = np.minimum(np.sqrt(np.concatenate((self.seen_class.ravel(), self.seen_branch.ravel()))), 6e4).astype(np.float16)
        n = len(w) // CELLS
        cut = lambda x: pa.array([b.tobytes() for b in x.reshape(n, CELLS)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), cut(w), cut(moved)], ["block", "w", "moved"])


def _merged(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks of `parts` tasks (numbered by `part`) as one each."""

    def mean(rows: pa.Table) -> pa.Table:
        total, weighed, of = np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32), np.zeros(CELLS, np.float32)
        for w, moved in zip(rows.column("w"), rows.column("moved"), strict=True):
            m = np.frombuffer(moved.as_buffer(), np.float16).astype(np.float32)
            total += m
            of += m**2
            weighed += m * np.frombuffer(w.as_buffer(), np.float16)
        w = (weighed / np.maximum(total, 1e-9)).astype(np.float16)
        return pa.table({"block": rows.column("block").slice(0, 1), "part": rows.column("part").slice(0, 1), "w": [w.tobytes()], "moved": [np.minimum(np.sqrt(of), 6e4).astype(np.float16).tobytes()]})

    while parts > 1:
        parts = -(-parts // FAN)
        blocks = blocks.withColumn("part", F.col("part") % parts).groupBy("block", "part").applyInArrow(mean, "block int, part int, w binary, moved binary")
    return blocks


def _numbered(texts: list[bytes], lexicon: Lexicon) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """features, leaves, word numbers, and the sizes of texts, all of them in one go."""
    words, sizes = split(texts)
    numbers = lexicon.number(words)
    return features(lexicon.hash[numbers], sizes), lexicon.leaf[numbers], numbers, sizes


def train(training: DataFrame, vocabulary: Vocabulary, epochs: int = 1) -> Weights:
    """Weights after `epochs` rounds of gradient updates by all tasks, each round from the merged weights of the one before."""
    spark = training.sparkSession
    weights = Weights(np.zeros((1 << CLASS_BITS, CLASSES), np.float32), np.zeros((vocabulary.levels, 1 << LEVEL_BITS), np.float32), *vocabulary.priors())
    if not vocabulary.total:
        return weights
    parts = int(np.clip(vocabulary.total // TASK_TOKENS, 1, training.rdd.getNumPartitions()))
    for _ in range(epochs):
        shared = spark.sparkContext.broadcast((vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, weights = shared.value
            lexicon, trainer = Lexicon(vocabulary), Trainer(weights)
            for batch in common.slices(batches, "text", TOGETHER):
                found, leaf, _, _ = _numbered(common.texts(batch, "text"), lexicon)
                for at in range(0, len(leaf), UPDATE):
                    trainer.update([f[at : at + UPDATE] for f in found], leaf[at : at + UPDATE])
            yield trainer.blocks()

        # As many rows as the tables have blocks, of fixed size.
        of = training.coalesce(parts).mapInArrow(run, "block int, w binary, moved binary").withColumn("part", F.spark_partition_id())
        rows = sorted(_merged(of, parts).select("block", "w").collect())
        table = np.frombuffer(b"".join(bytes(r.w) for r in rows), np.float16).astype(np.float32)
        shared.unpersist()
        weights = Weights(table[: CLASSES << CLASS_BITS].reshape(-1, CLASSES), table[CLASSES << CLASS_BITS :].reshape(vocabulary.levels, -1), weights.classes, weights.branches)
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", shared: int = SHARED, epochs: int = 1) -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10 probability)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    words = common.stash(count_words(_in_training(rows)))
    vocabulary = learn_vocabulary(words, shared)
    model = spark.sparkContext.broadcast((vocabulary, train(_in_training(rows), vocabulary, epochs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's sums over shared words, and its other words with their frequency."""
        vocabulary, weights = model.value
        lexicon = Lexicon(vocabulary)
        log_total = np.log10(vocabulary.leaf_total)
        for batch in common.slices(batches, "text", TOGETHER):
            found, leaf, numbers, sizes = _numbered(common.texts(batch, "text"), lexicon)
            logs = np.concatenate([weights.log_leaves([f[at : at + UPDATE] for f in found], leaf[at : at + UPDATE]) for at in range(0, len(leaf), UPDATE)])
            c = lexicon.known[numbers]
            starts = np.cumsum(sizes) - sizes
            add = lambda x: np.add.reduceat(x, starts)
            missing = np.flatnonzero(c == 0)
            of = np.repeat(np.arange(len(sizes)), sizes)[missing]
            each, times = np.unique(of << 32 | numbers[missing], return_counts=True)
            others = pa.StructArray.from_arrays([lexicon.words.take(pa.array(each & 0xFFFFFFFF)), pa.array(times.astype(np.int64))], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("held_out"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(add((c > 0).astype(np.int64))),
                    pa.array(add(lexicon.log_count[numbers])),
                    pa.array(add(logs / np.log(10) - log_total[leaf])),
                    pa.ListArray.from_arrays(pa.array(np.searchsorted(each >> 32, np.arange(len(sizes) + 1)).astype(np.int32)), others),
                ],
                ["key", "held_out", "n_tokens", "n_known", "log_counts", "log_leaves", "others"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, log_leaves double, others array<struct<word:binary,times:bigint>>"
    sums = common.stash(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    other = sums.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    found = other.join(words, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_counts"))
    n, v = vocabulary.total, vocabulary.distinct
    log_counts = F.col("log_counts") + F.coalesce("more_counts", F.lit(0.0))
    return sums.drop("others").join(found, "row", "left").select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (log_counts + F.col("log_leaves")).alias("score"),
    )
