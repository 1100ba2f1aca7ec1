"""Independent components of recordings in chunks.

A recording that fits in a task is cleaned in one (`signal.clean_ica`). Of a longer one, tasks add up what its covariance and
each step of the fixed-point iteration need, over chunks; the driver holds matrices of channels x channels, of `TOGETHER`
recordings at once, and results are the same but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions import kernels
from voltlake.operators import signal
from voltlake.session import kept
from voltlake.sources import recordings

#: Numbers (samples x channels) of a recording that one task may hold, and long recordings that are iterated together.
WHOLE, TOGETHER = 1 << 26, 64


@dataclass
class State:
    """Of one recording."""

    channels: list[str]
    n: int
    mean: np.ndarray
    white: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    back: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    w: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    done: bool = False
    gone: list[int] = field(default_factory=list)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.white @ (x - self.mean[:, None])


Part = Callable[[State, np.ndarray], list[np.ndarray]]


def _blocks(signals: DataFrame) -> DataFrame:
    """filename, sfreq, n_samples, chunk, start, channels, values: the channels of a chunk side by side."""
    own = F.array_sort(F.collect_list(F.struct("channel", "samples")))
    met = signals.groupBy("filename", "sfreq", "n_samples", "chunk", "start").agg(own.alias("c"))
    return met.select("filename", "sfreq", "n_samples", "chunk", "start", F.transform("c", lambda c: c["channel"]).alias("channels"), F.flatten(F.transform("c", lambda c: c["samples"])).alias("values"))


def _matrix(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.asarray(batch.column("values")[i].values, np.float64).reshape(len(batch.column("channels")[i]), -1)


def _summed(blocks: DataFrame, states: dict[str, State] | None, part: Part) -> dict[str, list[np.ndarray]]:
    """The sum over a recording's blocks of what `part` makes of each; of some recordings, some matrices each."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(states)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, name in enumerate(batch.column("filename").to_pylist()):
                state = shared.value[name] if shared.value else None
                if state and state.channels != batch.column("channels")[i].as_py():
                    raise ValueError(f"{name}: chunks have different channels")
                if state is None or not state.done:
                    flat = np.concatenate([p.reshape(-1) for p in part(state, _matrix(batch, i))])
                    held[name] = held[name] + flat if name in held else flat
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["filename", "v"])

    partial = blocks.select("filename", "channels", "values").mapInArrow(run, "filename string, v array<double>")
    rows = partial.select("filename", F.posexplode("v").alias("at", "x")).groupBy("filename", "at").agg(F.sum("x").alias("x")).collect()
    shared.unpersist()
    sums: dict[str, dict[int, float]] = {}
    for r in rows:
        sums.setdefault(r.filename, {})[r.at] = r.x
    return {name: np.array([v[i] for i in range(len(v))]) for name, v in sums.items()}


def _iterate(blocks: DataFrame, components: int, seed: int, detect: bool, muscles: bool, rounds: int, tolerance: float) -> dict[str, State]:
    heads = {r.filename: r.channels for r in blocks.groupBy("filename").agg(F.min("channels").alias("channels")).collect()}
    first = _summed(blocks, None, lambda _, x: [np.array([x.shape[1]], np.float64), x.sum(axis=1)])
    states = {name: State(heads[name], int(v[0]), v[1:] / v[0]) for name, v in first.items()}
    for s in states.values():
        s.done = min(components, len(s.channels) - 1) < 2 or not detect

    def second(s: State, x: np.ndarray) -> list[np.ndarray]:
        c = x - s.mean[:, None]
        return [c @ c.T]

    for name, v in _summed(blocks, states, second).items():
        s = states[name]
        covariance = v.reshape(len(s.channels), -1) / s.n
        s.white, s.back = kernels.whitener(covariance, min(components, len(s.channels) - 1))
        s.w, s.spread = kernels.ica_start(len(s.white), seed), np.sqrt(np.diag(covariance))
    open_ = {name: s for name, s in states.items() if not s.done}
    for _ in range(rounds):
        if all(s.done for s in open_.values()):
            break
        for name, v in _summed(blocks, states, lambda s, x: list(kernels.ica_moments(s.w, s.whitened(x)))).items():
            s = states[name]
            k = len(s.w)
            s.w, turned = kernels.ica_step(s.w, v[: k * k].reshape(k, k), v[k * k :], s.n)
            s.done = turned < tolerance
    for s in open_.values():
        s.done = False
    above = _summed(blocks, states, lambda s, x: [kernels.power_above(s.w @ s.whitened(x))]) if muscles and open_ else {}
    for name, s in open_.items():
        mixing = s.back @ s.w.T
        correlation = np.where(s.spread > 0, mixing.T / np.where(s.spread > 0, s.spread, 1), 0.0)
        s.gone = kernels.artefacts(s.channels, correlation, above.get(name))
    return states


def clean_long(signals: DataFrame, components: int = 15, detect: bool = True, seed: int = 42, muscles: bool = True, rounds: int = 500, tolerance: float = 1e-5) -> DataFrame:
    """signals in chunks without artefacts, by sums over chunks: for recordings of any length."""
    spark = signals.sparkSession
    blocks = kept(_blocks(signals))
    many = max(1, -(-blocks.select("filename").distinct().count() // TOGETHER))
    out = []
    for b in range(many):
        own = blocks.where(F.pmod(F.xxhash64("filename"), F.lit(many)) == b)
        shared = spark.sparkContext.broadcast(_iterate(own, components, seed, detect, muscles, rounds, tolerance))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for i, name in enumerate(batch.column("filename").to_pylist()):
                    s, x = shared.value[name], _matrix(batch, i)
                    if s.gone:
                        x = x - (s.back @ s.w.T)[:, s.gone] @ (s.w @ s.whitened(x))[s.gone]
                    same = [pa.array([batch.column(c)[i].as_py()] * len(x), batch.column(c).type) for c in ("filename", "sfreq", "n_samples")]
                    place = [pa.array([batch.column(c)[i].as_py()] * len(x), batch.column(c).type) for c in ("chunk", "start")]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*same, pa.array(s.channels), *place, lists], ["filename", "sfreq", "n_samples", "channel", "chunk", "start", "samples"])

        out.append(own.mapInArrow(run, "filename string, sfreq double, n_samples bigint, channel string, chunk bigint, start bigint, samples array<double>"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def clean(signals: DataFrame, most: int = WHOLE, **options) -> DataFrame:  # noqa: ANN003
    """signals in chunks without artefacts: recordings of at most `most` numbers in a task each, longer ones by sums over chunks."""
    sizes = signals.groupBy("filename").agg((F.countDistinct("channel") * F.max("n_samples")).alias("numbers"))
    long = sizes.where(F.col("numbers") > most).select("filename")
    names = ["filename", "sfreq", "n_samples", "channel", "chunk", "start", "samples"]
    short = signals.join(long, "filename", "left_anti")
    out = recordings.chunked(signal.clean_ica(recordings.whole(short), **options)).select(names)
    if long.isEmpty():
        return out
    return out.unionByName(clean_long(signals.join(long, "filename", "left_semi").select(names), **options))
