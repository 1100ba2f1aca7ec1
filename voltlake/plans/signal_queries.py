"""Queries over signals, and SQL that computes the same from definitions.

Symmetric filters are convolutions with their windowed impulse responses. A recursive filter is convolved with the impulse
response that its sections give one after the other; as no band-pass lets a constant through, steady initial states come to
a signal from which its first sample is taken off. Spectra are sums of cosines and sines.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake import config
from voltlake.functions import kernels
from voltlake.operators import align, charts, chunked, features, signal
from voltlake.plans import bindings as b
from voltlake.plans import recordings as plans
from voltlake.plans.registry import add
from voltlake.sources import recordings, sinks

RATE = b.SFREQ
Bands = dict[str, tuple[float, float]]

# ---- given signals, as (id, i, x)
_X = "x AS (SELECT vec_id AS id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, CAST(unnest(range(64)) AS BIGINT) AS i FROM embeddings))"
_EV = """ev AS (SELECT user_id, event_id, event_type, value / 9.97 AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
  rs AS (SELECT 'u' || user_id AS filename, i, c.channel, c.value AS x FROM (SELECT user_id, i, unnest([{'channel': 'C3', 'value': value}, {'channel': 'C4', 'value': (event_id * 37) % 101 / 10}]) AS c FROM ev))"""
_NOTES = """ra AS (SELECT 'u' || user_id AS filename, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS annot_idx, i / 128.0 + (event_id % 3) * 0.002 AS onset,
    CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 0.125 END AS duration, CASE event_id % 3 WHEN 0 THEN 'Resting' WHEN 1 THEN 'Think_Acting' ELSE 'Typing' END AS task FROM ev WHERE event_type = 'error' AND user_id % 4 <> 0),
  ti AS (SELECT DISTINCT filename, i, i / 128.0 AS t FROM rs),
  cover AS (SELECT ti.filename, i, annot_idx, task FROM ti JOIN ra ON ti.filename = ra.filename AND duration > 0 AND t >= onset AND t < onset + duration
    UNION ALL SELECT filename, i, annot_idx, task FROM (SELECT ti.filename, i, annot_idx, task, row_number() OVER (PARTITION BY ti.filename, annot_idx ORDER BY abs(t - onset), i) AS k FROM ti JOIN ra ON ti.filename = ra.filename WHERE duration <= 0) WHERE k = 1),
  mk AS (SELECT filename, i, coalesce(arg_max(task, annot_idx), 'none') AS task FROM ti LEFT JOIN cover USING (filename, i) GROUP BY ALL),
  gap AS (SELECT *, i - row_number() OVER (PARTITION BY filename, task ORDER BY i) AS g FROM mk),
  run0 AS (SELECT filename, task, g, min(i) AS a, max(i) AS b, count(*) AS n FROM gap GROUP BY ALL),
  run AS (SELECT *, row_number() OVER (PARTITION BY filename, task ORDER BY a) AS occurrence FROM run0)"""


def _convolved(source: str, out: str, taps: int, low: float, high: float, stop: bool = False) -> list[str]:
    """`out` (id, i, x): `source` through a Hamming-windowed filter; ends are turned about their last sample, as far as there are some."""
    e, half, t = out, (taps - 1) // 2, taps - 1
    ideal = "CASE WHEN k = 0 THEN {w} ELSE sin(pi() * {w} * k) / (pi() * k) END".format
    return [
        f"{e}_w AS (SELECT k, ({ideal(w=high)} - {ideal(w=low)}) * (0.54 + 0.46 * cos(2 * pi() * k / {t})) AS h FROM (SELECT CAST(unnest(range({-half}, {half + 1})) AS BIGINT) AS k))",
        f"{e}_s AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE 0 END - h AS h FROM {e}_w)"
        if stop
        else f"{e}_s AS (SELECT k, h FROM {e}_w)",
        f"{e}_h AS (SELECT k, h / (SELECT " + ("sum(h)" if stop else f"sqrt(pow(sum(h * cos(pi() * k * {(low + high) / 2})), 2) + pow(sum(h * sin(pi() * k * {(low + high) / 2})), 2))") + f" FROM {e}_s) AS h FROM {e}_s)",
        f"{e}_n AS (SELECT id, max(i) AS last, arg_min(x, i) AS x0, arg_max(x, i) AS x1 FROM {source} GROUP BY id)",
        f"{e}_e AS (SELECT id, i AS p, x FROM {source} UNION ALL SELECT id, -i, 2 * x0 - x FROM {source} JOIN {e}_n USING (id) WHERE i BETWEEN 1 AND least({half}, last) UNION ALL SELECT id, 2 * last - i, 2 * x1 - x FROM {source} JOIN {e}_n USING (id) WHERE last - i BETWEEN 1 AND least({half}, last))",
        f"{e} AS (SELECT s.id, s.i, sum(h * e.x) AS x FROM {source} s JOIN {e}_e e ON s.id = e.id JOIN {e}_h ON k = e.p - s.i GROUP BY s.id, s.i)",
    ]


def _bandpass(source: str, out: str, low: float, high: float) -> list[str]:
    a, c = min(max(low / 4, 2.0), low), min(max(high / 4, 2.0), RATE / 2 - high)
    return _convolved(source, out, math.ceil(3.3 * RATE / min(a, c)) | 1, 2 * (low - a / 2) / RATE, 2 * (high + c / 2) / RATE)


def _notched(source: str, out: str, freq: float) -> list[str]:
    half = freq / 200 + 0.5
    return _convolved(source, out, math.ceil(3.3 * RATE) | 1, 2 * (freq - half) / RATE, 2 * (freq + half) / RATE, True)


def _filtered(source: str, out: str, bands: Bands, order: int, most: int) -> list[str]:
    """`out` (id, subband, i, x): `source` through zero-phase Butterworth filters; without what is too short. most: samples of an id at most."""
    e, pad = out, 3 * (2 * order + 1)
    rows = []
    for name, (low, high) in bands.items():
        s = kernels.butter_sections(order, max(2 * low / RATE, 0.001), min(2 * high / RATE, 0.999))
        rows.append(f"('{name}', [{', '.join('[' + ', '.join(repr(float(c)) for c in row[[0, 1, 2, 4, 5]]) + ']' for row in s)}])")
    signals = ["CAST(k = -1 AS DOUBLE)"] + [f"y{j}" for j in range(1, order + 1)]
    state = ", ".join(f"z{j}, v{j}" for j in range(1, order + 1))
    # Each section's output and states of the next sample, from the one before it.
    outputs = ", ".join(f"c[{j}][1] * {signals[j - 1]} + z{j} AS y{j}, c[{j}][2] * {signals[j - 1]} - c[{j}][4] * (c[{j}][1] * {signals[j - 1]} + z{j}) + v{j} AS nz{j}, c[{j}][3] * {signals[j - 1]} - c[{j}][5] * (c[{j}][1] * {signals[j - 1]} + z{j}) AS nv{j}" for j in range(1, order + 1))
    zero = ", ".join(f"0.0::DOUBLE AS z{j}, 0.0::DOUBLE AS v{j}" for j in range(1, order + 1))
    after = ", ".join(f"nz{j}, nv{j}" for j in range(1, order + 1))
    return [
        f"{e}_c(subband, c) AS (VALUES {', '.join(rows)})",
        f"{e}_r(subband, c, k, h, {state}) AS (SELECT subband, c, CAST(-1 AS BIGINT), 0.0::DOUBLE, {zero} FROM {e}_c UNION ALL SELECT subband, c, k + 1, y{order}, {after} FROM (SELECT subband, c, k, {outputs} FROM {e}_r WHERE k < {most + 2 * pad}))",
        f"{e}_h AS (SELECT subband, k, h FROM {e}_r WHERE k >= 0)",
        f"{e}_n AS (SELECT id, max(i) AS last, arg_min(x, i) AS x0, arg_max(x, i) AS x1 FROM {source} GROUP BY id HAVING count(*) > {pad})",
        f"{e}_e AS (SELECT id, i + {pad} AS p, x FROM {source} SEMI JOIN {e}_n USING (id) UNION ALL SELECT id, {pad} - i, 2 * x0 - x FROM {source} JOIN {e}_n USING (id) WHERE i BETWEEN 1 AND {pad} UNION ALL SELECT id, 2 * last - i + {pad}, 2 * x1 - x FROM {source} JOIN {e}_n USING (id) WHERE last - i BETWEEN 1 AND {pad})",
        f"{e}_d AS (SELECT id, p, x - first_value(x) OVER (PARTITION BY id ORDER BY p) AS x FROM {e}_e)",
        f"{e}_f AS (SELECT a.id, subband, a.p, sum(h * d.x) AS x FROM {e}_e a JOIN {e}_d d ON a.id = d.id AND d.p <= a.p JOIN {e}_h ON k = a.p - d.p GROUP BY a.id, subband, a.p)",
        f"{e}_g AS (SELECT id, subband, p, x - first_value(x) OVER (PARTITION BY id, subband ORDER BY p DESC) AS x FROM {e}_f)",
        f"{e} AS (SELECT a.id, h.subband, a.p - {pad} AS i, sum(h * g.x) AS x FROM {e}_e a JOIN {e}_g g ON a.id = g.id AND g.p >= a.p JOIN {e}_h h ON h.subband = g.subband AND k = g.p - a.p JOIN {e}_n n ON n.id = a.id WHERE a.p BETWEEN {pad} AND last + {pad} GROUP BY a.id, h.subband, a.p)",
    ]


def _moments(source: str, out: str) -> str:
    return f"{out} AS (SELECT id, subband, avg(abs(x)) AS mav, var_pop(x) AS variance, stddev_pop(x) AS std FROM {source} GROUP BY id, subband)"


def _values(bands: Bands) -> str:
    return "(VALUES " + ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in bands.items()) + ") AS bands(subband, low, high)"


def _spectra(source: str, out: str, bands: Bands) -> list[str]:
    """`out` (id, subband, band_power, relative_power, peak_frequency) of all of `source`; 0 if a signal has fewer than four samples."""
    e = out
    return [
        f"{e}_n AS (SELECT id, count(*) AS n FROM {source} GROUP BY id)",
        f"{e}_p AS (SELECT id, k * {RATE} / n AS freq, (pow(sum(x * cos(-2 * pi() * ((k * i) % n) / n)), 2) + pow(sum(x * sin(-2 * pi() * ((k * i) % n) / n)), 2)) / n AS power FROM {source} JOIN (SELECT id, n, unnest(range(n // 2 + 1)) AS k FROM {e}_n WHERE n > 3) USING (id) GROUP BY id, n, k)",
        f"{e} AS (SELECT id, subband, coalesce(avg(power) FILTER (freq BETWEEN low AND high), 0) AS band_power, coalesce(sum(power) FILTER (freq BETWEEN low AND high), 0) / sum(power) AS relative_power, coalesce(arg_max(freq, {{'p': power, 'f': -freq}}) FILTER (freq BETWEEN low AND high), 0) AS peak_frequency FROM {e}_p, {_values(bands)} GROUP BY id, subband)",
    ]


def _welch(source: str, out: str, size: int = 256, epsilon: float = 0.0, fmax: float = 60.0) -> list[str]:
    """`out` (id, freq, db)."""
    e = out
    window = "(0.54 - 0.46 * CASE WHEN own = 1 THEN -1.0 ELSE cos(2 * pi() * j / (own - 1)) END)"
    return [
        f"{e}_n AS (SELECT id, count(*) AS n, least({size}, count(*)) AS own FROM {source} GROUP BY id)",
        f"{e}_s AS (SELECT id, own, i // own AS seg, i % own AS j, x FROM {source} JOIN {e}_n USING (id) WHERE i < n // own * own)",
        f"{e}_m AS (SELECT id, own, seg, j, (x - avg(x) OVER (PARTITION BY id, seg)) * {window} AS x, sum(pow({window}, 2)) OVER (PARTITION BY id, seg) AS w FROM {e}_s)",
        f"{e}_d AS (SELECT id, seg, k, CASE WHEN k IN (0, {size // 2}) THEN 1 ELSE 2 END * (pow(sum(x * cos(-2 * pi() * ((k * j) % {size}) / {size})), 2) + pow(sum(x * sin(-2 * pi() * ((k * j) % {size}) / {size})), 2)) / ({RATE} * any_value(w)) AS p FROM {e}_m, (SELECT unnest(range({size // 2 + 1})) AS k) WHERE k * {RATE} / {size} <= {fmax} GROUP BY id, seg, k)",
        f"{e} AS (SELECT id, k * {RATE} / {size} AS freq, 10 * log10(avg(p) + {epsilon}) AS db FROM {e}_d GROUP BY id, k)",
    ]


def add_signal(name: str, query, ctes: list[str], select: str, doubles: str, others: str, digits: int = 4) -> None:  # noqa: ANN001
    """With what DuckDB needs to be told of recursion."""
    add(name, query, ctes, select, doubles, others, digits)
    from voltlake.plans.registry import ORACLES

    ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)


_exploded = lambda df: df.select("vec_id", F.posexplode("samples").alias("i", "x"))

# ---- whole signals: each embedding is one
add_signal("bandpass_fir", lambda s, d: _exploded(signal.fir_bandpass(b.signals(s, d), 1.0, 40.0)), [_X, *_bandpass("x", "y", 1.0, 40.0)], "SELECT id AS vec_id, CAST(i AS INTEGER) AS i, x FROM y", "x", "vec_id i", 6)
add_signal("notch", lambda s, d: _exploded(signal.notch(b.signals(s, d), 50.0)), [_X, *_notched("x", "y", 50.0)], "SELECT id AS vec_id, CAST(i AS INTEGER) AS i, x FROM y", "x", "vec_id i", 6)
add_signal("welch_psd", lambda s, d: signal.psd(b.signals(s, d)), [_X, *_welch("x", "w", epsilon=1e-20)], "SELECT 'embeddings' AS filename, CAST(id AS VARCHAR) AS channel, freq, db FROM w", "freq db", "filename channel")
_TREATED = {"raw": "x", "bandpass": "y", "notch_bandpass": "z"}
add_signal(
    "psd_treatments",
    lambda s, d: signal.psd_by_treatment(b.signals(s, d)),
    [_X, *_bandpass("x", "y", 1.0, 40.0), *_notched("x", "n", 50.0), *_bandpass("n", "z", 1.0, 40.0), *(c for t, of in _TREATED.items() for c in _welch(of, f"w_{t}"))],
    " UNION ALL ".join(f"SELECT 'embeddings' AS filename, CAST(id AS VARCHAR) AS channel, freq, db, '{t}' AS treatment FROM w_{t}" for t in _TREATED),
    "freq db",
    "filename channel treatment",
)
add_signal(
    "subband_features",
    lambda s, d: features.subband_features(b.signals(s, d).select("vec_id", "task", "samples", "sfreq")),
    [_X, *_filtered("x", "f", config.SUBBANDS, 5, 64), _moments("f", "m"), *_spectra("x", "p", config.SUBBANDS)],
    "SELECT vec_id, CAST(label AS VARCHAR) AS task, subband, mav, variance, std, band_power, relative_power, peak_frequency, CAST(NULL AS VARCHAR) AS reason FROM m JOIN p USING (id, subband) JOIN embeddings ON vec_id = id",
    "mav variance std band_power relative_power peak_frequency",
    "vec_id task subband reason",
    6,
)


def _long_pipelines(spark: SparkSession, d: str) -> DataFrame:
    own = b.signals(spark, d).select(F.floor(F.col("vec_id") / 2).cast("string").alias("filename"), "sfreq", F.when(F.col("vec_id") % 2 == 0, "C3").otherwise("C4").alias("channel"), "samples")
    none = own.select("filename", F.lit(0).alias("annot_idx"), F.lit(0.0).alias("onset"), F.lit(0.0).alias("duration"), F.lit("x").alias("description")).limit(0)
    return features.pipelines(own, none, ["C3", "C4"], _THREE)


_THREE = {k: config.SUBBANDS[k] for k in ("Theta", "Alpha", "Beta")}
_TREATMENTS = {"with_notch": "z", "no_notch": "y", "raw": "x"}
add_signal(
    "notebook_long_features",
    _long_pipelines,
    [_X, *_bandpass("x", "y", 1.0, 40.0), *_notched("x", "n", 50.0), *_bandpass("n", "z", 1.0, 40.0), *(c for t, of in _TREATMENTS.items() for c in [*_filtered(of, f"f_{t}", _THREE, 4, 64), _moments(f"f_{t}", f"m_{t}")])],
    " UNION ALL ".join(f"SELECT CAST(id // 2 AS VARCHAR) AS filename, 'full_recording' AS task, CASE id % 2 WHEN 0 THEN 'C3' ELSE 'C4' END AS channel, subband, '{t}' AS pipeline, feature, value FROM (SELECT id, subband, variance, std FROM m_{t}) UNPIVOT (value FOR feature IN (variance, std))" for t in _TREATMENTS),
    "value",
    "filename task channel subband pipeline feature",
    6,
)
add("ica_clean", lambda s, d: signal.clean_ica(b.signals(s, d).withColumn("filename", F.floor(F.col("vec_id") / 8).cast("string")).select("filename", "sfreq", "channel", "samples")).select("filename", "channel", F.posexplode("samples").alias("i", "x")), digits=3)

# ---- features of tasks and their occurrences; filters of order 1 are short enough for them
_SHORT = {"order": 1, "subbands": _THREE}
_F = "mav variance std band_power relative_power peak_frequency"


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return align.mark(b.regular_samples(spark, d), b.regular_annotations(spark, d))


def _segmented(seg: str, extra: str = "") -> list[str]:
    """`feat` of `seg` (filename, task[, occurrence], channel, id, i, x): all features, a row for each subband; `reason` for what is too short."""
    return [
        _EV,
        _NOTES,
        seg,
        *_filtered("seg", "f", _THREE, 1, 200),
        _moments("f", "m"),
        *_spectra("seg", "p", _THREE),
        f"keys AS (SELECT filename, task, channel, id, count(*) AS n{extra} FROM seg GROUP BY ALL)",
        "feat AS (SELECT keys.*, subband, mav, variance, std, coalesce(band_power, 0) AS band_power, coalesce(relative_power, 0) AS relative_power, coalesce(peak_frequency, 0) AS peak_frequency, CASE WHEN n <= 9 THEN 'a signal of ' || n || ' samples is too short for an extension of 9' END AS reason "
        f"FROM keys CROSS JOIN {_values(_THREE)} LEFT JOIN m USING (id, subband) LEFT JOIN p USING (id, subband))",
    ]


_TASK = "seg AS (SELECT filename, task, channel, filename || '|' || task || '|' || channel AS id, row_number() OVER (PARTITION BY filename, task, channel ORDER BY i) - 1 AS i, x FROM rs JOIN mk USING (filename, i) WHERE task <> 'none')"
_OCC = "seg AS (SELECT rs.filename, r.task, occurrence, channel, rs.filename || '|' || r.task || occurrence || '|' || channel AS id, i - a AS i, x FROM rs JOIN run r ON rs.filename = r.filename AND i BETWEEN a AND b WHERE r.task <> 'none' AND n >= 4)"
_FIRST = """seg AS (SELECT rs.filename, r.task, channel, rs.filename || '|' || r.task || '|' || channel AS id, i - a AS i, x FROM rs JOIN run r ON rs.filename = r.filename AND i BETWEEN a AND b WHERE r.task <> 'none' AND occurrence = 1 AND n >= 4
    UNION ALL SELECT filename, 'full_recording', channel, filename || '||' || channel, i, x FROM rs WHERE filename NOT IN (SELECT filename FROM run WHERE task <> 'none'))"""
add_signal("task_features", lambda s, d: features.task_features(_marked(s, d), RATE, **_SHORT), _segmented(_TASK), "SELECT * FROM feat", _F, "filename task channel subband reason")
_occurrences = lambda s, d: features.occurrence_features(_marked(s, d), RATE, **_SHORT)
add_signal("occurrence_features", _occurrences, _segmented(_OCC, ", occurrence"), "SELECT *, task || '_' || occurrence AS task_occ FROM feat", _F, "filename task occurrence channel subband reason task_occ")
add_signal("occurrence_agg_features", lambda s, d: features.aggregated_occurrence_features(_occurrences(s, d), _F.split()), _segmented(_OCC, ", occurrence"), "SELECT filename, task, channel, subband, " + ", ".join(f"avg({f}) AS {f}" for f in _F.split()) + " FROM feat GROUP BY ALL", _F, "filename task channel subband")
add_signal("first_occurrence_features", lambda s, d: features.first_occurrence_features(_marked(s, d), RATE, **_SHORT), _segmented(_FIRST), "SELECT * FROM feat", _F, "filename task channel subband reason")
_RATIOS = [("alpha_beta", "Alpha", "Beta"), ("theta_alpha", "Theta", "Alpha")]
_RT = "(VALUES " + ", ".join(f"('{n}', '{x}', '{y}')" for n, x, y in _RATIOS) + ") AS rt(ratio_name, num, den)"
add_signal(
    "task_ratios",
    lambda s, d: features.band_ratios(features.task_features(_marked(s, d), RATE, **_SHORT), ["filename", "task", "channel"], _RATIOS),
    _segmented(_TASK),
    f"SELECT n.filename, n.task, n.channel, ratio_name, CASE WHEN m.band_power > 0 THEN n.band_power / m.band_power ELSE 0 END AS value FROM {_RT} JOIN feat n ON n.subband = num JOIN feat m ON m.subband = den AND m.id = n.id",
    "value",
    "filename task channel ratio_name",
)

# ---- recordings in chunks
_R = "filename, channel, filename || '|' || channel AS id, i, x"
_RX = f"r AS (SELECT {_R} FROM rs), keys AS (SELECT DISTINCT id, filename, channel FROM r), x AS (SELECT id, i, x FROM r)"
_long = lambda df: df.select("filename", "channel", (F.col("start") + F.col("i")).alias("i"), "x")
_samples = lambda df, *more: _long(df.select("filename", "channel", "start", *more, F.posexplode("samples").alias("i", "x")))
_chunks = lambda s, d: recordings.signals(b.chunks(s, d))
def _info(spark: SparkSession, d: str) -> DataFrame:
    own = b.chunks(spark, d)
    rows = recordings.info(recordings.headers_with_channels(own), recordings.annotations(own))
    return rows.select("filename", F.array_join("channels", ",").alias("names"), "n_channels", "sfreq", "duration_s", F.size("annotations").alias("n_annotations"), F.try_element_at("annotations", F.lit(-1))["onset"].alias("last_onset"))


add_signal(
    "recording_info",
    _info,
    [_EV, _NOTES],
    "SELECT filename, string_agg(DISTINCT channel, ',' ORDER BY channel) AS names, CAST(count(DISTINCT channel) AS INTEGER) AS n_channels, CAST(128 AS DOUBLE) AS sfreq, max(i) / 128.0 AS duration_s, CAST(coalesce(any_value(k), 0) AS INTEGER) AS n_annotations, any_value(last_onset) AS last_onset FROM rs LEFT JOIN (SELECT filename, count(*) AS k, arg_max(onset, annot_idx) AS last_onset FROM ra GROUP BY filename) USING (filename) GROUP BY filename",
    "sfreq duration_s last_onset",
    "filename names n_channels n_annotations",
    6,
)
add_signal("long_samples", lambda s, d: recordings.samples(_chunks(s, d)), [_EV], "SELECT filename, i AS sample_idx, i / 128.0 AS time, channel, x AS value FROM rs", "time value", "filename sample_idx channel", 6)
add_signal("marked_samples", lambda s, d: sinks.marked_samples_wide(_marked(s, d), ["C3", "C4"]).withColumnsRenamed({"C3": "c3", "C4": "c4"}), [_EV, _NOTES], "SELECT filename, i AS sample_idx, i / 128.0 AS time, max(x) FILTER (channel = 'C3') AS c3, max(x) FILTER (channel = 'C4') AS c4, any_value(task) AS marker FROM rs JOIN mk USING (filename, i) GROUP BY filename, i", "time c3 c4", "filename sample_idx marker", 6)
add_signal("chunked_bandpass", lambda s, d: _samples(chunked.fir_bandpass(_chunks(s, d), 1.0, 40.0)), [_EV, _RX, *_bandpass("x", "y", 1.0, 40.0)], "SELECT filename, channel, i, x FROM y JOIN keys USING (id)", "x", "filename channel i")
add_signal("chunked_notch", lambda s, d: _samples(chunked.notch(_chunks(s, d), 50.0)), [_EV, _RX, *_notched("x", "y", 50.0)], "SELECT filename, channel, i, x FROM y JOIN keys USING (id)", "x", "filename channel i")
add_signal("chunked_psd", lambda s, d: chunked.psd(_chunks(s, d), size=24), [_EV, _RX, *_welch("x", "w", 24, 1e-20)], "SELECT filename, channel, freq, db FROM w JOIN keys USING (id)", "freq db", "filename channel")


def _whole_pieces(spark: SparkSession, d: str) -> DataFrame:
    own = b.chunks(spark, d)
    return chunked.pieces(recordings.signals(own), recordings.headers(own).select("filename", F.lit("all").alias("task"), F.lit(0).cast("long").alias("start_idx"), "n_samples"))


add_signal("chunked_subband", lambda s, d: _samples(chunked.subband(_whole_pieces(s, d), 8.0, 13.0)), [_EV, _RX, *_filtered("x", "y", {"Alpha": (8.0, 13.0)}, 5, 200)], "SELECT filename, channel, i, x FROM y JOIN keys USING (id)", "x", "filename channel i")
add_signal("chunked_correlation", lambda s, d: charts.chunk_correlation(_chunks(s, d)), [_EV], "SELECT a.filename, a.channel AS channel_a, b.channel AS channel_b, corr(a.x, b.x) AS r FROM rs a JOIN rs b ON a.filename = b.filename AND a.i = b.i GROUP BY ALL", "r", "filename channel_a channel_b")
add_signal("recording_runs", lambda s, d: align.runs(align.disjoint(align.regular_spans(recordings.headers(b.chunks(s, d)), recordings.annotations(b.chunks(s, d))))), [_EV, _NOTES], "SELECT filename, task, occurrence, a AS start_idx, b AS end_idx, n AS n_samples FROM run WHERE task <> 'none'", "", "filename task occurrence start_idx end_idx n_samples")
_META = "CASE WHEN true THEN 'Normal' END AS category, 'unknown' AS subject, '' AS time, '' AS scenario"
add_signal(
    "recording_features",
    lambda s, d: plans.recording_features(b.chunks(s, d), band=(1.0, 40.0), subbands=_THREE, order=1).drop("reason"),
    [_EV, _RX, *_bandpass("x", "y", 1.0, 40.0), "rs0 AS (SELECT filename, channel, i, y.x AS x FROM y JOIN keys USING (id))", _NOTES, _FIRST.replace("FROM rs ", "FROM rs0 rs "), *_filtered("seg", "f", _THREE, 1, 200), _moments("f", "m"), *_spectra("seg", "p", _THREE), "names AS (SELECT DISTINCT id, filename, task, channel FROM seg)"],
    f"SELECT filename, task, channel, subband, true AS bandpass_ok, mav, variance, std, coalesce(band_power, 0) AS band_power, coalesce(relative_power, 0) AS relative_power, coalesce(peak_frequency, 0) AS peak_frequency, {_META} FROM names CROSS JOIN {_values(_THREE)} LEFT JOIN m USING (id, subband) LEFT JOIN p USING (id, subband)",
    _F,
    "filename task channel subband bandpass_ok category subject time scenario",
)
