"""A query for each operator, over the given tables, and the same in DuckDB's SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake import config
from voltlake.operators import align, charts, delta, features, quality, reshape, signal, stats
from voltlake.plans import bindings as b
from voltlake.plans import signal_queries  # noqa: F401  (its queries are registered with the others)
from voltlake.plans.registry import ORACLES, QUERIES, add  # noqa: F401
from voltlake.sources.path import group_of, in_scenarios, path_metadata

_FT = """ft AS (SELECT 'rec' || l_suppkey || '.edf' AS filename, CASE WHEN s_nationkey % 2 = 0 THEN 'ALS' ELSE 'Normal' END AS category,
  'S' || (l_suppkey % 50) AS subject, 'time' || (l_suppkey % 3) AS time, 'scenario' || (1 + (l_suppkey // 50) % 2) AS scenario,
  l_returnflag AS task, l_linestatus AS channel, 'band' || l_linenumber AS subband,
  avg(abs(l_extendedprice / 997)) AS mav, var_pop(l_extendedprice / 997) AS variance, stddev_pop(l_extendedprice / 997) AS std,
  sqrt(avg((l_extendedprice / 997) * (l_extendedprice / 997))) AS rms, avg(l_extendedprice / 997) AS mean, avg((l_extendedprice / 997) * (l_extendedprice / 997)) AS mean_power
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
_SM = """sm0 AS (SELECT user_id AS filename, event_id, event_type AS marker, value / 9.97 AS value, ts,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS time FROM events),
  sm AS (SELECT filename, CAST(sample_idx AS BIGINT) AS sample_idx, time, marker, value, event_id FROM sm0)"""
_AN = """an AS (SELECT filename, row_number() OVER (PARTITION BY filename ORDER BY time, event_id) - 1 AS annot_idx, time AS onset,
    CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 21600.0 END AS duration,
    CASE event_id % 3 WHEN 0 THEN 'Resting' WHEN 1 THEN 'Thinking and Acting' ELSE 'Typing' END AS description FROM sm WHERE marker = 'error'),
  occ AS (SELECT *, CASE description WHEN 'Thinking and Acting' THEN 'Think_Acting' ELSE description END AS task FROM an)"""
_NEAR = """near AS (SELECT filename, annot_idx, sample_idx FROM (SELECT s.filename, annot_idx, sample_idx, row_number() OVER (PARTITION BY s.filename, annot_idx ORDER BY abs(time - onset), sample_idx) AS k
    FROM sm s JOIN an a ON s.filename = a.filename WHERE duration <= 0) WHERE k = 1)"""
_ISL = """isl0 AS (SELECT filename, marker, sample_idx, value, sample_idx - row_number() OVER (PARTITION BY filename, marker ORDER BY sample_idx) AS g FROM sm),
  isl1 AS (SELECT filename, marker AS task, g, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx, count(*) AS n_samples,
    avg(abs(value)) AS mav, var_pop(value) AS variance, stddev_pop(value) AS std FROM isl0 GROUP BY ALL),
  isl AS (SELECT *, row_number() OVER (PARTITION BY filename, task ORDER BY start_idx) AS occurrence FROM isl1)"""
_BAND = "(VALUES " + ", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in config.SUBBANDS.items()) + ") AS bands(subband, low, high)"
_SPEC = f"""x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)),
  spec AS (SELECT vec_id, k * 2.0 AS freq, (pow(sum(x * cos(-2 * pi() * ((k * i) % 64) / 64)), 2) + pow(sum(x * sin(-2 * pi() * ((k * i) % 64) / 64)), 2)) / 64 AS power
    FROM x, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
  band AS (SELECT vec_id, subband, coalesce(avg(power) FILTER (freq BETWEEN low AND high), 0) AS band_power,
    coalesce(sum(power) FILTER (freq BETWEEN low AND high), 0) / sum(power) AS relative_power,
    coalesce(arg_max(freq, {{'p': power, 'f': -freq}}) FILTER (freq BETWEEN low AND high), 0) AS peak_frequency
    FROM spec, {_BAND} GROUP BY vec_id, subband)"""
_DELTA = """d AS (SELECT a.filename, a.channel, a.subband, a.category, a.subject, a.mav AS mav_a, a.variance AS variance_a, a.std AS std_a,
    b.mav AS mav_b, b.variance AS variance_b, b.std AS std_b, a.mav - b.mav AS delta_mav, a.variance - b.variance AS delta_variance, a.std - b.std AS delta_std
    FROM ft a JOIN ft b ON a.filename = b.filename AND a.channel = b.channel AND a.subband = b.subband AND a.category = b.category AND a.subject = b.subject
    WHERE a.task = 'A' AND b.task = 'R')"""
_LONG = "SELECT * FROM (SELECT category, subject, channel, subband, task, mav, variance, std FROM {t}) UNPIVOT (value FOR feature IN (mav, variance, std))"
_CELL = "channel, subband, feature"
_BY = "category, subject, channel, subband, feature"


def _rows(active: str, base: str | None) -> str:
    """Rows of a comparison, out of a table `n` of features."""
    mean = f"SELECT {_BY}, avg(value) AS value FROM ({_LONG.format(t='n')}) WHERE task = '{{}}' GROUP BY ALL"
    if base is None:
        return f"rows AS ({mean.format(active)})"
    return f"rows AS (SELECT {_BY}, x.value - y.value AS value FROM ({mean.format(active)}) x JOIN ({mean.format(base)}) y USING ({_BY}))"


def _z(of: str) -> str:
    z = lambda f: f"({f} - avg({f}) OVER w) / CASE WHEN stddev_samp({f}) OVER w = 0 THEN 1 ELSE stddev_samp({f}) OVER w END AS {f}"
    return f"n AS (SELECT category, subject, channel, subband, task, {z('mav')}, {z('variance')}, {z('std')} FROM {of} WINDOW w AS (PARTITION BY subject))"


_STATS = f"""g AS (SELECT {_CELL}, count(value) FILTER (category = 'ALS') AS n_als, count(value) FILTER (category = 'Normal') AS n_normal,
    avg(value) FILTER (category = 'ALS') AS mean_als, avg(value) FILTER (category = 'Normal') AS mean_normal,
    var_samp(value) FILTER (category = 'ALS') AS va, var_samp(value) FILTER (category = 'Normal') AS vn FROM rows GROUP BY ALL),
  h AS (SELECT *, ((n_als - 1) * va + (n_normal - 1) * vn) / (n_als + n_normal - 2) AS pooled FROM g),
  k AS (SELECT *, rank() OVER (PARTITION BY {_CELL} ORDER BY value) AS r, count(*) OVER (PARTITION BY {_CELL}, value) AS t FROM rows),
  u AS (SELECT {_CELL}, sum(r + (t - 1) / 2) FILTER (category = 'ALS') - count(*) FILTER (category = 'ALS') * (count(*) FILTER (category = 'ALS') + 1) / 2 AS u FROM k GROUP BY ALL),
  st AS (SELECT {_CELL}, n_als, n_normal, mean_als, mean_normal, CASE WHEN n_als >= 2 THEN sqrt(va / n_als) END AS sem_als, CASE WHEN n_normal >= 2 THEN sqrt(vn / n_normal) END AS sem_normal,
    CASE WHEN n_als >= 2 AND n_normal >= 2 THEN (mean_als - mean_normal) / sqrt(pooled * (1.0 / n_als + 1.0 / n_normal)) END AS t,
    CASE WHEN n_als >= 2 AND n_normal >= 2 THEN CASE WHEN pooled > 0 THEN (mean_als - mean_normal) / sqrt(pooled) ELSE 0 END END AS cohend, u FROM h JOIN u USING ({_CELL}))"""


_M = "filename category subject time scenario task channel subband"
_K = "filename channel subband category subject"
_F3 = "mav variance std"
_all = lambda fmt: " ".join(fmt.format(f) for f in _F3.split())
ft, sm, an = b.feature_table, b.samples, b.annotations


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return delta.task_delta(ft(spark, d), "A", "R")


# Features and deltas
add("feature_table", lambda s, d: ft(s, d, ("mav", "variance", "std", "rms", "mean", "mean_power")), [_FT], "SELECT * FROM ft", "mav variance std rms mean mean_power", _M)
add("task_delta", _delta, [_FT, _DELTA], "SELECT * FROM d", f"{_all('{}_a')} {_all('{}_b')} {_all('delta_{}')}", _K)
add(
    "task_delta_agg",
    lambda s, d: delta.delta_summary(_delta(s, d)),
    [_FT, _DELTA],
    "SELECT channel, subband, " + ", ".join(f"avg(delta_{f}) AS mean_delta_{f}, stddev_samp(delta_{f}) AS std_delta_{f}" for f in _F3.split()) + " FROM d GROUP BY ALL",
    f"{_all('mean_delta_{}')} {_all('std_delta_{}')}",
    "channel subband",
)
add(
    "erd_ers",
    lambda s, d: delta.erd_ers(ft(s, d), "A", "mav"),
    [_FT],
    "SELECT t.filename, t.channel, t.subband, t.task, b.mav AS baseline_value, t.mav AS task_value, CASE WHEN b.mav <> 0 THEN 100 * (t.mav - b.mav) / b.mav ELSE 0 END AS erd_ers_pct FROM ft t JOIN ft b USING (filename, channel, subband) WHERE t.task <> 'A' AND b.task = 'A'",
    "baseline_value task_value erd_ers_pct",
    "filename channel subband task",
)
_TR = "tr AS (SELECT category, subject{by}, avg(mav) FILTER (task = 'N') - avg(mav) FILTER (task = 'A') AS delta FROM ft GROUP BY ALL HAVING count(mav) FILTER (task = 'N') > 0 AND count(mav) FILTER (task = 'A') > 0)"
add("subject_transition", lambda s, d: delta.subject_transitions(ft(s, d), "A", "N", "mav").select("category", "subject", "delta"), [_FT, _TR.format(by="")], "SELECT * FROM tr", "delta", "category subject")
_GT = "SELECT category{by}, avg(delta) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(delta) / sqrt(count(*)) END AS sem, count(*) AS n FROM tr GROUP BY ALL"
add("group_transition", lambda s, d: delta.group_transitions(ft(s, d), "A", "N", "mav").drop("deltas"), [_FT, _TR.format(by="")], _GT.format(by=""), "mean sem", "category n")
add(
    "transition_table",
    lambda s, d: delta.transition_table(ft(s, d), "A", "N", "mav", ft(s, d).select("subband").distinct()),
    [_FT, _TR.format(by=", subband"), f"gt AS ({_GT.format(by=', subband')})"],
    "SELECT subband, 'A->N' AS transition, " + ", ".join(f"max(mean) FILTER (category = '{g}') AS {g.lower()}_mean, max(sem) FILTER (category = '{g}') AS {g.lower()}_sem, coalesce(max(n) FILTER (category = '{g}'), 0) AS {g.lower()}_n" for g in config.GROUPS) + " FROM (SELECT DISTINCT subband FROM ft) LEFT JOIN gt USING (subband) GROUP BY subband",
    "als_mean als_sem normal_mean normal_sem",
    "subband transition als_n normal_n",
)
# Comparison of groups
_N = "n AS (SELECT * FROM ft)"
_MODES = {"delta": [_FT, _N, _rows("A", "R")], "zscore": [_FT, "f1 AS (SELECT * FROM ft WHERE task = 'A')", _z("f1"), _rows("A", None)], "both": [_FT, "f2 AS (SELECT * FROM ft WHERE task IN ('A', 'R'))", _z("f2"), _rows("A", "R")]}
for _mode, _ctes in _MODES.items():
    add(f"compare_{_mode}", lambda s, d, m=_mode: stats.compare_rows(ft(s, d), "A", "R", mode=m), _ctes, "SELECT * FROM rows", "value", _BY.replace(",", ""))
_SC = "n_als n_normal mean_als mean_normal sem_als sem_normal t cohend u".split()
add("compare_stats", lambda s, d: stats.group_statistics(stats.compare_rows(ft(s, d), "A", "R")).select(*_CELL.split(", "), *_SC), [*_MODES["delta"], _STATS], "SELECT * FROM st", " ".join(_SC[2:]), "channel subband feature n_als n_normal")
# The labels.
_LABEL = "CASE WHEN cohend IS NULL THEN '–' WHEN abs(cohend) < 0.2 THEN 'Sangat Kecil' WHEN abs(cohend) < 0.5 THEN 'Kecil' WHEN abs(cohend) < 0.8 THEN 'Sedang' ELSE 'Besar' END AS effect"
add("effect_labels", lambda s, d: stats.group_statistics(stats.compare_rows(ft(s, d), "A", "R")).select(*_CELL.split(", "), "effect"), [*_MODES["delta"], _STATS], f"SELECT {_CELL}, {_LABEL} FROM st", "", "channel subband feature effect")
add("compare_stats_wide", lambda s, d: stats.wide(stats.group_statistics(stats.compare_rows(ft(s, d), "A", "R")), ["mean_als", "mean_normal", "cohend"]), [*_MODES["delta"], _STATS], "SELECT channel, subband, " + ", ".join(f"max({c}) FILTER (feature = '{f}') AS {c}_{f}" for f in _F3.split() for c in ("mean_als", "mean_normal", "cohend")) + " FROM st GROUP BY ALL", " ".join(f"{c}_{f}" for f in _F3.split() for c in ("mean_als", "mean_normal", "cohend")), "channel subband")
add("compare_pvalues", lambda s, d: stats.with_pvalues(stats.group_statistics(stats.compare_rows(ft(s, d), "A", "R"))).select(*_CELL.split(", "), "p", "p_t", "p_fdr"))
add(
    "fdr_bh",
    lambda s, d: stats.benjamini_hochberg(ft(s, d).where("task = 'A'").select("filename", "channel", "subband", (F.round("mav", 0) % 97 / 100).alias("p")), "p", ["channel"]),
    [_FT, "p AS (SELECT filename, channel, subband, round(mav, 0) % 97 / 100 AS p FROM ft WHERE task = 'A')", "r AS (SELECT *, p * count(*) OVER (PARTITION BY channel) / max(k) OVER (PARTITION BY channel, p) AS q FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p) AS k FROM p))"],
    "SELECT filename, channel, subband, p, least(1.0, min(q) OVER (PARTITION BY channel ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_fdr FROM r",
    "p p_fdr",
    "filename channel subband",
)
_NORM = {
    "zscore": "({f} - avg({f}) OVER w) / CASE WHEN stddev_samp({f}) OVER w = 0 THEN 1 ELSE stddev_samp({f}) OVER w END AS {f}",
    "minmax": "({f} - min({f}) OVER w) / CASE WHEN max({f}) OVER w = min({f}) OVER w THEN 1 ELSE max({f}) OVER w - min({f}) OVER w END AS {f}",
}
for _name, _method, _scope, _part in (("normalize_zscore", "zscore", "subject", "subject"), ("normalize_minmax", "minmax", "subject", "subject"), ("normalize_subject_scenario", "zscore", "subject_scenario", "subject, scenario")):
    add(_name, lambda s, d, m=_method, c=_scope: stats.normalize(ft(s, d), method=m, scope=c), [_FT], f"SELECT {_M.replace(' ', ', ')}, {', '.join(_NORM[_method].format(f=f) for f in _F3.split())} FROM ft WINDOW w AS (PARTITION BY {_part})", _F3, _M)
# Filters, distinct values, sets
add("filter_chain", lambda s, d: delta.keep(ft(s, d), category=["ALS"], scenario=["scenario1"], time=[], subband=["band1", "band2"], channel=None), [_FT], "SELECT * FROM ft WHERE category = 'ALS' AND scenario = 'scenario1' AND subband IN ('band1', 'band2')", _F3, _M)
add("focus_feature", lambda s, d: reshape.focus(_delta(s, d), "std"), [_FT, _DELTA], "SELECT * FROM d", "std_a std_b delta_std", _K)
add("distinct_values", lambda s, d: reshape.distinct_values(ft(s, d), ["category", "task", "channel", "subband", "scenario"]), [_FT], "SELECT DISTINCT \"column\", value FROM (SELECT category, task, channel, subband, scenario FROM ft) UNPIVOT (value FOR \"column\" IN (category, task, channel, subband, scenario))", "", '"column" value')
add("subject_counts", lambda s, d: reshape.counts(ft(s, d)), [_FT], "SELECT category, count(DISTINCT subject) AS n_subjects, count(DISTINCT filename) AS n_files FROM ft GROUP BY category", "", "category n_subjects n_files")
add("task_union", lambda s, d: reshape.task_union(ft(s, d)), [_FT], "SELECT DISTINCT task FROM ft", "", "task")
add("task_intersect_categories", lambda s, d: reshape.task_intersection(ft(s, d)), [_FT], "SELECT task FROM ft GROUP BY task HAVING count(DISTINCT category) = (SELECT count(DISTINCT category) FROM ft)", "", "task")
# Shapes
_SCN = ["scenario1", "scenario2"]
for _name, _fn, _arg, _keys in (("feature_pivot", reshape.feature_by_scenario, "arg_min", "channel subband subject"), ("feature_grid", reshape.feature_grid, "arg_max", "category channel subband subject")):
    add(_name, lambda s, d, f=_fn: f(ft(s, d).where("task = 'A'"), "mav", _SCN), [_FT], f"SELECT {_keys.replace(' ', ', ')}, " + ", ".join(f"{_arg}(mav, filename) FILTER (scenario = '{x}') AS {x}" for x in _SCN) + " FROM ft WHERE task = 'A' GROUP BY ALL", "scenario1 scenario2", _keys)
_BANDS = [f"band{i}" for i in range(1, 8)]
add("delta_heatmap", lambda s, d: reshape.pivot_mean(_delta(s, d), "channel", "subband", "delta_mav", _BANDS), [_FT, _DELTA], "SELECT channel, " + ", ".join(f"avg(delta_mav) FILTER (subband = '{x}') AS {x}" for x in _BANDS) + " FROM d GROUP BY channel", " ".join(_BANDS), "channel")
add("pivot_subband_channel", lambda s, d: reshape.pivot_mean(ft(s, d), "subband", "channel", "std", ["F", "O"]), [_FT], "SELECT subband, avg(std) FILTER (channel = 'F') AS F, avg(std) FILTER (channel = 'O') AS O FROM ft GROUP BY subband", "F O", "subband")
add("delta_top20_abs", lambda s, d: reshape.top_abs(_delta(s, d), "delta_mav", ["filename", "channel", "subband"]).select("filename", "channel", "subband", "delta_mav"), [_FT, _DELTA], "SELECT * FROM d ORDER BY abs(delta_mav) DESC, filename, channel, subband LIMIT 20", "delta_mav", "filename channel subband")
add("per_file_bars", lambda s, d: charts.per_file_bars(_delta(s, d), "mav"), [_FT, _DELTA], "SELECT replace(filename, '.edf', '') || ' | ' || channel || '_' || subband AS label, delta_mav AS value FROM d ORDER BY abs(delta_mav) DESC, label LIMIT 20", "value", "label")
add("delta_abs_sorted", lambda s, d: charts.delta_bars(delta.delta_summary(_delta(s, d)), "mav"), [_FT, _DELTA], "SELECT channel || ' / ' || subband AS label, avg(delta_mav) AS value FROM d GROUP BY ALL", "value", "label")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    rows = features.long_features(ft(spark, d).drop("category"), ["mav", "variance", "std"])
    rows = rows.groupBy("subject", "time", "task", "channel", "subband", "feature", "scenario").agg(F.avg("value").alias("value"))
    return delta.scenario_pairs(rows.withColumn("time", F.lit("t")).groupBy("subject", "time", "task", "channel", "subband", "feature", "scenario").agg(F.avg("value").alias("value")))


_SP = "lf AS (SELECT subject, time, scenario, task, channel, subband, feature, avg(value) AS value FROM (SELECT * FROM (SELECT subject, time, scenario, task, channel, subband, mav, variance, std FROM ft) UNPIVOT (value FOR feature IN (mav, variance, std))) GROUP BY ALL), lg AS (SELECT subject, 't' AS time, scenario, task, channel, subband, feature, avg(value) AS value FROM lf GROUP BY ALL), sp AS (SELECT subject, time, task, channel, subband, feature, x.value AS sc1, y.value AS sc2, abs(x.value - y.value) AS abs_delta FROM lg x JOIN lg y USING (subject, time, task, channel, subband, feature) WHERE x.scenario = 'scenario1' AND y.scenario = 'scenario2')"
_SD = "SELECT task, channel, subband, feature, abs(var_pop(sc1) - var_pop(sc2)) AS var_delta, abs(stddev_pop(sc1) - stddev_pop(sc2)) AS std_delta, count(*) AS n_samples FROM sp GROUP BY ALL"
add("scenario_paired_abs", _spread, [_FT, _SP], "SELECT * FROM sp", "sc1 sc2 abs_delta", "subject time task channel subband feature")
add("scenario_spread_delta", lambda s, d: delta.scenario_spread(_spread(s, d)), [_FT, _SP], _SD, "var_delta std_delta", "task channel subband feature n_samples", 3)


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    spread = delta.scenario_spread(_spread(spark, d))
    return reshape.align_results({t: spread.where((F.col("task") == t) & (F.col("feature") == "mav")) for t in ("A", "N", "R")}, ["channel", "subband"], "std_delta")


_AL = f"sd AS ({_SD}), al AS (SELECT channel, subband, " + ", ".join(f"max(std_delta) FILTER (task = '{t}') AS {t}" for t in "ANR") + ", avg(std_delta) AS avg FROM sd WHERE feature = 'mav' GROUP BY ALL)"
add("aligned_results", _aligned, [_FT, _SP, _AL], "SELECT * FROM al", "A N R avg", "channel subband")
add("top15_avg_delta", lambda s, d: reshape.top(_aligned(s, d), "avg", ["channel", "subband"], 15).select("channel", "subband", "avg").orderBy("avg", "channel", "subband"), [_FT, _SP, _AL], "SELECT * FROM al ORDER BY avg DESC, channel, subband LIMIT 15", "avg", "channel subband")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").join(b.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "raw").when(F.col("o_orderstatus") == "O", "with_notch").otherwise("no_notch")
    return o.select(F.col("c_mktsegment").alias("group"), F.col("o_orderpriority").alias("channel"), (F.year("o_orderdate")).cast("string").alias("subband"), kind.alias("pipeline"), (F.col("o_totalprice") / 997).alias("value"))


_OR = "lo AS (SELECT c_mktsegment AS \"group\", o_orderpriority AS channel, CAST(year(o_orderdate) AS VARCHAR) AS subband, CASE o_orderstatus WHEN 'F' THEN 'raw' WHEN 'O' THEN 'with_notch' ELSE 'no_notch' END AS pipeline, o_totalprice / 997 AS value FROM orders JOIN customer ON o_custkey = c_custkey)"
add("pipeline_descriptive", lambda s, d: reshape.describe(_orders(s, d), ["pipeline", "group", "channel"]), [_OR], "SELECT pipeline, \"group\", channel, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS count FROM lo GROUP BY ALL", "mean std", 'pipeline "group" channel count')
add("power_drop", lambda s, d: reshape.power_drop(_orders(s, d)), [_OR], "SELECT channel, subband, avg(value) FILTER (pipeline = 'raw') - avg(value) FILTER (pipeline = 'with_notch') AS drop FROM lo GROUP BY ALL", "drop", "channel subband")
add("micro_units", lambda s, d: reshape.micro_units(ft(s, d).select("filename", "task", "channel", "subband", (F.col("mav") * 1e-6).alias("mav"), "std")).withColumnsRenamed({"mav (µ)": "mav_micro", "std (µ)": "std_micro"}), [_FT], "SELECT filename, task, channel, subband, mav AS mav_micro, std FROM ft", "mav_micro std", "filename task channel subband")
add("scatter_enriched", lambda s, d: reshape.enrich(_delta(s, d).select("filename", "channel", "subband", "delta_mav"), ft(s, d), ["category", "subject", "scenario"]), [_FT, _DELTA], "SELECT d.filename, d.channel, d.subband, delta_mav, m.category, m.subject, m.scenario, d.channel || ' / ' || d.subband AS label FROM d LEFT JOIN (SELECT DISTINCT filename, category, subject, scenario FROM ft) m USING (filename)", "delta_mav", "filename channel subband category subject scenario label")
add("grouped_mean", lambda s, d: charts.grouped_mean(ft(s, d), ["category", "task", "channel"], "mav"), [_FT], "SELECT category, task, channel, avg(mav) AS mean FROM ft GROUP BY ALL", "mean", "category task channel")
add(
    "box_stats",
    lambda s, d: charts.box(ft(s, d).select("task", "channel", F.round("mav", 6).alias("mav")), ["task", "channel"], "mav"),
    [_FT, "f AS (SELECT task, channel, round(mav, 6) AS mav FROM ft)", "q AS (SELECT task, channel, quantile_cont(mav, 0.25) AS q1, quantile_cont(mav, 0.5) AS median, quantile_cont(mav, 0.75) AS q3 FROM f GROUP BY ALL)"],
    "SELECT task, channel, q1, median, q3, min(mav) FILTER (mav BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(mav) FILTER (mav BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (NOT mav BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM f JOIN q USING (task, channel) GROUP BY ALL",
    "q1 median q3 low high",
    "task channel outliers",
)
# Samples and annotations
_MK = f"""ins AS (SELECT s.filename, s.sample_idx, a.annot_idx, a.task FROM sm s JOIN occ a ON s.filename = a.filename AND s.time >= a.onset AND s.time < a.onset + a.duration WHERE a.duration > 0
    UNION ALL SELECT n.filename, n.sample_idx, n.annot_idx, o.task FROM near n JOIN occ o ON n.filename = o.filename AND n.annot_idx = o.annot_idx),
  mk AS (SELECT s.filename, s.sample_idx, coalesce(m.task, 'none') AS marker FROM sm s LEFT JOIN (SELECT filename, sample_idx, arg_max(task, annot_idx) AS task FROM ins GROUP BY ALL) m USING (filename, sample_idx))"""
add("marker_interval_join", lambda s, d: align.mark(sm(s, d).drop("marker", "event_id"), an(s, d)).select("filename", "sample_idx", "marker"), [_SM, _AN, _NEAR, _MK], "SELECT * FROM mk", "", "filename sample_idx marker")
add("marker_nearest", lambda s, d: align.nearest_samples(sm(s, d), an(s, d).where("duration <= 0")), [_SM, _AN, _NEAR], "SELECT * FROM near", "", "filename annot_idx sample_idx")
_OC = "oc AS (SELECT filename, annot_idx, task, row_number() OVER (PARTITION BY filename, task ORDER BY annot_idx) AS occurrence, onset, duration FROM occ)"
add("task_list", lambda s, d: align.tasks(an(s, d)), [_SM, _AN], "SELECT DISTINCT filename, task FROM occ", "", "filename task")
add("task_occurrences", lambda s, d: align.occurrences(an(s, d)), [_SM, _AN, _OC], "SELECT * FROM oc", "onset duration", "filename annot_idx task occurrence")
add("occurrence_timeline", lambda s, d: align.timeline(an(s, d)), [_SM, _AN, _OC], "SELECT filename, annot_idx, task || '_' || occurrence AS task_occ, round_even(onset, 2) AS onset, duration FROM oc", "onset duration", "filename annot_idx task_occ")
_OP = "np AS (SELECT *, lead(task) OVER w AS nt, lead(occurrence) OVER w AS no FROM oc WHERE task IN ('Resting', 'Typing') WINDOW w AS (PARTITION BY filename ORDER BY annot_idx))"
for _compat in (False, True):
    add("occurrence_pairs" + "_compat" * _compat, lambda s, d, c=_compat: align.occurrence_pairs(an(s, d), "Resting", "Typing", c), [_SM, _AN, _OC, _OP], f"SELECT DISTINCT filename, CASE WHEN task = 'Resting' THEN occurrence ELSE no END AS occ_a, CASE WHEN task = 'Resting' THEN no ELSE {'no' if _compat else 'occurrence'} END AS occ_b FROM np WHERE task <> nt", "", "filename occ_a occ_b")
add("occurrence_islands", lambda s, d: align.islands(sm(s, d)), [_SM, _ISL], "SELECT * FROM isl", "", "filename task occurrence start_idx end_idx n_samples")
add("task_summary", lambda s, d: align.task_summary(sm(s, d), 128.0), [_SM], "SELECT filename, marker AS task, count(*) AS n_samples, round_even(count(*) / 128.0, 2) AS duration_s, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY filename), 1) AS percent_total FROM sm GROUP BY filename, marker", "duration_s percent_total", "filename task n_samples")
add("annotation_counts", lambda s, d: align.annotation_counts(an(s, d)), [_SM, _AN], "SELECT description, count(*) AS n FROM an GROUP BY description", "", "description n")
add("time_range", lambda s, d: align.time_range(sm(s, d), 1000.0, 200000.0).select("filename", "sample_idx", "value"), [_SM], "SELECT * FROM sm WHERE time BETWEEN 1000 AND 200000", "value", "filename sample_idx")
add("task_lines", lambda s, d: charts.task_lines(sm(s, d), "purchase", 0.0, 500000.0).select("filename", "sample_idx", "value"), [_SM], "SELECT * FROM sm WHERE marker = 'purchase' AND time BETWEEN 0 AND 500000", "value", "filename sample_idx")
add("amplitude_histogram", lambda s, d: charts.histogram(sm(s, d), "marker", "value"), [_SM, "e AS (SELECT marker, min(value) AS lo, max(value) AS hi FROM sm GROUP BY marker)"], "SELECT marker, CASE WHEN hi > lo THEN least(80, CAST(floor((value - lo) * 80 / (hi - lo)) AS INTEGER) + 1) ELSE 1 END AS bin, count(*) AS n FROM sm JOIN e USING (marker) GROUP BY ALL", "", "marker bin n")
_CC = "cc AS (SELECT filename // 10 AS rec, filename % 10 AS channel, sample_idx, value FROM sm)"
_rec = lambda s, d: sm(s, d).select(F.floor(F.col("filename") / 10).alias("rec"), (F.col("filename") % 10).alias("channel"), "sample_idx", "value")
add("channel_correlation", lambda s, d: charts.correlation(_rec(s, d), "rec"), [_SM, _CC], "SELECT rec, CAST(a.channel AS VARCHAR) AS channel_a, CAST(b.channel AS VARCHAR) AS channel_b, corr(a.value, b.value) AS r FROM cc a JOIN cc b USING (rec, sample_idx) GROUP BY ALL", "r", "rec channel_a channel_b")
_BAD = "v AS (SELECT rec AS filename, channel, var_pop(value) AS variance FROM cc GROUP BY ALL), m AS (SELECT filename, median(variance) AS median FROM v GROUP BY filename), o AS (SELECT *, abs(variance - median) AS off FROM v JOIN m USING (filename)), bad AS (SELECT o.filename, channel, variance, median, mad, mad > 0 AND off > 3 * mad AS bad FROM o JOIN (SELECT filename, median(off) AS mad FROM o GROUP BY filename) USING (filename))"
add("bad_channels_mad", lambda s, d: quality.bad_channels(_rec(s, d).withColumnRenamed("rec", "filename")), [_SM, _CC, _BAD], "SELECT * FROM bad", "variance median mad", "filename channel bad", 3)
add("bad_channel_exclude", lambda s, d: quality.exclude_bad_channels(_rec(s, d).withColumnRenamed("rec", "filename").select("filename", "channel").distinct(), quality.bad_channels(_rec(s, d).withColumnRenamed("rec", "filename"))), [_SM, _CC, _BAD], "SELECT filename, channel FROM bad WHERE NOT bad OR filename NOT IN (SELECT filename FROM bad WHERE NOT bad)", "", "filename channel")
# Signals
add("amplitude_clip", lambda s, d: signal.clip_amplitude(b.signals(s, d), 1e5).select("vec_id", F.posexplode("samples").alias("i", "x")), ["x AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"], "SELECT vec_id, i, greatest(least(x, 0.1), -0.1) AS x FROM x", "x", "vec_id i")
_spectrum = lambda s, d: features.spectra(b.signals(s, d), ["vec_id"])
for _name, _column in (("band_power", "band_power"), ("relative_power", "relative_power"), ("peak_frequency", "peak_frequency")):
    add(_name, lambda s, d, c=_column: features.band_table(_spectrum(s, d), ["vec_id"]).select("vec_id", "subband", c), [_SPEC], "SELECT * FROM band", _column, "vec_id subband")
add("native_band_power", lambda s, d: features.band_table(features.native_spectrum(b.signals(s, d), ["vec_id"], 64, b.SFREQ), ["vec_id"]).select("vec_id", "subband", "band_power"), [_SPEC], "SELECT * FROM band", "band_power", "vec_id subband")
_RT = "(VALUES " + ", ".join(f"('{n}', '{x}', '{y}')" for n, x, y in config.RATIOS) + ") AS rt(ratio_name, num, den)"
add("band_ratios", lambda s, d: features.band_ratios(features.band_table(_spectrum(s, d), ["vec_id"]), ["vec_id"]), [_SPEC], f"SELECT n.vec_id, ratio_name, CASE WHEN m.band_power > 0 THEN n.band_power / m.band_power ELSE 0 END AS value FROM {_RT} JOIN band n ON n.subband = num JOIN band m ON m.subband = den AND m.vec_id = n.vec_id", "value", "vec_id ratio_name")
add("long_features", lambda s, d: features.long_features(ft(s, d), _F3.split()), [_FT], f"SELECT * FROM ft UNPIVOT (value FOR feature IN (mav, variance, std))", "value", f"{_M} feature")
_NS = "sg AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ns AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN e[9:32] || e[17:48] WHEN 1 THEN e[5:20] ELSE e END AS piece, CASE vec_id % 3 WHEN 0 THEN 'Resting' WHEN 1 THEN 'Think_Acting' ELSE 'full_recording' END AS task FROM sg)"


def _slices(spark: SparkSession, d: str) -> DataFrame:
    own = b.signals(spark, d).select(F.col("vec_id").alias("filename"), "sfreq", "channel", "samples")
    a = own.select("filename", F.explode(F.expr(
        "CASE filename % 3 WHEN 0 THEN array(named_struct('annot_idx', 0, 'onset', 0.0625D, 'duration', 0.1875D, 'description', 'Resting'), named_struct('annot_idx', 1, 'onset', 0.125D, 'duration', 0.25D, 'description', 'Resting ')) "
        "WHEN 1 THEN array(named_struct('annot_idx', 0, 'onset', 0.03125D, 'duration', 0.125D, 'description', 'Thinking and Acting'), named_struct('annot_idx', 1, 'onset', 0.5D, 'duration', 0D, 'description', 'Resting')) END"
    )).alias("a"))
    rows = align.sliced_segments(own, a.select("filename", "a.*"))
    return rows.select(F.col("filename").alias("vec_id"), "task", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda s, x: s + x * x).alias("energy"))


add("notebook_segments", _slices, [_NS], "SELECT vec_id, task, len(piece) AS n, list_sum(list_transform(piece, lambda x: x * x)) AS energy FROM ns", "energy", "vec_id task n")


# Paths
def _paths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 3 == 0, F.concat(F.lit("ALS"), k % 7)).otherwise(F.concat(F.lit("id"), k % 9)), F.when(k % 2 == 0, "/").otherwise("\\"), F.lit("time"), k % 4, F.lit("/"), F.when(k % 5 > 0, F.concat(F.lit("scenario"), k % 3, F.lit("/"))).otherwise(""), F.lit("EEG.EDF"))
    rows = b.table(spark, d, "supplier").select("s_suppkey", path.alias("path"))
    return rows.withColumns(path_metadata(F.col("path"))).withColumn("grp", group_of(F.col("subject"))).drop("path")


add("path_metadata", _paths, None, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ALS' ELSE 'Normal' END AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'ALS' || (s_suppkey % 7) ELSE 'id' || (s_suppkey % 9) END AS subject, 'time' || (s_suppkey % 4) AS time, CASE WHEN s_suppkey % 5 > 0 THEN 'scenario' || (s_suppkey % 3) ELSE '' END AS scenario, CASE WHEN s_suppkey % 3 = 0 THEN 'ALS' ELSE 'Control' END AS grp FROM supplier", "", "s_suppkey category subject time scenario grp")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 3 == 0, F.concat(F.lit("ALS"), k % 7)).otherwise(F.concat(F.lit("id"), k % 9)), F.lit("/"), F.when(k % 4 > 0, F.concat(F.lit("time"), k % 4)).otherwise("rest"), F.lit("/scenario"), k % 4, F.lit("/"), F.when(k % 11 > 0, "EEG.edf").otherwise("eeg.edf"))
    rows = b.table(spark, d, "supplier").select("s_suppkey", path.alias("path"))
    return rows.where(in_scenarios(F.col("path"), ["scenario1", "scenario2"])).withColumn("grp", group_of(path_metadata(F.col("path"))["subject"])).drop("path")


add("scenario_scan", _scanned, None, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'ALS' ELSE 'Control' END AS grp FROM supplier WHERE s_suppkey % 4 IN (1, 2) AND s_suppkey % 11 > 0", "", "s_suppkey grp")
# Small shapes
add("group_transition_deltas", lambda s, d: delta.group_transitions(ft(s, d), "A", "N", "mav").select("category", F.posexplode("deltas").alias("place", "delta")), [_FT, _TR.format(by="")], "SELECT category, CAST(row_number() OVER (PARTITION BY category ORDER BY subject) - 1 AS INTEGER) AS place, delta FROM tr", "delta", "category place")
add("delta_top20", lambda s, d: reshape.top(_delta(s, d), "delta_mav", ["filename", "channel", "subband"], 20).select("filename", "channel", "subband", "delta_mav"), [_FT, _DELTA], "SELECT * FROM d ORDER BY delta_mav DESC, filename, channel, subband LIMIT 20", "delta_mav", "filename channel subband")
_F6 = "mav variance std rms mean mean_power"
add("delta_of_all_features", lambda s, d: delta.task_delta(ft(s, d, tuple(_F6.split())), "A", "R").select(*_K.split(), *(f"delta_{f}" for f in _F6.split())), [_FT], f"SELECT {', '.join('a.' + k for k in _K.split())}, {', '.join(f'a.{f} - b.{f} AS delta_{f}' for f in _F6.split())} FROM ft a JOIN ft b ON a.filename = b.filename AND a.channel = b.channel AND a.subband = b.subband AND a.category = b.category AND a.subject = b.subject WHERE a.task = 'A' AND b.task = 'R'", " ".join(f"delta_{f}" for f in _F6.split()), _K, 3)
_BARS = "bars AS (SELECT channel, subband, feature, mean_als, mean_normal, (n_als + n_normal) % 20 / 100.0 AS p FROM st)"


def _bars(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.group_statistics(stats.compare_rows(ft(spark, d), "A", "R")).withColumn("p", (F.col("n_als") + F.col("n_normal")) % 20 / 100)
    return rows.select(*_CELL.split(", "), *(c.alias(n) for n, c in charts.significance(F.col("p"), F.col("mean_als"), F.col("mean_normal")).items()))


add("group_bars", _bars, [*_MODES["delta"], _STATS, _BARS], f"SELECT {_CELL}, CASE WHEN p <= 0.05 THEN '★' ELSE printf('p=%.3f', p) END AS mark, 1.15 * greatest(abs(mean_als), abs(mean_normal)) AS height FROM bars", "height", "channel subband feature mark")
add("label_decode", lambda s, d: align.timeline(an(s, d)).select("filename", "annot_idx", *(c.alias(n) for n, c in reshape.decoded(F.col("task_occ")).items())), [_SM, _AN, _OC], "SELECT filename, annot_idx, task, CAST(occurrence AS INTEGER) AS occurrence FROM oc", "", "filename annot_idx task occurrence")
add("first_files", lambda s, d: reshape.first_files(_delta(s, d)).select("filename", reshape.last_part(F.concat(F.lit("a.edf/"), F.col("filename"))).alias("name"), "channel", "subband", "delta_mav"), [_FT, _DELTA], "SELECT filename, replace(filename, '.edf', '') AS name, channel, subband, delta_mav FROM d WHERE filename IN (SELECT DISTINCT filename FROM d ORDER BY filename LIMIT 20)", "delta_mav", "filename name channel subband")
add("descriptive_head", lambda s, d: reshape.head(reshape.describe(_orders(s, d), ["pipeline", "group", "channel"]), ["pipeline"], ["group", "channel"]), [_OR], "SELECT * FROM (SELECT pipeline, \"group\", channel, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS count FROM lo GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pipeline ORDER BY \"group\", channel) <= 5", "mean std", 'pipeline "group" channel count')
_TEXT = "CASE l_linenumber % 4 WHEN 0 THEN 'x' || l_orderkey WHEN 1 THEN ' ' || l_suppkey || ' ' WHEN 2 THEN l_suppkey || 'e-1' ELSE '' END"
add("numeric_coerce", lambda s, d: b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", reshape.to_numeric(F.expr(_TEXT)).alias("number")), None, f"SELECT l_orderkey, l_linenumber, TRY_CAST(trim({_TEXT}) AS DOUBLE) AS number FROM lineitem", "number", "l_orderkey l_linenumber")
add("erd_roles", lambda s, d: delta.erd_ers(ft(s, d), "A", "mav").select("filename", "channel", "subband", "task", reshape.change_role(F.col("erd_ers_pct")).alias("role")), [_FT], "SELECT t.filename, t.channel, t.subband, t.task, CASE WHEN t.mav < b.mav THEN 'ERD' WHEN t.mav > b.mav THEN 'ERS' END AS role FROM ft t JOIN ft b USING (filename, channel, subband) WHERE t.task <> 'A' AND b.task = 'A' AND b.mav > 0", "", "filename channel subband task role")
