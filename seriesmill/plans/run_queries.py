"""Queries for scans (A), report pairing (F), learning and evaluation (P), motion (H), planning (J), logs (K) and streams (L)."""

from __future__ import annotations

import functools
import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import is_finite
from seriesmill.operators import evaluate as V
from seriesmill.operators import motion as H
from seriesmill.operators import planning as J
from seriesmill.operators import prefs as P
from seriesmill.operators import runlogs as K
from seriesmill.plans import registry, text_queries
from seriesmill.plans import roles as R
from seriesmill.plans.registry import query
from seriesmill.sources import commits, io
from seriesmill.sources.files import delete_tree, write_files
from seriesmill.sources.shared import shared_dir, stored


def r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# ---------------------------------------------------------------- P: evaluation, the flagship

_EVAL = f"""WITH {R.CANDIDATES}, ch AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY candidate_id) AS quality_rank FROM (SELECT series_id * 100 + CAST(floor((start_time + 1200) / 365) AS BIGINT) AS run_id, candidate_id, quality_score AS quality, nucleus_start, nucleus_end, start_time, end_time FROM cand))
, choice AS (SELECT run_id, start_time + 3 AS chosen_start, start_time + 33 AS chosen_end FROM ch WHERE quality_rank = 2)
, rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY quality DESC, quality_rank) AS rank FROM ch)
, ds AS (SELECT rk.run_id, rank, greatest(chosen_start - (nucleus_start + nucleus_end) / 2, (nucleus_start + nucleus_end) / 2 - chosen_end, 0.0) AS d FROM rk JOIN choice USING (run_id))
, ev AS (SELECT run_id, min(rank) FILTER (d <= 2.0) AS matched_rank, arg_min(rank, (d, rank)) AS closest_rank, min(d) AS closest_distance, count(*) AS selected FROM ds GROUP BY run_id)"""


def _champions(spark, d):
    """A customer's orders of a year as the champions of a run; the customer is the track."""
    from pyspark.sql import Window

    run = (F.col("series_id") * 100 + F.floor((F.col("start_time") + 1200) / 365)).cast("long")
    c = R.candidates(spark, d).withColumn("run_id", run)
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("candidate_id"))
    return c.select("run_id", F.col("quality_score").alias("quality"), rank.alias("quality_rank"), "nucleus_start", "nucleus_end", "start_time")


def _evaluation(spark, d):
    ch = _champions(spark, d)
    choice = ch.where("quality_rank = 2").select("run_id", (F.col("start_time") + 3).alias("chosen_start"), (F.col("start_time") + 33).alias("chosen_end"))
    return V.evaluate_ranking(ch, choice)


@query("p11_evaluate_ranking", _EVAL + " SELECT run_id, matched_rank, closest_rank, round(closest_distance, 6) AS closest_distance FROM ev")
def p11(spark, d):
    return _evaluation(spark, d).select("run_id", "matched_rank", "closest_rank", r6("closest_distance"))


@query("p12_first_per_track", _EVAL + " SELECT run_id // 100 AS track, min(run_id) AS run_id FROM ev GROUP BY 1")
def p12(spark, d):
    return V.first_per_track(_evaluation(spark, d).withColumn("track", F.floor(F.col("run_id") / 100)), "track", "run_id").select("track", "run_id")


@query(
    "p13_ranking_metrics",
    _EVAL + """, lab AS (SELECT run_id // 100 AS track, run_id FROM ch GROUP BY run_id), f AS (SELECT ev.* FROM ev JOIN (SELECT min(run_id) AS run_id FROM ev GROUP BY run_id // 100) USING (run_id))
, n AS (SELECT (SELECT count(*) FROM lab) AS labelled, (SELECT count(*) FROM ev) AS evaluated)
SELECT count(*) AS tracks, round(avg(CASE WHEN matched_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN matched_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3, round(avg(CASE WHEN matched_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(CASE WHEN matched_rank IS NULL THEN 0.0 ELSE 1.0 / matched_rank END), 6) AS mrr, round(quantile_cont(closest_distance, 0.5), 6) AS median_distance,
 round(avg(selected), 6) AS mean_selected, any_value(labelled) AS labelled, any_value(evaluated) AS evaluated, any_value(evaluated) - count(*) AS duplicate, any_value(labelled) - any_value(evaluated) AS skipped FROM f, n""",
)
def p13(spark, d):
    track = F.floor(F.col("run_id") / 100).alias("track")
    labelled = _champions(spark, d).select("run_id", track).distinct()  # runs with a single order have no choice and are skipped
    m = V.ranking_metrics(labelled, _evaluation(spark, d))
    return m.select("tracks", *[r6(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "median_distance", "mean_selected")], "labelled", "evaluated", "duplicate", "skipped")


_REPORTS = "SELECT o_orderkey AS run_id, o_orderkey % 3 AS schema_version, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS algorithm, o_orderdate AS generated_at, 'v/' || CAST(o_custkey AS VARCHAR) AS video FROM orders"


@query("f1_pair_reports", f"WITH a AS ({_REPORTS}), b AS (SELECT run_id, schema_version, CASE WHEN run_id % 7 = 0 THEN 'other' ELSE algorithm END AS algorithm, generated_at, CASE WHEN run_id % 11 = 0 THEN video || 'x' ELSE video END AS video FROM a) SELECT a.run_id, CASE WHEN a.algorithm IS NULL OR b.algorithm IS NULL THEN 'missing algorithm' WHEN a.algorithm <> b.algorithm THEN 'mismatch algorithm' WHEN a.video <> b.video THEN 'mismatch video' END AS mismatch FROM a JOIN b USING (run_id)")
def f1(spark, d):
    a = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 3).alias("schema_version"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("algorithm"), F.col("o_orderdate").alias("generated_at"), F.concat(F.lit("v/"), F.col("o_custkey").cast("string")).alias("video"))
    b = a.withColumn("algorithm", F.when(F.col("run_id") % 7 == 0, "other").otherwise(F.col("algorithm"))).withColumn("video", F.when(F.col("run_id") % 11 == 0, F.concat("video", F.lit("x"))).otherwise(F.col("video")))
    return V.pair_reports(a, b, ["schema_version", "algorithm", "generated_at"], "video")


# ---------------------------------------------------------------- P: learning


_HISTORY = """WITH r AS (SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 9 <> 0 THEN o_custkey % 50 END AS track_id, o_orderkey % 13 <> 0 AS valid_json, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 END AS chosen_index, n AS n_selections FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)
SELECT run_id, CASE WHEN track_id IS NULL THEN 'missing_track' WHEN track_id = 7 THEN 'current_track' WHEN NOT valid_json THEN 'invalid_json' WHEN chosen_index IS NULL THEN 'ambiguous_choice' WHEN n_selections < 2 OR chosen_index >= n_selections THEN 'invalid_selections' END AS skip_reason FROM r"""


def _diagnosed(spark, d):
    n = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("n_selections"))
    o, k = R.table(spark, d, "orders"), F.col("o_orderkey")
    r = o.select(k.alias("run_id"), F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey") % 50).alias("track_id"), (k % 13 != 0).alias("valid_json"), F.when(k % 4 != 0, k % 5).alias("chosen_index")).join(n, "run_id", "left")
    return P.history_diagnostics(r, F.lit(7)).select("run_id", "skip_reason")


@query("p1_history_diagnostics", _HISTORY)
def p1(spark, d):
    return _diagnosed(spark, d)


_BAD = "CASE WHEN l_partkey % 97 = 0 THEN 'NaN'::DOUBLE WHEN l_partkey % 89 = 0 THEN NULL ELSE l_discount END"


def _breakdown(spark, d):
    s = R.selections(spark, d)
    bad = F.when(F.col("l_partkey") % 97 == 0, float("nan")).when(F.col("l_partkey") % 89 == 0, F.lit(None).cast("double")).otherwise(F.col("l_discount"))
    return s.withColumn("breakdown", F.create_map(F.lit("quantity"), F.col("l_quantity"), F.lit("discount"), bad))


@query("p2_strict_features", f"WITH {R.SELECTIONS}, x AS (SELECT *, {_BAD} AS f FROM sel), y AS (SELECT *, min(CASE WHEN isfinite(f) THEN 1 ELSE 0 END) OVER (PARTITION BY report) AS ok FROM x) SELECT report, item, l_quantity AS f1, f AS f2, l_partkey FROM y WHERE ok = 1".replace("isfinite(f)", "coalesce(isfinite(f), false)"))
def p2(spark, d):
    return P.strict_features(_breakdown(spark, d), "breakdown", ["quantity", "discount"], ["report"]).select("report", "item", F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), "l_partkey")


@query("p2_permissive_features", f"WITH {R.SELECTIONS} SELECT report, item, l_partkey, CASE WHEN coalesce(isfinite({_BAD}), false) THEN {_BAD} ELSE 'NaN'::DOUBLE END AS f FROM sel")
def p2p(spark, d):
    return P.permissive_features(_breakdown(spark, d), "breakdown", ["discount"]).select("report", "item", "l_partkey", F.col("features")[0].alias("f"))


_Z = ", z AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w > 1e-8 THEN stddev_pop({c}) OVER w ELSE 1.0 END AS z{i}" for i, c in enumerate(R.FEATURES)) + " FROM sel WINDOW w AS (PARTITION BY report))"
_ZC = [f"z_{c}" for c in R.FEATURES]


@query("p3_znorm_group", f"WITH {R.SELECTIONS}{_Z} SELECT report, item, l_partkey, " + ", ".join(f"round(z{i}, 6) AS z_{c}" for i, c in enumerate(R.FEATURES)) + " FROM z")
def p3(spark, d):
    return P.znorm_group(R.selections(spark, d), R.FEATURES, ["report"]).select("report", "item", "l_partkey", *[r6(c) for c in _ZC])


_PAIRS = _Z + ", one AS (SELECT *, sum(CAST(chosen AS INT)) OVER (PARTITION BY report) AS k FROM z), pairs AS (SELECT b.report, b.track, b.item, b.l_partkey, " + ", ".join(f"a.z{i} - b.z{i} AS d{i}" for i in range(4)) + " FROM one a JOIN one b ON a.report = b.report AND a.k = 1 AND a.chosen AND NOT b.chosen WHERE sqrt(" + " + ".join(f"(a.z{i} - b.z{i}) * (a.z{i} - b.z{i})" for i in range(4)) + ") > 1e-12)"
_DC = [f"d_{c}" for c in _ZC]


def _pairs(spark, d):
    z = P.znorm_group(R.selections(spark, d), R.FEATURES, ["report"]).withColumn("item_key", F.struct("item", "l_partkey", "l_suppkey"))
    x = P.pairwise_differences(z, ["report"], "item_key", "chosen", _ZC)
    return x.withColumn("track", F.pmod("report", F.lit(20))).withColumn("item", F.col("item_key.item")).withColumn("l_partkey", F.col("item_key.l_partkey"))


@query("p4_pairwise_differences", f"WITH {R.SELECTIONS}{_PAIRS} SELECT report, item, l_partkey, " + ", ".join(f"round(d{i}, 6) AS d{i}" for i in range(4)) + " FROM pairs")
def p4(spark, d):
    return _pairs(spark, d).select("report", "item", "l_partkey", *[r6(c, f"d{i}") for i, c in enumerate(_DC)])


@query("p5_dedupe_pairs", f"WITH {R.SELECTIONS}{_PAIRS} SELECT track, count(*) AS pairs FROM (SELECT DISTINCT track, " + ", ".join(f"round(d{i}, 1) AS r{i}" for i in range(2)) + " FROM pairs) GROUP BY track")
def p5(spark, d):
    return P.dedupe_pairs(_pairs(spark, d), "track", _DC[:2], ["report", "item", "l_partkey"], 1).groupBy("track").agg(F.count(F.lit(1)).alias("pairs"))


_ROUNDED = ", ".join(f"round(d{i}, 1) AS r{i}" for i in range(2))


@query("p5_duplicate_counts", f"WITH {R.SELECTIONS}{_PAIRS} SELECT track, count(*) AS pairs, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT track, {_ROUNDED}, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY track")
def p5c(spark, d):
    return P.duplicate_pairs(_pairs(spark, d), "track", _DC[:2], 1)


_REASONS = ("missing_track", "current_track", "invalid_json", "ambiguous_choice", "invalid_selections")


@query("p1_history_counts", f"WITH {R.SELECTIONS}{_PAIRS}, h AS ({_HISTORY}), dup AS (SELECT CAST(sum(n - 1) AS BIGINT) AS x FROM (SELECT track, {_ROUNDED}, count(*) AS n FROM pairs GROUP BY ALL)) SELECT count(*) AS found, count(*) FILTER (skip_reason IS NULL) AS used, " + ", ".join(f"count(*) FILTER (skip_reason = '{r}') AS {r}" for r in _REASONS) + ", (SELECT x FROM dup) AS duplicate_pairs FROM h")
def p1c(spark, d):
    return P.diagnostics_counts(_diagnosed(spark, d), P.duplicate_pairs(_pairs(spark, d), "track", _DC[:2], 1))


def _solved(source: str, k: int = 4) -> str:
    """SQL of the weights w0.. of ridge systems (g_i_j, b_i) in source, by elimination, a step of columns at a time."""
    columns = lambda step: [f"a{i}_{j}_{step}" for i in range(k) for j in range(k + 1)]
    first = ", ".join([f"g_{min(i, j)}_{max(i, j)}" + (" + 4.0" if i == j else "") + f" AS a{i}_{j}_0" for i in range(k) for j in range(k)] + [f"b_{i} AS a{i}_{k}_0" for i in range(k)])
    out = f"(SELECT track, {first} FROM {source})"
    for p in range(k):
        cell = lambda i, j: f"a{i}_{j}_{p} - a{i}_{p}_{p} * a{p}_{j}_{p} / a{p}_{p}_{p}" if i != p else f"a{p}_{j}_{p} / a{p}_{p}_{p}"  # noqa: B023, E731
        out = f"(SELECT track, {', '.join(f'{cell(i, j)} AS a{i}_{j}_{p + 1}' for i in range(k) for j in range(k + 1))} FROM {out})"
    return f"(SELECT track, {', '.join(f'a{i}_{k}_{k} AS w{i}' for i in range(k))} FROM {out})"


_GRAM = [f"g_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"b_{i}" for i in range(4)]
_SUMS = ", sums AS (SELECT track, " + ", ".join([f"avg(d{i} * d{j}) AS g_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"avg(d{i}) AS b_{i}" for i in range(4)]) + " FROM pairs GROUP BY track), total AS (SELECT 0 AS track, " + ", ".join(f"sum({c}) AS {c}" for c in _GRAM) + " FROM sums)"
_LOGO = _SUMS + ", without AS (SELECT s.track, " + ", ".join(f"t.{c} - s.{c} AS {c}" for c in _GRAM) + f" FROM sums s, total t), solved AS {_solved('without')}, judged AS (SELECT track, count(*) AS n, sum(CASE WHEN abs(m) <= 1e-12 THEN 0.5 WHEN m > 0 THEN 1.0 ELSE 0.0 END) AS correct FROM (SELECT track, d0 * w0 + d1 * w1 + d2 * w2 + d3 * w3 AS m FROM pairs JOIN solved USING (track)) GROUP BY track)"


@query("p6_fit_pairwise_ridge", f"WITH {R.SELECTIONS}{_PAIRS}{_SUMS}, solved AS {_solved('total')} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(w{i}, 6) AS weight FROM solved" for i, c in enumerate(_DC)))
def p6(spark, d):
    return P.fit_pairwise_ridge(_pairs(spark, d), "track", _DC).select("feature", r6("weight"))


@query("p7_leave_one_group_out", f"WITH {R.SELECTIONS}{_PAIRS}{_LOGO} SELECT track, n, CAST(correct AS DOUBLE) AS correct FROM judged")
def p7(spark, d):
    return P.leave_one_group_out(_pairs(spark, d), "track", _DC)


@query("p8_gate_model", f"WITH {R.SELECTIONS}{_PAIRS}{_LOGO}, m AS (SELECT count(*) AS tracks, CAST(sum(n) AS BIGINT) AS pairs, sum(correct) / sum(n) AS accuracy FROM judged) SELECT tracks, pairs, round(CAST(accuracy AS DOUBLE), 6) AS accuracy, CASE WHEN tracks < 10 THEN 'too_few_tracks' WHEN accuracy <= 0.55 THEN 'accuracy_too_low' END AS reason, tracks >= 10 AND accuracy > 0.55 AS enabled FROM m")
def p8(spark, d):
    return P.gate_model(P.leave_one_group_out(_pairs(spark, d), "track", _DC)).select("tracks", "pairs", r6("accuracy"), "reason", "enabled")


@query("p9_score_preference", f"WITH {R.SELECTIONS}, f AS (SELECT report, item, l_partkey, l_quantity AS a, {_BAD} AS b0 FROM sel), g AS (SELECT *, CASE WHEN coalesce(isfinite(b0), false) THEN b0 END AS b1 FROM f), m AS (SELECT report, quantile_cont(b1, 0.5) AS med FROM g GROUP BY report), h AS (SELECT g.*, coalesce(b1, med, 0.0) AS b FROM g JOIN m USING (report)), u AS (SELECT report, item, l_partkey, 0.7 * (a - avg(a) OVER w) / CASE WHEN stddev_pop(a) OVER w > 1e-8 THEN stddev_pop(a) OVER w ELSE 1.0 END - 0.4 * (b - avg(b) OVER w) / CASE WHEN stddev_pop(b) OVER w > 1e-8 THEN stddev_pop(b) OVER w ELSE 1.0 END AS u FROM h WINDOW w AS (PARTITION BY report)) SELECT report, item, l_partkey, round(1 / (1 + exp(-greatest(-40.0, least(40.0, u)))), 6) AS preference FROM u")
def p9(spark, d):
    x = _breakdown(spark, d).withColumn("a", F.col("l_quantity")).withColumn("b", F.col("breakdown")["discount"])
    return P.score_preference(x, ["report"], {"a": 0.7, "b": -0.4}).select("report", "item", "l_partkey", r6("preference"))


@query("p9_score_disabled", f"WITH {R.SELECTIONS} SELECT report, item, l_partkey, CAST(0.5 AS DOUBLE) AS preference FROM sel")
def p9d(spark, d):
    return P.score_preference(R.selections(spark, d), ["report"], {"l_quantity": 0.7}, enabled=False).select("report", "item", "l_partkey", "preference")


@query("p10_history_fingerprint", f"WITH {R.SELECTIONS}, k AS (SELECT track, sha256(CAST(report AS VARCHAR) || ':' || CAST(item AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)) AS h FROM sel), p AS (SELECT track, h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM k GROUP BY ALL) SELECT track, sha256(string_agg(p || h, '' ORDER BY p)) AS fingerprint FROM p GROUP BY track")
def p10(spark, d):
    key = F.concat_ws(":", F.col("report").cast("string"), F.col("item").cast("string"), F.col("l_partkey").cast("string"))
    return P.history_fingerprint(R.selections(spark, d), "track", key)


_ONCE = ", once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, " + ", ".join(f"round(d{i}, 8)" for i in range(4)) + " ORDER BY report, item, l_partkey, l_suppkey) AS n FROM pairs) WHERE n = 1)"
_MODEL = _PAIRS.replace("b.l_partkey, ", "b.l_partkey, b.l_suppkey, ", 1) + _ONCE + _LOGO.replace("FROM pairs", "FROM once") + f", fitted AS {_solved('total')}, gate AS (SELECT count(*) >= 10 AND sum(correct) / sum(n) > 0.3 AS enabled FROM judged), scored AS (SELECT report, item, l_partkey, l_suppkey, l_tax * 10 AS structure, enabled, CASE WHEN enabled THEN 1 / (1 + exp(-greatest(-40.0, least(40.0, " + " + ".join(f"z{i} * w{i}" for i in range(4)) + ")))) ELSE 0.5 END AS preference FROM z, fitted, gate)"


@query("d14_preference_model", f"WITH {R.SELECTIONS}{_MODEL} SELECT report, item, l_partkey, l_suppkey, round(preference, 6) AS preference, round(CASE WHEN enabled THEN 0.85 * structure + 0.15 * preference ELSE structure END, 6) AS quality_score FROM scored")
def d14_model(spark, d):
    """A pipeline with the preference stage, fitted on all selections, saved, loaded, and applied to them."""
    from pyspark.ml import Pipeline, PipelineModel

    from seriesmill.operators.preference_model import PreferenceEstimator

    s = stored(R.selections(spark, d).withColumn("item_key", F.struct("item", "l_partkey", "l_suppkey")).withColumn("structure_score", F.col("l_tax") * 10))
    learn = PreferenceEstimator(groupCols=["report"], featureCols=R.FEATURES, itemCol="item_key", structureCol="structure_score", threshold=0.3)
    path = f"{shared_dir(spark)}/model"
    Pipeline(stages=[learn]).fit(s).write().save(path)
    out = PipelineModel.load(path).transform(s)
    return out.select("report", "item", "l_partkey", "l_suppkey", r6("preference"), r6("quality_score"))


# ---------------------------------------------------------------- H

WX = f"WITH {R.PIXELS}"
_PD = ", pd AS (SELECT video_id, frame_idx, seg, [abs(pixels[i] - p[i]) FOR i IN range(1, len(pixels) + 1)] AS dl, pixels = p AS duplicate FROM (SELECT *, lag(pixels) OVER (PARTITION BY video_id, seg ORDER BY frame_idx) AS p FROM (SELECT *, {seg} AS seg FROM pixels)) WHERE p IS NOT NULL), pf AS (SELECT video_id, frame_idx, seg, list_sum(dl) / len(dl) AS mad, len([x FOR x IN dl IF x >= 3.0]) * 100.0 / len(dl) AS changed_pct, duplicate FROM pd)"
_MM = "count(*) AS pairs, round(avg(mad), 6) AS mean_mad, round(quantile_cont(mad, 0.5), 6) AS median_mad, round(max(mad), 6) AS max_mad, round(avg(changed_pct), 6) AS mean_changed_pct, count(*) FILTER (duplicate) AS duplicates"
_MC = ["mean_mad", "median_mad", "max_mad", "mean_changed_pct"]


@query("h1_frame_pair_diff", WX + _PD.format(seg="0") + " SELECT video_id, frame_idx, round(mad, 6) AS mad, round(changed_pct, 6) AS changed_pct, duplicate FROM pf")
def h1(spark, d):
    return H.frame_pair_diff(R.pixels(spark, d)).select("video_id", "frame_idx", r6("mad"), r6("changed_pct"), "duplicate")


@query("h2_motion_metrics", WX + _PD.format(seg="0") + f" SELECT video_id, {_MM}, count(*) + 1 AS frames, round((count(*) + 1) / 24.0, 6) AS duration, round(max(changed_pct), 6) AS max_changed_pct FROM pf GROUP BY video_id")
def h2(spark, d):
    return H.motion_metrics(H.frame_pair_diff(R.pixels(spark, d))).select("video_id", "frames", r6("duration"), r6("max_changed_pct"), "pairs", *[r6(c) for c in _MC], "duplicates")


@query("h3_first_last_mad", WX + ", e AS (SELECT video_id, arg_min(pixels, frame_idx) AS a, arg_max(pixels, frame_idx) AS b FROM pixels GROUP BY video_id) SELECT video_id, round(list_sum([abs(a[i] - b[i]) FOR i IN range(1, len(a) + 1)]) / len(a), 6) AS first_last_mad FROM e")
def h3(spark, d):
    return H.first_last_mad(R.pixels(spark, d)).select("video_id", r6("first_last_mad"))


@query("h4_temporal_stddev", WX + ", u AS (SELECT video_id, unnest(range(1, len(pixels) + 1)) AS i, unnest(pixels) AS x FROM pixels) SELECT video_id, round(avg(s), 6) AS temporal_stddev FROM (SELECT video_id, i, stddev_pop(x) AS s FROM u GROUP BY ALL) GROUP BY video_id")
def h4(spark, d):
    return H.temporal_stddev(R.pixels(spark, d)).select("video_id", r6("temporal_stddev"))


_CLASS = "CASE WHEN x < 0.25 AND y < 0.5 THEN 'static' WHEN x < 0.75 AND y < 2.0 THEN 'minimal' ELSE 'visible' END"


@query("h5_classify_motion", f"SELECT class, count(*) AS n FROM (SELECT {_CLASS} AS class FROM (SELECT value / 100.0 AS x, (event_id % 30) / 10.0 AS y FROM events)) GROUP BY class")
def h5(spark, d):
    e = R.table(spark, d, "events")
    return e.groupBy(H.classify_motion(F.col("value") / 100.0, (F.col("event_id") % 30) / 10.0).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("h6_segment_motion", WX + _PD.format(seg="frame_idx // 8") + ", st AS (SELECT video_id, min(s) AS stop FROM (SELECT video_id, frame_idx // 8 AS s, count(*) AS n FROM pixels GROUP BY ALL) WHERE n < 2 GROUP BY video_id) SELECT pf.video_id, seg AS segment, " + _MM + " FROM pf LEFT JOIN st USING (video_id) WHERE stop IS NULL OR seg < stop GROUP BY ALL")
def h6(spark, d):
    return H.segment_motion(R.pixels(spark, d), 8).select("video_id", "segment", "pairs", *[r6(c) for c in _MC], "duplicates")


_SUMMARY = "count(*) FILTER (c = 'static') AS static, count(*) FILTER (c = 'minimal') AS minimal, count(*) FILTER (c = 'visible') AS visible, round(avg(mean_mad), 6) AS mean_mad, round(quantile_cont(mean_mad, 0.5), 6) AS median_mad, round(avg(mean_changed_pct), 6) AS mean_changed_pct, round(count(*) FILTER (c = 'static') * 100.0 / count(*), 6) AS static_pct"


def _user_motion(spark, d):
    return R.table(spark, d, "events").groupBy("user_id").agg((F.min("value") / 2).alias("mean_mad"), (F.min("value") * 1.5).alias("mean_changed_pct"))


_USER = "m AS (SELECT user_id, min(value) / 2 AS mean_mad, min(value) * 1.5 AS mean_changed_pct FROM events GROUP BY user_id)"


@query("h7_motion_summary", f"WITH {_USER} SELECT {_SUMMARY} FROM (SELECT *, " + _CLASS.replace("x <", "mean_mad <").replace("y <", "mean_changed_pct <") + " AS c FROM m)")
def h7(spark, d):
    m = H.motion_summary(_user_motion(spark, d))
    return m.select("static", "minimal", "visible", *[r6(c) for c in ("mean_mad", "median_mad", "mean_changed_pct", "static_pct")])


@query("h8_motion_gate", f"WITH {_USER} SELECT user_id FROM m WHERE mean_mad >= 0.5 AND mean_changed_pct >= 2.0")
def h8(spark, d):
    return H.motion_gate(_user_motion(spark, d)).select("user_id")


_SIMILAR = ", p AS (SELECT a.video_id, a.frame_idx, unnest(a.pixels) AS x, unnest(b.pixels) AS y FROM pixels a JOIN pixels b ON b.video_id = a.video_id AND b.frame_idx = a.frame_idx + 1), m AS (SELECT video_id, frame_idx, corr(x, y) AS r, stddev_pop(x) AS sa, stddev_pop(y) AS sb, avg(abs(x - y)) AS mad FROM p GROUP BY ALL), sim AS (SELECT video_id, frame_idx, CASE WHEN sa < 60 OR sb < 60 THEN 1 - mad / 255.0 ELSE r END AS similarity FROM m)"


def _similarities(spark, d):
    x = R.pixels(spark, d)
    b = x.select("video_id", (F.col("frame_idx") - 1).alias("frame_idx"), F.col("pixels").alias("next"))
    return H.anchor_similarity(x.join(b, ["video_id", "frame_idx"]), ["video_id", "frame_idx"], "pixels", "next", 60.0)


@query("h9_anchor_similarity", WX + _SIMILAR + " SELECT video_id, frame_idx, round(similarity, 6) AS similarity FROM sim")
def h9(spark, d):
    return _similarities(spark, d).select("video_id", "frame_idx", r6("similarity"))


@query("h9_anchor_gate", WX + _SIMILAR + " SELECT video_id, frame_idx // 2 AS clip, bool_and(coalesce(isfinite(similarity) AND similarity >= 0.5, false)) AS passed FROM sim GROUP BY ALL")
def h9g(spark, d):
    clips = _similarities(spark, d).withColumn("clip", F.floor(F.col("frame_idx") / 2).cast("int"))
    return H.anchor_gate(clips, ["video_id", "clip"])


@query("h10_to_gray", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 0.299 + l_discount * 0.587 + l_tax * 0.114, 6) AS luma, round((l_quantity + l_discount + l_tax) / 3.0, 6) AS mean FROM lineitem")
def h10(spark, d):
    a = [F.array(c) for c in ("l_quantity", "l_discount", "l_tax")]
    return R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r6(H.to_gray(*a)[0], "luma"), r6(H.to_gray(*a, luma=False)[0], "mean"))


@query("h11_error_isolation", "SELECT count(*) AS good, (SELECT count(*) FROM events WHERE NOT isfinite(CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value END)) AS bad FROM events WHERE event_id % 50 <> 0")
def h11(spark, d):
    e = R.table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value")))
    return H.error_summary(e, F.when(~is_finite(F.col("v")), "non-finite value"))


@query("h11_isolated_errors", "SELECT event_id, 'non-finite value' AS error FROM events WHERE event_id % 50 = 0")
def h11b(spark, d):
    e = R.table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 50 == 0, float("nan")).otherwise(F.col("value")))
    return H.isolate_errors(e, F.when(~is_finite(F.col("v")), "non-finite value"))[1].select("event_id", "error")


# ---------------------------------------------------------------- J


_RUN = "source || '-' || (doc_id // 200)"


def _runs(spark, d):
    """Documents of a source as the items of runs of bounded size, more of them in a larger table."""
    return R.table(spark, d, "documents").withColumn("source", F.expr("source || '-' || CAST(floor(doc_id / 200) AS BIGINT)"))


@query("j1_sample_epochs", f"WITH r AS (SELECT {_RUN} AS source, doc_id FROM documents), i AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM r), e AS (SELECT source, doc_id, unnest(range(0, 3)) * n + k AS position, n FROM i) SELECT source, position, doc_id FROM e WHERE position < 2 * n + 3 AND position < 3 * n")
def j1(spark, d):
    x = _runs(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))
    return J.sample_epochs(x, "source", "doc_id", F.least(2 * F.col("n") + 3, 3 * F.col("n")), 7, shuffle=False)


@query("j1_sample_epochs_shuffled")
def j1s(spark, d):
    return J.sample_epochs(_runs(spark, d).withColumn("n", F.lit(120)), "source", "doc_id", F.col("n"), 7)


@query("j2_evenly_spaced", "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, unnest(CASE WHEN n <= 7 THEN range(0, n) ELSE [CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT) FOR i IN range(7)] END) AS idx FROM n")
def j2(spark, d):
    n = R.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", F.explode(J.evenly_spaced(F.col("n"), 7)).alias("idx"))


@query("j3_assign_choice")
def j3(spark, d):
    return R.table(spark, d, "documents").select("doc_id", J.assign_choice(["rave", "calm", "storm"], 11, F.col("doc_id")).alias("choice"))


@query("j4_make_batches", "SELECT source, batch, array_to_string(list(doc_id ORDER BY doc_id), ',') AS ids FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents) GROUP BY ALL")
def j4(spark, d):
    return J.make_batches(R.table(spark, d, "documents"), "source", "doc_id", 8).select("source", "batch", F.array_join("ids", ",").alias("ids"))


@query("j5_plan_run")
def j5(spark, d):
    return J.plan_run(_runs(spark, d).withColumn("n", F.lit(60)), "source", "doc_id", F.col("n"), 3, ["build", "rise", "attack"], 6)


# ---------------------------------------------------------------- K

WL = f"WITH {R.LINES}"
_ERR = "(stream = 'stderr' OR regexp_matches(line, '" + K.any_of(K.ERROR_PATTERNS) + "'))"


@query("k1_route_error_lines", WL + f" SELECT line_no, line FROM lines WHERE {_ERR}")
def k1(spark, d):
    return K.route_error_lines(R.log_lines(spark, d)).select("line_no", "line")


def _attempts(lines):
    return lines.groupBy("stage", "attempt").agg((F.max("line_no") % 17 == 0).alias("timed_out"), (F.max("line_no") % 13 == 0).alias("idle_timed_out"))


_FAIL = f""", att AS (SELECT stage, attempt, max(line_no) % 17 = 0 AS timed_out, max(line_no) % 13 = 0 AS idle_timed_out FROM lines GROUP BY ALL), tl AS (SELECT *, row_number() OVER (PARTITION BY stage, attempt ORDER BY ts DESC, line_no DESC) AS r FROM lines)
, fg AS (SELECT stage, attempt, bool_or(regexp_matches(line, '{K.any_of(K.FATAL_PATTERNS)}')) AS fatal, bool_or(regexp_matches(line, '{K.any_of(K.QUOTA_PATTERNS)}')) AS quota FROM tl WHERE r <= 4 GROUP BY ALL)
, cls AS (SELECT att.stage, att.attempt, CASE WHEN timed_out THEN 'stage-timeout' WHEN idle_timed_out THEN 'idle-timeout' WHEN fatal THEN 'fatal' WHEN quota THEN 'quota-or-refusal' ELSE 'transient-or-unknown' END AS failure_class FROM att LEFT JOIN fg USING (stage, attempt))"""


def _classes(spark, d):
    lines = R.log_lines(spark, d)
    return K.classify_failure(lines, _attempts(lines), ["stage", "attempt"], 4)


@query("k2_classify_failure", WL + _FAIL + " SELECT stage, attempt, failure_class FROM cls")
def k2(spark, d):
    return _classes(spark, d)


_RETRY = ", qr AS (SELECT *, sum(CASE WHEN failure_class = 'quota-or-refusal' THEN 1 ELSE 0 END) OVER (PARTITION BY stage ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS quota_refusals FROM cls)"


@query("k3_retry_plan", WL + _FAIL + _RETRY + " SELECT stage, attempt, quota_refusals, quota_refusals >= 5 AS long_mode, CASE WHEN quota_refusals >= 5 AND failure_class = 'quota-or-refusal' THEN 3600 WHEN failure_class = 'quota-or-refusal' THEN 300 ELSE 30 END AS wait_seconds FROM qr", quota_refusals="BIGINT")
def k3(spark, d):
    return K.retry_plan(_classes(spark, d), ["stage"], "attempt", 5, 30, 300, 3600).select("stage", "attempt", "quota_refusals", "long_mode", "wait_seconds")


@query("k4_idle_gaps", WL + " SELECT line_no, round(gap, 3) AS gap FROM (SELECT line_no, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY attempt ORDER BY ts, line_no)) / 1e6 AS gap FROM lines) WHERE gap > 86400")
def k4(spark, d):
    return K.idle_gaps(R.log_lines(spark, d), ["attempt"], 86400.0).select("line_no", F.round("gap", 3).alias("gap"))


@query("k4_stage_overruns", WL + " SELECT attempt, round(s, 3) AS seconds FROM (SELECT attempt, epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS s FROM lines GROUP BY attempt) WHERE s > 2500000")
def k4b(spark, d):
    return K.stage_overruns(R.log_lines(spark, d), ["attempt"], 2_500_000.0).select("attempt", F.round("seconds", 3).alias("seconds"))


@query("k7_exit_classes", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'finished' WHEN 1 THEN 'allocation' WHEN 2 THEN 'stalled' WHEN 3 THEN 'timeout' ELSE 'failed' END AS outcome FROM events")
def k7b(spark, d):
    k = F.col("event_id") % 6
    code = F.when(k == 0, 0).when(k == 1, 75).when(k == 2, 76).when(k == 3, 124).otherwise(k)
    return R.table(spark, d, "events").select("event_id", K.exit_class(code).alias("outcome"))


@query("k5_run_progress", "WITH n AS (SELECT doc_id % 20 AS run, doc_id, CASE WHEN quality = 1 THEN 'done' ELSE 'open' END AS status, CASE WHEN quality = 1 AND doc_id % 3 = 0 THEN 'done' ELSE 'open' END AS was FROM labels) SELECT run, count(*) AS items, count(*) FILTER (status = 'done') AS finished, count(*) FILTER (status = 'done' AND was <> 'done') AS newly_finished, count(*) FILTER (status <> 'done') AS remaining FROM n GROUP BY run")
def k5(spark, d):
    la = R.table(spark, d, "labels")
    done = F.col("quality") == 1
    now = la.select((F.col("doc_id") % 20).alias("run"), "doc_id", F.when(done, "done").otherwise("open").alias("status"))
    before = la.select((F.col("doc_id") % 20).alias("run"), "doc_id", F.when(done & (F.col("doc_id") % 3 == 0), "done").otherwise("open").alias("status"))
    return K.run_progress(now, before, "run", "doc_id")


@query("k6_recent_output", WL + " SELECT attempt, line_no, from_end FROM (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY ts DESC, line_no DESC) AS from_end FROM lines) WHERE from_end <= 10")
def k6(spark, d):
    return K.recent_output(R.log_lines(spark, d), ["attempt"], 10).select("attempt", "line_no", "from_end")


@query("k7_progress_watchdog", WL + ", s AS (SELECT line_no, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 - max(CASE WHEN line LIKE 'purchase%' THEN epoch_us(ts) / 1e6 END) OVER w AS a, epoch_us(ts) / 1e6 - max(CASE WHEN line LIKE 'view%' THEN epoch_us(ts) / 1e6 END) OVER w AS b FROM lines WINDOW w AS (PARTITION BY attempt ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING)) SELECT line_no, round(a, 3) AS since_progress, CASE WHEN a > 259200 THEN 'stalled' WHEN b > 172800 THEN 'lost' ELSE 'ok' END AS state FROM s")
def k7(spark, d):
    x = K.progress_watchdog(R.log_lines(spark, d), "attempt", F.col("line").startswith("purchase"), F.col("line").startswith("view"), 259200.0, 172800.0)
    return x.select("line_no", F.round("since_progress", 3).alias("since_progress"), "state")


_ACC = "WITH a AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS progress, event_type IN ('error', 'view') AS failed, event_id % 2 = 0 AS transient FROM events), b AS (SELECT *, sum(CAST(progress AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT *, sum(CAST(NOT progress AND failed AS INT)) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failures, sum(CAST(progress OR (failed AND NOT transient) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM b)"


@query("k8_attempt_accounting", _ACC + " SELECT event_id, failures, used, CASE WHEN NOT failed THEN 'none' WHEN failures >= 3 THEN 'long' ELSE 'short' END AS wait_class FROM c", failures="BIGINT", used="BIGINT")
def k8(spark, d):
    t = F.col("event_type")
    a = R.table(spark, d, "events").select("user_id", "ts", "event_id", (t == "purchase").alias("progress"), t.isin("error", "view").alias("failed"), (F.col("event_id") % 2 == 0).alias("transient"))
    return K.attempt_accounting(a, "user_id", ["ts", "event_id"]).select("event_id", "failures", "used", "wait_class")


# ---------------------------------------------------------------- A


@query("a3_explode_clips", "SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS clip_index, l_partkey FROM lineitem")
def a3(spark, d):
    clips = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: F.struct(x["l_partkey"].alias("l_partkey")))
    m = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(clips.alias("clips"))
    return io.explode_clips(m)


@query("a4_scan_choices", "WITH f AS (SELECT l_orderkey AS run, CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS k FROM lineitem) SELECT run AS run_id, min(k) - 1 AS chosen_index FROM f WHERE k IS NOT NULL GROUP BY run HAVING count(DISTINCT k) = 1 AND min(k) - 1 >= 0")
def a4(spark, d):
    files = R.table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", F.concat(F.lit("short_"), F.col("l_linenumber").cast("string"), F.lit("_x.mp4"))).otherwise("notes.txt").alias("name"))
    return io.choices_of(files, F.col("l_orderkey"), F.col("name"))


@query("a5_scan_media", "SELECT url FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.txt' END AS url FROM pages) WHERE lower(url) LIKE '%.png' OR lower(url) LIKE '%.jpg'")
def a5(spark, d):
    k = F.col("page_id") % 3
    f = R.table(spark, d, "pages").select(F.concat("url", F.when(k == 0, ".PNG").when(k == 1, ".jpg").otherwise(".txt")).alias("path"))
    return io.media_files(f, ["png", ".JPG"]).withColumnRenamed("path", "url")


@query("a6_latest_only", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def a6(spark, d):
    return io.latest_only(R.table(spark, d, "events"), "user_id", "event_id", "ts").select("user_id", "event_id")


_MARKED = "WITH m AS (SELECT c_custkey AS run, unnest([CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 5 + 1 END, CASE WHEN c_custkey % 7 = 0 THEN 9 END, CASE WHEN c_custkey % 13 = 0 THEN 0 END]) AS k FROM customer)"


@query("a4_empty_markers", _MARKED + " SELECT run AS run_id, min(k) - 1 AS chosen_index FROM m WHERE k IS NOT NULL GROUP BY run HAVING count(DISTINCT k) = 1 AND min(k) > 0", run_id="BIGINT", chosen_index="INTEGER")
def a4_tree(spark, d, runs_a_tree: int = 100_000):
    """Marker files without content in a folder of each run. Trees of about runs_a_tree runs are written, scanned and deleted one after the other, so that a disk's files and folders don't run out."""
    run = F.col("c_custkey")
    index = F.array_compact(F.array(F.when(run % 11 != 0, run % 5 + 1), F.when(run % 7 == 0, F.lit(9)), F.when(run % 13 == 0, F.lit(0)), F.lit(-1)))
    name = F.when(F.col("k") < 0, "notes.txt").otherwise(F.concat(F.lit("short_"), F.col("k").cast("string"), F.lit("_x.mp4")))
    runs = R.table(spark, d, "customer").select(run).where(run.isNotNull())
    trees, chosen = max(1, -(-runs.count() // runs_a_tree)), []
    for k in range(trees):
        path = shared_dir(spark)
        own = runs.where(F.pmod(F.xxhash64(run), F.lit(trees)) == k)
        tree = own.select(run, F.explode(index).alias("k")).select(F.concat(run.cast("string"), F.lit("/shorts/picked/"), name).alias("file"), F.lit(None).cast("string").alias("text"))
        write_files(tree, path, "file", [], "text")
        chosen.append(stored(io.scan_choices(spark, path, "picked").withColumn("run_id", F.col("run_id").cast("long"))))
        delete_tree(spark, path)
    return functools.reduce(DataFrame.unionByName, chosen)


@query("a5_media_tree", "SELECT 'user=' || (page_id % 40) || '/' || page_id || CASE page_id % 3 WHEN 0 THEN '.PNG' ELSE '.jpg' END AS relative, CASE WHEN page_id % 4 = 0 THEN 0 ELSE strlen(coalesce(html, '')) END AS length FROM pages WHERE page_id % 3 < 2", length="BIGINT")
def a5_tree(spark, d):
    """A file for each page, a quarter of them empty."""
    path, k = shared_dir(spark), F.col("page_id")
    name = F.concat(F.lit("user="), (k % 40).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".jpg").otherwise(".txt"))
    write_files(R.table(spark, d, "pages").select(name.alias("file"), F.when(k % 4 != 0, F.col("html")).alias("text")), path, "file", [], "text")
    return io.scan_media(spark, path, ["png", ".JPG"]).select("relative", "length")


@query("a8_publish_generation", "SELECT doc_id, lang FROM documents")
def a8(spark, d):
    path = shared_dir(spark)
    docs = R.table(spark, d, "documents").select("doc_id", "lang")
    commits.publish_generation(docs.limit(0), path)
    commits.publish_generation(docs, path)
    return commits.read_generation(spark, path)


@query("a8_published_batches", "SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def a8_batches(spark, d):
    """Totals that a stream publishes anew after each batch; the first batches are delivered again by a query without their checkpoint."""
    s, path = _stream(spark, d, R.table(spark, d, "events").select("user_id", "value").repartition(3, "user_id"))

    def add(batch, table):
        new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
        both = new if table is None else new.unionByName(table)
        return both.groupBy("user_id").agg(F.sum("events").alias("events"), F.sum("total").alias("total"))

    for k in (1, 2):
        q = s.writeStream.foreachBatch(commits.publish_batches(f"{path}/table", "totals", add)).option("checkpointLocation", f"{path}/checkpoint{k}").trigger(availableNow=True).start()
        q.awaitTermination()
    return commits.read_generation(spark, f"{path}/table").select("user_id", "events", F.round("total", 4).alias("total"))


@query("a9_content_inventory", "SELECT 'pages-' || (page_id % 7) || '/' || page_id || '.html' AS relative_path, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS sha256 FROM pages")
def a9(spark, d):
    """A file for each page."""
    path, k = shared_dir(spark) + "/inventory", F.col("page_id")
    write_files(R.table(spark, d, "pages").select(F.concat(F.lit("pages-"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit(".html")).alias("file"), "html"), path, "file", [], "html")
    return io.content_inventory(spark, path).select("relative_path", "bytes", "sha256")


_ARTIFACTS = """WITH a AS (SELECT page_id % 25 AS contract_id, CASE WHEN page_id % 9 = 0 THEN 2 ELSE 1 END AS version, CASE WHEN page_id % 8 = 0 THEN 'other' ELSE 'clip' END AS kind, CASE WHEN page_id % 7 = 0 THEN '' ELSE '/' END || CAST(page_id % 40 AS VARCHAR) AS path, CASE WHEN page_id % 6 = 0 THEN -1 ELSE strlen(html) END AS bytes, CASE WHEN page_id % 5 = 0 THEN upper(sha256(html)) ELSE sha256(html) END AS sha, page_id FROM pages)
SELECT page_id, concat_ws(',', CASE WHEN version <> 1 THEN 'version' END, CASE WHEN kind <> 'clip' THEN 'kind' END, CASE WHEN NOT starts_with(path, '/') THEN 'relative_path' END, CASE WHEN NOT regexp_full_match(sha, '[0-9a-f]{64}') THEN 'digest' END, CASE WHEN bytes < 0 THEN 'bytes' END, CASE WHEN count(*) OVER (PARTITION BY contract_id, path) > 1 THEN 'duplicate_path' END) AS violations FROM a"""


def _artifacts(spark, d):
    k = F.col("page_id")
    sha = F.sha2("html", 256)
    return R.table(spark, d, "pages").select(
        "page_id", (k % 25).alias("contract_id"), F.when(k % 9 == 0, 2).otherwise(1).alias("version"), F.when(k % 8 == 0, "other").otherwise("clip").alias("kind"),
        F.concat(F.when(k % 7 == 0, "").otherwise("/"), (k % 40).cast("string")).alias("path"), F.when(k % 6 == 0, -1).otherwise(F.octet_length("html")).alias("bytes"), F.when(k % 5 == 0, F.upper(sha)).otherwise(sha).alias("sha256"),
    )


@query("a10_validate_artifacts", _ARTIFACTS)
def a10(spark, d):
    return io.validate_artifacts(_artifacts(spark, d), 1, ["clip"]).select("page_id", F.array_join("violations", ",").alias("violations"))


@query("a10_verify_artifacts", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'bytes,changed' WHEN page_id % 5 = 0 OR page_id % 4 = 0 THEN 'changed' ELSE '' END AS violations FROM pages")
def a10v(spark, d):
    k, size = F.col("page_id"), F.octet_length("html")
    path = F.concat(F.lit("/"), k.cast("string"))
    named = R.table(spark, d, "pages").select("page_id", F.lit(1).alias("contract_id"), F.lit(1).alias("version"), F.lit("clip").alias("kind"), path.alias("path"), F.when(k % 6 == 0, -1).otherwise(size).alias("bytes"), F.sha2("html", 256).alias("sha256"))
    there = R.table(spark, d, "pages").where(k % 5 != 0).select(path.alias("path"), size.alias("bytes"), F.sha2(F.when(k % 4 == 0, "other").otherwise(F.col("html")), 256).alias("sha256"))
    return io.validate_artifacts(named, 1, ["clip"], there).select("page_id", F.array_join("violations", ",").alias("violations"))


@query("a11_missing_references", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)")
def a11(spark, d):
    files = R.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")).where("l_partkey % 10 <> 0")
    return io.missing_references(R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), files, "l_partkey")


@query("a12_write_report_json", """SELECT o_custkey, '{"schema_version":3,"selections":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']}' AS document FROM orders GROUP BY o_custkey""")
def a12(spark, d):
    return io.report_documents(R.table(spark, d, "orders"), "o_custkey", 3, ["o_orderkey", "o_orderstatus"], "o_orderkey")


@query("a12_written_reports", "SELECT 3 AS schema_version, count(*) AS selections, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey", schema_version="BIGINT")
def a12w(spark, d):
    path = shared_dir(spark)
    io.write_report_json(R.table(spark, d, "orders"), path, "o_custkey", 3, ["o_orderkey", "o_orderstatus"], "o_orderkey")
    x = spark.read.schema("schema_version long, selections array<struct<o_orderkey:long>>").json(path)
    return x.select("schema_version", F.size("selections").cast("long").alias("selections"), F.col("selections")[0]["o_orderkey"].alias("first_order"))


# ---------------------------------------------------------------- A: report trees, L: streams


def _tree(spark, d) -> str:
    """Report documents of all customers, one a line, in folders of runs; some of them broken."""
    root = shared_dir(spark)
    o = R.table(spark, d, "orders")
    one = io.report_documents(o, "o_custkey", 3, ["o_orderkey", "o_orderstatus"], "o_orderkey")
    text = F.when(F.col("o_custkey") % 30 == 1, F.lit("{broken")).otherwise(F.col("document"))
    one.select(text.alias("value"), (F.col("o_custkey") % 20).alias("run")).repartition("run").write.partitionBy("run").text(f"{root}/tree")
    return f"{root}/tree"


@query("a1_scan_reports", "SELECT CAST(o_custkey % 20 AS VARCHAR) AS run_id, CASE WHEN o_custkey % 30 = 1 THEN 'invalid_json' END AS skip_reason, CASE WHEN o_custkey % 30 <> 1 THEN CAST(count(*) AS INT) END AS n_selections FROM orders GROUP BY o_custkey")
def a1(spark, d):
    x = io.scan_reports(spark, _tree(spark, d), "run=*/*.txt", r"/run=(\d+)/", lines=True)
    return x.select("run_id", "skip_reason", F.when(F.col("selections").isNotNull(), F.size("selections")).alias("n_selections"))


@query("a2_scan_manifests", "SELECT CAST(page_id % 5 AS VARCHAR) AS run_id, 2::BIGINT AS version, CASE WHEN page_id % 7 <> 0 THEN regexp_replace(lower(url) || '/a/b.wav', '/+', '/', 'g') END AS track_id FROM pages")
def a2(spark, d):
    root = shared_dir(spark)
    m = R.table(spark, d, "pages").select((F.col("page_id") % 5).alias("run"), F.to_json(F.struct(F.lit(2).alias("version"), F.struct(F.when(F.col("page_id") % 7 != 0, F.concat("url", F.lit("\\A\\.\\b.WAV"))).alias("path")).alias("music"))).alias("value"))
    m.write.partitionBy("run").text(root)
    return io.scan_manifests(spark, root, "run=*/*.txt", r"/run=(\d+)/", lines=True).select("run_id", "version", "track_id")


def _stream(spark, d, df, per_trigger: int = 1):
    """df written as a few files and read back as a stream of files."""
    from seriesmill.streaming.streams import stream_chunks

    path = shared_dir(spark)
    df.write.parquet(f"{path}/in")
    return stream_chunks(spark, f"{path}/in", df.schema, per_trigger), path


def _stream_of(spark, parts: list, by: str | None = None):
    """Tables of one schema that arrive one after the other, each in one trigger; by: the column that deals a table's rows.

    Each is written as so many files as the session has shuffle partitions, if it has 100 rows for each at least.
    """
    from seriesmill.streaming.streams import stream_chunks

    path = shared_dir(spark)
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts[0].count() // 100))
    for part in parts:
        (part.repartition(files, by) if by else part.repartition(files)).write.mode("append").parquet(f"{path}/in")
    return stream_chunks(spark, f"{path}/in", parts[0].schema, files), path


def _thirds(df, order: str) -> list:
    """Three tables of about equal size, in order of a column."""
    df = stored(df)
    edges = df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [1 / 3, 2 / 3], 0.001)
    x = F.col(order).cast("double")
    return [df.where(x <= edges[0]), df.where((x > edges[0]) & (x <= edges[1])), df.where(x > edges[1])]


def _late_stream(spark, d):
    """Log lines in three triggers by time, then lines of the first third once more, which come too late, and two lines far ahead."""
    one, two, three = _thirds(R.log_lines(spark, d), "ts")
    ahead = [one.limit(1).withColumn("ts", F.expr(f"ts + INTERVAL {years} YEARS")).withColumn("stage", F.lit("ahead")).withColumn("stream", F.lit("stderr")) for years in (20, 40)]
    return _stream_of(spark, [one, two, three, one, *ahead])


@query("l1_stream_chunks", "SELECT event_id, user_id FROM events")
def l1(spark, d):
    from seriesmill.streaming.streams import run_to_table

    s, path = _stream(spark, d, R.table(spark, d, "events").select("event_id", "user_id").repartition(3, "user_id"))
    return run_to_table(s, path)


@query("l2_stream_error_counts", WL + f" SELECT time_bucket(INTERVAL '6 hours', ts) AS start, stage, count(*) AS errors FROM lines WHERE {_ERR} GROUP BY ALL")
def l2(spark, d):
    from seriesmill.streaming.streams import error_counts, run_to_table

    s, path = _late_stream(spark, d)
    x = run_to_table(error_counts(s, "6 hours", "1 hour"), path)
    return x.where("stage <> 'ahead'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l3_stream_idle_sessions", WL + ", g AS (SELECT stage, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY stage ORDER BY ts) + INTERVAL '90 minutes' OR lag(ts) OVER (PARTITION BY stage ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM lines), h AS (SELECT *, sum(n) OVER (PARTITION BY stage ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT stage, min(ts) AS start, max(ts) + INTERVAL '90 minutes' AS end, count(*) AS lines FROM h GROUP BY stage, k".replace(" AS end,", ' AS "end",'))
def l3(spark, d):
    from seriesmill.streaming.streams import idle_sessions, run_to_table

    s, path = _late_stream(spark, d)
    x = run_to_table(idle_sessions(s, "stage", "90 minutes", "1 hour"), path)
    return x.where("stage <> 'ahead'").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("l3_idle_sessions_by_run", registry.sql_of("l3_stream_idle_sessions").replace("PARTITION BY stage", "PARTITION BY attempt").replace("SELECT stage, ts", "SELECT attempt, ts").replace("SELECT stage, min(ts)", "SELECT attempt, min(ts)").replace("GROUP BY stage, k", "GROUP BY attempt, k").replace("90 minutes", "12 hours"))
def l3_runs(spark, d):
    from seriesmill.streaming.streams import idle_sessions, run_to_table

    s, path = _late_stream(spark, d)
    x = run_to_table(idle_sessions(s, "attempt", "12 hours", "1 hour"), path)
    return x.where("year(start) < 2040").withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("l4_stream_dedupe_reports", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def l4(spark, d):
    from seriesmill.streaming.streams import dedupe_reports, run_to_table

    x = R.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    s, path = _stream_of(spark, [x, x])
    return run_to_table(dedupe_reports(s, ["l_orderkey", "l_linenumber"]), path).select("l_orderkey", "l_linenumber")


@query("l5_stream_quota_state", WL + _FAIL + _RETRY + " SELECT stage, attempt, CAST(quota_refusals AS BIGINT) AS quota_refusals, quota_refusals >= 5 AS long_mode FROM qr")
def l5(spark, d):
    from seriesmill.streaming.streams import quota_state, run_to_table

    s, path = _stream_of(spark, _thirds(_classes(spark, d), "attempt"), "stage")
    return run_to_table(quota_state(s, 5), path)


@query("l6_stream_recent_rules", text_queries.bans_sql())
def l6(spark, d):
    from seriesmill.plans.text_queries import PHRASES
    from seriesmill.streaming.streams import recent_rules, run_to_table

    s, path = _stream_of(spark, _thirds(R.prompts(spark, d), "idx"), "run_id")
    return run_to_table(recent_rules(s, PHRASES, 2, 4), path).select("run_id", "idx", F.array_join("bans", ",").alias("bans"))


def _growing_logs(spark, d):
    """A log file for each attempt that grows in three rounds, each time by a third of its lines and half of the next one; a stream that starts anew after each round tails them."""
    from seriesmill.streaming.streams import run_to_table
    from seriesmill.streaming.tail import tail_lines

    path = shared_dir(spark)
    w = Window.partitionBy("attempt")
    n = F.row_number().over(w.orderBy("ts", "line_no"))
    lines = stored(R.log_lines(spark, d).select("attempt", "line", n.alias("n"), F.count(F.lit(1)).over(w).alias("of")))
    for part in (1, 2, 3):
        edge = F.floor(F.col("of") * part / 3)
        text = F.when(F.col("n") <= edge, F.concat("line", F.lit("\n"))).otherwise(F.substring(F.col("line"), F.lit(1), F.floor(F.length("line") / 2).cast("int")))
        written = lines.where(F.col("n") <= edge + 1).select(F.concat(F.lit("run-"), F.col("attempt").cast("string"), F.lit(".log")).alias("file"), "n", text.alias("text"))
        write_files(written, f"{path}/logs", "file", ["n"], "text")
        x = run_to_table(tail_lines(spark, f"{path}/logs", "run-*.log"), path)
    return x.select(F.regexp_extract("file", r"(\d+)", 1).cast("long").alias("attempt"), "position", "line")


@query("l7_stream_tail", WL + " SELECT line FROM lines")
def l7(spark, d):
    return _growing_logs(spark, d).select("line")


@query("l7_tail_positions", WL + " SELECT attempt, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY attempt ORDER BY ts, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position, line FROM lines", position="BIGINT")
def l7_positions(spark, d):
    return _growing_logs(spark, d)


@query("l7_stream_new_files", WL + " SELECT line FROM lines")
def l7_files(spark, d):
    from seriesmill.streaming.streams import run_to_table, tail

    path = shared_dir(spark)
    R.log_lines(spark, d).select("line").repartition(3).write.text(f"{path}/in")
    return run_to_table(tail(spark, f"{path}/in", 2), path).select("line")


# ---------------------------------------------------------------- streams in order, alarms


@query("l6_stream_rules_in_order", text_queries.all_rules_sql())
def l6_ordered(spark, d):
    from seriesmill.plans.text_queries import LEAD, PHRASES, REACTION
    from seriesmill.streaming.stateful import recent_rules_in_order
    from seriesmill.streaming.streams import run_to_table

    p = stored(R.prompts(spark, d))
    part = F.pmod(F.xxhash64("run_id", "idx"), F.lit(3))
    s, path = _stream_of(spark, [p.where(part == k) for k in (2, 0, 1)], "run_id")
    x = run_to_table(recent_rules_in_order(s, PHRASES, LEAD, REACTION, ban_last=2, ban_limit=4), path)
    return x.withColumn("bans", F.array_join("bans", ","))


_ATTEMPTS = "WITH a AS (SELECT user_id AS run, event_id AS attempt, ts, CASE WHEN event_id % 3 = 0 THEN 'quota-or-refusal' WHEN event_id % 11 = 1 THEN 'fatal' ELSE 'transient-or-unknown' END AS failure_class FROM events WHERE event_type = 'error'), q AS (SELECT *, sum(CASE WHEN failure_class = 'quota-or-refusal' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY ts, attempt ROWS UNBOUNDED PRECEDING) AS quota_refusals FROM a)"
_WAITS = " SELECT run, attempt, quota_refusals, quota_refusals >= 2 AS long_mode, CASE WHEN quota_refusals >= 2 AND failure_class = 'quota-or-refusal' THEN 3600 WHEN failure_class = 'quota-or-refusal' THEN 300 ELSE 30 END AS wait_seconds FROM q"


def _user_attempts(spark, d):
    """Failed attempts of each user, who stands for a run and a stage."""
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "quota-or-refusal").when(k % 11 == 1, "fatal").otherwise("transient-or-unknown")
    return R.table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("run"), k.alias("attempt"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("failure_class"))


@query("k3_retry_plan_by_run", _ATTEMPTS + _WAITS, quota_refusals="BIGINT")
def k3_runs(spark, d):
    return K.retry_plan(_user_attempts(spark, d).withColumn("at", F.struct("ts", "attempt")), ["run"], "at", 2, 30, 300, 3600).select("run", "attempt", "quota_refusals", "long_mode", "wait_seconds")


@query("l5_quota_in_order", _ATTEMPTS + _WAITS, quota_refusals="BIGINT")
def l5_ordered(spark, d):
    from seriesmill.streaming.stateful import quota_in_order
    from seriesmill.streaming.streams import run_to_table

    a = stored(_user_attempts(spark, d))
    first, last = a.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    width = (last or 0) - (first or 0) + 1
    when = F.floor((F.unix_seconds("ts") - first) * 6 / width) + F.when(F.col("attempt") % 3 == 1, 1).otherwise(0)  # a third comes a trigger late
    ahead = [spark.sql(f"SELECT -1L AS run, {k}L AS attempt, TIMESTAMP '2100-01-01' + INTERVAL {k} YEARS AS ts, 'x' AS failure_class") for k in (1, 2)]
    s, path = _stream_of(spark, [*[a.where(when == k) for k in range(7)], *ahead], "run")
    return run_to_table(quota_in_order(s, ["run"], 2, 30, 300, 3600, f"{-(-width // 6) + 1} seconds"), path).where("run >= 0")


@query("k7_live_watchdog", "SELECT DISTINCT user_id AS attempt, 'stalled' AS state FROM events")
def k7_live(spark, d):
    """All lines come at once and nothing after them, so every run is reported."""
    from seriesmill.streaming.stateful import live_watchdog

    s, path = _stream_of(spark, [R.log_lines(spark, d)], "attempt")
    said = live_watchdog(s, "attempt", F.col("line").startswith("purchase"), F.col("line").startswith("view"), 2.0, 1.0)
    return _until(said, path, R.table(spark, d, "events").select("user_id").distinct().count()).where("state = 'stalled'").select("attempt", "state").distinct()


def _until(said, path: str, runs: int, state: str = "stalled", seconds: int = 300):
    """Runs a stream of alarms until so many runs are in a state."""
    spark = said.sparkSession
    q = said.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/data").trigger(processingTime="500 milliseconds").start()
    out = spark.read.schema(said.schema).format("parquet")
    end = time.monotonic() + seconds
    try:
        while runs and time.monotonic() < end and q.isActive:
            q.awaitTermination(1)
            if q.lastProgress and out.load(f"{path}/data").where(F.col("state") == state).select("attempt").distinct().count() >= runs:
                break
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    return out.load(f"{path}/data")
