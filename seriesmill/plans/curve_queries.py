"""Queries for curves and points (C, and the joins that they stand for) over events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import curves as C
from seriesmill.operators import points as P
from seriesmill.plans import roles as R
from seriesmill.plans.registry import query

K = ["series_id", "frame_idx"]
WF = f"WITH {R.FRAMES}"
WP = f"WITH {R.FRAMES}, {R.POINTS}, {R.SERIES}"
WV = f"WITH {R.VECTORS}"


def r6(c, name=None):
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c)


@query(
    "c1_resample_linear",
    WF + """, s AS (SELECT series_id, t * 1.7 AS t, max(rms) AS v FROM frames GROUP BY ALL), g AS (SELECT series_id, unnest(generate_series(0, CAST(floor(max(t)) AS BIGINT))) AS grid_idx FROM s GROUP BY series_id)
, n AS (SELECT g.series_id, g.grid_idx, a.t AS ta, a.v AS va, b.t AS tb, b.v AS vb FROM g ASOF LEFT JOIN s a ON a.series_id = g.series_id AND a.t <= CAST(g.grid_idx AS DOUBLE) ASOF LEFT JOIN s b ON b.series_id = g.series_id AND b.t >= CAST(g.grid_idx AS DOUBLE))
SELECT series_id, grid_idx, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL OR ta = tb THEN va ELSE va + (vb - va) * (grid_idx - ta) / (tb - ta) END, 6) AS v FROM n""",
)
def c1(spark, d):
    f = R.frames(spark, d).select("series_id", (F.col("t") * 1.7).alias("t"), F.col("rms").alias("v"))
    return C.resample_linear(f, 1.0).select("series_id", "grid_idx", r6("v"))


@query("c2_minmax_scale", WF + " SELECT series_id, frame_idx, round((rms - min(rms) OVER w) / (max(rms) OVER w - min(rms) OVER w + 1e-8), 6) AS scaled FROM frames WINDOW w AS (PARTITION BY series_id)")
def c2(spark, d):
    return C.minmax_scale(R.frames(spark, d), "rms").select(*K, r6("scaled"))


_ROBUST = "greatest(0.0, least(1.0, ({x} - lo) / (hi - lo)))"


@query("c3_robust_scale", WF + ", p AS (SELECT series_id, quantile_cont(rms, 0.1) AS lo, quantile_cont(rms, 0.9) AS hi FROM frames GROUP BY series_id) SELECT series_id, frame_idx, round(CASE WHEN hi - lo < 1e-8 THEN 0.0 ELSE " + _ROBUST.format(x="rms") + " END, 6) AS scaled FROM frames JOIN p USING (series_id)")
def c3(spark, d):
    return C.robust_scale(R.frames(spark, d), "rms").select(*K, r6("scaled"))


@query("c4_beat_density", WP + " SELECT series_id, frame_idx, (SELECT count(*) FROM points p WHERE p.series_id = f.series_id AND p.t BETWEEN f.t - 3.0 AND f.t + 3.0) / 6.0 AS beat_density FROM frames f".replace("/ 6.0 AS", "/ 6.0 AS").replace("SELECT series_id, frame_idx, (", "SELECT series_id, frame_idx, round((").replace(" / 6.0 AS", " / 6.0, 6) AS"))
def c4(spark, d):
    f = R.frames(spark, d)
    return C.beat_density(f, R.points(f)).select(*K, r6("beat_density"))


_D = range(R.DIMS)


def _unit_sql(eps: str, source: str) -> str:
    return "u AS (SELECT series_id, frame_idx, " + ", ".join(f"x{i} / (sqrt({' + '.join(f'x{j} * x{j}' for j in _D)}) + {eps}) AS u{i}" for i in _D) + f" FROM {source})"


@query(
    "c5_repeatability",
    WV + ", " + _unit_sql("1e-6", "vectors") + ", r AS (SELECT a.series_id, a.frame_idx, coalesce(sum(CASE WHEN abs(a.frame_idx - b.frame_idx) > 5 THEN " + " + ".join(f"a.u{i} * b.u{i}" for i in _D) + " END), 0.0) AS r FROM u a JOIN u b USING (series_id) GROUP BY a.series_id, a.frame_idx) SELECT series_id, frame_idx, round(CASE WHEN max(r) OVER w > min(r) OVER w THEN (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE r END, 6) AS repeatability FROM r WINDOW w AS (PARTITION BY series_id)",
)
def c5(spark, d):
    return C.repeatability(R.vectors(spark, d), R.DIMS, 5).select(*K, r6("repeatability"))


def _cos_sql(a: str, b: str) -> str:
    dot = " + ".join(f"{a}{i} * {b}{i}" for i in _D)
    return f"({dot}) / (sqrt({' + '.join(f'{a}{i} * {a}{i}' for i in _D)}) * sqrt({' + '.join(f'{b}{i} * {b}{i}' for i in _D)}))"


@query(
    "c6_novelty",
    WV + ", m AS (SELECT series_id, frame_idx, count(*) OVER (PARTITION BY series_id) AS n, " + ", ".join(f"avg(x{i}) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a{i}, avg(x{i}) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b{i}" for i in _D)
    + " FROM vectors WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)), r AS (SELECT series_id, frame_idx, CASE WHEN frame_idx >= 5 AND frame_idx < n - 5 THEN 1 - " + _cos_sql("a", "b") + " ELSE 0.0 END AS r FROM m) SELECT series_id, frame_idx, round(CASE WHEN max(r) OVER w > min(r) OVER w THEN (r - min(r) OVER w) / (max(r) OVER w - min(r) OVER w) ELSE r END, 6) AS novelty FROM r WINDOW w AS (PARTITION BY series_id)",
)
def c6(spark, d):
    return C.novelty(R.vectors(spark, d), R.DIMS, 5).select(*K, r6("novelty"))


@query(
    "c7_sequence_repeatability",
    WV + ", s AS (SELECT series_id, frame_idx, CAST(frame_idx / 2 AS INT) AS i, " + ", ".join(f"x{i}" for i in _D) + " FROM vectors WHERE frame_idx % 2 = 0), " + _unit_sql("1e-8", "(SELECT series_id, i AS frame_idx, " + ", ".join(f"x{i}" for i in _D) + " FROM s)")
    + ", p AS (SELECT a.series_id, a.frame_idx AS i, b.frame_idx AS j, b.frame_idx - a.frame_idx AS lag, " + " + ".join(f"a.u{i} * b.u{i}" for i in _D) + " AS sim FROM u a JOIN u b ON a.series_id = b.series_id AND b.frame_idx - a.frame_idx >= 4)"
    + """, z AS (SELECT *, count(*) OVER (PARTITION BY series_id, lag) AS size FROM p)
, q AS (SELECT series_id, i, j, CASE WHEN size >= 4 THEN sum(sim) OVER (PARTITION BY series_id, lag ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4
  WHEN size = 3 THEN sum(sim) OVER (PARTITION BY series_id, lag ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3
  WHEN size = 2 THEN sum(sim) OVER (PARTITION BY series_id, lag ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 ELSE sim END AS q FROM z)
, b AS (SELECT s.series_id, s.i, greatest(0.0, coalesce(max(q.q), 0.0)) AS v FROM s LEFT JOIN q ON q.series_id = s.series_id AND (q.i = s.i OR q.j = s.i) GROUP BY s.series_id, s.i)
, e AS (SELECT v.series_id, v.frame_idx, CASE WHEN v.frame_idx % 2 = 0 OR n.i IS NULL THEN a.v ELSE (a.v + n.v) / 2 END AS v FROM vectors v JOIN b a ON a.series_id = v.series_id AND a.i = v.frame_idx // 2 LEFT JOIN b n ON n.series_id = v.series_id AND n.i = v.frame_idx // 2 + 1)
, l AS (SELECT series_id, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM e GROUP BY series_id) SELECT series_id, frame_idx, round(CASE WHEN hi - lo < 1e-8 THEN 0.0 ELSE """ + _ROBUST.format(x="v") + " END, 6) AS sequence_repeatability FROM e JOIN l USING (series_id)",
)
def c7(spark, d):
    return C.sequence_repeatability(R.vectors(spark, d), 2, 4, 4, 1.0).select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"), r6("sequence_repeatability"))


_BOUNDARY = """, m AS (SELECT series_id, frame_idx, novelty, count(*) OVER (PARTITION BY series_id) AS n, abs(avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) - avg(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) AS e, """ + ", ".join(f"avg({c}) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS a{i}, avg({c}) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b{i}" for i, c in enumerate(("rms", "onset", "bass"))) + """ FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx))
, k AS (SELECT series_id, frame_idx, novelty, CASE WHEN frame_idx >= 1 AND frame_idx < n - 1 THEN e ELSE 0.0 END AS e, CASE WHEN frame_idx >= 1 AND frame_idx < n - 1 AND sqrt(a0*a0+a1*a1+a2*a2) * sqrt(b0*b0+b1*b1+b2*b2) > 1e-8 THEN greatest(0.0, 1 - (a0*b0+a1*b1+a2*b2) / (sqrt(a0*a0+a1*a1+a2*a2) * sqrt(b0*b0+b1*b1+b2*b2))) ELSE 0.0 END AS c FROM m)
, l AS (SELECT series_id, quantile_cont(e, 0.1) AS elo, quantile_cont(e, 0.9) AS ehi, quantile_cont(c, 0.1) AS clo, quantile_cont(c, 0.9) AS chi FROM k GROUP BY series_id)
, boundary AS (SELECT series_id, frame_idx, greatest(0.0, least(1.0, 0.5 * novelty + 0.3 * CASE WHEN ehi - elo < 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, (e - elo) / (ehi - elo))) END + 0.2 * CASE WHEN chi - clo < 1e-8 THEN 0.0 ELSE greatest(0.0, least(1.0, (c - clo) / (chi - clo))) END)) AS boundary_strength FROM k JOIN l USING (series_id))"""


@query("c8_boundary_strength", WF + _BOUNDARY + " SELECT series_id, frame_idx, round(boundary_strength, 6) AS boundary_strength FROM boundary")
def c8(spark, d):
    return C.boundary_strength(R.frames(spark, d), 3, 2).select(*K, r6("boundary_strength"))


@query(
    "c9_pulse_curve",
    WP + ", h AS (SELECT f.series_id, f.frame_idx, CASE WHEN EXISTS (SELECT 1 FROM points p WHERE p.series_id = f.series_id AND CAST(round_even(p.t, 0) AS INT) = f.frame_idx) THEN 1.0 ELSE 0.0 END AS hit FROM frames f) SELECT series_id, frame_idx, round(greatest(0.0, least(1.0, 0.15 * coalesce(lead(hit, 2) OVER w, 0) + 0.45 * coalesce(lead(hit) OVER w, 0) + hit + 0.45 * coalesce(lag(hit) OVER w, 0) + 0.15 * coalesce(lag(hit, 2) OVER w, 0))), 6) AS pulse FROM h WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)", pulse="DOUBLE",
)
def c9(spark, d):
    f = R.frames(spark, d)
    return C.pulse_curve(f, R.points(f), 1.0).select(*K, r6("pulse"))


@query("c10_hook_curve", WF + " SELECT series_id, frame_idx, round(greatest(0.0, least(1.0, 0.40 * bass + 0.30 * vocal + 0.15 * onset + 0.15 * rms)), 6) AS hook FROM frames")
def c10(spark, d):
    return C.hook_curve(R.frames(spark, d), "bass", "vocal", "onset", "rms").select(*K, r6("hook"))


@query("c11_melody_salience", WF + " SELECT series_id, frame_idx, round((1.0 - flatness) * vocal, 6) AS melody_salience FROM frames")
def c11(spark, d):
    return C.melody_salience(R.frames(spark, d), "flatness", "vocal").select(*K, r6("melody_salience"))


def _peaks_sql(name: str, value: str, source: str, threshold: float, dist: int) -> str:
    return f"""{name}_p AS (SELECT series_id, frame_idx AS pos, h FROM (SELECT series_id, frame_idx, {value} AS h, lag({value}) OVER w AS a, lead({value}) OVER w AS b FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)) WHERE h > a AND h > b AND h > {threshold}),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY h DESC, pos) AS r FROM {name}_p),
{name}_g AS (SELECT series_id, 0::BIGINT AS r, []::INT[] AS kept FROM (SELECT DISTINCT series_id FROM {name}_o) UNION ALL SELECT o.series_id, o.r, CASE WHEN len([k FOR k IN g.kept IF abs(o.pos - k) < {dist}]) > 0 THEN g.kept ELSE list_append(g.kept, o.pos) END FROM {name}_g g JOIN {name}_o o ON o.series_id = g.series_id AND o.r = g.r + 1),
{name} AS (SELECT series_id, unnest(arg_max(kept, r)) AS frame_idx FROM {name}_g GROUP BY series_id)"""


WR = f"WITH RECURSIVE {R.FRAMES}"


@query("c12_find_peaks", WR + ", " + _peaks_sql("peaks", "rms", "frames", 0.4, 3) + " SELECT series_id, frame_idx FROM peaks")
def c12(spark, d):
    return C.find_peaks(R.frames(spark, d), "rms", 0.4, 3)


_LEVELS, _RISES = {"rms": 0.9, "bass": 0.97, "novelty": 0.97}, {"rms": 0.7, "vocal": 0.9}
_DIFFS = ", diffs AS (SELECT series_id, frame_idx, " + ", ".join(f"{c} - coalesce(lag({c}) OVER w, {c}) AS d_{c}" for c in _RISES) + " FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx))"
_ANCHORS = (
    _DIFFS + ", " + ", ".join([*[_peaks_sql(f"l{i}", c, "frames", t, 3) for i, (c, t) in enumerate(_LEVELS.items())], *[_peaks_sql(f"d{i}", f"d_{c}", "diffs", t, 3) for i, (c, t) in enumerate(_RISES.items())]])
    + ", found AS (" + " UNION ".join([f"SELECT * FROM l{i}" for i in range(len(_LEVELS))] + [f"SELECT * FROM d{i}" for i in range(len(_RISES))])
    + "), few AS (SELECT f.series_id, max(f.frame_idx) AS last FROM frames f GROUP BY f.series_id HAVING (SELECT count(*) FROM found x WHERE x.series_id = f.series_id) < 9 AND max(f.frame_idx) + 1 - 10 > 10), anchors AS (SELECT * FROM found UNION SELECT series_id, CAST(unnest(generate_series(10, last - 10, 10)) AS INT) FROM few)"
)


def _anchors(f):
    return C.detect_anchors(f, _LEVELS, _RISES, 3, 10, 9)


@query("c13_detect_anchors", WR + _ANCHORS + " SELECT series_id, frame_idx FROM anchors")
def c13(spark, d):
    return _anchors(R.frames(spark, d))


@query("c14_top_anchors", WR + _ANCHORS + " SELECT series_id, frame_idx, rank FROM (SELECT series_id, frame_idx, row_number() OVER (PARTITION BY series_id ORDER BY 0.25 * rms + 0.20 * bass + 0.20 * onset + 0.20 * novelty + 0.15 * vocal DESC, frame_idx) AS rank FROM anchors JOIN frames USING (series_id, frame_idx)) WHERE rank <= 4")
def c14(spark, d):
    f = R.frames(spark, d)
    return C.top_anchors(_anchors(f), f, {"rms": 0.25, "bass": 0.20, "onset": 0.20, "novelty": 0.20, "vocal": 0.15}, 4).select(*K, "rank")


_COVER = ", cov AS (SELECT s.series_id, s.duration, count(DISTINCT p.t) AS n, min(p.t) AS first, max(p.t) AS last FROM series s LEFT JOIN points p ON p.series_id = s.series_id AND p.t >= 0 AND p.t <= s.duration GROUP BY s.series_id, s.duration), cover AS (SELECT *, CASE WHEN n >= 2 AND duration > 0 THEN greatest(0.0, (last - first) / duration) ELSE 0.0 END AS coverage FROM cov)"
_COMPLETE = "n >= 4 AND first <= least(10.0, duration * 0.10) AND last >= greatest(0.0, duration - 10.0) AND coverage >= 0.85"


@query("c15_coverage", WP + _COVER + f" SELECT series_id, n, round(coverage, 6) AS coverage, {_COMPLETE} AS complete FROM cover")
def c15(spark, d):
    f = R.frames(spark, d)
    return P.coverage(R.points(f), R.series(f)).select("series_id", "n", r6("coverage"), "complete")


_FILL = """, g AS (SELECT series_id, t, lead(t) OVER (PARTITION BY series_id ORDER BY t) - t AS gap FROM (SELECT DISTINCT series_id, t FROM points))
, fa AS (SELECT series_id, count(*) AS n, min(t) AS first, max(t) AS last, count(*) FILTER (gap BETWEEN 0.5 AND 6.5) AS ok, quantile_cont(gap, 0.5) FILTER (gap BETWEEN 0.5 AND 6.5) AS step FROM g GROUP BY series_id)
, fx AS (SELECT fa.*, s.duration FROM fa JOIN series s USING (series_id) WHERE fa.n >= 6 AND last - first >= 4 AND ok >= greatest(4, ceil(0.60 * (fa.n - 1))))
, filled AS (SELECT series_id, t FROM g UNION SELECT series_id, first - unnest(generate_series(1, CAST(floor(first / step) AS INT))) * step FROM fx UNION SELECT series_id, last + unnest(generate_series(1, CAST(floor((duration - last) / step) AS INT))) * step FROM fx
  UNION SELECT g.series_id, g.t + unnest(generate_series(1, CAST(round_even(g.gap / fx.step, 0) AS INT) - 1)) * fx.step FROM g JOIN fx USING (series_id) WHERE g.gap > 1.75 * fx.step)"""


@query("c16_fill_grid", WP + _FILL + " SELECT DISTINCT series_id, round(t, 6) AS t FROM filled WHERE t >= 0")
def c16(spark, d):
    f = R.frames(spark, d)
    return P.fill_grid(R.points(f), R.series(f), 6, 4.0, 0.5, 6.5).select("series_id", r6("t")).distinct()


@query(
    "c17_choose_source",
    WP + ", p2 AS (SELECT series_id, CAST(frame_idx AS DOUBLE) AS t FROM frames WHERE event_type IN ('view', 'click'))" + _COVER + _COVER.replace("cov AS", "cov2 AS").replace("points p", "p2 p").replace("cover AS", "cover2 AS").replace("FROM cov)", "FROM cov2)")
    + f", a AS (SELECT series_id, coverage, {_COMPLETE} AS complete FROM cover) SELECT a.series_id, CASE WHEN take THEN 'b' ELSE 'a' END AS source, round(CASE WHEN take THEN cb ELSE ca END, 6) AS coverage FROM (SELECT a.series_id, a.coverage AS ca, b.coverage AS cb, NOT a.complete AND b.n >= 4 AND b.coverage >= greatest(0.60, a.coverage + 0.05) AS take FROM a JOIN cover2 b USING (series_id)) a",
)
def c17(spark, d):
    f = R.frames(spark, d)
    other = f.where("event_type in ('view', 'click')").select("series_id", "t")
    return P.choose_source(P.coverage(R.points(f), R.series(f)), P.coverage(other, R.series(f))).select("series_id", "source", r6("coverage"))


def _phase_sql(name: str, source: str) -> str:
    return f"""{name}_k AS (SELECT series_id, t, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY t)),
{name}_m AS (SELECT p.series_id, p.k % 4 AS phase, coalesce(avg(0.7 * f.novelty + 0.3 * f.onset), 0.0) AS m FROM {name}_k p LEFT JOIN frames f ON f.series_id = p.series_id AND f.frame_idx = CAST(round_even(p.t, 0) AS INT) GROUP BY ALL),
{name}_b AS (SELECT series_id, arg_max(phase, (m, -phase)) AS best FROM {name}_m GROUP BY series_id),
{name} AS (SELECT p.series_id, p.t FROM {name}_k p JOIN {name}_b b USING (series_id) WHERE p.n < 4 OR p.k % 4 = b.best)"""


_GRID = ", " + _phase_sql("down", "points") + ", " + _phase_sql("phr", "down")


@query("c18_metric_grid", WP + _GRID + " SELECT series_id, 'downbeat' AS kind, t FROM down UNION ALL SELECT series_id, 'phrase', t FROM phr")
def c18(spark, d):
    f = R.frames(spark, d)
    return P.metric_grid(R.points(f), f.withColumn("boundary", F.col("novelty")), 1.0)


def _near_sql(points: str) -> str:
    return f"(SELECT min(abs(p.t - f.t)) FROM {points} p WHERE p.series_id = f.series_id)"


@query("c19_nearest_alignment", WP + f" SELECT series_id, frame_idx, round(coalesce(greatest(0.0, 1 - {_near_sql('points')} / 2.5), 0.0), 6) AS alignment FROM frames f")
def c19(spark, d):
    f = R.frames(spark, d)
    return P.nearest_distance(f, R.points(f), K).select(*K, r6(P.alignment(F.col("distance"), 2.5), "alignment"))


_ALIGN = f", al AS (SELECT series_id, frame_idx, {_near_sql('points')} AS d1, {_near_sql('down')} AS d2, {_near_sql('phr')} AS d3 FROM frames f), align AS (SELECT series_id, frame_idx, CASE WHEN d2 IS NULL THEN coalesce(greatest(0.0, 1 - d1 / 0.30), 0.0) ELSE 0.20 * greatest(0.0, 1 - d1 / 0.30) + 0.50 * greatest(0.0, 1 - d2 / 0.45) + 0.30 * coalesce(greatest(0.0, 1 - d3 / 0.65), 0.0) END AS alignment FROM al)"


def aligned(f):
    p = R.points(f)
    g = P.metric_grid(p, f.withColumn("boundary", F.col("novelty")), 1.0)
    return P.metric_alignment(f, p, g.where("kind = 'downbeat'"), g.where("kind = 'phrase'"), K)


@query("c20_metric_alignment", WP + _GRID + _ALIGN + " SELECT series_id, frame_idx, round(alignment, 6) AS alignment FROM align")
def c20(spark, d):
    return aligned(R.frames(spark, d)).select(*K, r6("alignment"))


SCORES = """, sc0 AS (SELECT series_id, frame_idx, vocal AS alignment, novelty AS boundary, onset, coalesce(avg(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) AS b, avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS a FROM frames WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx))
, scores AS (SELECT series_id, frame_idx, greatest(0.0, least(1.0, 0.30 * alignment + 0.25 * boundary + 0.25 * greatest(0.0, least(1.0, 0.5 + 1.25 * (a - b))) + 0.20 * onset)) AS start_score,
  greatest(0.0, least(1.0, 0.35 * alignment + 0.30 * boundary + 0.25 * greatest(0.0, least(1.0, 0.5 + 1.25 * (b - a))) + 0.10 * onset * greatest(0.0, least(1.0, 0.5 + 1.25 * (b - a))))) AS end_score FROM sc0)"""


def scored_frames(spark, d, some: str = "true"):
    """Frames with start and end scores; vocal stands for the alignment, novelty for the boundary. some: which frames there are."""
    f = R.frames(spark, d).where(some).withColumn("alignment", F.col("vocal")).withColumn("boundary", F.col("novelty"))
    return C.metric_boundary_scores(f, 2)


@query("c21_boundary_scores", WF + SCORES + " SELECT series_id, frame_idx, round(start_score, 6) AS start_score, round(end_score, 6) AS end_score FROM scores")
def c21(spark, d):
    return scored_frames(spark, d).select(*K, r6("start_score"), r6("end_score"))


@query("f7_points_in_window", WP + ", w AS (SELECT series_id, unnest(generate_series(0, n - 11, 10)) AS start_idx FROM series WHERE n > 10) SELECT w.series_id, w.start_idx, count(p.t) AS points FROM w LEFT JOIN points p ON p.series_id = w.series_id AND p.t >= w.start_idx AND p.t < w.start_idx + 10 GROUP BY ALL")
def f7(spark, d):
    from seriesmill.operators.windows import frames_in_windows, sliding_windows

    f = R.frames(spark, d)
    w = sliding_windows(R.series(f), 10, 10)
    inside = frames_in_windows(f.select("series_id", "frame_idx", (F.col("event_type") == "purchase").cast("int").alias("p")), w, ["series_id"])
    return inside.groupBy("series_id", "start_idx").agg(F.sum("p").alias("points"))


@query("f8_nearest_point", WP + f" SELECT series_id, frame_idx, {_near_sql('points')} AS distance FROM frames f")
def f8(spark, d):
    f = R.frames(spark, d)
    return P.nearest_distance(f, R.points(f), K).select(*K, "distance")


@query("f9_lag_self_join", WF + " SELECT a.series_id, a.frame_idx, round(a.rms * b.rms, 6) AS product FROM frames a JOIN frames b ON b.series_id = a.series_id AND b.frame_idx = a.frame_idx + 7")
def f9(spark, d):
    from seriesmill.operators.joins import lag_self_join

    return lag_self_join(R.frames(spark, d), "series_id", "frame_idx", "rms", 7, "later").select(*K, r6(F.col("rms") * F.col("later"), "product"))
