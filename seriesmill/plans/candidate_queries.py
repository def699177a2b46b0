"""Queries for windows (D), selection (E) and greedy folds (G) over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.operators import curves as C
from seriesmill.operators import joins
from seriesmill.operators import select as E
from seriesmill.operators import windows as W
from seriesmill.plans import registry
from seriesmill.plans import roles as R
from seriesmill.plans.curve_queries import SCORES, r6, scored_frames
from seriesmill.plans.registry import query
from seriesmill.sources.shared import stored

WF = f"WITH {R.FRAMES}"
WS = f"WITH {R.FRAMES}, {R.SERIES}"
IDS = ["series_id", "start_idx", "end_idx"]
_WIN = ", win AS (SELECT series_id, CAST(s AS INT) AS start_idx, CAST(s + 20 AS INT) AS end_idx FROM (SELECT series_id, unnest(generate_series(0, n - 21, 5)) AS s FROM series WHERE n > 20))"


def _frames(spark, d, some: str = "true"):
    """Frames with scores in all roles; some: which frames the series have."""
    f = scored_frames(spark, d, some)
    return f.select("*", F.col("novelty").alias("flux"), F.col("vocal").alias("synth"), F.col("density").alias("melody"), F.col("bass").alias("repeat"), F.col("vocal").alias("hook"), F.col("flatness").alias("ending"))


def _windows(f):
    return W.sliding_windows(R.series(f), 20, 5)


@query("d1_sliding_windows", WS + _WIN + " SELECT * FROM win")
def d1(spark, d):
    return _windows(R.frames(spark, d))


@query(
    "d2_anchored_windows",
    WS + """, a AS (SELECT series_id, t FROM frames WHERE event_type = 'signup'), x AS (SELECT a.series_id, n, CAST(round_even(greatest(0.0, t - o), 0) AS INT) AS start_idx, du FROM a JOIN series USING (series_id), (VALUES (0.0), (3.0), (6.0)) o(o), (VALUES (12.0), (16.5), (20.0)) d(du))
SELECT DISTINCT series_id, start_idx, start_idx + CAST(round_even(du, 0) AS INT) AS end_idx FROM x WHERE start_idx + CAST(round_even(du, 0) AS INT) < n""",
)
def d2(spark, d):
    f = R.frames(spark, d)
    return W.anchored_windows(f.where("event_type = 'signup'").select("series_id", "t"), R.series(f), [0, 3, 6], [12, 16.5, 20], 1.0)


@query(
    "d3_refine_end",
    WS + _WIN + """, o AS (SELECT w.series_id, w.start_idx, w.end_idx, f.frame_idx, 0.35 * f.vocal + 0.30 * f.novelty + 0.20 * f.rms + 0.10 * f.onset + 0.05 * greatest(0.0, 1 - abs(f.frame_idx - w.end_idx) / 4.0) AS s, abs(f.frame_idx - w.end_idx) AS dist
 FROM win w JOIN series s USING (series_id) JOIN frames f ON f.series_id = w.series_id AND f.frame_idx BETWEEN greatest(w.start_idx + 17, w.end_idx - 4) AND least(s.n - 1, w.start_idx + 23, w.end_idx + 4))
SELECT series_id, start_idx, end_idx, arg_max(frame_idx, (s, -dist, -frame_idx)) AS refined_idx FROM o GROUP BY ALL""",
)
def d3(spark, d):
    f = R.frames(spark, d)
    return W.refine_end(_windows(f), f, 4, 17, 23, {"vocal": 0.35, "novelty": 0.30, "rms": 0.20, "onset": 0.10})


_REFINE = """, sa AS (SELECT w.series_id, w.start_idx, w.end_idx, f.frame_idx AS ra, f.start_score AS ss, row_number() OVER (PARTITION BY w.series_id, w.start_idx, w.end_idx ORDER BY f.start_score DESC, abs(f.frame_idx - w.start_idx), f.frame_idx) AS r FROM (SELECT DISTINCT series_id, start_idx, end_idx FROM {w}) w JOIN scores f ON f.series_id = w.series_id AND f.frame_idx BETWEEN greatest(0, w.start_idx - 4) AND w.start_idx + 4)
, sb AS (SELECT w.series_id, w.start_idx, w.end_idx, f.frame_idx AS rb, f.end_score AS es, row_number() OVER (PARTITION BY w.series_id, w.start_idx, w.end_idx ORDER BY f.end_score DESC, abs(f.frame_idx - w.end_idx), f.frame_idx) AS r FROM (SELECT DISTINCT series_id, start_idx, end_idx FROM {w}) w JOIN scores f ON f.series_id = w.series_id AND f.frame_idx BETWEEN greatest(1, w.end_idx - 4) AND w.end_idx + 4)
, pr AS (SELECT series_id, start_idx, end_idx, arg_max((ra, rb), (0.40 * ss + 0.40 * es + 0.14 * least(ss, es) + 0.06 * greatest(0.0, 1 - abs((rb - ra) - (end_idx - start_idx)) / 8.0), -(abs(ra - start_idx) + abs(rb - end_idx)), -ra, -rb)) AS x
  FROM (SELECT series_id, start_idx, end_idx, ra, ss, rb, es FROM sa JOIN sb USING (series_id, start_idx, end_idx) WHERE sa.r <= {top} AND sb.r <= {top} AND rb - ra BETWEEN {lo} AND {hi}) GROUP BY ALL)
, refined AS (SELECT w.series_id, w.start_idx, w.end_idx, coalesce(pr.x[1], w.start_idx) AS refined_start, coalesce(pr.x[2], w.end_idx) AS refined_end FROM (SELECT DISTINCT series_id, start_idx, end_idx FROM {w}) w LEFT JOIN pr USING (series_id, start_idx, end_idx))"""


@query("d4_refine_both", WS + _WIN + SCORES + _REFINE.format(w="win", top=5, lo=17, hi=23) + " SELECT * FROM refined")
def d4(spark, d):
    f = scored_frames(spark, d)
    return W.refine_both(_windows(f), f, 4, 17, 23, top=5)


_IN = ", ins AS (SELECT w.*, f.*  EXCLUDE (series_id), f.frame_idx - w.start_idx AS k, w.end_idx - w.start_idx AS len FROM win w JOIN frames f ON f.series_id = w.series_id AND f.frame_idx >= w.start_idx AND f.frame_idx < w.end_idx)"


@query(
    "d5_window_features_core",
    WS + _WIN + _IN + """, m AS (SELECT series_id, start_idx, end_idx, avg(rms) AS rms, avg(bass) AS bass, avg(onset) AS onset, avg(density) AS density, avg(novelty) AS flux, quantile_cont(rms, 0.9) - quantile_cont(rms, 0.1) AS contrast, avg(rms) FILTER (k < 10) AS r1, avg(rms) FILTER (k >= 10) AS r2 FROM ins GROUP BY ALL)
, p AS (SELECT m.*, CASE WHEN start_idx < 15 THEN 0.5 * (1 - start_idx / 15.0) ELSE 0.0 END + CASE WHEN end_idx > duration - 15 THEN 0.5 * (1 - (duration - end_idx) / 15.0) ELSE 0.0 END AS edge, CASE WHEN rms < 0.08 THEN 1.0 ELSE 0.0 END + CASE WHEN r2 > 0.1 AND r1 / r2 < 0.2 THEN 0.3 ELSE 0.0 END AS silence FROM m JOIN series USING (series_id))
SELECT series_id, start_idx, end_idx, round(contrast, 6) AS contrast, round(silence, 6) AS silence_penalty, round(edge, 6) AS edge_penalty, round(greatest(0.0, 0.25 * rms + 0.20 * bass + 0.15 * onset + 0.15 * density + 0.15 * flux + 0.10 * contrast - 0.40 * silence - 0.30 * edge), 6) AS core_score FROM p""", silence_penalty="DOUBLE",
)
def d5(spark, d):
    f = _frames(spark, d)
    x = W.window_features_core(f, _windows(f), R.series(f), 15.0, 1.0)
    return x.select(*IDS, *[r6(c) for c in ("contrast", "silence_penalty", "edge_penalty", "core_score")])


_ADV = """, m AS (SELECT series_id, start_idx, end_idx, avg(rms) AS rms, avg(bass) AS bass, avg(onset) AS onset, avg(density) AS density, avg(novelty) AS flux, avg(centroid) AS centroid, avg(flatness) AS flatness, avg(vocal) AS synth, max(onset) AS peak, max(novelty) AS new, max(rms) FILTER (k < 3) AS drop FROM ins GROUP BY ALL)
, q AS (SELECT m.*, (SELECT avg(f.rms) FROM frames f WHERE f.series_id = m.series_id AND f.frame_idx >= m.start_idx - 5 AND f.frame_idx < m.start_idx) AS lead, (SELECT avg(f.rms) FROM frames f WHERE f.series_id = m.series_id AND f.frame_idx >= m.start_idx - 20 AND f.frame_idx < m.start_idx) AS prms, (SELECT avg(f.centroid) FROM frames f WHERE f.series_id = m.series_id AND f.frame_idx >= m.start_idx - 20 AND f.frame_idx < m.start_idx) AS pcen FROM m)
, adv AS (SELECT *, CASE WHEN coalesce(lead, 0.0) > 0 THEN greatest(0.0, drop - lead) ELSE 0.0 END AS spike, coalesce(0.5 * abs(rms - prms) + 0.5 * abs(centroid - pcen), 0.0) AS change FROM q)"""


@query(
    "d6_window_features_advanced",
    WS + _WIN + _IN + _ADV + """ SELECT series_id, start_idx, end_idx, round(spike, 6) AS drop_spike, round(change, 6) AS contrast_prev, round(greatest(0.0, 0.12 * spike * peak + 0.12 * rms * density * bass + 0.08 * new + 0.08 * rms * centroid * onset + 0.08 * density * onset + 0.08 * bass * rms * (1 - centroid) + 0.06 * (1 - centroid) * rms * flux * flatness + 0.06 * peak * bass
 + 0.06 * synth * (1 - flatness) + 0.06 * synth * (1 - flatness) * density + 0.06 * density + 0.06 * bass + 0.04 * change), 6) AS advanced_score FROM adv""",
)
def d6(spark, d):
    f = _frames(spark, d)
    return W.window_features_advanced(f, _windows(f), 5, 3).select(*IDS, *[r6(c) for c in ("drop_spike", "contrast_prev", "advanced_score")])


_U = [f"{c} / (sqrt(rms * rms + onset * onset + bass * bass) + 1e-6)" for c in ("rms", "onset", "bass")]


@query(
    "d7_window_features_dynamic",
    WS + _WIN + _IN + f""", rk AS (SELECT *, row_number() OVER (PARTITION BY series_id, start_idx, end_idx ORDER BY rms, frame_idx) - 1 AS r, list_contains([floor(i * 19 / 11.0) FOR i IN range(12)], k) AS picked, {_U[0]} AS u0, {_U[1]} AS u1, {_U[2]} AS u2 FROM ins)
, m AS (SELECT series_id, start_idx, end_idx, avg(rms) AS rms, avg(onset) FILTER (k < 2) AS o, avg(rms) FILTER (k < 2) AS e, arg_min(k, (-rms, k)) AS top, avg(rms) FILTER (r < 5) AS q, count(*) FILTER (picked) AS s, sum(u0 * u0 + u1 * u1 + u2 * u2) FILTER (picked) AS diag, sum(u0) FILTER (picked) AS s0, sum(u1) FILTER (picked) AS s1, sum(u2) FILTER (picked) AS s2 FROM rk GROUP BY ALL)
, z AS (SELECT m.*, coalesce(e1.flatness, 0.0) AS clean, coalesce(e1.novelty, 0.0) AS n1, e0.novelty AS n0, top / 20.0 AS wh FROM m LEFT JOIN frames e1 ON e1.series_id = m.series_id AND e1.frame_idx = m.end_idx JOIN frames e0 ON e0.series_id = m.series_id AND e0.frame_idx = m.start_idx)
, y AS (SELECT *, CASE WHEN wh >= 0.15 AND wh <= 0.85 THEN 1.0 ELSE greatest(0.0, 1 - least(abs(wh - 0.15), abs(wh - 0.85)) * 4) END AS arc, CASE WHEN s > 1 THEN (s0 * s0 + s1 * s1 + s2 * s2 - diag) / (s * (s - 1)) ELSE 0.0 END AS rep, CASE WHEN q < 0.05 THEN greatest(0.0, 1 - q / 0.05) ELSE 0.0 END + 0.5 * (1 - (20 - 15) / (22 - 15 + 1e-6)) AS pad, o * e AS imp FROM z)
SELECT series_id, start_idx, end_idx, round(imp, 6) AS start_impact, round(arc, 6) AS arc_payoff, round(rep, 6) AS repetition_penalty, round(pad, 6) AS padding_penalty, round(greatest(0.0, 0.15 * imp + 0.10 * clean + 0.15 * rms + 0.15 * arc + 0.10 * greatest(n0, n1) + 0.15 * imp * rms * arc + 0.10 * ((20 - 15) / (30 - 15 + 1e-6)) - 0.15 * rep - 0.15 * pad), 6) AS dynamic_score FROM y""",
)
def d7(spark, d):
    f = _frames(spark, d)
    x = W.window_features_dynamic(f, _windows(f), 2, 15, 22, 26, 30, 1.0, 3, sample=12)
    return x.select(*IDS, *[r6(c) for c in ("start_impact", "arc_payoff", "repetition_penalty", "padding_penalty", "dynamic_score")])


@query(
    "d8_padding_risk",
    WS + _WIN + _IN + """, g AS (SELECT *, rms < 0.3 AS low, row_number() OVER (PARTITION BY series_id, start_idx, end_idx ORDER BY frame_idx) - row_number() OVER (PARTITION BY series_id, start_idx, end_idx, rms < 0.3 ORDER BY frame_idx) AS g FROM ins)
, runs AS (SELECT series_id, start_idx, end_idx, low, g, count(*) AS n FROM g GROUP BY ALL) SELECT series_id, start_idx, end_idx, round(0.65 * sum(CASE WHEN low THEN n ELSE 0 END) / sum(n) + 0.35 * max(CASE WHEN low THEN n ELSE 0 END) / sum(n), 6) AS padding_risk FROM runs GROUP BY ALL""",
)
def d8(spark, d):
    f = R.frames(spark, d)
    return W.padding_risk(f, _windows(f), low=0.3).select(*IDS, r6("padding_risk"))


_NUC = SCORES + """, nw AS (SELECT series_id, CAST(s AS INT) AS start_idx, CAST(s + l AS INT) AS end_idx, l, greatest(0.0, least(1.0, 1 - abs(l - 10) / 10.0)) AS prior FROM (SELECT series_id, l, unnest(generate_series(0, n - l - 1, 4)) AS s FROM series, (VALUES (8), (10), (14)) v(l) WHERE n > l))
, fd AS (SELECT series_id, frame_idx, vocal AS h, rms AS e, abs(vocal - lag(vocal) OVER (PARTITION BY series_id ORDER BY frame_idx)) AS d FROM frames)
, ni AS (SELECT w.*, f.h, f.e, f.d, f.frame_idx - w.start_idx AS k FROM nw w JOIN fd f ON f.series_id = w.series_id AND f.frame_idx >= w.start_idx AND f.frame_idx < w.end_idx)
, nt AS (SELECT *, CASE WHEN k < l // 3 + least(l % 3, 1) THEN 0 WHEN k < 2 * (l // 3) + least(l % 3, 2) THEN 1 ELSE 2 END AS third FROM ni)
, nm AS (SELECT series_id, start_idx, end_idx, prior, avg(h) AS mean_hook, quantile_cont(h, 0.75) AS upper_hook, avg(e) AS energy, avg(e) FILTER (k < 4) AS early, avg(e) FILTER (third = 0) AS t0, avg(e) FILTER (third = 1) AS t1, avg(e) FILTER (third = 2) AS t2, avg(CASE WHEN e < 0.15 THEN 1.0 ELSE 0.0 END) AS low, avg(d) FILTER (k > 0) * 2 AS inst FROM nt GROUP BY ALL)
, np AS (SELECT nm.*, coalesce((SELECT avg(f.rms) FROM frames f WHERE f.series_id = nm.series_id AND f.frame_idx >= nm.start_idx - 6 AND f.frame_idx < nm.start_idx), energy) AS pre, s.start_score AS sb FROM nm JOIN scores s ON s.series_id = nm.series_id AND s.frame_idx = nm.start_idx)
, nx AS (SELECT *, greatest(0.0, least(1.0, 0.5 + 1.25 * (early - pre))) AS lift, greatest(0.0, least(1.0, 0.55 * (0.5 + 1.25 * (greatest(t1, t2) - t0)) + 0.45 * (0.5 + 1.25 * (greatest(t0, t1, t2) - pre)))) AS payoff FROM np)
, nuc AS (SELECT *, greatest(0.0, least(1.0, 0.42 * mean_hook + 0.18 * upper_hook + 0.14 * sb + 0.12 * lift + 0.10 * payoff + 0.04 * prior - 0.08 * low - 0.04 * inst)) AS nucleus_score FROM nx)"""


def _nuclei(f):
    return W.nucleus_proposals(f, [8, 10, 14], 4, 10.0, 6, 4)


@query("d9_nucleus_proposals", WS + _NUC + " SELECT series_id, start_idx, end_idx, round(nucleus_score, 6) AS nucleus_score, round(lift, 6) AS drop_lift, round(payoff, 6) AS payoff, round(upper_hook, 6) AS upper_hook FROM nuc")
def d9(spark, d):
    return _nuclei(_frames(spark, d)).select(*IDS, *[r6(c) for c in ("nucleus_score", "drop_lift", "payoff", "upper_hook")])


# scores are rounded before the fold, so that both engines break ties alike
_SUP = """, sr AS (SELECT series_id, start_idx, end_idx, round(nucleus_score, 6) AS nucleus_score, row_number() OVER (PARTITION BY series_id ORDER BY round(nucleus_score, 6) DESC, start_idx, end_idx) AS r FROM nuc)
, sg AS (SELECT series_id, 0::BIGINT AS r, []::STRUCT(s INT, e INT, n DOUBLE)[] AS kept FROM (SELECT DISTINCT series_id FROM sr) UNION ALL SELECT o.series_id, o.r, CASE WHEN len(g.kept) >= 6 OR len([k FOR k IN g.kept IF abs((o.start_idx + o.end_idx) / 2.0 - (k.s + k.e) / 2.0) < 4.0 OR (least(o.end_idx, k.e) - greatest(o.start_idx, k.s)) / CAST(least(o.end_idx - o.start_idx, k.e - k.s) AS DOUBLE) >= 0.70]) > 0 THEN g.kept
  ELSE list_append(g.kept, {'s': o.start_idx, 'e': o.end_idx, 'n': o.nucleus_score}) END FROM sg g JOIN sr o ON o.series_id = g.series_id AND o.r = g.r + 1)
, sk AS (SELECT series_id, arg_max(kept, r) AS kept FROM sg GROUP BY series_id), sup AS (SELECT series_id, kept[i].s AS start_idx, kept[i].e AS end_idx, kept[i].n AS nucleus_score, 'nucleus_' || lpad(CAST(i AS VARCHAR), 3, '0') AS nucleus_id FROM (SELECT series_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM sk))"""
WR = WS.replace("WITH ", "WITH RECURSIVE ", 1)


def _suppressed(f):
    return W.suppress_nuclei(_nuclei(f).withColumn("nucleus_score", F.round("nucleus_score", 6)), 6)


@query("d10_suppress_nuclei", WR + _NUC + _SUP + " SELECT series_id, nucleus_id, start_idx, end_idx, nucleus_score FROM sup")
def d10(spark, d):
    return _suppressed(_frames(spark, d)).select("series_id", "nucleus_id", "start_idx", "end_idx", "nucleus_score")


_EXP = """, ex0 AS (SELECT u.series_id, u.nucleus_id, u.start_idx AS a, u.end_idx AS b, s.n, l, greatest(least(CAST(round_even((u.start_idx + u.end_idx) / 2.0 - p * l, 0) AS INT), u.start_idx), u.end_idx - l) AS st FROM sup u JOIN series s USING (series_id), (VALUES (16), (20)) x(l), (VALUES (0.25), (0.55)) y(p) WHERE l >= u.end_idx - u.start_idx)
, ex AS (SELECT series_id, nucleus_id, a, b, greatest(0, least(st, CAST(n AS INT) - l - 1)) AS start_idx, least(CAST(n AS INT) - 1, greatest(0, least(st, CAST(n AS INT) - l - 1)) + l) AS end_idx FROM ex0)""" + _REFINE.format(w="ex", top=16, lo=14, hi=24) + """
, ey AS (SELECT ex.series_id, ex.nucleus_id, a, b, CASE WHEN refined_start > a OR refined_end < b THEN ex.start_idx ELSE refined_start END AS start_idx, CASE WHEN refined_start > a OR refined_end < b THEN ex.end_idx ELSE refined_end END AS end_idx FROM ex JOIN refined USING (series_id, start_idx, end_idx))
, expd AS (SELECT DISTINCT series_id, nucleus_id, a AS nucleus_start, b AS nucleus_end, start_idx, end_idx FROM ey WHERE start_idx <= a AND end_idx >= b AND end_idx - start_idx BETWEEN 14 AND 24)"""


def _expanded(f, nuclei):
    return W.expand_nuclei(nuclei, f, [16, 20], (0.25, 0.55), 4, 14, 24)


@query("d11_expand_nuclei", WR + _NUC + _SUP + _EXP + " SELECT * FROM expd")
def d11(spark, d):
    f = stored(_frames(spark, d))
    return _expanded(f, stored(_suppressed(f)))


#: Series of very different lengths, most of them short: a series keeps its first frames only.
_SHORT = WR.replace("frames AS (", "all_frames AS (", 1).replace(", series AS", ", frames AS (SELECT * FROM all_frames WHERE frame_idx < (series_id * 7) % 90), series AS", 1)
_NUC_WHOLE = _NUC.replace("v(l) WHERE n > l))", "v(l) WHERE n > l UNION ALL SELECT series_id, n - 1 AS l, 0 AS s FROM series WHERE n BETWEEN 2 AND 8))", 1)
_EXP_ALL = """, ln AS (SELECT series_id, CAST(n AS INT) AS n, least(24.0, n - 1) AS emax, least(14.0, emax) AS emin, least(greatest(16.0, emin), emax) AS t0, least(greatest(20.0, t0), emax) AS t1 FROM series WHERE n >= 2)
, nu AS (SELECT ln.series_id, coalesce(q.nucleus_id, 'nucleus_001') AS nucleus_id, coalesce(q.start_idx, 0) AS a, coalesce(q.end_idx, least(n - 1, greatest(1, CAST(round_even(emin, 0) AS INT)))) AS b FROM ln LEFT JOIN (SELECT * FROM sup WHERE nucleus_score >= 0.55) q USING (series_id))
, ex0 AS (SELECT nu.*, n, l, greatest(least(CAST(round_even((a + b) / 2.0 - p * l, 0) AS INT), a), b - l) AS st FROM (SELECT DISTINCT series_id, n, greatest(1, CAST(round_even(unnest([emin, t0, (t0 + t1) / 2, t1, emax]), 0) AS INT)) AS l FROM ln) JOIN nu USING (series_id), (VALUES (0.25), (0.40), (0.55)) y(p) WHERE l >= b - a)
, ex AS (SELECT series_id, nucleus_id, a, b, greatest(0, least(st, n - l - 1)) AS start_idx, least(n - 1, greatest(0, least(st, n - l - 1)) + l) AS end_idx FROM ex0)""" + _REFINE.format(w="ex", top=16, lo="(SELECT emin FROM ln WHERE ln.series_id = sa.series_id)", hi="(SELECT emax FROM ln WHERE ln.series_id = sa.series_id)") + """
, ey AS (SELECT ex.series_id, ex.nucleus_id, a, b, CASE WHEN refined_start > a OR refined_end < b THEN ex.start_idx ELSE refined_start END AS start_idx, CASE WHEN refined_start > a OR refined_end < b THEN ex.end_idx ELSE refined_end END AS end_idx FROM ex JOIN refined USING (series_id, start_idx, end_idx))
SELECT DISTINCT series_id, nucleus_id, a AS nucleus_start, b AS nucleus_end, start_idx, end_idx FROM ey JOIN ln USING (series_id) WHERE start_idx <= a AND end_idx >= b AND end_idx - start_idx BETWEEN emin AND emax"""


@query("d11_expand_all_series", _SHORT + _NUC_WHOLE + _SUP + _EXP_ALL)
def d11_all(spark, d):
    """Short series, and quiet ones whose nuclei don't reach a score."""
    f = stored(_frames(spark, d, "frame_idx < pmod(series_id * 7, 90)"))
    nuclei = stored(W.suppress_nuclei(W.nucleus_proposals(f, [8, 10, 14], 4, 10.0, 6, 4, whole=True).withColumn("nucleus_score", F.round("nucleus_score", 6)), 6).where("nucleus_score >= 0.55"))
    return W.expand_all_series(nuclei, f, W.allowed_lengths(R.series(f), 14, 16, 20, 24), (0.25, 0.40, 0.55), 4)


_SC = """, ci AS (SELECT c.*, f.vocal AS hook, f.onset, f.rms, f.frame_idx, f.frame_idx - c.start_idx AS k FROM expd c JOIN frames f ON f.series_id = c.series_id AND f.frame_idx >= c.start_idx AND f.frame_idx < c.end_idx)
, cm AS (SELECT series_id, nucleus_id, nucleus_start, nucleus_end, start_idx, end_idx, avg(hook) AS hook, avg(hook) FILTER (k < 3) AS hook0, quantile_cont(onset, 0.9) FILTER (k < 2) AS o90, avg(rms) FILTER (frame_idx >= nucleus_start AND frame_idx < nucleus_end) AS en, avg(rms) FILTER (frame_idx < nucleus_start) AS pre, avg(rms) FILTER (frame_idx >= nucleus_end) AS post,
   avg(rms) FILTER (frame_idx >= greatest(start_idx, end_idx - 5)) AS c1, avg(rms) FILTER (frame_idx >= greatest(start_idx, end_idx - 10) AND frame_idx < greatest(start_idx, end_idx - 5)) AS c0 FROM ci GROUP BY ALL)
, cg AS (SELECT *, rms < 0.15 AS low, row_number() OVER (PARTITION BY series_id, nucleus_id, start_idx, end_idx ORDER BY frame_idx) - row_number() OVER (PARTITION BY series_id, nucleus_id, start_idx, end_idx, rms < 0.15 ORDER BY frame_idx) AS g FROM ci)
, cr AS (SELECT series_id, nucleus_id, start_idx, end_idx, 0.65 * sum(CASE WHEN low THEN n ELSE 0 END) / sum(n) + 0.35 * max(CASE WHEN low THEN n ELSE 0 END) / sum(n) AS pad FROM (SELECT series_id, nucleus_id, start_idx, end_idx, low, g, count(*) AS n FROM cg GROUP BY ALL) GROUP BY ALL)
, cs AS (SELECT cm.*, a.start_score AS sb, b.end_score AS eb, sup.nucleus_score AS ns, s.n, cr.pad, coalesce(pre, en) AS pre1, coalesce(post, en) AS post1, cm.end_idx - cm.start_idx AS len, (cm.nucleus_start + cm.nucleus_end) / 2.0 AS ctr FROM cm JOIN scores a ON a.series_id = cm.series_id AND a.frame_idx = cm.start_idx JOIN scores b ON b.series_id = cm.series_id AND b.frame_idx = cm.end_idx JOIN sup ON sup.series_id = cm.series_id AND sup.nucleus_id = cm.nucleus_id JOIN series s ON s.series_id = cm.series_id JOIN cr ON cr.series_id = cm.series_id AND cr.nucleus_id = cm.nucleus_id AND cr.start_idx = cm.start_idx AND cr.end_idx = cm.end_idx)
, ct AS (SELECT *, greatest(0.0, least(1.0, 0.55 * hook0 + 0.25 * o90 + 0.20 * sb)) AS oh, greatest(0.0, least(1.0, 0.65 * greatest(0.0, least(1.0, 0.5 + 1.25 * (en - pre1))) + 0.35 * greatest(0.0, least(1.0, 0.5 + 1.25 * (en - post1))))) AS arc, sqrt(greatest(0.0, sb * eb)) AS bq,
  CASE WHEN len BETWEEN 17 AND 21 THEN 1.0 WHEN len < 17 THEN greatest(0.0, least(1.0, (len - 14) / 3.0)) ELSE greatest(0.0, least(1.0, (24 - len) / 3.0)) END AS fit, greatest(0.0, least(1.0, 1 - abs((ctr - start_idx) / greatest(1.0, len) - 0.35) / 0.45)) AS pos, greatest(0.0, least(1.0, 1 - abs(ctr / greatest(1.0, n - 1) - 0.5) / 0.5)) AS song,
  greatest(0.0, least(1.0, 0.6 * greatest(0, nucleus_end - greatest(start_idx, end_idx - 5)) / greatest(1, nucleus_end - nucleus_start) + 0.8 * greatest(0.0, coalesce(c1, 0.0) - coalesce(c0, 0.0)))) AS cta FROM cs)
, cu AS (SELECT *, greatest(0.0, least(1.0, 0.60 * ns + 0.10 * arc + 0.15 * bq + 0.15 * song)) AS ev, greatest(0.0, least(1.0, 0.30 * greatest(0.0, least(1.0, 0.55 * oh + 0.45 * hook)) + 0.25 * bq + 0.15 * fit + 0.15 * pos + 0.10 * (1 - pad) + 0.05 * (1 - cta))) AS ed FROM ct)"""


@query("d12_score_candidates", WR + _NUC + _SUP + _EXP + _SC + " SELECT series_id, nucleus_id, start_idx, end_idx, round(ev, 6) AS event_score, round(ed, 6) AS edit_score, round(greatest(0.0, least(1.0, 0.85 * ev + 0.15 * ed)), 6) AS structure_score, round(arc, 6) AS measured_arc FROM cu")
def d12(spark, d):
    f = stored(_frames(spark, d))
    n = stored(_suppressed(f))
    x = W.score_candidates(stored(_expanded(f, n)), f, n, 3, 2, 5, 14, 17, 21, 24)
    return x.select("series_id", "nucleus_id", "start_idx", "end_idx", *[r6(c) for c in ("event_score", "edit_score", "structure_score")], r6(F.col("breakdown")["measured_arc"], "measured_arc"))


WC = f"WITH {R.CANDIDATES}"
WCR = f"WITH RECURSIVE {R.CANDIDATES}"


@query("d13_number_candidates", WC + " SELECT series_id, candidate_id AS source_id, 'candidate_' || lpad(CAST(row_number() OVER (PARTITION BY series_id ORDER BY quality_score DESC, start_time, end_time) AS VARCHAR), 4, '0') AS candidate_id FROM cand")
def d13(spark, d):
    c = R.candidates(spark, d).withColumnRenamed("candidate_id", "source_id")
    return E.number_candidates(c, "quality_score").select("series_id", "source_id", "candidate_id")


@query("d14_blend_preference", WC + " SELECT candidate_id, round(CASE WHEN series_id % 3 <> 0 THEN 0.85 * quality_score + 0.15 * greatest(0.0, least(1.0, CASE WHEN candidate_id % 7 = 0 THEN 0.5 ELSE (candidate_id % 50) / 40.0 END)) ELSE quality_score END, 12) AS quality_score FROM cand")
def d14(spark, d):
    c = R.candidates(spark, d).withColumnRenamed("quality_score", "structure_score")
    p = F.when(F.col("candidate_id") % 7 == 0, float("nan")).otherwise((F.col("candidate_id") % 50) / 40.0)
    return E.blend_preference(c, p, F.col("series_id") % 3 != 0).select("candidate_id", F.round("quality_score", 12).alias("quality_score"))


@query("d15_quality_percentile", WC + " SELECT candidate_id, round((row_number() OVER (PARTITION BY series_id ORDER BY quality_score, candidate_id) - 1) / CAST(greatest(1, count(*) OVER (PARTITION BY series_id) - 1) AS DOUBLE), 6) AS quality_percentile FROM cand")
def d15(spark, d):
    return E.quality_percentile(R.candidates(spark, d), "quality_score", "candidate_id").select("candidate_id", r6("quality_percentile"))


_CL = """, o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY quality_score DESC, start_time, end_time, candidate_id) AS r FROM cand)
, g AS (SELECT series_id, 0::BIGINT AS r, 0::BIGINT AS cl, 0::BIGINT AS candidate_id, []::STRUCT(s DOUBLE, e DOUBLE, ns DOUBLE, ne DOUBLE)[] AS lead FROM (SELECT DISTINCT series_id FROM cand)
 UNION ALL SELECT series_id, r, CASE WHEN m > 0 THEN m ELSE len(lead) + 1 END, candidate_id, CASE WHEN m > 0 THEN lead ELSE list_append(lead, x) END FROM (
  SELECT o.series_id, o.r, o.candidate_id, g.lead, {'s': o.start_time, 'e': o.end_time, 'ns': o.nucleus_start, 'ne': o.nucleus_end} AS x,
   coalesce(list_position([abs((o.nucleus_start + o.nucleus_end) / 2 - (k.ns + k.ne) / 2) <= 8.0 OR greatest(0.0, least(o.nucleus_end, k.ne) - greatest(o.nucleus_start, k.ns)) / greatest(1e-6, least(o.nucleus_end - o.nucleus_start, k.ne - k.ns)) >= 0.5 OR greatest(0.0, least(o.end_time, k.e) - greatest(o.start_time, k.s)) / greatest(1e-6, least(o.end_time - o.start_time, k.e - k.s)) >= 0.85 FOR k IN g.lead], true), 0) AS m
  FROM g JOIN o ON o.series_id = g.series_id AND o.r = g.r + 1))
, cl AS (SELECT o.*, g.cl AS cluster, row_number() OVER (PARTITION BY o.series_id, g.cl ORDER BY o.r) = 1 AS is_champion, count(*) OVER (PARTITION BY o.series_id, g.cl) AS size FROM o JOIN g USING (series_id, r))
, fl AS (SELECT *, max(quality_score) OVER (PARTITION BY series_id) AS best, max(quality_score) OVER (PARTITION BY series_id) * 0.6 AS floor FROM cl)
, rr AS (SELECT *, CASE WHEN is_champion AND cluster <= 3 AND (quality_score >= floor OR cluster = 1) THEN NULL WHEN NOT is_champion THEN 'alternate_of_stronger_champion' WHEN quality_score < floor THEN 'below_quality_floor' ELSE 'outside_requested_count' END AS rejection_reason FROM fl)"""


@query("e1_cluster_events", WCR + _CL + " SELECT series_id, candidate_id, cluster, is_champion FROM cl")
def e1(spark, d):
    return E.cluster_events(R.candidates(spark, d)).select("series_id", "candidate_id", "cluster", "is_champion")


@query("e2_select_champions", WCR + _CL + " SELECT series_id, candidate_id, cluster FROM rr WHERE rejection_reason IS NULL")
def e2(spark, d):
    return E.select_champions(R.candidates(spark, d), 3, ratio=0.6).select("series_id", "candidate_id", "cluster")


@query("e3_annotate_selection", WCR + _CL + " SELECT series_id, candidate_id, row_number() OVER (PARTITION BY series_id ORDER BY cluster) AS selection_rank, row_number() OVER (PARTITION BY series_id ORDER BY start_time, end_time, cluster) AS timeline_order, 'event_' || lpad(CAST(cluster AS VARCHAR), 3, '0') AS event_id, round(greatest(0.0, least(1.0, quality_score / greatest(best, 1e-8))), 6) AS confidence, size - 1 AS event_alternatives FROM rr WHERE rejection_reason IS NULL")
def e3(spark, d):
    x = E.annotate_selection(R.candidates(spark, d), 3, ratio=0.6)
    return x.select("series_id", "candidate_id", "selection_rank", "timeline_order", "event_id", r6("confidence"), "event_alternatives")


@query("e4_rejection_reasons", WCR + _CL + " SELECT series_id, candidate_id, r AS quality_rank, rejection_reason FROM rr")
def e4(spark, d):
    return E.rejection_reasons(R.candidates(spark, d), 3, ratio=0.6).select("series_id", "candidate_id", "quality_rank", "rejection_reason")


@query("e5_candidate_summary", WCR + _CL + " SELECT series_id, count(*) AS generated, count(*) FILTER (is_champion) AS event_clusters, count(*) FILTER (is_champion AND quality_score >= floor) AS above_floor, count(*) FILTER (rejection_reason IS NULL) AS selected, round(max(floor), 6) AS floor FROM rr GROUP BY series_id")
def e5(spark, d):
    x = E.candidate_summary(E.rejection_reasons(R.candidates(spark, d), 3, ratio=0.6))
    return x.select("series_id", "generated", "event_clusters", "above_floor", "selected", r6("floor"))


_OV = "(CASE WHEN least(c.end_time, k.e) - greatest(c.start_time, k.s) <= 0 THEN 0.0 ELSE (least(c.end_time, k.e) - greatest(c.start_time, k.s)) / greatest(1e-6, least(c.end_time - c.start_time, k.e - k.s)) END)"
_GP = "(CASE WHEN least(c.end_time, k.e) - greatest(c.start_time, k.s) > 0 THEN 0.0 ELSE greatest(0.0, (15.0 - greatest(0.0, greatest(c.start_time, k.s) - least(c.end_time, k.e))) / 15.0) END)"


@query(
    "e6_select_diverse",
    WCR + f""", sc AS (SELECT series_id, greatest(max(abs(quality_score)), 1e-6) AS scale FROM cand GROUP BY series_id)
, g AS (SELECT series_id, 0 AS pick, []::STRUCT(s DOUBLE, e DOUBLE, id BIGINT)[] AS kept, NULL::BIGINT AS candidate_id FROM sc
 UNION ALL SELECT series_id, pick + 1, list_append(kept, {{'s': x[2], 'e': x[3], 'id': x[1]}}), x[1] FROM (SELECT g.series_id, g.pick, any_value(g.kept) AS kept, arg_max((c.candidate_id, c.start_time, c.end_time), (c.quality_score - sc.scale * (0.75 * coalesce(list_max([{_OV} FOR k IN g.kept]), 0.0) + 0.15 * coalesce(list_max([{_GP} FOR k IN g.kept]), 0.0)), c.quality_score, c.end_time - c.start_time, -c.start_time, c.start_time, c.end_time, c.candidate_id)) AS x
  FROM g JOIN sc USING (series_id) JOIN cand c USING (series_id) WHERE g.pick < 3 AND NOT list_contains([k.id FOR k IN g.kept], c.candidate_id) AND (len(g.kept) = 0 OR coalesce(list_max([{_OV} FOR k IN g.kept]), 0.0) < 0.92) GROUP BY g.series_id, g.pick))
SELECT series_id, pick, candidate_id FROM g WHERE pick > 0""",
)
def e6(spark, d):
    x = E.select_diverse(R.candidates(spark, d), 3, score="quality_score")
    return x.select("series_id", "pick", "candidate_id")


_NEAR = "greatest(0.0, 1 - abs(p - k.p) / 400.0)"


@query(
    "g2_greedy_marginal",
    f"""WITH RECURSIVE part AS (SELECT l_orderkey AS grp, l_linenumber AS item, max(l_extendedprice) / 100000.0 AS s, CAST(max(l_partkey) AS DOUBLE) AS p FROM lineitem GROUP BY ALL)
, g AS (SELECT grp, 0 AS pick, []::STRUCT(p DOUBLE, item INT)[] AS kept, NULL::INT AS item FROM part GROUP BY grp
 UNION ALL SELECT grp, pick + 1, list_append(kept, {{'p': x[1], 'item': x[2]}}), x[2] FROM (SELECT g.grp, g.pick, any_value(g.kept) AS kept, arg_max((c.p, c.item), (c.s - coalesce(list_max([{_NEAR} FOR k IN g.kept]), 0.0), -c.item)) AS x
  FROM g JOIN part c USING (grp) WHERE g.pick < 3 AND NOT list_contains([k.item FOR k IN g.kept], c.item) AND len([k FOR k IN g.kept IF abs(c.p - k.p) < 20]) = 0 GROUP BY g.grp, g.pick))
SELECT grp, pick, item FROM g WHERE pick > 0""",
)
def g2(spark, d):
    from seriesmill.operators.greedy import greedy_marginal

    part = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("item")).agg((F.max("l_extendedprice") / 100000.0).alias("s"), F.max("l_partkey").cast("double").alias("p"))
    near = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x["p"] - y["p"]) / 400.0)
    return greedy_marginal(part, ["grp"], "item", F.col("s"), ["p"], 3, near, lambda x, y: F.abs(x["p"] - y["p"]) < 20).select("grp", "pick", "item")


@query("e7_topk_per_series", WC + " SELECT series_id, candidate_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY quality_score DESC, candidate_id) AS rank FROM cand) WHERE rank <= 3")
def e7(spark, d):
    return E.top_k(R.candidates(spark, d), [F.desc("quality_score"), F.col("candidate_id")], 3).select("series_id", "candidate_id", "rank")


@query("f6_interval_overlap_join", WC + " SELECT a.series_id, a.candidate_id AS a_id, b.candidate_id AS b_id, round((least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time)) / greatest(1e-6, least(a.end_time - a.start_time, b.end_time - b.start_time)), 6) AS ratio FROM cand a JOIN cand b ON a.series_id = b.series_id AND a.candidate_id < b.candidate_id WHERE least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) > 0 AND (least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time)) / greatest(1e-6, least(a.end_time - a.start_time, b.end_time - b.start_time)) >= 0.5")
def f6(spark, d):
    c = R.candidates(spark, d)
    return joins.interval_overlap_join(c, c, "series_id", 0.5, 64.0, ("candidate_id", "candidate_id")).where("a_id < b_id").select("series_id", "a_id", "b_id", r6("ratio"))


@query("f2_attach_selection", WCR + _CL + " SELECT cand.candidate_id, rr.cluster FROM cand LEFT JOIN rr ON rr.candidate_id = cand.candidate_id AND rr.rejection_reason IS NULL")
def f2(spark, d):
    c = R.candidates(spark, d)
    s = E.select_champions(c, 3, ratio=0.6).select("candidate_id", "cluster")
    return c.select("candidate_id").join(s, "candidate_id", "left")


@query("g1_greedy_suppress", "WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS r FROM lineitem), g AS (SELECT k, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT k FROM o) UNION ALL SELECT o.k, o.r, CASE WHEN len([x FOR x IN g.kept IF abs(x - o.pk) < 300]) > 0 THEN g.kept ELSE list_append(g.kept, o.pk) END FROM g JOIN o ON o.k = g.k AND o.r = g.r + 1) SELECT k AS l_orderkey, unnest(arg_max(kept, r)) AS l_partkey FROM g GROUP BY k")
def g1(spark, d):
    from seriesmill.operators.greedy import greedy_suppress

    x = R.table(spark, d, "lineitem")
    order = [(-F.col("l_extendedprice")).alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3")]
    return greedy_suppress(x, ["l_orderkey"], order, ["l_partkey"], lambda a, b: F.abs(a["l_partkey"] - b["l_partkey"]) < 300).select("l_orderkey", "l_partkey")


# ---------------------------------------------------------------- endings from their components

_ENDINGS = f", {R.POINTS}, ending AS (SELECT f.*, coalesce(greatest(0.0, 1 - (SELECT min(abs(p.t - f.t)) FROM points p WHERE p.series_id = f.series_id) / 0.35), 0.0) AS beat, greatest(0.0, coalesce(avg(rms) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0.0) - avg(rms) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) AS release FROM frames f WINDOW w AS (PARTITION BY series_id ORDER BY frame_idx)), clean AS (SELECT *, 0.45 * beat + 0.30 * novelty + 0.15 * release + 0.10 * onset AS cleanliness FROM ending)"


def _ending_frames(spark, d):
    f = _frames(spark, d)
    return C.ending_components(f, R.points(f), 2)


@query("c21_ending_components", WS + _ENDINGS + " SELECT series_id, frame_idx, round(beat, 6) AS beat, round(release, 6) AS release, round(cleanliness, 6) AS ending_cleanliness FROM clean")
def c21_endings(spark, d):
    return _ending_frames(spark, d).select("series_id", "frame_idx", *[r6(c) for c in ("beat", "release", "ending_cleanliness")])


@query("d3_refine_computed_end", registry.sql_of("d3_refine_end").replace(" o AS (", _ENDINGS[2:] + ", o AS (", 1).replace("0.35 * f.vocal", "0.35 * f.beat").replace("0.20 * f.rms", "0.20 * f.release").replace("JOIN frames f ON", "JOIN ending f ON"))
def d3_computed(spark, d):
    f = stored(_ending_frames(spark, d))
    return W.refine_end(_windows(f), f, 4, 17, 23, {"beat": 0.35, "novelty": 0.30, "release": 0.20, "onset": 0.10})


@query("d7_dynamic_with_endings", registry.sql_of("d7_window_features_dynamic").replace(" rk AS (", _ENDINGS[2:] + ", rk AS (", 1).replace("coalesce(e1.flatness, 0.0) AS clean", "coalesce(e1.cleanliness, 0.0) AS clean").replace("LEFT JOIN frames e1", "LEFT JOIN clean e1"))
def d7_endings(spark, d):
    f = stored(_ending_frames(spark, d))
    x = W.window_features_dynamic(f, _windows(f), 2, 15, 22, 26, 30, 1.0, 3, sample=12, clean="ending_cleanliness")
    return x.select(*IDS, *[r6(c) for c in ("start_impact", "arc_payoff", "repetition_penalty", "padding_penalty", "dynamic_score")])


# ---------------------------------------------------------------- greedy by rounds: groups of any size


@query("g1_suppress_by_rounds", registry.sql_of("g1_greedy_suppress"))
def g1_rounds(spark, d):
    from seriesmill.operators.greedy import suppress_by_rounds

    x = R.table(spark, d, "lineitem").withColumn("lo", F.col("l_partkey") - 150).withColumn("hi", F.col("l_partkey") + 150)
    order = [(-F.col("l_extendedprice")).alias("o1"), F.col("l_linenumber").alias("o2"), F.col("l_partkey").alias("o3")]
    return suppress_by_rounds(x, ["l_orderkey"], order, ["l_partkey"], lambda a, b: F.abs(a["l_partkey"] - b["l_partkey"]) < 300, "lo", "hi", 300.0).select("l_orderkey", "l_partkey")


@query("e1_clusters_by_rounds", registry.sql_of("e1_cluster_events"))
def e1_rounds(spark, d):
    return E.cluster_events_by_rounds(R.candidates(spark, d), width=60.0).select("series_id", "candidate_id", "cluster", "is_champion")


@query("g2_marginal_by_rounds", registry.sql_of("g2_greedy_marginal"))
def g2_rounds(spark, d):
    from seriesmill.operators.greedy import marginal_by_rounds

    part = R.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("item")).agg((F.max("l_extendedprice") / 100000.0).alias("s"), F.max("l_partkey").cast("double").alias("p"))
    near = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x["p"] - y["p"]) / 400.0)
    return marginal_by_rounds(part, ["grp"], "item", F.col("s"), ["p"], 3, near, lambda x, y: F.abs(x["p"] - y["p"]) < 20).select("grp", "pick", "item")


@query("d10_suppress_by_rounds", registry.sql_of("d10_suppress_nuclei"))
def d10_rounds(spark, d):
    proposals = stored(_nuclei(_frames(spark, d)).withColumn("nucleus_score", F.round("nucleus_score", 6)))
    return W.suppress_nuclei(proposals, 6, rounds=True).select("series_id", "nucleus_id", "start_idx", "end_idx", "nucleus_score")
