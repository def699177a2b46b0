"""Queries for the scalar library (B) over orders, lineitem and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill.functions import scalars as S
from seriesmill.operators import joins
from seriesmill.plans.registry import query
from seriesmill.plans.roles import CANDIDATES, candidates, table


@query("b1_clip01", "SELECT l_orderkey, l_linenumber, greatest(0.0, least(1.0, l_quantity / 25.0 - 0.5)) AS x FROM lineitem")
def b1(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.clip01(F.col("l_quantity") / 25.0 - 0.5).alias("x"))


@query("b2_finite_or", "SELECT doc_id, coalesce(CASE WHEN isfinite(try_cast(regexp_extract(text, '^[^ ]*[0-9.]+', 0) AS DOUBLE)) THEN try_cast(regexp_extract(text, '^[^ ]*[0-9.]+', 0) AS DOUBLE) END, 0.5) AS x FROM documents")
def b2(spark, d):
    return table(spark, d, "documents").select("doc_id", S.finite_or(F.regexp_extract("text", "^[^ ]*[0-9.]+", 0), 0.5).alias("x"))


_PAIRS = f"WITH {CANDIDATES}, p AS (SELECT series_id, candidate_id, start_time AS s, end_time AS e, lead(start_time) OVER w AS s2, lead(end_time) OVER w AS e2 FROM cand WINDOW w AS (PARTITION BY series_id ORDER BY start_time, candidate_id)) "


def _pairs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("start_time", "candidate_id")
    c = candidates(spark, d)
    return c.select("series_id", "candidate_id", F.col("start_time").alias("s"), F.col("end_time").alias("e"), F.lead("start_time").over(w).alias("s2"), F.lead("end_time").over(w).alias("e2")).where("s2 is not null")


@query("b3_interval_overlap_ratio", _PAIRS + "SELECT series_id, candidate_id, CASE WHEN least(e, e2) - greatest(s, s2) <= 0 THEN 0.0 ELSE round((least(e, e2) - greatest(s, s2)) / greatest(1e-6, least(e - s, e2 - s2)), 9) END AS ratio FROM p WHERE s2 IS NOT NULL")
def b3(spark, d):
    return _pairs(spark, d).select("series_id", "candidate_id", F.round(S.interval_overlap_ratio(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")), 9).alias("ratio"))


@query("b4_gap_closeness", _PAIRS + "SELECT series_id, candidate_id, CASE WHEN least(e, e2) - greatest(s, s2) > 0 THEN 0.0 ELSE round(greatest(0.0, (100.0 - greatest(0.0, greatest(s, s2) - least(e, e2))) / 100.0), 9) END AS closeness FROM p WHERE s2 IS NOT NULL")
def b4(spark, d):
    return _pairs(spark, d).select("series_id", "candidate_id", F.round(S.gap_closeness(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"), 100.0), 9).alias("closeness"))


@query("b5_distance_to_interval", _PAIRS + "SELECT series_id, candidate_id, greatest(s2 - s, s - e2, 0.0) AS distance FROM p WHERE s2 IS NOT NULL")
def b5(spark, d):
    return _pairs(spark, d).select("series_id", "candidate_id", S.distance_to_interval(F.col("s"), F.col("s2"), F.col("e2")).alias("distance"))


@query("b6_duration_fit", f"WITH {CANDIDATES}, x AS (SELECT candidate_id, end_time - start_time AS d FROM cand) SELECT candidate_id, round(CASE WHEN d BETWEEN 32 AND 45 THEN 1.0 WHEN d < 32 THEN greatest(0.0, least(1.0, (d - 25) / 7.0)) ELSE greatest(0.0, least(1.0, (55 - d) / 10.0)) END, 9) AS fit FROM x")
def b6(spark, d):
    return candidates(spark, d).select("candidate_id", F.round(S.duration_fit(F.col("end_time") - F.col("start_time"), 25, 32, 45, 55), 9).alias("fit"))


@query("b7_tail_window", f"WITH {CANDIDATES}, x AS (SELECT candidate_id, end_time - start_time AS d FROM cand) SELECT candidate_id, greatest(0.0, d - least(d, 30.0)) AS start, least(d, 30.0) AS length FROM x")
def b7(spark, d):
    return candidates(spark, d).select("candidate_id", S.tail_window(F.col("end_time") - F.col("start_time"), 30.0).alias("w")).select("candidate_id", "w.start", "w.length")


@query("b8_required_clips", "SELECT o_orderkey, CAST(ceil(o_totalprice / (1 + o_orderkey % 9)) AS BIGINT) AS clips FROM orders")
def b8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.required_clips(F.col("o_totalprice"), 1 + F.col("o_orderkey") % 9).alias("clips"))


@query("b9_crossfade", "SELECT o_orderkey, CASE WHEN o_totalprice <= 4.0 THEN 1 ELSE CAST(ceil((o_totalprice - 0.5) / (4.0 - 0.5)) AS BIGINT) END AS clips, round((o_orderkey % 50 + 1) * 4.0 - (o_orderkey % 50) * 0.5, 6) AS duration FROM orders", duration="DOUBLE")
def b9(spark, d):
    n = F.col("o_orderkey") % 50 + 1
    return table(spark, d, "orders").select("o_orderkey", S.required_crossfade_clips(F.col("o_totalprice"), F.lit(4.0), F.lit(0.5)).alias("clips"), F.round(S.crossfade_duration(n, F.lit(4.0), F.lit(0.5)), 6).alias("duration"))


@query("b10_crossfade_offsets", "SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) * 3.5 AS off FROM lineitem", off="DOUBLE")
def b10(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) * F.lit(4.0 - 0.5)).alias("off"))


@query("b11_effective_seed", "SELECT o_orderkey, (o_custkey * 7919 + (o_orderkey % 6) * 104729) % 2147483648 AS seed, round(least(0.30, 0.15 + 0.05 * (o_orderkey % 6)), 9) AS scale FROM orders", scale="DOUBLE")
def b11(spark, d):
    k = F.col("o_orderkey") % 6
    return table(spark, d, "orders").select("o_orderkey", S.effective_seed(F.col("o_custkey") * 7919, k).alias("seed"), F.round(S.noise_scale(k), 9).alias("scale"))


@query("b12_settings_hash", """SELECT page_id, sha256('{"bytes":' || strlen(html) || ',"contract_version":6,"url":' || to_json(url) || '}') AS settings_sha256 FROM pages""")
def b12(spark, d):
    return table(spark, d, "pages").select("page_id", S.settings_hash({"url": F.col("url"), "bytes": F.octet_length("html")}, 6).alias("settings_sha256"))


@query(
    "b13_audit_settings",
    """WITH s AS (SELECT o_orderkey, 32 * (1 + o_custkey % 40) + CASE WHEN o_orderkey % 5 = 0 THEN 8 ELSE 0 END AS width, 8 * (o_orderkey % 30) + CASE WHEN o_custkey % 4 = 0 THEN 3 ELSE 1 END AS frames, o_totalprice - 2000 AS budget, o_orderkey % 70 AS shortest, o_custkey % 90 AS longest FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN width % 32 <> 0 THEN 'width' END, CASE WHEN frames % 8 <> 1 THEN 'frames' END, CASE WHEN budget <= 0 THEN 'budget' END, CASE WHEN shortest > longest THEN 'lengths' END) AS violations FROM s""",
)
def b13(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = table(spark, d, "orders").select(
        "o_orderkey", (32 * (1 + c % 40) + F.when(k % 5 == 0, 8).otherwise(0)).alias("width"), (8 * (k % 30) + F.when(c % 4 == 0, 3).otherwise(1)).alias("frames"),
        (F.col("o_totalprice") - 2000).alias("budget"), (k % 70).alias("shortest"), (c % 90).alias("longest"),
    )
    return s.select("o_orderkey", F.array_join(S.audit_settings(*[F.col(x) for x in ("width", "frames", "budget", "shortest", "longest")]), ",").alias("violations"))


@query("b14_round_half_even", "SELECT o_orderkey, round_even((o_orderkey % 1000) / 8.0, 2) AS x, round_even((o_orderkey % 101) / 2.0, 0) AS y FROM orders")
def b14(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.round_half_even((k % 1000) / 8.0, 2).alias("x"), S.round_half_even((k % 101) / 2.0).alias("y"))


@query("f10_cross_expand", "SELECT s_suppkey, o, p FROM supplier, (VALUES (0), (3), (6)) a(o), (VALUES (0.25), (0.55)) b(p)", p="DOUBLE")
def f10(spark, d):
    return joins.cross_expand(table(spark, d, "supplier").select("s_suppkey"), o=[0, 3, 6], p=[0.25, 0.55]).select("s_suppkey", "o", "p")
