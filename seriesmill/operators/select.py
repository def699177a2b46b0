"""Ranking and selection of candidates (series_id, candidate_id, start_time, end_time, quality...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import clip01, gap_closeness, interval_overlap_ratio, is_finite
from seriesmill.operators.greedy import clusters_by_rounds, leader_clusters

KEY = "series_id"


def number_candidates(df: DataFrame, score: str) -> DataFrame:
    """candidate_no and candidate_id in order of falling score, start, end within the series."""
    w = Window.partitionBy(KEY).orderBy(F.desc(score), "start_time", "end_time")
    return df.withColumn("candidate_no", F.row_number().over(w)).withColumn("candidate_id", F.format_string("candidate_%04d", F.col("candidate_no")))


def blend_preference(df: DataFrame, preference: Column, enabled: Column, weight: float = 0.15, structure: str = "structure_score") -> DataFrame:
    """quality_score: (1 - weight) structure + weight preference where the model is enabled, else the structure; a preference that isn't finite counts as one half."""
    p = clip01(F.when(is_finite(preference), preference).otherwise(0.5))
    return df.withColumn("preference_score", F.when(enabled, p).otherwise(0.5)).withColumn("quality_score", F.when(enabled, (1 - weight) * F.col(structure) + weight * p).otherwise(F.col(structure)))


def quality_percentile(df: DataFrame, quality: str, position: str) -> DataFrame:
    """Rank by rising quality, then position, over the number of candidates less one: equal qualities differ."""
    w = Window.partitionBy(KEY)
    return df.withColumn("quality_percentile", (F.row_number().over(w.orderBy(quality, position)) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1))


def top_k(df: DataFrame, order: list[Column], k: int, by: str = KEY) -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows a task before the shuffle's sort."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def same_event(overlap: float = 0.5, tolerance: float = 8.0, edit: float = 0.85):
    """The rule by which a candidate belongs to a leader's event: nuclei close or overlapping, or almost the same edit; intervals alone where a nucleus is missing."""

    def rule(x: Column, y: Column) -> Column:
        both = interval_overlap_ratio(x["start_time"], x["end_time"], y["start_time"], y["end_time"])
        centre = F.abs((x["nucleus_start"] + x["nucleus_end"]) / 2 - (y["nucleus_start"] + y["nucleus_end"]) / 2)
        nucleus = (centre <= tolerance) | (interval_overlap_ratio(x["nucleus_start"], x["nucleus_end"], y["nucleus_start"], y["nucleus_end"]) >= overlap)
        known = x["nucleus_start"].isNotNull() & x["nucleus_end"].isNotNull() & y["nucleus_start"].isNotNull() & y["nucleus_end"].isNotNull()
        return F.when(known, nucleus | (both >= edit)).otherwise(both >= overlap)

    return rule


_CARRY = ["start_time", "end_time", "nucleus_start", "nucleus_end"]


def _order(quality: str) -> list[Column]:
    return [(-F.col(quality)).alias("o1"), F.col("start_time").alias("o2"), F.col("end_time").alias("o3"), F.col("candidate_id").alias("o4")]


def cluster_events(df: DataFrame, quality: str = "quality_score", overlap: float = 0.5, tolerance: float = 8.0) -> DataFrame:
    """df's rows of finite quality with cluster (1 is the best leader's) and is_champion."""
    good = df.where(is_finite(F.col(quality)))
    got = leader_clusters(good, [KEY], _order(quality), "candidate_id", _CARRY, same_event(overlap, tolerance))
    return good.join(got.withColumnRenamed("is_leader", "is_champion"), [KEY, "candidate_id"])


def cluster_events_by_rounds(df: DataFrame, quality: str = "quality_score", overlap: float = 0.5, tolerance: float = 8.0, width: float = 60.0) -> DataFrame:
    """The rows of cluster_events, for series with any number of candidates; start_time and end_time aren't null. width: about a candidate's length."""
    centre = (F.col("nucleus_start") + F.col("nucleus_end")) / 2
    good = df.where(is_finite(F.col(quality))).withColumn("_lo", F.least("start_time", "nucleus_start", centre - tolerance / 2)).withColumn("_hi", F.greatest("end_time", "nucleus_end", centre + tolerance / 2))
    got = clusters_by_rounds(good, [KEY], _order(quality), "candidate_id", _CARRY, same_event(overlap, tolerance), "_lo", "_hi", width)
    return good.drop("_lo", "_hi").join(got.withColumnRenamed("is_leader", "is_champion"), [KEY, "candidate_id"])


def with_floor(clustered: DataFrame, quality: str = "quality_score", ratio: float = 0.94, absolute: float | None = None) -> DataFrame:
    """quality_rank, floor, and champion_rank (of champions) within each series."""
    s = Window.partitionBy(KEY)
    floor = F.max(quality).over(s) * max(0.0, ratio)
    if absolute is not None:
        floor = F.greatest(floor, F.lit(float(absolute)))
    out = clustered.withColumn("floor", floor).withColumn("quality_rank", F.row_number().over(s.orderBy(F.desc(quality), "start_time", "end_time", "candidate_id")))
    return out.withColumn("champion_rank", F.when(F.col("is_champion"), F.col("cluster")))


def select_champions(df: DataFrame, k: int = 5, quality: str = "quality_score", ratio: float = 0.94, absolute: float | None = None) -> DataFrame:
    """The best candidate of each event, best events first: those at or above the floor (at least one), k at most."""
    ranked = with_floor(cluster_events(df, quality), quality, ratio, absolute)
    return ranked.where(F.col("is_champion") & (F.col("champion_rank") <= k) & ((F.col(quality) >= F.col("floor")) | (F.col("champion_rank") == 1)))


def annotate_selection(df: DataFrame, k: int = 5, quality: str = "quality_score", ratio: float = 0.94, absolute: float | None = None) -> DataFrame:
    """select_champions with selection_rank, timeline_order, event_id, confidence and the number of alternatives of the event."""
    ranked = with_floor(cluster_events(df, quality), quality, ratio, absolute)
    ranked = ranked.withColumn("event_alternatives", F.count(F.lit(1)).over(Window.partitionBy(KEY, "cluster")) - 1).withColumn("_best", F.max(quality).over(Window.partitionBy(KEY)))
    chosen = ranked.where(F.col("is_champion") & (F.col("champion_rank") <= k) & ((F.col(quality) >= F.col("floor")) | (F.col("champion_rank") == 1)))
    s = Window.partitionBy(KEY)
    return (
        chosen.withColumn("selection_rank", F.row_number().over(s.orderBy("champion_rank"))).withColumn("timeline_order", F.row_number().over(s.orderBy("start_time", "end_time", "champion_rank")))
        .withColumn("event_id", F.format_string("event_%03d", F.col("champion_rank").cast("int"))).withColumn("confidence", clip01(F.col(quality) / F.greatest(F.col("_best"), F.lit(1e-8)))).drop("_best")
    )


def rejection_reasons(df: DataFrame, k: int = 5, quality: str = "quality_score", ratio: float = 0.94, absolute: float | None = None) -> DataFrame:
    """Every candidate with the reason why it isn't selected; null for those that are."""
    ranked = with_floor(cluster_events(df, quality), quality, ratio, absolute)
    chosen = F.col("is_champion") & (F.col("champion_rank") <= k) & ((F.col(quality) >= F.col("floor")) | (F.col("champion_rank") == 1))
    reason = F.when(chosen, F.lit(None).cast("string")).when(~F.col("is_champion"), "alternate_of_stronger_champion").when(F.col(quality) < F.col("floor"), "below_quality_floor").otherwise("outside_requested_count")
    return ranked.withColumn("rejection_reason", reason)


def candidate_summary(reasons: DataFrame, quality: str = "quality_score") -> DataFrame:
    """One row for each series: generated, event_clusters, above_floor, selected, floor."""
    return reasons.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if("is_champion").alias("event_clusters"), F.count_if(F.col("is_champion") & (F.col(quality) >= F.col("floor"))).alias("above_floor"),
        F.count_if(F.col("rejection_reason").isNull()).alias("selected"), F.max("floor").alias("floor"),
    )


def select_diverse(df: DataFrame, k: int = 5, min_gap: float = 15.0, overlap_penalty: float = 0.75, gap_penalty: float = 0.15, duplicate: float = 0.92, score: str = "combined_score") -> DataFrame:
    """k rounds in each series: the candidate with the largest score less penalties for overlap with, and closeness to, those already chosen.

    Candidates that overlap a chosen one by `duplicate` or more are left out. Ties: score, duration, earlier start. A
    native fold over the series' candidates (a bounded list), in rows of (series_id, pick, candidate_id, adjusted_score).
    """
    row = F.struct(F.col(score).alias("s"), F.col("start_time").alias("a"), F.col("end_time").alias("b"), "candidate_id")
    g = df.groupBy(KEY).agg(F.array_sort(F.collect_list(row)).alias("all"), F.greatest(F.max(F.abs(score)), F.lit(1e-6)).alias("scale"))
    kind = "array<struct<adj:double,s:double,d:double,na:double,a:double,b:double,candidate_id:%s>>" % df.schema["candidate_id"].dataType.simpleString()

    def pick(acc: Column, _: Column) -> Column:
        most = lambda x, f: F.aggregate(acc, F.lit(0.0), lambda m, y: F.greatest(m, f(x["a"], x["b"], y["a"], y["b"])))
        over = lambda x: most(x, interval_overlap_ratio)
        near = lambda x: most(x, lambda a, b, c, d: gap_closeness(a, b, c, d, min_gap))
        free = F.filter("all", lambda x: ~F.exists(acc, lambda y: y["candidate_id"] == x["candidate_id"]) & ((F.size(acc) == 0) | (over(x) < duplicate)))
        scored = F.transform(free, lambda x: F.struct((x["s"] - F.col("scale") * (overlap_penalty * over(x) + gap_penalty * near(x))).alias("adj"), x["s"].alias("s"), (x["b"] - x["a"]).alias("d"), (-x["a"]).alias("na"), x["a"].alias("a"), x["b"].alias("b"), x["candidate_id"].alias("candidate_id")))
        best = F.array_max(scored)
        return F.when(best.isNull(), acc).otherwise(F.concat(acc, F.array(best)))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(kind), pick)
    out = g.select(KEY, F.posexplode(chosen).alias("p", "x"))
    return out.select(KEY, (F.col("p") + 1).alias("pick"), F.col("x.candidate_id").alias("candidate_id"), F.col("x.adj").alias("adjusted_score"), F.col("x.a").alias("start_time"), F.col("x.b").alias("end_time"))
