"""Evaluation of a ranking against past choices: pairing of reports, ranks of the chosen interval, hit@k and MRR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import distance_to_interval
from seriesmill.sources.shared import stored


def pair_reports(a: DataFrame, b: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(run_id, mismatch): the first metadata key that is missing or differs between two sets of reports, then the path; null if all agree."""
    x, y = a.select("run_id", *[F.col(c).alias(f"a_{c}") for c in [*keys, path]]), b.select("run_id", *[F.col(c).alias(f"b_{c}") for c in [*keys, path]])
    both = x.join(y, "run_id")
    tests = []
    for k in keys:
        tests += [F.when(F.col(f"a_{k}").isNull() | F.col(f"b_{k}").isNull(), f"missing {k}"), F.when(F.col(f"a_{k}") != F.col(f"b_{k}"), f"mismatch {k}")]
    tests += [F.when(F.col(f"a_{path}").isNull() | F.col(f"b_{path}").isNull(), f"missing {path}"), F.when(F.col(f"a_{path}") != F.col(f"b_{path}"), f"mismatch {path}")]
    return both.select("run_id", F.coalesce(*tests).alias("mismatch"))


def evaluate_ranking(champions: DataFrame, choices: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """One row for each choice (run_id, chosen_start, chosen_end) whose run has champions (run_id, quality, quality_rank, nucleus_start, nucleus_end).

    Champions are ranked by falling quality, then quality_rank. matched_rank: best rank whose nucleus centre is within
    the tolerance of the chosen interval, or null; closest_rank and closest_distance: of the nearest centre; selected:
    how many champions the run has.
    """
    w = Window.partitionBy("run_id").orderBy(F.desc("quality"), "quality_rank")
    ranked = champions.withColumn("rank", F.row_number().over(w))
    d = distance_to_interval((F.col("nucleus_start") + F.col("nucleus_end")) / 2, F.col("chosen_start"), F.col("chosen_end"))
    m = ranked.join(choices, "run_id").withColumn("d", d)
    return m.groupBy("run_id").agg(F.min(F.when(F.col("d") <= tolerance, F.col("rank"))).alias("matched_rank"), F.min_by("rank", F.struct("d", "rank")).alias("closest_rank"), F.min("d").alias("closest_distance"), F.count(F.lit(1)).alias("selected"))


def first_per_track(df: DataFrame, track: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(track).orderBy(order))).where("_n = 1").drop("_n")


def exact_median(rows: DataFrame, value: str, bins: int = 1000) -> float | None:
    """The median of the values that aren't null, or None: counts by bins of about equal size, then only the middle bin's values in order.

    rows is read three times, so it should be a stored table. The driver gets one count for each bin. A bin of equal
    values, such as one that most rows tie in, gives its value without being put in order.
    """
    x = rows.select(F.col(value).cast("double").alias("v")).where("v is not null")
    edges = sorted(set(x.approxQuantile("v", [k / bins for k in range(1, bins)], 0.25 / bins))) if bins > 1 else []
    place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v"))) if edges else F.lit(0)
    counts = sorted((r["b"], r["n"], r["low"], r["high"]) for r in x.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect())
    n = sum(c for _, c, _, _ in counts)
    if not n:
        return None
    got = []
    for want in sorted({(n - 1) // 2, n // 2}):
        before = 0
        for b, c, low, high in counts:
            if want < before + c:
                break
            before += c
        if low == high:
            got.append(low)
            continue
        at = x.where(place == b).withColumn("r", F.row_number().over(Window.orderBy("v"))).where(F.col("r") == want - before + 1)
        got.append(at.first()["v"])
    return (got[0] + got[-1]) / 2


def ranking_metrics(labelled: DataFrame, evaluated: DataFrame, track: str = "track", order: str = "run_id") -> DataFrame:
    """One row over labelled runs (run_id, track) and those of them that evaluate_ranking could evaluate.

    Of each track the first evaluated run counts: tracks, hit_at_1, hit_at_3, hit_at_5, mrr (a miss counts 0),
    median_distance, mean_selected; and over all runs: labelled, evaluated, duplicate (of a track that counts already)
    and skipped. Without evaluated runs rates and mrr are 0, and the median and mean are null.
    """
    w = Window.partitionBy(track).orderBy(F.col("matched").isNull(), order)
    rows = labelled.select("run_id", track).join(evaluated.withColumn("matched", F.lit(1)), "run_id", "left")
    rows = stored(rows.withColumn("first", (F.row_number().over(w) == 1) & F.col("matched").isNotNull()))
    one, rank = F.col("first"), F.col("matched_rank")
    hit = lambda k: F.coalesce(F.avg(F.when(one, F.when(rank <= k, 1.0).otherwise(0.0))), F.lit(0.0)).alias(f"hit_at_{k}")
    median = exact_median(rows.where("first"), "closest_distance")
    counts = rows.agg(
        F.count_if(one).alias("tracks"), hit(1), hit(3), hit(5), F.coalesce(F.avg(F.when(one, F.when(rank.isNull(), 0.0).otherwise(1.0 / rank))), F.lit(0.0)).alias("mrr"), F.avg(F.when(one, F.col("selected"))).alias("mean_selected"),
        F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("matched").isNotNull()).alias("evaluated"),
    )
    return counts.withColumn("median_distance", F.lit(median).cast("double")).withColumn("duplicate", F.col("evaluated") - F.col("tracks")).withColumn("skipped", F.col("labelled") - F.col("evaluated"))
