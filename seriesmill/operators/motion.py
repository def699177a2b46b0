"""Frame motion over tables of grey frames (video_id, frame_idx, pixels array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import is_finite
from seriesmill.operators.evaluate import exact_median
from seriesmill.sources.shared import stored


def to_gray(r: Column, g: Column, b: Column, luma: bool = True) -> Column:
    """Luma of the channels (0.299, 0.587, 0.114), or their plain mean; arrays of equal length."""
    rg = F.zip_with(r, g, lambda x, y: x * 0.299 + y * 0.587 if luma else x + y)
    return F.zip_with(rg, b, lambda x, y: x + y * 0.114 if luma else (x + y) / 3.0)


def _mad(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def frame_pair_diff(frames: DataFrame, changed: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """(keys, frame_idx, mad, changed_pct, duplicate) of each frame against the one before; pairs never cross a key."""
    by = by or ["video_id"]
    w = Window.partitionBy(*by).orderBy("frame_idx")
    p = frames.withColumn("_p", F.lag("pixels").over(w)).where("_p is not null")
    share = F.size(F.filter(F.zip_with("pixels", "_p", lambda x, y: F.abs(x - y)), lambda d: d >= changed)) * 100.0 / F.size("pixels")
    return p.select(*by, "frame_idx", _mad(F.col("pixels"), F.col("_p")).alias("mad"), share.alias("changed_pct"), (F.col("pixels") == F.col("_p")).alias("duplicate"))


def motion_metrics(pairs: DataFrame, by: list[str] | None = None, fps: float = 24.0) -> DataFrame:
    """For each key: pairs, frames (one more than pairs), duration in seconds, and statistics of the pairs."""
    frames = F.count(F.lit(1)) + 1
    return pairs.groupBy(*(by or ["video_id"])).agg(
        F.count(F.lit(1)).alias("pairs"), frames.alias("frames"), (frames / fps).alias("duration"), F.max("changed_pct").alias("max_changed_pct"), F.avg("mad").alias("mean_mad"), F.percentile("mad", 0.5).alias("median_mad"), F.max("mad").alias("max_mad"), F.avg("changed_pct").alias("mean_changed_pct"), F.count_if("duplicate").alias("duplicates")
    )


def first_last_mad(frames: DataFrame) -> DataFrame:
    m = frames.groupBy("video_id").agg(F.min_by("pixels", "frame_idx").alias("a"), F.max_by("pixels", "frame_idx").alias("b"))
    return m.select("video_id", _mad(F.col("a"), F.col("b")).alias("first_last_mad"))


def temporal_stddev(frames: DataFrame) -> DataFrame:
    """Population deviation over time of each pixel, averaged over the pixels."""
    p = frames.select("video_id", F.posexplode("pixels").alias("at", "x")).groupBy("video_id", "at").agg(F.stddev_pop("x").alias("s"))
    return p.groupBy("video_id").agg(F.avg("s").alias("temporal_stddev"))


def classify_motion(mad: Column, changed: Column) -> Column:
    return F.when((mad < 0.25) & (changed < 0.5), "static").when((mad < 0.75) & (changed < 2.0), "minimal").otherwise("visible")


def segment_motion(frames: DataFrame, frames_per_segment: int, most: int | None = None) -> DataFrame:
    """motion_metrics of each fixed-length segment, as many as a video has frames for, or up to `most` of them; a video's list ends before its first segment of fewer than two frames."""
    x = frames.withColumn("segment", F.floor(F.col("frame_idx") / frames_per_segment))
    sizes = x.groupBy("video_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    stop = sizes.where("n < 2").groupBy("video_id").agg(F.min("segment").alias("stop"))
    m = motion_metrics(frame_pair_diff(x, by=["video_id", "segment"]), ["video_id", "segment"])
    return m.join(stop, "video_id", "left").where(F.col("stop").isNull() | (F.col("segment") < F.col("stop"))).where(F.lit(True) if most is None else F.col("segment") < most).drop("stop")


def motion_summary(metrics: DataFrame) -> DataFrame:
    """One row over the classes; shares and means are null without rows. The median is exact and found by bins, not in one task."""
    metrics = stored(metrics)
    c = classify_motion(F.col("mean_mad"), F.col("mean_changed_pct"))
    return metrics.withColumn("c", c).agg(*[F.count_if(F.col("c") == k).alias(k) for k in ("static", "minimal", "visible")], F.avg("mean_mad").alias("mean_mad"), F.lit(exact_median(metrics, "mean_mad")).cast("double").alias("median_mad"), F.avg("mean_changed_pct").alias("mean_changed_pct"), (F.count_if(F.col("c") == "static") * 100.0 / F.count(F.lit(1))).alias("static_pct"))


def motion_gate(metrics: DataFrame, least_mad: float = 0.5, least_changed: float = 2.0) -> DataFrame:
    return metrics.where((F.col("mean_mad") >= least_mad) & (F.col("mean_changed_pct") >= least_changed))


def anchor_similarity(pairs: DataFrame, ids: list[str], a: str, b: str, flat: float = 7.5) -> DataFrame:
    """ids and similarity: Pearson correlation of two vectors, or 1 - MAD / 255 if either's deviation is below `flat`."""
    x = pairs.select(*ids, F.explode(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).alias("x")).select(*ids, "x.a", "x.b")
    m = x.groupBy(*ids).agg(F.corr("a", "b").alias("r"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mad"))
    return m.select(*ids, F.when((F.col("sa") < flat) | (F.col("sb") < flat), 1 - F.col("mad") / 255.0).otherwise(F.col("r")).alias("similarity"))


def anchor_gate(similarities: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """by and passed: whether all samples of a clip are finite and at least `least`; a null sample fails."""
    ok = F.coalesce(is_finite(F.col("similarity")) & (F.col("similarity") >= least), F.lit(False))
    return similarities.groupBy(*by).agg(F.bool_and(ok).alias("passed"))


def error_summary(df: DataFrame, problem: Column) -> DataFrame:
    """One row: good and bad rows, in one pass."""
    return df.select(problem.alias("e")).agg(F.count_if(F.col("e").isNull()).alias("good"), F.count_if(F.col("e").isNotNull()).alias("bad"))


def isolate_errors(df: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with column error): problem is a message, or null for a good row."""
    x = df.withColumn("error", problem)
    return x.where("error is null").drop("error"), x.where("error is not null")
