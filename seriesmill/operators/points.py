"""Operators on irregular points in time (series_id, t): coverage, grid repair, metric phase, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_id"


def coverage(points: DataFrame, series: DataFrame, head: float = 10.0, tail: float = 10.0, share: float = 0.85) -> DataFrame:
    """(series_id, duration, n, first, last, coverage, complete) of every row of series (series_id, duration).

    Points outside the series are left out and repeated ones count once. complete: at least 4 points, which begin within
    the head (10 s or a tenth of the duration), end within the tail, and span the share of the duration.
    """
    inside = series.join(points, KEY, "left").where("t is null or (t >= 0 and t <= duration)")
    got = inside.groupBy(KEY).agg(F.max("duration").alias("duration"), F.countDistinct("t").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    every = series.select(KEY, F.col("duration").alias("d")).join(got, KEY, "left")
    d = F.col("d")
    cover = F.when((F.col("n") >= 2) & (d > 0), F.greatest(F.lit(0.0), (F.col("last") - F.col("first")) / d)).otherwise(0.0)
    ok = (F.col("n") >= 4) & (F.col("first") <= F.least(F.lit(head), d * 0.10)) & (F.col("last") >= F.greatest(F.lit(0.0), d - tail)) & (cover >= share)
    return every.select(KEY, d.alias("duration"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "first", "last", cover.alias("coverage"), F.coalesce(ok, F.lit(False)).alias("complete"))


def fill_grid(points: DataFrame, series: DataFrame, least: int = 12, span: float = 4.0, shortest: float = 0.20, longest: float = 2.50) -> DataFrame:
    """(series_id, t): the points, extended by their median plausible interval to both ends and over gaps of more than 1.75 intervals.

    A series stays as it is if it has fewer than `least` points, spans less than `span`, or if fewer than 60 % of its
    intervals (4 at least) are plausible.
    """
    w = Window.partitionBy(KEY).orderBy("t")
    p = points.select(KEY, "t").distinct().withColumn("gap", F.lead("t").over(w) - F.col("t"))
    good = (F.col("gap") >= shortest) & (F.col("gap") <= longest)
    facts = p.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.count_if(good).alias("ok"), F.percentile(F.when(good, F.col("gap")), 0.5).alias("step"))
    facts = facts.where((F.col("n") >= least) & (F.col("last") - F.col("first") >= span) & (F.col("ok") >= F.greatest(F.lit(4), F.ceil(0.60 * (F.col("n") - 1))))).join(series.select(KEY, "duration"), KEY)
    step = F.col("step")
    upto = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    before = facts.where(F.col("first") >= step).withColumn("i", upto(F.floor(F.col("first") / step))).select(KEY, (F.col("first") - F.col("i") * step).alias("t"))
    ahead = facts.where(F.col("last") + step <= F.col("duration")).withColumn("i", upto(F.floor((F.col("duration") - F.col("last")) / step))).select(KEY, (F.col("last") + F.col("i") * step).alias("t"))
    holes = p.join(facts.select(KEY, "step"), KEY).where(F.col("gap") > 1.75 * step).withColumn("k", F.rint(F.col("gap") / step).cast("int") - 1).where("k >= 1")
    inner = holes.withColumn("i", upto(F.col("k"))).select(KEY, (F.col("t") + F.col("i") * step).alias("t"))
    return p.select(KEY, "t").unionByName(before).unionByName(ahead).unionByName(inner).where("t >= 0").distinct()


def choose_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """(series_id, source, coverage) from two coverage tables: b replaces a only with 4 points or more and a coverage of at least 0.60 and a's plus 0.05."""
    x, y = a.select(KEY, F.col("coverage").alias("ca"), "complete"), b.select(KEY, F.col("coverage").alias("cb"), F.col("n").alias("nb"))
    take = ~F.col("complete") & (F.coalesce("nb", F.lit(0)) >= 4) & (F.coalesce("cb", F.lit(0.0)) >= F.greatest(F.lit(0.60), F.col("ca") + 0.05))
    return x.join(y, KEY, "left").select(KEY, F.when(take, "b").otherwise("a").alias("source"), F.when(take, F.col("cb")).otherwise(F.col("ca")).alias("coverage"))


def metric_phase(points: DataFrame, frames: DataFrame, fps: float, boundary: str = "boundary", onset: str = "onset", period: int = 4) -> DataFrame:
    """(series_id, t): the points of the phase of `period` with the largest mean strength (0.7 boundary + 0.3 onset), the first phase of equals.

    Series with fewer than `period` points keep them all. A phase none of whose points has a frame has strength 0.
    """
    w = Window.partitionBy(KEY)
    p = points.withColumn("k", F.row_number().over(w.orderBy("t")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("phase", F.pmod("k", F.lit(period)))
    s = frames.select(KEY, F.col("frame_idx").alias("at"), (0.7 * F.col(boundary) + 0.3 * F.col(onset)).alias("s"))
    q = p.withColumn("at", F.rint(F.col("t") * fps).cast("int")).join(s, [KEY, "at"], "left")
    mean = q.groupBy(KEY, "phase").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("m"))
    best = mean.groupBy(KEY).agg(F.max_by("phase", F.struct("m", -F.col("phase"))).alias("best"))
    return p.join(best, KEY).where((F.col("n") < period) | (F.col("phase") == F.col("best"))).select(KEY, "t")


def metric_grid(points: DataFrame, frames: DataFrame, fps: float) -> DataFrame:
    """(series_id, kind, t): downbeats among the points, and phrases among the downbeats."""
    down = metric_phase(points, frames, fps)
    phrase = metric_phase(down, frames, fps)
    return down.select(KEY, F.lit("downbeat").alias("kind"), "t").unionByName(phrase.select(KEY, F.lit("phrase").alias("kind"), "t"))


def nearest_distance(queries: DataFrame, points: DataFrame, ids: list[str]) -> DataFrame:
    """ids, t and distance to the nearest point (null if the series has none): an as-of join in both directions by a sort each way."""
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in ids if c != KEY]
    both = queries.select(KEY, "t", *[c for c in ids if c != KEY], F.lit(None).cast("double").alias("p")).unionByName(points.select(KEY, "t", *none, F.col("t").alias("p")))
    running = lambda by: Window.partitionBy(KEY).orderBy(by).rangeBetween(Window.unboundedPreceding, 0)
    back, ahead = F.max("p").over(running(F.col("t"))), F.min("p").over(running(F.desc("t")))
    near = both.withColumn("_b", back).withColumn("_a", ahead).where("p is null")
    return near.select(*ids, "t", F.least(F.col("t") - F.col("_b"), F.col("_a") - F.col("t")).alias("distance"))


def alignment(distance: Column, tolerance: float) -> Column:
    """1 at a point, falling to 0 at the tolerance; 0 without points."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / max(tolerance, 1e-6)), F.lit(0.0))


def metric_alignment(frames: DataFrame, beats: DataFrame, downbeats: DataFrame, phrases: DataFrame, ids: list[str]) -> DataFrame:
    """ids and alignment: 0.20 beat + 0.50 downbeat + 0.30 phrase, with tolerances .30, .45 and .65; the beat alone in series without downbeats."""
    one = nearest_distance(frames, beats, ids).select(*ids, F.col("distance").alias("d1"))
    two = nearest_distance(frames, downbeats, ids).select(*ids, F.col("distance").alias("d2"))
    three = nearest_distance(frames, phrases, ids).select(*ids, F.col("distance").alias("d3"))
    m = one.join(two, ids).join(three, ids)
    beat = alignment(F.col("d1"), 0.30)
    return m.select(*ids, F.when(F.col("d2").isNull(), beat).otherwise(0.20 * beat + 0.50 * alignment(F.col("d2"), 0.45) + 0.30 * alignment(F.col("d3"), 0.65)).alias("alignment"))
