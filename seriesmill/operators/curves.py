"""Operators on feature curves: tables of frames (series_id, frame_idx, t, curves...), one row for each frame.

Most shuffle by series_id only, so a chain of them keeps one partitioning. Frame windows are bounded or running, so a
window's work for a frame doesn't grow with the series; sequence_repeatability alone compares frames pairwise.
repeatability, novelty and sequence_repeatability work by blocks of a series, so that a series may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import clip01, is_finite, weighted_sum
from seriesmill.operators.blocks import block_of, group_percentiles, group_totals, with_group_rows
from seriesmill.sources.shared import stored

KEY, ORDER = "series_id", "frame_idx"
#: A block of a series has 2^_BITS frames.
_BITS = 8


def _series():
    return Window.partitionBy(KEY)


def _rows(a: int, b: int):
    return Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(a, b)


def resample_linear(samples: DataFrame, fps: float, value: str = "v", t: str = "t") -> DataFrame:
    """(series_id, grid_idx, t, value): samples on a regular grid from 0 to the last sample's time, linear between samples, flat beyond them.

    Samples at the same time: the last in value order counts. A series of one sample is constant.
    """
    s = samples.groupBy(KEY, F.col(t).alias("t")).agg(F.max(value).alias("v"))
    grid = s.groupBy(KEY).agg(F.floor(F.max("t") * fps).alias("n")).select(KEY, F.explode(F.sequence(F.lit(0), F.col("n"))).alias("grid_idx"))
    both = s.select(KEY, "t", "v", F.lit(None).cast("long").alias("grid_idx")).unionByName(grid.select(KEY, (F.col("grid_idx") / fps).alias("t"), F.lit(None).cast("double").alias("v"), "grid_idx"))
    back = Window.partitionBy(KEY).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(KEY).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)  # running frames on both sides
    at = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    near = both.withColumn("a", F.max(at).over(back)).withColumn("b", F.min(at).over(ahead)).where("grid_idx is not null")
    lerp = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    v = F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("a.t") == F.col("b.t")), F.col("a.v")).otherwise(lerp)
    return near.select(KEY, "grid_idx", "t", v.alias("v"))


def minmax_scale(frames: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    low, high = F.min(value).over(_series()), F.max(value).over(_series())
    return frames.withColumn(out, (F.col(value) - low) / (high - low + 1e-8))


def robust_scale(frames: DataFrame, value: str, out: str = "scaled", low: float = 0.10, high: float = 0.90) -> DataFrame:
    """Scaled so that the low and high percentiles of the finite values become 0 and 1, and clipped; 0 everywhere if they are less than 1e-8 apart.

    NaN and null count as the low percentile, infinities as the clip's ends; percentiles are exact, one aggregate for each series.
    """
    x = F.when(is_finite(F.col(value)), F.col(value))
    edges = frames.groupBy(KEY).agg(F.percentile(x, low).alias("_lo"), F.percentile(x, high).alias("_hi"))
    filled = F.when(F.col(value).isNull() | F.isnan(value), F.col("_lo")).otherwise(F.col(value))
    scaled = F.when(F.col("_hi").isNull() | (F.col("_hi") - F.col("_lo") < 1e-8), F.lit(0.0)).otherwise(clip01((filled - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    return frames.join(edges, KEY).withColumn(out, scaled).drop("_lo", "_hi")


def beat_density(frames: DataFrame, points: DataFrame, half: float = 3.0) -> DataFrame:
    """Points within `half` seconds of each frame, by second: one sort of frames and points together, no range join."""
    both = frames.select(KEY, ORDER, "t", F.lit(0).alias("p")).unionByName(points.select(KEY, F.lit(None).cast("int").alias(ORDER), "t", F.lit(1).alias("p")))
    near = F.expr(f"sum(p) OVER (PARTITION BY {KEY} ORDER BY t RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING)")
    return both.withColumn("beat_density", near / (2 * half)).where(F.col(ORDER).isNotNull()).select(KEY, ORDER, "beat_density")


def _unit(v: Column, eps: float) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / (norm + eps))


def _dims(vec: str, dims: int) -> list[Column]:
    return [F.col(vec)[i] for i in range(dims)]


def _blocks(frames: DataFrame, order: str = ORDER) -> DataFrame:
    return frames.withColumn("_block", block_of(KEY, F.col(order), _BITS))


def _blocks_with_neighbours(frames: DataFrame, before: int, after: int) -> DataFrame:
    """frames by blocks of a series, with copies of those that a block's frames see up to `before` and `after` themselves; _home: a block's own."""
    at = lambda i: F.shiftright(i.cast("long"), _BITS)
    i = F.col(ORDER)
    x = frames.withColumn("_at", F.explode(F.sequence(at(F.greatest(i - after, F.lit(0))), at(i + before))))
    return x.withColumn("_block", F.struct(F.col(KEY), F.col("_at").alias("at"))).withColumn("_home", F.col("_at") == at(i)).drop("_at")


def _block_rows(a: int, b: int):
    return Window.partitionBy("_block").orderBy(ORDER).rowsBetween(a, b)


def _minmax_of_series(raw: DataFrame, out: str) -> DataFrame:
    """(series_id, frame_idx, out): r min-max scaled over its series, equal values as they are. raw is stored, as it is read twice."""
    x = _blocks(stored(raw.select(KEY, ORDER, "r")))
    x = x.join(group_totals(x, KEY, _low=(F.min, F.col("r")), _high=(F.max, F.col("r"))), "_block")
    return x.select(KEY, ORDER, F.when(F.col("_high") > F.col("_low"), (F.col("r") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.col("r")).alias(out))


def repeatability(frames: DataFrame, dims: int, exclude: int, vec: str = "vec") -> DataFrame:
    """(series_id, frame_idx, repeatability): summed cosine to all frames more than `exclude` away, min-max scaled.

    The sum over frames is the product of a frame with the vector sum of those frames, so no pairs are formed. Frames are
    numbered without gaps; a series' sum comes from its blocks' sums, near frames from a block and its neighbours.
    """
    unit = frames.select(KEY, ORDER, _unit(F.col(vec), 1e-6).alias("u"))
    whole = group_totals(_blocks(unit), KEY, _n=(F.sum, F.lit(1)), **{f"_s{i}": (F.sum, F.col("u")[i]) for i in range(dims)})
    near = _block_rows(-exclude, exclude)
    total = sum(F.col("u")[i] * (F.col(f"_s{i}") - F.sum(F.col("u")[i]).over(near)) for i in range(dims))
    any_far = F.col("_n") > F.count(F.lit(1)).over(near)  # otherwise the difference of the sums is rounding alone
    raw = _blocks_with_neighbours(unit, exclude, exclude).join(whole, "_block").select(KEY, ORDER, "_home", F.when(any_far, total).otherwise(0.0).alias("r"))
    return _minmax_of_series(raw.where("_home"), "repeatability")


def _cosine(a: list[Column], b: list[Column]) -> tuple[Column, Column]:
    """Dot product over norms, and the product of the norms."""
    dot = sum(x * y for x, y in zip(a, b))
    norms = F.sqrt(sum(x * x for x in a)) * F.sqrt(sum(x * x for x in b))
    return dot / norms, norms


def novelty(frames: DataFrame, dims: int, width: int, vec: str = "vec") -> DataFrame:
    """(series_id, frame_idx, novelty): 1 - cosine of the means of the `width` frames before and from here, 0 near the ends, min-max scaled.

    Frames are numbered without gaps; means come from a block of a series and its neighbours.
    """
    frames = frames.select(KEY, ORDER, vec)
    whole = group_totals(_blocks(frames), KEY, _n=(F.sum, F.lit(1)))
    left = [F.avg(x).over(_block_rows(-width, -1)).alias(f"a{i}") for i, x in enumerate(_dims(vec, dims))]
    right = [F.avg(x).over(_block_rows(0, width - 1)).alias(f"b{i}") for i, x in enumerate(_dims(vec, dims))]
    cos, norms = _cosine([F.col(f"a{i}") for i in range(dims)], [F.col(f"b{i}") for i in range(dims)])
    m = _blocks_with_neighbours(frames, width, width - 1).join(whole, "_block").select(KEY, ORDER, "_n", "_home", *left, *right).where("_home")
    inner = (F.col(ORDER) >= width) & (F.col(ORDER) < F.col("_n") - width) & (norms > 0)
    return _minmax_of_series(m.select(KEY, ORDER, F.when(inner, 1 - cos).otherwise(0.0).alias("r")), "novelty")


def _diagonal_tile(t: pa.Table, key: str, block: int, exclude: int, smooth: int) -> pa.Table:
    """(key, n, q) of one tile: the largest smoothed similarity of each sample with a partner `lag` samples on, for the tile's samples and lags."""
    value = t.column(key)[0].as_py()
    ib, lb, n = (t.column(c)[0].as_py() for c in ("ib", "lb", "samples"))
    u = t.column("u").combine_chunks()
    dims = len(u[0]) if t.num_rows else 0
    vectors, at, right = u.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), t.column("i").to_numpy(), t.column("right").to_numpy(zero_copy_only=False)
    first, last = max(0, ib * block - smooth), min(n, (ib + 1) * block + smooth)
    lags = np.arange(max(exclude, lb * block), min(n, (lb + 1) * block))
    if last <= first or not len(lags):
        return pa.table({key: pa.array([], t.schema.field(key).type), "n": pa.array([], pa.int64()), "q": pa.array([], pa.float64())})
    end = min(n, last + int(lags[-1]))
    one, two = np.zeros((last - first, dims)), np.zeros((end - first - int(lags[0]), dims))
    left = ~right & (at >= first) & (at < last)
    one[at[left] - first] = vectors[left]
    far = right & (at >= first + lags[0]) & (at < end)
    two[at[far] - first - lags[0]] = vectors[far]
    products = one @ two.T
    i, j = np.arange(last - first)[:, None], np.arange(last - first)[:, None] + (lags - lags[0])[None, :]
    inside = j < two.shape[0]
    sims = np.where(inside, products[i, np.minimum(j, two.shape[0] - 1)], 0.0)  # a row for each sample, a column for each lag
    size = n - lags
    width = np.minimum(smooth, size)
    sums = np.concatenate([np.zeros((1, len(lags))), np.cumsum(sims, 0)])
    k = np.arange(max(0, ib * block), min(n, (ib + 1) * block))
    low = np.maximum(k[:, None] - width // 2, 0) - first
    high = np.minimum(k[:, None] + width - width // 2, size) - first
    columns = np.arange(len(lags))[None, :]
    high = np.clip(high, 0, last - first)
    low = np.minimum(np.clip(low, 0, last - first), high)
    q = np.where(k[:, None] < size, (sums[high, columns] - sums[low, columns]) / width, -np.inf)
    best = np.full(int(k[-1] + lags[-1] - k[0]) + 1, -np.inf)
    best[: len(k)] = q.max(1)
    for row in range(len(k)):  # partners of one sample are neighbours
        part = best[row + lags[0] : row + lags[-1] + 1]
        np.maximum(part, q[row], out=part)
    found = np.flatnonzero(np.isfinite(best))
    return pa.table({key: pa.array([value] * len(found), t.schema.field(key).type), "n": pa.array(found + k[0], pa.int64()), "q": pa.array(best[found])})


def sequence_repeatability(frames: DataFrame, stride: int, exclude: int, smooth: int, fps: float, vec: str = "vec", block: int = 512) -> DataFrame:
    """(series_id, frame_idx, sequence_repeatability): best smoothed similarity along the diagonals of the self-similarity, robustly scaled.

    Every stride-th frame is compared with those at least `exclude` samples later; along each lag the similarity is averaged over `smooth`
    neighbours, missing ones as 0. The pairs are never rows: tiles of `block` samples by `block` lags are products of matrices in tasks, which return the
    best value of each sample. A series of n samples costs n * n / 2 products in n * n / (2 * block * block) tiles, to
    which three blocks of vectors each are sent; a tile takes about 24 * block * block bytes. exclude is at least 1.
    Frames are numbered without gaps; those between samples are linear in their numbers, so fps changes nothing.
    """
    s = frames.where(F.pmod(ORDER, F.lit(stride)) == 0).select(KEY, (F.col(ORDER) / stride).cast("int").alias("i"), _unit(F.col(vec), 1e-8).alias("u"))
    s = _blocks(s, "i")
    sized = s.join(group_totals(s, KEY, samples=(F.max, F.col("i") + 1)), "_block").drop("_block")
    at, lowest, half = (lambda x: F.floor(x / block).cast("int")), exclude // block, smooth
    left = sized.withColumn("ib", F.explode(F.sequence(F.greatest(F.lit(0), at(F.col("i") - half)), F.least(at(F.col("i") + half), at(F.col("samples") - 1)))))
    top = at(F.col("samples") - 1 - F.col("ib") * block)
    left = left.where(top >= lowest).withColumn("lb", F.explode(F.sequence(F.lit(lowest), top))).withColumn("right", F.lit(False))
    right = sized.withColumn("db", F.explode(F.sequence(F.greatest(F.lit(0), at(F.col("i") - half) - 1), F.least(at(F.col("i") + half), at(F.col("samples") - 1)))))
    right = right.where(F.col("db") >= lowest).withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("db") - lowest))).withColumn("lb", F.col("db") - F.col("ib")).withColumn("right", F.lit(True)).drop("db")
    tiles = left.unionByName(right).groupBy(KEY, "ib", "lb")
    kind = s.schema[KEY].dataType.simpleString()
    ends = tiles.applyInArrow(lambda t: _diagonal_tile(t, KEY, block, exclude, smooth), f"{KEY} {kind}, n long, q double")
    found = s.select(KEY, F.col("i").cast("long").alias("n")).join(ends.groupBy(KEY, "n").agg(F.max("q").alias("q")), [KEY, "n"], "left")
    best = stored(found.select(KEY, "n", F.greatest(F.coalesce("q", F.lit(0.0)), F.lit(0.0)).alias("v")))
    pairs = best.join(best.select(KEY, (F.col("n") - 1).alias("n"), F.col("v").alias("w")), [KEY, "n"], "left")
    grid = frames.select(KEY, ORDER, F.floor(F.col(ORDER) / stride).alias("n"), (F.pmod(ORDER, F.lit(stride)) / stride).alias("part"))
    x = stored(grid.join(pairs, [KEY, "n"]).select(KEY, ORDER, (F.col("v") + (F.coalesce("w", "v") - F.col("v")) * F.col("part")).alias("v")))
    x = with_group_rows(_blocks(x), group_percentiles(_blocks(x), KEY, "v", {"_lo": 0.10, "_hi": 0.90}), KEY)
    scaled = F.when(F.col("_hi") - F.col("_lo") < 1e-8, F.lit(0.0)).otherwise(clip01((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))
    return x.select(KEY, ORDER, scaled.alias("sequence_repeatability"))


def boundary_strength(frames: DataFrame, dims: int, radius: int, energy: str = "rms", novelty_col: str = "novelty", vec: str = "vec") -> DataFrame:
    """0.50 novelty + 0.30 robust energy change + 0.20 robust change of the mean vector, before against after; the first and last frames have no change."""
    before, after = _rows(-radius, -1), _rows(0, radius - 1)
    n = F.count(F.lit(1)).over(_series())
    m = frames.select(
        KEY, ORDER, novelty_col, n.alias("n"), F.abs(F.avg(energy).over(after) - F.avg(energy).over(before)).alias("e"),
        *[F.avg(x).over(before).alias(f"a{i}") for i, x in enumerate(_dims(vec, dims))], *[F.avg(x).over(after).alias(f"b{i}") for i, x in enumerate(_dims(vec, dims))],
    )
    cos, norms = _cosine([F.col(f"a{i}") for i in range(dims)], [F.col(f"b{i}") for i in range(dims)])
    inner = (F.col(ORDER) >= 1) & (F.col(ORDER) < F.col("n") - 1)
    raw = m.select(KEY, ORDER, novelty_col, F.when(inner, F.col("e")).otherwise(0.0).alias("e"), F.when(inner & (norms > 1e-8), F.greatest(F.lit(0.0), 1 - cos)).otherwise(0.0).alias("c"))
    scaled = robust_scale(robust_scale(raw, "e", "e2"), "c", "c2")
    return scaled.select(KEY, ORDER, clip01(0.50 * F.col(novelty_col) + 0.30 * F.col("e2") + 0.20 * F.col("c2")).alias("boundary_strength"))


def pulse_curve(frames: DataFrame, points: DataFrame, fps: float, kernel: tuple[float, ...] = (0.15, 0.45, 1.0, 0.45, 0.15)) -> DataFrame:
    """Unit impulses at the frames nearest to the points, spread by the kernel and clipped."""
    hits = points.select(KEY, F.rint(F.col("t") * fps).cast("int").alias(ORDER)).distinct().withColumn("hit", F.lit(1.0))
    x = frames.select(KEY, ORDER).join(hits, [KEY, ORDER], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    w, half = Window.partitionBy(KEY).orderBy(ORDER), len(kernel) // 2
    total = weighted_sum([(k, F.coalesce(F.lag("hit", i - half).over(w), F.lit(0.0))) for i, k in enumerate(kernel)])
    return x.select(KEY, ORDER, clip01(total).alias("pulse"))


def hook_curve(frames: DataFrame, repeat: str, melody: str, pulse: str, energy: str) -> DataFrame:
    return frames.withColumn("hook", clip01(weighted_sum([(0.40, F.col(repeat)), (0.30, F.col(melody)), (0.15, F.col(pulse)), (0.15, F.col(energy))])))


def melody_salience(frames: DataFrame, flatness: str, vocal: str) -> DataFrame:
    return frames.withColumn("melody_salience", (1.0 - F.col(flatness)) * F.col(vocal))


def local_maxima(frames: DataFrame, value: str, threshold: float) -> DataFrame:
    """Frames strictly above both neighbours and the threshold; the ends are none."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    return frames.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).where((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) > threshold)).drop("_a", "_b")


def find_peaks(frames: DataFrame, value: str, threshold: float, min_dist: int) -> DataFrame:
    """(series_id, frame_idx): local maxima, the higher first, each at least min_dist from those taken."""
    from seriesmill.operators.greedy import greedy_suppress

    peaks = local_maxima(frames, value, threshold).select(KEY, F.col(ORDER).alias("at"), F.col(value).alias("h"))
    kept = greedy_suppress(peaks, [KEY], [(-F.col("h")).alias("k"), F.col("at").alias("k2")], ["at"], lambda x, y: F.abs(x["at"] - y["at"]) < min_dist)
    return kept.select(KEY, F.col("at").alias(ORDER))


def detect_anchors(frames: DataFrame, levels: dict[str, float], rises: dict[str, float], min_dist: int, grid: int, least: int = 5) -> DataFrame:
    """(series_id, frame_idx): the union of the peaks of some curves and of the rises of some; series with fewer than `least` also get every grid-th frame."""
    w = Window.partitionBy(KEY).orderBy(ORDER)
    sets = [find_peaks(frames, c, thr, min_dist) for c, thr in levels.items()]
    for c, thr in rises.items():
        sets.append(find_peaks(frames.withColumn("_d", F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c))), "_d", thr, min_dist))
    found = sets[0]
    for s in sets[1:]:
        found = found.unionByName(s)
    found = found.distinct()
    sizes = frames.groupBy(KEY).agg(F.max(ORDER).alias("last")).join(found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")), KEY, "left")
    few = sizes.where(F.coalesce("n", F.lit(0)) < least).where(F.col("last") + 1 - grid > grid)
    fill = few.select(KEY, F.explode(F.sequence(F.lit(grid), F.col("last") - grid, F.lit(grid))).alias(ORDER))
    return found.unionByName(fill).distinct()


def top_anchors(anchors: DataFrame, frames: DataFrame, weights: dict[str, float], n: int) -> DataFrame:
    """The n anchors of each series with the largest weighted sum of curves; the earlier of equals."""
    score = weighted_sum([(w, F.col(c)) for c, w in weights.items()])
    ranked = anchors.join(frames.select(KEY, ORDER, score.alias("score")), [KEY, ORDER])
    w = Window.partitionBy(KEY).orderBy(F.desc("score"), ORDER)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def metric_boundary_scores(frames: DataFrame, radius: int, alignment: str = "alignment", energy: str = "rms", onset: str = "onset", boundary: str = "boundary") -> DataFrame:
    """start_score and end_score of every frame: alignment, boundary, rise or release of the energy, onset. Computed once for each frame."""
    before, after = F.avg(energy).over(_rows(-radius, -1)), F.avg(energy).over(_rows(0, radius - 1))
    m = frames.withColumn("_b", F.coalesce(before, after)).withColumn("_a", after)
    rise, release = clip01(0.5 + 1.25 * (F.col("_a") - F.col("_b"))), clip01(0.5 + 1.25 * (F.col("_b") - F.col("_a")))
    start = clip01(weighted_sum([(0.30, F.col(alignment)), (0.25, F.col(boundary)), (0.25, rise), (0.20, F.col(onset))]))
    end = clip01(weighted_sum([(0.35, F.col(alignment)), (0.30, F.col(boundary)), (0.25, release), (0.10, F.col(onset) * release)]))
    return m.withColumn("start_score", start).withColumn("end_score", end).drop("_a", "_b")


def ending_components(frames: DataFrame, points: DataFrame, radius: int, tolerance: float = 0.35, energy: str = "rms", onset: str = "onset", novelty: str = "novelty") -> DataFrame:
    """frames with beat (closeness to the nearest point, 0 at the tolerance and without points), release (fall of the mean energy of `radius` frames from before to behind, at least 0) and ending_cleanliness.

    What stands before the first frame counts as silence. Computed once for each frame; refine_end takes beat, release and the other curves as its parts.
    """
    from seriesmill.operators.points import alignment, nearest_distance

    near = nearest_distance(frames, points, [KEY, ORDER]).select(KEY, ORDER, alignment(F.col("distance"), tolerance).alias("beat"))
    before, after = F.coalesce(F.avg(energy).over(_rows(-radius, -1)), F.lit(0.0)), F.avg(energy).over(_rows(0, radius - 1))
    x = frames.withColumn("release", F.greatest(F.lit(0.0), before - F.coalesce(after, before))).join(near, [KEY, ORDER])
    return x.withColumn("ending_cleanliness", weighted_sum([(0.45, F.col("beat")), (0.30, F.col(novelty)), (0.15, F.col("release")), (0.10, F.col(onset))]))
