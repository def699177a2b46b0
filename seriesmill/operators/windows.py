"""Window generation and scoring: tables of intervals [start_idx, end_idx) over frames.

Means come from prefix sums (two equi-joins on the frame index, whatever a window's length); maxima, percentiles and
runs need the window's frames, which an equi-join on (series, bin) brings together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import clip01, duration_fit, weighted_sum

KEY, ORDER = "series_id", "frame_idx"


def sliding_windows(series: DataFrame, length: int, step: int, frames_col: str = "n") -> DataFrame:
    """(series_id, start_idx, end_idx) for starts 0, step, ... below n - length; the last possible start is left out."""
    return series.where(F.col(frames_col) > length).select(KEY, F.explode(F.sequence(F.lit(0), (F.col(frames_col) - length - 1).cast("int"), F.lit(step))).alias("start_idx")).withColumn("end_idx", F.col("start_idx") + length)


def anchored_windows(anchors: DataFrame, series: DataFrame, offsets: list[float], durations: list[float], fps: float) -> DataFrame:
    """(series_id, start_idx, end_idx): every anchor (t) with every start offset and duration; windows that end past the series go, repeated ones stay once."""
    x = anchors.join(series.select(KEY, "n"), KEY)
    x = x.withColumn("off", F.explode(F.array(*[F.lit(float(o)) for o in offsets]))).withColumn("dur", F.explode(F.array(*[F.lit(float(d)) for d in durations])))
    start = F.rint(F.greatest(F.lit(0.0), F.col("t") - F.col("off")) * fps).cast("int")
    out = x.select(KEY, "n", start.alias("start_idx"), (start + F.rint(F.col("dur") * fps).cast("int")).alias("end_idx"))
    return out.where("end_idx < n").select(KEY, "start_idx", "end_idx").distinct()


def frames_in_windows(frames: DataFrame, windows: DataFrame, ids: list[str], bin_frames: int = 64) -> DataFrame:
    """Each window with each of its frames: windows are exploded to bins of frames, joined on (series, bin), then filtered."""
    w = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_idx") / bin_frames), F.floor((F.col("end_idx") - 1) / bin_frames))))
    f = frames.withColumn("_bin", F.floor(F.col(ORDER) / bin_frames))
    keep = [c for c in frames.columns if c != KEY]
    return w.join(f, [KEY, "_bin"]).where((F.col(ORDER) >= F.col("start_idx")) & (F.col(ORDER) < F.col("end_idx"))).select(*ids, "start_idx", "end_idx", *keep)


def window_means(frames: DataFrame, windows: DataFrame, curves: list[str], start: str = "start_idx", end: str = "end_idx", suffix: str = "") -> DataFrame:
    """windows with mean_<curve> over [start, end), null for an empty range: cumulative sums once, then two equi-joins."""
    w = Window.partitionBy(KEY).orderBy(ORDER).rowsBetween(Window.unboundedPreceding, 0)
    sums = frames.select(KEY, (F.col(ORDER) + 1).alias("_at"), *[F.sum(c).over(w).alias(f"_{c}") for c in curves])
    a = sums.select(KEY, F.col("_at").alias(start), *[F.col(f"_{c}").alias(f"_a_{c}") for c in curves])
    b = sums.select(KEY, F.col("_at").alias(end), *[F.col(f"_{c}").alias(f"_b_{c}") for c in curves])
    out = windows.join(a, [KEY, start], "left").join(b, [KEY, end], "left")
    n = F.col(end) - F.col(start)
    for c in curves:
        out = out.withColumn(f"mean_{c}{suffix}", F.when(n > 0, (F.coalesce(F.col(f"_b_{c}"), F.lit(0.0)) - F.coalesce(F.col(f"_a_{c}"), F.lit(0.0))) / n))
    return out.drop(*[f"_{x}_{c}" for c in curves for x in "ab"])


def refine_end(windows: DataFrame, frames: DataFrame, radius: int, shortest: int, longest: int, parts: dict[str, float]) -> DataFrame:
    """(series_id, start_idx, end_idx, refined_idx): the best end within `radius` frames of the nominal one.

    The score is the weighted sum of the parts (curves of an end's merit) and 0.05 times the closeness; of equals the
    nearest, then the earlier. If the allowed lengths leave no end in range, the nominal end stays.
    """
    last = frames.groupBy(KEY).agg(F.max(ORDER).alias("_last"))
    w = windows.join(last, KEY)
    lo = F.greatest(F.col("start_idx") + shortest, F.col("end_idx") - radius)
    hi = F.least(F.col("_last"), F.col("start_idx") + longest, F.col("end_idx") + radius)
    options = w.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").select(KEY, "start_idx", "end_idx", F.explode(F.sequence("_lo", "_hi")).alias(ORDER))
    dist = F.abs(F.col(ORDER) - F.col("end_idx"))
    score = weighted_sum([(k, F.col(c)) for c, k in parts.items()]) + 0.05 * F.greatest(F.lit(0.0), 1 - dist / max(1, radius))
    scored = options.join(frames.select(KEY, ORDER, *parts), [KEY, ORDER])
    best = scored.groupBy(KEY, "start_idx", "end_idx").agg(F.max_by(ORDER, F.struct(score, -dist, -F.col(ORDER))).alias("_best"))
    stay = F.greatest(F.lit(0), F.least(F.col("end_idx"), F.col("_last")))
    return w.join(best, [KEY, "start_idx", "end_idx"], "left").select(KEY, "start_idx", "end_idx", F.coalesce("_best", stay).cast("int").alias("refined_idx"))


def refine_both(windows: DataFrame, frames: DataFrame, radius: int, shortest: float, longest: float, fps: float = 1.0, top: int = 16, start: str = "start_score", end: str = "end_score", limits: DataFrame | None = None) -> DataFrame:
    """(series_id, start_idx, end_idx, refined_start, refined_end): the best pair of the `top` starts and ends within `radius`.

    Joint score 0.40 start + 0.40 end + 0.14 smaller + 0.06 closeness to the nominal length, which must lie between
    shortest and longest; ties: least total shift, earliest start, earliest end. Without an allowed pair, as it was.
    limits: (series_id, shortest, longest) where these differ from series to series.
    """
    last = frames.groupBy(KEY).agg(F.max(ORDER).alias("_last"))
    ids = [KEY, "start_idx", "end_idx"]
    w = windows.select(*ids).distinct().join(last, KEY)
    side = lambda at, lo, hi, score: (
        w.select(*ids, F.explode(F.sequence(lo, hi)).alias(ORDER)).join(frames.select(KEY, ORDER, F.col(score).alias("_s")), [KEY, ORDER])
        .withColumn("_r", F.row_number().over(Window.partitionBy(*ids).orderBy(F.desc("_s"), F.abs(F.col(ORDER) - F.col(at)), ORDER))).where(F.col("_r") <= top)
    )
    a = side("start_idx", F.greatest(F.lit(0), F.col("start_idx") - radius), F.least(F.col("_last"), F.col("start_idx") + radius), start)
    b = side("end_idx", F.greatest(F.lit(1), F.col("end_idx") - radius), F.least(F.col("_last"), F.col("end_idx") + radius), end)
    both = a.select(*ids, F.col(ORDER).alias("a"), F.col("_s").alias("sa")).join(b.select(*ids, F.col(ORDER).alias("b"), F.col("_s").alias("sb")), ids)
    length, nominal = (F.col("b") - F.col("a")) / fps, (F.col("end_idx") - F.col("start_idx")) / fps
    close = F.greatest(F.lit(0.0), 1 - F.abs(length - nominal) / max(2.0 * radius / fps, 1e-6))
    joint = 0.40 * F.col("sa") + 0.40 * F.col("sb") + 0.14 * F.least("sa", "sb") + 0.06 * close
    if limits is not None:
        both, shortest, longest = both.join(limits.select(KEY, "shortest", "longest"), KEY), F.col("shortest"), F.col("longest")
    fit = both.where((length >= shortest - 1e-6) & (length <= longest + 1e-6))
    key = F.struct(joint, -(F.abs(F.col("a") - F.col("start_idx")) + F.abs(F.col("b") - F.col("end_idx"))), -F.col("a"), -F.col("b"))
    best = fit.groupBy(*ids).agg(F.max_by(F.struct("a", "b"), key).alias("_x"))
    return w.join(best, ids, "left").select(*ids, F.coalesce("_x.a", "start_idx").alias("refined_start"), F.coalesce("_x.b", "end_idx").alias("refined_end"))


def window_features_core(frames: DataFrame, windows: DataFrame, series: DataFrame, margin: float, fps: float) -> DataFrame:
    """Core score of each window: mean loudness, bass, onset, density, flux, 90-10 percentile contrast, minus penalties for silence and for the series' edges."""
    ids = [KEY, "start_idx", "end_idx"]
    inside = frames_in_windows(frames, windows, [KEY])
    half = F.floor((F.col("end_idx") - F.col("start_idx")) / 2)
    first = F.col(ORDER) - F.col("start_idx") < half
    m = inside.groupBy(*ids).agg(
        *[F.avg(c).alias(c) for c in ("rms", "bass", "onset", "density", "flux")], (F.percentile("rms", 0.9) - F.percentile("rms", 0.1)).alias("contrast"),
        F.avg(F.when(first, F.col("rms"))).alias("r1"), F.avg(F.when(~first, F.col("rms"))).alias("r2"),
    ).join(series.select(KEY, "duration"), KEY)
    t0, t1 = F.col("start_idx") / fps, F.col("end_idx") / fps
    edge = F.when(t0 < margin, 0.5 * (1 - t0 / margin)).otherwise(0.0) + F.when(t1 > F.col("duration") - margin, 0.5 * (1 - (F.col("duration") - t1) / margin)).otherwise(0.0)
    silence = F.when(F.col("rms") < 0.08, 1.0).otherwise(0.0) + F.when((F.col("r2") > 0.1) & (F.col("r1") / F.col("r2") < 0.2), 0.3).otherwise(0.0)
    score = weighted_sum([(0.25, F.col("rms")), (0.20, F.col("bass")), (0.15, F.col("onset")), (0.15, F.col("density")), (0.15, F.col("flux")), (0.10, F.col("contrast")), (-0.40, silence), (-0.30, edge)])
    return m.select(*ids, "contrast", silence.alias("silence_penalty"), edge.alias("edge_penalty"), F.greatest(F.lit(0.0), score).alias("core_score"))


def window_features_advanced(frames: DataFrame, windows: DataFrame, lead: int, head: int) -> DataFrame:
    """Advanced score of each window: thirteen products and maxima of curve means. lead: frames before the start, head: first frames that may hold the drop."""
    ids, curves = [KEY, "start_idx", "end_idx"], ["rms", "bass", "onset", "density", "flux", "centroid", "flatness", "synth", "vocal", "melody", "repeat"]
    inside = frames_in_windows(frames, windows, [KEY])
    m = inside.groupBy(*ids).agg(*[F.avg(c).alias(c) for c in curves], F.max("onset").alias("peak"), F.max("novelty").alias("new"), F.max(F.when(F.col(ORDER) - F.col("start_idx") < head, F.col("rms"))).alias("drop"))
    m = m.withColumn("_lead", F.greatest(F.lit(0), F.col("start_idx") - lead)).withColumn("_prev", F.greatest(F.lit(0), F.col("start_idx") - (F.col("end_idx") - F.col("start_idx"))))
    m = window_means(frames, m, ["rms"], "_lead", "start_idx", "_lead")
    m = window_means(frames, m, ["rms", "centroid"], "_prev", "start_idx", "_prev")
    c = {k: F.col(k) for k in [*curves, "peak", "new", "drop"]}
    spike = F.when(F.coalesce("mean_rms_lead", F.lit(0.0)) > 0, F.greatest(F.lit(0.0), c["drop"] - F.col("mean_rms_lead"))).otherwise(0.0)
    change = F.coalesce(0.5 * F.abs(c["rms"] - F.col("mean_rms_prev")) + 0.5 * F.abs(c["centroid"] - F.col("mean_centroid_prev")), F.lit(0.0))
    terms = [
        (0.12, spike * c["peak"]), (0.12, c["rms"] * c["density"] * c["repeat"]), (0.08, c["new"]), (0.08, c["rms"] * c["centroid"] * c["onset"]), (0.08, c["density"] * c["onset"]),
        (0.08, c["bass"] * c["rms"] * (1 - c["centroid"])), (0.06, (1 - c["centroid"]) * c["rms"] * c["flux"] * c["flatness"]), (0.06, c["peak"] * c["bass"]),
        (0.06, c["synth"] * (1 - c["flatness"])), (0.06, c["vocal"] * (1 - c["flatness"]) * c["melody"]), (0.06, c["melody"]), (0.06, c["repeat"]), (0.04, change),
    ]
    return m.select(*ids, spike.alias("drop_spike"), change.alias("contrast_prev"), F.greatest(F.lit(0.0), weighted_sum(terms)).alias("advanced_score"))


def window_features_dynamic(frames: DataFrame, windows: DataFrame, head: int, shortest: float, target_from: float, target_to: float, longest: float, fps: float, dims: int, sample: int = 120, clean: str = "ending", vec: str = "vec") -> DataFrame:
    """Dynamic score of each window: impact of the start, cleanliness of the end, arc, boundary novelty, repetition and padding penalties, length bonus.

    Repetition is the mean cosine between frames, from the norm of the sum of unit vectors; windows longer than `sample`
    frames are sampled at evenly spaced ones. clean: a curve with an ending's cleanliness at each frame.
    """
    ids = [KEY, "start_idx", "end_idx"]
    n, k = (F.col("end_idx") - F.col("start_idx")), (F.col(ORDER) - F.col("start_idx"))
    inside = frames_in_windows(frames, windows, [KEY]).withColumn("_k", k).withColumn("_n", n)
    inside = inside.withColumn("_r", F.row_number().over(Window.partitionBy(*ids).orderBy("rms", ORDER)) - 1)
    picked = F.when(F.col("_n") <= sample, F.lit(True)).otherwise(F.exists(F.sequence(F.lit(0), F.lit(sample - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (sample - 1)) == F.col("_k")))
    norm = F.sqrt(sum(F.col(vec)[i] * F.col(vec)[i] for i in range(dims)))
    u = [F.when(picked, F.col(vec)[i] / (norm + 1e-6)) for i in range(dims)]
    low = F.floor(0.25 * F.col("_n"))
    m = inside.groupBy(*ids).agg(
        F.avg("rms").alias("rms"), F.avg(F.when(F.col("_k") < head, F.col("onset"))).alias("o"), F.avg(F.when(F.col("_k") < head, F.col("rms"))).alias("e"), F.min_by("_k", F.struct(-F.col("rms"), F.col("_k"))).alias("top"),
        F.coalesce(F.avg(F.when(F.col("_r") < low, F.col("rms"))), F.min("rms")).alias("q"), F.count_if(picked).alias("s"), F.sum(F.when(picked, (norm / (norm + 1e-6)) ** 2)).alias("diag"), *[F.sum(x).alias(f"u{i}") for i, x in enumerate(u)],
    )
    at = frames.select(KEY, F.col(ORDER), F.col(clean).alias("_clean"), F.col("novelty").alias("_nov"))
    m = m.join(at.select(KEY, F.col(ORDER).alias("end_idx"), F.col("_clean").alias("clean"), F.col("_nov").alias("n1")), [KEY, "end_idx"], "left").join(at.select(KEY, F.col(ORDER).alias("start_idx"), F.col("_nov").alias("n0")), [KEY, "start_idx"])
    total = sum(F.col(f"u{i}") * F.col(f"u{i}") for i in range(dims))
    repetition = F.when(F.col("s") > 1, (total - F.col("diag")) / (F.col("s") * (F.col("s") - 1))).otherwise(0.0)
    d = n / fps
    where = F.col("top") / n
    arc = F.when((where >= 0.15) & (where <= 0.85), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(where - 0.15), F.abs(where - 0.85)) * 4))
    padding = F.when(F.col("q") < 0.05, F.greatest(F.lit(0.0), 1 - F.col("q") / 0.05)).otherwise(0.0) + F.when(d < target_from, 0.5 * (1 - (d - shortest) / (target_from - shortest + 1e-6))).when(d > target_to, 0.5 * ((d - target_to) / (longest - target_to + 1e-6))).otherwise(0.0)
    impact = F.col("o") * F.col("e")
    bonus = 0.10 * ((d - shortest) / (longest - shortest + 1e-6))
    edge = F.greatest("n0", F.coalesce("n1", F.lit(0.0)))
    terms = [(0.15, impact), (0.10, F.coalesce("clean", F.lit(0.0))), (0.15, F.col("rms")), (0.15, arc), (0.10, edge), (0.15, impact * F.col("rms") * arc), (1.0, bonus), (-0.15, repetition), (-0.15, padding)]
    return m.select(*ids, impact.alias("start_impact"), arc.alias("arc_payoff"), repetition.alias("repetition_penalty"), padding.alias("padding_penalty"), F.greatest(F.lit(0.0), weighted_sum(terms)).alias("dynamic_score"))


def combined_score(core: Column, advanced: Column, dynamic: Column) -> Column:
    return 0.30 * core + 0.35 * advanced + 0.35 * dynamic


def padding_risk(frames: DataFrame, windows: DataFrame, energy: str = "rms", low: float = 0.15) -> DataFrame:
    """(series_id, start_idx, end_idx, padding_risk): 0.65 of the share of low frames and 0.35 of that of the longest low run; 1 for a window without frames."""
    ids = [KEY, "start_idx", "end_idx"]
    inside = frames_in_windows(frames, windows, [KEY]).withColumn("_low", F.col(energy) < low)
    island = F.row_number().over(Window.partitionBy(*ids).orderBy(ORDER)) - F.row_number().over(Window.partitionBy(*ids, "_low").orderBy(ORDER))
    runs = inside.withColumn("_g", island).groupBy(*ids, "_low", "_g").agg(F.count(F.lit(1)).alias("_len"))
    m = runs.groupBy(*ids).agg(F.sum("_len").alias("n"), F.sum(F.when(F.col("_low"), F.col("_len")).otherwise(0)).alias("lows"), F.max(F.when(F.col("_low"), F.col("_len")).otherwise(0)).alias("run"))
    risk = clip01(0.65 * F.col("lows") / F.col("n") + 0.35 * F.col("run") / F.col("n"))
    return windows.select(*ids).distinct().join(m, ids, "left").select(*ids, F.coalesce(risk, F.lit(1.0)).alias("padding_risk"))


def nucleus_proposals(frames: DataFrame, lengths: list[int], step: int, prior_at: float, lead: int, early: int, fps: float = 1.0, hook: str = "hook", energy: str = "rms", start: str = "start_score", whole: bool = False) -> DataFrame:
    """Scored windows of the given lengths every `step` frames: hook mean and upper quartile, start boundary, lift, payoff by thirds, minus low energy and instability.

    whole: a series too short for any of the lengths has one window, of all its frames but the last.
    """
    n = frames.groupBy(KEY).agg((F.max(ORDER) + 1).alias("n"))
    w = None
    for length in lengths:
        one = sliding_windows(n, length, step).withColumn("prior", clip01(F.lit(1.0 - abs(length / fps - prior_at) / prior_at)))
        w = one if w is None else w.unionByName(one)
    if whole:
        short = n.where((F.col("n") >= 2) & (F.col("n") - 1 < min(lengths)))
        w = w.unionByName(short.select(KEY, F.lit(0).alias("start_idx"), (F.col("n") - 1).cast("int").alias("end_idx"), clip01(1.0 - F.abs((F.col("n") - 1) / fps - prior_at) / prior_at).alias("prior")))
    ids = [KEY, "start_idx", "end_idx"]
    lag = F.lag(hook).over(Window.partitionBy(KEY).orderBy(ORDER))
    f = frames.select(KEY, ORDER, F.col(hook).alias("h"), F.col(energy).alias("e"), F.abs(F.col(hook) - lag).alias("d"))
    inside = frames_in_windows(f, w, [KEY]).withColumn("k", F.col(ORDER) - F.col("start_idx")).withColumn("len", F.col("end_idx") - F.col("start_idx"))
    # thirds as even as can be, the first ones longer
    size, more = F.floor(F.col("len") / 3), F.pmod("len", F.lit(3))
    third = F.when(F.col("k") < size + F.least(more, F.lit(1)), 0).when(F.col("k") < 2 * size + F.least(more, F.lit(2)), 1).otherwise(2)
    part = lambda i: F.avg(F.when(third == i, F.col("e")))
    m = inside.groupBy(*ids).agg(
        F.avg("h").alias("mean_hook"), F.percentile("h", 0.75).alias("upper_hook"), F.avg("e").alias("energy"), F.avg(F.when(F.col("k") < early, F.col("e"))).alias("early"),
        part(0).alias("t0"), part(1).alias("t1"), part(2).alias("t2"), F.avg((F.col("e") < 0.15).cast("double")).alias("low_energy"), (F.avg(F.when(F.col("k") > 0, F.col("d"))) * 2).alias("instability"),
    ).withColumn("_lead", F.greatest(F.lit(0), F.col("start_idx") - lead))
    m = window_means(f, m, ["e"], "_lead", "start_idx", "_lead").withColumn("pre", F.coalesce("mean_e_lead", "energy"))
    m = m.join(w, ids).join(frames.select(KEY, F.col(ORDER).alias("start_idx"), F.col(start).alias("start_boundary")), [KEY, "start_idx"])
    lift = clip01(0.5 + 1.25 * (F.col("early") - F.col("pre")))
    payoff = clip01(0.55 * (0.5 + 1.25 * (F.greatest("t1", "t2") - F.col("t0"))) + 0.45 * (0.5 + 1.25 * (F.greatest("t0", "t1", "t2") - F.col("pre"))))
    score = clip01(weighted_sum([(0.42, F.col("mean_hook")), (0.18, F.col("upper_hook")), (0.14, F.col("start_boundary")), (0.12, lift), (0.10, payoff), (0.04, F.col("prior")), (-0.08, F.col("low_energy")), (-0.04, F.col("instability"))]))
    return m.select(*ids, score.alias("nucleus_score"), lift.alias("drop_lift"), payoff.alias("payoff"), "mean_hook", "upper_hook")


def suppress_nuclei(nuclei: DataFrame, most: int = 36, separation: float = 4.0, overlap: float = 0.70, fps: float = 1.0, rounds: bool = False) -> DataFrame:
    """Greedy non-maximum suppression, best first: gone if a kept centre is nearer than `separation` or the overlap is at least `overlap`. nucleus_id in acceptance order.

    rounds: by rounds over local bests, for series with any number of proposals.
    """
    from seriesmill.operators.greedy import greedy_suppress, suppress_by_rounds

    centre = lambda x: (x["start_idx"] + x["end_idx"]) / 2.0 / fps
    common = lambda x, y: F.least(x["end_idx"], y["end_idx"]) - F.greatest(x["start_idx"], y["start_idx"])
    shorter = lambda x, y: F.least(x["end_idx"] - x["start_idx"], y["end_idx"] - y["start_idx"])
    clash = lambda x, y: (F.abs(centre(x) - centre(y)) < separation) | (common(x, y) / shorter(x, y) >= overlap)
    order = [(-F.col("nucleus_score")).alias("o1"), F.col("start_idx").alias("o2"), F.col("end_idx").alias("o3")]
    names = ["start_idx", "end_idx", "nucleus_score"]
    if rounds:
        reach = F.lit(separation * fps / 2)
        middle = (F.col("start_idx") + F.col("end_idx")) / 2.0
        placed = nuclei.withColumn("_lo", F.least(F.col("start_idx").cast("double"), middle - reach)).withColumn("_hi", F.greatest(F.col("end_idx").cast("double"), middle + reach))
        kept = suppress_by_rounds(placed, [KEY], order, names, clash, "_lo", "_hi", 16.0 * fps, most)
    else:
        kept = greedy_suppress(nuclei, [KEY], order, names, clash, most)
    return kept.withColumn("nucleus_id", F.format_string("nucleus_%03d", F.col("rank").cast("int")))


def expand_nuclei(nuclei: DataFrame, frames: DataFrame, lengths: list[int], placements: tuple[float, ...], radius: int, shortest: int, longest: int) -> DataFrame:
    """(series_id, nucleus_id, start_idx, end_idx): every nucleus in windows of the given lengths and placements, refined on both sides.

    Nominal windows are shifted to contain their nucleus and lie in the series; a refined window that doesn't contain the
    nucleus gives way to the nominal one. Windows outside the allowed lengths go, repeated ones stay once.
    """
    n = frames.groupBy(KEY).agg((F.max(ORDER) + 1).alias("n"))
    a, b, size = F.col("nucleus_start"), F.col("nucleus_end"), F.col("len")
    x = nuclei.select(KEY, "nucleus_id", F.col("start_idx").alias("nucleus_start"), F.col("end_idx").alias("nucleus_end")).join(n, KEY)
    x = x.withColumn("len", F.explode(F.array(*[F.lit(v) for v in lengths]))).withColumn("place", F.explode(F.array(*[F.lit(p) for p in placements]))).where(size >= b - a)
    nominal = F.greatest(F.least(F.rint((a + b) / 2.0 - F.col("place") * size).cast("int"), a), b - size)
    nominal = F.greatest(F.lit(0), F.least(nominal, F.col("n") - size - 1))
    x = x.withColumn("start_idx", nominal).withColumn("end_idx", F.least(F.col("n") - 1, F.col("start_idx") + size))
    r = x.join(refine_both(x, frames, radius, shortest, longest), [KEY, "start_idx", "end_idx"])
    bad = (F.col("refined_start") > a) | (F.col("refined_end") < b)
    s, e = F.when(bad, F.col("start_idx")).otherwise(F.col("refined_start")), F.when(bad, F.col("end_idx")).otherwise(F.col("refined_end"))
    out = r.select(KEY, "nucleus_id", "nucleus_start", "nucleus_end", s.alias("start_idx"), e.alias("end_idx"))
    return out.where((F.col("start_idx") <= a) & (F.col("end_idx") >= b) & (F.col("end_idx") - F.col("start_idx") >= shortest) & (F.col("end_idx") - F.col("start_idx") <= longest)).distinct()


def allowed_lengths(series: DataFrame, shortest: float, target_from: float, target_to: float, longest: float, fps: float = 1.0) -> DataFrame:
    """(series_id, n, shortest, target_from, target_to, longest, durations) of each series (series_id, n) of two frames or more, in seconds.

    Limits are clamped to what the series has; durations are the different ones of shortest, target_from, the targets' middle, target_to and longest.
    """
    x = series.where("n >= 2").select(KEY, "n", ((F.col("n") - 1) / fps).alias("_a"))
    x = x.withColumn("longest", F.least(F.lit(float(longest)), "_a")).withColumn("shortest", F.least(F.lit(float(shortest)), "longest"))
    x = x.withColumn("target_from", F.least(F.greatest(F.lit(float(target_from)), "shortest"), "longest"))
    x = x.withColumn("target_to", F.least(F.greatest(F.lit(float(target_to)), "target_from"), "longest"))
    every = F.array("shortest", "target_from", (F.col("target_from") + F.col("target_to")) / 2.0, "target_to", "longest")
    fits = F.filter(F.transform(every, lambda v: F.round(v, 3)), lambda v: (v >= F.col("shortest") - 1e-6) & (v <= F.col("longest") + 1e-6))
    return x.withColumn("durations", F.array_distinct(fits)).select(KEY, "n", "shortest", "target_from", "target_to", "longest", "durations")


def with_fallback(nuclei: DataFrame, lengths: DataFrame, fps: float = 1.0) -> DataFrame:
    """nuclei (series_id, nucleus_id, start_idx, end_idx, nucleus_score), and for each series of allowed_lengths without one its beginning, of the shortest length, with a score of 0."""
    lonely = lengths.join(nuclei.select(KEY).distinct(), KEY, "left_anti")
    end = F.least(F.col("n") - 1, F.greatest(F.lit(1), F.rint(F.col("shortest") * fps).cast("int")))
    return nuclei.select(KEY, "nucleus_id", "start_idx", "end_idx", "nucleus_score").unionByName(lonely.select(KEY, F.lit("nucleus_001").alias("nucleus_id"), F.lit(0).alias("start_idx"), end.cast("int").alias("end_idx"), F.lit(0.0).alias("nucleus_score")))


def expand_all_series(nuclei: DataFrame, frames: DataFrame, lengths: DataFrame, placements: tuple[float, ...], radius: int, fps: float = 1.0) -> DataFrame:
    """expand_nuclei with each series' own lengths (allowed_lengths); series that are short or have no nucleus have candidates too. Only series with fewer than two frames have none."""
    x = with_fallback(nuclei, lengths, fps).select(KEY, "nucleus_id", F.col("start_idx").alias("nucleus_start"), F.col("end_idx").alias("nucleus_end"))
    x = x.join(lengths, KEY).withColumn("len", F.explode("durations")).withColumn("len", F.greatest(F.lit(1), F.rint(F.col("len") * fps).cast("int"))).withColumn("place", F.explode(F.array(*[F.lit(p) for p in placements])))
    a, b, size = F.col("nucleus_start"), F.col("nucleus_end"), F.col("len")
    x = x.where(size >= b - a)
    nominal = F.greatest(F.least(F.rint((a + b) / 2.0 - F.col("place") * size).cast("int"), a), b - size)
    nominal = F.greatest(F.lit(0), F.least(nominal, F.col("n") - size - 1))
    x = x.withColumn("start_idx", nominal.cast("int")).withColumn("end_idx", F.least(F.col("n") - 1, F.col("start_idx") + size).cast("int"))
    r = x.join(refine_both(x, frames, radius, 0, 0, fps, limits=lengths), [KEY, "start_idx", "end_idx"])
    bad = (F.col("refined_start") > a) | (F.col("refined_end") < b)
    s, e = F.when(bad, F.col("start_idx")).otherwise(F.col("refined_start")), F.when(bad, F.col("end_idx")).otherwise(F.col("refined_end"))
    out = r.select(KEY, "nucleus_id", "nucleus_start", "nucleus_end", s.alias("start_idx"), e.alias("end_idx"), "shortest", "longest")
    seconds = (F.col("end_idx") - F.col("start_idx")) / fps
    return out.where((F.col("start_idx") <= a) & (F.col("end_idx") >= b) & (seconds >= F.col("shortest") - 1e-6) & (seconds <= F.col("longest") + 1e-6)).drop("shortest", "longest").distinct()


def score_candidates(candidates: DataFrame, frames: DataFrame, nuclei: DataFrame, opening: int, onset_head: int, tail: int, shortest: float, target_from: float, target_to: float, longest: float, fps: float = 1.0) -> DataFrame:
    """event_score, edit_score, structure_score and their breakdown (a map) of each candidate (series_id, nucleus_id, nucleus_start, nucleus_end, start_idx, end_idx)."""
    ids = [KEY, "nucleus_id", "nucleus_start", "nucleus_end", "start_idx", "end_idx"]
    inside = frames_in_windows(frames, candidates, ids).withColumn("k", F.col(ORDER) - F.col("start_idx"))
    nuc = (F.col(ORDER) >= F.col("nucleus_start")) & (F.col(ORDER) < F.col("nucleus_end"))
    m = inside.groupBy(*ids).agg(
        F.avg("hook").alias("hook"), F.avg(F.when(F.col("k") < opening, F.col("hook"))).alias("hook0"), F.percentile(F.when(F.col("k") < onset_head, F.col("onset")), 0.9).alias("onset90"),
        F.avg(F.when(nuc, F.col("rms"))).alias("en"), F.avg(F.when(F.col(ORDER) < F.col("nucleus_start"), F.col("rms"))).alias("pre"), F.avg(F.when(F.col(ORDER) >= F.col("nucleus_end"), F.col("rms"))).alias("post"),
    )
    m = m.withColumn("cta", F.greatest(F.col("start_idx"), F.col("end_idx") - tail)).withColumn("cta0", F.greatest(F.col("start_idx"), F.col("cta") - tail))
    m = window_means(frames, m, ["rms"], "cta", "end_idx", "_cta")
    m = window_means(frames, m, ["rms"], "cta0", "cta", "_cta0")
    at = frames.select(KEY, ORDER, "start_score", "end_score")
    m = m.join(at.select(KEY, F.col(ORDER).alias("start_idx"), F.col("start_score").alias("sb")), [KEY, "start_idx"]).join(at.select(KEY, F.col(ORDER).alias("end_idx"), F.col("end_score").alias("eb")), [KEY, "end_idx"])
    m = m.join(nuclei.select(KEY, "nucleus_id", "nucleus_score"), [KEY, "nucleus_id"]).join(frames.groupBy(KEY).agg((F.max(ORDER) + 1).alias("n")), KEY)
    m = m.join(padding_risk(frames, candidates), [KEY, "start_idx", "end_idx"])
    opening_hook = clip01(0.55 * F.col("hook0") + 0.25 * F.col("onset90") + 0.20 * F.col("sb"))
    window_hook = clip01(0.55 * opening_hook + 0.45 * F.col("hook"))
    en, pre, post = F.col("en"), F.coalesce("pre", "en"), F.coalesce("post", "en")
    arc = clip01(0.65 * clip01(0.5 + 1.25 * (en - pre)) + 0.35 * clip01(0.5 + 1.25 * (en - post)))
    quality = F.sqrt(F.greatest(F.lit(0.0), F.col("sb") * F.col("eb")))
    length = F.col("end_idx") - F.col("start_idx")
    fit = duration_fit(length / fps, shortest, target_from, target_to, longest)
    centre = (F.col("nucleus_start") + F.col("nucleus_end")) / 2.0
    position = clip01(1 - F.abs((centre - F.col("start_idx")) / F.greatest(F.lit(1.0), length) - 0.35) / 0.45)
    song = clip01(1 - F.abs(centre / F.greatest(F.lit(1.0), F.col("n") - 1) - 0.50) / 0.50)
    rise = F.greatest(F.lit(0.0), F.coalesce("mean_rms_cta", F.lit(0.0)) - F.coalesce("mean_rms_cta0", F.lit(0.0)))
    conflict = clip01(0.6 * F.greatest(F.lit(0), F.col("nucleus_end") - F.col("cta")) / F.greatest(F.lit(1), F.col("nucleus_end") - F.col("nucleus_start")) + 0.8 * rise)
    event = clip01(0.60 * F.col("nucleus_score") + 0.10 * arc + 0.15 * quality + 0.15 * song)
    edit = clip01(0.30 * window_hook + 0.25 * quality + 0.15 * fit + 0.15 * position + 0.10 * (1 - F.col("padding_risk")) + 0.05 * (1 - conflict))
    parts = {"window_hook": window_hook, "opening_hook": opening_hook, "measured_arc": arc, "boundary_quality": quality, "duration_fit": fit, "nucleus_position": position, "song_position": song, "padding_risk": F.col("padding_risk"), "cta_conflict": conflict}
    breakdown = F.map_from_arrays(F.array(*[F.lit(k) for k in parts]), F.array(*parts.values()))
    return m.select(*ids, event.alias("event_score"), edit.alias("edit_score"), breakdown.alias("breakdown")).withColumn("structure_score", clip01(0.85 * F.col("event_score") + 0.15 * F.col("edit_score")))
