"""Column expressions: clamps, interval arithmetic, planning arithmetic, canonical hashes. None of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip01(x: Column) -> Column:
    """x held in [0, 1]; null stays null."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) + F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0))


def is_finite(x: Column) -> Column:
    """Whether x is a number other than NaN and the infinities; false for null."""
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def finite_or(x: Column, default: float) -> Column:
    """x as a double, and the default where it isn't a finite number (text that is no number, NaN, infinity, null)."""
    d = x.try_cast("double")
    return F.when(is_finite(d), d).otherwise(F.lit(float(default)))


def interval_overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common length over the shorter interval's length, 0 for intervals that don't overlap."""
    common = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(common <= 0, F.lit(0.0)).otherwise(common / F.greatest(F.lit(1e-6), F.least(e1 - s1, e2 - s2)))


def gap_closeness(s1: Column, e1: Column, s2: Column, e2: Column, min_gap: float) -> Column:
    """How far the gap between two intervals falls short of min_gap, as a share of it; 0 if they overlap or min_gap is 0."""
    if min_gap <= 0:
        return F.lit(0.0)
    gap = F.greatest(F.lit(0.0), F.greatest(s1, s2) - F.least(e1, e2))
    return F.when(F.least(e1, e2) - F.greatest(s1, s2) > 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (min_gap - gap) / min_gap))


def distance_to_interval(p: Column, start: Column, end: Column) -> Column:
    """0 inside, else the distance to the nearer end."""
    return F.greatest(start - p, p - end, F.lit(0.0))


def duration_fit(d: Column, shortest: float, target_from: float, target_to: float, longest: float) -> Column:
    """1 in the target band, falling to 0 at the shortest and longest lengths."""
    return (
        F.when((d >= target_from) & (d <= target_to), F.lit(1.0))
        .when(d < target_from, clip01((d - shortest) / max(target_from - shortest, 1e-6)))
        .otherwise(clip01((longest - d) / max(longest - target_to, 1e-6)))
    )


def tail_window(duration: Column, wanted: float) -> Column:
    """Struct (start, length) of the last `wanted` seconds, shorter if there is less."""
    length = F.least(duration, F.lit(float(wanted)))
    return F.struct(F.greatest(F.lit(0.0), duration - length).alias("start"), length.alias("length"))


def required_clips(duration: Column, clip: Column) -> Column:
    return F.ceil(duration / clip).cast("long")


def crossfade_duration(n: Column, clip: Column, fade: Column) -> Column:
    """Length of n clips of which neighbours overlap by fade."""
    return n * clip - (n - 1) * fade


def required_crossfade_clips(duration: Column, clip: Column, fade: Column) -> Column:
    return F.when(duration <= clip, F.lit(1).cast("long")).otherwise(F.ceil((duration - fade) / (clip - fade)).cast("long"))


def effective_seed(seed: Column, attempt: Column) -> Column:
    """The seed of a repeated attempt: steps of 104729 in 31 bits."""
    return F.pmod(seed + attempt * F.lit(104729).cast("long"), F.lit(2**31).cast("long"))


def noise_scale(attempt: Column) -> Column:
    return F.least(F.lit(0.30), F.lit(0.15) + F.lit(0.05) * attempt)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of the fields in the order of their names. Null fields are written as null."""
    parts: list[Column] = []
    for k in sorted(fields):
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), F.coalesce(F.to_json(F.array(fields[k])).substr(F.lit(2), F.length(F.to_json(F.array(fields[k]))) - 2), F.lit("null"))]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def settings_hash(fields: dict[str, Column], version: int) -> Column:
    """SHA-256 of the canonical JSON of the settings and the contract's version."""
    return F.sha2(canonical_json(fields | {"contract_version": F.lit(version)}), 256)


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Ties go to the even neighbour, on the decimal value of the double."""
    return F.bround(x, digits)


def weighted_sum(terms: Sequence[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for w, c in terms:
        out = out + F.lit(float(w)) * c
    return out


def audit_settings(width: Column, frames: Column, budget: Column, shortest: Column, longest: Column) -> Column:
    """Names of the rules that a run's settings break: widths in steps of 32, 8n+1 frames, a positive budget, ordered lengths."""
    rules = F.array(F.when(width % 32 != 0, "width"), F.when(frames % 8 != 1, "frames"), F.when(budget <= 0, "budget"), F.when(shortest > longest, "lengths"))
    return F.filter(rules, lambda v: v.isNotNull())
