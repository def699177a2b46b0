"""Joins on runs, clips and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending_clips(clips: DataFrame, reports: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """Clips without a valid report for the same keys (clip, prompt hash, settings hash)."""
    return clips.join(reports.where(valid).select(*keys), keys, "left_anti")


def batch_members(clips: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return clips.join(batch.select(key), key, "left_semi")


def missing_keys(required: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Required keys that aren't there, once each; none means full coverage."""
    return required.select(*keys).distinct().join(have.select(*keys), keys, "left_anti")


def skip_existing(runs: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    return runs if force else runs.join(done.select(key), key, "left_anti")


def interval_overlap_join(a: DataFrame, b: DataFrame, key: str, least_ratio: float, bin_width: float, ids: tuple[str, str]) -> DataFrame:
    """(key, id of a, id of b, ratio): intervals of one key that overlap by least_ratio of the shorter one.

    Both sides are exploded into time bins and joined on (key, bin); a pair is taken only in the first bin that both are
    in, so it comes once without a distinct. An interval makes as many rows as it has bins, so choose bins of about the
    usual length.
    """
    bins = lambda df, p: df.select(key, F.col(ids[p == "b"]).alias(f"{p}_id"), F.col("start_time").alias(f"{p}s"), F.col("end_time").alias(f"{p}e")).withColumn(f"{p}0", F.floor(F.col(f"{p}s") / bin_width)).withColumn("bin", F.explode(F.sequence(F.col(f"{p}0"), F.floor(F.col(f"{p}e") / bin_width))))
    both = bins(a, "a").join(bins(b, "b"), [key, "bin"]).where(F.col("bin") == F.greatest("a0", "b0"))
    common = F.least("ae", "be") - F.greatest("as", "bs")
    ratio = F.when(common <= 0, 0.0).otherwise(common / F.greatest(F.lit(1e-6), F.least(F.col("ae") - F.col("as"), F.col("be") - F.col("bs"))))
    return both.withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio).select(key, "a_id", "b_id", "ratio")


def lag_self_join(df: DataFrame, key: str, order: str, value: str, lag: int, later: str) -> DataFrame:
    """Rows with a row of the same key `lag` places later, and that row's value as `later`: an equi-join."""
    b = df.select(key, (F.col(order) - lag).alias(order), F.col(value).alias(later))
    return df.join(b, [key, order])


def cross_expand(df: DataFrame, **values: list) -> DataFrame:
    """Every row with every combination of the literal values."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in options])))
    return df
