"""Preference learning from past choices: pairs (chosen - rejected), ridge fit from Gram sums, leave-one-group-out, scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.scalars import is_finite
from seriesmill.sources.shared import stored


def history_diagnostics(reports: DataFrame, current_track: Column | None = None) -> DataFrame:
    """skip_reason of each report (run_id, track_id, valid_json, chosen_index, n_selections); null for usable ones. The first reason that holds counts."""
    current = (F.col("track_id") == current_track) if current_track is not None else F.lit(False)
    reason = (
        F.when(F.col("track_id").isNull(), "missing_track").when(current, "current_track").when(~F.coalesce("valid_json", F.lit(False)), "invalid_json")
        .when(F.col("chosen_index").isNull(), "ambiguous_choice").when((F.col("n_selections") < 2) | (F.col("chosen_index") >= F.col("n_selections")), "invalid_selections")
    )
    return reports.withColumn("skip_reason", reason)


def diagnostics_counts(diagnosed: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: reports found and used, those skipped for each reason, and repeated pairs (the sum of duplicates.duplicates)."""
    rows = diagnosed.select("skip_reason", F.lit(1).alias("r"), F.lit(0).cast("long").alias("d"))
    if duplicates is not None:
        rows = rows.unionByName(duplicates.select(F.lit(None).cast("string").alias("skip_reason"), F.lit(0).alias("r"), F.col("duplicates").alias("d")))
    reasons = ("missing_track", "current_track", "invalid_json", "ambiguous_choice", "invalid_selections")
    return rows.agg(F.count_if(F.col("r") == 1).alias("found"), F.count_if((F.col("r") == 1) & F.col("skip_reason").isNull()).alias("used"), *[F.count_if(F.col("skip_reason") == r).alias(r) for r in reasons], F.coalesce(F.sum("d"), F.lit(0)).alias("duplicate_pairs"))


def strict_features(df: DataFrame, breakdown: str, names: list[str], group: list[str]) -> DataFrame:
    """features (array) of rows whose group is wholly finite: one bad value voids the group."""
    values = F.array(*[F.col(breakdown)[n].try_cast("double") for n in names])
    x = df.withColumn("features", values).withColumn("_ok", F.forall("features", is_finite))
    return x.withColumn("_all", F.min(F.col("_ok").cast("int")).over(Window.partitionBy(*group))).where("_all = 1").drop("_ok", "_all")


def permissive_features(df: DataFrame, breakdown: str, names: list[str]) -> DataFrame:
    """features (array) with NaN for what isn't a finite number."""
    one = lambda c: F.when(is_finite(c), c).otherwise(float("nan"))
    return df.withColumn("features", F.array(*[one(F.col(breakdown)[n].try_cast("double")) for n in names]))


def znorm_group(df: DataFrame, columns: list[str], group: list[str]) -> DataFrame:
    """z_<column>: z-score in the group with the population deviation; deviations of at most 1e-8 count as 1."""
    w = Window.partitionBy(*group)
    for c in columns:
        s = F.stddev_pop(c).over(w)
        df = df.withColumn(f"z_{c}", (F.col(c) - F.avg(c).over(w)) / F.when(s > 1e-8, s).otherwise(1.0))
    return df


def pairwise_differences(df: DataFrame, group: list[str], item: str, chosen: str, columns: list[str]) -> DataFrame:
    """group, item (of the rejected) and d_<column> = chosen - rejected, for groups with exactly one chosen row; pairs of no difference go."""
    n = F.sum(F.col(chosen).cast("int")).over(Window.partitionBy(*group))
    x = df.withColumn("_n", n).where("_n = 1").drop("_n")
    a = x.where(chosen).select(*group, *[F.col(c).alias(f"_{c}") for c in columns])
    b = x.where(~F.col(chosen))
    out = b.join(a, group).select(*group, item, *[(F.col(f"_{c}") - F.col(c)).alias(f"d_{c}") for c in columns])
    return out.where(F.sqrt(sum(F.col(f"d_{c}") * F.col(f"d_{c}") for c in columns)) > 1e-12)


def dedupe_pairs(df: DataFrame, track: str, columns: list[str], order: list[str], digits: int = 8) -> DataFrame:
    """The first of pairs whose columns, rounded to digits, repeat within a track."""
    keys = [F.round(c, digits).alias(f"_r{i}") for i, c in enumerate(columns)]
    x = df.select("*", *keys)
    w = Window.partitionBy(track, *[f"_r{i}" for i in range(len(columns))]).orderBy(*order)
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *[f"_r{i}" for i in range(len(columns))])


def duplicate_pairs(df: DataFrame, track: str, columns: list[str], digits: int = 8) -> DataFrame:
    """(track, pairs, duplicates): how many pairs dedupe_pairs keeps and drops."""
    once = df.groupBy(track, *[F.round(c, digits).alias(f"_r{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy(track).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("n") - 1).alias("duplicates"))


def group_grams(pairs: DataFrame, track: str, columns: list[str]) -> DataFrame:
    """For each track the sums that a ridge fit needs: g_i_j, b_i and n, each pair weighted by one over the track's pairs."""
    k, n = range(len(columns)), F.count(F.lit(1))
    mean = lambda c: F.sum(c) / n
    return pairs.groupBy(track).agg(*[mean(F.col(columns[i]) * F.col(columns[j])).alias(f"g_{i}_{j}") for i in k for j in k if i <= j], *[mean(F.col(columns[i])).alias(f"b_{i}") for i in k], n.alias("n"))


def _system(row, k: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.array([[float(row[f"g_{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)])
    return g, np.array([float(row[f"b_{i}"]) for i in range(k)])


def _solve(g: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    a = g + ridge * np.eye(len(b))
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a) @ b


def fit_pairwise_ridge(pairs: DataFrame, track: str, columns: list[str], ridge: float = 4.0) -> DataFrame:
    """(feature, weight): ridge weights for the target 1 of every pair. Spark sums the Gram matrix; only its k x k entries reach the driver."""
    k = len(columns)
    sums = group_grams(pairs, track, columns)
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != track]).first()
    if total is None or total["n"] is None:
        w = np.zeros(k)
    else:
        w = _solve(*_system(total, k), ridge)
    return pairs.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, w)], "feature string, weight double")


def leave_one_group_out(pairs: DataFrame, track: str, columns: list[str], ridge: float = 4.0) -> DataFrame:
    """(track, n, correct): pairs of each track that the weights fitted without it get right; margins of at most 1e-12 count one half.

    The sums without a track are the total less its own, so nothing is fitted from rows again. The total (k x k numbers)
    is the only thing that all tracks share. A track's weights are solved from its sums, and its pairs are judged by
    columns, wherever they lie: no task holds a track's pairs.
    """
    k = len(columns)
    sums = group_grams(pairs, track, columns)
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c != track]).first()
    out = f"track {pairs.schema[track].dataType.simpleString()}, n long, correct double"
    if total is None or total["n"] is None:
        return pairs.sparkSession.createDataFrame([], out)
    g, b = _system(total, k)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights = [_solve(g - own[0], b - own[1], ridge).tolist() for own in (_system(row, k) for _, row in pdf.iterrows())]
            yield pd.DataFrame({"track": pdf[track], "w": weights})

    # a table of known size, so that Spark sends few tracks' weights to the pairs and shuffles these only for many
    solved = stored(sums.mapInPandas(solve, f"track {pairs.schema[track].dataType.simpleString()}, w array<double>"))
    margin = sum(F.col(c) * F.col("w")[i] for i, c in enumerate(columns))
    right = F.when(F.abs(margin) <= 1e-12, 0.5).otherwise((margin > 0).cast("double"))
    return pairs.select(F.col(track).alias("track"), *columns).join(solved, "track").groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.sum(right).alias("correct"))


def gate_model(validation: DataFrame, min_tracks: int = 10, threshold: float = 0.55) -> DataFrame:
    """One row: tracks, pairs, accuracy, enabled, reason."""
    m = validation.agg(F.count(F.lit(1)).alias("tracks"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), (F.sum("correct") / F.sum("n")).alias("accuracy"))
    reason = F.when(F.col("tracks") < min_tracks, "too_few_tracks").when(F.col("tracks") < 2, "no_validation").when(F.coalesce("accuracy", F.lit(0.0)) <= threshold, "accuracy_too_low")
    return m.withColumn("reason", reason).withColumn("enabled", F.col("reason").isNull())


def score_preference(df: DataFrame, group: list[str], weights: dict[str, float] | None, enabled: bool = True) -> DataFrame:
    """preference: logistic of the weighted z-scores in the group; values that aren't finite become the group's median (0 if it has none). 0.5 if the model is disabled or has no weights."""
    if not enabled or weights is None:
        return df.withColumn("preference", F.lit(0.5))
    w = Window.partitionBy(*group)
    names = list(weights)
    meds = df.groupBy(*group).agg(*[F.percentile(F.when(is_finite(F.col(c)), F.col(c)), 0.5).alias(f"_m{i}") for i, c in enumerate(names)])
    x = df.join(meds, group)
    total = F.lit(0.0)
    for i, c in enumerate(names):
        x = x.withColumn(f"_x{i}", F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.coalesce(f"_m{i}", F.lit(0.0))))
        s = F.stddev_pop(f"_x{i}").over(w)
        total = total + F.lit(weights[c]) * (F.col(f"_x{i}") - F.avg(f"_x{i}").over(w)) / F.when(s > 1e-8, s).otherwise(1.0)
    x = x.withColumn("_u", total)
    return x.withColumn("preference", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("_u")))))).drop("_u", *[f"_x{i}" for i in range(len(names))], *[f"_m{i}" for i in range(len(names))])


def history_fingerprint(pairs: DataFrame, track: str, value: Column) -> DataFrame:
    """(track, fingerprint): SHA-256 over the values of a track, whatever the order of rows.

    The values' hashes are put into 4096 parts by their first three digits; a part's sorted hashes are hashed, and the
    parts' hashes again, so no task holds a track's values.
    """
    hashed = pairs.select(track, F.sha2(value.cast("string"), 256).alias("h"))
    parts = hashed.groupBy(track, F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: F.concat(x["p"], x["h"])), "")
    return parts.groupBy(track).agg(F.sha2(ordered, 256).alias("fingerprint"))
