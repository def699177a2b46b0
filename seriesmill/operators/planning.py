"""Sampling and planning tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.operators.blocks import numbered


def sample_epochs(items: DataFrame, key: str, order: str, n: Column, seed: int, shuffle: bool = True) -> DataFrame:
    """(key, position, order): n draws for each key (n is a column of items) that repeat an item only after a full pass over all.

    With shuffle, the order of each pass follows a hash of item, pass and seed; without, the given order repeats. The
    number of passes is computed, so only the rows that are asked for are made, and one partial pass.
    """
    w = Window.partitionBy(key)
    x = items.select(key, order, n.alias("_n")).withColumn("_size", F.count(F.lit(1)).over(w)).where("_n > 0")
    x = x.withColumn("_pass", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.col("_size")) - 1).cast("int"))))
    inner = [F.xxhash64(F.col(order), F.col("_pass"), F.lit(seed)), F.col(order)] if shuffle else [F.col(order)]
    return x.withColumn("position", F.row_number().over(w.orderBy("_pass", *inner)) - 1).where("position < _n").select(key, "position", order)


def evenly_spaced(n: Column, k: int) -> Column:
    """Array of k indices spread over 0 .. n-1, halves to even; all of them if k >= n, the first if k is 1."""
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / (k - 1)).cast("long"))
    return F.when(n <= k, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(some)


def assign_choice(pool: list[str], seed: int, *keys: Column) -> Column:
    """A seeded choice from the pool for each row."""
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(len(pool))) + 1).cast("int"))


def make_batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """(by, batch, ids): consecutive chunks of `size` in order; no task numbers a whole group."""
    x = numbered(df.select(by, order), by, order, "_k", bits=10).withColumn("batch", F.floor(F.col("_k") / size))
    return x.groupBy(by, "batch").agg(F.array_sort(F.collect_list(order)).alias("ids"))


def plan_run(items: DataFrame, key: str, order: str, n: Column, seed: int, modes: list[str], version: int) -> DataFrame:
    """One row for each planned clip: index, item, seed, mode, contract version, path, status."""
    from seriesmill.functions.scalars import effective_seed
    from seriesmill.operators.textrules import mode_schedule

    x = sample_epochs(items, key, order, n, seed)
    return x.select(
        key, F.col("position").alias("clip_index"), order, effective_seed(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(2**31)), F.col("position").cast("long")).alias("seed"),
        mode_schedule(F.col("position"), modes).alias("mode"), F.lit(version).alias("contract_version"), F.format_string("clips/%s/%04d.mp4", F.col(key).cast("string"), F.col("position").cast("int")).alias("path"), F.lit("planned").alias("status"),
    )
