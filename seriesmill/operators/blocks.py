"""Numbers, totals and percentiles of whole groups of any size, by blocks of a group, so that no task gets all of it.

A block is a struct of the group's key and a number; only one row for each block meets the group's other blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seriesmill.sources.shared import stored


def block_of(key: str, order: Column, bits: int) -> Column:
    """The block of a row: its key, and which stretch of 2^bits values its order lies in."""
    return F.struct(F.col(key), F.shiftright(order.cast("long"), bits).alias("at"))


def _group(key: str, block: str):
    return Window.partitionBy(F.col(block)[key])


def numbered(df: DataFrame, key: str, order: str, out: str, bits: int = 12) -> DataFrame:
    """df with `out`: the row's number from 0 within its key, in the order of a column, nulls last.

    Rows are numbered within blocks, behind the counts of the earlier blocks. Blocks are 2^bits values of an integer column,
    which hold about as many rows as values if these repeat little, and are few if they lie densely, as ids do. Rows in
    the order of any other column are stored in ranges of it first.
    """
    if isinstance(df.schema[order].dataType, IntegralType):
        x = df.withColumn("_block", block_of(key, F.col(order), bits))
    else:
        x = stored(df.repartitionByRange(F.col(key), F.col(order).asc_nulls_last()).withColumn("_block", F.struct(F.col(key), F.spark_partition_id().alias("at"))))
    sizes = x.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = _group(key, "_block").orderBy(F.col("_block.at").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_block").orderBy(F.col(order).asc_nulls_last()))
    return x.join(starts, "_block").withColumn(out, F.col("_start") + within - 1).drop("_block", "_start")


def group_totals(df: DataFrame, key: str, block: str = "_block", **totals: tuple[Callable[..., Column], Column]) -> DataFrame:
    """(block, totals): for each block of df the totals of its whole group; each is an aggregate that combines with itself (sum, min, max) and its column."""
    parts = df.groupBy(block).agg(*[f(c).alias(name) for name, (f, c) in totals.items()])
    return parts.select(block, *[f(F.col(name)).over(_group(key, block)).alias(name) for name, (f, _) in totals.items()])


def with_group_rows(df: DataFrame, rows: DataFrame, key: str, block: str = "_block") -> DataFrame:
    """df with the columns of rows, which has one row for each key; joined by blocks, so that a large group isn't dealt by its key."""
    blocks = df.select(block).distinct().withColumn(key, F.col(block)[key])
    return df.join(blocks.join(rows, key).drop(key), block)


def group_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float], block: str = "_block", bins: int = 1024) -> DataFrame:
    """(key, percentiles by name): exact, linear between neighbouring values, for finite values.

    Counts of equal bins between a group's extremes say which bins hold the wanted ranks; only the distinct values of those are ordered.
    """
    ends = group_totals(df, key, block, _low=(F.min, F.col(value)), _high=(F.max, F.col(value)), _n=(F.sum, F.lit(1)))
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins))
    x = df.join(ends, block).select(key, F.col(value).alias("_v"), "_n", F.when(F.col("_high") > F.col("_low"), at).otherwise(0).alias("_bin"))
    ranks = {name: share * (F.col("_n") - 1) for name, share in shares.items()}
    wanted = [f(rank) for rank in ranks.values() for f in (F.floor, F.ceil)]

    def spans(rows: DataFrame, by: list[str], order: str, start: Column) -> DataFrame:
        upto = F.sum("_rows").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("_to", start + upto).withColumn("_from", F.col("_to") - F.col("_rows"))

    def holds(rank: Column) -> Column:
        return (F.col("_from") <= rank) & (rank < F.col("_to"))

    counts = x.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_n"))
    held = [holds(w) for w in wanted]
    some = held[0]
    for h in held[1:]:
        some = some | h
    needed = spans(counts, [key], "_bin", F.lit(0)).where(some).select(key, "_bin", F.col("_from").alias("_start"))
    values = x.join(needed, [key, "_bin"]).groupBy(key, "_bin", "_v").agg(F.count(F.lit(1)).alias("_rows"), F.max("_n").alias("_n"), F.max("_start").alias("_start"))
    values = spans(values, [key, "_bin"], "_v", F.col("_start"))
    found = values.groupBy(key).agg(F.max("_n").alias("_n"), *[F.max(F.when(holds(w), F.col("_v"))).alias(f"_v{i}") for i, w in enumerate(wanted)])
    between = {name: F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * (rank - F.floor(rank)) for i, (name, rank) in enumerate(ranks.items())}
    return found.select(key, *[c.alias(name) for name, c in between.items()])
