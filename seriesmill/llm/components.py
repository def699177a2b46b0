"""Connected components of a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the smallest node of its component.

    Alternates two steps until no link changes: each node's larger neighbours are linked to the smallest node around
    it, then its smaller ones. The links shrink to stars, in about as many rounds as the logarithm of the longest path.
    Loops and repeated links don't matter; an empty table gives an empty result. A node's links are only aggregated and
    joined, never gathered in one row, so a node may have any number of them.
    """
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = mark(now)
    while True:
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("root"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("root").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("root"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("root").alias("v")), F.struct(F.col("v").alias("u"), F.col("root").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        small = stored(small)
        this = mark(small)
        discard(now)
        if this == last:
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, last = small, this
