"""Greedy folds over a group's rows in a fixed order: suppression, leader clustering, marginal selection.

A fold collects one group's rows in one row, so groups must be bounded: candidates of one series (some thousands at most).
For unbounded groups of intervals `suppress_by_rounds` and `clusters_by_rounds` give the same rows without gathering any group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.sources.shared import discard, stored


def greedy_suppress(df: DataFrame, by: list[str], order: list[Column], carry: list[str], conflict: Callable[[Column, Column], Column], limit: int | None = None) -> DataFrame:
    """Rows that conflict with no row kept before, in the given order; carry plus `rank` (from 1, in acceptance order).

    order: aliased columns, ascending; conflict: of a row and a kept row, as structs of carry. At most limit rows stay.
    """
    row = F.struct(*order, F.struct(*carry).alias("x"))
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("all"))
    kind = df.select(F.struct(*carry).alias("x")).schema["x"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    full = (lambda acc: F.size(acc) >= limit) if limit is not None else (lambda acc: F.lit(False))
    fold = F.aggregate("all", none, lambda acc, r: F.when(full(acc) | F.exists(acc, lambda k: conflict(r["x"], k)), acc).otherwise(F.concat(acc, F.array(r["x"]))))
    out = groups.select(*by, F.posexplode(fold).alias("rank", "x"))
    return out.select(*by, (F.col("rank") + 1).alias("rank"), "x.*")


def greedy_marginal(df: DataFrame, by: list[str], ident: str, score: Column, carry: list[str], k: int, penalty: Callable[[Column, Column], Column], drop: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """by, pick (from 1), ident, adjusted and carry: in each of k rounds the row with the largest score less its largest penalty against a row picked before.

    penalty and drop are of a row and a picked one, as structs of carry; a row for which drop holds is left out. Ties go
    to the smaller ident. A native fold over a group's rows, which must be bounded, as above.
    """
    row = F.struct(score.cast("double").alias("s"), F.col(ident).alias("i"), F.struct(*carry).alias("x"))
    types = df.select(F.col(ident).alias("i"), F.struct(*carry).alias("x")).schema
    kind = f"array<struct<adj:double,i:{types['i'].dataType.simpleString()},x:{types['x'].dataType.simpleString()}>>"
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("all"))

    def pick(acc: Column, _: Column) -> Column:
        most = lambda r: F.aggregate(acc, F.lit(0.0), lambda m, y: F.greatest(m, penalty(r["x"], y["x"])))
        free = F.filter("all", lambda r: ~F.exists(acc, lambda y: (y["i"] == r["i"]) | (drop(r["x"], y["x"]) if drop else F.lit(False))))
        scored = F.transform(free, lambda r: F.struct((r["s"] - most(r)).alias("adj"), r["i"].alias("i"), r["x"].alias("x")))
        best = F.array_max(F.transform(scored, lambda r: r["adj"]))
        return F.when(F.size(scored) == 0, acc).otherwise(F.concat(acc, F.slice(F.filter(scored, lambda r: r["adj"] == best), 1, 1)))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.array().cast(kind), pick)
    out = groups.select(*by, F.posexplode(chosen).alias("p", "y"))
    return out.select(*by, (F.col("p") + 1).alias("pick"), F.col("y.i").alias(ident), F.col("y.adj").alias("adjusted"), "y.x.*")


def leader_clusters(df: DataFrame, by: list[str], order: list[Column], ident: str, carry: list[str], same: Callable[[Column, Column], Column]) -> DataFrame:
    """by, ident, cluster (from 1, in order of their leaders), is_leader: each row joins the first cluster whose leader it matches, else leads a new one.

    Rows are compared with leaders only, so this isn't the transitive closure. One pass: a group's rows are collected
    once, folded to their leaders, and matched with these in place.
    """
    me = F.struct(ident, *[c for c in carry if c != ident])
    groups = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, me.alias("x")))).alias("all"))
    none = F.array().cast(f"array<{df.select(me.alias('x')).schema['x'].dataType.simpleString()}>")
    fold = F.aggregate("all", none, lambda acc, r: F.when(F.exists(acc, lambda k: same(r["x"], k)), acc).otherwise(F.concat(acc, F.array(r["x"]))))
    rows = groups.withColumn("leaders", F.transform(fold, lambda k, i: F.struct((i + 1).alias("rank"), k.alias("x")))).select(*by, "leaders", F.explode("all").alias("r")).select(*by, "leaders", F.col("r.x").alias("me"))
    first = F.filter("leaders", lambda k: (k["x"][ident] == F.col("me")[ident]) | same(F.col("me"), k["x"]))[0]
    return rows.select(*by, F.col("me")[ident].alias(ident), first.alias("f")).select(*by, ident, F.col("f.rank").alias("cluster"), (F.col("f.x")[ident] == F.col(ident)).alias("is_leader"))


# ---------------------------------------------------------------- groups of any size


def _bins(lo: str, hi: str, width: float) -> Column:
    return F.sequence(F.floor(F.col(lo) / width).cast("long"), F.floor(F.col(hi) / width).cast("long"))


def _accept(df: DataFrame, by: list[str], order: list[Column], carry: list[str], conflict: Callable[[Column, Column], Column], lo: str, hi: str, width: float) -> DataFrame:
    """by, key (the order's struct, with the struct x of carry) of the rows that a greedy fold keeps. A row is stored once, with its first and last bin."""
    ends = [F.floor(F.col(c) / width).cast("long").alias(end) for c, end in ((lo, "_from"), (hi, "_to"))]
    left = stored(df.select(*by, F.struct(*order, F.struct(*carry).alias("x")).alias("key"), *ends).withColumn("id", F.monotonically_increasing_id()))
    bins, same = F.explode(F.sequence("_from", "_to")).alias("bin"), lambda a, b: [a[c].eqNullSafe(b[c]) for c in [*by, "bin"]]
    kept = []
    while not left.isEmpty():
        cells = left.select(*by, "id", "key", (F.col("_to") - F.col("_from") + 1).alias("n"), bins)
        first = cells.groupBy(*by, "bin").agg(F.min_by(F.struct("id", "key", "n"), F.struct("key", "id")).alias("f"))  # of equal rows the same one in all bins
        best = first.groupBy(*by, "f.id").agg(F.count(F.lit(1)).alias("m"), F.first("f").alias("f"), F.collect_list("bin").alias("bins"))
        won = stored(best.where(F.col("m") == F.col("f.n")).select(*by, F.col("f.id").alias("id"), F.col("f.key").alias("key"), "bins"))
        marks = won.select(*by, F.explode("bins").alias("bin"), F.col("key.x").alias("winner"), F.col("id").alias("winner_id"))
        met = left.select(*by, "id", F.col("key.x").alias("x"), bins)
        gone = met.join(marks, same(met, marks)).where((F.col("id") == F.col("winner_id")) | conflict(F.col("x"), F.col("winner"))).select("id").distinct()
        rest = stored(left.join(gone, "id", "left_anti"))
        discard(left)
        kept.append(won)
        left = rest
    discard(left)
    if not kept:
        return left.limit(0).select(*by, "key")
    out = kept[0].select(*by, "key")
    for x in kept[1:]:
        out = out.unionByName(x.select(*by, "key"))
    return out


def suppress_by_rounds(df: DataFrame, by: list[str], order: list[Column], carry: list[str], conflict: Callable[[Column, Column], Column], lo: str, hi: str, width: float, limit: int | None = None, fold_rows: int = 100) -> DataFrame:
    """The rows of greedy_suppress, for groups of any size.

    lo and hi: columns of numbers with lo <= hi, not null; rows that conflict must have overlapping stretches [lo, hi]. The line is cut in bins of `width`. In each round a row
    that comes first in the order in every bin that it touches is kept, as nothing that could be kept before it can conflict with it; then what conflicts with it
    goes. A bin keeps one row a round, so nothing is compared but rows with their bins' winners: a round costs rows times bins each, and rounds are as
    many as rows that are kept one after the other in a neighbourhood. width: about the length of a stretch.

    Each round writes and shuffles what is left several times. So groups of at most fold_rows rows are folded in place, for one shuffle of their
    rows, and only larger ones go through rounds; the rows are the same. A fold compares a row with those that its group keeps, so fold_rows bounds its cost.
    """
    rows, large = df, None
    if fold_rows:
        large = stored(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_rows).select(*by))
        if large.isEmpty():
            return greedy_suppress(df, by, order, carry, conflict, limit)
        of_large = lambda how: df.join(large, [df[c].eqNullSafe(large[c]) for c in by], how)
        rows = of_large("left_semi")
    won = _accept(rows, by, order, carry, conflict, lo, hi, width)
    ranked = won.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key")))
    out = (ranked.where(F.col("rank") <= limit) if limit is not None else ranked).select(*by, "rank", "key.x.*")
    return out if large is None else out.unionByName(greedy_suppress(of_large("left_anti"), by, order, carry, conflict, limit))


def clusters_by_rounds(df: DataFrame, by: list[str], order: list[Column], ident: str, carry: list[str], same: Callable[[Column, Column], Column], lo: str, hi: str, width: float) -> DataFrame:
    """The rows of leader_clusters, for groups of any size; lo, hi and width as for suppress_by_rounds, for rows that may be the same. Leaders are found by rounds; then each row meets the leaders of its bins."""
    names = [ident, *[c for c in carry if c != ident]]
    leaders = stored(_accept(df, by, order, names, same, lo, hi, width).withColumn("cluster", F.row_number().over(Window.partitionBy(*by).orderBy("key"))))
    extent = df.select(*by, F.col(ident).alias("_i"), _bins(lo, hi, width).alias("bins"))
    at = leaders.join(extent.withColumnRenamed("_i", "_l"), [*[leaders[c].eqNullSafe(extent[c]) for c in by], leaders["key"]["x"][ident] == F.col("_l")]).select(*[leaders[c] for c in by], "cluster", F.col("key.x").alias("leader"), F.explode("bins").alias("bin"))
    rows = df.select(*by, F.struct(*names).alias("me"), F.explode(_bins(lo, hi, width)).alias("bin"))
    met = rows.join(at, [*by, "bin"]).where((F.col("leader")[ident] == F.col("me")[ident]) | same(F.col("me"), F.col("leader")))
    first = met.groupBy(*by, F.col("me")[ident].alias(ident)).agg(F.min("cluster").alias("cluster"), F.max(F.col("leader")[ident] == F.col("me")[ident]).alias("is_leader"))
    return first.select(*by, ident, "cluster", "is_leader")


def marginal_by_rounds(df: DataFrame, by: list[str], ident: str, score: Column, carry: list[str], k: int, penalty: Callable[[Column, Column], Column], drop: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The rows of greedy_marginal, for groups of any size; the columns of by aren't null.

    In each of k rounds the group's rows meet the list of those picked so far, k at most, and the best one is found by an aggregation
    that Spark begins before its shuffle.
    """
    rows = stored(df.select(*by, score.cast("double").alias("s"), F.col(ident).alias("i"), F.struct(*carry).alias("x")))
    picked = None
    for k_th in range(1, k + 1):
        if picked is None:
            free = rows.withColumn("adj", F.col("s"))
        else:
            met = rows.join(picked.groupBy(*by).agg(F.collect_list(F.struct("i", "x")).alias("acc")), by)
            gone = F.exists("acc", lambda y: (y["i"] == F.col("i")) | (drop(F.col("x"), y["x"]) if drop else F.lit(False)))
            most = F.aggregate("acc", F.lit(0.0), lambda m, y: F.greatest(m, penalty(F.col("x"), y["x"])))
            free = met.where(~gone).withColumn("adj", F.col("s") - most)
        best = free.groupBy(*by).agg(F.min_by(F.struct("i", "adj", "x"), F.struct(-F.col("adj"), "s", "i")).alias("b")).select(*by, F.lit(k_th).alias("pick"), "b.*")
        before, picked = picked, stored(best if picked is None else picked.unionByName(best))
        if before is not None:
            discard(before)
    discard(rows)
    return picked.select(*by, "pick", F.col("i").alias(ident), F.col("adj").alias("adjusted"), "x.*")
