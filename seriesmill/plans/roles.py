"""The given tables in the roles of the library's inputs, as DataFrames and, for the SQL twins, as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesmill.operators.blocks import numbered

FPS = 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Curves derived from event_id: multiplier and modulus.
_CURVES = {"onset": (7919, 101), "novelty": (104729, 97), "bass": (31, 89), "vocal": (17, 83), "flatness": (13, 79), "density": (11, 73), "centroid": (23, 71)}


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a series of frames, one second each."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = e.select(
        F.col("user_id").alias("series_id"), (F.row_number().over(w) - 1).cast("int").alias("frame_idx"), "event_type", "event_id", (F.col("value") / (F.col("value") + 50.0)).alias("rms"),
        *[(F.pmod(F.col("event_id") * a, F.lit(m)) / float(m - 1)).alias(c) for c, (a, m) in _CURVES.items()],
    )
    return x.withColumn("t", F.col("frame_idx").cast("double")).withColumn("vec", F.array("rms", "onset", "bass"))


FRAMES = (
    "frames AS (SELECT *, CAST(frame_idx AS DOUBLE) AS t FROM (SELECT user_id AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame_idx, event_type, event_id, value / (value + 50.0) AS rms, "
    + ", ".join(f"((event_id * {a}) % {m}) / {m - 1}.0 AS {c}" for c, (a, m) in _CURVES.items())
    + " FROM events))"
)


def points(f: DataFrame) -> DataFrame:
    """A quarter of a second after each purchase."""
    return f.where("event_type = 'purchase'").select("series_id", (F.col("frame_idx") + 0.25).alias("t"))


POINTS = "points AS (SELECT series_id, frame_idx + 0.25::DOUBLE AS t FROM frames WHERE event_type = 'purchase')"


def series(f: DataFrame) -> DataFrame:
    return f.groupBy("series_id").agg((F.max("frame_idx") + 1).alias("n"), (F.max("frame_idx") + 1).cast("double").alias("duration"))


SERIES = "series AS (SELECT series_id, max(frame_idx) + 1 AS n, CAST(max(frame_idx) + 1 AS DOUBLE) AS duration FROM frames GROUP BY series_id)"

#: Components of the given embeddings.
DIMS = 64


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as a series of vectors."""
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("series_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return numbered(x, "series_id", "vec_id", "frame_idx").select("series_id", F.col("frame_idx").cast("int").alias("frame_idx"), "vec")


VECTORS = (
    "vectors AS (SELECT label AS series_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS frame_idx, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(DIMS))
    + " FROM embeddings)"
)

_VIDEO = "CAST(floor(vec_id / 400) AS BIGINT) * 1000 + label"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of a label as grey frames, in videos: one for every 400 ids, so that there are more of them in a larger table."""
    w = Window.partitionBy(F.expr(_VIDEO)).orderBy("vec_id")
    grey = F.transform("embedding", lambda x: F.floor(F.pmod(F.abs(x.cast("double")) * 640.0, F.lit(256.0))).cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.expr(_VIDEO).alias("video_id"), (F.row_number().over(w) - 1).cast("int").alias("frame_idx"), grey.alias("pixels"))


PIXELS = f"pixels AS (SELECT {_VIDEO} AS video_id, CAST(row_number() OVER (PARTITION BY {_VIDEO} ORDER BY vec_id) - 1 AS INT) AS frame_idx, [floor(fmod(abs(CAST(x AS DOUBLE)) * 640.0, 256.0)) FOR x IN embedding] AS pixels FROM embeddings)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as scored intervals with nuclei."""
    o = table(spark, sf_dir, "orders")
    start, d = F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double"), (20 + F.pmod("o_orderkey", F.lit(40))).cast("double")
    x = o.select(F.col("o_custkey").alias("series_id"), F.col("o_orderkey").alias("candidate_id"), start.alias("start_time"), (start + d).alias("end_time"), (F.col("o_totalprice") / 500000.0).alias("quality_score"))
    return x.withColumn("nucleus_start", F.col("start_time") + (F.col("end_time") - F.col("start_time")) * 0.25).withColumn("nucleus_end", F.col("start_time") + (F.col("end_time") - F.col("start_time")) * 0.5)


CANDIDATES = (
    "cand0 AS (SELECT o_custkey AS series_id, o_orderkey AS candidate_id, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start_time, CAST(20 + o_orderkey % 40 AS DOUBLE) AS d, o_totalprice / 500000.0 AS quality_score FROM orders), "
    "cand AS (SELECT series_id, candidate_id, start_time, start_time + d AS end_time, quality_score, start_time + (start_time + d - start_time) * 0.25 AS nucleus_start, start_time + (start_time + d - start_time) * 0.5 AS nucleus_end FROM cand0)"
)

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the selections of a report; returned ones are the choices."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report"), F.col("l_linenumber").alias("item"), F.pmod("l_orderkey", F.lit(20)).alias("track"), (F.col("l_returnflag") == "R").alias("chosen"), "l_partkey", "l_suppkey", *FEATURES)


SELECTIONS = "sel AS (SELECT l_orderkey AS report, l_linenumber AS item, l_orderkey % 20 AS track, l_returnflag = 'R' AS chosen, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines; errors become quota, fatal and other failures."""
    e = table(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    line = F.when(bad & (F.col("event_id") % 3 == 0), "backend said: quota exceeded").when(bad & (F.col("event_id") % 11 == 1), "No such file or directory").when(bad, F.concat(F.lit("step failed "), "props")).otherwise(F.concat("event_type", F.lit(" "), "props"))
    return e.select((F.col("user_id") % 10).alias("run_id"), F.concat(F.lit("stage"), (F.col("user_id") % 5).cast("string")).alias("stage"), F.col("user_id").alias("attempt"), F.when(F.col("event_id") % 7 == 0, "stderr").otherwise("stdout").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("line_no"), line.alias("line"))


LINES = (
    "lines AS (SELECT user_id % 10 AS run_id, 'stage' || CAST(user_id % 5 AS VARCHAR) AS stage, user_id AS attempt, CASE WHEN event_id % 7 = 0 THEN 'stderr' ELSE 'stdout' END AS stream, ts, event_id AS line_no, "
    "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'backend said: quota exceeded' WHEN event_type = 'error' AND event_id % 11 = 1 THEN 'No such file or directory' WHEN event_type = 'error' THEN 'step failed ' || props ELSE event_type || ' ' || props END AS line FROM events)"
)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), "text")


PROMPTS = "prompts AS (SELECT conv_id AS run_id, turn AS idx, text FROM conversations)"
