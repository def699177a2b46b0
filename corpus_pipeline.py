"""A corpus pipeline: toxicity, exact dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from seriesmill.llm.common import stored, table
from seriesmill.llm.queries import vocabulary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the machine is trained on all of labels."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where("score < 0.5").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    gone = near_dedup.near_duplicates(docs).where("not kept").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that also occur elsewhere are cut out; a document that consists of them keeps its row."""
    out = suffix_dedup.suffix_array_dedup(docs).select("row.*", F.col("kept_text").alias("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, mixed by source."""
    return packing.pack(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("near dedup", near), ("suffix-array dedup", passages), ("packing", packed)]

#: Not expressible: training, sampling and tokenising are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
