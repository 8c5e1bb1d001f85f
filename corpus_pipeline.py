"""A training-data pipeline over `documents`: quality filter, exact dedup, near dedup, benchmark decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is
written as Parquet and read again before the next. All but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettera.llm.common import in_small_batches, read_table, shared_path
from lettera.llm.decontam import drop_contaminated
from lettera.llm.exact_dedup import drop_exact_copies
from lettera.llm.quality import keep_good
from lettera.llm.near_copies import drop_near_copies
from lettera.llm.sentence_pieces import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of SentencePiece ids of its text, and the ids."""
    in_small_batches(spark)
    # of the texts nothing goes along
    found = encode(docs, then=lambda t: t.select(["id", "ids"]), gives="ids array<int>", carry=lambda raw: b"")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", decontaminate), ("sentence_pieces", tokenize)]

#: The classifier of the first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
