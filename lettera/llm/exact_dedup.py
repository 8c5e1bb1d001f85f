"""Exact dedup by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of the normalised text, groups of two or more by
a hash of its prefix, and what still has company by SHA-256 of the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_or_not, without_copies


def normalised(text: str = "text"):
    """Each run of [\\x20\\x09-\\x0D] as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, hash_all: bool = False) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the least id stays. Null counts as the empty text,
    which is a text like others. Rows that repeat an id together with its text
    count in group_size and share the decision. A null id stays only if its group has
    no other; then keep_id is null. An empty table gives no rows; other columns are
    ignored, whatever their names. text_sha256 is null where refinement ended
    before the whole text had to be hashed, unless hash_all is set.

    Only (id, length, prefix hash, digest) rows are shuffled; texts move only if
    the surviving groups are too many to broadcast, and only without hash_all.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t")).select("id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p"), "t")
    digest = F.unhex(F.sha2("t", 256)).alias("h")
    # with hash_all each text is read and normalised once
    hashed = checkpointed(rows.select("id", "n", "p", digest)) if hash_all else None
    short = hashed.drop("h") if hash_all else checkpointed(rows.drop("t"))
    lengths = short.groupBy("n").count().where("count > 1").select("n")
    survivors = checkpointed(short.join(lengths, "n", "left_semi").groupBy("n", "p").count().where("count > 1").select("n", "p"))
    if not hash_all:
        full = rows.join(small_or_not(survivors), ["n", "p"], "left_semi").select("id", "n", "p", digest)
        alone = short.join(survivors, ["n", "p"], "left_anti").select("id", "n", "p", F.lit(None).cast("binary").alias("h"))
        hashed = checkpointed(full.union(alone))
    groups = hashed.join(survivors, ["n", "p"], "left_semi").groupBy("n", "p", "h").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return (
        hashed.join(groups, ["n", "p", "h"], "left")
        .select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("h")).alias("text_sha256"))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each normalised text, that of least id; columns as they were.

    Decisions are taken by row: another text under an id that is dropped stays, and of rows that repeat an id with its text one stays.
    A null text equals an empty one. A row with a null id stays only if no row with an id has its text. An empty table gives no rows.
    """
    found = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    decided = checkpointed(found.groupBy(F.col(id_col).alias("i"), F.unhex("text_sha256").alias("h"), "kept").agg(F.count("*").alias("n")))
    return without_copies(docs, F.col(id_col), F.unhex(F.sha2(normalised(text_col), 256)), decided)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), hash_all=True)


OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""
