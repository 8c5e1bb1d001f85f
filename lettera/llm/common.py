"""What the operators share: tables, the shared folder, checkpoints, session limits."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Bytes that go to a Python worker at once, and Spark's setting of them.
BATCH_BYTES, BATCH_SETTING = 2 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's setting that removes a query's shuffle files with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a temporary one in local mode, which has no other machine, and else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext.getCheckpointDir()):
        found = own
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lettera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of some BATCH_BYTES to Python workers, unless its own setting says otherwise.

    Spark's own batches are of 10,000 rows, tens of MB of texts. Executor and worker hold each several times, and their allocators keep that memory.
    Results don't depend on batches. The setting stays, as a DataFrame runs only after the function that made it.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Within it, actions send batches of some `size` bytes to Python workers; after it the session's own setting holds again."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before) if before is not None else spark.conf.unset(BATCH_SETTING)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one that an operator wrote and nothing reads again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder; a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder. Its shuffle files, which nothing reads again, are removed with the end of the write."""
    spark, at = df.sparkSession, shared_path(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(at)


def shuffled(df: DataFrame) -> DataFrame:
    """df marked so that joins with it are sort-merge joins. Without the mark a side that is small when measured is broadcast, which is put together in the driver's memory."""
    return df.hint("merge")


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows that it is small; call it on checkpointed rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased."""
    return text.lower().split()


def without_copies(docs: DataFrame, key: Column, mark: Column, decided: DataFrame) -> DataFrame:
    """docs without the rows whose (key, mark) is in decided (i, h, kept, n) as not kept; of n rows that are kept under one (key, mark), one stays. Columns as they were.

    Rows are told apart by key and mark together, so a key may repeat with other texts, and be null. decided
    holds only rows that have company; what moves is each row once, dealt by both.
    """
    rows = docs.select(F.struct("*").alias("row"), key.alias("i"), mark.alias("h"))
    same = lambda d: rows_of["i"].eqNullSafe(d["i"]) & (rows_of["h"] == d["h"])
    gone, twice = decided.where("not kept").select("i", "h"), decided.where("kept and n > 1").select("i", "h")
    rows_of = rows
    rest = rows.join(gone, same(gone), "left_anti")
    if not twice.isEmpty():
        rows_of = rest
        single = rest.join(twice, same(twice), "left_semi").groupBy("i", "h").agg(F.first("row").alias("row"))
        rest = rest.join(twice, same(twice), "left_anti").select("row").union(single.select("row"))
    return rest.select("row.*")
