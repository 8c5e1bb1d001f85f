"""How much of a table a Python worker gets at a time."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def in_small_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of some BATCH_BYTES to Python workers, unless its own setting says otherwise.

    Spark's own batches are of 10,000 rows or 64 MB, of which a worker holds several copies and more as Python's strings. Results don't depend on batches.
    The setting stays, as a DataFrame runs only after the function that made it.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
