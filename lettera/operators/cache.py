"""The response cache as a table of what was fetched when: what a request at some time would be answered with, and stored bodies."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, key: str, at: str, order: list[str], values: dict[str, Column], width: float) -> DataFrame:
    """rows with, for each name of values, its last non-null value up to the row, by at and then order.

    Rows are worked on by key and span of `width`, and what was last before a span comes from a table of one row a span, so a key of very many rows is
    spread over its spans.
    """
    span = rows.withColumn("_span", F.floor(F.col(at) / width))
    own = Window.partitionBy(key, "_span").orderBy(at, *order)
    within = span.withColumns({f"_own_{n}": F.last(c, ignorenulls=True).over(own) for n, c in values.items()})
    pick = F.struct(at, *order)
    ends = span.groupBy(key, "_span").agg(*(F.max_by(c, F.when(c.isNotNull(), pick)).alias(n) for n, c in values.items()))
    carried = ends.select(F.col(key).alias("_key"), F.col("_span").alias("_s"), *(F.last(n, ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}") for n in values))
    both = within.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_span").eqNullSafe(F.col("_s")))
    return both.select(*rows.columns, *(F.coalesce(f"_own_{n}", f"_before_{n}").alias(n) for n in values))


def lookups(history: DataFrame, requests: DataFrame, ttl: float = 7 * 86_400, span: float = 86_400) -> DataFrame:
    """(id, url, at, answer, etag, last_modified, content_hash, age) for each request (id, url, at), out of history (url, fetched_at, status, etag, last_modified, content_hash).

    A stored response is the last of status 200 at or before the request, by the URL that was asked for; a 304 after it
    makes it fresh again and keeps its validators; other answers store nothing. answer is miss (nothing stored), hit (younger than ttl), revalidate (older, with
    validators to send) or refetch (older, without). Of rows of one time the one with the larger hash counts.
    """
    event = history.select("url", F.col("fetched_at").alias("at"), F.lit(0).alias("is_request"), F.coalesce("content_hash", F.lit("")).alias("tie"), F.lit(None).cast(requests.schema["id"].dataType).alias("id"), F.when(F.col("status") == 200, F.struct("etag", "last_modified", "content_hash")).alias("whole"), F.when(F.col("status").isin(200, 304), F.col("fetched_at")).alias("touch"))
    asked = requests.select("url", "at", F.lit(1).alias("is_request"), F.lit("").alias("tie"), "id", F.lit(None).cast(event.schema["whole"].dataType).alias("whole"), F.lit(None).cast("double").alias("touch"))
    found = last_before(event.unionByName(asked), "url", "at", ["is_request", "tie"], {"kept": F.col("whole"), "touched": F.col("touch")}, span).where("is_request = 1")
    age = F.when(F.col("kept").isNotNull(), F.col("at") - F.col("touched"))
    answer = F.when(F.col("kept").isNull(), "miss").when(age < ttl, "hit").when(F.coalesce("kept.etag", "kept.last_modified").isNotNull(), "revalidate").otherwise("refetch")
    return found.select("id", "url", "at", answer.alias("answer"), "kept.etag", "kept.last_modified", "kept.content_hash", age.alias("age"))


def plain(raw: bytes, encoding: str) -> bytes:
    """A body without its content encoding: gzip, or deflate with or without its head; a broken one as it is."""
    kind = (encoding or "").lower()
    for name, undo in (("gzip", gzip.decompress), ("deflate", zlib.decompress), ("deflate", lambda x: zlib.decompress(x, -zlib.MAX_WBITS))):
        if name in kind:
            try:
                return undo(raw)
            except (OSError, EOFError, zlib.error):
                continue
    return raw


def bodies(resources: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """(url, body, content_hash, error) of resources (url, body, encoding): bodies decompressed, with their SHA-256; one of over `limit` bytes as stored has an error in place of a body. Null bodies are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if len(x or b"") > limit else plain(x or b"", e) for x, e in zip(b["body"].to_pylist(), b["encoding"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["url"], pa.array(out, pa.binary())], ["url", "body"])

    made = resources.select("url", "body", "encoding").mapInArrow(run, "url string, body binary")
    return made.select("url", "body", F.sha2("body", 256).alias("content_hash"), F.when(F.col("body").isNull(), f"over {limit} bytes").alias("error"))
