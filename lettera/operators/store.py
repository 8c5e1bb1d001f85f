"""The document store's relational operators and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettera.functions.native import ascii_lower

DOCUMENT = "id string, kind string, url string, viewer_url string, issue_id string, article_id string, page_number int, publication string, title string, date string, language string, text_raw string, text_modern string, orthography string, old_score double, ocr_confidence double, source_type string, metadata string, fetched_at double"


def get_document(docs: DataFrame, id_: str) -> DataFrame:
    return docs.where(F.col("id") == id_)


def find_documents(docs: DataFrame, issue_id: str = "", publication: str = "", date_from: str = "", date_to: str = "", kind: str = "", language: str = "", limit: int = 50, offset: int = 0, order: Sequence[str] = ("date", "page_number", "id")) -> DataFrame:
    """Rows that meet every condition given. Dates compare as strings; publication is a LIKE substring that minds the case of ASCII letters only."""
    for c, v in (("issue_id", issue_id), ("kind", kind), ("language", language)):
        docs = docs.where(F.col(c) == v) if v else docs
    docs = docs.where(ascii_lower(F.col("publication")).like(f"%{publication.translate({c: c + 32 for c in range(65, 91)})}%")) if publication else docs
    docs = docs.where(F.col("date") >= date_from) if date_from else docs
    docs = docs.where(F.col("date") <= date_to) if date_to else docs
    return docs.orderBy(*(F.asc_nulls_first(c) for c in order)).offset(offset).limit(limit)


def group_counts(rows: DataFrame, *keys: str, missing: str = "?") -> DataFrame:
    """(key, value, n) for each key, in one pass by grouping sets; null and empty values count as `missing`."""
    filled = rows.select(*(F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(missing)).alias(k) for k in keys))
    sets = filled.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bits = {k: (1 << len(keys)) - 1 - (1 << (len(keys) - 1 - i)) for i, k in enumerate(keys)}
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, b in bits.items():
        name, value = F.when(F.col("g") == b, F.lit(k)).otherwise(name), F.when(F.col("g") == b, F.col(k)).otherwise(value)
    return sets.select(name.alias("key"), value.alias("value"), "n")


def totals(docs: DataFrame, issue: str = "issue_id", date: str = "date") -> DataFrame:
    """One row: documents, distinct issues, first and last date; empty strings are missing."""
    return docs.agg(F.count("*").alias("documents"), F.count_distinct(F.nullif(issue, F.lit(""))).alias("issues"), F.min(F.nullif(date, F.lit(""))).alias("first_date"), F.max(F.nullif(date, F.lit(""))).alias("last_date"))


def upsert(old: DataFrame, new: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The latest row of each key of both, by order."""
    return latest(old.unionByName(new), key, order)


def latest(rows: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """The row with the largest order of each key: an aggregate that combines before the shuffle, so a hot key costs a row a task."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(rows.columns)


def is_visited(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    return urls.join(frontier.where(F.col("state").isin("done", "skipped")).select("url"), "url", "left_semi")


def export_jsonl(docs: DataFrame, path: str, order: str) -> None:
    """A JSON object a line, in order; nulls are kept. Files follow each other in order of name."""
    docs.orderBy(order).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def with_metadata(docs: DataFrame) -> DataFrame:
    """metadata as a VARIANT; what is not JSON as an empty object."""
    return docs.withColumn("metadata", F.coalesce(F.try_parse_json("metadata"), F.parse_json(F.lit("{}"))))
