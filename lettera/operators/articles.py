"""From page blocks to articles: reading order, block ranges, assembly, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettera.functions.native import document_id


def column_order(blocks: DataFrame, page: str = "page_id") -> DataFrame:
    """blocks with reading_pos: by column, then from top to bottom. A page has as many columns, 1 to 12, as its width has upper-median widths of the blocks that have one.

    A page without a width is as wide as its blocks reach. Columns have fractional widths; a block's column is the whole quotient, by an exact remainder.
    """
    reach = F.max(F.col("hpos") + F.col("width"))
    sizes = blocks.groupBy(page).agg(F.array_sort(F.collect_list(F.when(F.col("width") > 0, F.col("width")))).alias("w"), F.coalesce(F.nullif(F.max("page_width"), F.lit(0)), F.nullif(reach, F.lit(0)), F.lit(1)).alias("pw"))
    median = F.get("w", F.floor(F.size("w") / 2).cast("int"))
    columns = F.coalesce(F.least(F.greatest(F.bround(F.col("pw") / median), F.lit(1)), F.lit(12)), F.lit(1))
    placed = blocks.join(sizes.select(page, (F.col("pw") / columns).alias("_cw")), page)
    column = F.round((F.col("hpos") - F.pmod(F.col("hpos").cast("double"), F.col("_cw"))) / F.col("_cw"))
    by = Window.partitionBy(page).orderBy(column, "vpos", "hpos", "pos")
    return placed.withColumn("reading_pos", F.row_number().over(by)).drop("_cw")


def area_blocks(areas: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks of each area (area_id, page_id, begin, end): a range of positions on its page.

    No begin: the whole page. An unknown begin: none; an unknown end: the first block alone; a range the wrong way round is turned.
    """
    where = blocks.select(F.col("page_id").alias("_p"), F.col("block_id").alias("_b"), F.col("pos").alias("_pos"))
    first = areas.join(where.withColumnRenamed("_pos", "_from"), (F.col("page_id") == F.col("_p")) & (F.col("begin") == F.col("_b")), "left").drop("_p", "_b")
    both = first.join(where.withColumnRenamed("_pos", "_to"), (F.col("page_id") == F.col("_p")) & (F.col("end") == F.col("_b")), "left").drop("_p", "_b")
    known = both.where((F.coalesce("begin", F.lit("")) == "") | F.col("_from").isNotNull()).withColumn("_to", F.coalesce("_to", "_from"))
    low, high = F.coalesce(F.least("_from", "_to"), F.lit(-(1 << 31))), F.coalesce(F.greatest("_from", "_to"), F.lit((1 << 31) - 1))
    found = known.withColumns({"_low": low, "_high": high}).join(blocks, "page_id")
    return found.where(F.col("pos").between(F.col("_low"), F.col("_high"))).drop("_from", "_to", "_low", "_high")


def assemble(area_rows: DataFrame, key: str = "div_id") -> DataFrame:
    """Articles: texts of their blocks in order of area and position with blank lines between; pages; mean of block confidences."""
    kept = area_rows.where(F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.struct("area_id", "pos", "text")))
    return kept.groupBy(key).agg(parts.alias("_t"), F.array_sort(F.collect_set("page_number")).alias("page_numbers"), F.avg("confidence").alias("confidence")).select(
        key, F.array_join(F.transform("_t", lambda x: x["text"]), "\n\n").alias("text"), "page_numbers", "confidence"
    )


def page_confidence(strings: DataFrame) -> DataFrame:
    """Mean over blocks of the mean over lines of the mean over strings."""
    lines = strings.groupBy("page_id", "block_id", "line_id").agg(F.avg("confidence").alias("c"))
    return lines.groupBy("page_id", "block_id").agg(F.avg("c").alias("c")).groupBy("page_id").agg(F.avg("c").alias("confidence"))


def documents(articles: DataFrame, functions: dict) -> DataFrame:
    """Documents of articles (url, issue_id, article_id, page_number, title, text): analysed, with id, language, date and orthography."""
    a = functions["analyze_article"](F.col("text"))
    rows = articles.withColumn("_a", a)
    return rows.select("*", document_id(F.col("url"), F.col("issue_id"), F.col("article_id"), F.col("page_number").cast("string"), F.substring("title", 1, 60)).alias("id"), "_a.text_raw", "_a.text_modern", "_a.orthography", "_a.old_score", "_a.language", "_a.date", "_a.places").drop("_a", "text")
