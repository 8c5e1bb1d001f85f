"""Parsed formats as DataFrames: one row per resource in, flat rows out, parsed in Arrow batches on the executors."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lettera.functions.batches import in_small_batches

from . import parsers as P

BLOCKS = "source_url string, page_id string, page_number int, page_width int, pos int, block_id string, parent_id string, type string, hpos int, vpos int, width int, height int, text string, confidence double"
#: Parsed rows that a batch has.
ROWS = 5000


def in_columns(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(fields), fields)], schema=fields)


def parse_rows(resources: DataFrame, parse, schema: str) -> DataFrame:
    """parse(url, bytes) -> rows; a resource that cannot be parsed gives none. Rows go on some thousands at a time, however many a batch of resources gives."""
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for url, body in zip(b["url"], b["body"]):
                try:
                    rows += parse(url.as_py(), body.as_py() or b"")
                except (ValueError, SyntaxError, KeyError):  # XML errors are SyntaxErrors
                    continue
                if len(rows) >= ROWS:
                    yield in_columns(rows, fields)
                    rows = []
            yield in_columns(rows, fields)

    in_small_batches(resources.sparkSession)
    return resources.select("url", "body").mapInArrow(run, schema)


def with_format(resources: DataFrame) -> DataFrame:
    """resources (url, body, content_type) with the format that parsers.sniff gives, natively. A null body is empty."""
    head = F.lower(F.decode(F.coalesce(F.substring("body", 1, 4096), F.lit(b"")), "ISO-8859-1"))  # all marks are ASCII
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    html = F.startswith(kind, F.lit("text/html"))
    text = F.when(html, "html").when(F.startswith(kind, F.lit("text/")) | (kind == ""), "text").otherwise("binary")

    def sniffed(head):
        start = F.regexp_extract(head["start"], "^[ \t-\r]*([^ \t-\r])", 1)
        found = F.when(html, "html").otherwise("xml")
        for name, marks, n in reversed(P.FORMATS):
            found = F.when(reduce(or_, (F.contains(head["start" if n == 2048 else "all"], F.lit(m)) for m in marks)), name).otherwise(found)
        return F.when(start == "<", found).when(start.isin("{", "["), "json").otherwise(text)

    # lambda variables, so that the head is made once and not for each mark
    cut = F.transform(F.array(head), lambda h: F.struct(F.substring(h, 1, 2048).alias("start"), h.alias("all")))
    return resources.withColumn("format", F.get(F.transform(cut, sniffed), F.lit(0)))


def page_blocks(resources: DataFrame, fmt: str = "alto") -> DataFrame:
    def rows(url, body):
        page = {"alto": P.parse_alto, "page": P.parse_page_xml, "hocr": P.parse_hocr}[fmt](body, strings=False)
        return [(url, page["id"], page["number"], page["width"], i, b["id"], b["parent"], b["type"], b["hpos"], b["vpos"], b["width"], b["height"], b["text"], b["confidence"]) for i, b in enumerate(page["blocks"])]

    return parse_rows(resources, rows, BLOCKS)


def mets_divs(resources: DataFrame) -> DataFrame:
    return parse_rows(resources, lambda u, b: [(u, *d.values()) for d in P.parse_mets(b)["divs"]], "mets_url string, map string, preorder int, parent int, div_id string, type string, label string, ord string, dmdid string")


def mets_areas(resources: DataFrame) -> DataFrame:
    return parse_rows(resources, lambda u, b: [(u, *a.values()) for a in P.parse_mets(b)["areas"]], "mets_url string, div_preorder int, pos int, file_id string, begin string, end string, betype string")


def mets_files(resources: DataFrame) -> DataFrame:
    return parse_rows(resources, lambda u, b: [(u, i, *f.values()) for i, f in enumerate(P.parse_mets(b)["files"])], "mets_url string, pos int, file_id string, href string, use string, mimetype string")


def tei_articles(resources: DataFrame) -> DataFrame:
    return parse_rows(resources, lambda u, b: [(u, i, *a.values()) for i, a in enumerate(P.parse_tei(b)["articles"])], "source_url string, pos int, article_id string, type string, title string, text string")


def html_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Title, language, links, text and main text of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [P.parse_html(h or "", u or "") for h, u in zip(b["html"], b["url"])]
            yield pd.DataFrame({"id": b["id"], "title": [x["title"] for x in found], "lang": [x["lang"] for x in found], "links": [x["links"] for x in found], "text": [x["text"] for x in found], "main_text": [x["main_text"] for x in found]})

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"id {kind}, title string, lang string, links array<string>, text string, main_text string").withColumnRenamed("id", id_col)
