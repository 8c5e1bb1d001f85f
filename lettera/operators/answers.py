"""Answers of sites' own searches as tables of hits: trees of JSON walked as VARIANT, links of HTML, and the first of equal hits."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lettera.operators import urls as U
from lettera.operators.documents import Site
from lettera.sources import parsers as P

DEPTH, SNIPPET = 6, 400
CONTAINER = "array<struct<path: array<int>, node: variant>>"
FOUND = "pos int, url string, title string, snippet string, ids_in string"


def within(c: Column, use) -> Column:
    """use(c), with c worked out once however often use has it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def held(x: Column) -> Column:
    """What a node holds: the items of a list, the values of an object in order of their keys; a scalar holds nothing."""
    below = lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), c.alias("node"))
    return F.coalesce(F.transform(as_list(x["node"]), below), F.transform(F.map_values(as_map(x["node"])), below), F.array().cast(CONTAINER))


def nodes(v: Column, depth: int = DEPTH) -> Column:
    """All nodes of a tree down to `depth` below its root, with their paths; level by level, each held node once."""
    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), v.alias("node")))
    level = F.struct(root.alias("all"), root.alias("last"))
    deeper = lambda a, _: within(F.flatten(F.transform(a["last"], held)), lambda n: F.struct(F.concat(a["all"], n).alias("all"), n.alias("last")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), level, deeper)["all"]


def says(node: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys' values that is not empty, zero or false, as a string; an object or list is its JSON."""

    def value(k: str) -> Column:
        v = F.try_variant_get(node, f"$.{k}", "variant")
        text, kind = F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)
        return F.when(kind == "STRING", F.nullif(text, F.lit(""))).when(kind == "BOOLEAN", F.when(text == "true", "True")).when(kind != "VOID", F.when(~text.isin("0", "0.0", "-0.0", "[]", "{}"), text))

    return F.coalesce(*map(value, keys), F.lit(""))


def is_hit(node: Column) -> Column:
    keys = F.transform(F.map_keys(as_map(node)), F.lower)
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, sorted(names))))
    return F.coalesce(has(P.NAMES) & has(P.DESCRIBES), F.lit(False))


def tree_hits(v: Column) -> Column:
    """The hits of a tree, a parent before what it holds: (path, url as it stands, title, snippet, json)."""
    hit = lambda x: F.struct(x["path"], *(says(x["node"], keys).alias(n) for n, keys in P.HIT_KEYS.items()), F.to_json(x["node"]).alias("json"))
    return F.array_sort(F.transform(F.filter(nodes(v), lambda x: is_hit(x["node"])), hit))


@F.pandas_udf(StringType())
def joined(base: pd.Series, url: pd.Series) -> pd.Series:
    """URLs as their page means them; one that cannot be joined stays."""

    def join(b: str | None, u: str) -> str:
        try:
            return urljoin(b or "", u) if u else ""
        except ValueError:
            return u

    return pd.Series([join(b, u) for b, u in zip(base, url)], dtype=object)


def parsed(rows: DataFrame, html: bool) -> DataFrame:
    """Hits by Python: links of HTML, or JSON that VARIANT does not take, such as objects with a key twice (the last counts)."""
    keep = rows.select("_row", "_base", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, base, text in zip(b["_row"].to_pylist(), b["_base"].to_pylist(), b["_text"].to_pylist()):
                try:
                    found = (P.html_hits if html else P.json_hits)(text, base or "")
                except ValueError:  # a URL that cannot be joined
                    found = (P.html_hits if html else P.json_hits)(text, "")
                if found:
                    cols = {k: [h[k] for h in found] for k in ("url", "title", "snippet", "ids_in")}
                    yield pa.RecordBatch.from_pydict({"_row": [row] * len(found), "pos": pa.array(range(len(found)), pa.int32()), **cols})

    return keep.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, {FOUND}")


def hits(answers: DataFrame, site: Site, id_col: str = "id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """(id_col, pos, url, title, snippet, issue_id, article_id, page), a row for each hit of each answer; ids must differ.

    An answer that begins with { or [ is JSON, whose hits are objects with a key that names and one that describes, at most six levels down; else it is
    HTML, whose hits are links with an id of an issue or article. Members of an object come in order of their keys. Null and empty texts have no hits.
    """
    rows = answers.select(F.col(id_col).alias("_row"), F.col(url_col).alias("_base"), F.coalesce(text_col, F.lit("")).alias("_text"))
    json = F.regexp_replace(F.substring("_text", 1, 4096), r"^\s+", "").rlike(r"^[{\[]")
    trees = rows.where(json).select("_row", "_base", "_text", F.try_parse_json("_text").alias("_v"))
    walked = trees.where("_v is not null").select("_row", "_base", F.posexplode(tree_hits(F.col("_v"))).alias("pos", "h"))
    walked = walked.select("_row", "pos", joined("_base", "h.url").alias("url"), "h.title", F.substring("h.snippet", 1, SNIPPET).alias("snippet"), F.col("h.json").alias("json"))
    walked = walked.select("_row", "pos", "url", "title", "snippet", F.when(F.col("url") != "", F.col("url")).otherwise(F.col("json")).alias("ids_in"))
    found = walked.unionByName(parsed(trees.where("_v is null"), False)).withColumn("link", F.lit(False))
    found = found.unionByName(parsed(rows.where(~json), True).withColumn("link", F.lit(True)))
    never = ("(?!)x()",)  # a pattern with a group that finds nothing
    ids = U.ids_from_url(F.col("ids_in"), site.issue or never, site.article or never, site.page or never)
    named = found.withColumn("_ids", ids).where(~F.col("link") | (F.col("_ids.issue_id") != "") | (F.col("_ids.article_id") != ""))
    return named.select(F.col("_row").alias(id_col), "pos", "url", "title", "snippet", "_ids.issue_id", "_ids.article_id", "_ids.page")


def merged(found: DataFrame, asked: DataFrame, id_col: str = "id", limit: int = 25) -> DataFrame:
    """(query, rank, matched_query, ...) of hits with asked (id_col, query, turn, matched_query), where each answer belongs to a turn of a query: the first hit of each URL, or of
    each issue and article where it has no URL, by turn and place; of these the first `limit` a query. Hits with neither are left out."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.concat("issue_id", "article_id"))
    rows = found.join(asked.select(id_col, "query", "turn", "matched_query"), id_col).withColumn("_key", key).where("_key <> ''")
    first = rows.groupBy("query", "_key").agg(F.min_by(F.struct("*"), F.struct("turn", "pos", id_col)).alias("_hit")).select("_hit.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("turn", "pos", id_col))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "matched_query", "url", "title", "snippet", "issue_id", "article_id", "page")
