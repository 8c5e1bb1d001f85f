"""URLs: normal form, scope, priority, ids, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Query parameters that track and do not name anything.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


#: Parts of a URL: scheme, //authority, path, ?query, #fragment.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def decoded(c: Column) -> Column:
    """A form's encoding undone: plus signs are blanks, and a percent sign without two hex digits stands for itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(c: Column) -> Column:
    """Blanks as plus signs; letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(u: Column, keep_fragment: bool = True) -> Column:
    """http and https alone (others give an empty string): lower-case host, no default port, single slashes, the query parsed and written again without tracking parameters."""
    plain = F.regexp_replace(F.regexp_replace(u, r"^[\x00-\x20]+|[\s\x85\xa0]+$", ""), r"[\t\r\n]", "")
    part = lambda k: F.regexp_extract(plain, PARTS, k)
    scheme, authority = F.lower(part(1)), F.lower(F.substring(part(2), 3, 1 << 30))
    port = F.when(scheme == "http", ":80$").otherwise(":443$")
    path = F.regexp_replace(part(3), "/{2,}", "/")
    pair = lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"))
    pairs = F.filter(F.transform(F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda p: p != ""), pair), lambda p: ~F.lower(p["k"]).isin(*TRACKING))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    marked = lambda sign, c: F.when(c == "", "").otherwise(F.concat(F.lit(sign), c))
    fragment = F.substring(part(5), 2, 1 << 30) if keep_fragment else F.lit("")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(authority, port, ""), F.when(path == "", "/").otherwise(path), marked("?", query), marked("#", fragment))
    return F.when(scheme.isin("http", "https"), whole).otherwise("")


def host(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, r"^(?i)https?://([^/?#:]+)", 1))


def in_scope(u: Column, hosts: Sequence[str], deny: Sequence[str]) -> Column:
    bad = F.lit(False)
    for p in deny:
        bad = bad | u.rlike(f"(?i){p}")
    return host(u).isin(*hosts) & ~bad


def priority(u: Column, prefer: Sequence[str]) -> Column:
    """10 for each preferred pattern, 5 for XML."""
    return sum((F.when(u.rlike(f"(?i){p}"), 10).otherwise(0) for p in prefer), F.when(F.lower(u).endswith(".xml"), 5).otherwise(0))


def ids_from_url(u: Column, issue: Sequence[str], article: Sequence[str], page: Sequence[str]) -> Column:
    """Struct(issue_id, article_id, page) by the first pattern of each list that matches the decoded URL; patterns have one group."""
    plain = F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u)
    first = lambda ps: F.coalesce(*(F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in ps), F.lit(""))
    return F.struct(F.regexp_replace(first(issue), "^/+|/+$", "").alias("issue_id"), first(article).alias("article_id"), F.nullif(first(page), F.lit("")).cast("int").alias("page"))


# Kinds by what a URL has in it, in order of trial, and the order of kinds in a list of templates.
KIND_MARKS = [("mets", ["mets"]), ("alto", ["alto"]), ("tei", ["tei"]), ("iiif", ["manifest", "iiif"]), ("plaintext", ["text", "txt", "fulltext"])]
KIND_ORDER = ["mets", "alto", "tei", "plaintext", "iiif", "json", "xml"]


def kind(u: Column, content_type: Column | None = None) -> Column:
    """What a URL's answer seems to be, by its words, then by its content type or ending."""
    low, says = F.lower(u), F.lower(F.coalesce(content_type, F.lit(""))) if content_type is not None else F.lit("")
    found = F.when(F.contains(says, F.lit("json")) | low.endswith(".json"), "json").when(low.endswith(".xml") | F.contains(says, F.lit("xml")), "xml").otherwise("cits")
    for name, marks in reversed(KIND_MARKS):
        found = F.when(low.rlike("|".join(marks)), name).otherwise(found)
    return found


def template(u: Column, issue_id: Column | None = None) -> Column:
    """The issue id as {issue}, and the path's last number that stands alone, of at most eight digits, as {n}, or {n:0Kd} if it begins with 0."""
    named = u if issue_id is None else F.when(F.coalesce(issue_id, F.lit("")) != "", F.replace(u, issue_id, F.lit("{issue}"))).otherwise(u)
    front, path, rest = F.regexp_extract(named, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", 0), F.regexp_extract(named, PARTS, 3), F.regexp_extract(named, "[?#].*$", 0)
    number = r"^(.*)(?<![A-Za-z0-9])(\d{1,8})(?![A-Za-z0-9])(.*)$"
    n = F.regexp_extract(path, number, 2)
    mark = F.when(n.startswith("0"), F.concat(F.lit("{n:0"), F.length(n).cast("string"), F.lit("d}"))).otherwise("{n}")
    return F.when(n == "", named).otherwise(F.concat(front, F.regexp_extract(path, number, 1), mark, F.regexp_extract(path, number, 3), rest))


def templates(urls: DataFrame, col: str = "url", issue_id: Column | None = None, content_type: Column | None = None) -> DataFrame:
    """(kind, template, n, example, rank): rank orders by kind, then template, as a list of them is shown; the example is the least URL."""
    found = urls.groupBy(kind(F.col(col), content_type).alias("kind"), template(F.col(col), issue_id).alias("template")).agg(F.count("*").alias("n"), F.min(col).alias("example"))
    return found.withColumn("rank", F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")), F.lit(0)), F.lit(10)))
