"""Discovery over stored responses: nested sitemaps, and lists that go on by a token."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettera.operators import stored
from lettera.sources import parsers as P
from lettera.sources.tables import parse_rows


def unzipped(body: bytes) -> bytes:
    """A gzipped body as it was; one that is no gzip, or a broken one, as it is."""
    try:
        return gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
    except (OSError, EOFError):
        return body


def kept(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, so that a round of a loop never works out those before it."""
    at = stored.fresh(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def sitemap_urls(resources: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """(root, sitemap, depth, pos, url): the page URLs of the sitemaps that each root (url) leads to by at most max_depth steps, out of stored resources (url, body).

    A sitemap counts once a root, at its least depth, however many lead to it, so cycles end. What is not stored,
    is no XML or is no sitemap gives nothing; bodies may be gzipped. A round a level: what is found new is joined with the bodies, and only those are parsed.
    """

    def rows(url, body):
        pages, more = P.sitemap_urls(unzipped(body))
        return [(url, "page", i, u) for i, u in enumerate(pages)] + [(url, "sitemap", i, u) for i, u in enumerate(more)]

    bodies = resources.where("body is not null").select("url", "body")
    new = roots.select(F.col("url").alias("root"), F.col("url").alias("sitemap")).distinct()
    seen, out = None, None
    for depth in range(max_depth + 1):
        new = kept(new, "sitemap-level")
        seen = new if seen is None else seen.union(new)
        wanted = bodies.join(new.select(F.col("sitemap").alias("url")).distinct(), "url", "left_semi")
        parsed = kept(parse_rows(wanted, rows, "sitemap string, kind string, pos int, loc string"), "sitemap-parsed")
        found = new.join(parsed, "sitemap")
        pages = found.where("kind = 'page'").select("root", "sitemap", F.lit(depth).alias("depth"), "pos", F.col("loc").alias("url"))
        out = pages if out is None else out.union(pages)
        new = found.where("kind = 'sitemap'").select("root", F.col("loc").alias("sitemap")).distinct().join(seen, ["root", "sitemap"], "left_anti")
    return out


def chain_order(links: DataFrame) -> DataFrame:
    """(endpoint, token, rank): the responses of each endpoint in order, from that of the empty token on, out of links (endpoint, token, next_token).

    Tokens are followed by doubling: a round knows the first 2^k responses and jumps of 2^k steps, so a list of n
    responses takes some log2(n) rounds. An empty or null next token, or one whose response is not there, ends a list; a token that comes again is not followed again.
    """
    jumps = kept(links.where("token is not null").groupBy("endpoint", "token").agg(F.min(F.coalesce("next_token", F.lit(""))).alias("to")).where("to <> ''"), "chain-jumps")
    there = links.where("token is not null").select("endpoint", "token").distinct()
    jumps = kept(jumps.join(there.withColumnRenamed("token", "to"), ["endpoint", "to"], "left_semi"), "chain-jumps")
    found, step = kept(there.where("token = ''").withColumn("rank", F.lit(0).cast("long")), "chain-found"), 1
    while True:
        new = found.join(jumps, ["endpoint", "token"]).select("endpoint", F.col("to").alias("token"), (F.col("rank") + step).alias("rank"))
        first = found.union(new).groupBy("endpoint", "token").agg(F.min("rank").alias("rank"))
        more = kept(first, "chain-found")
        if more.count() == found.count():
            return more
        ahead = jumps.select("endpoint", F.col("token").alias("to"), F.col("to").alias("then"))
        jumps, found, step = kept(jumps.join(ahead, ["endpoint", "to"]).select("endpoint", "token", F.col("then").alias("to")), "chain-jumps"), more, 2 * step


def oai_identifiers(responses: DataFrame) -> DataFrame:
    """(endpoint, rank, pos, identifier, datestamp, sets) of stored ListIdentifiers responses (endpoint, token, body): headers in the order in which the tokens give them.

    A response that reports an error or cannot be parsed has no headers and ends its list; a header without an identifier is left out, but counts in pos.
    """

    def rows(url, body):
        root = P.xml(body)
        if any(P.name(e) == "error" for e in root.iter()):
            return []
        headers, token = P.oai_headers(body)
        return [(url, -1, token, "", "")] + [(url, i, h["identifier"], h["datestamp"], ",".join(h["sets"])) for i, h in enumerate(headers)]

    sep = "\x1f"
    named = responses.where("endpoint is not null").select(F.concat("endpoint", F.lit(sep), F.coalesce("token", F.lit(""))).alias("url"), "body")
    parsed = kept(parse_rows(named, rows, "url string, pos int, value string, datestamp string, sets string"), "oai-parsed")
    parsed = parsed.select(F.substring_index("url", sep, 1).alias("endpoint"), F.substring_index("url", sep, -1).alias("token"), "pos", "value", "datestamp", "sets")
    order = chain_order(parsed.where("pos = -1").select("endpoint", "token", F.col("value").alias("next_token")))
    return parsed.where("pos >= 0 and value <> ''").join(order, ["endpoint", "token"]).select("endpoint", "rank", "pos", F.col("value").alias("identifier"), "datestamp", "sets")
