"""Full-text search: queries as AND-groups of phrases, BM25 over all fields without an index, fallback, post-filters. With an index: see index."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettera.functions import native as N
from lettera.functions import text as T
from lettera.operators.index import Index
from lettera.operators.index import search as ranked_search


def phrases(query: str) -> list[list[str]]:
    """Words of the query without quotes, each as the tokens it is indexed under; a word of several tokens is a phrase."""
    import re

    plain = lambda w: re.findall(r"[^\W_]+", T.deaccent(w).replace("ſ", "s"))
    return [p for w in query.replace('"', "").split() if (p := plain(w))]


def query_groups(query: str, fold: bool = True) -> list[list[list[str]]]:
    """AND-groups that are OR-ed: the words as they are, folded, and stemmed, each only if it adds something."""
    forms = [query]
    if fold and query.strip():
        folded = T.fold(query)
        forms += [folded] if folded and folded != query.lower() else []
        stems = T.stem_text(query)
        forms += [stems] if stems and stems not in (query.lower(), folded) else []
    return [g for g in map(phrases, forms) if g]


def indexed(docs: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(id, tokens: array of one token array a field): what a search without an index reads."""
    return docs.select(F.col(id_col).alias("id"), F.array(*(N.tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields)).alias("tokens"))


def occurrences(tokens: str, phrase: list[str]) -> Column:
    """How often the phrase stands in the fields, its tokens next to each other in one field."""
    if len(phrase) == 1:
        return F.aggregate(tokens, F.lit(0), lambda n, t: n + F.size(t) - F.size(F.array_remove(t, phrase[0])))
    want, k = F.array(*map(F.lit, phrase)), len(phrase)
    at = lambda t: F.when(F.size(t) >= k, F.size(F.filter(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.slice(t, i, k) == want))).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda n, t: n + at(t))


def search(index: DataFrame, groups: list[list[list[str]]], limit: int | None = 20) -> DataFrame:
    """(id, score) as index.search gives, without an index: for a table that is searched once.

    One pass counts the phrases of each row; one aggregate of a single row has what
    BM25 needs of all rows. A row's score sums over the phrases of the groups that it matches.
    """
    unique = list(dict.fromkeys(tuple(p) for g in groups for p in g))
    if not unique:
        return index.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    names = {p: f"f{i}" for i, p in enumerate(unique)}
    counted = index.select("id", F.aggregate("tokens", F.lit(0), lambda n, t: n + F.size(t)).alias("d"), *(occurrences("tokens", list(p)).alias(c) for p, c in names.items()))
    whole = counted.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *(F.sum((F.col(c) > 0).cast("long")).alias(f"n_{c}") for c in names.values()))
    rows = counted.where(" or ".join(f"{c} > 0" for c in names.values())).crossJoin(F.broadcast(whole))  # whole is one row

    def weight(p):
        f, n = F.col(names[p]), F.col(f"n_{names[p]}")
        idf = F.greatest(F.log((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        return -idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("d") / F.col("mean")))

    def matches(g):
        c = F.lit(True)
        for p in g:
            c = c & (F.col(names[tuple(p)]) > 0)
        return c

    hit = F.lit(False)
    score = F.lit(0.0)
    for g in groups:
        hit = hit | matches(g)
        score = score + F.when(matches(g), sum((weight(tuple(p)) for p in g), F.lit(0.0))).otherwise(0.0)
    found = rows.where(hit).select("id", score.alias("score"))
    return found.orderBy("score", "id").limit(limit) if limit is not None else found


def like_fallback(docs: DataFrame, query: str, id_col: str, title: str, raw: str, modern: str, limit: int = 20) -> DataFrame:
    """Rows that hold the query (or folded, in the raw text) as a LIKE pattern; used where ranked search finds nothing. In order of id."""
    q = query.lower()
    like = lambda c, needle: N.ascii_lower(F.col(c)).like(f"%{needle}%")
    return docs.where(like(modern, q) | like(raw, T.fold(query)) | like(title, q)).orderBy(id_col).limit(limit)


def local_search(docs: DataFrame, index: Index, query: str, limit: int = 20, language: str = "", id_col: str = "id", fallback: tuple[str, str, str] | None = None) -> DataFrame:
    """Ranked hits of the index, joined to their documents. The language filter comes after the limit.

    With fallback, the columns of title, raw and modern text, a query that the index answers with nothing is looked for as a substring; such rows have no score.
    """
    hits = ranked_search(index, query_groups(query), limit)
    if fallback and hits.isEmpty():
        title, raw, modern = fallback
        found = like_fallback(docs, query, id_col, title, raw, modern, limit).withColumn("score", F.lit(None).cast("double")) if query.strip() else docs.limit(0).withColumn("score", F.lit(0.0))
    else:
        found = docs.join(F.broadcast(hits.withColumnRenamed("id", id_col)), id_col)  # at most `limit` rows
    found = found.where(F.col("language") == language) if language else found
    return found.orderBy("score", id_col)


def with_search_columns(docs: DataFrame, functions: dict) -> DataFrame:
    """text_fold and text_stem, made once when documents are stored."""
    fold = functions["fold_text"](F.concat_ws("\n", "title", "text_raw"))
    return docs.withColumn("text_fold", fold).withColumn("text_stem", functions["stem_text"](F.concat_ws(" ", "title", "text_modern", "text_fold")))


def site_search(variants: Sequence[str], fetch: Callable[[str], list[dict]], limit: int = 25) -> list[dict]:
    """Hits of a site's own search for each variant in turn, first come first kept by URL or issue and article; a variant that fails is passed over."""
    found: dict = {}
    for v in variants:
        try:
            hits = fetch(v)
        except OSError:
            continue
        for h in hits:
            found.setdefault(h.get("url") or (h.get("issue_id"), h.get("article_id")), {**h, "matched_query": v})
            if len(found) >= limit:
                return list(found.values())
    return list(found.values())


def first_wins(hits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order: an aggregate that combines before the shuffle, so a hot key costs a row a task."""
    best = hits.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_row"))
    return best.select("_row.*").select(hits.columns)
