"""Snippets of hits: the window of tokens in which most of a query's phrases stand, with marks around what matched."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettera.functions import text as T

TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
BEGIN, END, MORE = "«", "»", " … "


def matches(keys: Sequence[str], phrases: Sequence[Sequence[str]]) -> list[tuple[int, int, int]]:
    """(end, start, phrase) of each place where a phrase stands, in order of its end."""
    first: dict[str, list[int]] = {}
    for k, p in enumerate(phrases):
        first.setdefault(p[0], []).append(k)
    return sorted((at + len(phrases[k]), at, k) for at, key in enumerate(keys) for k in first.get(key, ()) if list(keys[at : at + len(phrases[k])]) == list(phrases[k]))


def best_window(found: Sequence[tuple[int, int, int]], n: int, size: int) -> tuple[int, int]:
    """[begin, end) of at most `size` of n tokens in which most distinct phrases stand whole, the first of equal ones; it begins before its first match only at the end of the text.

    One pass in order of ends: a match comes in at its end, and matches go out that begin too far back.
    """
    held, inside, best, begin = Counter(), [], 0, 0
    for end, start, k in found:
        inside.append((start, k))
        held[k] += 1
        kept = [x for x in inside if x[0] >= end - size]
        for x in inside:
            if x[0] < end - size:
                held[x[1]] -= 1
        inside, held = kept, +held
        if len(held) > best:
            best, begin = len(held), min(s for s, _ in inside)
    begin = max(0, min(begin, n - size))
    return begin, min(n, begin + size)


def snippet_of(text: str, phrases: Sequence[Sequence[str]], size: int = 24) -> str:
    spans = [m.span() for m in TOKEN.finditer(text)]
    keys = [T.deaccent(text[a:b]).replace("ſ", "s") for a, b in spans]
    found = matches(keys, phrases)
    begin, end = best_window(found, len(spans), size)
    marked = {i for stop, start, _ in found if begin <= start and stop <= end for i in range(start, stop)}
    out, at = [MORE if begin else text[: spans[0][0]] if spans else text], spans[begin][0] if spans else 0
    for i in range(begin, end):
        a, b = spans[i]
        joined = i in marked and i - 1 in marked and i > begin
        out += [text[at:a], BEGIN if i in marked and not joined else "", text[a:b], END if i in marked and not (i + 1 in marked and i + 1 < end) else ""]
        at = b
    return "".join(out) + (MORE if end < len(spans) else text[at:] if spans else "")


def with_snippets(hits: DataFrame, phrases: Sequence[Sequence[str]], text_col: str = "text_raw", size: int = 24) -> DataFrame:
    """hits, joined to their documents, with snippet: at most `size` tokens of text_col with the phrases (of tokens, as the index has them) marked. A null text gives an empty one."""
    phrases = [list(p) for p in phrases if p]
    rows = hits.withColumn("snippet", F.coalesce(text_col, F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.schema.get_field_index("snippet")
            yield b.set_column(k, b.schema.field(k), pa.array([snippet_of(t, phrases, size) for t in b["snippet"].to_pylist()], b.schema.field(k).type))

    return rows.mapInArrow(run, rows.schema)
