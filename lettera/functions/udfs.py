"""Arrow-batched functions over the Python text functions, and their names in SQL.

The text functions remember words (see text.remembered) for as long as a worker lives, so a word is worked out once a worker, not once an occurrence.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T

ARTICLE = "text_raw string, text_modern string, orthography string, old_score double, language string, language_confidence double, date string, places array<struct<name: string, modern: string>>"
DATE = "date string, date_old_style string, calendar string, gregorian_if_julian string, year int, month int, day int, months array<int>, matched string"
REPORT = "text string, corrections array<struct<original: string, corrected: string, position: int, alternatives: array<string>>>, unresolved array<string>"


def strings(fn, kind: str = "string"):
    """fn(text) over batches; null texts count as empty."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(fn)

    return run


def structs(fn, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fn(t) for t in s.fillna("")])

    return run


def plain(fn):
    """A function of this package as one that is shipped by name, with the memory that its module has in the worker."""
    return lambda t: fn(t)


def functions(lexicon: T.Lexicon | None = None) -> dict:
    lex = lexicon or T.Lexicon.of([], places=True)
    return {
        "clean_ocr": strings(plain(T.clean_ocr)),
        "old_to_modern": strings(plain(T.old_to_modern)),
        "fold_text": strings(plain(T.fold)),
        "deaccent_text": strings(plain(T.deaccent)),
        "stem_text": strings(plain(T.stem_text)),
        "looks_old": strings(plain(T.looks_old), "double"),
        "long_s": strings(plain(T.long_s)),
        "normalize_lv": strings(lambda t: T.normalize_lv(t, lex)),
        "split_sentences": strings(plain(T.split_sentences), "array<string>"),
        "inflections": strings(plain(T.inflections), "array<string>"),
        "old_spellings": strings(plain(T.old_spellings), "array<string>"),
        "expand_query_lv": strings(plain(T.expand_query_lv), "array<string>"),
        "place_variants": strings(plain(T.place_variants), "array<string>"),
        "find_places": strings(plain(T.find_places), "array<struct<name: string, modern: string>>"),
        "parse_date": structs(plain(T.parse_date), DATE),
        "analyze_article": structs(lambda t: T.analyze_article(t, lexicon=lex), ARTICLE),
        "correct_text": structs(lambda t: T.correct_text(t, lex), REPORT),
    }


def register(spark: SparkSession, lexicon: T.Lexicon | None = None) -> None:
    """Makes the functions callable from SQL."""
    for name, f in functions(lexicon).items():
        spark.udf.register(name, f)
