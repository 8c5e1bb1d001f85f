"""All old spellings of a query's words that an index holds: a word's spellings are an automaton, which is walked along the sorted vocabulary.

A word is a row of graphemes, each with its spellings in old print, so its spellings multiply; a prefix of them is followed only where
some term begins with it. So the work goes with what is there, and no spelling is left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettera.functions import text as T
from lettera.functions.constants import OLD_SPELLINGS
from lettera.operators.index import Index

#: Terms in a file of the vocabulary; characters of a prefix by which files and row groups are chosen, and how many such prefixes are looked for.
FILE_TERMS, PREFIX, PREFIXES = 4_000_000, 4, 200
LAST = chr(0x10FFFF)  # after every sign of a term


@dataclass(frozen=True)
class Vocabulary:
    index: Index
    at: str

    @property
    def terms(self) -> DataFrame:
        """(term, documents, times), sorted by term within a file."""
        return self.index.spark.read.schema("term string, documents long, times long").parquet(self.at)


def write_vocabulary(index: Index, to: str) -> Vocabulary:
    """The terms of an index in order, in files of disjoint ranges. The index has counted them."""
    kept = index.terms.select("term", "documents", "times")
    files = 1 + kept.count() // FILE_TERMS
    kept.repartitionByRange(files, "term").sortWithinPartitions("term").write.parquet(f"{to}/terms")
    return Vocabulary(index, f"{to}/terms")


def token(text: str) -> str:
    """A word as the index has it."""
    return T.deaccent(text).replace("ſ", "s")


def spellings(word: str) -> list[list[str]]:
    """The spellings of each grapheme in turn, as the index has them; other letters stand for themselves."""
    w, at, out = word.lower(), 0, []
    while at < len(w):
        graph, forms = next(((g, f) for g, f in OLD_SPELLINGS if w.startswith(g, at)), (w[at], [w[at]]))
        out.append(list(dict.fromkeys(map(token, forms))))
        at += len(graph)
    return out


def bases(word: str, inflect: bool = True, places: bool = True) -> list[str]:
    """The word, its inflections and, of a place, its other names, as far as these are one word."""
    more = [*(T.inflections(word) if inflect else ()), *(T.place_variants(word) if places else ())]
    return [b for b in dict.fromkeys([word.lower(), *(m.lower() for m in more)]) if token(b) and all(c.isalnum() for c in token(b))]


def automata(word: str, inflect: bool = True, places: bool = True) -> list[list[list[str]]]:
    """One for each base, and one for each base as it is written."""
    return [a for b in bases(word, inflect, places) for a in (spellings(b), [[token(b)]])]


def held(terms: Sequence[str], automaton: Sequence[Sequence[str]]) -> list[int]:
    """Where in the sorted, distinct terms the automaton's strings stand. Of its prefixes only those are kept with which a term begins, each with the range of these terms."""
    ranges = {"": (0, len(terms))}
    for forms in automaton:
        further: dict[str, tuple[int, int]] = {}
        for prefix, (low, high) in ranges.items():
            for p in (prefix + f for f in forms):
                if p not in further:
                    a = bisect_left(terms, p, low, high)
                    b = bisect_left(terms, p + LAST, a, high)
                    if a < b:
                        further[p] = (a, b)
        ranges = further
    return sorted(low for p, (low, _) in ranges.items() if terms[low : low + 1] == [p])


def prefixes(automaton: Sequence[Sequence[str]], size: int) -> set[str]:
    """Of at most `size` signs: each string of the automaton begins with one of them."""
    found = {""}
    for forms in automaton:
        found = {p if len(p) >= size else (p + f)[:size] for p in found for f in forms}
        if all(len(p) >= size for p in found):
            break
    return found


def begins(wanted: Sequence[Sequence[Sequence[str]]]) -> Column:
    """A filter that the scan can use on the files' and row groups' ranges."""
    some = {""}
    for size in range(PREFIX, 0, -1):
        some = {p for a in wanted for p in prefixes(a, size)}
        if len(some) <= PREFIXES:
            break
    return reduce(lambda x, y: x | y, (F.col("term").startswith(p) for p in sorted(some)), F.lit(False))


def reached(vocabulary: Vocabulary, words: Sequence[str], inflect: bool = True, places: bool = True) -> DataFrame:
    """(word, term, documents, times): every term that is a spelling of a word, of one of its inflections or of its names as a place. Words are those of a query; a word that is no word reaches nothing."""
    wanted = {w: automata(w, inflect, places) for w in dict.fromkeys(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.sort_by("term")
            terms = b["term"].to_pylist()
            for w, some in wanted.items():
                if at := sorted({i for a in some for i in held(terms, a)}):
                    got = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([w] * len(at)), *got.columns], ["word", *got.schema.names])

    scan = vocabulary.terms.where(begins([a for some in wanted.values() for a in some]))
    return scan.mapInArrow(run, "word string, term string, documents long, times long")


def search(vocabulary: Vocabulary, words: Sequence[str], limit: int | None = 20, inflect: bool = True, places: bool = True) -> DataFrame:
    """(id, score) of the documents that hold each word in some spelling, best (lowest) first, ties by id: BM25, where all terms that a word reaches count as one.

    The terms a query reaches come to the driver, as a query's terms do; postings of these alone are read.
    """
    index, words = vocabulary.index, list(dict.fromkeys(words))
    none = index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    classes: dict[str, list[int]] = {}
    for r in reached(vocabulary, words, inflect, places).select("word", "term").collect():
        classes.setdefault(r.term, []).append(words.index(r.word))
    if not words or {k for ks in classes.values() for k in ks} != set(range(len(words))):
        return none
    terms = index.spark.createDataFrame([(t, k) for t, ks in sorted(classes.items()) for k in ks], "term string, k int")
    hits = index.of_terms(index.postings, list(classes)).select("term", "id", "f", "d").join(F.broadcast(terms), "term")
    counts = hits.groupBy("id").agg(F.max("d").alias("d"), *(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("f"))), F.lit(0)).alias(f"f{k}") for k in range(len(words))))
    n = counts.agg(*(F.count_if(F.col(f"f{k}") > 0) for k in range(len(words)))).first()
    mean = index.tokens / max(index.documents, 1)

    def weight(k: int) -> Column:
        f, idf = F.col(f"f{k}"), max(math.log((index.documents - n[k] + 0.5) / (n[k] + 0.5)), 1e-6)
        return -F.lit(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("d") / mean))

    both = reduce(lambda x, y: x & y, (F.col(f"f{k}") > 0 for k in range(len(words))))
    found = counts.where(both).select("id", sum((weight(k) for k in range(len(words))), F.lit(0.0)).alias("score"))
    return found.orderBy("score", "id").limit(limit) if limit is not None else found
