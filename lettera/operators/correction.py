"""Correction of misread words against a lexicon, as joins: a vocabulary is corrected once, however often its words occur.

A lexicon is a table of (kind, key). A word is known if one of its keys is in it: the word itself and without marks ("word"), its
stem ("stem"), its folded form ("fold"), or, where the modern spelling is another, that spelling's word and stem keys.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettera.functions import native as N
from lettera.functions import text as T
from lettera.functions.constants import CORE, GERMANISMS, PALATALS
from lettera.operators import stored

#: Keys that a lexicon may have and still be broadcast; it is counted first.
BROADCAST_KEYS = 300_000
SHORTEST, ALTERNATIVES, OPTIONS, SUSPICIOUS = 3, 3, 5, 50
#: Bits that a filter of a lexicon's keys has, as powers of two: so many a key, within these.
FILTER_BITS, LEAST_BITS, MOST_BITS = 6, 12, 27
#: Letters that cleaning leaves, and of which each case is one sign that comes back from the other.
PLAIN = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and not T.FIXED.match(c) and all(len(x) == 1 for x in (c.lower(), c.upper())) and c.lower().upper().lower() == c.lower() and unicodedata.is_normalized("NFC", c))
OF_PLAIN, DIGIT = re.compile(f"[{PLAIN}]+"), re.compile("[0-9]")
STEMS = re.compile(f"^(?:{T.STEM.pattern})$", re.M)


def word_keys(word: str) -> list[tuple[str, str]]:
    """The keys under which a word is looked for."""
    low, modern = word.lower(), T.modern_word(word)
    keys = [("word", low), ("word", T.deaccent(low)), ("stem", T.stem(low)), ("fold", T.fold(word))]
    if modern.lower() != low:
        keys += [("word", modern.lower()), ("word", T.deaccent(modern)), ("stem", T.stem(modern.lower()))]
    return list(dict.fromkeys(keys))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): the distinct words of texts and how often each occurs."""
    return docs.select(F.explode(N.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def keys_of_plain(words: list[str]) -> list[tuple[str, list[str]]]:
    """Kinds of keys, each with that key of every word, which are together those of word_keys; for words of PLAIN alone, all at once as the lines of one string."""
    each = lambda t: "\n".join([T.undouble(w) if T.DOUBLE.search(w) else w for w in t.split("\n")])
    stems = lambda t: STEMS.sub(r"\1", t)
    low = "\n".join(words).lower()
    modern = each(reduce(lambda t, rule: t.replace(*rule), [*CORE, *GERMANISMS, *PALATALS], low))
    plain, plain_modern = T.deaccent(low), T.deaccent(modern)
    found = [("word", low), ("word", plain), ("stem", stems(plain)), ("fold", each(plain_modern)), ("word", modern), ("word", plain_modern), ("stem", stems(plain_modern))]
    return [(kind, lines.split("\n")) for kind, lines in found]


@dataclass(frozen=True)
class KeyFilter:
    """Bits by a hash of a lexicon's keys: what it refuses is no key, what it lets pass may be one. digits: whether any key has one."""

    bits: np.ndarray
    power: int
    digits: bool

    def passes(self, kind: str, keys: list[str]) -> np.ndarray:
        at = np.fromiter(map(zlib.crc32, map(str.encode, keys), repeat(zlib.crc32(f"{kind}:".encode()))), np.uint32, len(keys)) >> (32 - self.power)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.bool_)


def key_filter(lex: DataFrame) -> KeyFilter:
    """At most 2^MOST_BITS bits reach the driver, whatever the lexicon has."""
    n, digits = lex.agg(F.count("*"), F.coalesce(F.bool_or(F.col("key").rlike("[0-9]")), F.lit(False))).first()
    power = min(MOST_BITS, max(LEAST_BITS, FILTER_BITS + int(n).bit_length()))
    at = F.shiftright(F.crc32(F.concat(F.col("kind"), F.lit(":"), F.col("key")).cast("binary")), 32 - power).alias("at")
    rows = lex.select(at).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 AS int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (power - 3), np.uint8)
    bits[rows["byte"].to_numpy()] = rows["bits"].to_numpy()
    return KeyFilter(bits, power, digits)


def lexicon(words: DataFrame, col: str = "word", places: bool = True) -> DataFrame:
    """The keys of a table of words; lines that are empty or begin with # are none. places adds the names of places, new and old."""
    session = words.sparkSession
    rows = words.select(F.trim(col).alias("word")).where("word <> '' and not startswith(word, '#')")
    if places:
        names = [x for p in T.PLACES for x in T.place_variants(p)]
        rows = rows.union(session.createDataFrame([(n,) for n in names], "word string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [k for w in b["word"].to_pylist() for low in [w.lower()] for k in (("word", low), ("word", T.deaccent(low)), ("stem", T.stem(low)), ("fold", T.fold(low)))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string())], ["kind", "key"])

    return rows.distinct().mapInArrow(run, "kind string, key string").distinct()


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """The distinct words of texts."""
    return docs.select(F.explode(N.words(F.col(text_col))).alias("word")).distinct()


def with_keys(words: DataFrame, lex: DataFrame, styles: Sequence[str] = (), edits: int = 0) -> DataFrame:
    """(word, n, form, keys): a word itself, as form 0, or with edits its confusable forms, numbered in order. Only forms that have a key which may be in the lexicon, with these keys alone."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("key", pa.string())]))
    may = key_filter(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b["word"].to_pylist()
            for at in range(0, len(words), 500):
                rows = [(w, n, f) for w in words[at : at + 500] for n, f in (enumerate(T.confusable(w, styles, edits), 1) if edits else [(0, w)])]
                if not may.digits:  # every key of a form has the form's digits
                    rows = [r for r in rows if not DIGIT.search(r[2])]
                some: dict[int, dict[tuple[str, str], None]] = {}
                plain = [i for i, r in enumerate(rows) if OF_PLAIN.fullmatch(r[2])]
                for k, keys in keys_of_plain([rows[i][2] for i in plain]) if plain else ():
                    for j in np.flatnonzero(may.passes(k, keys)):
                        some.setdefault(plain[j], {})[k, keys[j]] = None
                for i in sorted(set(range(len(rows))) - set(plain)):
                    for k, v in word_keys(rows[i][2]):
                        if may.passes(k, [v])[0]:
                            some.setdefault(i, {})[k, v] = None
                if some:
                    kept = [rows[i] for i in some]
                    keys = pa.array([[{"kind": k, "key": v} for k, v in x] for x in some.values()], kind)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in kept], pa.string()), pa.array([r[1] for r in kept], pa.int32()), pa.array([r[2] for r in kept], pa.string()), keys], ["word", "n", "form", "keys"])

    # few bytes, much work: so many tasks, whatever the size
    dealt = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return dealt.mapInArrow(run, "word string, n int, form string, keys array<struct<kind: string, key: string>>")


def known(forms: DataFrame, lex: DataFrame) -> DataFrame:
    """(word, n, form) of the forms that have a key in the lexicon."""
    lex = F.broadcast(lex) if lex.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else lex
    keys = forms.select("word", "n", "form", F.explode("keys").alias("k")).select("word", "n", "form", "k.kind", "k.key")
    return keys.join(lex, ["kind", "key"], "left_semi").select("word", "n", "form").distinct()


def corrections(words: DataFrame, lex: DataFrame, styles: Sequence[str] = ("common", "fraktur"), edits: int = 1) -> DataFrame:
    """(word, corrected, alternatives, options) for each distinct word that the lexicon doesn't know and that has three letters or more.

    Of its confusable forms that are known, the one of least edit distance, then least difference in length, then first in
    order, is the correction, with the word's initial capital, and the next three are alternatives; a word without
    any is its own. options are the first five known forms in order. A row for each form and key meets the lexicon; what is gathered for a word are its known forms.
    """
    distinct = words.where("word is not null").select("word").distinct()
    at = stored.fresh(words.sparkSession, "unknown-words")
    distinct.where(F.length("word") >= SHORTEST).join(known(with_keys(distinct, lex), lex).select("word"), "word", "left_anti").write.parquet(at)
    unknown = words.sparkSession.read.parquet(at)
    found = known(with_keys(unknown, lex, styles, edits), lex)
    order = F.struct(F.levenshtein("word", "form").alias("d"), F.abs(F.length("form") - F.length("word")).alias("l"), "n", "form")
    best = found.groupBy("word").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 1 + ALTERNATIVES).alias("b"), F.slice(F.array_sort(F.collect_list(F.struct("n", "form"))), 1, OPTIONS).alias("o"))
    first = F.get("b", F.lit(0))["form"]
    capital = F.substring("word", 1, 1).rlike(r"^\p{Lu}")
    named = F.when(first.isNull(), F.col("word")).when(capital, F.concat(F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 30))).otherwise(first)
    forms = lambda c: F.coalesce(F.transform(c, lambda x: x["form"]), F.array().cast("array<string>"))
    return unknown.join(best, "word", "left").select("word", named.alias("corrected"), forms(F.slice("b", 2, ALTERNATIVES)).alias("alternatives"), forms("o").alias("options"))


def correct_texts(docs: DataFrame, lex: DataFrame, id_col: str = "id", text_col: str = "text", styles: Sequence[str] = ("common", "fraktur"), edits: int = 1) -> DataFrame:
    """(id_col, text, corrections, unresolved, suspicious) for each row of docs, whose ids must differ: T.correct_text and T.suspicious_words of whole texts.

    Words are corrected once for all texts; a text meets the corrections of its own unknown words alone. Null texts are empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    fixes = corrections(vocabulary(rows, "t"), lex, styles, edits)
    each = rows.select("id", F.explode(F.array_distinct(N.words(F.col("t")))).alias("word")).join(fixes, "word")
    own = each.groupBy("id").agg(F.collect_list(F.struct("word", "corrected", "alternatives", "options")).alias("fixes")).withColumnRenamed("id", "own_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, fixes in zip(b["t"].to_pylist(), b["fixes"].to_pylist()):
                of = {f["word"]: f for f in fixes or []}
                spots = [(m.start(), of[m[0]]) for m in T.WORD.finditer(text) if m[0] in of]
                changed = [{"original": f["word"], "corrected": f["corrected"], "position": at, "alternatives": f["alternatives"]} for at, f in spots if f["corrected"] != f["word"]]
                unresolved = list(dict.fromkeys(f["word"] for _, f in spots if f["corrected"] == f["word"]))
                odd = list({f["word"]: {"word": f["word"], "options": f["options"]} for _, f in spots}.values())[:SUSPICIOUS]
                out.append({"text": T.WORD.sub(lambda m: of[m[0]]["corrected"] if m[0] in of else m[0], text), "corrections": changed, "unresolved": unresolved, "suspicious": odd})
            fields = pa.schema([("text", pa.string()), ("corrections", pa.list_(pa.struct([("original", pa.string()), ("corrected", pa.string()), ("position", pa.int32()), ("alternatives", pa.list_(pa.string()))]))), ("unresolved", pa.list_(pa.string())), ("suspicious", pa.list_(pa.struct([("word", pa.string()), ("options", pa.list_(pa.string()))])))])
            made = pa.RecordBatch.from_pylist(out, fields)
            yield pa.RecordBatch.from_arrays([b["id"], *made.columns], ["id", *fields.names])

    both = rows.join(own, F.col("id").eqNullSafe(F.col("own_id")), "left").select("id", "t", "fixes")
    return both.mapInArrow(run, f"id {kind}, text string, corrections array<struct<original: string, corrected: string, position: int, alternatives: array<string>>>, unresolved array<string>, suspicious array<struct<word: string, options: array<string>>>").withColumnRenamed("id", id_col)


def postprocess(docs: DataFrame, lex: DataFrame, analyze, id_col: str = "id", text_col: str = "text", correct: bool = True) -> DataFrame:
    """What follows recognition: texts corrected (unless not correct), then analysed as articles by `analyze`, a function of udfs.functions(); with the number of corrections and the unresolved words."""
    none = F.array().cast("array<string>")
    fixed = correct_texts(docs, lex, id_col, text_col).select(id_col, "text", F.size("corrections").alias("n_corrections"), "unresolved") if correct else docs.select(id_col, F.col(text_col).alias("text"), F.lit(0).alias("n_corrections"), none.alias("unresolved"))
    return fixed.withColumn("a", analyze(F.col("text"))).select(id_col, "n_corrections", "unresolved", "a.*")
