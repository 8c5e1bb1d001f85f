"""Text functions as column expressions; they run inside code generation and never leave the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import ABBREVIATIONS, CHARACTER_FIXES, CORE, GERMANISMS, MODERN_MARK, OLD_MARKS, PALATALS, STOPWORDS, SUFFIXES

def plain_letters() -> tuple[str, str]:
    """All lower-case letters that Unicode decomposes into one letter and marks, with that letter; then the marks, which go. Hangul, which decomposes into letters, is left."""
    pairs, gone = [], []
    for c in map(chr, range(0x80, 0x10000)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if not base:
            gone.append(c)
        elif len(base) == 1 and base != c and not 0xD800 <= ord(c) <= 0xDFFF:
            pairs.append((c, base))
    return "".join(c for c, _ in pairs) + "".join(gone), "".join(b for _, b in pairs)


ACCENTED, PLAIN = plain_letters()
SUFFIX = "|".join(sorted(set(SUFFIXES), key=lambda s: (-len(s), s)))


def deaccent(c: Column) -> Column:
    """Lower case without the marks of letters, of any script but Hangul."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))


def tokens(c: Column) -> Column:
    """Search tokens: letters and digits without marks, long s as s."""
    return F.regexp_extract_all(F.translate(deaccent(c), "ſ", "s"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def stem(c: Column) -> Column:
    return F.regexp_replace(deaccent(c), f"^(.{{3,}}?)({SUFFIX})$", "$1")


def stems(c: Column) -> Column:
    """The stem of each word of a text, with a blank between: as stem of each of words, by one pass over the text."""
    return F.regexp_replace(deaccent(F.array_join(words(c), " ")), f"(?<![^ ])([^ ]{{3,}}?)(?:{SUFFIX})(?![^ ])", "$1")


#: A letter of a letter-spaced run and the blank after it: the run has four single letters or more, and a match goes on where the last one ended.
SPACED = r"(?:(?<!\p{L})(?=(?:\p{L}\s){3,}\p{L}(?!\p{L}))|\G(?!^))(\p{L})\s(?=\p{L}(?!\p{L}))"


def clean_ocr(c: Column) -> Column:
    """As the Python function, for texts in NFC."""
    c = reduce(lambda x, fix: F.replace(x, F.lit(fix[0]), F.lit(fix[1])), CHARACTER_FIXES, F.coalesce(c, F.lit("")))
    for pattern, by in ((r"(\p{L})[-=¬]\s*\n\s*(\p{L})", "$1$2"), (SPACED, "$1"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        c = F.regexp_replace(c, pattern, by)
    return c


#: Blanks of any script, and the end of a sentence with them.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
SENTENCE_END = f"(?<=[.!?]){BLANK}+"


def bound(c: Column, use) -> Column:
    """use(c), an array, with c worked out once however often use has it."""
    return F.flatten(F.transform(F.array(c), use))


def sentences(c: Column) -> Column:
    """Sentences of a text (in NFC; null: none), cleaned. A part that ends in an abbreviation or in a number of up to four digits belongs to what is before it and to what is after it.

    Whether two parts belong together is seen from their ends alone, so the parts are looked at once, and time and memory are in proportion to the text.
    """
    trimmed = F.transform(F.split(clean_ocr(c), SENTENCE_END), lambda p: F.regexp_replace(p, f"^{BLANK}+|(?<!{BLANK}){BLANK}+$", ""))

    def binds(p: Column) -> Column:
        last = F.lower(F.regexp_replace(p, f"(?s)^.*{BLANK}", ""))
        return last.isin(*ABBREVIATIONS) | last.rlike(r"^\p{Nd}{1,4}\.\z")

    def join(parts: Column, binding: Column) -> Column:
        begins = F.filter(F.transform(binding, lambda b, i: F.when((i == 0) | ~(b | F.get(binding, i - 1)), i)), lambda i: i.isNotNull())
        whole = lambda begin: F.transform(begin, lambda s, k: F.array_join(F.slice(parts, s + 1, F.coalesce(F.get(begin, k + 1), F.size(parts)) - s), " "))
        return bound(begins, whole)

    return bound(F.filter(trimmed, lambda p: p != ""), lambda parts: bound(F.transform(parts, binds), lambda binding: join(parts, binding)))


def spelling_rules(c: Column) -> Column:
    """Core, germanism and palatal rules of a lower-case word."""
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [*CORE, *GERMANISMS, *PALATALS], c)


def old_weight(word: Column) -> Column:
    return F.greatest(*(F.when(word.rlike(p), w).otherwise(0.0) for p, w in OLD_MARKS))


def old_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, old_score, not rounded): one row per row of docs. Words are exploded and weighed inside code generation; the eight marks are tried only in words that have one of them."""
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), words(F.lower(F.col(text_col))).alias("w"))
    each = rows.select("r", "id", F.explode_outer("w").alias("w"))
    some = F.col("w").rlike("|".join(f"(?:{p})" for p, _ in OLD_MARKS))
    weighed = each.select("r", "id", F.when(some, old_weight(F.col("w"))).otherwise(0.0).alias("o"), (~some & F.col("w").rlike(MODERN_MARK)).cast("int").alias("m"))
    sums = weighed.groupBy("r", "id").agg(F.sum("o").alias("o"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    return sums.select(F.col("id").alias(id_col), F.when(F.col("o") == 0, 0.0).otherwise(F.col("o") / (F.col("o") + F.col("m"))).alias("old_score"))


def old_score(c: Column) -> Column:
    w = F.transform(words(F.lower(c)), lambda x: F.struct(old_weight(x).alias("o"), x.rlike(MODERN_MARK).alias("m")))
    sums = F.aggregate(w, F.struct(F.lit(0.0).alias("o"), F.lit(0).alias("m")), lambda a, x: F.struct((a["o"] + x["o"]).alias("o"), (a["m"] + F.when((x["o"] == 0) & x["m"], 1).otherwise(0)).alias("m")))
    return F.when(sums["o"] == 0, 0.0).otherwise(F.round(sums["o"] / (sums["o"] + sums["m"]), 3))


def languages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, language, confidence), a row for each row of docs, by the stop-word shares of cleaned texts (in NFC); ties go lv, de, et.

    Words are exploded and looked up in one broadcast list, and a row's sums are made in the task that reads it: only these are shuffled. Letters are those of words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).alias("id"), words(F.lower(clean_ocr(F.col(text_col)))).alias("w"))
    each = rows.select("r", "id", F.explode_outer("w").alias("w")).withColumn("n", F.when(F.col("w").isNotNull(), 1).otherwise(0))
    stops = docs.sparkSession.createDataFrame([(w, *(w in STOPWORDS[k] for k in ("lv", "de", "et"))) for w in sorted({w for v in STOPWORDS.values() for w in v})], "w string, lv boolean, de boolean, et boolean")
    known = each.join(F.broadcast(stops), "w", "left")  # a fixed list of some 150 words
    within = lambda k: F.coalesce(F.sum(F.when(F.col(k), F.col("n"))), F.lit(0))
    more = F.octet_length("w") > F.length("w")  # only such words have marks or Cyrillic letters
    count = lambda test, n: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    cyrillic, letters = count(more & F.col("w").rlike("[Ѐ-ӿ]"), F.col("n") * F.length(F.regexp_replace("w", "[^Ѐ-ӿ]", ""))), F.sum(F.col("n") * F.length("w"))
    sums = known.groupBy("r", "id").agg(F.sum("n").alias("n"), (cyrillic / letters).alias("c"), within("lv").alias("lv"), within("de").alias("de"), within("et").alias("et"), count(more & F.col("w").rlike(MODERN_MARK), F.col("n")).alias("marks"))
    lv, de, et = F.col("lv") / F.col("n") + F.least(F.lit(0.25), F.col("marks") / F.col("n")), F.col("de") / F.col("n"), F.col("et") / F.col("n")
    shares = sums.select("id", "n", "c", *(F.when(F.col("n") > 0, x).otherwise(0.0).alias(k) for k, x in (("lv", lv), ("de", de), ("et", et))))
    best, ru, none = F.greatest("lv", "de", "et"), (F.col("c") > 0.2) & (F.col("n") > 0), F.col("n") == 0
    name = F.when(none, "unknown").when(ru, "ru").when(best < 0.03, "unknown").when(F.col("lv") == best, "lv").when(F.col("de") == best, "de").otherwise("et")
    score = F.when(none, 0.0).when(ru, F.least(F.lit(1.0), "c")).when(best < 0.03, best).otherwise(F.least(F.lit(1.0), 4 * best))
    return shares.select(F.col("id").alias(id_col), name.alias("language"), F.round(score, 3).alias("confidence"))


def julian_to_gregorian(d: Column) -> Column:
    days = F.when(d < "1700-03-01", 10).when(d < "1800-03-01", 11).when(d < "1900-03-01", 12).otherwise(13)
    return F.date_add(d, days)


def guess_date(c: Column) -> Column:
    """The first year, month and day, zero-padded and unchecked; else the first year; else empty."""
    full = r"(1[5-9]\d{2}|20\d{2})[-./](\d{1,2})[-./](\d{1,2})"
    part = lambda k: F.lpad(F.regexp_extract(c, full, k), 2, "0")
    return F.when(F.regexp_extract(c, full, 1) != "", F.concat_ws("-", F.regexp_extract(c, full, 1), part(2), part(3))).otherwise(F.regexp_extract(c, r"\b(1[5-9]\d{2}|20[0-2]\d)\b", 1))


def snippet(text: Column, query: str, width: int = 160) -> Column:
    """width characters around the first query word, or the first of the text."""
    first = F.lit((query.lower().split() or [""])[0])
    at = F.instr(F.lower(text), first)
    start = F.when(at > 0, F.greatest(at - width // 2, F.lit(1))).otherwise(1)
    return F.trim(F.substr(text, start, F.lit(width)))


def document_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *(F.nullif(p, F.lit("")) for p in parts))), 1, 20)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def round_half_even(c: Column) -> Column:
    return F.bround(c)
