"""Fill-in-the-middle transformation: texts cut in three and put in another order between sentinels; all of it column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def drawn(key: Column, k: int) -> Column:
    """The k-th (from 1) group of eight hex digits of the key's SHA-256, as an unsigned integer."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, keep_percent: int = 10, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): a row for each row of docs; other columns are left out.

    A text is the array of its code points. Prefix and middle end at two cuts that the hash of seed and id draws, the suffix is the
    rest. Form is plain (the text as it is: it is empty, has a sentinel, or is of the
    keep_percent that are kept), spm (spm_percent of the rest: suffix, prefix, middle) or psm (prefix, suffix, middle);
    of plain texts both lengths are null. Null texts count as empty, a null id as an empty
    string of digits; rows that repeat an id are cut at the same draws. The array costs some 60 bytes a code point while its row is worked on.
    """
    p, s, m = (F.lit(x) for x in sentinels)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = rows.select("id", "t", F.regexp_extract_all("t", F.lit("(?s)."), F.lit(0)).alias("units"), key.alias("key"))
    marked = reduce(lambda a, b: a | b, (F.contains("t", x) for x in (p, s, m)))
    form = F.when((F.col("t") == "") | marked | (drawn(F.col("key"), 3) % 100 >= 100 - keep_percent), "plain").when(drawn(F.col("key"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    cut = lambda k: (drawn(F.col("key"), k) % (F.size("units") + 1)).cast("int")
    rows = rows.select("id", "t", "units", F.size("units").cast("long").alias("n"), form.alias("form"), F.least(cut(1), cut(2)).alias("a"), F.greatest(cut(1), cut(2)).alias("b"))
    piece = lambda start, length: F.array_join(F.slice("units", start, length), "")
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = piece(F.lit(1), a), piece(a + 1, b - a), piece(b + 1, F.size("units") - b)
    plain = F.col("form") == "plain"
    # each arrangement names each piece once, so that only the one taken is put together
    output = F.when(plain, F.col("t")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return rows.select("id", "n", "form", F.when(~plain, a.cast("long")).alias("prefix_chars"), F.when(~plain, (b - a).cast("long")).alias("middle_chars"), output.alias("output"))


def restore(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows with restored: the text before the transformation, from output and form alone, by what stands between the sentinels.

    A text that has a sentinel is always plain, and no sentinel begins or ends within another, so each stands in the output once.
    """
    parts = F.when(F.col("form") != "plain", F.split("output", "|".join(f"\\Q{x}\\E" for x in sentinels), -1))
    at = lambda k: F.get("_parts", F.lit(k))
    ordered = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
    return rows.withColumn("_parts", parts).withColumn("restored", ordered).drop("_parts")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: lengths, form, and digests of the output and of the text restored from it. Odd rows: see transform."""
    found = restore(transform(read_table(spark, sf_dir, "documents")))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
