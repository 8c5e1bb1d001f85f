"""The tokens of native.tokens for batches of texts in Arrow: code points are looked up, tokens are cut out at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .native import ACCENTED, PLAIN

ALL, GONE = 0x110000, 0xFFFFFFFF


@cache
def letters_of(spark: SparkSession) -> np.ndarray:
    """What stands in a token for each code point of a lower-case text: a letter or digit (as Spark's patterns have them) without marks; 0 for what is between tokens; GONE for marks, which are passed over."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    ranges = spark.range(ALL).where(~F.col("id").between(0xD800, 0xDFFF) & char.rlike(r"^[\p{L}\p{N}]$")).agg(F.collect_list(F.col("id").cast("int")).alias("all"))
    token = np.zeros(ALL, np.bool_)
    token[ranges.first()["all"]] = True
    plain = np.arange(ALL, dtype=np.uint32)
    plain[[ord(c) for c in ACCENTED]] = [ord(c) for c in PLAIN] + [GONE] * (len(ACCENTED) - len(PLAIN))
    plain[plain == ord("ſ")] = ord("s")
    kept = plain != GONE
    plain[kept] = np.where(token[plain[kept]], plain[kept], 0)
    return plain


def tokens_of(texts: pa.StringArray, letters: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The tokens of lower-case texts, one after the other, and how many each text has. Texts must not be null."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    ends = bounds - bounds[0]
    points = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    without = lambda gone, at: at - np.searchsorted(np.flatnonzero(gone), at)
    if len(points) < len(data):
        ends = without((data & 0xC0) == 0x80, ends)
    signs = letters[points]
    if (marks := signs == GONE).any():
        ends, signs = without(marks, ends), signs[~marks]
    inside = signs != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(signs)]
    begins[heads] = inside[heads]
    signs = signs[inside]
    if not len(signs):
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    per_text = np.diff(np.searchsorted(np.flatnonzero(begins), ends))
    starts = np.append(np.flatnonzero(begins[inside]).astype(np.int32), np.int32(len(signs)))
    if signs.max() < 0x80:
        utf8 = signs.astype(np.uint8)
    else:
        utf8 = signs.tobytes().decode("utf-32-le").encode()
        more = np.zeros(len(signs) + 1, np.int32)
        np.cumsum((signs >= 0x80).view(np.uint8) + (signs >= 0x800) + (signs >= 0x10000), dtype=np.int32, out=more[1:])
        starts = starts + more[starts]
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(utf8)), per_text
