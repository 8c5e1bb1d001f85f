"""Benchmark decontamination by Wu-Manber search over words.

A symbol is a word, a block two words. For patterns of m words a table holds, by
block hash, how far the search may move on; where it may not, the bucket of the
block that ends the window names the patterns to compare word by word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table

#: A-Z to lower case; ASCII outside 0-9 and a-z to blanks. Bytes of other characters stay.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SLOTS = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased; null has none."""
    return (text or "").encode().translate(FOLD).split()


def blocks(hashes: np.ndarray, width: int) -> np.ndarray:
    """Slot of the block that ends at each word from the width-th on."""
    h = hashes.astype(np.uint64)
    if width == 2:
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(SLOTS)).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


class WuManber:
    """Patterns of one length in words, each with the items it is from."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.patterns, self.m = patterns, len(next(iter(patterns)))
        self.width = min(2, self.m)
        self.shift = np.full(SLOTS, self.m - self.width + 1, np.int8 if self.m < 100 else np.int32)
        self.bucket: dict[int, dict[bytes, list[tuple[bytes, ...]]]] = {}
        for p in patterns:
            slots = blocks(word_hashes(list(p)), self.width)
            np.minimum.at(self.shift, slots, np.arange(len(slots) - 1, -1, -1).astype(self.shift.dtype))
            self.bucket.setdefault(int(slots[-1]), {}).setdefault(p[0], []).append(p)

    def search(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of all occurrences."""
        if len(words) < self.m:
            return
        slots = blocks(hashes, self.width)
        shift = self.shift[slots]
        moves = shift.tolist()
        i, n, before = self.m - self.width, len(moves), self.m - self.width
        while i < n:
            if moves[i]:
                i += moves[i]
                continue
            at = i - before
            for p in self.bucket.get(int(slots[i]), {}).get(words[at], ()):
                if tuple(words[at : at + self.m]) == p:
                    yield at, p
            i += 1


def windows(items: Iterable[tuple[object, str | None]], window: int, short_items: bool) -> Iterator[tuple[tuple[bytes, ...], str]]:
    for item, text in items:
        w = words_of(text)
        if item is not None and w and (short_items or len(w) >= window):
            for at in range(max(1, len(w) - window + 1)):
                yield tuple(w[at : at + window]), str(item)


def pattern_blocks(benchmark: DataFrame, window: int, most: int, short_items: bool = True) -> Iterator[list[WuManber]]:
    """Searchers for at most `most` windows at a time, so that what is broadcast at once is bounded."""
    held: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    n = 0
    for p, item in windows(((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator()), window, short_items):
        held.setdefault(len(p), {}).setdefault(p, set()).add(item)
        n += 1
        if n >= most:
            yield [WuManber(x) for x in held.values()]
            held, n = {}, 0
    if held:
        yield [WuManber(x) for x in held.values()]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: Columns that occurrences adds.
FOUND = ("n_words", "hit_spans", "hit_items", "hit_whole")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_windows: int = 250_000, short_items: bool = True) -> DataFrame:
    """docs with columns more: n_words, hit_spans (array of [start, end) word spans, merged), hit_items (sorted item ids), hit_whole (those of them with a hit of `window` words).

    Windows of `window` consecutive words of an item occur in a document's words; an item of fewer,
    but not none, is one window, unless short_items is off. Null or wordless texts have no words and no
    hits; null item ids and wordless items are left out; items repeated under one id count
    once. Columns of docs with the names of the new ones are replaced. Nothing is
    shuffled: each block of benchmark windows is broadcast and takes one pass over the texts.
    """
    names = [c for c in docs.columns if c.lower() not in FOUND]
    none = F.expr("cast(array() as array<string>)")
    rows = docs.select(names).withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.expr("cast(array() as array<struct<start: long, end: long>>)"), "hit_items": none, "hit_whole": none})
    for k, block in enumerate([None, *pattern_blocks(benchmark, window, block_windows, short_items)][1:] or [[]]):
        rows = one_pass(checkpointed(rows) if k else rows, block, window)
    return rows


def one_pass(rows: DataFrame, block: list[WuManber], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([s.patterns for s in block])

    def run(batches):
        searchers = [WuManber(p) for p in shared.value]
        for b in batches:
            counts, spans, items, wholes = [], [], [], []
            for text, old_spans, old_items, old_whole in zip(b["text"], b["hit_spans"], b["hit_items"], b["hit_whole"]):
                words = words_of(text.as_py())
                hashes = word_hashes(words)
                hit, named, whole = [(x["start"], x["end"]) for x in old_spans.as_py()], set(old_items.as_py()), set(old_whole.as_py())
                for s in searchers:
                    for at, p in s.search(words, hashes):
                        hit.append((at, at + s.m))
                        named |= s.patterns[p]
                        if s.m >= window:
                            whole |= s.patterns[p]
                counts.append(len(words))
                spans.append([{"start": x, "end": y} for x, y in merged(hit)])
                items.append(sorted(named))
                wholes.append(sorted(whole))
            new = {"n_words": pa.array(counts, pa.int64()), "hit_spans": pa.array(spans, b.schema.field("hit_spans").type), "hit_items": pa.array(items, b.schema.field("hit_items").type), "hit_whole": pa.array(wholes, b.schema.field("hit_whole").type)}
            yield pa.RecordBatch.from_arrays([new.get(c, b[c]) for c in b.schema.names], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


LEAST_ITEMS = 2


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 1) -> DataFrame:
    """docs without the rows in which whole windows of least_items or more items occur, or LEAST_ITEMS items of any length; columns as they were.

    One item of a few words may stand in a clean document by chance, a passage of eight does not. Each row is judged by its text alone, so rows
    that repeat an id may fare differently; null and empty texts stay, and an empty table gives no rows.
    """
    used = {c.lower() for c in docs.columns}
    kept_as = {c: "_" * (1 + max(map(len, used))) + c for c in docs.columns if c.lower() in FOUND}  # a name that no column has
    found = occurrences(docs.withColumnsRenamed(kept_as), benchmark).where((F.size("hit_items") < max(least_items, LEAST_ITEMS)) & (F.size("hit_whole") < least_items))
    return found.select(*(F.col(kept_as.get(c, c)).alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = occurrences(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") >= LEAST_ITEMS).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(8, len(w)) AS m, array_to_string(list_slice(w, i, i + least(8, len(w)) - 1), ' ') AS t
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS t
      FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT g.doc_id, g.i, g.m, p.item_id FROM g JOIN p ON g.m = p.m AND g.t = p.t),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(s.n_items, 0) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, coalesce(s.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
