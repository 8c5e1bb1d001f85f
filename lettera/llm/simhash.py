"""SimHash near-dedup with anchor points from a covering code.

A 64-bit fingerprint has two halves of 32 bits. Where two fingerprints differ in
at most 2 bits, one half differs in at most 1. On 31 bits of a half the perfect
Hamming code [31, 26] has covering radius 1: each half has a home anchor within
distance 1, and each half within distance 1 of it lies within distance 2 of that
anchor. So fingerprints go once to their home anchors and once to every anchor
within radius plus threshold (at most 16 a half), and are compared per anchor.
The 32nd bit of a half takes no part in the anchor, only in the comparison.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, read_table, shuffled
from .components import connected_components

SEED, BLOCK = 42, 1 << 15


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Fingerprint of a whole text; a bit is set if over half the shingle hashes have it. No words: 0."""
    words = ascii_words((text or "").encode())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])], np.uint64) for at in range(0, n, BLOCK))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that over half of the 64-bit hashes have, given in arrays; 0 of none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle_words) for t in b["t"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the positions 1..31 of the bits set in x; 0 for codewords."""
    s = np.zeros(len(x), np.uint32)
    for i in range(31):
        s ^= np.where((x >> np.uint32(i)) & np.uint32(1), np.uint32(i + 1), np.uint32(0))
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit values: home anchors, and (n, 16) all anchors within distance 2, home repeated where there are fewer."""
    x = (half & np.uint32(0x7FFFFFFF)).astype(np.uint32)
    s = syndrome(x)
    bit = lambda p: np.where(p > 0, np.uint32(1) << (np.maximum(p, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    home = x ^ bit(s)
    near = np.repeat(home[:, None], 16, axis=1)
    filled = np.ones(len(x), np.int64)
    for i in range(1, 32):
        j = np.uint32(i) ^ s
        at = np.flatnonzero((s > 0) & (j > i))
        near[at, filled[at]] = x[at] ^ np.uint32(1 << (i - 1)) ^ bit(j[at])
        filled[at] += 1
    return home, near


def anchor_rows(fps: DataFrame, home_only: bool) -> DataFrame:
    """(anchor, fp): each fp at its home anchors, or at every anchor within radius plus threshold."""

    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for side in (0, 1):
                home, near = anchors(((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                if home_only:
                    keys, who = home, fp
                else:
                    fresh = np.ones(near.shape, bool)
                    fresh[:, 1:] = near[:, 1:] != home[:, None]
                    keys, who = near[fresh], np.repeat(fp, 16).reshape(-1, 16)[fresh]
                keys = keys.astype(np.int64) | (side << 32)
                for at in range(0, len(keys), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 65536]), pa.array(who[at : at + 65536].view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(u, v), u < v: each pair of distinct fingerprints (fp) that differ in 1 or 2 bits, once.

    A fingerprint has at most 2080 such partners, so rows stay in proportion to fps.
    """
    home, near = anchor_rows(fps, True).withColumnRenamed("fp", "u"), anchor_rows(fps, False).withColumnRenamed("fp", "v")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    low = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    once = F.when(F.col("anchor") < F.lit(1 << 32), low <= 1).otherwise(low == 2)  # the lower half finds the pair if it can
    return shuffled(home).join(near, "anchor").where((F.col("u") < F.col("v")) & (F.bit_count(differ) <= 2) & once).select("u", "v")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """One row per row of docs: id_col, fp (long), n_links, component_id.

    Fingerprints at 2 or fewer differing bits are linked; component_id is the least
    id reachable. n_links counts the other distinct fingerprints linked to the row's own. Null or
    empty texts have fingerprint 0 and are linked like any other; repeated rows and
    ties share a component; a null id never becomes a component_id unless its
    component has no other. An empty table gives no rows; further columns are ignored.
    """
    own = checkpointed(fingerprints(docs, id_col, text_col, shingle_words))
    groups = own.groupBy("fp").agg(F.min("id").alias("least"))
    pairs = checkpointed(links(groups))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    member = connected_components(pairs).select(F.col("node").alias("fp"), "root")
    linked = groups.join(shuffled(member), "fp")
    first = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    label = linked.join(shuffled(first), "root").join(shuffled(degree), "fp").select("fp", "component_id", "n_links")
    label = checkpointed(groups.join(shuffled(label), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    return own.join(shuffled(label), "fp").select(F.col("id").alias(id_col), "fp", "n_links", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
