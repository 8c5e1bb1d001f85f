"""Near copies by exact Jaccard similarity of five-word shingles, on candidates from SimHash fingerprints and MinHash bands.

The SimHash fingerprint of a text's distinct shingles meets others at the anchors of the covering code (see simhash), and
those at 2 or fewer differing bits are candidates. At a similarity of 0.8 more bits differ, so texts meet at MinHash anchors too: a text's anchors are BANDS hashes of ROWS minima each over its distinct shingles; two texts
of Jaccard similarity s meet at one with probability 1 - (1 - s^ROWS)^BANDS: 0.99993 at 0.8,
the probability rising with s. Texts that meet are linked if, and only if, the similarity of their whole shingle sets,
as 64-bit hashes, is the asked one or more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, shuffled, without_copies
from .components import connected_components
from .simhash import SEED, links as fingerprint_links, majority

ROWS, BANDS = 5, 24
CACHE, BLOCK, SLICE = 300_000, 1 << 12, 1 << 15
#: At an anchor of up to so many texts all pairs are candidates; the texts of a fuller one are compared where they meet.
PAIRED = 32
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle_words: int, cache: dict) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text; of fewer words than a shingle has, all of them are one. No words: none."""
    words = ascii_words((text or "").encode())
    if not words:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w, SEED)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(shingle_words, len(words))
    n = len(words) - k + 1
    shingles = np.zeros(n, np.uint64)
    for i in range(k):
        shingles = mixed(shingles * np.uint64(31) + h[i : i + n], 7)
    return np.unique(shingles)


def anchors(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of shingles, each of the band and its minima; none of an empty set."""
    if not len(shingles):
        return shingles
    least = np.full(ROWS * BANDS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        x = shingles[at : at + BLOCK, None] * FACTORS[0] + FACTORS[1]
        np.minimum(least, x.min(axis=0), out=least)
    keys = mixed(np.arange(BANDS, dtype=np.uint64), 11)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(31) + row, 13)
    return keys


def alike(one: np.ndarray, many: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have the Jaccard similarity or more with one; all are sorted, and none is empty."""
    n = np.fromiter(map(len, many), np.int64, len(many))
    found = np.zeros(len(many), bool)
    able = np.flatnonzero(np.minimum(n, len(one)) >= similarity * np.maximum(n, len(one)) - 1e-9)
    if len(able):
        x = np.concatenate([many[k] for k in able.tolist()])
        at = np.minimum(np.searchsorted(one, x), len(one) - 1)
        both = np.add.reduceat((one[at] == x).astype(np.int64), np.cumsum(n[able]) - n[able])
        found[able] = both >= similarity * (n[able] + len(one) - both) - 1e-9
    return found


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join what all links among the sets would join: each set is compared with all that it is not joined with yet."""
    out, label = [], np.arange(len(sets))
    for i in range(len(sets)):
        other = np.flatnonzero(label != label[i])
        near = other[alike(sets[i], [sets[k] for k in other.tolist()], similarity)]
        if len(near):
            joined, first = np.unique(label[near], return_index=True)
            out += [(i, k) for k in near[first].tolist()]
            label[np.isin(label, joined)] = label[i]
    return out


def by_key(batches, columns: list[str]):
    """Tables of whole keys, of batches sorted by their column key; each has one key or more."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        # rows of the last key may go on in the next batch
        if held[0]["key"][0].as_py() != (end := b["key"][b.num_rows - 1].as_py()):
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(table["key"].to_numpy() == end)[0])
            yield table.slice(0, cut).select(columns)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).select(columns)


def key_ranges(key: np.ndarray) -> list[tuple[int, int]]:
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return list(zip(begin.tolist(), np.append(begin[1:], len(key)).tolist()))


def digest_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    x = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def fingerprint_rows(groups: DataFrame) -> DataFrame:
    """(key, who): each group at the key of its fingerprint fp, and at that of every lesser fingerprint within 2 bits, by the anchors of the covering code."""
    pairs = checkpointed(fingerprint_links(groups.select("fp").distinct()))
    ball = groups.select("who", "fp", F.col("fp").alias("at")).union(groups.join(shuffled(pairs), groups["fp"] == pairs["v"]).select("who", "fp", F.col("u").alias("at")))
    return ball.select(F.xxhash64(F.lit("fingerprint"), "at").alias("key"), "who")


def links(docs: DataFrame, groups: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(u, v): links among groups (who, least: the id of a text, h1, h2: the digest of its set, fp, anchors) that meet at fingerprints or anchors; where over PAIRED meet, a spanning forest of theirs. docs are texts (id, t).

    Candidate pairs are distinct before texts are fetched; a text's set goes once to each partner and to each full anchor.
    """

    def meet(batches):
        for t in by_key(batches, ["key", "who"]):
            key, who = t["key"].to_numpy(), t["who"].to_numpy()
            to, come, full = [], [], []
            for a, z in key_ranges(key):
                m = np.unique(who[a:z])
                if len(m) > PAIRED:
                    to.append(np.full(len(m), key[a]))
                    come.append(m)
                    full.append(np.ones(len(m), bool))
                elif len(m) > 1:
                    i, j = np.triu_indices(len(m), 1)
                    to.append(m[i])
                    come.append(m[j])
                    full.append(np.zeros(len(i), bool))
            if to:
                rows = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (to, come, full)], ["key", "who", "full"])
                for at in range(0, rows.num_rows, 65536):
                    yield rows.slice(at, 65536)

    meeting = groups.select(F.explode("anchors").alias("key"), "who").union(fingerprint_rows(groups.where(F.size("anchors") > 0)))
    routes = meeting.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "key long, who long, full boolean").distinct()
    leads = routes.where("not full").select("key", F.col("key").alias("who"), "full").distinct()
    goes = checkpointed(routes.union(leads).groupBy("who").agg(F.collect_list(F.struct("key", "full")).alias("to")).join(shuffled(groups.select("who", "least", "h1", "h2")), "who"))

    def send(batches):
        cache: dict = {}
        for b in batches:
            for who, h1, h2, t, to in zip(b["who"].to_pylist(), b["h1"].to_pylist(), b["h2"].to_pylist(), b["t"], b["to"]):
                s = shingle_set(t.as_py(), shingle_words, cache)
                if digest_of(s) != (h1, h2):
                    continue  # another text under the same id
                where = [(x["key"], x["full"]) for x in to.as_py()]
                raw, part = s.tobytes(), max(1, (4 << 20) // max(s.nbytes, 1))
                for at in range(0, len(where), part):
                    w = where[at : at + part]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in w], pa.int64()), pa.array([f for _, f in w]), pa.array([f or k != who for k, f in w]), pa.array([who] * len(w), pa.int64()), pa.array([raw] * len(w), pa.binary())], ["key", "full", "follows", "who", "shingles"])

    def compare(batches):
        key = lead = None
        held: list[np.ndarray] = []
        names: list[int] = []

        def found():
            near = [(names[i], names[j]) for i, j in forest(held, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in near], pa.int64()), pa.array([v for _, v in near], pa.int64())], ["u", "v"])

        for b in batches:
            u, v = [], []
            for k, full, follows, who, raw in zip(*(b[c].to_pylist() for c in ("key", "full", "follows", "who", "shingles"))):
                s = np.frombuffer(raw, np.uint64)
                if (k, full) != key:
                    if held:
                        yield found()
                    key, lead, held, names = (k, full), [], [], []
                if full:
                    held.append(s)
                    names.append(who)
                elif not follows:
                    lead.append(s)
                elif any(alike(x, [s], similarity)[0] for x in lead if len(x) and len(s)):
                    u.append(k)
                    v.append(who)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        if held:
            yield found()

    sent = goes.join(docs.select(F.col("id").alias("least"), "t"), "least").select("who", "h1", "h2", "t", "to").mapInArrow(send, "key long, full boolean, follows boolean, who long, shingles binary")
    return sent.repartition("key", "full").sortWithinPartitions("key", "full", "follows").mapInArrow(compare, "u long, v long")


def components(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float) -> DataFrame:
    """(id, mark, component_id, first): one row per row of docs; mark is the MD5 of its text, first that of the row that stays, whose id is component_id. Both are null for a null id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def sketches(batches):
        cache: dict = {}
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle_words, cache) for t in b["t"]]
            h1, h2 = zip(*map(digest_of, sets)) if sets else ((), ())
            keys = [anchors(s).view(np.int64) for s in sets]
            fp = pa.array(np.array([majority(s[at : at + SLICE] for at in range(0, len(s), SLICE)) for s in sets], np.uint64).view(np.int64))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["id"], b["mark"], pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), fp, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))], ["id", "mark", "h1", "h2", "fp", "anchors"])

    own = checkpointed(rows.select("id", "t", mark_of("t").alias("mark")).mapInArrow(sketches, "id long, mark binary, h1 long, h2 long, fp long, anchors array<long>"))
    some = own.where("id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "mark")).alias("one"), F.first("fp").alias("fp"), F.first("anchors").alias("anchors"))
    # groups, not ids, are linked: an id may repeat with other texts
    groups = checkpointed(some.select("h1", "h2", "one", F.col("one.id").alias("least"), "fp", "anchors", F.monotonically_increasing_id().alias("who")))
    member = connected_components(links(rows, groups, shingle_words, similarity))
    linked = groups.select("h1", "h2", "one", "who").join(shuffled(member), groups["who"] == member["node"], "left").select("h1", "h2", "one", F.coalesce("root", "who").alias("root"))
    least = linked.groupBy("root").agg(F.min("one").alias("one"))
    label = linked.select("h1", "h2", "root").join(least, "root").select("h1", "h2", F.col("one.id").alias("component_id"), F.col("one.mark").alias("first"))
    named = own.where("id is not null").select("id", "mark", "h1", "h2").join(label, ["h1", "h2"]).select("id", "mark", "component_id", "first")
    return named.union(own.where("id is null").select("id", "mark", F.lit(None).cast("long"), F.lit(None).cast("binary")))


def mark_of(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs: id_col, component_id: the least id that links lead to, its own included.

    Texts are linked if their sets of distinct shingles have the Jaccard similarity or more, and meet at a fingerprint or an
    anchor; texts with equal sets always are. Null and wordless texts are alike. Ids are integers;
    a null id is its own component. Rows that repeat an id with another text are rows of their own. An empty table gives no rows.
    """
    found = components(docs, id_col, text_col, shingle_words, similarity)
    return found.select(F.col("id").alias(id_col), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each component, one of least id; columns as they were.

    Decisions are taken by row: another text under an id that is dropped stays, unless it is a copy too. Rows with a null id stay. An empty table gives no rows.
    """
    found = components(docs, id_col, text_col, shingle_words, similarity).where("id is not null")
    kept = (F.col("id") == F.col("component_id")) & (F.col("mark") == F.col("first"))
    decided = checkpointed(found.groupBy(F.col("id").alias("i"), F.col("mark").alias("h"), kept.alias("kept")).agg(F.count("*").alias("n")).where("n > 1 or not kept"))
    return without_copies(docs, F.col(id_col).cast("long"), mark_of(text_col), decided)
