"""Removal of long repeats across documents with suffix arrays.

Any 50-byte string holds a 16-gram whose hash is the least among its 35 (winnowing), so
two documents share the string only if they share that gram and what surrounds it.
1. Each document's selected grams go, as packed arrays, to the task of their hash, each
   with a hash of its context: the 34 bytes before it and the 34 after it.
   Of equal contexts all but those of the least document are resolved there.
2. Only grams that documents share in different contexts need their bytes, and of these only contexts that
   share 17 bytes on one side of the gram too, as any 50 bytes around it reach so far on the left or on the right.
   These contexts are dealt by gram to tasks, which cut them into shards.
   A shard's suffix array comes from Larsson-Sadakane refinement,
   common prefixes from Kasai's recurrence, run abreast over all contexts. Runs of suffixes with 50 bytes in common are
   equal strings; where the contexts of one gram fill several shards, the shards'
   sorted strings are merged by binary search.
3. Each document gets its spans and is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

GRAM = 16
#: Bytes of text worked on at once; entries held before they are sent; bytes of contexts in a shard.
PIECE, HELD, SHARD = 1 << 19, 1 << 19, 1 << 19
BASE, INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, base, np.uint64)))) if n > 1 else np.ones(n, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of x[i : i + width], for every i that has so many."""
    have = 1
    while have * 2 <= width:
        x, have = best(x[:-have], x[have:]), have * 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Winnower:
    """Selected grams of texts: positions, gram hashes and context hashes."""

    def __init__(self, length: int, piece: int):
        self.piece = piece
        self.length, self.span = length, length - GRAM + 1
        self.side = (length - GRAM) // 2
        self.letters = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.up = self.down = np.ones(0, np.uint64)

    def pieces(self, text: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(low, high, first, last): bytes low to high hold all that windows first to last and their contexts need."""
        for first in range(0, len(text) - self.length + 1, self.piece):
            last = min(first + self.piece, len(text) - self.length + 1)
            yield max(0, first - self.span + 1), min(len(text), last + 2 * self.length), first, last

    def select(self, parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
        """For parts (bytes, first, last window): part and position in it of each selected gram, gram hash, context hash, hashes of the gram with what is left and with what is right of it, zero if that is too short."""
        lens = np.array([len(p) for p, _, _ in parts])
        starts = np.concatenate(([0], np.cumsum(lens)))
        buf = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
        n = len(buf)
        if len(self.up) < n + 1:
            self.up, self.down = powers(BASE, 2 * n + 1), powers(INVERSE, 2 * n + 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum(self.letters[buf] * self.up[:n])))
        gram = mixed((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1]) | np.uint64(1)
        least = sliding(gram, self.span, np.minimum)  # at each window's start
        ok = np.zeros(len(least), bool)
        for at, (_, first, last) in zip(starts, parts):
            ok[at + first : at + last] = True
        least[~ok] = 0
        reach = np.concatenate((np.zeros(self.span - 1, np.uint64), least, np.zeros(max(0, len(gram) - len(least)), np.uint64)))
        at = np.flatnonzero(sliding(reach, self.span, np.maximum)[: len(gram)] == gram)
        part = np.searchsorted(starts, at, "right") - 1
        low = np.maximum(starts[part], at - self.span + 1)
        high = np.minimum(starts[part + 1], at + self.length)
        around = mixed((total[high] - total[low]) * self.down[low] + np.uint64(BASE) * ((at - low).astype(np.uint64) * np.uint64(256) + (high - at).astype(np.uint64)))
        few = lambda low, high, ok: np.where(ok, mixed((total[high] - total[low]) * self.down[low]) >> np.uint64(32) | np.uint64(1), np.uint64(0)).astype(np.uint32)
        left = few(np.maximum(at - self.side, 0), at + GRAM, at - self.side >= starts[part])
        right = few(at, np.minimum(at + GRAM + self.side, n), at + GRAM + self.side <= starts[part + 1])
        return part, at - starts[part], gram[at], around, left, right


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length as byte planes, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T).tobytes() for c in columns)
    return np.uint32(len(columns[0])).tobytes() + zstandard.compress(planes, 1)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, planes, out, at = int(np.frombuffer(blob, np.uint32, 1)[0]), zstandard.decompress(blob[4:]), [], 0
    for k in kinds:
        width = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(planes, np.uint8, n * width, at).reshape(width, n).T).view(k).ravel())
        at += n * width
    return out


#: Of an entry: gram (its lower half; the upper gives the bucket), context, document, position, sides.
KINDS = ["<u4", "<u8", "<i8", "<u4", "<u4", "<u4"]


def first_of(gram, around, doc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (gram, context, document); in it, whether a row's document is the least with its context, and where contexts begin."""
    order = np.lexsort((doc, around, gram))
    g, a, d = gram[order], around[order], doc[order]
    begins = np.concatenate(([True], (g[1:] != g[:-1]) | (a[1:] != a[:-1])))
    return order, d == d[np.maximum.accumulate(np.where(begins, np.arange(len(d)), 0))], begins


def selected_grams(rows: DataFrame, length: int, buckets: int, piece: int = PIECE, most: int = HELD) -> DataFrame:
    """(bucket, open, done): packed entries, those still open in the bucket of their gram, and (document, position) of those that a smaller document of the task resolves, in any bucket."""

    def run(batches):
        winnow = Winnower(length, piece)
        held: list[list[np.ndarray]] = []
        turn = 0

        def flush():
            nonlocal turn
            if not held:
                return
            gram, around, doc, pos, left, right = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first, _ = first_of(gram, around, doc)
            gone, keep = order[~first], order[first]
            bucket = (gram[keep] >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            for at in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                k = keep[at]
                yield int(bucket[at[0]]), pack([gram[k].astype(np.uint32), around[k], doc[k], pos[k], left[k], right[k]]), None
            if len(gone):
                turn += 1
                yield (int(doc[gone[0]]) + turn) % buckets, None, pack([doc[gone], pos[gone]])

        def batch_of(found):
            b, o, d = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(o, pa.binary()), pa.array(d, pa.binary())], ["bucket", "open", "done"])

        def take(parts, where):
            part, pos, gram, around, left, right = winnow.select(parts)
            ids, lows = np.array([w[0] for w in where], np.int64), np.array([w[1] for w in where])
            held.append([gram, around, ids[part], (pos + lows[part]).astype(np.uint32), left, right])

        for b in batches:
            parts, where, size = [], [], 0
            for i, t in zip(b["id"], b["t"]):
                i, text = i.as_py(), (t.as_py() or "").encode()
                if i is None:
                    continue
                for low, high, first, last in winnow.pieces(text):
                    parts.append((text[low:high], first - low, last - low))
                    where.append((i, low))
                    size += high - low
                    if size >= piece:
                        take(parts, where)
                        parts, where, size = [], [], 0
                    if sum(len(x[0]) for x in held) >= most:
                        yield batch_of(flush())
            if parts:
                take(parts, where)
        if held:
            yield batch_of(flush())

    return rows.mapInArrow(run, "bucket int, open binary, done binary")


def shared_side(gram: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which entries have a side, with their gram, that an entry of another document has too."""
    key = gram.astype(np.uint64) << np.uint64(32) | side
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    differ = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
    out = np.empty(len(key), bool)
    out[order] = np.repeat(differ, np.diff(np.append(head, len(k))))
    return out & (side > 0)


def resolved(grams: DataFrame, most: int = HELD) -> DataFrame:
    """(doc, pos, gram): gram null where the whole context of the gram at pos is in a smaller document, else the gram whose contexts must be compared."""

    def rows(doc, pos, gram=None):
        for k in range(0, len(doc), 65536):
            some = doc[k : k + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(pos[k : k + 65536].astype(np.int64)), pa.nulls(len(some), pa.int64()) if gram is None else pa.array(gram[k : k + 65536].astype(np.int64))], ["doc", "pos", "gram"])

    def first_only(held):
        """The entries of least document of each context, and those of other documents."""
        columns = [np.concatenate(x) for x in zip(*held)]
        order, first, _ = first_of(columns[0], columns[1], columns[2])
        return [c[order[first]] for c in columns], [c[order[~first]] for c in columns]

    def run(batches):
        now, held, size = None, [], 0

        def close():
            if held:
                (gram, _, doc, pos, left, right), gone = first_only(held)
                yield from rows(gone[2], gone[3])
                many = shared_side(gram, left, doc) | shared_side(gram, right, doc)
                yield from rows(doc[many], pos[many], gram[many])

        for b in batches:
            for k, o, d in zip(b["bucket"].to_pylist(), b["open"], b["done"]):
                if k != now:
                    yield from close()
                    now, held, size = k, [], 0
                if d.is_valid:
                    yield from rows(*unpack(d.as_py(), ["<i8", "<u4"]))
                if o.is_valid:
                    held.append(unpack(o.as_py(), KINDS))
                    size += len(held[-1][0])
                    if size >= 2 * most and len(held) > 1:  # a hot gram: equal contexts leave as they come
                        kept, gone = first_only(held)
                        yield from rows(gone[2], gone[3])
                        held, size = [kept], len(kept[0]) // 2
        yield from close()

    return grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc long, pos long, gram long")


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by Larsson-Sadakane: sort by a few symbols, then sort again, by the rank of what follows, only the groups that are not yet single."""
    n = len(text)
    wide = np.zeros(n + 8, np.uint64)
    wide[:n] = text
    key, step = np.zeros(n, np.uint64), 7  # nine bits a symbol
    for k in range(step):
        key = (key << np.uint64(9)) | wide[k : k + n]
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while True:
        single = first & np.append(first[1:], True)
        at = np.flatnonzero(~single)  # places in order whose group is not single
        if not len(at):
            return order, rank[:n]
        who = order[at]
        key = rank[who] * (n + 1) + rank[np.minimum(who + step, n)] + 1
        by = np.argsort(key, kind="stable")
        key, who = key[by], who[by]
        order[at] = who
        first[at] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[who] = np.maximum.accumulate(np.where(first[at], at, 0))
        step *= 2


def kasai(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, lens: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to most: Kasai's recurrence, in all contexts at once, one offset after the other."""
    n = len(text)
    padded = np.append(text, np.zeros(most + 1, text.dtype))
    lcp = np.zeros(n, np.int64)
    held = np.zeros(len(starts), np.int64)
    for offset in range(int(lens.max(initial=0))):
        lanes = np.flatnonzero(lens > offset)
        i = starts[lanes] + offset
        r = rank[i]
        j = order[np.maximum(r - 1, 0)]
        h = np.where(r > 0, np.maximum(held[lanes] - 1, 0), 0)
        active = np.flatnonzero((r > 0) & (h < most))
        while len(active):
            a, b = i[active] + h[active], j[active] + h[active]
            active = active[(np.maximum(a, b) < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            h[active] += 1
            active = active[h[active] < most]
        lcp[r] = h
        held[lanes] = h
    return lcp


def shard_groups(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `length` bytes of the contexts in suffix order: context, offset, group of equal strings; and the shard's text as bytes."""
    lens = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16) + 1
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    text[starts + lens] = 0  # a separator is less than any byte
    order, rank = suffix_array(text)
    lcp = kasai(text, order, rank, starts, lens, length)
    context = np.searchsorted(starts, order, "right") - 1
    offset = order - starts[context]
    fits = offset + length <= lens[context]
    group = np.cumsum(lcp < length)[fits]
    return context[fits], offset[fits], group, (text - 1).astype(np.uint8)


def found_elsewhere(shards: Iterator[tuple[list[bytes], np.ndarray, np.ndarray, int | None]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For shards (contexts, their documents and positions, gram if it fills several shards): document and position of each window that a smaller document has."""
    waiting, strings, least, now = [], np.zeros(0, f"S{length}"), np.zeros(0, np.int64), None

    def answers():
        for own, sizes, doc, at in waiting:
            found = np.repeat(least[np.searchsorted(strings, own)], sizes) < doc
            yield doc[found], at[found]

    for contexts, docs, lows, gram in shards:
        if gram != now:
            yield from answers()
            waiting, strings, least, now = [], strings[:0], least[:0], gram
        context, offset, group, text = shard_groups(contexts, length)
        if not len(context):
            continue
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(head, len(group)))
        doc, at = docs[context], lows[context] + offset
        lowest = np.minimum.reduceat(doc, head)
        if gram is None:
            found = np.repeat(lowest, sizes) < doc
            yield doc[found], at[found]
            continue
        # sorted distinct strings of the shard, merged with those of the shards before by binary search
        begin = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contexts])[:-1]))[context[head]] + offset[head]
        own = np.ascontiguousarray(text[begin[:, None] + np.arange(length)]).view(f"S{length}").ravel()
        place = np.searchsorted(strings, own)
        same = np.zeros(len(own), bool)
        inside = np.flatnonzero(place < len(strings))
        same[inside] = strings[place[inside]] == own[inside]
        np.minimum.at(least, place[same], lowest[same])
        strings, least = np.insert(strings, place[~same], own[~same]), np.insert(least, place[~same], lowest[~same])
        waiting.append((own, sizes, doc, at))
    yield from answers()


def as_shards(batches, size: int = SHARD) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, int | None]]:
    """Rows (gram, doc, low, context), sorted by gram, cut into shards; a gram's contexts share a shard unless they are more than one holds."""

    def shard(rows, gram):
        return [r[3] for r in rows], np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), gram

    rows, held, begun, at, split = [], 0, None, 0, False
    for b in batches:
        for r in zip(*(b[c].to_pylist() for c in ("gram", "doc", "low", "context"))):
            if r[0] != begun:
                if rows and (split or held >= size):
                    yield shard(rows, begun if split else None)
                    rows, held = [], 0
                begun, at, split = r[0], len(rows), False
            rows.append(r)
            held += len(r[3])
            if held >= 2 * size:
                if at:  # what comes before this gram is whole
                    yield shard(rows[:at], None)
                    rows, at = rows[at:], 0
                    held = sum(len(x[3]) for x in rows)
                if held >= 2 * size:
                    yield shard(rows, begun)
                    rows, held, split = [], 0, True
    if rows:
        yield shard(rows, begun if split else None)


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document and start, those that overlap or touch as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ends so far within a document: an offset for each document keeps them apart
    step = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1]))) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + step)
    new = np.concatenate(([True], (start + step)[1:] > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], start[new], (reach - step)[last]


def compared(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(gram, doc, low, context) -> (doc, start, end): spans of windows that a smaller document has too."""

    def run(batches):
        for doc, at in found_elsewhere(as_shards(batches, shard_bytes), length):
            d, s, e = merged_spans(doc, at, at + length)
            for k in range(0, len(d), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 65536]) for x in (d, s, e)], ["doc", "start", "end"])

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, "doc long, start long, end long")


def repeat_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = SHARD, piece: int = PIECE, most: int = HELD) -> DataFrame:
    """(id, t, spans): each row's id and text, and its merged spans [start, end) of bytes inside `length`-byte strings that start in documents of smaller id too.

    Ids are integers and name one text; rows that repeat an id with its text get the same
    spans. Null and empty texts, and rows with a null id, have no spans and give none to others.
    Texts are shuffled once: both joins with them are by id, over as many partitions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    spark, span = rows.sparkSession, length - GRAM + 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = written(resolved(selected_grams(rows, length, 8 * parts, piece, most), most), "repeat-grams")
    asked = found.where("gram is not null").groupBy("doc").agg(F.collect_set(F.struct("pos", "gram")).alias("asked"))

    def cut_out(batches):
        for b in batches:
            gram, doc, low, context = [], [], [], []
            for i, t, asked in zip(b["id"].to_pylist(), b["t"], b["asked"].to_pylist()):
                text = (t.as_py() or "").encode()
                for x in asked:
                    gram.append(x["gram"])
                    doc.append(i)
                    low.append(max(0, x["pos"] - span + 1))
                    context.append(text[low[-1] : x["pos"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(doc, pa.int64()), pa.array(low, pa.int64()), pa.array(context, pa.binary())], ["gram", "doc", "low", "context"])

    # a null id has no partner in a join; spread, such rows don't meet in one task
    dealt = rows.withColumn("of", F.coalesce("id", F.xxhash64("t"))).repartition(parts, "of")
    contexts = dealt.where("id is not null").join(asked.withColumnRenamed("doc", "of"), "of").select("id", "t", "asked").mapInArrow(cut_out, "gram long, doc long, low long, context binary")
    near = compared(contexts, length, shard_bytes)
    whole = found.where("gram is null").select("doc", F.greatest(F.lit(0), F.col("pos") - (span - 1)).alias("start"), (F.col("pos") + length).alias("end"))
    spans = whole.unionByName(near).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return dealt.join(spans, "of", "left").select("id", "t", F.when(F.col("id").isNotNull(), F.col("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, shard_bytes: int = SHARD, piece: int = PIECE, most: int = HELD) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, spans (array of [start, end)), kept (binary).

    kept may cut a UTF-8 character, as spans are bytes. An empty table gives no rows; further columns are ignored.
    """

    def run(batches):
        for b in batches:
            n_bytes, spans, kept = [], [], []
            for t, s in zip(b["t"], b["spans"].to_pylist()):
                text = (t.as_py() or "").encode()
                got = np.array([(x["start"], min(x["end"], len(text))) for x in s or ()], np.int64).reshape(-1, 2)
                _, start, end = merged_spans(np.zeros(len(got), np.int64), got[:, 0], got[:, 1])
                n_bytes.append(len(text))
                spans.append([{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *end.tolist()], [*start.tolist(), len(text)])))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(n_bytes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    out = repeat_spans(docs, id_col, text_col, length, shard_bytes, piece, most).mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
