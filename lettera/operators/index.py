"""The inverted index as tables in a folder, and ranked search that reads them alone.

`postings` has a row for each term of each document: in how many places of all fields it stands (f), how many tokens
all fields of the document have (d), and the places, field * 2^32 + position. Where fields have the same token at the same
position, the first alone has the place, with bit COPIES + k for each further field k, so these count without being there again. It is partitioned by a hash of the term and sorted by term, block and id
within a file, so a query reads its terms' folders and row groups. A block is a class of documents of like length;
`blocks` has for each block of a term that FREQUENT documents have the number of documents, the largest f and the least d, from which a bound of any score
in the block follows; of other terms these are made from their few postings.
`terms` has for each term the number of documents and of places. `whole` has a row: documents and tokens of all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettera.functions.tokens import letters_of, tokens_of

#: Characters for which the index has a folder of terms more; blocks for each doubling of a document's length; documents for which these are split once more; characters whose postings a task sorts.
BUCKET_CHARS, PER_DOUBLING, SPLIT_DOCS, TASK_CHARS = 256 << 20, 6, 20_000_000, 8 << 20
#: Documents from which on a term's blocks are stored; such terms that may still be broadcast (they are counted first).
FREQUENT, BROADCAST_TERMS = 500, 300_000
#: The bit of a place from which on further fields have theirs, and the number of fields up to which these are looked for: 8 bits are left for the field, 32 for the position.
COPIES, MOST_FIELDS = 40, 23
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    at: str
    id_type: str
    buckets: int
    documents: int
    tokens: int

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"term string, block int, id {self.id_type}, f int, d int, positions array<long>, bucket int").parquet(f"{self.at}/postings")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema("term string, block int, n long, most int, least int, bucket int").parquet(f"{self.at}/blocks")

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema("bucket int, term string, documents long, times long").parquet(f"{self.at}/terms")

    def bounds(self, terms: Sequence[str]) -> dict[int, dict[str, tuple[int, int, int]]]:
        """By block and term: documents, the largest f, the least d. A row a block and term reaches the driver."""
        rows = self.of_terms(self.blocks, terms).collect()
        if rare := list(set(terms) - {r.term for r in rows}):
            rows += in_blocks(self.of_terms(self.postings, rare)).collect()
        out: dict[int, dict[str, tuple[int, int, int]]] = {}
        for r in rows:
            out.setdefault(r.block, {})[r.term] = (r.n, r.most, r.least)
        return out

    def of_terms(self, table: DataFrame, terms: Sequence[str]) -> DataFrame:
        """The rows of some terms: their folders, then their row groups."""
        return table.where(F.col("bucket").isin(*{zlib.crc32(t.encode()) % self.buckets for t in terms}) & F.col("term").isin(*terms))


def in_blocks(postings: DataFrame) -> DataFrame:
    return postings.groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max("f").alias("most"), F.min("d").alias("least"))


def copies_of(code: np.ndarray, per_row: np.ndarray, per_field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether no earlier field of its row has it at its position, and a bit for each later field that has."""
    kept, copies = np.ones(len(code), np.bool_), np.zeros(len(code), np.int64)
    if len(per_row) and 1 < per_row.max() <= MOST_FIELDS:
        starts, last = np.cumsum(per_field) - per_field, np.cumsum(per_row)
        for first, end in zip(last - per_row, last):
            for k in range(first + 1, end):
                for j in range(first, k):
                    n = min(per_field[j], per_field[k])
                    a, b = slice(starts[j], starts[j] + n), slice(starts[k], starts[k] + n)
                    same = (code[a] == code[b]) & kept[a] & kept[b]
                    copies[a] |= same.astype(np.int64) << (k - first)
                    kept[b] &= ~same
    return kept, copies


def plain_places(places: Column) -> Column:
    """Places with those of the further fields."""
    further = lambda x: F.filter(F.array(*map(F.lit, range(1, MOST_FIELDS))), lambda k: F.getbit(x, k + COPIES) == 1)
    own = lambda x: x.bitwiseAND(F.lit((1 << COPIES) - 1))
    at = lambda x, k: k.cast("long") * (1 << 32) + x.bitwiseAND(F.lit((1 << 32) - 1))
    return F.flatten(F.transform(places, lambda x: F.when(x < 1 << COPIES, F.array(x)).otherwise(F.concat(F.array(own(x)), F.transform(further(x), lambda k: at(x, k))))))


def term_rows(texts: DataFrame, buckets: int, letters: np.ndarray) -> DataFrame:
    """(id, block, texts: an array of lower-case fields) -> a row for each distinct term of each row, before anything is shuffled.

    A batch's rows come in the order of the index's files, so what is shuffled packs well and a sort of it merges long runs.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.sort_by([("block", "ascending"), ("id", "ascending")])
            per_row = np.asarray(b["texts"].value_lengths()).astype(np.int64)
            tokens, per_field = tokens_of(b["texts"].flatten(), letters)
            if not len(tokens):
                continue
            first = lambda n: np.cumsum(n) - n
            row_of = np.repeat(np.arange(len(per_row), dtype=np.int32), per_row)
            before = ((np.arange(len(per_field)) - first(per_row)[row_of]) << 32) - first(per_field)
            field = np.repeat(np.arange(len(per_field), dtype=np.int32), per_field)
            coded = tokens.dictionary_encode()
            folder = pa.array((np.fromiter(map(zlib.crc32, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint32, len(coded.dictionary)) % buckets).astype(np.int32))
            ranked = pc.sort_indices(pa.table({"bucket": folder, "term": coded.dictionary}), sort_keys=[("bucket", "ascending"), ("term", "ascending")])
            rank = np.empty(len(ranked), np.uint32)
            rank[ranked.to_numpy()] = np.arange(len(ranked), dtype=np.uint32)
            code = coded.indices.to_numpy()
            kept, copies = copies_of(code, per_row, per_field)
            d = np.bincount(row_of, weights=per_field, minlength=len(per_row)).astype(np.int32)
            at = np.flatnonzero(kept)
            code = rank[code[at]]
            # by term, then by row and place, in which the tokens are: sorts of 16 bits are linear
            order = np.argsort(code.astype(np.uint16), kind="stable")
            if len(rank) > 1 << 16:
                order = order[np.argsort((code >> 16).astype(np.uint16)[order], kind="stable")]
            code, order = code[order], at[order]
            field = field[order]
            row = row_of[field]
            starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
            f = np.add.reduceat(1 + np.bitwise_count(copies[order]).astype(np.int64), starts)
            rows, term = row[starts], ranked.take(pa.array(code[starts]))
            places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(before[field] + order + (copies[order] << COPIES)))
            own = lambda c: b[c].take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(term), own("block"), own("id"), pa.array(f.astype(np.int32)), pa.array(d[rows]), places, folder.take(term)], ["term", "block", "id", "f", "d", "positions", "bucket"])

    return texts.mapInArrow(run, f"term string, block int, id {kind}, f int, d int, positions array<long>, bucket int")


def write_index(docs: DataFrame, to: str, id_col: str, fields: Sequence[str], buckets: int | None = None, size: Column | None = None) -> Index:
    """Indexes the fields of docs, 255 at most. Null fields are empty; ids must differ. Texts are tokenised once; what is shuffled is a row for each distinct term of a document.

    Postings are dealt by folder and block, so a term that all documents have is written by as many tasks as there are blocks; tasks are so many that none sorts more than some 100 MB.
    size, the characters of a row's fields, deals rows to blocks and sets the number of folders and tasks, on which no result depends: for fields that cost much to make, the caller may give one that costs less.
    """
    if len(fields) > 255:
        raise ValueError("an index has 255 fields at most")
    spark = docs.sparkSession
    size = (size if size is not None else sum((F.length(F.coalesce(F.col(f), F.lit(""))) for f in fields), F.lit(0))).cast("long")
    chars, n = docs.agg(F.sum(size), F.count("*")).first()
    buckets, splits = buckets or min(4096, 8 + (chars or 0) // BUCKET_CHARS), 1 + n // SPLIT_DOCS
    block = F.floor(PER_DOUBLING * F.log2(1 + size)) * splits + F.pmod(F.xxhash64(id_col), F.lit(splits))
    texts = docs.select(F.col(id_col).alias("id"), block.cast("int").alias("block"), F.array(*(F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields)).alias("texts"))
    rows = term_rows(texts, buckets, letters_of(spark))
    # how often a term stands in a document follows from its places, and is not shuffled
    f = F.size("positions") if len(fields) == 1 else F.aggregate("positions", F.lit(0), lambda n, x: n + 1 + F.bit_count(F.shiftright(x, COPIES)))
    dealt = rows.drop("f").repartition(max(8, 1 + (chars or 0) // TASK_CHARS), "bucket", "block").sortWithinPartitions("bucket", "term", "block", "id")
    dealt = dealt.select("term", "block", "id", f.cast("int").alias("f"), "d", "positions", "bucket")
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(4 << 20))
    try:
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{to}/postings")
    finally:
        spark.conf.set(BATCH, before) if before is not None else spark.conf.unset(BATCH)
    kind = texts.schema["id"].dataType.simpleString()
    made = Index(spark, to, kind, buckets, n, 0)
    made.postings.groupBy("bucket", "term").agg(F.count("*").alias("documents"), F.sum("f").alias("times")).write.parquet(f"{to}/terms")
    frequent = made.terms.where(F.col("documents") >= FREQUENT).select("bucket", "term")
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_TERMS else frequent
    in_blocks(made.postings.join(frequent, ["bucket", "term"], "left_semi")).repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{to}/blocks")
    whole = made.terms.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("tokens")).select(F.lit(buckets).alias("buckets"), F.lit(n).cast("long").alias("documents"), "tokens", F.lit(kind).alias("id_type"))
    whole.coalesce(1).write.parquet(f"{to}/whole")
    return open_index(spark, to)


def open_index(spark: SparkSession, at: str) -> Index:
    r = spark.read.schema("buckets int, documents long, tokens long, id_type string").parquet(f"{at}/whole").first()
    return Index(spark, at, r.id_type, r.buckets, r.documents, r.tokens)


def counted(index: Index, phrases: list[tuple[str, ...]], blocks: Sequence[int] | None = None) -> DataFrame:
    """(id, d, f0, f1, ...): how often each phrase stands in the documents that have a token of any; places are read only where a phrase has several tokens, which must follow each other in a field."""
    tokens = list(dict.fromkeys(t for p in phrases for t in p))
    joined = {t for p in phrases if len(p) > 1 for t in p}
    rows = index.of_terms(index.postings, tokens)
    rows = rows.where(F.col("block").isin(*blocks)) if blocks is not None else rows
    only = lambda t, c: F.when(F.col("term") == t, F.col(c))
    place, name = {t: f"p{k}" for k, t in enumerate(tokens)}, {t: f"t{k}" for k, t in enumerate(tokens)}
    found = rows.groupBy("id").agg(F.max("d").alias("d"), *(F.coalesce(F.max(only(t, "f")), F.lit(0)).alias(name[t]) for t in tokens), *(F.first(only(t, "positions"), ignorenulls=True).alias(place[t]) for t in tokens if t in joined))

    def times(p: tuple[str, ...]) -> Column:
        if len(p) == 1:
            return F.col(name[p[0]])
        back = lambda c, k: F.transform(c, lambda x: x - k)
        places = lambda t: plain_places(F.col(place[t]))
        starts = places(p[0])
        for k, t in enumerate(p[1:], 1):
            starts = F.array_intersect(starts, back(places(t), k))
        return F.coalesce(F.nullif(F.size(starts), F.lit(-1)), F.lit(0))

    return found.select("id", "d", *(times(p).alias(f"f{k}") for k, p in enumerate(phrases)))


def search(index: Index, groups: list[list[list[str]]], limit: int | None = 20) -> DataFrame:
    """(id, score): documents that match all phrases of a group, best (lowest) score first, ties by id.

    A document's score sums over the phrases of the groups that it matches. With a limit, blocks are looked at in order of the best
    score that they can have: the first give a k-th score, and of the rest only those whose bound reaches it are read. The driver gets a row a block and token,
    of which the lengths of documents allow some hundreds, and `limit` scores a round.
    """
    phrases = list(dict.fromkeys(tuple(p) for g in groups for p in g))
    if not phrases or any(not p for p in phrases):
        return index.postings.select("id", F.lit(0.0).alias("score")).limit(0)
    wanted = [[phrases.index(tuple(p)) for p in g] for g in groups]
    bounds = index.bounds(list({t for p in phrases for t in p}))
    held = [sum(b.get(p[0], (0,))[0] for b in bounds.values()) for p in phrases]
    if long := [k for k, p in enumerate(phrases) if len(p) > 1]:
        # a phrase's documents are known only from its places
        n = counted(index, [phrases[k] for k in long]).agg(*(F.count_if(F.col(f"f{i}") > 0) for i in range(len(long)))).first()
        for i, k in enumerate(long):
            held[k] = n[i]
    idf = [max(math.log((index.documents - n + 0.5) / (n + 0.5)), 1e-6) for n in held]
    mean = index.tokens / max(index.documents, 1)

    def best(block: dict[str, tuple[int, int, int]]) -> float | None:
        """A bound of scores in a block; None if no group can match."""
        weights = []
        for i, p in zip(idf, phrases):
            has = [block.get(t) for t in p]
            f, d = (min(h[1] for h in has), max(h[2] for h in has)) if all(has) else (0, 0)
            weights.append(i * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)) if f else 0.0)
        able = [sum(weights[k] for k in g) for g in wanted if all(weights[k] for k in g)]
        return -sum(able) * (1 + 1e-9) if able else None

    def scored(blocks: Sequence[int] | None) -> DataFrame:
        def weight(k):
            f = F.col(f"f{k}")
            return -F.lit(idf[k]) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("d") / mean))

        hit, score = F.lit(False), F.lit(0.0)
        for g in wanted:
            m = F.lit(True)
            for k in g:
                m = m & (F.col(f"f{k}") > 0)
            hit, score = hit | m, score + F.when(m, sum((weight(k) for k in g), F.lit(0.0))).otherwise(0.0)
        return counted(index, phrases, blocks).where(hit).select("id", score.alias("score"))

    able = sorted((b, k) for k, x in bounds.items() if (b := best(x)) is not None)
    if limit is None:
        return scored(None if len(able) == len(bounds) else [k for _, k in able])
    taken = max(1, len(able) // 8)
    while taken < len(able):
        top = scored([k for _, k in able[:taken]]).orderBy("score").limit(limit).collect()
        needed = len(able) if len(top) < limit else sum(b <= top[-1].score for b, _ in able)
        if needed <= taken:
            break
        taken = needed if len(top) == limit else min(len(able), 4 * taken)
        if len(top) == limit:
            break
    return scored([k for _, k in able[:taken]]).orderBy("score", "id").limit(limit)
