"""Token-id files: each document's ids compressed alone under one shared zstandard dictionary.

A file set is a folder with two tables. `dictionary` has one row: the dictionary,
its SHA-256 and the width of an id in bytes. `blocks` has rows of (shard, block, start, n_tokens, first_id,
last_id, dictionary_sha256, ids, offsets, counts, frames): the documents of a
block in ascending order, each one zstandard frame at its offset, so that a short document
is read by itself.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from .common import read_table, shared_path

CACHE, BLOCK_BYTES, LEVEL = 1_000_000, 4 << 20, 3
#: Texts are looked through in runs of about so many characters.
RUN_CHARS = 1 << 20
#: Words of printable ASCII and Latin-1 letters: of these the pre-tokens are known from a pattern, the file's own for such characters.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
SPECIAL = "<|"


def worker_cache(name: str, make):
    """What make() returns, kept from task to task of a Python worker."""
    held = sys.modules.setdefault("_lettera_worker", types.ModuleType("_lettera_worker"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


class WordEncoder:
    """Encodes texts word by word with a memory of words and of their pieces.

    The tokenizer drops white space and no token crosses it, so the ids of a text
    are those of its ASCII-blank-separated words in turn; other white space stays inside a word and is left to the library.
    A plain word is lower-cased and cut into pre-tokens here, and pre-tokens not met before are
    encoded together by the library's byte-pair model; any other word goes through the whole of the library's tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Remembers words not met before."""
        plain: dict[bytes, list[str]] = {}
        for w in words:
            t = w.decode()
            if PLAIN.fullmatch(t) and SPECIAL not in t:
                plain[w] = PIECE.findall(t.lower())
            else:
                self.known[w] = self.ids(t)
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        fresh = list(set().union(*plain.values()).difference(self.pieces))
        for at in range(0, len(fresh), 1000):
            some = fresh[at : at + 1000]
            ids = np.array(self.model.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width  # a pre-token's last token alone ends a word
            if len(ends) != len(some):
                raise ValueError("tokens do not tell where a word ends")
            raw = ids.astype(f"<u{self.width}").tobytes()
            self.pieces.update((p, raw[x:y]) for p, x, y in zip(some, [0, *ends[:-1].tolist()], ends.tolist()))
        of = self.pieces.__getitem__
        self.known.update((w, of(p[0]) if len(p) == 1 else b"".join(map(of, p))) for w, p in plain.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian integers of self.width bytes."""
        out, at = [], 0
        while at < len(texts):
            run, chars = [], 0
            while at < len(texts) and chars < RUN_CHARS:
                run.append((texts[at] or "").encode().split())
                chars, at = chars + len(texts[at] or ""), at + 1
            if len(self.known) > CACHE:
                self.known.clear()
            self.learn(set().union(*run).difference(self.known))
            out += [b"".join(map(self.known.__getitem__, words)) for words in run]
        return out


def train_dictionary(docs: DataFrame, path: str, sample: int, size: int) -> bytes:
    """A zstandard dictionary from the ids of at most `sample` documents, of least hash; empty if they are too few.

    Only rows under a hash that some two times `sample` rows have are looked at, so tasks send few whole texts.
    """
    share = F.lit(min(1.0, 2 * sample / max(docs.count(), 1)) * (1 << 32))
    rows = docs.where(F.crc32(F.concat(F.lit("sample"), F.coalesce(F.col("id").cast("string"), F.lit("")))) < share).select("id", "t").orderBy(F.xxhash64("id"), "id", "t").limit(sample)
    found = WordEncoder(path).encode([r.t for r in rows.select("t").collect()])
    try:
        return zstandard.train_dictionary(size, [x for x in found if x]).as_bytes()
    except zstandard.ZstdError:
        return b""


def compression(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_tokens(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, sample: int = 1000, dictionary_bytes: int = 64 << 10) -> None:
    """Writes the ids of every row of docs, each document ended by end_id, in ascending id order.

    Null and empty texts have the end id alone. Null ids come first; repeated ids are
    documents of their own, in the order of their texts. An empty table gives a file set without blocks.
    Rows are dealt by ranges of ids and sorted within a range; a task holds one block at a time.
    """
    spark, path = docs.sparkSession, path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    dictionary = train_dictionary(rows, path, sample, dictionary_bytes)
    sha, width = hashlib.sha256(dictionary).hexdigest(), WordEncoder(path).width
    spark.createDataFrame([(sha, bytearray(dictionary), width)], "dictionary_sha256 string, dictionary binary, width int").coalesce(1).write.parquet(f"{to}/dictionary")
    kind = rows.schema["id"].dataType

    def run(batches):
        encoder = worker_cache(f"encoder {path}", lambda: WordEncoder(path))
        compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **compression(dictionary)).compress
        end = np.array([end_id], f"<u{width}").tobytes()
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, offsets, frames, held = [], [], [], [], 0

        def row(id_type):
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "start": start, "n_tokens": sum(counts), "first_id": ids[0], "last_id": ids[-1], "dictionary_sha256": sha, "ids": ids, "offsets": offsets, "counts": counts, "frames": b"".join(frames)}],
                pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("first_id", id_type), ("last_id", id_type), ("dictionary_sha256", pa.string()), ("ids", pa.list_(id_type)), ("offsets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("frames", pa.binary())]),
            )

        id_type = pa.int64()
        for b in batches:
            id_type = b.schema.field("id").type
            for i, raw in zip(b["id"].to_pylist(), encoder.encode(b["t"].to_pylist())):
                raw += end
                ids.append(i)
                counts.append(len(raw) // width)
                offsets.append(held)
                frames.append(compress(raw))
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield row(id_type)
                    start, block = start + sum(counts), block + 1
                    ids, counts, offsets, frames, held = [], [], [], [], 0
        if ids:
            yield row(id_type)

    i = kind.simpleString()
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "t")
    ordered.mapInArrow(run, f"shard int, block int, start long, n_tokens long, first_id {i}, last_id {i}, dictionary_sha256 string, ids array<{i}>, offsets array<long>, counts array<long>, frames binary").write.parquet(f"{to}/blocks")


def open_dictionary(spark: SparkSession, at: str) -> tuple[bytes, int]:
    r = spark.read.parquet(f"{at}/dictionary").first()
    data = bytes(r.dictionary)
    if hashlib.sha256(data).hexdigest() != r.dictionary_sha256:
        raise ValueError(f"the dictionary of {at} doesn't match its hash")
    return data, r.width


def read_tokens(spark: SparkSession, at: str, digest: bool = False) -> DataFrame:
    """(id, start, n_tokens) and tokens array<long>, or with digest the CRC-32 of the ids as unsigned 32-bit integers.

    start is the number of ids of all documents before. A block whose dictionary hash is not that of the
    folder's dictionary, or a frame whose ids are not as many as indexed, raises an error.
    """
    dictionary, width = open_dictionary(spark, at)
    sha = hashlib.sha256(dictionary).hexdigest()
    blocks = spark.read.parquet(f"{at}/blocks")
    kind = blocks.schema["first_id"].dataType.simpleString()
    base, before = [], 0
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # a row for each task that wrote
        base.append((r.shard, before))
        before += r.n
    bases = dict(base)
    value = pa.int64() if digest else pa.list_(pa.int64())

    def run(batches):
        decompress = zstandard.ZstdDecompressor(**compression(dictionary)).decompress
        for b in batches:
            for r in b.to_pylist():
                if r["dictionary_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                view, start, starts, out = memoryview(r["frames"]), r["start"] + bases[r["shard"]], [], []
                for a, z, n in zip(r["offsets"], [*r["offsets"][1:], len(view)], r["counts"]):
                    got = np.frombuffer(decompress(view[a:z]), f"<u{width}")
                    if len(got) != n:
                        raise ValueError("a frame doesn't hold as many ids as its index says")
                    starts.append(start)
                    start += n
                    out.append(zlib.crc32(got.astype("<u4").tobytes()) if digest else got.tolist())
                id_type = b.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], id_type), pa.array(starts, pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(out, value)], ["id", "start", "n_tokens", "value"])

    found = blocks.select("shard", "start", "dictionary_sha256", "ids", "offsets", "counts", "frames").mapInArrow(run, f"id {kind}, start long, n_tokens long, value {'long' if digest else 'array<long>'}")
    return found.withColumnRenamed("value", "ids_crc32" if digest else "tokens")


def read_document(spark: SparkSession, at: str, doc_id) -> list[list[int]]:
    """The ids of each document of that id; only its own frames are decompressed."""
    dictionary, width = open_dictionary(spark, at)
    rows = spark.read.parquet(f"{at}/blocks").where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).where(F.array_contains("ids", doc_id))
    hits = rows.select(F.explode(F.arrays_zip("ids", "offsets", F.slice(F.concat("offsets", F.array(F.length("frames").cast("long"))), 2, F.size("offsets")).alias("ends"))).alias("x"), "frames").where(F.col("x.ids") == doc_id)
    decompress = zstandard.ZstdDecompressor(**compression(dictionary)).decompress
    return [np.frombuffer(decompress(bytes(r.f)), f"<u{width}").tolist() for r in hits.select(F.expr("substring(frames, cast(x.offsets as int) + 1, cast(x.ends - x.offsets as int))").alias("f")).collect()]


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_path(spark, "token-files")
    write_tokens(read_table(spark, sf_dir, "documents"), at)
    return read_tokens(spark, at, digest=True).withColumnRenamed("id", "doc_id")
