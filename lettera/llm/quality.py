"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A word feature is the word lower-cased, or with its letters and digits mapped to
classes, so that words never met before still carry their form; bigrams are
of the classes' hashes. A document is scored by one sparse dot product.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BITS, CACHE = 18, 300_000
SIZE = (1 << BITS) + 34
#: Letters, digits and other bytes of a word, by class; runs are squeezed.
RUN = re.compile(rb"(.)\1+", re.S)
SHAPES = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


class Memo(dict):
    """Values of a function by its argument, kept until there are too many."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key):
        if len(self) > CACHE:
            self.clear()
        self[key] = value = self.of(key)
        return value


class Hashes:
    """Hashes of the words of a text in lower case, of their shapes with runs squeezed, and of their last two bytes. Shapes and ends are few, and remembered."""

    def __init__(self):
        self.shapes, self.ends = Memo(lambda s: zlib.crc32(b"\0" + RUN.sub(rb"\1", s))), Memo(lambda e: zlib.crc32(b"\1" + e))

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = text.split()
        n = len(words)
        word = np.fromiter(map(zlib.crc32, text.lower().split()), np.uint64, n)
        shape = np.fromiter(map(self.shapes.__getitem__, text.translate(SHAPES).split()), np.uint64, n)
        return word, shape, np.fromiter(map(self.ends.__getitem__, [w[-2:] for w in words]), np.uint64, n)


def features(text: str | None, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of a whole text and their values, of Euclidean length 1. Index 0 is the constant."""
    word, shape, end = hashes((text or "").encode())
    pair = lambda a, salt: (a[:-1] * np.uint64(0x9E3779B1) + a[1:] * np.uint64(0x85EBCA77) + np.uint64(salt)) >> np.uint64(7)
    groups = [word, shape, end, pair(word, 1), pair(shape, 2)]
    where, value = [np.zeros(1, np.int64)], [np.array([1.0])]
    for g in groups:
        if len(g):
            index, n = np.unique((g % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1, return_counts=True)
            v = n / len(g)
            where.append(index)
            value.append(v / np.sqrt((v * v).sum()))
    # n-grams told apart only by whether the text had them before: shares of words like the last one, of words, and of bigrams met again
    n, last = max(len(word), 1), 1 << BITS
    again = [(word[1:] == word[:-1]).sum() / n, 1 - len(where[1]) / n if len(word) else 0, 1 - len(where[4]) / n if len(word) > 1 else 0]
    index = np.concatenate([*where, [last], [last + 1 + 11 * i + int(10 * x) for i, x in enumerate(again)]])
    return index.astype(np.int64), np.concatenate([*value, [min(np.log1p(n), 16) / 16, 1.0, 1.0, 1.0]])


class Ftrl:
    """FTRL-proximal for logistic loss: per-coordinate rates, L1 and L2."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int) -> float:
        w = self.weights(index)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        sigma = (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] += g * g
        return p


def train(rows: list[tuple[str | None, int]], epochs: int = 3) -> np.ndarray:
    """Dense weights; rows in the order given, in each epoch."""
    model, hashes = Ftrl(SIZE), Hashes()
    ready = [(*features(t, hashes), y) for t, y in rows]
    for _ in range(epochs):
        for index, value, y in ready:
            model.update(index, value, y)
    return model.weights(np.arange(SIZE)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most: int) -> list[tuple[str | None, int]]:
    """At most `most` labelled rows outside the held-out fifth, by the hash of their id, so alike at every size.

    Which rows are taken depends on ids alone; a text is read once. The order of training is that of the hash. Of an id with
    several texts the least in order is taken.
    """
    known = labels.where(F.col(label_col).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id")
    return [(r.text, int(r.y)) for r in found.select("text", "y").collect()]


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row per row of docs; null and empty texts are scored on the constant alone."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # 2^18 floats: 1 MB at any size of the corpus

    def run(batches):
        w, hashes = shared.value, Hashes()
        for b in batches:
            out = []
            for t in b["t"]:
                index, value = features(t.as_py(), hashes)
                out.append(1 / (1 + np.exp(-float(w[index] @ value))))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = 6000, epochs: int = 3) -> DataFrame:
    """(doc_id, score) for every row of docs, by a classifier fitted to at most max_train labelled rows.

    The score of a row comes from its text alone. Repeated rows get equal scores;
    of clashing labels of an id the larger counts; null labels and labels without
    a document are left out. Without labels every score is 0.5. Further columns are ignored.
    """
    return score(docs, train(training_rows(docs, labels, label_col, max_train), epochs)).withColumnRenamed("id", "doc_id")


THRESHOLD = 0.3


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows scored below threshold; columns as they were.

    The classifier is fitted to labelled rows of docs; texts are scored in the scan, nothing is joined. Each row is judged by its text alone:
    rows that repeat an id may fare differently, null and empty texts are scored on the constant, and an empty table gives no rows.
    """
    weights = train(training_rows(docs, labels, "quality", 6000))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, hashes = shared.value, Hashes()
        for b in batches:
            good = []
            for t in b["text"]:
                index, value = features(t.as_py(), hashes)
                good.append(1 / (1 + np.exp(-float(w[index] @ value))) >= threshold)
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
