"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A
word's likelihood is the sum over all ways to cut it into pieces, by a forward
algorithm in log space; a text's is the product over its words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, small_or_not

WORD = re.compile(r"[^\W\d_]+")
CACHE, SMOOTHING = 300_000, 0.1
#: In words of more characters, with their mark, products of probabilities could become zero.
LONG = 32


def words_of(text: str | None) -> list[str]:
    """Runs of word characters that hold a letter, in lower case; signs such as ½ alone are no word."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the mark of a word's start, by their ids; single characters outside share one id."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i).lower()
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and p and WORD.fullmatch(p.removeprefix("▁") or "a"):
            pieces.setdefault(p, len(pieces))
    return pieces


def edges(word: str, pieces: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(start, end, piece) of every piece in the word with its mark; a single character always is one."""
    w, unknown, out = "▁" + word, len(pieces), []
    for i in range(len(w)):
        out.append((i, i + 1, pieces.get(w[i], unknown)))
        out += [(i, j, p) for j in range(i + 2, min(len(w), i + longest) + 1) if (p := pieces.get(w[i:j])) is not None]
    return out


def forward_one(word: str, pieces: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """Log likelihoods of a word of any length, one a language; sums are scaled at each position, so they cannot vanish."""
    w, n, unknown = "▁" + word, len(word) + 1, len(pieces)
    ahead = np.zeros((longest + 1, probs.shape[1]))
    ahead[0] = 1.0
    total = np.zeros(probs.shape[1])
    for i in range(n):
        for c in range(1, min(longest, n - i) + 1):
            p = pieces.get(w[i : i + c], unknown if c == 1 else -1)
            if p >= 0:
                ahead[c] += ahead[0] * probs[p]
        ahead = np.roll(ahead, -1, axis=0)
        ahead[-1] = 0.0
        scale = ahead[0].copy()
        total += np.log(scale)
        ahead /= scale
    return total


def forward(words: list[str], pieces: dict[str, int], longest: int, probs: np.ndarray) -> np.ndarray:
    """(words, languages): log of the sum over all segmentations; words of equal length go through the lattice together."""
    out = np.empty((len(words), probs.shape[1]))
    table = np.vstack([probs, np.zeros(probs.shape[1])])  # the last row: no such piece
    unknown, none, by_length = len(pieces), len(pieces) + 1, {}
    for k, w in enumerate(words):
        by_length.setdefault(len(w), []).append(k)
    for length, where in by_length.items():
        if length > 32:
            for k in where:
                out[k] = forward_one(words[k], pieces, longest, probs)
            continue
        n, marked = length + 1, ["▁" + words[k] for k in where]
        ahead = np.zeros((n + 1, len(where), probs.shape[1]))
        ahead[0] = 1.0
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                other = unknown if j == i + 1 else none
                ahead[j] += ahead[i] * table[[pieces.get(w[i:j], other) for w in marked]]
        out[where] = np.log(ahead[n])
    return out


def piece_counts(e: list[tuple[int, int, int]], m: int, prob: np.ndarray) -> list[tuple[int, float]]:
    """(piece, its expected count in all segmentations) of each edge of a word of m characters; sums of long words are in log space, so they cannot vanish."""
    if m <= LONG:
        ahead, back = np.zeros(m + 1), np.zeros(m + 1)
        ahead[0] = back[m] = 1.0
        for i, j, p in e:
            ahead[j] += ahead[i] * prob[p]
        for i, j, p in reversed(e):
            back[i] += back[j] * prob[p]
        return [(p, ahead[i] * prob[p] * back[j] / ahead[m]) for i, j, p in e]
    ahead, back = np.full(m + 1, -np.inf), np.full(m + 1, -np.inf)
    ahead[0] = back[m] = 0.0
    logs = np.log(prob)
    for i, j, p in e:
        ahead[j] = np.logaddexp(ahead[j], ahead[i] + logs[p])
    for i, j, p in reversed(e):
        back[i] = np.logaddexp(back[i], back[j] + logs[p])
    return [(p, np.exp(ahead[i] + logs[p] + back[j] - ahead[m])) for i, j, p in e]


def fit(rows: list[tuple[str, str]], pieces: dict[str, int], rounds: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages in order, and (pieces + 1, languages) probabilities, by expectation maximisation from equal piece weights in all segmentations.

    Words count once for each document they are in, so one long text does not make a language.
    """
    langs = sorted({lang for _, lang in rows})
    longest = max(map(len, pieces), default=1)
    words = {lang: Counter() for lang in langs}
    for text, lang in rows:
        words[lang].update(set(words_of(text)))
    size = len(pieces) + 1
    probs = np.zeros((size, len(langs)))
    for a, lang in enumerate(langs):
        prob = np.full(size, 1.0 / size)
        for _ in range(rounds):
            counts = np.zeros(size)
            for word, n in words[lang].items():
                for p, x in piece_counts(edges(word, pieces, longest), len(word) + 1, prob):
                    counts[p] += n * x
            prob = (counts + SMOOTHING) / (counts.sum() + SMOOTHING * size)
        probs[:, a] = prob
    return langs, probs


def training_rows(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """About per_language texts of each language (all, if it has fewer), chosen by a hash of their id, from documents outside the held-out quarter."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    share = checkpointed(known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")))
    chosen = known.join(small_or_not(share), "lang").where(F.crc32(F.concat(F.lit("train"), F.col("doc_id").cast("string"))) < F.col("share") * F.lit(float(1 << 32)))
    return sorted((r.text, r.lang) for r in chosen.select("text", "lang").collect())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_language: int = 400, path: str | None = None) -> DataFrame:
    """(id_col, lang_pred, score): one row per row of docs, from its text alone.

    score is the posterior probability of lang_pred, with equal priors, on a log
    likelihood averaged over the square root of the number of words. Null texts and texts without a
    letter are `und` with score 0, as are all texts if no language can be learned. On a tie
    the first language in order wins. Repeated rows get equal results; further columns are ignored.
    """
    pieces = vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))
    langs, probs = fit(training_rows(docs, per_language), pieces)
    longest = max(map(len, pieces))
    shared = docs.sparkSession.sparkContext.broadcast((pieces, langs, probs))  # the vocabulary's size times the number of languages

    def run(batches):
        pieces, langs, probs = shared.value
        row_of, rows = {}, np.zeros((1024, len(langs)))
        for b in batches:
            counts = [Counter(words_of(x.as_py())) for x in b["t"]]
            if len(row_of) > CACHE:
                row_of = {}
            fresh = list(set().union(*counts).difference(row_of)) if counts and langs else []
            if len(row_of) + len(fresh) > len(rows):  # grows by doubling
                rows = np.vstack([rows[: len(row_of)], np.zeros((len(row_of) + 2 * len(fresh), len(langs)))])
            if fresh:
                rows[len(row_of) : len(row_of) + len(fresh)] = forward(fresh, pieces, longest, probs)
            row_of.update(zip(fresh, range(len(row_of), len(row_of) + len(fresh))))
            pred, score = [], []
            for c in counts:
                if not c or not langs:
                    pred.append("und")
                    score.append(0.0)
                    continue
                n = np.fromiter(c.values(), np.float64, len(c))
                like = n @ rows[np.fromiter(map(row_of.__getitem__, c), np.int64, len(c))] / np.sqrt(n.sum())
                post = np.exp(like - like.max())
                pred.append(langs[int(like.argmax())])
                score.append(float(post.max() / post.sum()))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
