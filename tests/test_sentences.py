import random

import pandas as pd
from pyspark.sql import functions as F

from lettera.functions import native as N
from lettera.functions import text as T


def split(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.s for r in rows.select("i", N.sentences(F.col("t")).alias("s")).orderBy("i").collect()]


def test_against_the_two_passes(spark):
    r = random.Random(11)
    pieces = ["g.", "Prof.", "12.", "12345.", "Vārds", "vārds.", "Kā?", "Nē!", "u.c.", "a.b.", "...", "?!", "t.i.", "7"]
    blanks = [" ", " ", " ", "  ", "\n", "\n\n\n", "\t", "\xa0", "\u2003", "", " \x1f"]
    texts = ["".join(r.choice(pieces) + r.choice(blanks) for _ in range(r.randint(0, 12))) for _ in range(2500)]
    texts += [None, "", "   ", ".", "5.", "g.", "5. 6. g.", "A. 5. B.", "\xa0A. B. \xa0", "x\u0085"]
    got = split(spark, texts)
    wrong = [(t, g, T.split_sentences(t)) for t, g in zip(texts, got) if g != T.split_sentences(t)]
    assert not wrong, wrong[:3]


def test_long_texts(spark):
    """Many sentences, one long word, blanks without end: time in proportion to the text."""
    texts = ["Šis ir teikums. " * 60_000, "x" * 1_000_000 + ". A.", "a" + " " * 400_000 + "b. C.", "5. " * 100_000]
    got = split(spark, texts)
    assert [len(g) for g in got] == [60_000, 2, 2, 1] and got[2] == ["a b.", "C."]


def test_all_texts(spark):
    sf = "/root/testdata/sf0.01"
    texts = pd.read_parquet(f"{sf}/documents.parquet").text
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", N.sentences(F.col("text")).alias("s")).orderBy("doc_id").collect()
    assert [r.s for r in rows] == [T.split_sentences(t) for t in texts]
