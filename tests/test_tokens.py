import random

import pyarrow as pa
from pyspark.sql import functions as F

from lettera.functions import native as N
from lettera.functions.tokens import letters_of, tokens_of
from lettera.operators import index as I
from lettera.operators import spellings as Y

ODD = ["", " ", "a", "Rīgā ſchodeen, ǅ ΑΣ Ἀθῆναι", "été ́ x́", "́", "́a", "İstanbul ẛ", "한국어 ½ ² Ⅷ 𝔘𝟙 𐐀", "a\x00b", "__a_b--", "日本 語", "ŉ ß ﬁ", "٣٤x", "á", "z"]


def test_tokens_are_those_of_the_expression(spark):
    r = random.Random(3)
    signs = [*"abc AB.-ſāŅéß̧́İΣ½𝔘日", *map(chr, range(0x80, 0x3000, 37))]
    texts = [*ODD, *("".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(500)), "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", F.lower("t").alias("low"), N.tokens(F.col("t")).alias("want")).orderBy("id").collect()
    letters = letters_of(spark)
    for a, b in ((0, len(rows)), (3, 9), (5, 6), (0, 2), (4, 4)):
        part = pa.array([x.low for x in rows], pa.string()).slice(a, b - a)
        got, n = tokens_of(part, letters)
        assert got.to_pylist() == [t for x in rows[a:b] for t in x.want] and list(n) == [len(x.want) for x in rows[a:b]]


def test_rows_come_in_the_order_of_files(spark):
    docs = spark.createDataFrame([(i, 9 - i % 3, [f"b{i % 4} a a", "ō c"]) for i in range(40)], "id long, block int, texts array<string>").coalesce(1)
    rows = I.term_rows(docs, 3, letters_of(spark)).collect()
    keys = [(r.bucket, r.term, r.block, r.id) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == 40 * 4
    assert {(r.f, r.d, tuple(r.positions)) for r in rows if r.term == "a"} == {(2, 5, (1, 2))} and {tuple(r.positions) for r in rows if r.term == "c"} == {((1 << 32) + 1,)}


def test_postings_are_dealt_by_size_and_terms_are_counted_once(spark, tmp_path, monkeypatch):
    """Tasks follow the characters, however well their rows pack; a vocabulary reads the index's counts, not its postings."""
    monkeypatch.setattr(I, "TASK_CHARS", 100)
    docs = spark.createDataFrame([(i, f"w{i} same same") for i in range(300)], "id long, body string")
    index = I.write_index(docs, str(tmp_path / "i"), "id", ["body"], buckets=2, size=F.lit(10))
    assert sorted(map(tuple, index.terms.where("documents > 1 or term = 'w7'").select("term", "documents", "times").collect())) == [("same", 300, 600), ("w7", 1, 1)]
    terms = Y.write_vocabulary(index, str(tmp_path / "v")).terms
    assert terms.count() == 301 and index.tokens == 900
    plan = index.terms._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "Exchange" not in plan


def test_stems_of_a_text_are_those_of_its_words(spark):
    r = random.Random(6)
    words = ["Rīgas", "iem", "skolas", "tautas", "ĶĒNIŅIEM", "as", "abas", "abcusies", "ΑΣ", "İas", "x", "tas", "grāmatas", "éas", "á"]
    texts = [*ODD, None, *("".join(r.choice(words) + r.choice((" ", ", ", "\n", "-", "1", "'")) for _ in range(r.randint(1, 30))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(N.stems(F.col("t")).alias("got"), F.array_join(F.transform(N.words(F.col("t")), N.stem), " ").alias("want"))
    assert all(x.got == x.want for x in rows.collect()) and rows.where("got <> ''").count() > 300
    # the index of fields asks for their sizes without making them
    from lettera import queries as Q

    fields = Q.with_fields(spark, "/root/testdata/sf0.001")
    plan = fields.agg(F.sum(F.expr(Q.FIELDS_SIZE)))._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "translate" not in plan
