import random

import pytest
from pyspark.sql import functions as F

from lettera.functions import native as N
from lettera.functions import text as T
from lettera.functions import udfs
from lettera.operators import correction as C

LINES = ["# words", "", "Sabeedriba", "latweeschu", "sinas", "māja", "mahja", "diena", "ķēniņš", "raksti", "skola", "tauta", "zeme", "nams", "nauda", "kalns", "balss"]
TEXTS = ["Sabeebriba uu lalweeschu fiuas. Mājā, bieua Dienā tanta!", "ķēuiņš raxsti skoia Zeme zerne nanis", None, "", "Rihga Rīgā Kihga 12 uz xx", "MĀJA tauta tauta Iauta", "qqqq " * 70 + " ".join("".join(random.Random(k).choices("abcdexyz", k=5)) for k in range(60))]


@pytest.fixture(scope="module")
def lexicons(spark):
    own = T.Lexicon.from_lines(LINES)
    for p in T.PLACES:
        for x in T.place_variants(p):
            own.add(x)
    return own, C.lexicon(spark.createDataFrame([(x,) for x in LINES], "word string"))


@pytest.mark.parametrize("edits, broadcast", [(1, True), (2, True), (1, False)])
def test_corrections_against_one_word_at_a_time(spark, lexicons, edits, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(C, "BROADCAST_KEYS", 3)
    own, table = lexicons
    words = sorted({w for t in TEXTS for w in T.WORD.findall(t or "")})
    got = C.corrections(spark.createDataFrame([(w,) for w in [*words, *words]] + [(None,)], "word string"), table, edits=edits).collect()
    unknown = [w for w in words if len(w) >= 3 and not own.matches(w)]
    assert sorted(r.word for r in got) == unknown and len(unknown) > 10
    assert {r.word: (r.corrected, r.alternatives) for r in got} == {w: T.correct_word(w, own, edits=edits) for w in unknown}
    assert {r.word: r.options for r in got} == {w: [c for c in T.confusable(w, edits=edits) if own.matches(c)][:5] for w in unknown}
    assert sum(r.corrected != r.word for r in got) >= 4


def test_texts_against_one_at_a_time(spark, lexicons):
    own, table = lexicons
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for r in C.correct_texts(docs, table).collect():
        want = T.correct_text(TEXTS[r.id], own)
        assert (r.text, [c.asDict() for c in r.corrections], r.unresolved) == (want["text"], want["corrections"], want["unresolved"])
        assert [s.asDict() for s in r.suspicious] == T.suspicious_words(TEXTS[r.id], own)


def test_postprocess(spark, lexicons):
    own, table = lexicons
    docs = spark.createDataFrame([(1, TEXTS[0]), (2, "")], "id long, text string")
    got = {r.id: r for r in C.postprocess(docs, table, udfs.functions()["analyze_article"]).collect()}
    want = T.correct_text(TEXTS[0], own)
    assert got[1].n_corrections == len(want["corrections"]) and got[1].text_raw == T.clean_ocr(want["text"]) and got[2].language == "unknown"
    assert C.postprocess(docs, table, udfs.functions()["analyze_article"], correct=False).where("id = 1").first().text_raw == T.clean_ocr(TEXTS[0])


def test_keys_of_all_words_at_once():
    r = random.Random(4)
    forms = [w for t in TEXTS for w in T.WORD.findall(t or "")] + ["Schwarzeneeh", "nejaukkas", "ĶĒŅIŅŠ", "Attahlinah", "zzz", "ppaa"] + ["".join(r.choices(C.PLAIN[:60] + "eehhwzsschttkkāšņ", k=r.randint(1, 9))) for _ in range(3000)]
    plain = [f for f in forms if C.OF_PLAIN.fullmatch(f)]
    assert len(plain) > 2500 and not C.OF_PLAIN.search("ßſẞİŉ1 \n")
    columns = C.keys_of_plain(plain)
    for i, f in enumerate(plain):
        assert {(k, keys[i]) for k, keys in columns} == set(C.word_keys(f)), f


@pytest.mark.parametrize("most", [27, 3])
def test_filter_lets_every_key_pass(spark, lexicons, most, monkeypatch):
    """Forms without a key of the lexicon are not handed on; a filter that is far too small refuses nothing that is known."""
    own, table = lexicons
    monkeypatch.setattr(C, "MOST_BITS", most)
    may = C.key_filter(table)
    assert all(may.passes(r.kind, [r.key])[0] for r in table.collect()) and not may.digits
    words = spark.createDataFrame([(w,) for t in TEXTS for w in T.WORD.findall(t or "")], "word string").distinct()
    forms = C.with_keys(words, table, ("common", "fraktur"), 1)
    made = sum(len(T.confusable(r.word)) for r in words.collect())
    assert C.known(forms, table).count() == sum(own.matches(f) for r in words.collect() for f in T.confusable(r.word))
    assert most < 27 or forms.count() < made / 4


def test_texts_are_read_once_for_words(spark):
    """The lexicon of frequent words comes from the counts, and is that of the texts in lower case."""
    from lettera import queries as Q

    sf = "/root/testdata/sf0.001"
    low = Q.table(spark, sf, "documents").select(F.explode(N.words(F.lower("text"))).alias("word")).groupBy("word").count().where("count >= 20")
    lex = Q.common_words(spark, sf)
    assert {tuple(r) for r in lex.collect()} == {tuple(r) for r in C.lexicon(low).collect()} and "documents" not in Q.word_counts(spark, sf)._jdf.queryExecution().executedPlan().toString()
