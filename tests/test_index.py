import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lettera.operators import index as I
from lettera.operators import search as S

FIELDS = ["title", "body"]


def make(spark, rows, tmp_path, **more):
    docs = spark.createDataFrame(rows, "id long, title string, body string")
    return docs, I.write_index(docs, str(tmp_path / "index"), "id", FIELDS, **more)


def texts(n=400, seed=1):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(k))
    return [(i, some(r.randint(0, 3)) or None, some(r.choice((0, 1, 5, 20, 200)))) for i in range(n)]


def test_scores_are_sqlites(spark, tmp_path):
    """Phrases, OR-ed groups and counts over two fields, against the ranking of a public full-text engine."""
    rows = texts(300)
    _, index = make(spark, rows, tmp_path)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, body)")
    con.executemany("insert into t(rowid, title, body) values (?, ?, ?)", rows)
    for groups, match in (([[["aa", "bb"]], [["cc"], ["dd", "ee", "ff"]]], '"aa bb" OR ("cc" AND "dd ee ff")'), ([[["gg"], ["hh"]]], '"gg" AND "hh"'), ([[["aa", "aa"]]], '"aa aa"')):
        want = con.execute("select rowid, bm25(t) from t where t match ? order by bm25(t), rowid", (match,)).fetchall()
        got = [tuple(r) for r in I.search(index, groups, None).collect()]
        assert sorted(g[0] for g in got) == sorted(w[0] for w in want) and want
        assert all(abs(dict(want)[i] - s) < 1e-9 for i, s in got)


@pytest.mark.parametrize("groups", [[[["aa"]]], [[["aa"], ["bb"]], [["cc", "dd"]]], [[["ff"]], [["none"]]], [[["none"]]], [[["hh", "hh", "hh"]]]])
def test_top_is_that_of_a_scan(spark, tmp_path, groups, monkeypatch):
    monkeypatch.setattr(I, "FREQUENT", 100)
    docs, index = make(spark, texts(500), tmp_path, buckets=3)
    scan = S.indexed(docs, "id", FIELDS)
    for limit in (1, 3, 20, 1000, None):
        rounded = lambda df: [(r.id, round(r.score, 9)) for r in df.orderBy("score", "id").collect()]
        assert rounded(I.search(index, groups, limit)) == rounded(S.search(scan, groups, limit))


def test_a_query_reads_its_terms_and_blocks(spark, tmp_path):
    rows = [(i, None, "aa " * (1 + i % 7) + "zz " * (i * i % 900)) for i in range(3000)]
    _, index = make(spark, rows, tmp_path)
    found = I.search(index, [[["aa"]]], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (=|IN)", plan) and "EqualTo(term,aa)" in plan and "positions" not in plan.split("ReadSchema")[1]
    read = re.search(r"In\(block, \[([\d,]+)\]", plan)[1].split(",")
    assert len(read) < len(index.bounds(["aa"])) / 2


def test_odd_documents(spark, tmp_path):
    _, index = make(spark, [(1, None, None), (2, "", " .,"), (3, "Rīgā ſchodeen", "x" * 50_000), (4, "a", "b")], tmp_path)
    assert (index.documents, index.tokens) == (4, 5)
    assert [r.id for r in I.search(index, S.query_groups("riga schodeen")).collect()] == [3]
    assert I.search(index, [[["a", "b"]]]).count() == 0 and I.search(index, []).count() == 0  # a phrase does not cross fields
    again = I.open_index(spark, index.at)
    assert again == index


def test_no_documents(spark, tmp_path):
    _, index = make(spark, [], tmp_path)
    assert I.search(index, [[["a"]]]).count() == 0


def test_local_search_falls_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Title", "laba diena", "lv"), (2, "b", "sliktas dienas", "de")], "id long, title string, body string, language string")
    index = I.write_index(docs, str(tmp_path / "i"), "id", FIELDS)
    found = lambda q, **k: [r.id for r in S.local_search(docs, index, q, fallback=("title", "body", "body"), **k).collect()]
    assert found("laba") == [1] and found("liktas") == [2] and found("liktas", language="lv") == [] and found("") == [] and found("nothing") == []


def test_fields_with_the_same_tokens_have_their_places_once(spark, tmp_path):
    """Counts, phrases and scores are those of a scan, however alike the fields are."""
    r = random.Random(4)
    words = [[r.choice("aa bb cc dd".split()) for _ in range(r.choice((0, 1, 9, 60)))] for _ in range(80)]
    rows = [(i, " ".join(w[:3]), " ".join(w), " ".join(w).upper(), " ".join(x if x != "cc" else "c" for x in w), " ".join(["dd", *w]) if i % 3 else None) for i, w in enumerate(words)]
    fields = ["a", "b", "c", "d", "e"]
    docs = spark.createDataFrame(rows, "id long, a string, b string, c string, d string, e string")
    index = I.write_index(docs, str(tmp_path / "i"), "id", fields)
    tokens = {i: [(f or "").lower().split() for f in fs] for i, *fs in rows}
    got = index.postings.select("id", "term", "f", "d", "positions", I.plain_places(F.col("positions")).alias("plain")).collect()
    want = {(i, t): sorted((k << 32) + p for k, f in enumerate(fs) for p, x in enumerate(f) if x == t) for i, fs in tokens.items() for t in set(sum(fs, []))}
    assert {(r.id, r.term): sorted(r.plain) for r in got} == want
    assert all(r.f == len(want[r.id, r.term]) and r.d == sum(map(len, tokens[r.id])) for r in got)
    assert sum(len(r.positions) for r in got) < 0.5 * sum(map(len, want.values()))
    scan = S.indexed(docs, "id", fields)
    rounded = lambda df: [(r.id, round(r.score, 9)) for r in df.orderBy("score", "id").collect()]
    for groups in ([[["aa", "bb"]], [["c"], ["dd", "aa", "bb"]]], [[["cc", "cc"]]], [[["c", "dd"], ["bb"]]]):
        assert rounded(I.search(index, groups, None)) == rounded(S.search(scan, groups, None))
