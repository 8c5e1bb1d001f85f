import duckdb
import pytest

from lettera import queries as Q
from lettera.functions import udfs
from lettera.operators import frontier as R
from lettera.operators import search as S
from lettera.operators import store as K

SF = "/root/testdata/sf0.001"
TABLES = "documents pages conversations events orders lineitem".split()


@pytest.mark.parametrize("name", [n for n in Q.ORACLES if n not in ("old_score", "stem_vocab_counts")])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda found: sorted((tuple(map(str, r)) for r in found))
    assert rows(got.select(names).collect()) == rows(want.select(", ".join(names)).fetchall())


def test_search_groups_and_phrases(spark):
    d = spark.createDataFrame([(1, "ſchodeen laba diena"), (2, "šodien cita lieta"), (3, "diena laba"), (4, "")], "id long, text string")
    d = d.withColumn("fold", udfs.functions()["fold_text"]("text"))
    found = lambda q: {r.id for r in S.search(S.indexed(d, "id", ["text", "fold"]), S.query_groups(q)).collect()}
    assert found("šodien") == {1, 2} and found("schodeen") == {1, 2} and found("laba-diena") == {1} and found("") == set()


def test_search_orders_like_sqlite(spark):
    import sqlite3

    texts = ["a b c", "a a b", "c c c d", "a d", "b b b b a"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x)")
    con.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts, 1))
    want = con.execute("select rowid, bm25(t) from t where t match '\"a\" OR \"d\"' order by bm25(t), rowid").fetchall()
    d = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    got = [tuple(r) for r in S.search(S.indexed(d, "id", ["text"]), [[["a"]], [["d"]]]).collect()]
    assert [g[0] for g in got] == [w[0] for w in want] and all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "id string, text string, seq int")
    new = spark.createDataFrame([("a", "z", 2), ("č", None, 3)], "id string, text string, seq int")
    rows = K.upsert(old, new, "id", "seq")
    assert {(r.id, r.text) for r in rows.collect()} == {("a", "z"), ("b", "y"), ("č", None)}
    K.export_jsonl(rows, str(tmp_path / "out"), "id")
    lines = [line for p in sorted((tmp_path / "out").glob("part*")) for line in p.read_text().splitlines()]
    assert lines[-1] == '{"id":"č","text":null,"seq":3}' and len(lines) == 3


def test_crawl(spark, tmp_path):
    first = R.add_urls(spark.createDataFrame([], R.SCHEMA), spark.createDataFrame([("u0", 0, 0, "", 0)], "url string, depth int, priority int, discovered_from string, seq long"))
    links = {"u0": ["u1", "u2"], "u1": ["u2", "u3"], "u2": ["u0"]}

    def process(active):
        rows = active.collect()
        results = spark.createDataFrame([(r.url, "failed" if r.url == "u3" else "done") for r in rows] or [("", "")], "url string, result string")
        found = [(u, r.url, r.depth + 1, 0, 10 * r.seq + i + 1) for r in rows for i, u in enumerate(links.get(r.url, []))]
        return results, spark.createDataFrame(found, "url string, discovered_from string, depth int, priority int, seq long")

    def keep(frontier, n):
        frontier.write.mode("overwrite").parquet(f"{tmp_path}/{n}")
        return spark.read.parquet(f"{tmp_path}/{n}")

    end = {r.url: (r.state, r.attempts, r.depth) for r in R.crawl(first, process, keep, wave=2, max_depth=2).collect()}
    assert end == {"u0": ("done", 1, 0), "u1": ("done", 1, 1), "u2": ("done", 1, 1), "u3": ("failed", 1, 2)}
    assert R.requeue_active(R.claim(first, 1)).first().state == "pending"


def test_dates_of_whole_texts(spark, tmp_path):
    from lettera.functions import text as T

    rows = [(1, "vārdi " * 100 + "1905. gada 3. maijā"), (2, "1905. gada 3. maijā"), (3, "vārdi"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.date for r in Q.QUERIES["parse_dates_full"](spark, str(tmp_path)).collect()}
    assert got == {i: T.parse_date(t)["date"] for i, t in rows} and got[1] == got[2] == "1905-05-03"


def test_near_words_with_accents_against_brute_force(spark, tmp_path):
    from lettera.functions import text as T

    texts = ["Therefore thērefore, treêtre", "treçre étreretre therefor\u0113 ķēniņš", "there for e", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {"".join(c if c.isalpha() else " " for c in x).lower() for t in texts if t for x in t.split()}
    want = {w: n for x in words for w in x.split() if (n := T.levenshtein(w, "therefore")) <= 4}
    got = {r.word: r.distance for r in Q.QUERIES["levenshtein_near_full"](spark, str(tmp_path)).collect()}
    assert got == want and {"thērefore", "thereforē", "treêtre", "treçre", "étreretre"} <= set(got)


def test_urls_against_the_standard_library(spark):
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    from pyspark.sql import functions as F

    from lettera.operators import urls as U

    def want(u):
        p = urlsplit(u.strip())
        if p.scheme not in ("http", "https"):
            return ""
        host = p.netloc.lower()
        host = host.removesuffix(":80") if p.scheme == "http" else host.removesuffix(":443")
        query = urlencode([(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in U.TRACKING])
        path = p.path
        while "//" in path:
            path = path.replace("//", "/")
        return urlunsplit((p.scheme, host, path or "/", query, p.fragment))

    urls = ["http://a?a&b=%20x", "HTTP://[::1]:80/x", "https://U:p@H.lv:443//a//b?x=1&&y=%zz&=q&UTM_Source=1#panel:p|issue:/1", "http://a/?", "http://a#", " http://a/ā?k=ē*~(1)+%2B\n", "https://a:80/", "ftp://a/b", "a/b", "", "http://a/%41?q=a%3Db;c", "http://a/?gclid=1", "javascript:x"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.normalize_url(F.col("u")).alias("n")).collect()
    assert {r.u: r.n for r in got} == {u: want(u) for u in urls}


def test_templates(spark):
    from pyspark.sql import functions as F

    from lettera.operators import urls as U

    cases = {"http://h:8000/bw1899n01/index": ("cits", "http://h:8000/bw1899n01/index"), "http://h/p_1/alto/00000003.xml?n=4": ("alto", "http://h/p_1/alto/{n:08d}.xml?n=4"), "http://h/0/x": ("cits", "http://h/{n:01d}/x"), "http://h/123456789/12.json": ("json", "http://h/123456789/{n}.json"), "http://127.0.0.1:80": ("cits", "http://127.0.0.1:80"), "http://h/i7/METS.xml": ("mets", "http://h/{issue}/METS.xml"), "http://h/1/2#3": ("cits", "http://h/1/{n}#3")}
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", U.kind(F.col("url")).alias("k"), U.template(F.col("url"), F.lit("i7")).alias("t"))
    assert {r.url: (r.k, r.t) for r in rows.collect()} == cases
    assert [r.kind for r in U.templates(spark.createDataFrame([(u,) for u in cases], "url string")).orderBy("rank", "template").collect()][:3] == ["mets", "alto", "json"]


def test_column_order_is_that_of_documents(spark):
    import random

    from lettera.operators import articles as A
    from lettera.operators.documents import in_columns

    r = random.Random(4)
    pages = [{"id": str(p), "width": r.choice((0, 333, 1000, 1789)), "blocks": [{"id": k, "hpos": r.choice((0, 333, 334, 666, 1000, r.randint(0, 2000))), "vpos": r.randint(0, 3), "width": r.choice((0, 50, 333, 142))} for k in range(r.randint(1, 9))]} for p in range(60)]
    pages.append({"id": "thirds", "width": 1000, "blocks": [{"id": k, "hpos": h, "vpos": 10 * k, "width": 333} for k, h in enumerate((0, 666, 340))]})
    rows = [(p["id"], k, b["id"], b["hpos"], b["vpos"], b["width"], p["width"]) for p in pages for k, b in enumerate(p["blocks"])]
    got = A.column_order(spark.createDataFrame(rows, "page_id string, pos int, block int, hpos int, vpos int, width int, page_width int")).collect()
    order = lambda p: [x.block for x in sorted((x for x in got if x.page_id == p), key=lambda x: x.reading_pos)]
    assert {p["id"]: order(p["id"]) for p in pages} == {p["id"]: [b["id"] for b in in_columns(p)] for p in pages}
    assert order("thirds") == [0, 1, 2]


def test_search_answers_in_json_and_html():
    from lettera.sources import parsers as P

    answer = '{"n": 1, "hits": [{"ID": 1, "Snippet": "s"}, {"href": "/a", "heading": "h", "text": "' + "t" * 500 + '"}, {"link": "/b", "title": "no"}, {"url": "", "id": "x/1", "label": "", "name": "n", "in": {"identifier": 7, "text": 3}}]}'
    got = P.json_hits(answer, "http://s/q")
    assert [(h["url"], h["title"], h["snippet"][:5]) for h in got] == [("", "", ""), ("http://s/a", "", "ttttt"), ("http://s/x/1", "n", ""), ("", "", "3")]
    assert len(got[1]["snippet"]) == 400 and got[0]["ids_in"] == '{"ID": 1, "Snippet": "s"}' and P.json_hits("{") == []
    deep = "[" * 6 + '{"id": 1, "title": "t"}' + "]" * 6
    assert len(P.json_hits(deep)) == 1 and P.json_hits(f"[{deep}]") == []
    assert [(h["url"], h["title"]) for h in P.html_hits("<a href='/i/1'>One <b>x</b></a>", "http://s/")] == [("http://s/i/1", "One x")]


def against_sql(spark, folder, name: str, table: str, columns: str, rows: list[tuple]) -> tuple[list, list]:
    """Rows of a query and of its SQL over a table of these rows."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({columns})")
    con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.execute(f"COPY {table} TO '{folder}/{table}.parquet'")
    want = con.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, str(folder)).select(want.columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


def test_ids_of_documents_with_empty_parts(spark, tmp_path):
    parts = [(t, lang, source) for t in ("a b", "", None, "é" * 70, "|") for lang in ("en", "", None) for source in ("s", "", None)]
    got, want = against_sql(spark, tmp_path, "doc_id_hash", "documents", "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", [(i, *p) for i, p in enumerate(parts)])
    assert got == want


def test_titles_with_references_cut_short(spark, tmp_path):
    titles = ["a &amp", "a &amp; b", "&amp;lt; &lt;b&gt; &quot;", "R&D &#39;x&#39; &copy &eacute;", "&&amp;&&lt", "  x  ", ""]
    pages = [(i, f"<html lang='lv'><head><title>{t}</title></head><body>&amp</body></html>") for i, t in enumerate(titles)]
    got, want = against_sql(spark, tmp_path, "page_title_lang", "pages", "page_id BIGINT, url VARCHAR, html VARCHAR", [(i, "http://x/", h) for i, h in pages])
    assert got == want
