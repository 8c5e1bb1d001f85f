import json
import unicodedata

from lettera.operators.documents import Site, alto_files, assemble_issue, documents, from_response, guess_date, page_order, urls_in_json
from lettera.sources import parsers as P
from lettera.sources.tables import with_format


def alto(number, blocks, language=""):
    rows = "".join(f"<TextBlock ID='{i}' HPOS='{x}' VPOS='{y}' WIDTH='100' HEIGHT='9' {more}><TextLine>{line}</TextLine></TextBlock>" for i, x, y, more, line in blocks)
    return f"<alto>{'<Language>' + language + '</Language>' if language else ''}<Layout><Page ID='P{number}' PHYSICAL_IMG_NR='{number}' WIDTH='210' HEIGHT='300'>{rows}</Page></Layout></alto>".encode()


def words(text):
    return "".join(f"<String CONTENT='{w}' WC='0.5'/>" for w in text.split())


METS = b"""<mets xmlns:xlink='x'><fileSec><fileGrp USE='ALTO'><file ID='A1'><FLocat xlink:href='p1.xml'/></file><file ID='A2'><FLocat xlink:href='p2.xml'/></file></fileGrp><fileGrp USE='IMAGE'><file ID='I1'><FLocat xlink:href='p1.tif'/></file></fileGrp></fileSec>
<structMap TYPE='PHYSICAL'><div TYPE='BOOK'><div TYPE='PAGE' ORDER='7'><fptr><area FILEID='A1'/></fptr></div><div TYPE='PAGE'><fptr><area FILEID='A2'/></fptr></div></div></structMap>
<structMap TYPE='LOGICAL'><div TYPE='ISSUE'><fptr><area FILEID='A1'/></fptr><div TYPE='ARTICLE' ID='D1' LABEL=' Ziema '><fptr><area FILEID='A1' BEGIN='b2' END='b1'/><area FILEID='A2' BEGIN='c1'/></fptr></div><div TYPE='ADVERT' ID='D2'><fptr><area FILEID='A2' BEGIN='none'/></fptr></div></div></structMap></mets>"""
PAGES = {"A1": alto(1, [("b1", 110, 0, "", words("right")), ("b2", 0, 5, "", words("left"))]), "A2": alto(0, [("c1", 0, 0, "", words("after"))])}


def test_alto_halves_language_and_types():
    line = "<String SUBS_TYPE='HypPart1' CONTENT='sa'/><String CONTENT='x'/><String SUBS_TYPE='hyppart2' CONTENT='vu'/><String SUBS_TYPE='HYPPART1' SUBS_CONTENT='kopā' CONTENT='ko'/><String SUBS_TYPE='HypPart2' CONTENT='pā'/><String SUBS_TYPE='HypPart2' CONTENT='alone'/><String CONTENT=''/>"
    page = P.parse_alto(alto(3, [("b", 0, 0, "STYLEREFS='T1'", line)], " lav "))
    assert page["blocks"][0]["text"] == "sa x kopā alone" and page["language"] == "lav" and page["blocks"][0]["type"] == "T1"


def test_issues_are_put_together():
    mets, pages = P.parse_mets(METS), {k: P.parse_alto(v) for k, v in PAGES.items()}
    assert [f["file_id"] for f in alto_files(mets)] == ["A1", "A2"] and page_order(mets) == {"A1": 7, "A2": 3}
    (one,) = assemble_issue(mets, pages)
    assert (one["id"], one["title"], one["text"], one["pages"], one["confidence"]) == ("D1", "Ziema", "right\n\nleft\n\nafter", [1, 3], 0.5)
    assert [a["type"] for a in assemble_issue(mets, pages, ("issue",))] == ["ISSUE"]
    # without articles each page is one, its columns from left to right
    assert [(a["id"], a["text"]) for a in assemble_issue(mets, pages, ("none",))] == [("A1", "left\n\nright"), ("A2", "after")]


def test_documents_of_each_format(spark):
    site = Site("http://x", (r"/(i\d+)/",), page=(r"page=(\d+)",), viewer="{base}/v#{issue}:{n}")
    long = "word " * 60
    rows = [
        ("http://x/i1/mets.xml", METS, ""), ("http://x/i1/p1.xml", PAGES["A1"], ""), ("http://x/i1/p2.xml", PAGES["A2"], ""), ("http://x/i2/a.txt?page=4", "kaut kas ē".encode(), "text/plain"),
        ("http://x/1905-3-4/h", f"<html lang='de'><title>T</title><p>{long}</p><a href='/n'>n</a></html>".encode(), "text/html"), ("http://x/short", b"<html><p>few</p></html>", "text/html"),
        ("http://x/i3/lost.xml", METS.replace(b"p1.xml", b"q1.xml").replace(b"p2.xml", b"q2.xml"), ""), ("http://x/bad.xml", b"<alto><broken", ""), ("http://x/none", None, "text/plain"), (None, b"text", "text/plain"),
        ("http://x/tei", b"<TEI><title>Avize</title><date>1890-01-02</date><body><div xml:id='t1'><head>H</head><p>p</p></div></body></TEI>", ""),
    ]
    table = spark.createDataFrame(rows, "url string, body binary, content_type string")
    got = {(r.source_type, r.url.removeprefix("http://x/"), r.kind): r for r in documents(table, site).collect()}
    assert set(got) == {("mets+alto", "i1/mets.xml", "article"), ("alto", "i1/p1.xml", "page"), ("alto", "i1/p2.xml", "page"), ("text", "i2/a.txt?page=4", "page"), ("html", "1905-3-4/h", "web"), ("mets", "i3/lost.xml", "issue"), ("tei", "tei", "article")}
    article, text, web = got["mets+alto", "i1/mets.xml", "article"], got["text", "i2/a.txt?page=4", "page"], got["html", "1905-3-4/h", "web"]
    assert (article.title, article.issue_id, article.article_id, article.page_number, article.viewer_url) == ("Ziema", "i1", "D1", 1, "http://x/v#i1:1") and json.loads(article.metadata)["pages"] == [1, 3]
    assert (text.page_number, text.text_raw, text.issue_id) == (4, "kaut kas ē", "i2") and (web.language, web.date) == ("de", "1905-03-04") and got["tei", "tei", "article"].date == "1890-01-02"
    assert documents(table.where("false"), site).count() == 0
    assert from_response("http://x/s", b'{"href": "/a/b", "x": "http://y/z"}', "application/json")[1] == ["http://x/a/b", "http://y/z"] == urls_in_json('{"href": "/a/b", "x": "http://y/z"}', "http://x/s")


def test_dates_and_formats_agree(spark):
    assert (guess_date("in 1899", "on 1901/2/3"), guess_date("", "in 1899"), guess_date("x")) == ("1901-02-03", "1899", "")
    bodies = [*PAGES.values(), METS, b"<html>", b"{}", "ā".encode() * 2000, b"<?xml version='1.0'?><x/>", b"<PcGts/>", b"<TEI/>", b"\x00\x01", b" \n\x0b<!DOCTYPE html>", b"", b"<p>" + b" " * 3000 + b"ocr_line", b"<p>" + b" " * 3000 + b"<tei"]
    rows = [(k, b, t) for k, (b, t) in enumerate((b, t) for b in bodies for t in ("", "text/html", "text/plain", "application/json", "Text/HTML; charset=x"))]
    got = with_format(spark.createDataFrame(rows, "url int, body binary, content_type string")).collect()
    assert [(r.url, r.format) for r in got if r.format != P.sniff(bytes(r.body), r.content_type)] == []


def test_native_text_functions_agree_with_python(spark):
    from pyspark.sql import functions as F

    from lettera.functions import native as N
    from lettera.functions import text as T

    texts = ["v a l o d a ir un k a s ef", "a b c d ef g h i j", "Ąę Ő ű й Ёж ǆ ñ", "éā", "Это русский текст и ещё слова", "der und die das und", "un ir ar par no", "Rihgâ wezza sche", "", "123", "мама the"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = rows.select("t", N.deaccent(F.col("t")).alias("plain"), N.clean_ocr(F.col("t")).alias("clean")).collect()
    assert [(r.t, r.plain) for r in got if r.plain != T.deaccent(r.t)] == [] and [(r.t, r.clean) for r in got if unicodedata.is_normalized("NFC", r.t) and r.clean != T.clean_ocr(r.t)] == []
    found = {r.k: {"language": r.language, "confidence": r.confidence} for r in N.languages(rows, "k", "t").collect()}
    assert [(t, found[k]) for k, t in enumerate(texts) if unicodedata.is_normalized("NFC", t) and found[k] != T.detect_language(t)] == []
    scores = {r.k: round(r.old_score, 3) for r in N.old_scores(rows, "k", "t").collect()}
    assert scores == {k: T.looks_old(t) for k, t in enumerate(texts)}
