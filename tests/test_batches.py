"""What keeps the cost of a row and the memory of a worker small, with the results unchanged."""

import re

import pytest

from lettera.functions import text as T
from lettera.functions.batches import BATCH, in_small_batches
from lettera.operators import documents as D
from lettera.operators.documents import documents, issue_documents
from lettera.sources import parsers as P

from test_documents import METS, PAGES, alto, words

HOCR = b"<html><div class='ocr_page' title='bbox 0 0 9 8; ppageno 3'><span class='ocr_line' id='l1' title='bbox 1 2 5 6'><span class='ocrx_word' title='bbox 1 2 3 4; x_wconf 50'>a</span></span><span class='ocr_line' id='l2'>b <b>c</b></span></div></html>"
PAGE = b"<PcGts><Page imageFilename='p7.png' imageWidth='9'><TextRegion id='r' type='t'><Coords points='1,2 3,4'/><TextLine><TextEquiv conf='0.5'><Unicode>x y</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>"


@pytest.mark.parametrize("parse, body", [(P.parse_alto, alto(1, [("b", 1, 2, "TYPE='T'", words("one two"))])), (P.parse_hocr, HOCR), (P.parse_hocr, HOCR.replace(b"</html>", b"<br>")), (P.parse_page_xml, PAGE)])
def test_pages_without_strings_are_the_same(parse, body):
    full, bare = parse(body), parse(body, strings=False)
    assert full["blocks"] and [[x["text"] for x in b["lines"]] for b in full["blocks"]] == [[x["text"] for x in b["lines"]] for b in bare["blocks"]]
    for page in (full, bare):
        for b in page["blocks"]:
            b["lines"] = None
    assert full == bare


def test_attributes_with_prefixes_are_read():
    """An attribute counts by its local name, and the first of that name: a look-up is only taken where no prefix stands before it."""
    a = P.parse_alto(b"<a:alto xmlns:a='x' xmlns:s='y' s:schemaLocation='q'><a:Page s:ID='P' ID='Q'><a:TextBlock ID='b'><a:TextLine><a:String s:CONTENT = 'one'/></a:TextLine></a:TextBlock></a:Page></a:alto>")
    assert (a["id"], a["blocks"][0]["id"], a["blocks"][0]["text"]) == ("P", "b", "one")
    assert P.xml("﻿ <?xml version='1.0'?><a b='\x01é'/>").attrib == {"b": " é"}


def test_issue_documents_are_those_of_all_documents(spark):
    rows = [("http://x/i1/mets.xml", METS), ("http://x/i1/p1.xml", PAGES["A1"]), ("http://x/i1/p2.xml", PAGES["A2"]), ("http://y/lost.xml", METS), ("http://y/p1.xml", None), ("http://y/bad.xml", b"<mets>"), (None, METS)]
    table = spark.createDataFrame([(u, b, "") for u, b in rows], "url string, body binary, content_type string")
    plain = lambda df: sorted(map(str, df.collect()))
    of_issues = plain(issue_documents(table))
    assert len(of_issues) == 2 and of_issues == plain(documents(table).where("source_type like 'mets%'"))


def test_sessions_keep_their_own_batches(spark):
    before = spark.conf.get(BATCH, None)
    try:
        spark.conf.set(BATCH, "777777")
        in_small_batches(spark)
        assert spark.conf.get(BATCH) == "777777"
        spark.conf.unset(BATCH)
        in_small_batches(spark)
        assert spark.conf.get(BATCH) == str(2 << 20)
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)


def test_remembered_words_are_bounded():
    seen = T.Memory(lambda w: w.upper())
    seen.MOST = 3
    assert [seen[w] for w in ("a", "b", "c", "d", "x" * 41)] == ["A", "B", "C", "D", "X" * 41] and len(seen) == 1


def test_cleaning_as_by_the_plain_patterns():
    def plain(t):
        for pattern, by in ((r"([^\W\d_])[-=¬]\s*\n\s*([^\W\d_])", r"\1\2"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
            t = re.sub(pattern, by, t)
        return t.strip()

    for t in ("a-\nb-\nc", " a \t b\n \n \n\n c ", "a=\n  \n b¬ \nc", "\t", "a  b", "a \n", "\x0b a-\r\nb"):
        assert T.clean_ocr(t) == plain(t)
    assert T.normalize_lv("Rihgas seme", T.Lexicon.of(["zeme"])) == "Rīgas zeme"


def test_documents_of_some_columns_are_those_of_all(spark, monkeypatch):
    """A text is analysed only for what is asked for and its source does not say."""
    dated = METS.replace(b"</mods>", b"<dateIssued>1901-02-03</dateIssued></mods>") if b"</mods>" in METS else METS
    rows = [("http://x/1901-02-03/mets.xml", dated), ("http://x/1901-02-03/p1.xml", PAGES["A1"]), ("http://x/1901-02-03/p2.xml", PAGES["A2"])]
    table = spark.createDataFrame([(u, b, "") for u, b in rows], "url string, body binary, content_type string")
    plain = lambda df: sorted(map(str, df.collect()))
    for asked in (["url", "title", "text_raw", "date", "ocr_confidence"], ["id", "language"], ["url", "metadata"]):
        assert plain(issue_documents(table, columns=asked).select(*asked)) == plain(issue_documents(table).select(*asked))
    monkeypatch.setattr(D.T, "analyze_article", lambda text: 1 / 0)
    mets, asked = P.parse_mets(dated), frozenset({"url", "title", "text_raw", "date"})
    found = D.from_mets("http://x/1901-02-03/mets.xml", mets, D.Site(), "", PAGES, asked)
    assert found and all(d["text_raw"] and d["date"] == "1901-02-03" for d in found)
