from lettera.sources import parsers as P

ALTO = b"""<?xml version="1.0"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v3#"><Layout><Page ID="P1" PHYSICAL_IMG_NR="1" WIDTH="1000" HEIGHT="2000"><PrintSpace>
<ComposedBlock ID="CB1"><TextBlock ID="TB1" HPOS="0" VPOS="0" WIDTH="400" HEIGHT="10"><TextLine><String CONTENT="Beed" SUBS_TYPE="HypPart1" SUBS_CONTENT="Beedriba" WC="0.5"/><String CONTENT="riba" SUBS_TYPE="HypPart2"/><String CONTENT="x" WC="1"/></TextLine></TextBlock></ComposedBlock>
<TextBlock ID="TB2"><TextLine><String CONTENT="otrs"/></TextLine></TextBlock><TextBlock ID="TB3"><TextLine/></TextBlock></PrintSpace></Page></Layout></alto>"""
METS = b"""<mets xmlns="http://www.loc.gov/METS/" xmlns:xlink="http://www.w3.org/1999/xlink"><dmdSec><title>Avize</title><dateIssued>1899-05-01</dateIssued></dmdSec><fileSec><fileGrp USE="ALTO"><file ID="F1"><FLocat xlink:href="p1.xml"/></file></fileGrp></fileSec>
<structMap TYPE="LOGICAL"><div TYPE="ISSUE" ID="D0"><div TYPE="ARTICLE" ID="D1"><fptr><area FILEID="F1" BEGIN="TB1" END="TB2"/></fptr></div></div></structMap></mets>"""


def test_alto():
    page = P.parse_alto(ALTO)
    assert (page["id"], page["number"], page["width"]) == ("P1", 1, 1000)
    assert [(b["id"], b["parent"], b["text"], b["confidence"]) for b in page["blocks"]] == [("TB1", "CB1", "Beedriba x", 0.75), ("TB2", "", "otrs", None)]


def test_mets():
    m = P.parse_mets(METS)
    assert m["metadata"]["title"] == "Avize" and m["files"][0]["href"] == "p1.xml"
    assert [(d["div_id"], d["parent"]) for d in m["divs"]] == [("D0", None), ("D1", 0)] and m["areas"][0]["end"] == "TB2"


def test_other_formats():
    assert P.parse_tei(b"<TEI><text><body><div id='a'><head>T</head><p>x  y</p></div></body></text></TEI>")["articles"] == [{"id": "a", "type": "", "title": "T", "text": "x y"}]
    page = P.parse_page_xml(b"<PcGts><Page imageFilename='s_3.png' imageWidth='2480' imageHeight='3508'><TextRegion id='r1'><Coords points='0,0 10,20'/><TextLine><TextEquiv conf='0.6'><Unicode>a b</Unicode></TextEquiv></TextLine></TextRegion></Page></PcGts>")
    assert page["number"] == 3 and page["blocks"][0]["text"] == "a b" and page["blocks"][0]["height"] == 20
    hocr = P.parse_hocr(b"<html><div class='ocr_page' title='bbox 0 0 9 9'><span class='ocr_line' title='bbox 0 0 5 5'><span class='ocrx_word' title='bbox 0 0 2 2; x_wconf 80'>vards</span></span></div></html>")
    assert hocr["blocks"][0]["text"] == "vards" and hocr["confidence"] == 0.8
    assert P.parse_hocr(b"<div class='ocr_line'><span class='ocrx_word'>a</span><p></div>")["blocks"][0]["text"] == "a"
    html = P.parse_html("<html lang=lv><title>T</title><nav><a href='/n'>n</a></nav><p>teksts</p><a href='mailto:x'>m</a>", "http://a/")
    assert (html["title"], html["lang"], html["links"], html["main_text"].split()[0]) == ("T", "lv", ["http://a/n"], "teksts")
    assert P.sitemap_urls(b"<urlset><url><loc>http://a/1</loc></url></urlset>") == (["http://a/1"], [])
    assert P.oai_headers(b"<OAI-PMH><ListIdentifiers><header><identifier>i</identifier></header><resumptionToken>t</resumptionToken></ListIdentifiers></OAI-PMH>")[1] == "t"
    assert P.rdf_aggregates(b"<RDF xmlns:rdf='r'><D rdf:resource='/a/article1'/><D rdf:resource='/b'/></RDF>", "http://s", "article") == ["http://s/a/article1"]
    assert [P.sniff(x) for x in (ALTO, METS, b"{}", b"<html>", b"plain")] == ["alto", "mets", "json", "html", "text"]
    assert 0 < P.otsu([10] * 10 + [0] * 236 + [10] * 10) < 250
