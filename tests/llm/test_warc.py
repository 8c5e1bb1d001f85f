import base64
import glob
import hashlib
import struct

import duckdb
import pytest
import zstandard

from lettera.llm import warc
from lettera.llm.warc import LINE_END, Damaged, frames, op13_warc, page_record, parsed, read_archives, records_of, resolved, write_archives

LONG = "<p>Gaŗš teksts</p>" * 60_000
PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, "http://a/3", None), (4, None, ""), (5, "http://a/ü\r\nX: y %41", "<p>y</p>"), (6, "u", LONG), (7, "u", LONG), (8, "a", "same"), (8, "b", "same"), (8, "b", "same"), (8, "b", "same"), (None, "n", "lost"), (None, "n", "lost"), (9, "", "r\r\n\r\nWARC/1.1\r\n")]
SCHEMA = "page_id long, url string, html string, id int, payload string, sha1 string, top int, n int, error string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def by_hand(pages, least=0):
    """Of each payload, the row of the largest id stays a response; of rows alike in id (then URL) one does."""
    want, groups = [], {}
    for i, url, html in pages:
        groups.setdefault(html or "", []).append((-1 if i is None else i, "" if url is None else url))
    for html, rows in groups.items():
        n = len(html.encode())
        rows = sorted(rows)
        for k, (i, _) in enumerate(rows):
            last = n < least or k == len(rows) - 1
            want.append((i, n, digest(html), "response" if last else "revisit", None if last else rows[-1][0]))
    return sorted(map(str, want))


def result(found):
    null = lambda x: -1 if x is None else int(x)
    return sorted(str((null(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, null(r.refers_to) if r.record_type == "revisit" else r.refers_to)) for r in found.collect())


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, 1, "p", "s", 2, 3, "e") for p in PAGES], SCHEMA).repartition(3)


@pytest.mark.parametrize("least, broadcast", [(0, True), (0, False), (5, True)])
def test_round_trip_of_odd_rows(spark, tmp_path, pages, monkeypatch, least, broadcast):
    if not broadcast:
        monkeypatch.setattr(warc, "small_or_not", lambda df: df)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    write_archives(pages, str(tmp_path / "w"), least_bytes=least)
    records = read_archives(spark, str(tmp_path / "w"))
    assert result(resolved(records)) == by_hand(PAGES, least)
    rows = records.collect()
    assert len({r.record_id for r in rows}) == len(PAGES) and not any(r.error for r in rows)
    payloads = {r.payload_digest: r.payload.decode() for r in rows if r.record_type == "response"}
    assert all(payloads[digest(h)] == (h or "") for _, _, h in PAGES)
    assert {(r.page_id, r.target_uri) for r in rows} == {(None if i is None else str(i), u) for i, u, _ in PAGES}


def test_empty_table(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert resolved(read_archives(spark, str(tmp_path / "w"))).count() == 0


def test_archives_have_the_dictionary_first_and_a_frame_a_record(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    write_archives(pages, str(tmp_path / "w"))
    n = 0
    for path in glob.glob(f"{tmp_path}/w/part*"):
        data = open(path, "rb").read()
        found = list(frames(memoryview(data)))
        assert found[0][0] == warc.DICTIONARY and data.endswith(LINE_END.encode())
        head = zstandard.ZstdDecompressor().decompress(data[8 : found[0][2]])
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(head))
        for magic, a, z in found:
            if magic == warc.FRAME:
                assert plain.decompress(data[a:z]).startswith(b"WARC/1.1\r\n")
                n += 1
    assert n == pages.count()


def test_query_on_copies(spark, tmp_path):
    """The whole query and its SQL, on the given pages with copies of every third."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = pages.where("page_id % 3 = 0")
    pages.union(more.selectExpr("page_id + 100000", "url", "html")).union(more.where("page_id % 2 = 0").selectExpr("page_id + 200000", "url", "html")).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP13_SQL)
    names = sorted(want.columns)
    got = op13_warc(spark, str(tmp_path))
    assert sorted(map(str, want.select(", ".join(names)).fetchall())) == sorted(str(tuple(r)) for r in got.select(names).collect())
    assert got.where("record_type = 'revisit'").count() >= more.count()


def one(**over):
    html = b"<p>x</p>"
    page = {"id": "1", "url": "http://a", "sha1": hashlib.sha1(html).hexdigest(), "size": len(html), "payload": html, "revisit": False, "named": True, "refers_id": None, "refers_url": None}
    return page_record(page | over, "2020-01-01T00:00:00Z")


def test_damaged_records_are_told(spark, tmp_path):
    good, z = one(), zstandard.ZstdCompressor().compress
    assert parsed(good)["payload"] == b"<p>x</p>" and parsed(one(revisit=True, refers_id="2"))["payload"] is None
    bad = [good[:-1], good + b"x", good.replace(b"WARC/1.1", b"ZARC/1.1"), good.replace(b"WARC-Type: response\r\n", b""), good.replace(b"<p>x", b"<p>y"), good.replace(b"Content-Length: 8", b"Content-Length: 9"), good.replace(b"HTTP/1.1", b"HTTQ/1.1"), b"nothing", one(revisit=True, refers_id="2").replace(b"WARC-Refers-To:", b"X-Other:")]
    for raw in bad:
        with pytest.raises(Damaged):
            parsed(raw)
    whole = b"".join(map(z, [good, *bad, good]))
    rows = list(records_of("a", whole))
    assert [bool(r.get("error")) for r in rows] == [False, *[True] * len(bad), False]
    cut = list(records_of("a", z(good) + z(good)[:-3]))
    assert len(cut) == 2 and cut[1]["error"] and not cut[0].get("error")
    assert list(records_of("a", b"")) == [] and list(records_of("a", b"\x00" * 9))[0]["error"]
    (tmp_path / "a.warc.zst").write_bytes(whole)
    kept = read_archives(spark, str(tmp_path / "a.warc.zst"), damaged="keep")
    assert kept.where("error is not null").count() == len(bad) and kept.where("payload is not null").count() == 2
    with pytest.raises(Exception, match="Damaged"):
        read_archives(spark, str(tmp_path / "a.warc.zst")).collect()


def test_archives_of_other_writers(spark, tmp_path):
    """A plain dictionary, frames without their content's size, records that are no HTTP, and a revisit of a record that is not there."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\ncontent-length: 5\r\n\r\nhello\r\n\r\n"
    words = b" ".join(f"http://a/{i} <p>x</p> Content-Type".encode() for i in range(2000))
    raw = zstandard.train_dictionary(2000, [words[i : i + 400] for i in range(0, len(words), 200)]).as_bytes()
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_checksum=True)
    streamed = z.compressobj()
    body = streamed.compress(one()) + streamed.flush()
    (tmp_path / "b.warc.zst").write_bytes(struct.pack("<II", warc.DICTIONARY, len(raw)) + raw + z.compress(info) + struct.pack("<II", warc.SKIPPABLE + 3, 2) + b"zz" + body)
    rows = {r.record_type: r for r in read_archives(spark, str(tmp_path)).collect()}
    assert bytes(rows["warcinfo"].payload) == b"hello" and rows["warcinfo"].payload_digest == digest("hello") and bytes(rows["response"].payload) == b"<p>x</p>"
    (tmp_path / "c.warc.zst").write_bytes(zstandard.ZstdCompressor().compress(one(revisit=True, refers_id="404", named=False)))
    with pytest.raises(Exception, match="no response"):
        resolved(read_archives(spark, str(tmp_path / "c.warc.zst"))).collect()
