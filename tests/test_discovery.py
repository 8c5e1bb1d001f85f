import gzip
import random
import zlib

from lettera.operators import cache as H
from lettera.operators import discovery as D


def index(*urls):
    return ("<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>").encode()


def pages(*urls):
    return ("<urlset>" + "".join(f"<url><loc> {u} </loc></url>" for u in urls) + "</urlset>").encode()


def test_sitemaps(spark):
    """Zipped and broken bodies, a cycle, a sitemap that two name, one that is missing, and one too deep."""
    stored = {"r": gzip.compress(index("a", "b", "gone", "bad", "r")), "a": index("b", "c", "r"), "b": pages("p1", "p2", "p1"), "c": index("d"), "d": index("deep"), "deep": pages("no"), "bad": b"\x1f\x8bxx", "other": index("b")}
    resources = spark.createDataFrame([(u, bytearray(b)) for u, b in stored.items()] + [("null", None)], "url string, body binary")
    got = D.sitemap_urls(resources, spark.createDataFrame([("r",), ("other",), ("r",), ("none",), ("null",)], "url string")).collect()
    assert sorted(map(tuple, got)) == [(r, "b", 1, i, u) for r in ("other", "r") for i, u in enumerate(("p1", "p2", "p1"))]
    assert {r.url for r in D.sitemap_urls(resources, spark.createDataFrame([("a",)], "url string"), max_depth=3).collect()} == {"p1", "p2", "no"}


def test_chains_against_following(spark, monkeypatch):
    """Long lists, gaps and cycles; the rounds are some log2 of the length."""
    r, rows = random.Random(1), []
    for e in range(6):
        tokens = ["", *(f"{e}-{k}" for k in range(r.choice((0, 1, 5, 130))))]
        rows += [(f"e{e}", a, b) for a, b in zip(tokens, [*tokens[1:], ""]) if r.random() > 0.01 or not a]
    rows += [("cycle", "", "a"), ("cycle", "a", "b"), ("cycle", "b", "a"), ("self", "", ""), ("lost", "x", "y"), ("one", "", None), ("head", "", "q"), ("head", "q", "z"), ("head", "z", "gone")]
    want = []
    for e in {x[0] for x in rows}:
        to, at, seen = {a: b for x, a, b in rows if x == e}, "", []
        while at in to and at not in seen and (at or not seen):
            seen.append(at)
            at = to[at] or ""
        want += [(e, t, k) for k, t in enumerate(seen)]
    rounds, kept = [], D.kept
    monkeypatch.setattr(D, "kept", lambda df, what: rounds.append(what) or kept(df, what))
    got = D.chain_order(spark.createDataFrame(rows, "endpoint string, token string, next_token string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and rounds.count("chain-found") <= 10


def test_oai_identifiers(spark):
    def answer(token, *names):
        return ("<OAI-PMH><ListIdentifiers>" + "".join(f"<header><identifier>{n}</identifier><datestamp>2020</datestamp><setSpec>s</setSpec><setSpec>t</setSpec></header>" for n in names) + f"<resumptionToken>{token}</resumptionToken></ListIdentifiers></OAI-PMH>").encode()

    rows = [("o", "t1", answer("t2", "c", "", "d")), ("o", "", answer("t1", "a", "b")), ("o", "t2", b"<OAI-PMH><error code='x'/></OAI-PMH>"), ("p", None, answer("", "x")), ("q", "", b"<broken")]
    got = D.oai_identifiers(spark.createDataFrame([(e, t, bytearray(b)) for e, t, b in rows], "endpoint string, token string, body binary")).orderBy("endpoint", "rank", "pos").collect()
    assert [(r.endpoint, r["rank"], r.pos, r.identifier) for r in got] == [("o", 0, 0, "a"), ("o", 0, 1, "b"), ("o", 1, 0, "c"), ("o", 1, 2, "d"), ("p", 0, 0, "x")] and got[0].sets == "s,t"


def test_cache_against_replay(spark):
    r = random.Random(2)
    history = [("u", 10.0, 304, "x", None, "n"), ("u", 20.0, 200, "e1", None, "h1"), ("u", 30.0, 304, None, None, None), ("u", 40.0, 500, None, None, "z"), ("u", 90.0, 200, None, None, "h2"), ("u", 90.0, 200, None, "m3", "h3"), (None, 1.0, 200, "n", None, "null")]
    history += [(r.choice("abc"), float(r.randint(0, 300)), r.choice((200, 304, 304, 404)), r.choice((None, "e")), r.choice((None, "m")), f"h{k}") for k in range(150)]
    requests = [(k, r.choice([*"abcu", "never"]), float(r.randint(0, 320))) for k in range(300)] + [(999, "u", 90.0), (998, "u", 19.0)]
    want = {}
    for k, u, at in requests:
        kept = touched = None
        for h in sorted((h for h in history if h[0] == u and h[1] <= at), key=lambda h: (h[1], h[5] or "")):
            if h[2] == 200:
                kept = h[3:6]
            touched = h[1] if h[2] in (200, 304) else touched
        want[k] = ("miss", None, None, None, None) if not kept else ("hit" if at - touched < 25 else "revalidate" if kept[0] or kept[1] else "refetch", *kept, at - touched)
    df = spark.createDataFrame(history, "url string, fetched_at double, status int, etag string, last_modified string, content_hash string")
    asked = spark.createDataFrame(requests, "id long, url string, at double")
    for span in (7.0, 1e9):
        got = {x.id: (x.answer, x.etag, x.last_modified, x.content_hash, x.age) for x in H.lookups(df, asked, ttl=25, span=span).collect()}
        assert got == want and len({w[0] for w in want.values()}) == 4


def test_stored_bodies(spark):
    text = b"text" * 100
    raw = zlib.compressobj(wbits=-15)
    rows = [("gz", gzip.compress(text), "x-GZIP"), ("zlib", zlib.compress(text), "deflate"), ("raw", raw.compress(text) + raw.flush(), "Deflate"), ("none", text, None), ("broken", b"abc", "gzip"), ("null", None, "gzip"), ("large", b"x" * 501, "")]
    got = {r.url: r for r in H.bodies(spark.createDataFrame([(u, None if b is None else bytearray(b), e) for u, b, e in rows], "url string, body binary, encoding string"), limit=500).collect()}
    assert {u: None if r.body is None else bytes(r.body) for u, r in got.items()} == {"gz": text, "zlib": text, "raw": text, "none": text, "broken": b"abc", "null": b"", "large": None}
    assert got["large"].error == "over 500 bytes" and not got["gz"].error and got["gz"].content_hash == got["none"].content_hash
