import glob
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d"), (2, "a  b\nc d"), (3, None), (4, ""), (5, "x"), (6, "x"), (6, "x"), (None, "lost"), (8, "word " * 30_000), (9, "é" * 70), (10, "é" * 70)]
SCHEMA = "doc_id long, text string, id int, t string, bits string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "t", "b") for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return pd.read_parquet(f"{SF}/documents.parquet")


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_simhash_against_brute_force(spark, docs):
    from lettera.llm.simhash import fingerprint, op1_simhash

    fp = {i: fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    ids = sorted(fp)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = op1_simhash(spark, SF).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == want and list(got.fingerprint) == [f"{fp[i]:016x}" for i in got.doc_id]


def test_simhash_links_all_pairs_within_two_bits(spark):
    from lettera.llm.simhash import links

    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 20).tolist()
    fps = {b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 2, 3, 4)} | {0, 1 << 31, (1 << 31) | 1}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    got = [tuple(r) for r in links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert set(got) == want and len(got) == len(want)


def test_components(spark):
    from lettera.llm.components import connected_components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3), (50, 40)]
    want = components({x for e in edges for x in e if x} - {None}, [e for e in edges if None not in e])
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: r for n, r in want.items()}


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    from lettera.llm import components as steps
    from lettera.llm import simhash

    plans, own = [], simhash.checkpointed

    def noted(df):
        out = own(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for module in (simhash, steps):
        monkeypatch.setattr(module, "checkpointed", noted)
    rows = [(i, f"some words of text {i // 3}") for i in range(60)]
    found = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 60
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert any("Join" in p for p in plans) and not [p for p in plans if "Broadcast" in p]


def test_quality_and_language(spark):
    from lettera.llm.langid import op7_langid
    from lettera.llm.quality import op2_quality

    sf = "/root/testdata/sf0.01"
    labels, truth = pd.read_parquet(f"{sf}/labels.parquet"), pd.read_parquet(f"{sf}/documents.parquet")
    q = op2_quality(spark, sf).toPandas().merge(labels, on="doc_id")
    q = q[q.held_out]
    assert (q[q.quality == 1].predicted == 1).mean() > 0.97 and q[q.quality == 1].score.mean() - q[q.quality == 0].score.mean() > 0.5
    got = op7_langid(spark, sf).toPandas().merge(truth, on="doc_id")
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))


def test_forward_sums_all_segmentations():
    from lettera.llm.langid import forward, forward_one

    pieces, probs = {"▁": 0, "a": 1, "b": 2, "▁a": 3, "ab": 4}, np.array([[0.2], [0.1], [0.3], [0.15], [0.2], [0.05]])
    want = np.log(0.2 * 0.1 * 0.3 + 0.15 * 0.3 + 0.2 * 0.2)
    assert np.isclose(forward(["ab"], pieces, 2, probs)[0, 0], want) and np.isclose(forward_one("ab", pieces, 2, probs)[0], want)
    assert np.isfinite(forward_one("ab" * 3000, pieces, 2, probs)[0])


def test_fitting_counts_whole_words():
    from lettera.llm.langid import edges, fit, piece_counts

    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "c": 4}
    _, probs = fit([("ab" * 400 + "c" * 400, "x"), ("ab" * 400, "y")], pieces)
    assert np.isfinite(probs).all() and probs[4, 0] > 0.2 and probs[4, 1] < 0.01
    # each character is in one piece; long and short words are counted alike
    prob = np.array([0.1, 0.2, 0.3, 0.2, 0.1, 0.1])
    for word in ("ab" * 15, "ab" * 16, "ab" * 2000):
        e = edges(word, pieces, 2)
        found = piece_counts(e, len(word) + 1, prob)
        assert np.isclose(sum(x * (j - i) for (_, x), (i, j, _) in zip(found, e)), len(word) + 1)
        assert np.isclose(sum(x for p, x in found if p == 3), 0.2 / (0.2 + 0.06) * len(word) / 2)


def brute_repeats(rows, length=50):
    first, out = {}, {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(i, first.get(b[s : s + length], i))
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        out[i] = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300, "piece": 700, "most": 300}])
def test_repeats_against_brute_force(spark, docs, sizes):
    """With small sizes a text has several pieces, a gram several shards, and entries of one gram are many times as many as are held."""
    from lettera.llm.suffix_dedup import remove_repeats

    rows = [(int(i), t[:2500]) for i, t in zip(docs.doc_id, docs.text)] + [(10_001 + k, "same line of text that comes again " * 3 + "x" * k) for k in range(40)] + [(20_000, None), (20_001, "")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **sizes).select("doc_id", F.sha2("kept", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == brute_repeats(rows)


def test_suffix_array_and_common_prefixes():
    from lettera.llm.suffix_dedup import kasai, suffix_array

    t = np.random.default_rng(2).integers(1, 4, 500).astype(np.uint16)
    order, rank = suffix_array(t)
    raw = [tuple(t[i:]) for i in range(500)]
    assert order.tolist() == sorted(range(500), key=raw.__getitem__) and (order[rank] == np.arange(500)).all()
    lcp = kasai(t, order, rank, np.array([0]), np.array([500]), 50)
    for r in range(1, 500):
        a, b = raw[order[r - 1]], raw[order[r]]
        assert lcp[r] == min(50, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_licenses(spark):
    from lettera.llm.license_scan import scan

    text = "Intro words here.\nLicensed under CC BY-NC 4.0.\nMore. Released  under the MIT\nLicense. End"
    got = scan(spark.createDataFrame([(1, text), (2, None), (3, "plain text with no such thing")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(m.license, m.coverage, text[m.start : m.end]) for m in got[0].matches] == [("CC-BY-NC-4.0", 1.0, "Licensed under CC BY-NC 4.0"), ("MIT", 1.0, "Released  under the MIT\nLicense")]
    assert not got[1].matches and not got[2].matches


def test_licenses_and_their_near_siblings(spark):
    from lettera.llm.license_scan import TEMPLATES, scan

    header = TEMPLATES["GPL-3.0", "header"]
    texts = {
        "Apache-2.0": TEMPLATES["Apache-2.0", "text"], "BSD-2-Clause": TEMPLATES["BSD-2-Clause", "text"], "BSD-3-Clause": TEMPLATES["BSD-3-Clause", "text"], "MIT": TEMPLATES["MIT", "text"],
        "GPL-2.0": header.replace("version 3", "version 2"), "GPL-3.0": header, "AGPL-3.0": header.replace("GNU General", "GNU Affero General"), "LGPL-3.0": header.replace("GNU General", "GNU Lesser General"),
        None: header.replace("version 3", "version 9"),
    }
    rows = [(i, f"Before it.\n{t}\nAnd after.") for i, t in enumerate(texts.values())]
    got = {r.doc_id: r.matches for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [[m.license for m in got[i]] for i, _ in rows] == [[n] if n else [] for n in texts]
    # the span is that of the whole text, less punctuation at its end
    assert all(m.coverage > 0.98 and m.end - m.start > 0.97 * len(t) for (i, _), t in zip(rows, texts.values()) for m in got[i])


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact(spark, odd, hash_all):
    from lettera.llm.exact_dedup import exact_dedup

    got = exact_dedup(odd, hash_all=hash_all)
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 3, True), (6, 5, 3, False), (None, None, 1, True), (9, 9, 2, True)} <= rows
    assert "PythonUDF" not in got._jdf.queryExecution().toString()


def test_sentence_pieces_as_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece

    from lettera.llm.sentence_pieces import decode, encode

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(int(i), t) for i, t in zip(docs.doc_id[:60], docs.text[:60])] + [(-1, None), (-2, ""), (-3, "  two  spaces\n\n tab\tß😀 " + "long" * 90), (-3, "a")]
    got = decode(encode(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == model.encode(r.text) and r.decoded == r.text


def test_runs_of_blanks_as_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from lettera.llm.sentence_pieces import Encoder, encode, encode_units

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [" " * n + end for n in range(1, 201) for end in ("", "return", "漢")] + ["a\n" + " " * n + "x = 1" for n in (15, 17, 33)]
    got = encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and [r.text for r in got if list(r.ids) != model.encode(r.text)] == []
    rng = np.random.default_rng(4)
    letters, words = list("aeinorst▁▁.,-=(1é漢"), open(__file__).read().split()
    units = {"▁" * n + end for n in range(1, 47) for end in ("", "return", "漢")} | {"".join(rng.choice(letters, int(n))) for n in rng.integers(1, 63, 1500)} | {w[:62] for w in words}
    encoder, folded = Encoder(path), {}
    for r in encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), path).collect():
        folded[r.unit] = np.frombuffer(encoder.ids(r.unit, r.cuts), np.int32).tolist()
    assert len(folded) > 1000 and [u for u in units if folded.get(u, np.frombuffer(encoder.ids(u), np.int32).tolist()) != model.encode("\n" + u)[2:]] == []


def test_long_units_as_the_library(spark):
    import public_tokenizers
    import sentencepiece

    from lettera.llm.sentence_pieces import LongUnits, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list(some), n)) for some in ("aeiourstnl", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab", "=-") for n in (62, 63, 64, 94, 95, 200, 1000, 20_000)]
    texts += ["x" * n for n in (62, 63, 500)] + ["=" * n for n in (63, 94, 777)] + ["漢字" * 300, "é" * 5000, ("word" * 40 + " ") * 30]
    got = encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and [r.text[:40] for r in got if list(r.ids) != model.encode(r.text)] == []
    # most are put together from their windows, not by the library
    own, joined = LongUnits(path), 0
    for t in texts[:16]:
        windows = [np.array(model.encode("\n" + w)[2:], np.int32).tobytes() for w in own.windows(t)]
        joined += own.joined(t, windows) is not None
    assert joined == 16


def test_ids_with_holes():
    """A text is cut once, where its known units get their ids; the others fill its holes later, any number of times and of any length."""
    import public_tokenizers
    import pyarrow as pa
    import sentencepiece

    from lettera.llm.sentence_pieces import Holed, Known, UnitIds, apart, cut, together, unit_pattern, vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = re.compile(unit_pattern(vocabulary(model)))
    text = "known 7 known 7 q " + "x" * 200 + " 7\n\n\x01 \uffff" + " 7" * 500
    known, holed = Known({"▁known": np.array(model.encode("known"), np.int32).tobytes()}), Holed(path)
    ids = b"".join(map(known.__getitem__, cut(pieces, text)))
    names = list(dict.fromkeys(known.met))
    raw = holed.pack(ids, [names.index(u) for u in known.met])
    folded = pa.table({"unit": pa.array([], pa.string()), "cuts": pa.array([], pa.int64())})
    units = UnitIds(folded, path)
    units.update((u, np.array(model.encode("\n" + u)[2:], np.int32).tobytes()) for u in {*names, *(w for u in names for w in units.long.windows(u))} if len(u) <= 62)
    assert len(known.met) > 500 > len(names) and np.frombuffer(holed.fill(raw, names, units.__getitem__), np.int32).tolist() == model.encode(text)
    once = holed.pack(Known.hole + Known.hole, [0, 1])
    assert holed.fill(once, ["▁known", "7"], lambda u: known[u] if u == "▁known" else b"\x09\0\0\0") == known["▁known"] + b"\x09\0\0\0" and len(once) == 8
    odd_units = ["▁a", "\n\n\n", "▁▁", "\n", "\x01", "▁▁b"]
    assert apart(together(odd_units)) == odd_units and apart(together(names)) == names
    none = holed.pack(b"", [])
    assert holed.fill(none, [""], units.__getitem__) == b""


def test_numbers_of_known_units():
    """Numbers of one, two and three bytes and holes come back as the units' ids."""
    from lettera.llm.sentence_pieces import THREE, TOO_MANY, TWO, Known, Numbered

    known = [np.arange(k, k + 1 + k % 3, dtype=np.int32).tobytes() for k in range(THREE + 70_000)]
    table = Numbered.table(known)
    numbers = [0, TWO - 2, TWO - 1, TWO, -1, THREE - 2, THREE - 1, THREE, -1, len(known) - 1, 0, THREE + 65_535, THREE + 65_534, *range(TWO - 3, THREE + 70_000, 97), -1]
    raw = Numbered().pack(np.array(numbers, np.int32).tobytes(), [0, 1, 0])
    rare = {"q": b"\x07\0\0\0", "xq": b"\x09\0\0\0\x08\0\0\0"}
    holes = iter(["q", "xq", "q"])
    want = b"".join(known[k] if k >= 0 else rare[next(holes)] for k in numbers)
    assert Numbered(table).fill(raw, ["q", "xq"], rare.__getitem__) == want
    assert Numbered(table).fill(Numbered().pack(b"", []), [""], rare.__getitem__) == b""
    assert len(Numbered().pack(Known.hole * 5 + np.int32(TWO - 2).tobytes() * 5, [0, 1, 2, 3, 4])) == 4 + 10
    with pytest.raises(ValueError):
        Numbered.table([b""] * TOO_MANY)


def test_little_is_shuffled_for_pieces(spark):
    """Bytes of shuffle files a character; 1.26 when ids of two bytes were shuffled instead of units' numbers."""
    from lettera.llm.sentence_pieces import op6_sentence_pieces

    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    sf = SF.replace("sf0.001", "sf0.01")
    chars = spark.read.parquet(f"{sf}/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    got = op6_sentence_pieces(spark, sf)
    before = files()
    assert got.count() == 1000 and 0 < sum(map(os.path.getsize, files() - before)) < 1.15 * chars


def test_texts_stay_where_a_digest_is_carried(spark):
    from lettera.llm.sentence_pieces import encode

    rows = [(1, "some words 123 here"), (2, None), (None, "others é there"), (1, "some words 123 here"), (3, "y" * 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = encode(frame).collect()
    got = encode(frame, carry=lambda raw: zlib.crc32(raw).to_bytes(4, "little"), gives="text binary, ids array<int>").collect()
    key = lambda i, t, ids: (i or 0, t, tuple(ids))
    assert sorted(key(r.doc_id, zlib.crc32(r.text.encode()).to_bytes(4, "little"), r.ids) for r in whole) == sorted(key(r.doc_id, bytes(r.text), r.ids) for r in got)


def test_token_files(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lettera.llm.token_files import read_document, read_tokens, write_tokens

    write_tokens(odd, f"{tmp_path}/x")
    got = read_tokens(spark, f"{tmp_path}/x").orderBy("start").collect()
    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted(((i, known.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(r.id, list(r.tokens)) for r in got] == want and [r.start for r in got] == np.concatenate(([0], np.cumsum([len(w[1]) for w in want])[:-1])).tolist()
    assert read_document(spark, f"{tmp_path}/x", 1) == [want[[w[0] for w in want].index(1)][1]] and len(read_document(spark, f"{tmp_path}/x", 6)) == 2


def test_decontamination_against_brute_force(spark):
    from lettera.llm.decontam import occurrences, words_of

    items = [(1, "One two three four five six seven eight nine ten"), (2, "short ITEM"), (3, "!!!"), (4, None), (5, "nine ten"), (None, "x y")]
    docs = [(1, "zero one Two three four five six seven eight. nine"), (2, "short item, nine ten short item"), (3, None), (4, ""), (5, "one two three four five six seven")]
    want = {}
    for i, t in docs:
        w, hit, named = words_of(t), set(), set()
        for item, text in items:
            p = words_of(text)
            for k in range(max(1, len(p) - 7)) if p and item else ():
                win = p[k : k + 8]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        named.add(str(item))
        want[i] = (len(w), len(hit), sorted(named))
    for most in (1000, 1):
        got = occurrences(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_windows=most).collect()
        assert {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.hit_spans), list(r.hit_items)) for r in got} == want


def test_contaminated_documents_are_dropped(spark):
    from lettera.llm.decontam import drop_contaminated

    items = [(1, "What is the capital?"), (2, "Name two rivers"), (3, "one two three four five six seven eight nine"), (4, None)]
    docs = [(1, "so what is the capital of it"), (2, "What is the capital? Name two rivers!"), (3, "what is the capital what is the capital"), (4, "x one two three four five six seven eight"), (5, None), (6, "name two rivers one two three four five six seven")]
    got = drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "text"] and sorted(r.doc_id for r in got.collect()) == [1, 3, 5, 6]


def test_html():
    from lettera.llm.html_text import main_text

    page = "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=a>menu</a></nav><div class='ad'>Buy</div><div id=cookie-notice>Cookies</div>"
    body = "<article><h1>Head &amp; line</h1><p><b>One\n two<br>three<p>Four</p><script>var a='</p>'</script><ul><li>x<li>y</ul><div class=share-buttons>Share</div></article>"
    end = "<section class=comments><p>I say a lot of things here, and more.</p></section><aside>Side</aside><form>Mail</form><footer>(c)</footer></body></html>"
    assert main_text(page + body + end) == "Head & line\nOne two three\nFour\nx\ny"
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    long = "word " * 50
    assert main_text(f"<body><div><a href=1>a</a> <a href=2>b</a></div><div><h1>T</h1><div><p>{long}</p><p>{long}</p></div></div>") == f"T\n{long.strip()}\n{long.strip()}"


def test_html_text_outside_and_across_articles():
    from lettera.llm.html_text import main_text

    def words(w, n):
        return " ".join([w] * n)

    nav, long, other = "<nav><a href=1>x</a></nav>", [words("aaa", 80), words("bbb", 70)], [words("ccc", 60), words("ddd", 50)]
    paragraphs, more = ("".join(f"<p>{t}</p>" for t in x) for x in (long, other))
    assert main_text(f"<body>{nav}<div>{paragraphs}</div></body>") == "\n".join(long)
    assert main_text(f"<body>{nav}<article><h3>Card</h3><p>A teaser.</p></article><div>{paragraphs}</div></body>") == "\n".join(long)
    assert main_text(f"<body>{nav}<article>{paragraphs}</article><article>{more}</article><article>{paragraphs}</article></body>") == "\n".join(long + other + long)
    assert main_text(f"<body>{nav}<main><article>{paragraphs}</article><article>{more}</article></main></body>") == "\n".join(long + other)


def test_near_copies(spark, odd):
    from lettera.llm.near_copies import drop_near_copies, near_copies

    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [list(rng.choice(vocabulary, 300)) for _ in range(15)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 3):
            copy = list(words)
            copy[int(rng.integers(0, 300))] = "changed"
            rows.append((10 * k + c, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 10 for i, _ in rows}
    kept = drop_near_copies(odd)
    assert kept.columns == odd.columns and {1, 3, 5, 8, 9, None} <= {r.doc_id for r in kept.collect()}


def test_near_copies_against_brute_force(spark, docs):
    from lettera.llm.near_copies import near_copies

    rng = np.random.default_rng(3)
    texts = [t.split() for t in docs.text if 120 < len(t.split()) < 600][:40]
    rows = [(100 * k, w) for k, w in enumerate(texts)]
    for k, w in enumerate(texts):
        other = texts[(k + 7) % len(texts)]
        for c, share in enumerate((0.05, 0.1, 0.15, 0.2, 0.3)):
            n = int(share * len(w))
            at = int(rng.integers(0, len(w) - n))
            swapped = list(w)
            for p in rng.choice(len(w), max(1, n // 10), replace=False):
                swapped[p] = f"new{p}"
            rows += [(100 * k + 10 + c, w + other[:n]), (100 * k + 20 + c, w[:at] + w[at + n :]), (100 * k + 30 + c, swapped)]
    # many copies of one text, which fill its anchors, and one that is only near to some of them
    rows += [(9000 + c, [f"v{c}" if i == 3 * c else f"w{i}" for i in range(300)]) for c in range(60)]
    sets = {i: {tuple(x.lower() for x in w[p : p + 5]) for p in range(len(w) - 4)} for i, w in rows}
    ids = sorted(sets)
    want = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9])
    got = near_copies(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_copies_meet_at_fingerprints(spark, monkeypatch):
    """Without MinHash anchors, those of the covering code alone link texts whose SimHash fingerprints differ in 2 bits or fewer."""
    from lettera.llm import near_copies as own
    from lettera.llm.simhash import majority

    rng = np.random.default_rng(8)
    rows = []
    for k in range(12):
        words = list(rng.choice([f"w{i}" for i in range(3000)], 1500))
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 5):
            at = int(rng.integers(0, 1500))
            rows.append((10 * k + c, " ".join([*words[:at], f"new{c}", *words[at + 1 :]])))
    rows += [(500 + i, " ".join(f"r{i}" for _ in range(9))) for i in range(9)] + [(600, ""), (601, None)]
    sets = {i: own.shingle_set(t, 5, {}) for i, t in rows}
    fp = {i: majority([s]) for i, s in sets.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    want = components(sorted(fp), near)
    monkeypatch.setattr(own, "anchors", lambda s: np.array([xxhash.xxh64_intdigest(s.tobytes())] * min(1, len(s)), np.uint64))
    got = {r.doc_id: r.component_id for r in own.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and got == want


def test_copies_are_dropped_by_row(spark):
    from lettera.llm.exact_dedup import drop_exact_copies
    from lettera.llm.near_copies import drop_near_copies

    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, "a b c d e f", 1), (2, "a  b c d e f", 2), (2, "only here and not there", 3), (3, "q r s t u v", 4), (3, "q r s t u v", 5), (None, "q r s t u v", 6), (None, "no other has this", 7), (4, None, 8), (5, "", 9)]
    near = [(7, long, 10), (8, long + " more", 11), (8, "again under the same id", 12), (9, "again under the same id", 13)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string, i int")
    got = {(r.doc_id, r.i) for r in drop_exact_copies(make(rows + near)).collect()}
    assert {(i, n) for i, n in got if i != 3} == {(1, 1), (2, 3), (None, 7), (4, 8), (7, 10), (8, 11), (8, 12)} and len(got & {(3, 4), (3, 5)}) == 1 and len(got) == 8
    got = {(r.doc_id, r.i) for r in drop_near_copies(make(rows + near)).collect()}
    assert {(i, n) for i, n in got if i != 3} == {(1, 1), (2, 3), (None, 6), (None, 7), (4, 8), (7, 10), (8, 12)} and len(got & {(3, 4), (3, 5)}) == 1 and len(got) == 8
    for drop in (drop_exact_copies, drop_near_copies):
        empty = drop(make(rows).where("false"))
        assert empty.columns == ["doc_id", "text", "i"] and empty.count() == 0


def test_odd_and_empty_tables(spark, odd):
    """Values of each operator on nulls, empty and long texts, ties, repeated rows and clashing columns; no rows of an empty table."""
    from lettera.llm import decontam, exact_dedup, langid, license_scan, near_copies, quality, sentence_pieces, simhash, suffix_dedup

    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    by_id = lambda rows, f: {(r.doc_id, f(r)) for r in rows}
    ids = {i for i, _ in ODD}
    runs = {
        quality: (lambda d: quality.quality_scores(d, labels), lambda got: len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and all(0 <= r.score <= 1 for r in got)),
        langid: (lambda d: langid.identify(d.withColumn("lang", F.lit("en"))), lambda got: by_id(got, lambda r: r.lang_pred) == {(i, "und" if i in (3, 4) else "en") for i in ids}),
        license_scan: (license_scan.scan, lambda got: not any(r.matches for r in got)),
        exact_dedup: (exact_dedup.exact_dedup, lambda got: sum(r.kept for r in got) == 6),
        simhash: (simhash.near_dedup, lambda got: by_id(got, lambda r: r.component_id) >= {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (8, 8), (9, 9), (10, 9)}),
        suffix_dedup: (suffix_dedup.remove_repeats, lambda got: by_id(got, lambda r: (r.n_bytes, len(r.kept))) >= {(3, (0, 0)), (4, (0, 0)), (9, (140, 140)), (10, (140, 0)), (8, (150_000, 150_000))}),
        decontam: (lambda d: decontam.occurrences(d, items), lambda got: by_id(got, lambda r: tuple(r.hit_items)) == {(i, ("1",) if i in (1, 2) else ()) for i in ids}),
        near_copies: (near_copies.near_copies, lambda got: by_id(got, lambda r: r.component_id) == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (None, None), (8, 8), (9, 9), (10, 9)}),
        sentence_pieces: (sentence_pieces.encode, lambda got: all((not r.ids) == (r.doc_id in (3, 4)) for r in got) and len({tuple(r.ids) for r in got if r.doc_id in (5, 6)}) == 1),
    }
    for op, (run, right) in runs.items():
        got = run(odd).collect()
        assert len(got) == len(ODD) and right(got), op.__name__
        assert run(odd.where("false")).count() == 0, op.__name__


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.exact(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == docs.select(F.regexp_replace("text", r"\s+", " ")).distinct().count()
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_ids", "ids"] and 0 < out.count() <= kept.count()


def test_pieces_need_no_python_workers(spark):
    import public_tokenizers
    from lettera.llm.sentence_pieces import model_of, piece_table, vocabulary

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = piece_table(spark, path)
    assert "RDD" not in pieces._jdf.queryExecution().toString()
    assert dict(pieces.dtypes) == {"piece": "string", "piece_id": "int", "place": "int", "late": "boolean"}
    assert {r.piece: r.piece_id for r in pieces.collect()} == {p: i for p, i in vocabulary(model_of(path)).items() if len(p) > 1}


def test_workers_get_small_batches(spark):
    import corpus_pipeline as P
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    # 20 MB in 1000 rows, after any of the stages with Arrow functions
    for name, stage in P.STAGES:
        own = spark.newSession()
        stage(own, own.read.parquet(f"{SF}/documents.parquet").limit(20), SF)
        rows = own.range(1).select(F.explode(F.array_repeat(F.lit("x" * 20_000), 1000)).alias("t"))
        assert name == "exact_dedup" or max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 4 << 20


def test_batches_change_no_rows(spark):
    import corpus_pipeline as P

    found = []
    for size in ("8k", "64m"):
        own = spark.newSession()
        own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
        found.append(sorted((r.doc_id, r.n_ids, r.ids) for r in P.run(own, SF).collect()))
        assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size
    assert found[0] == found[1] and found[0]


def test_word_encoder_equals_the_library():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lettera.llm.token_files import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", "it's I'LL don't 'sx .'s \"'s ''s", "<|endoftext|> a<|startoftext|>b <|x|>", "Œuvre ΣΑΣ ß ẞ É É ½ ª µ × ÷ \x1eb \x85 a\xa0b 東京 İi", "1234 a1b2 _x_", "​😀👍🏽 don’t", "x" * 3000]
    whole = Tokenizer.from_file(path)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in WordEncoder(path).encode(texts)] == want


def test_html_of_odd_rows(spark):
    from lettera.llm.html_text import extract

    page = "<body><div><p>Some text of a page that is long enough.</p></div></body>"
    rows = [(1, None, "x"), (2, "", "x"), (3, page, "x"), (3, page, "x"), (None, page, None), (5, "<b" * 50_000, "x"), (6, f"<div {'a=1 ' * 50_000}>{page}" + "</i>" * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(pages)
    text = "Some text of a page that is long enough."
    assert got.columns == ["page_id", "text"] and sorted(((r.page_id or 0), r.text) for r in got.collect()) == [(0, text), (1, ""), (2, ""), (3, text), (3, text), (5, ""), (6, text)]
    assert extract(pages.where("false")).count() == 0


def test_html_takes_time_in_proportion():
    import time

    from lettera.llm.html_text import main_text

    for part in ("<a ", "</b>", "<b></i>", "<a></b>", '<p class="', "<li>", "<!-- <p>", "<div class='ad-"):
        began = time.process_time()
        main_text("<body>" + part * 30_000)
        assert time.process_time() - began < 5


def test_html_densities_by_the_formula():
    """Densities and the subtree of the largest sum, from counts taken node by node."""
    import math

    from lettera.llm.html_text import Node, in_order, measure, parse

    html = "<body><div><a>menu</a> <a>more</a></div><div><p>One two three four, and <a>five</a>.</p><p>Six seven eight nine ten eleven.</p><ul><li>x</li></ul></div></body>"
    nodes = in_order(parse(html))
    measure(nodes)

    def below(n):
        return [n] + [x for c in n.children if isinstance(c, Node) for x in below(c)]

    def count(n):
        inside = below(n)
        chars = lambda m: sum(len("".join(c.split())) for x in below(m) for c in x.children if isinstance(c, str))
        return chars(n), len(inside) - 1, sum(chars(x) for x in inside if x.tag == "a"), sum(x.tag == "a" for x in inside[1:])

    body = next(n for n in nodes if n.tag == "body")
    c, _, lc, _ = count(body)
    for n in nodes:
        own, tags, links, anchors = count(n)
        t, k, a = max(tags, 1), max(links, 1), max(anchors, 1)
        base = math.log(own / max(own - links, 1) * links + lc / c * own + math.e)
        assert math.isclose(n.density, own / t * math.log(max(own / k * t / a, 1.0) + 1) / max(base and math.log(base), 1.0) if own else 0.0)
    sums = {id(n): sum(c.density for c in n.children if isinstance(c, Node)) for n in nodes}
    assert all(math.isclose(n.total, sums[id(n)]) for n in nodes) and max(nodes, key=lambda n: n.total).tag in ("div", "body")


def test_signs_are_no_language(spark):
    from lettera.llm.langid import identify

    rows = [(i, "some words of a text", "en") for i in range(20)] + [(100, "½ ² ①", None), (101, "12 34 -", None), (102, "½ words", None)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[100] == got[101] == "und" and got[102] == "en"


def test_ftrl_against_an_independent_one(spark):
    """Training and scoring by the textbook's per-coordinate loop; false positives are counted too."""
    import math

    from lettera.llm.quality import Hashes, features, train

    rows = [("good words in a row here and there", 1), ("BUY now!!! 1111", 0), ("another good line of words", 1), ("x x x x x x", 0), (None, 0)] * 3
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2, hashes = 0.3, 1.0, 0.02, 0.1, Hashes()

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for t, y in rows:
            index, value = features(t, hashes)
            total = defaultdict(float)
            for i, v in zip(index.tolist(), value.tolist()):
                total[i] += v
            assert len(total) == len(index)
            w = {i: weight(i) for i in total}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in total.items())))
            for i, v in total.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    got = train(rows)
    assert all(math.isclose(got[i], weight(i), rel_tol=1e-4, abs_tol=1e-6) for i in list(z))


def test_empty_token_files(spark, tmp_path):
    from lettera.llm.token_files import read_tokens, write_tokens

    empty = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(empty, f"{tmp_path}/none")
    assert read_tokens(spark, f"{tmp_path}/none").count() == 0
