import hashlib

from pyspark.sql import functions as F

from lettera.llm.fill_middle import op12_fill_middle, restore, transform

SF = "/root/testdata/sf0.001"
TEXTS = [(1, "aé😀b\r\n c"), (2, None), (3, ""), (4, "has <S> inside"), (4, "has <S> inside"), (5, "<"), (6, "a<P"), (7, "><M>"), (None, "no id <"), (8, "é \x85\n" * 40_000), (9, "x"), (9, "y"), (10, "M>S>P>" * 9)]
SCHEMA = "doc_id long, text string, id int, t string, units int, n string, form string, output string, _parts int, restored int"


def by_hand(i, text, keep=10, spm=20):
    """(n, form, prefix, middle, output), from the words of the contract."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100 - keep:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < spm else "psm"
    return len(t), form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_transform_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 7, "t", 1, "n", "f", "o", 2, 3) for i, t in TEXTS], SCHEMA)
    for keep, spm in ((10, 20), (0, 100), (0, 0), (100, 50)):
        found = restore(transform(docs, keep_percent=keep, spm_percent=spm)).collect()
        got = sorted((str(r.id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found)
        want = sorted((str(i), *by_hand(i, t, keep, spm)) for i, t in TEXTS)
        assert got == want
        assert sorted(r.restored for r in found) == sorted(t or "" for _, t in TEXTS)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert restore(transform(docs)).count() == 0


def test_query_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: (*(w := by_hand(r.doc_id, r.text))[:4], sha(w[4]), sha(r.text or "")) for r in docs}
    found = op12_fill_middle(spark, SF)
    assert {r.doc_id: tuple(r)[1:] for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert found.where(F.col("form") != "plain").count() > 100
