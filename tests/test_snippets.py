import random

import pandas as pd

from lettera.operators import snippets as W


def test_windows_against_all_windows():
    r = random.Random(3)
    for _ in range(400):
        keys = [r.choice("abcdxyz") for _ in range(r.randint(0, 40))]
        phrases = [[r.choice("abcd") for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 4))]
        size = r.randint(3, 9)
        found = W.matches(keys, phrases)
        assert found == sorted((i + len(p), i, k) for k, p in enumerate(phrases) for i in range(len(keys)) if keys[i : i + len(p)] == p)
        whole = lambda a, found=found: len({k for e, s, k in found if a <= s and e <= a + size})  # noqa: B023, E731
        begin, end = W.best_window(found, len(keys), size)
        assert end - begin == min(size, len(keys)) and whole(begin) == max(map(whole, range(max(1, len(keys) - size + 1))))


def test_snippets(spark):
    text = "Pirms tam. " + "x " * 30 + "Rīgā, šodien — ſchodeen laba diena! " + "y " * 30
    assert W.snippet_of("a, (b) c", [["b"], ["c"]]) == "a, («b) c»" and W.snippet_of("", [["b"]]) == "" and W.snippet_of("none here.", [["b"]]) == "none here."
    got = W.snippet_of(text, [["riga"], ["laba", "diena"]], 6)
    assert got == " … «Rīgā», šodien — ſchodeen «laba diena»! y … "
    rows = spark.createDataFrame([(1, text), (2, None)], "id long, text string")
    assert {r.id: r.snippet for r in W.with_snippets(rows, [["riga"], ["laba", "diena"]], "text", 6).collect()} == {1: got, 2: ""}


def test_query(spark):
    from lettera import queries as Q

    sf = "/root/testdata/sf0.001"
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    phrases = [p for g in Q.PHRASES for p in g]
    rows = Q.QUERIES["search_snippets"](spark, sf).collect()
    assert len(rows) == 30 and all(r.snippet == W.snippet_of(texts[r.doc_id], phrases) and W.BEGIN in r.snippet for r in rows)
    assert all(len(W.TOKEN.findall(r.snippet)) <= 24 for r in rows)
