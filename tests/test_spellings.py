import itertools
import math
import random
import re

import pytest

from lettera.functions import text as T
from lettera.operators import index as I
from lettera.operators import spellings as Y


def test_walk_is_the_product():
    r = random.Random(5)
    for _ in range(200):
        terms = sorted({"".join(r.choice("abh") for _ in range(r.randint(1, 5))) for _ in range(60)})
        automaton = [r.sample(["a", "ah", "b", "h", "ab"], r.randint(1, 3)) for _ in range(r.randint(1, 4))]
        whole = {"".join(p) for p in itertools.product(*automaton)}
        assert [terms[i] for i in Y.held(terms, automaton)] == [t for t in terms if t in whole]
        for size in (1, 2, 3):
            assert all(any(s.startswith(p) for p in Y.prefixes(automaton, size)) for s in whole)


def test_spellings_hold_the_listed_ones():
    """Every spelling that an expansion of a query lists is one of the automaton's."""
    for word in ("cilvēks", "šodien", "džungļi", "dzīvība", "čaukstēt", "hercogs", "Žēlīgs"):
        whole = {"".join(p) for p in itertools.product(*Y.spellings(word))}
        assert {Y.token(v) for v in T.old_spellings(word)} <= whole
    # more spellings than could be listed: 3^40 and no term, then one
    assert Y.held(["abc"], Y.spellings("ī" * 40)) == [] and Y.held(["abc", "ih" * 20 + "y" * 20], Y.spellings("ī" * 40)) == [1]


@pytest.fixture(scope="module")
def vocabulary(spark, tmp_path_factory):
    rows = [(1, "Zilweks un zilwehki, schodeen!"), (2, "Cilvēks šodien"), (3, "Mitau Jelgawas zilwehks ſchodeen schodeen"), (4, None), (5, "x" * 40_000), (6, "zilwehku")]
    at = str(tmp_path_factory.mktemp("words"))
    index = I.write_index(spark.createDataFrame(rows, "id long, body string"), f"{at}/index", "id", ["body"])
    return Y.write_vocabulary(index, f"{at}/terms")


def test_reached(vocabulary):
    got = sorted((r.word, r.term, r.documents, r.times) for r in Y.reached(vocabulary, ["cilvēks", "šodien", "Jelgava", "nekas", "", "a b"]).collect())
    assert got == [("Jelgava", "jelgawas", 1, 1), ("Jelgava", "mitau", 1, 1), ("cilvēks", "cilveks", 1, 1), ("cilvēks", "zilwehki", 1, 1), ("cilvēks", "zilwehks", 1, 1), ("cilvēks", "zilwehku", 1, 1), ("cilvēks", "zilweks", 1, 1), ("šodien", "schodeen", 2, 3), ("šodien", "sodien", 1, 1)]
    assert [r.term for r in Y.reached(vocabulary, ["cilvēks"], inflect=False).orderBy("term").collect()] == ["cilveks", "zilwehks", "zilweks"]


def test_search(vocabulary):
    rows = Y.search(vocabulary, ["cilvēks", "šodien"]).collect()
    assert {r.id for r in rows} == {1, 2, 3} and [r.score for r in rows] == sorted(r.score for r in rows)
    # a class of terms counts as one term: document 3 has "schodeen" twice, document 2 "sodien" once, and the mean is of all documents
    n, mean, f, d = 6, (4 + 2 + 5 + 1 + 1) / 6, {1: (2, 1), 2: (1, 1), 3: (1, 2)}, {1: 4, 2: 2, 3: 5}
    part = lambda f, d, df: -max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))
    assert all(abs(r.score - part(f[r.id][0], d[r.id], 4) - part(f[r.id][1], d[r.id], 3)) < 1e-9 for r in rows)
    assert [r.id for r in Y.search(vocabulary, ["Jelgava"]).collect()] == [3]
    assert Y.search(vocabulary, ["cilvēks", "nekas"]).count() == 0 and Y.search(vocabulary, []).count() == 0
    assert {r.id for r in Y.search(vocabulary, ["cilvēks"], None).collect()} == {1, 2, 3, 6}


def test_scan_reads_ranges(vocabulary):
    plan = Y.reached(vocabulary, ["cilvēks"], inflect=False)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,zilw)" in plan


def test_empty_index(spark, tmp_path):
    index = I.write_index(spark.createDataFrame([], "id long, body string"), str(tmp_path / "i"), "id", ["body"])
    v = Y.write_vocabulary(index, str(tmp_path / "t"))
    assert Y.reached(v, ["vārds"]).count() == 0 and Y.search(v, ["vārds"]).count() == 0


def test_query_against_every_term(spark):
    """Every term of the texts against each word's spellings as one pattern."""
    from lettera import queries as Q

    sf = "/root/testdata/sf0.01"
    pattern = {w: re.compile("|".join("".join(f"(?:{'|'.join(f)})" for f in a) for a in Y.automata(w, False, False))) for w in Q.OLD_WORDS}
    terms = {r.term for r in Q.text_index(spark, sf).postings.select("term").distinct().collect()}
    want = {(w, t) for w, p in pattern.items() for t in terms if p.fullmatch(t)}
    assert {(r.word, r.term) for r in Q.QUERIES["spellings_reached"](spark, sf).collect()} == want and {w for w, _ in want} == set(Q.OLD_WORDS) - {"hāt"}
