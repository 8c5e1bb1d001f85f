import json
import random

import pytest

from lettera.operators import answers as V
from lettera.operators.documents import Site
from lettera.sources import parsers as P

SITE = Site(issue=(r"/issue/(\w+)",), article=(r"/article/(\w+)",), page=(r"page=(\d+)",))
NAMES = "id pos url title snippet issue_id article_id page".split()


def by_python(i, base, text):
    """Every hit by the walk of Python objects, with the members of objects in order."""
    ordered = json.dumps(json.loads(text), sort_keys=True) if text else text
    for pos, h in enumerate(P.json_hits(ordered, base)):
        ids = SITE.ids(h["ids_in"])
        yield i, pos, h["url"], h["title"], h["snippet"], ids["issue_id"], ids["article_id"], int(ids["page"]) if ids["page"] else None


def run(spark, rows):
    got = V.hits(spark.createDataFrame(rows, "id long, url string, text string"), SITE).select(NAMES).collect()
    return sorted(map(tuple, got), key=lambda r: r[:2])


def test_trees_against_a_walk_of_objects(spark):
    r = random.Random(7)
    keys = ["id", "URL", "url", "href", "title", "Label", "name", "text", "snippet", "x", "items", "identifier"]
    leaf = lambda: r.choice(["", "s", "/article/a1?page=3", "http://o/issue/i%20x", 7, 0, None, True, False, "z" * 500, "../up", "ā\"b", -3, 2.5])

    def tree(depth):
        kind = r.random()
        if depth == 0 or kind < 0.25:
            return leaf()
        if kind < 0.55:
            return [tree(depth - 1) for _ in range(r.randint(0, 3))]
        return {k: leaf() if k != "items" else tree(depth - 1) for k in r.sample(keys, r.randint(0, 6))} | {f"k{i}": tree(depth - 1) for i in range(r.randint(0, 2))}

    rows = [(i, "http://s/a/b?q", json.dumps({"top": tree(9), "list": [tree(5)]})) for i in range(400)]
    want = [h for row in rows for h in by_python(*row)]
    got = run(spark, rows)
    assert len(want) > 300 and got == want


def test_depth_and_odd_answers(spark):
    deep = "[" * 6 + '{"id": 1, "title": "t"}' + "]" * 6
    rows = [(1, "http://s/", deep), (2, "http://s/", f"[{deep}]"), (3, None, None), (4, "http://s/", ""), (5, "http://s/", "{"), (6, "http://s/", ' \n[{"id": 1, "id": "/issue/a", "title": "t"}]'),
            (7, "http://s/x/", "<a href='/issue/i1?page=2'>One <b>x</b></a><a href='/about'>no</a>"), (8, "http://s/", "[]"), (9, "http://[", '{"url": "//[x", "name": "n"}'), (10, None, '{"url": "a", "name": "n"}')]
    assert run(spark, rows) == [(1, 0, "http://s/1", "t", "", "", "", None), (6, 0, "http://s/issue/a", "t", "", "a", "", None), (7, 0, "http://s/issue/i1?page=2", "One x", "", "i1", "", 2), (9, 0, "//[x", "n", "", "", "", None), (10, 0, "a", "n", "", "", "", None)]


def test_ids_of_a_hit_without_url(spark):
    assert run(spark, [(1, "http://s/", '{"identifier": "/article/b2", "heading": "h"}')]) == [(1, 0, "", "", "", "", "b2", None)]


def test_a_long_answer(spark):
    """A list of many hits in one answer."""
    text = json.dumps([{"url": f"/issue/{i}", "title": "t" * 20, "in": {"k": [1, 2, 3]}} for i in range(20_000)])
    got = run(spark, [(1, "http://s/", text)])
    assert len(got) == 20_000 and got[-1] == (1, 19_999, "http://s/issue/19999", "t" * 20, "", "19999", "", None)


def test_merged(spark):
    answers = [(1, "http://s/", '[{"url": "/a", "title": "first"}, {"url": "/b", "title": "b"}, {"Id": "", "title": "nothing"}]'), (2, "http://s/", '[{"url": "/a", "title": "again"}, {"identifier": "/article/x", "title": "by id"}, {"url": "/c", "title": "c"}]'), (3, "http://s/", '[{"url": "/a", "title": "other query"}]')]
    asked = spark.createDataFrame([(1, "q", 1, "old"), (2, "q", 0, "q"), (3, "p", 0, "p")], "id long, query string, turn int, matched_query string")
    found = V.hits(spark.createDataFrame(answers, "id long, url string, text string"), SITE)
    rows = lambda n: sorted((r.query, r["rank"], r.matched_query, r.title) for r in V.merged(found, asked, limit=n).collect())
    assert rows(25) == [("p", 1, "p", "other query"), ("q", 1, "q", "again"), ("q", 2, "q", "by id"), ("q", 3, "q", "c"), ("q", 4, "old", "b")]
    assert rows(2) == [("p", 1, "p", "other query"), ("q", 1, "q", "again"), ("q", 2, "q", "by id")]


@pytest.mark.parametrize("schema", ["id long, url string, text string"])
def test_no_answers(spark, schema):
    assert V.hits(spark.createDataFrame([], schema), Site()).count() == 0
