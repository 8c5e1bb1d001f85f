"""Tables whose columns have the operators' own names, and texts whose work must stay in proportion to their length."""

import time

import pytest

from lettera.llm.decontam import drop_contaminated
from lettera.llm.langid import identify
from lettera.llm.license_scan import TEMPLATES, inverted_index, scan_text

ITEM = "one two three four five six seven eight nine ten"


def test_decontamination_keeps_columns_of_its_own_names(spark):
    rows = [(1, "clean text", "spans", 5, "items", True), (2, f"x {ITEM} y", "s", 6, "i", False), (3, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hit_spans string, N_Words int, hit_items string, hit_whole boolean")
    got = drop_contaminated(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert got.dtypes == docs.dtypes and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_identification_ignores_columns_of_its_own_names(spark):
    rows = [(k, f"{w} text words {k}", lang, 1.0, "i", "t") for k in range(40) for w, lang in (("hello", "en"), ("bonjour", "fr"))]
    found = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, share double, id string, t string"))
    assert found.columns == ["doc_id", "lang_pred", "score"] and {r.lang_pred for r in found.collect()} == {"en", "fr"}


@pytest.mark.parametrize("unit", ["this license the software the license of the program ", TEMPLATES["GPL-3.0", "header"] + " and then ", "copies of the software and to permit persons to "])
def test_license_scans_take_time_in_proportion(unit):
    import numpy as np

    ready, index = inverted_index(TEMPLATES)
    keys, took = np.array(sorted(index), np.uint64), []
    for n in (40, 40, 320):
        t = time.process_time()
        found = scan_text(unit * n, ready, index, keys, 0.8)
        took.append(time.process_time() - t)
        assert len(found) == (n if unit.startswith("This program") else 0)
    assert took[2] < 16 * max(took[1], 0.02)
