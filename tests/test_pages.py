"""Blocks of pages: a worked example with odd elements, and how often the plan shuffles."""

import pytest

from docloom.operators import pages as P
from docloom.plans.catalog import QUERIES

from .conftest import SF

T1, T2 = [["h", "k"], ["a", None]], [["h ", "k"], ["", "b"], ["c ", "d"]]
ELEMENTS = [
    (1, 1, "table", 0, 1, None, T1), (1, 2, "table", 0, 2, None, T2), (1, 2, "table", 1, 3, None, []), (1, 2, "table", 2, 4, None, [["w", "i", "d", "e"], ["", " ", "x", ""]]),
    (1, 3, "scan", 0, 5, None, None), (1, 3, "scan", 0, 6, None, None), (1, 4, "note", 0, 7, "n", None), (1, 2, "text", 1, 8, "1.2 t", None), (1, 1, "text", 0, 9, "u", None),
    (2, 5, "scan", 0, 2, None, None), (2, 1, "scan", 0, 1, None, None), (3, 2, "table", 0, 1, None, [["z", "z"]]), (3, 6, "note", 0, 2, "n", None),
]


def elements(spark):
    return spark.createDataFrame(ELEMENTS, "doc_id long, page int, kind string, top int, seq int, content string, raw_rows array<array<string>>")


def test_page_blocks(spark):
    got = {}
    for r in P.page_blocks(elements(spark)).collect():
        rows = r["rows"] and [(x.row_type, *x.cells) for x in r["rows"]]
        got[r.block_id] = (r.ord, r.type, r.page, r.page_end, r.content, r.section_path, r.col_count, rows, r.ocr_status)
    assert got == {
        "1_b001": (0, "text", 1, None, "u", None, None, None, None),
        "1_tbl_001": (1, "table", 1, 2, None, None, 2, [("header", "h", "k"), ("data", "a", "b"), ("data", "c", "d")], None),
        "1_b003": (2, "text", 2, None, "1.2 t", "1.2", None, None, None),
        "1_tbl_002": (3, "table", 2, 4, None, "1.2", 4, [("header", "w", "i", "d", "e"), ("section", "", "", "x", "")], None),
        "1_scan_003": (4, "image", 3, None, None, None, None, None, "pending"),
        "2_scan_001": (0, "image", 1, None, None, None, None, None, "pending"),
        "2_scan_005": (1, "image", 5, None, None, None, None, None, "pending"),
        "3_tbl_001": (0, "table", 2, 6, None, None, 2, [("header", "z", "z")], None),
    }
    images = {(r.doc_id, r.ord, r.block_id, r.page) for r in P.scan_blocks(elements(spark)).collect()}
    assert images == {(int(k[0]), v[0], k, v[2]) for k, v in got.items() if v[1] == "image"}


@pytest.mark.parametrize("name", ["page_blocks", "scan_blocks"])
def test_one_pass(spark, name):
    """Elements are read, shuffled and numbered once: no joins of a document's parts."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "Join" not in plan
