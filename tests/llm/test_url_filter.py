import random

import duckdb
from pyspark.sql import functions as F

from docloom.llm import url_filter as U

from ..conftest import SF


def whole(glob, text):
    """Whether the glob covers the text, by the table of (prefix of glob, prefix of text)."""
    parts, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            parts.append(("is", glob[i]))
        else:
            parts.append(("any", "") if c == "*" else ("one", "") if c == "?" else ("is", c))
        i += 1
    row = [True] + [False] * len(text)
    for kind, c in parts:
        new = [row[0] and kind == "any"]
        for j, x in enumerate(text):
            new.append(row[j + 1] or new[j] if kind == "any" else row[j] and (kind == "one" or x == c))
        row = new
    return row[-1]


def test_automaton_against_regular_expressions():
    r = random.Random(1)
    globs = ["", "*", "?", "**", "a*", "*a", "\\*", "\\", "a?b", "é*", "*日?"] + ["".join(r.choice("ab*?") for _ in range(r.randrange(1, 40))) for _ in range(60)]
    texts = ["", "a", "*", "\\", "é", "éab", "x日b", "\n"] + ["".join(r.choice("abc") for _ in range(r.randrange(0, 60))) for _ in range(100)]
    got = U.Automaton([(i, g, "block") for i, g in enumerate(globs)]).matches(texts)
    assert U.Automaton([(i, g, "block") for i, g in enumerate(globs)]).words > 5
    for j, g in enumerate(globs):
        for i, t in enumerate(texts):
            assert got[i, j] == whole(g, t), (g, t)


def test_no_rules():
    assert U.Automaton([]).matches(["a", ""]).shape == (2, 0)


def test_canonical(spark):
    cases = {
        " HTTP://Ex.ORG:80/A?utm_source=x&b=1#f ": "http://ex.org/A?b=1", "https://a.b:443": "https://a.b/", "https://a.b?q=1": "https://a.b/?q=1", "http://a/?a=1&utm_x=2": "http://a/?a=1",
        "http://a/?utm_a=1&utm_b=2": "http://a/", "no scheme": "no scheme", "": "", None: None, "http://a:8080/x?b": "http://a:8080/x?b",
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(U.canonical(F.col("u"))).collect()] == list(cases.values())


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = {r[0]: r[1:] for r in c.execute(U.SQL).fetchall()}
    got = {r.page_id: (r.canonical, r.rules, r.blocked) for r in U.query(spark, SF).collect()}
    assert got == want


def test_odd_rows(spark):
    rules = [(1, "*bad*", "block"), (2, "*good*", "allow"), (2, "*fine*", "allow"), (3, "", "block")]
    urls = [(1, None), (2, ""), (None, "http://bad/"), (3, "http://bad/good"), (4, "http://bad/" + "x" * 100_000), (4, "http://a/"), (5, "http://é/bad"), (6, "http://good/fine")]
    d = spark.createDataFrame([(i, u, "x", 1, "y") for i, u in urls], "page_id long, url string, canonical string, rules int, blocked string")
    got = [(r.page_id, r.rules, r.blocked) for r in U.filtered(d, rules=rules).collect()]
    assert sorted(got, key=repr) == sorted([(1, [], False), (2, [3], True), (None, [1], True), (3, [1, 2], False), (4, [1], True), (4, [], False), (5, [1], True), (6, [2], False)], key=repr)
    assert U.filtered(d.limit(0)).count() == 0
