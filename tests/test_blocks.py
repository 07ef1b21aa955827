"""Document algebra: worked examples and independent models of the folds."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.lists(st.lists(st.text("ab ", max_size=9), max_size=12).map("\n".join), min_size=25, max_size=40)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def packed(text, limit, overlap=None):
    out, cur, n = [], [], 0
    for x in text.split("\n"):
        if n + len(x) + (overlap is not None) > limit and cur:
            out.append("\n".join(cur))
            tail, used = [], 0
            for y in reversed(cur) if overlap is not None else []:
                if used + len(y) > overlap:
                    break
                tail.insert(0, y)
                used += len(y)
            cur, n = tail, used
        cur = [*cur, x]
        n += len(x) + 1
    return [*out, "\n".join(cur)]


def test_line_packer_examples(spark):
    got = column(spark, ["aaaa\nbbbb\ncc", "aaaa\nbbbbb\ncc", "x" * 12 + "\ny", "", "\n\n"], lambda c: B.pack_lines(c, 10))
    assert got == [["aaaa\nbbbb", "cc"], ["aaaa\nbbbbb", "cc"], ["x" * 12, "y"], [""], ["\n\n"]]


def test_overlap_packer_examples(spark):
    assert column(spark, ["aaaa\nbbbb\ncccc"], lambda c: B.pack_overlapping(c, 10, 4)) == [["aaaa\nbbbb", "bbbb\ncccc"]]
    assert column(spark, ["aaaa\nbbbb\ncccc"], lambda c: B.pack_overlapping(c, 10, 3)) == [["aaaa\nbbbb", "cccc"]]
    assert column(spark, ["aa\nbb\ncc\ndd"], lambda c: B.pack_overlapping(c, 9, 4)) == [["aa\nbb\ncc", "bb\ncc\ndd"]]


@FEW
@given(texts)
def test_packers_follow_the_model(spark, values):
    assert column(spark, values, lambda c: B.pack_lines(c, 12)) == [packed(v, 12) for v in values]
    assert column(spark, values, lambda c: B.pack_overlapping(c, 14, 5)) == [packed(v, 14, 5) for v in values]
    assert all("\n".join(p) == v for p, v in zip(column(spark, values, lambda c: B.pack_lines(c, 12)), values))


@pytest.mark.parametrize(("pack", "sizes"), [(B.pack_lines, (12,)), (B.pack_overlapping, (14, 5))])
def test_packers_need_no_python_workers(spark, pack, sizes):
    """Batches of texts in Python took memory by their rows; texts are packed one at a time where they are read."""
    text = "ж" * 9 + "\n" + "😀" * 4 + "\n\n" + "e" * 3
    df = spark.createDataFrame([(0, None), (1, text)], "i int, v string").select("i", pack(F.col("v"), *sizes).alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.p for r in df.collect()} == {0: None, 1: packed(text, *sizes)}


rows = st.lists(st.tuples(st.lists(st.sampled_from(["", "a", "b"]), min_size=1, max_size=3), st.lists(st.sampled_from(["", "a", "b"]), min_size=1, max_size=3)), min_size=30, max_size=40)


def merged(a, b):
    if len(a) != len(b) or not any(b):
        return None
    return [f"{x} {y}".strip() if x and y else x or y for x, y in zip(a, b)]


@FEW
@given(rows)
def test_split_rows(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    assert [r[0] for r in df.orderBy("i").select(B.merge_split_row(F.col("a"), F.col("b"))).collect()] == [merged(a, b) for a, b in pairs]


def stitched(parts):
    done = list(parts[0])
    for more in parts[1:]:
        more = more[1:] if len(more) > 1 and [c.strip() for c in more[0]] == [c.strip() for c in done[0]] else more
        one = merged(done[-1], more[0]) if more else None
        if one is not None:
            done, more = [*done[:-1], one], more[1:]
        done = [*done, *more]
    return done


tables = st.lists(st.lists(st.lists(st.lists(st.sampled_from(["", "a", "h"]), min_size=2, max_size=2), min_size=1, max_size=3), min_size=1, max_size=4), min_size=10, max_size=15)


@FEW
@given(tables)
def test_stitch(spark, sessions):
    df = spark.createDataFrame([(s, i, r) for s, parts in enumerate(sessions) for i, r in enumerate(parts)], "s int, seq int, rows array<array<string>>")
    got = {r.s: r["rows"] for r in B.stitch(df, ["s"]).collect()}
    assert got == {s: stitched(p) for s, p in enumerate(sessions)}


def test_section_numbers(spark):
    cases = {"1.1 Общие": "1.1", "1.1.\tX": "1.1", "1.1 Общие": "1.1", "1.1": "1", "1.10": "1", "12": None, "10.05.2024": "10.05", "2024 год": "2024", "3) x": "3", "": None, None: None}
    assert column(spark, list(cases), T.section_number) == list(cases.values())


def test_scalar_examples(spark):
    assert column(spark, ["Приложение  №1\r\n к\tдоговору "], T.clean) == ["Приложение №1 к\tдоговору"]
    assert column(spark, [None, "ab", "x" * 80, "x" * 81], T.estimate_tokens) == [0, 0, 29, 29]
    assert column(spark, ["Ёлка 12-Б ñandú über ПО №5"], T.tokens) == [["ёлка", "12", "б", "and", "ber", "по", "5"]]
    names = {"Техническое задание (1).pdf": "Техническое_задание_1_.pdf", "Учёт.docx": "Уч_т.docx", "..hidden..": "hidden", "///": "uploaded_document", "a b__c.PDF": "a_b__c.PDF"}
    assert column(spark, list(names), T.safe_name) == list(names.values())
    assert column(spark, ["<&>\"'"], T.html_escape) == ["&lt;&amp;&gt;&quot;&#x27;"]
    assert column(spark, [["abc"], ["x" * 100], ["word " * 12], ["x" * 12], []], B.column_width, "array<string>") == [10, 60, 22, 14, 10]
    assert column(spark, ["a.PDF", ".bashrc", "x", "d/e.tar.gz"], T.extension) == [".pdf", "", "", ".gz"]
    assert column(spark, ["```json\n{}\n```", " {} ", "```"], T.unfence) == ["{}", "{}", ""]


@pytest.mark.parametrize(("prompt", "completion", "model", "cost"), [(1000, 200, "mini", 0.0003), (0, 5, "mini", None), (None, 5, "mini", None), (1000, 1, "other", None), (10, None, "mini", 0.000002)])
def test_llm_cost(spark, prompt, completion, model, cost):
    df = spark.createDataFrame([(model, prompt, completion)], "m string, p long, c long")
    got = df.select(T.llm_cost(F.col("m"), F.col("p"), F.col("c"))).first()[0]
    assert (None if got is None else float(got)) == cost


def test_section_runs(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([None, "1", None, "1", "2", "1"])] + [(1, 0, "1"), (1, 1, "")], "d int, o int, s string")
    got = [(r.d, r.o, r.label, r.run) for r in B.section_runs(df, ["d"], "o", "s").orderBy("d", "o").collect()]
    assert got == [(0, 0, "__header__", 0), (0, 1, "1", 1), (0, 2, "1", 1), (0, 3, "1", 1), (0, 4, "2", 2), (0, 5, "1", 3), (1, 0, "1", 1), (1, 1, "1", 1)]


def test_chunks_drop_short_and_split_long(spark):
    rows = [("d", 0, None, "short", "b0"), ("d", 1, "1", "y" * 60, "b1"), ("d", 2, None, " ", "b2"), ("d", 3, "2", "z" * 1500, "b3"), ("d", 4, None, "w" * 900, "b4")]
    df = spark.createDataFrame(rows, "doc_id string, ord int, section_path string, text string, block_id string")
    got = [(r.chunk_no, r.section_path, r.text_length, r.block_ids) for r in B.section_chunks(df).orderBy("chunk_no").collect()]
    assert got == [(0, "1", 60, ["b1"]), (1, "2", 1500, ["b3", "b4"]), (2, "2#1", 900, ["b3", "b4"])]
