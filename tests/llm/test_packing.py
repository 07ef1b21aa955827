import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import packing

from ..conftest import SF
from .helpers import ODD, docs, prose


def test_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {tuple(r) for r in c.execute(packing.SQL).fetchall()}
    assert {tuple(r) for r in packing.query(spark, SF).select("doc_id", "piece", "bucket", "start", "n_tokens", "text", "batch", "slot").collect()} == want


@pytest.mark.parametrize("top", [0, 3, 13])
def test_round_trip_and_lengths(spark, top):
    texts = {1: " a b\n c ", 2: " ".join(prose(1, 37)), 3: "x", **{i: t for i, t in ODD if i}}
    rows = packing.pack(docs(spark, list(texts.items())), max_log2=top, tokens_per_batch=8, docs_per_slice=3).collect()
    for i, t in texts.items():
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        n = len((t or "").replace(" ", " ").split())
        assert "".join(r.text for r in mine) == (t if n else "")
        want = [1 << top] * (n >> top) + [1 << b for b in range(top - 1, -1, -1) if n >> b & 1]
        assert [r.n_tokens for r in mine] == want and [1 << r.bucket for r in mine] == want
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    for b in batches.values():
        assert len({r.n_tokens for r in b}) == 1 and sorted(r.slot for r in b) == list(range(len(b)))
        assert len(b) == 1 or sum(r.n_tokens for r in b) <= 8


def test_token_arrays(spark):
    df = spark.createDataFrame([(1, list(range(13))), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = packing.pack(df, tokens_col="ids", max_log2=2).orderBy("piece").collect()
    assert [r.tokens for r in got] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12]] and [r.start for r in got] == [0, 4, 8, 12]


def test_odd_rows(spark):
    d = docs(spark, [*ODD, (1, "a b"), (1, "a b")])
    got = packing.pack(d)
    assert got.where("doc_id IS NULL").count() == 1 and got.where("doc_id = 1").count() == 2 and got.where("doc_id IN (90, 91, 92)").count() == 0
    assert packing.pack(d.limit(0)).count() == 0
    assert got.where("doc_id = 95").select(F.length("text")).first()[0] == 300_000
