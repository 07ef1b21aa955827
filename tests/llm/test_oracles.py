"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from docloom.llm import queries

from ..conftest import SF
from ..test_catalog import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall()) and got
