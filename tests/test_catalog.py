"""Every query of the engine against its SQL in DuckDB."""

from collections import Counter

import duckdb
import numpy as np
import pytest

from docloom.plans import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v != v:
        return None
    if isinstance(v, (float, np.floating)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalog.ORACLES:
        assert sum(got.values()) > 0
        return
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert got == want
