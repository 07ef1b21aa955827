import numpy as np
import pyarrow.parquet as pq
import pytest

from docloom.llm import ann as A

from ..conftest import SF


def recall(rows, ids, vectors, every, k=A.K):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids)}
    asks = [i for i in ids if i % every == 0]
    hits = dict.fromkeys(asks, 0)
    s = unit[[at[i] for i in asks]] @ unit.T
    s[np.arange(len(asks)), [at[i] for i in asks]] = -9
    worst = dict(zip(asks, np.sort(s, 1)[:, -k]))
    row = {i: n for n, i in enumerate(asks)}
    for r in rows:
        hits[r.vec_id] += s[row[r.vec_id], at[r.neighbour]] >= worst[r.vec_id] - 1e-5
    return np.mean([min(h, k) / k for h in hits.values()])


@pytest.mark.parametrize(("every", "sizes"), [(1, {}), (20, {"enough": 3000, "per_block": 200, "per_task": 300})])
def test_recall(spark, every, sizes):
    """With production sizes, and with many blocks, spread blocks and homes."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    rows = A.neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), every=every, **sizes).collect()
    ids, v = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy())
    assert recall(rows, ids, v, every) >= 0.9
    each = {}
    for r in rows:
        each.setdefault(r.vec_id, []).append((r.rank, r.neighbour, r.cosine))
    assert set(each) == {i for i in ids.tolist() if i % every == 0}
    for q, found in each.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(found) + 1)) and len({x[1] for x in found}) == len(found) == A.K and q not in {x[1] for x in found}
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))


def test_query_over_a_small_table_is_exact(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    v = np.stack(t["embedding"].to_numpy()).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    got = {}
    for r in A.query(spark, SF).collect():
        got.setdefault(r.vec_id, []).append(r.cosine)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    assert set(got) == {q for q in t["vec_id"].to_pylist() if q % A.EVERY == 0}
    for i, q in enumerate(t["vec_id"].to_pylist()):
        if q in got:
            assert np.allclose(sorted(got[q], reverse=True), np.sort(s[i])[::-1][: A.K], atol=1e-5)


def test_labels_collide_as_cosines_do():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 64)).astype(np.float32)
    y = x + 0.5 * rng.standard_normal((3000, 64)).astype(np.float32)
    first = lambda v: A.labels(v / np.linalg.norm(v, axis=1, keepdims=True), 0) >> (A.BITS - A.SYMBOL_BITS)
    assert (first(x) == first(y)).mean() > 0.4 and abs((first(x) == first(rng.permutation(x))).mean() - 1 / 32) < 0.02


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0]), (8, [float("nan"), 1.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (4, [0.0, 1.0]),
    ]
    d = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<float>, id string, block int, code string")
    got = {}
    for r in A.neighbours(d, k=2).collect():
        assert r.rank not in got.setdefault(r.vec_id, {})
        got[r.vec_id][r.rank] = r.neighbour
    assert got == {1: {1: 2, 2: 3}, 2: {1: 1, 2: 3}, 3: {1: 1, 2: 2}, 4: {1: 1, 2: 2}}
    assert {(r.vec_id, r.neighbour) for r in A.neighbours(d, k=2, every=2).collect()} == {(2, 1), (2, 3), (4, 1), (4, 2)}
    assert A.neighbours(d.limit(0)).count() == 0
    assert A.neighbours(d.where("vec_id = 1")).count() == 0


def test_many_equal_vectors(spark):
    """Copies answer by their least ids, and an id's several vectors count as one neighbour."""
    d = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(300)] + [(400, [0.0, 1.0]), (401, [1.0, 0.0]), (401, [0.9, 0.2]), (401, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {}
    for r in A.neighbours(d, k=4).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour))
    assert sorted(got[2]) == [(1, 0), (2, 1), (3, 3), (4, 4)] and sorted(got[299]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert {n for _, n in got[400]} == {401, 0, 1, 2} and len(got[401]) == 12
