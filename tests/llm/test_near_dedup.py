import numpy as np
import pytest

from docloom.llm import links as L
from docloom.llm import near_dedup as N

from .helpers import ODD, docs, edited, prose
from .test_links import by_links


def corpus():
    rows, n = [], 0
    for g in range(12):
        base = prose(g, 120)
        for k in range(6):
            rows.append((n, " ".join(edited(base, 1000 * g + k, 0.03 * k))))
            n += 1
    rows += [(n + i, rows[0][1]) for i in range(4)]
    return [*rows, *[(200 + i, " ".join(prose(500 + i, 80))) for i in range(20)]]


def agree(x, y, threshold=N.THRESHOLD):
    return (np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum() >= threshold


def brute(spark, d, k=N.SHINGLE, threshold=N.THRESHOLD):
    members = {(r.id, None if r.sig is None else bytes(r.sig)) for r in N.signatures(d, k=k).collect()}
    return by_links(members, lambda x, y: agree(x, y, threshold))


def rows(found):
    return sorted(tuple(r) for r in found.collect())


def test_classes_are_those_of_brute_force(spark):
    d = docs(spark, corpus())
    want = brute(spark, d)
    assert rows(N.near_classes(d)) == want and sum(n for _, _, n, _ in want) > 60


@pytest.mark.parametrize("block", [1024, 7])
def test_lower_threshold_with_many_collisions(spark, monkeypatch, block):
    """Long posting lists, whole or in blocks."""
    monkeypatch.setattr(L, "BLOCK", block)
    d = docs(spark, [(i, " ".join(prose(i, 60, 25))) for i in range(60)])
    want = brute(spark, d, 1, 20)
    assert rows(N.near_classes(d, threshold=20, k=1)) == want and sum(n for _, _, n, _ in want) > 100


def test_hot_coordinate(spark):
    """6,000 different documents that share a third of their words: one hot posting list, cut in blocks, and no link."""
    d = spark.range(6_000).selectExpr("id AS doc_id", "concat('same words stand here ', id, ' ', id * 7, ' ', id * 13, ' ', id * 17, ' ', id * 19, ' x', id * 3) AS text")
    got = N.near_classes(d, k=1).selectExpr("count(*) AS n", "count(DISTINCT class_id) AS c", "max(n_links) AS m").first()
    assert got.n == 6_000 and got.c >= 5_900


def test_signature_estimates_jaccard(spark):
    a, b = prose(1, 2000, 10**6), prose(1, 2000, 10**6)
    b[:200] = prose(2, 200, 10**6)
    x, y = (np.frombuffer(r.sig, "<u4") for r in N.signatures(docs(spark, [(1, " ".join(a)), (2, " ".join(b))])).orderBy("id").collect())
    assert abs((x == y).mean() - 1800 / 2200) < 0.2


def test_one_of_each_group_stays(spark):
    texts = corpus()
    d = docs(spark, [*texts, *ODD, (300, texts[0][1]), (300, texts[0][1]), (301, "alone here now"), (301, "alone here now")])
    kept = N.deduplicated(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(200, 220)) <= set(ids) and 300 not in ids and ids.count(301) == 1 and {None, 90, 91, 92} <= set(ids) and 95 in ids
    assert {i for i in ids if i is not None and i < 90} == {c for _, c, *_ in brute(spark, docs(spark, texts)) if c < 90}


def test_odd_rows(spark):
    d = docs(spark, [*ODD, (1, "a b c d"), (1, "a b c d"), (1, "other text of it"), (2, "a b c d")])
    want = brute(spark, d)
    assert rows(N.near_classes(d)) == want and {r[:2] for r in want} >= {(1, 1), (2, 1), (90, 90), (92, 92)}
    assert N.near_classes(d.limit(0)).count() == 0 and N.deduplicated(d.limit(0)).count() == 0
    clash = d.withColumnsRenamed({"lang": "class_id", "source": "place", "id": "c1"})
    assert N.deduplicated(clash).columns == clash.columns and N.deduplicated(clash).count() == N.deduplicated(d).count()
