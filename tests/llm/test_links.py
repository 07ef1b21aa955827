import itertools

import numpy as np

from docloom.llm import links as L


def by_links(members, linked):
    """Rows of classes() by definition: members {(id, h)}, linked(h, other)."""
    parent, docs = {m: m for m in members}, sorted(members, key=str)

    def root(m):
        while parent[m] != m:
            m = parent[m]
        return m

    n, copies = dict.fromkeys(docs, 0), dict.fromkeys(docs, 0)
    for x, y in itertools.combinations(docs, 2):
        if x[1] is None or y[1] is None:
            continue
        same = x[1] == y[1]
        if same or linked(x[1], y[1]):
            for m in (x, y):
                n[m] += 1
                copies[m] += same
            parent[root(x)] = root(y)
    least = {}
    for m in docs:
        least[root(m)] = min(m[0], least.get(root(m), m[0]))
    return sorted((m[0], least[root(m)], n[m], copies[m]) for m in docs)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (20, 21), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (40, 40)]
    got = {r.id: r.root for r in L.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 9), 1), **dict.fromkeys((20, 21), 20), **dict.fromkeys(range(30, 36), 30)}


def test_united_joins_chains_and_stars():
    rng = np.random.default_rng(1)
    for n in (2, 30, 200):
        i, j = rng.integers(0, n, (2, n))
        got = L.united(np.arange(n), i, j)
        label = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                label[a] = label[b] = min(label[a], label[b])
        assert (got == label).all()
