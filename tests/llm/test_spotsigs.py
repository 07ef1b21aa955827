import random

import pytest

from docloom.llm import links as L
from docloom.llm import spotsigs as S

from .helpers import ODD, docs, edited
from .test_links import by_links


def corpus(n=40):
    r = random.Random(2)
    rows = []
    for g in range(n // 5):
        base = [r.choice(["the", "is", "of", "a"]) if r.random() < 0.4 else f"w{r.randrange(500)}" for _ in range(100)]
        rows += [(len(rows) + k, " ".join(edited(base, g * 10 + k, 0.02 * k))) for k in range(5)]
    return [*rows, (100, rows[0][1]), (101, rows[0][1].upper()), (102, "no anchors here")]


def sets_of(text, chain=S.CHAIN):
    words = text.lower().split()
    out = set()
    for i, w in enumerate(words):
        if w in S.ANCHORS:
            c = [x for x in words[i + 1 :] if x not in S.COMMON and x not in S.ANCHORS][:chain]
            if len(c) == chain:
                out.add((w, *c))
    return frozenset(out)


def brute(sets, threshold):
    return by_links({(i, s or None) for i, s in sets.items()}, lambda x, y: len(x & y) > 0 and len(x & y) >= threshold * len(x | y))


def chains(text, n=S.CHAIN + 1):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


@pytest.mark.parametrize(("threshold", "block"), [(0.3, 1024), (0.3, 5), (0.5, 1024), (0.5, 3), (0.8, 1024), (1.0, 1024)])
def test_classes_are_those_of_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = [*corpus(), (103, "no anchors here"), (104, "nothing"), (105, "nothing"), (106, "one two three four five six"), (107, "one two three four five six seven"), (108, " ")]
    want = brute({i: sets_of(t) or chains(t) for i, t in rows}, threshold)
    got = sorted(tuple(r) for r in S.similar(docs(spark, rows), threshold=threshold).collect())
    assert got == want and (threshold == 1.0 or sum(n for _, _, n, _ in want) > 10)
    assert dict((r[0], r[1]) for r in got)[103] == 102


def test_sets_of_many_sizes_share_common_spots(spark):
    r = random.Random(5)
    rows = [(i, " ".join(f"the w{x} q r" for x in sorted(r.sample(range(24), r.randrange(1, 24))))) for i in range(80)]
    want = brute({i: sets_of(t) or chains(t) for i, t in rows}, 0.5)
    assert sorted(tuple(x) for x in S.similar(docs(spark, rows)).collect()) == want and sum(n for _, _, n, _ in want) > 200


def test_odd_rows(spark):
    text = "the red fox runs is blue sky high"
    d = docs(spark, [*ODD, (1, text), (1, text), (2, text), (1, None)])
    got = {r.doc_id: tuple(r)[1:] for r in S.similar(d).collect()}
    assert got[1] == got[2] == (1, 1, 1) and got[90] == (90, 0, 0) and set(got) == {1, 2, *range(90, 96)}
    assert S.similar(d.limit(0)).count() == 0
