import random
import re

import pytest

from docloom.llm import substring_dedup as S

from .helpers import ODD, docs, prose

N = S.PHRASE + S.WINDOW - 1


def brute(rows):
    """Rows of passages() by definition, from a dictionary of all windows."""
    held, places = {}, {}
    for key in {(i, t) for i, t in rows if i is not None and t is not None}:
        places[key] = [m.span() for m in re.finditer(r"[^ \t\n\r\f\v]+", key[1])]
        words = [key[1][s:e] for s, e in places[key]]
        for w in range(len(words) - N + 1):
            held.setdefault(tuple(words[w : w + N]), []).append((key, w))
    own = {}
    for found in held.values():
        ids = {key[0] for key, _ in found}
        if len(ids) > 1:
            for key, w in found:
                own.setdefault((key, min(ids)), []).append(w)
    out = []
    for (key, first), starts in own.items():
        joined = []
        for w in sorted(starts):
            if joined and w <= joined[-1][1]:
                joined[-1][1] = w + N
            else:
                joined.append([w, w + N])
        out += [(key[0], first, places[key][a][0], places[key][b - 1][1], b - a) for a, b in joined]
    return sorted(out)


def got(spark, rows):
    return sorted(tuple(r) for r in S.passages(docs(spark, rows)).collect())


def planted(seed=3, n=60):
    r = random.Random(seed)
    passages = [prose(900 + i, k) for i, k in enumerate((32, 36, 50, 51, 60, 75, 120, 52, 51, 300))]
    rows = []
    for d in range(n):
        words = prose(1000 * seed + d, r.randrange(0, 300))
        for p in r.sample(range(len(passages)), r.choice((0, 1, 2, 3))):
            at, a, b = r.randrange(0, len(words) + 1), r.choice((0, 0, 5)), r.choice((0, 0, 7))
            words[at:at] = passages[p][a : len(passages[p]) - b]
        rows.append((d, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [3, 4])
def test_rows_are_those_of_brute_force(spark, monkeypatch, seed):
    """First documents included, whatever the sizes of shards, parts and rows."""
    rows = planted(seed)
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 30 and any(a == b for a, b, *_ in want)
    for name, value in (("PHRASES_PER_SHARD", 2), ("DOCS_PER_TASK", 3), ("WINDOWS_PER_ROW", 40), ("WINDOWS_PER_PART", 30)):
        monkeypatch.setattr(S, name, value)
    assert got(spark, rows) == want


def test_periodic_and_pooled_texts(spark):
    r = random.Random(8)
    pool = [prose(i, 70, 12) for i in range(6)]
    rows = [(d, " ".join(w for _ in range(3) for w in r.choice(pool)[r.randrange(15) :])) for d in range(14)]
    rows += [(50, "a " * 200), (51, "a " * 90), (52, "a b " * 100), (53, "b a " * 40)]
    assert got(spark, rows) == brute(rows)


def test_long_words_blanks_and_scripts(spark):
    p, q = [f"{'x' * 55}{i:05d}" for i in range(70)], [f"слово{i}" for i in range(60)]
    rows = [(1, " ".join([*prose(1, 30), *p, *prose(2, 30)])), (2, " ".join([*prose(3, 30), *p, *prose(4, 30)]))]
    rows += [(3, "  ".join(q)), (4, "\n\t ".join(["é", *q, "日本"])), (5, " ".join(q))]
    found = got(spark, rows)
    assert found == brute(rows) and {(r[0], r[4]) for r in found} == {(1, 70), (2, 70), (3, 60), (4, 60)}


def test_one_id_with_two_texts_and_repeated_rows(spark):
    p, other = prose(1, 60), prose(7, 400)
    a, b = " ".join([*prose(2, 40), *p]), " ".join(other)
    rows = [(1, " ".join(p)), (2, a), (2, b), (2, b), (3, " ".join(p)), (3, " ".join(p)), (4, " ".join([*other[:20], *prose(9, 30)])), *ODD]
    assert got(spark, rows) == brute(rows) and {r[0] for r in brute(rows)} == {1, 2, 3}
    kept = S.cut(docs(spark, rows)).collect()
    assert sorted(r.text for r in kept if r.doc_id == 2) == sorted([" ".join(prose(2, 40)) + " ", b, b])


def test_phrases_alone_are_no_passage(spark):
    p = prose(1, 50)
    rows = [(i, " ".join([*prose(10 + i, 60), *p, *prose(50 + i, 60)])) for i in range(12)]
    assert got(spark, rows) == []


def test_long_owner_is_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "PHRASES_PER_SHARD", 20)
    text = prose(1, 5000, 10**6)
    rows = [(1, " ".join(text)), (2, " ".join(text[1000:3000])), (3, " ".join(text[2500:]))]
    found = docs(spark, rows)
    assert sorted(tuple(r) for r in S.passages(found).collect()) == brute(rows)


def test_cut(spark):
    p, q = prose(1, 60), prose(2, 100)
    d = docs(spark, [(1, " ".join(p)), (2, " ".join([*q[:50], *p, *q[50:]])), (3, " ".join(p)), *ODD])
    left = {r.doc_id: r for r in S.cut(d).collect()}
    assert S.cut(d).columns == d.columns and 3 not in left and left[1].text == " ".join(p)
    assert left[2].text.split() == q and left[2].n_chars == len(left[2].text)
    assert {None, 90, 91, 92, 93, 94, 95} <= set(left) and left[90].text is None
    clash = d.withColumnsRenamed({"lang": "cuts", "source": "tk", "id": "c1"})
    assert S.cut(clash).columns == clash.columns and S.cut(clash).count() == len(left)


def test_empty(spark):
    d = docs(spark, ODD)
    assert S.passages(d.limit(0)).count() == 0 and S.passages(d).count() == 0 and S.cut(d.limit(0)).count() == 0
