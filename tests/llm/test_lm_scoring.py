import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.llm import lm_scoring as L

from .helpers import ODD, docs, prose


class Katz:
    """The model straight from its definition, over words; the unknown token is one more, so no context has seen all."""

    def __init__(self, texts, order=L.ORDER, k=L.GT_MAX):
        self.order = order
        counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for g in self.grams(t):
                for n in range(1, order + 1):
                    counts[n][g[order - n :]] += 1
        self.kinds = max(1, len(counts[1])) + 1
        self.after, self.d = [{} for _ in counts], [None]
        for n in range(1, order + 1):
            for g, c in counts[n].items():
                self.after[n].setdefault(g[:-1], {})[g[-1]] = c
            number = Counter(counts[n].values())
            self.d.append(L.discounts([number[r] for r in range(1, k + 2)]))
        self.known = {}

    def grams(self, t):
        s = ["<"] * (self.order - 1) + t.split() + [">"]
        return [tuple(s[i - self.order + 1 : i + 1]) for i in range(self.order - 1, len(s))]

    def seen(self, h):
        if h not in self.known:
            n = len(h) + 1
            found = self.after[n][h]
            total = sum(found.values())
            kept = {w: c * (self.d[n][c - 1] if c <= len(self.d[n]) else 1.0) for w, c in found.items()}
            base = total + (sum(kept.values()) >= total)
            p = {w: x / base for w, x in kept.items()}
            self.known[h] = p, (1 - sum(p.values())) / (1 - sum(self.p(h[1:], w) if h else 1 / self.kinds for w in found))
        return self.known[h]

    def p(self, h, w):
        lower = lambda: self.p(h[1:], w) if h else 1 / self.kinds
        if h not in self.after[len(h) + 1]:
            return lower()
        p, alpha = self.seen(h)
        return p[w] if w in p else alpha * lower()

    def log(self, t):
        return sum(math.log(self.p(g[:-1], g[-1])) for g in self.grams(t))


@pytest.fixture(scope="module")
def texts():
    return [" ".join(prose(i % 40, 30, 12)) for i in range(60)] + ["a b c", "a  b\tc", "", " ", "c b a", "é日 ñ"] + ["x y"] * 8


@pytest.fixture(scope="module")
def model(spark, texts):
    return L.train(docs(spark, list(enumerate(texts))))


def test_other_texts_back_off_as_defined(spark, texts, model):
    katz = Katz(texts)
    new = [*texts[:5], "zzz q", "a b zzz", "w1 w2 日本 w3", "b a c b", "x y x y", ""]
    assert katz.p(("a", "b"), "zzz") != katz.p(("zzz",), "zzz")
    got = {r.doc_id: r for r in L.score(docs(spark, list(enumerate(new))), model).collect()}
    for i, t in enumerate(new):
        assert got[i].n_tokens == len(t.split()) + 1
        assert got[i].logprob == pytest.approx(katz.log(t), abs=1e-9)
        assert got[i].perplexity == pytest.approx(math.exp(-katz.log(t) / got[i].n_tokens))


def test_every_context_sums_to_one(texts):
    """The definition's own probabilities over all kinds of tokens, which the tables equal by the test above."""
    katz = Katz(texts)
    kinds = [*katz.after[1][()], "unknown"]
    assert len(kinds) == katz.kinds
    for h in [(), *list(katz.after[2])[:30], *list(katz.after[3])[:60], ("nowhere", "a")]:
        assert sum(katz.p(h, w) for w in kinds) == pytest.approx(1, abs=1e-9)


def test_tables_are_partitioned(spark, texts, monkeypatch, model):
    monkeypatch.setattr(L, "ROWS_PER_PARTITION", 50)
    kinds, tables = L.train(docs(spark, list(enumerate(texts))))
    assert kinds == model[0] and len(tables[-1][0].inputFiles()) > 3
    for (g, c), (g2, c2) in zip(tables, model[1]):
        for x, y in ((g, g2), (c, c2)):
            assert x.select(F.round("v", 9)).exceptAll(y.select(F.round("v", 9))).count() == 0 and x.count() == y.count()


def test_discounts():
    d = L.discounts([100, 50, 30, 20, 12, 8])
    assert len(d) == 5 and all(0 < x <= 1 for x in d)
    assert L.discounts([0, 0, 0, 0, 0, 0]) == [1.0] * 5


@pytest.mark.parametrize("sizes", [(), (("PART_BYTES", 500), ("RUN_BYTES", 100), ("GROUP_BYTES", 700))])
def test_own_scores_are_those_of_the_definition(spark, monkeypatch, texts, sizes):
    for name, value in sizes:
        monkeypatch.setattr(L, name, value)
    katz = Katz([*texts, "a b c", "a b c"])
    got = L.own_scores(docs(spark, [*enumerate(texts), (900, "a b c"), (900, "a b c"), (901, None)])).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r.doc_id] if r.doc_id < 900 else "a b c"
        assert r.n_tokens == len(t.split()) + 1
        assert r.logprob == pytest.approx(katz.log(t), abs=1e-9)
        assert r.perplexity == pytest.approx(math.exp(-katz.log(t) / r.n_tokens))
    few = ["p q r", "p q r", "s t"]  # nothing is discounted here, so all contexts count an unseen token
    katz = Katz(few)
    assert katz.d[3] == [1.0] * L.GT_MAX
    assert {r.doc_id: r.logprob for r in L.own_scores(docs(spark, list(enumerate(few)))).collect()} == pytest.approx({i: katz.log(t) for i, t in enumerate(few)})


def test_own_scores_are_those_of_train_and_score(spark, texts):
    d = docs(spark, [*enumerate(texts), *ODD, (900, "a b c"), (900, "a b c")])
    rows = lambda found: sorted((r.doc_id, r.n_tokens, round(r.logprob, 7)) for r in found.collect())
    assert rows(L.own_scores(d)) == rows(L.score(d, L.train(d)))


def test_odd_rows(spark, model):
    d = docs(spark, [*ODD, (1, "a b"), (1, "a b")])
    got = L.own_scores(d).collect()
    by = {r.doc_id: r for r in got}
    assert None not in by and 90 not in by and by[91].n_tokens == by[92].n_tokens == 1 and sum(r.doc_id == 1 for r in got) == 2 and by[95].n_tokens == 2
    assert L.own_scores(d.limit(0)).count() == 0 and L.score(d.limit(0), model).count() == 0
    empty = L.train(d.limit(0))
    assert [r for r in L.score(d, empty).collect() if r.doc_id == 93][0].logprob == pytest.approx(-2 * math.log(2))


def test_query_tells_word_order_and_grows_with_the_words(spark, tmp_path):
    """Sentences of the same words in another order, and ones that repeat, are told apart, which three bytes of context can't do."""
    common = [f"the {x} saw the {y}" for x in ("dog", "cat", "cow") for y in ("dog", "cat", "cow")] * 6
    docs(spark, [*enumerate(common), (900, "saw the dog the cat")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.query(spark, str(tmp_path)).collect()}
    assert got[900].n_tokens == 6
    assert got[900].bits_per_token > got[1].bits_per_token


def test_query_scores_by_a_model_that_backs_off(spark, tmp_path, monkeypatch, texts):
    """The query's scores are looked up in tables of all orders with weights, which give other texts what the definition does."""
    made, used = [], []
    train, score = L.train, L.score
    monkeypatch.setattr(L, "train", lambda *a, **b: made.append(train(*a, **b)) or made[-1])
    monkeypatch.setattr(L, "score", lambda d, m, *a, **b: used.append(m) or score(d, m, *a, **b))
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    katz = Katz(texts)
    got = {r.doc_id: r.logprob for r in L.query(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({i: katz.log(t) for i, t in enumerate(texts)}, abs=6e-4)
    assert len(made) == 1 and used[0] is made[0]
    new = ["zzz q", "a b zzz", "b a c b", texts[0][:40] + " zzz"]
    found = {r.doc_id: r.logprob for r in score(docs(spark, list(enumerate(new))), made[0]).collect()}
    assert found == pytest.approx({i: katz.log(t) for i, t in enumerate(new)}, abs=1e-9)


def test_packed_tables_with_few_common_words_and_spread_contexts(spark, monkeypatch, texts):
    """Rare words by their hashes, words that fill several parts, many small groups: the same values, from a stored row for each part and not for each n-gram."""
    for name, value in (("BOOK", 3), ("ROWS_PER_PARTITION", 60), ("GROUP_BYTES", 700)):
        monkeypatch.setattr(L, name, value)
    katz = Katz(texts)
    model = L.train(docs(spark, list(enumerate(texts))))
    assert model.places.spread.max() > 1 and model.places.book.n == 4
    blocks = model.blocks.count()
    assert 1 < blocks <= model.places.parts
    tables = model[1]
    assert [g.count() for g, _ in tables] == [sum(map(len, katz.after[n].values())) for n in (1, 2, 3)]
    assert [c.count() for _, c in tables] == [len(katz.after[n]) for n in (1, 2, 3)]
    assert tables[2][1].agg(F.sum("v")).first()[0] == pytest.approx(sum(math.log(katz.seen(h)[1]) for h in katz.after[3]))
    new = [*texts, "zzz q", "a b zzz", "w1 w2 日本 w3", "b a c b", "w1 zzz w1 w2 w1", ""]
    got = {r.doc_id: r.logprob for r in L.score(docs(spark, list(enumerate(new))), model).collect()}
    assert got == pytest.approx({i: katz.log(t) for i, t in enumerate(new)}, abs=1e-9)
