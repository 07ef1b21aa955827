import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language_id as L

from ..conftest import SF
from .helpers import ODD, docs


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    net = L.Network(["a", "b", "und"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 8, (6, 5))
    x[4:, 0] = L.PAD
    target = np.array([0, 1, 2, 0, 1])

    def loss():
        p = net.probabilities(net.states(x).astype(np.float64))
        valid = x != L.PAD
        return -(np.log(p[:, target, np.arange(5)]) * valid).sum() / valid.sum()

    g, _ = net.gradients(x, target)
    for name, at in (("x", (0, 2, 3)), ("x", (1, 7, 5)), ("u", (0, 8, 1)), ("u", (1, 0, 2)), ("c", (1, 2, 0)), ("w", (1, 4)), ("b", (2, 0))):
        keep, step = net.p[name][at], 1e-2
        net.p[name][at] = keep + step
        up = loss()
        net.p[name][at] = keep - step
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3, (name, at)


def test_fast_states():
    net = L.Network(["a", "und"])
    x = np.random.default_rng(1).integers(0, 257, (L.WINDOW, 9))
    assert np.allclose(net.states(x), net.fast_states(x), atol=1e-4)


@pytest.fixture(scope="module")
def net(spark):
    return L.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 <> 0"))


def test_held_out_accuracy(spark, net):
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 5 = 0")
    got = L.predictions(held, net).join(held.select("doc_id", "lang", "n_chars"), "doc_id")
    assert got.where("lang_pred = lang").count() / got.count() > 0.95
    assert got.where("accepted").count() / got.count() > 0.99
    assert got.where((F.abs(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-4)).count() == 0


def test_noise_goes_and_prose_stays(spark, net):
    rng = np.random.default_rng(9)
    junk = [(i, "".join(rng.choice(list("0123456789#=/|<>{}-+;"), 400))) for i in range(20)]
    good = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 100").select("text").limit(30).collect()]
    got = {r.doc_id: r.accepted for r in L.predictions(docs(spark, [*junk, *enumerate(good, 100)]), net).collect()}
    assert sum(got[i] for i in range(20)) <= 1 and all(got[100 + i] for i in range(len(good)))


def test_odd_rows(spark, net):
    d = docs(spark, [*ODD, (1, "the same"), (1, "the same")])
    got = L.predictions(d, net).collect()
    by = {r.doc_id: r for r in got}
    assert None not in by and len(got) == 8
    assert all(by[i].lang_pred == L.UNKNOWN and not by[i].accepted and by[i].prob == 1 for i in (90, 91, 92))
    assert sum(by[95].label_bytes) == 300_000 and sum(by[94].label_bytes) == len("é日本 😀 words".encode())
    assert L.predictions(d.limit(0), net).count() == 0
    assert L.train(d.limit(0)) is None and L.train(d.withColumn("lang", F.lit(None).cast("string"))) is None
    assert all(r.accepted and r.lang_pred is None for r in L.predictions(d, None).collect())
    kept = L.accepted(d.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == d.columns and kept.count() == d.count()


def test_training_repeats(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(L.sample(d, "doc_id", "text", "lang").collect())
    assert rows == sorted(L.sample(d.repartition(3), "doc_id", "text", "lang").collect())
    assert len(rows) == sum(min(L.ROWS_PER_LANGUAGE, r["count"]) for r in d.groupBy("lang").count().collect())


def test_rows_labelled_und_are_learnt(spark):
    words = lambda i, a: " ".join(a[(i * 7 + j * j) % len(a)] for j in range(60))
    rows = [(i, words(i, ["alpha", "beta", "gamma", "delta"]), "en") for i in range(40)] + [(100 + i, words(i, ["qzx", "wvk", "jjq", "xkz"]), L.UNKNOWN) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.predictions(d, L.train(d)).join(d, "doc_id")
    assert got.where("lang_pred = lang").count() >= 78


def test_pooling_is_the_mean_over_all_positions(spark, net):
    """Each document by itself, position by position, by plain loops."""
    texts = ["der Hund und die Katze " * 9, "é" * 40, "a", "the quick brown fox " * 5 + "x" * 3]
    got = {r.doc_id: r for r in L.predictions(docs(spark, list(enumerate(texts))), net).collect()}
    for i, t in enumerate(texts):
        data, rows = t.encode(), []
        for s in range(0, len(data), L.WINDOW):
            x = np.full((L.WINDOW, 1), L.PAD)
            part = np.frombuffer(data[s : s + L.WINDOW], np.uint8)
            x[: len(part), 0] = part
            rows += list(net.probabilities(net.states(x))[: len(part), :, 0])
        assert np.allclose(np.mean(rows, 0), got[i].probs, atol=1e-3) and len(rows) == len(data)
        assert got[i].label_bytes == np.bincount([int(r.argmax()) for r in rows], minlength=len(net.labels)).tolist()
        assert got[i].lang_pred == net.labels[int(np.mean(rows, 0).argmax())] and got[i].accepted == (np.mean(rows, 0)[-1] < L.REJECT)


def test_ties_go_to_the_first_label():
    net = L.Network(["a", "b", "und"])
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    probs, seen = net.documents(np.frombuffer(b"some text", np.uint8), np.array([0, 9]))
    assert np.allclose(probs, 1 / 3) and seen.tolist() == [[9, 0, 0]] and probs.argmax() == 0
