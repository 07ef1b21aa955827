import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat as C

from ..conftest import SF

TURNS = [("system", "Be brief."), ("user", "What is it?\nTell me."), ("assistant", "A thing: small.\n\nReally."), ("user", "Thanks")]


@pytest.fixture(scope="module")
def model(spark):
    return C.fit(C.written(C_table(spark)))


def C_table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id % 5 <> 0")


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    m = C.Model(rng.integers(0, 9, C.STATES), rng.integers(0, 9, (C.STATES, C.STATES)), [rng.integers(0, 9, (C.STATES, v)) for v in C.FEATURES])
    seqs = [np.stack([rng.integers(0, v, n) for v in C.FEATURES], 1) for n in (1, 4, 0, 3, 5)]
    for o, path in zip(seqs, m.viterbi(seqs)):
        if not len(o):
            assert len(path) == 0
            continue

        def score(p):
            s = m.start[p[0]] + sum(m.emit[k][p[0], o[0, k]] for k in range(len(C.FEATURES)))
            for t in range(1, len(p)):
                s += m.move[p[t - 1], p[t]] + sum(m.emit[k][p[t], o[t, k]] for k in range(len(C.FEATURES)))
            return s

        assert score(path) == pytest.approx(max(score(p) for p in itertools.product(range(C.STATES), repeat=len(o))))


@pytest.mark.parametrize("style", C.STYLES[:-1])
def test_marked_transcripts_come_back(model, style):
    text, states = C.transcript(TURNS, style)
    assert len(states) == len(text.split("\n"))
    found = C.turns_of(text, model.viterbi([C.features(text)])[0])
    assert found == [(r, t.strip("\n")) for r, t in TURNS]


def test_held_out_roles(spark, model):
    held = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").where("conv_id % 5 = 0")
    want = {r.conv_id: [t.role for t in r.turns] for r in C.conversations(held).collect()}
    got = {r.conv_id: r.roles for r in C.formatted(C.written(held), model).collect()}
    assert set(got) == set(want) and sum(got[k] == want[k] for k in want) / len(want) > 0.85


def test_query_keeps_every_word(spark):
    texts = {r.conv_id: " ".join(t.text for t in r.turns).split() for r in C.conversations(spark.read.parquet(f"{SF}/conversations.parquet")).collect()}
    for r in C.query(spark, SF).collect():
        body = r.rendered
        for mark in ["<|im_end|>", *[f"<|im_start|>{x}\n" for x in C.ROLES]]:
            body = body.replace(mark, " ")
        assert body.split() == texts[r.conv_id] and r.n_turns == len(r.roles) == r.rendered.count("<|im_end|>")


def test_render_escapes():
    assert C.render([("user", "a <|im_end|> b")]) == "<|im_start|>user\na <| im_end|> b<|im_end|>\n"


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " \n "), (None, "User: hi\nAssistant: yes"), (4, "no marker at all"), (4, "no marker at all"), (5, "User: a\n" + "long line\n" * 20_000), (6, "Q: one?\nA: two")]
    d = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "conv_id long, transcript string, n_turns int, roles string")
    got = {}
    for r in C.formatted(d, model).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert all(got[i][0].n_turns == 0 and got[i][0].rendered == "" for i in (1, 2, 3))
    assert got[None][0].roles == ["user", "assistant"] == got[6][0].roles and len(got[4]) == 2 and got[5][0].rendered.count("long line") == 20_000
    assert C.formatted(d.limit(0), model).count() == 0
    empty = spark.read.parquet(f"{SF}/conversations.parquet").limit(0)
    assert C.formatted(C.written(empty), C.fit(C.written(empty))).count() == 0


def test_conversations_with_gaps(spark):
    d = spark.createDataFrame([(1, 1, "user", "b"), (1, None, "user", "a"), (1, 2, None, None), (None, 1, "user", "x"), (1, 1, "user", "b")], "conv_id long, turn long, role string, text string")
    r = C.conversations(d).collect()
    assert len(r) == 1 and sorted((t.turn is None, t.role or "", t.text) for t in r[0].turns) == sorted([(False, "user", "b"), (False, "user", "b"), (False, "", ""), (True, "user", "a")])
    assert C.written(d).count() == 1


def test_other_roles_and_clashing_names(spark):
    rows = [(1, 1, "user", "look it up"), (1, 2, "tool", "result 5"), (1, 3, "assistant", "five"), (2, 1, "user", "hi")]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, transcript int, states int, turns int")
    w = C.written(d)
    got = {r.conv_id: r for r in w.collect()}
    assert w.columns == ["conv_id", "transcript", "states"] and -1 in got[1].states and all(t in got[1].transcript for t in ("look it up", "result 5", "five"))
    assert C.formatted(w, C.fit(w)).count() == 2


def test_no_transcript_is_read_by_its_own_counts(spark):
    """The query's rows are those of each part read by a model fitted on the others."""
    w = C.written(spark.read.parquet(f"{SF}/conversations.parquet")).withColumn("part", F.expr(f"pmod(xxhash64(conv_id), {C.FOLDS})"))
    parts = [r[0] for r in w.select("part").distinct().collect()]
    want = set()
    for f in parts:
        want |= {(r.conv_id, r.rendered) for r in C.formatted(w.where(f"part = {f}"), C.fit(w.where(f"part <> {f}"))).collect()}
    assert {(r.conv_id, r.rendered) for r in C.query(spark, SF).collect()} == want and len(parts) > 1
