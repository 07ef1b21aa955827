import corpus_pipeline as P
from docloom.llm import language_id, near_dedup, packing, substring_dedup
from docloom.llm.common import made

from ..conftest import SF
from .helpers import ODD, docs


def test_stages_one_after_another(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows, net = d.collect(), language_id.train(d)
    ok = {r.doc_id: r.accepted for r in language_id.predictions(d, net).collect()}
    stage1 = P.STAGES[0][1](spark, d, SF)
    assert {r.doc_id for r in stage1.collect()} == {i for i, a in ok.items() if a}
    least = {r.doc_id: r.class_id for r in near_dedup.near_classes(stage1).collect()}
    stage2 = P.STAGES[1][1](spark, stage1, SF)
    kept = {r.doc_id: r.text for r in stage2.collect()}
    assert set(kept) == {i for i, c in least.items() if c == i} and len(kept) < len(rows)
    cuts = {}
    for r in substring_dedup.passages(stage2).collect():
        if r.first_doc < r.doc_id:
            cuts.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = {i: "".join(c for k, c in enumerate(t) if k not in cuts.get(i, ())) for i, t in kept.items()}
    stage3 = P.STAGES[2][1](spark, stage2, SF)
    assert {r.doc_id: r.text for r in stage3.collect()} == {i: t for i, t in want.items() if t.strip() or i not in cuts}
    assert all(s.columns == d.columns for s in (stage1, stage2, stage3))
    columns = ["doc_id", "piece", "batch", "slot", "text"]
    before = made()
    got = {tuple(r) for r in P.run(spark, SF).select(*columns).collect()}
    assert made() == before + len(P.STAGES) - 1  # only the stages' own rows are left
    assert got == {tuple(r) for r in packing.pack(stage3).select(*columns).collect()}


def test_odd_rows(spark):
    d = docs(spark, [*ODD, (1, "some words of text"), (1, "some words of text")])
    now = d
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == d.columns
        now.count()
    assert P.STAGES[-1][1](spark, now, SF).count() > 0
    for _, stage in P.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0
