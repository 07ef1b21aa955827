import json

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import bpe as B
from docloom.llm.textkernel import utf8

from ..conftest import SF
from .helpers import ODD, docs

ODD_TEXTS = ["", " ", "  a", "a  b", "it's 12  34%% <|endoftext|>", "日本 語　 です", "a\t\tb \n", "😀 😀x", "x  y", "q  r", "é è  \n\n z", "a ́b", "\x1c \x85", "don't  'll"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(B.VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_ids_and_offsets_are_those_of_whole_texts(spark, plain):
    texts = ODD_TEXTS + [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    got = B.encode(docs(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        e = plain.encode(texts[r.doc_id], add_special_tokens=False)
        assert r.ids == e.ids and list(zip(r.starts, r.ends)) == [tuple(o) for o in e.offsets] and r.exact and r.n_tokens == len(e.ids)


def test_decoding_gives_the_text_back(spark):
    d = docs(spark, list(enumerate([*ODD_TEXTS, None])))
    back = {r.doc_id: r.text for r in B.decode(B.encode(d)).collect()}
    assert back == dict(enumerate([*ODD_TEXTS, None]))


def test_split_characters_and_foreign_ids(spark, plain):
    ids = plain.encode("😀", add_special_tokens=False).ids
    assert len(ids) > 1
    d = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, [10**6, -1, None, *ids])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in B.decode(d).collect()}
    assert got[1] == got[3] == "😀" and "�" in got[2]


def test_byte_table_is_whole():
    table = B.byte_table()
    assert sorted(table.values()) == list(range(256))
    vocab = json.load(open(B.VOCABULARY, encoding="utf-8"))["model"]["vocab"]
    assert all(c in table for t in vocab if t != "<|endoftext|>" for c in t)


def test_a_full_chunk_table_is_emptied(monkeypatch, plain):
    monkeypatch.setattr(B, "KNOWN_CHUNKS", 5)
    c = B.Codec()
    for t in ("one two three four", "five six seven", "one two five"):
        raw, offsets = utf8(pa.array([t]))
        assert c.encode(raw, offsets)[0].tolist() == plain.encode(t).ids


def test_odd_rows(spark):
    d = docs(spark, [*ODD, (1, "a b"), (1, "a b")])
    got = B.encode(d).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == d.count() and by[90].ids is None and by[90].n_tokens is None and by[91].ids == [] and all(r.exact for r in got)
    assert by[95].ends[-1] == 300_000 and by[None].n_tokens > 0
    assert B.encode(d.limit(0)).count() == 0 and B.decode(B.encode(d.limit(0))).count() == 0
    assert np.all(np.diff(by[94].starts) >= 0)
