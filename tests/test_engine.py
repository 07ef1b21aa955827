"""Upserts, files, outside calls, streams and the driver entry."""

import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.operators import external, ledger, retrieval
from docloom.sources import adapters, files, schemas, sinks
from docloom.streaming import ingest

from .conftest import SF


def test_upsert_laws(spark):
    cur = spark.createDataFrame([(1, "a", "e"), (2, "b", None), (None, "n", "x")], "k int, name string, err string")
    chg = spark.createDataFrame([(1, None, None), (3, "c", "f"), (None, "m", None)], "k int, name string, err string")
    once = ledger.upsert(cur, chg, ["k"], ["name"], ["err"])
    want = {(1, "a", None), (2, "b", None), (3, "c", "f"), (None, "m", None)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in ledger.upsert(once, chg, ["k"], ["name"], ["err"]).collect()} == want


def test_rerank_ties_and_all(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([[2.0, 1.0], [2.0, 1.0], [0.0, 1.0]])], "i int, v array<float>")
    assert [r.i for r in retrieval.rerank(df, [1.0, 0.0], "v", "i", 2).collect()] == [0, 1]
    assert [r.i for r in retrieval.rerank(df, [1.0, 0.0], "v", "i", 0).collect()] == [0, 1, 2]
    assert retrieval.rerank(df.limit(0), [1.0, 0.0], "v", "i", None).collect() == []


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def para(text, style="", extra=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t>{extra}</w:r></w:p>'


def cell(body, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{body}</w:tc>"


def table(*rows):
    return f"<w:tbl>{''.join(f'<w:tr>{''.join(r)}</w:tr>' for r in rows)}</w:tbl>"


def docx(body, *more):
    styles = f'<w:styles {W}><w:style w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>'
    return zipped([("word/document.xml", f"<w:document {W} {R}><w:body>{body}</w:body></w:document>"), ("word/styles.xml", styles), *more])


DOCX = docx(para("1. Scope", "Heading2") + table([cell(para("a  b"), '<w:gridSpan w:val="2"/>')], [cell("<w:p/>")]))
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = zipped([
    ("xl/workbook.xml", f'<workbook {M} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'),
    ("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
    ("xl/sharedStrings.xml", f"<sst {M}><si><t>head</t></si></sst>"),
    ("xl/worksheets/s.xml", f'<worksheet {M}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"><v></v></c></row></sheetData></worksheet>'),
])


def test_archives_and_documents(spark, tmp_path):
    inner = zipped([("deep/c.xlsx", XLSX)])
    (tmp_path / "t.zip").write_bytes(zipped([("z.docx", DOCX), ("n.zip", inner), ("../evil.pdf", b"x"), ("a.md", b"x"), ("b.rar", b"x"), ("bad.docx", b"x")]))
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    entries = files.archive_entries(spark.read.format("binaryFile").load(str(tmp_path / "*.zip"))).cache()
    got = {(r.path, r.depth, r.error is None) for r in entries.collect()}
    assert {("z.docx", 0, True), ("n.zip/deep/c.xlsx", 1, True), ("../evil.pdf", 0, False), ("b.rar", 1, False), ("", 0, False), ("bad.docx", 0, True)} == got
    by = {}
    for r in files.read_blocks(entries.where("error IS NULL")).collect():
        by.setdefault(r.path, []).append(r)
    assert [(r.type, r.content, r.heading_level, r.section_path) for r in by["z.docx"]] == [("text", "1. Scope", 2, "1"), ("table", None, None, "1")]
    assert by["z.docx"][1]["rows"] == [("header", [("a b", 2, 1)])] and by["z.docx"][1].col_count == 2
    assert [[c.value for c in row.cells] for row in by["n.zip/deep/c.xlsx"][0]["rows"]] == [["head", "", "5"]] and by["n.zip/deep/c.xlsx"][0].block_id == "doc_sheet_01"
    assert by["bad.docx"][0].error


def test_other_archives_come_in_as_readers(monkeypatch):
    monkeypatch.setitem(files.ARCHIVE_READERS, ".7z", lambda data: iter([("x/a.docx", DOCX), ("skip.exe", b"1")]))
    monkeypatch.setitem(files.ARCHIVE_READERS, ".rar", lambda data: iter([("in.7z", b"7")]))
    assert [(p, d, e) for p, d, _, e in files.walk(b"r", ".rar")] == [("in.7z/x/a.docx", 1, None)]


def test_docx_ids_sections_images_and_wrappers():
    inner = lambda t: table([cell(para(f"{t}1")), cell(para(f"{t}2"))])
    shown = '<w:drawing><a:blip r:embed="i2"/></w:drawing>'
    body = para("before") + para("2.1 Terms", "Heading2") + table([cell(inner("x") + "<w:p/>"), cell(inner("y"))], [cell(para("layout"))])
    body += para("text", extra=shown) + para("again", extra=shown) + para("Free", "Heading2") + table([cell(para("h")), cell(para("k"))], [cell(para("v"), '<w:vMerge w:val="restart"/>'), cell(para("1"))], [cell("<w:p/>", "<w:vMerge/>"), cell(para("2"))])
    rels = '<Relationships xmlns="p"><Relationship Id="i1" Type="x/image" Target="media/a.jpeg"/><Relationship Id="i2" Type="x/image" Target="media/b.png"/><Relationship Id="s" Type="x/styles" Target="styles.xml"/></Relationships>'
    kinds = '<Types xmlns="t"><Default Extension="jpeg" ContentType="image/jpeg"/><Default Extension="png" ContentType="image/png"/></Types>'
    data = docx(body, ("word/_rels/document.xml.rels", rels), ("[Content_Types].xml", kinds), ("word/media/a.jpeg", b"AA"), ("word/media/b.png", b"BB"))
    got = files.docx_blocks(data, "d")
    assert [(b["block_id"], b["type"], b["section_path"]) for b in got] == [
        ("d_b001", "text", None), ("d_b002", "text", "2.1"), ("d_tbl_001", "table", "2.1"), ("d_tbl_002", "table", "2.1"), ("d_b003", "text", "2.1"), ("d_img_002", "image", "2.1"),
        ("d_b004", "text", "2.1"), ("d_b005", "text", None), ("d_tbl_003", "table", None), ("d_img_001", "image", None),
    ]
    cells = lambda b: [[c["value"] for c in r["cells"]] for r in b["rows"]]
    assert cells(got[2]) == [["x1", "x2"]] and cells(got[3]) == [["y1", "y2"]] and cells(got[8]) == [["h", "k"], ["v", "1"], ["v", "2"]]
    assert [r["row_type"] for r in got[8]["rows"]] == ["header", "data", "data"]
    assert (got[5]["image_ref"], got[5]["blob"], got[9]["image_ref"]) == ("images/d_img_002.png", b"BB", "images/d_img_001.jpg")


def test_formats_go_where_route_says(spark):
    seen = []

    def office(data, ext, target, timeout):
        if data == b"slow":
            raise TimeoutError
        return (1, None, "no") if data == b"broken" else (0, {"docx": DOCX, "xlsx": XLSX}.get(target, data + b">" + target.encode()), "")

    def pdf(data, doc_id):
        seen.append(data)
        return [files.blank_block("text", block_id=f"{doc_id}_b001", content=data.decode(), page=1)]

    names = ["a.doc", "b.xls", "c.ppt", "d.pptx", "e.pdf", "f.csv", "g.rtf", "h.odt"]
    d = spark.createDataFrame([(n, b"slow" if n == "g.rtf" else b"broken" if n == "h.odt" else b"P") for n in names], "path string, content binary")
    got = {r.path: r for r in files.read_blocks(d, {"pdf": pdf}, external.converted(office)).orderBy(F.desc("ord")).collect()}
    assert got["a.doc"].block_id == "doc_b001" and got["b.xls"].type == "table"
    assert (got["c.ppt"].content, got["d.pptx"].content, got["e.pdf"].content) == ("P>pptx>pdf", "P>pdf", "P")
    assert "UnsupportedFormat" in got["f.csv"].error and "timeout" in got["g.rtf"].error and "code 1, no" in got["h.odt"].error
    assert "no converter" in files.read_blocks(d.where("path = 'a.doc'")).first().error


def test_names():
    # bytes of cp866 that are Cyrillic in cp1251 too are taken for that: the first code page that gives Cyrillic letters counts
    assert files.repair_name("Тест.pdf".encode("cp866").decode("cp437")) == "Тест.pdf".encode("cp866").decode("cp1251")
    assert files.repair_name("Акт.pdf".encode().decode("cp437")) == "Акт.pdf" and files.repair_name("Акт.pdf".encode("cp1251").decode("cp437")) == "Акт.pdf"
    assert files.repair_name("plain.pdf") == "plain.pdf"


def test_sheets_come_back(spark, tmp_path):
    rows = [("header", [("A & <b>", 2, 1), ("c", 1, 1)]), ("section", [("part", 3, 1)]), ("data", [("1", 1, 1), ("", 1, 1), ("x\x01y", 1, 1)])]
    d = spark.createDataFrame([("t1", "table", 3, rows), ("b1", "text", None, None)], f"block_id string, type string, col_count int, rows {schemas.ROWS}")
    for spans, want in ((True, [["A & <b>", "", "c"], ["part", "", ""], ["1", "", "xy"]]), (False, [["A & <b>", "c"], ["part"], ["1", "", "xy"]])):
        made = sinks.sheets(d, spans)
        assert [r.name for r in sinks.write_files(made, str(tmp_path / str(spans))).collect()] == ["tables/t1.xlsx"]
        data = (tmp_path / str(spans) / "tables" / "t1.xlsx").read_bytes()
        read = files.xlsx_blocks(data)[0]
        assert [[c["value"] for c in r["cells"]] for r in read["rows"]] == want
        body = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
        assert ('<mergeCell ref="A1:B1"/>' in body) == spans and 'state="frozen"' in body and ('s="2"' in body) == spans
    assert sinks.width_of(["abc"]) == 10 and sinks.width_of(["x" * 100]) == 60 and sinks.width_of(["word " * 12]) == 22


def test_documents_out_and_back(spark, tmp_path):
    made = files.read_blocks(spark.createDataFrame([("in/b.docx", "d2", DOCX), ("in/a.docx", "d1", DOCX)], "path string, doc_id string, content binary"))
    out = sinks.documents_of(made)
    assert sinks.write_files(sinks.json_files(out, "doc_id"), str(tmp_path / "parsed")).count() == 2
    back = files.scanned(spark, str(tmp_path / "parsed"), schemas.DOCUMENT)
    assert [(r.doc_id, r.source_filename, [b.block_id for b in r.blocks]) for r in back.collect()] == [("d1", "a.docx", ["d1_b001", "d1_tbl_001"]), ("d2", "b.docx", ["d2_b001", "d2_tbl_001"])]
    assert [r.doc_id for r in files.scanned(spark, str(tmp_path / "parsed"), schemas.DOCUMENT, ["d2", "d9"]).collect()] == ["d2"]
    manifest = spark.createDataFrame([("t", "parsed", None, 5, [("d1", "a", "x.zip", 5, ".docx")])], schemas.MANIFEST)
    sinks.write_files(sinks.json_files(manifest, "tender_id", "_manifest.json"), str(tmp_path / "m")).collect()
    assert files.read_json(spark, str(tmp_path / "m"), schemas.MANIFEST).collect() == manifest.collect()
    index = spark.createDataFrame([({"t1": ("parsed", None, 3)},)], schemas.INDEX)
    sinks.write_files(sinks.json_files(index.withColumn("n", F.lit("index")), "n"), str(tmp_path / "i")).collect()
    assert files.read_json(spark, str(tmp_path / "i"), schemas.INDEX).collect() == index.collect() and files.read_json(spark, str(tmp_path / "none"), schemas.INDEX).count() == 0


def test_images_and_uploads_as_files(spark, tmp_path):
    d = spark.createDataFrame([("d", "image", "images/d_img_001.png", b"PNG"), ("d", "text", None, None)], "doc_id string, type string, image_ref string, blob binary")
    assert [tuple(r) for r in sinks.write_images(d, f"file://{tmp_path}").collect()] == [("d/images/d_img_001.png", 3)] and (tmp_path / "d/images/d_img_001.png").read_bytes() == b"PNG"
    up = spark.createDataFrame([("u", 2, "../b c.PDF", b"2"), ("u", 1, None, b"1"), ("v", 7, "Учёт (1).docx", b"3")], "upload string, seq int, filename string, content binary")
    assert {(r.upload, r.name) for r in sinks.uploads(up).collect()} == {("u", "001_uploaded_document"), ("u", "002_b_c.pdf"), ("v", "001_Уч_т_1.docx")}


def test_facts_are_added_and_failures_are_only_told(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(1, "a")], "id int, stage string")
    assert sinks.append_facts(rows, str(tmp_path / "f")) and sinks.append_facts(rows, str(tmp_path / "f")) and spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert not sinks.append_facts(rows, "nowhere://x/y") and "weren't written" in caplog.text


def test_database_tables(spark):
    url = "jdbc:derby:memory:docloom;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(50).selectExpr("id", "id * 2 AS v")
    rows.write.format("jdbc").options(url=url, dbtable="facts", **options).save()
    back = sinks.read_table(spark, url, "facts", "id", (0, 50), 4, **options)
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("v")).first()[0] == 2450 and sinks.read_table(spark, url, "facts", **options).count() == 50


def test_json_documents(spark, tmp_path):
    assert files.read_json(spark, str(tmp_path / "none"), schemas.PASSPORT).count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('{"doc_id": "d1", "key_topics": ["a"], "sections": [{"section_id": "1", "title": "t"}]}')
    r = files.read_json(spark, str(tmp_path / "p"), schemas.PASSPORT).first()
    assert (r.doc_id, r.key_topics, r.sections[0].title, r.summary) == ("d1", ["a"], "t", None)
    assert files.normal_rows('[{"row_type": "header", "cells": ["a", {"value": "b", "colspan": 2}]}]') == '[{"row_type": "header", "cells": [{"value": "a", "colspan": 1, "rowspan": 1}, {"value": "b", "colspan": 2, "rowspan": 1}]}]'


def test_calls_retry_and_cost():
    waits, tries = [], []

    def client(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise external.RateLimited("slow down")
        return {"text": "```json\n{}\n```", "prompt_tokens": 1000, "completion_tokens": 200}

    *answer, rows = external.call(client, "p", "mini", sleep=waits.append)
    assert answer == ["```json\n{}\n```", "success", 3, 1000, 200, 0.0003, None] and waits == [4.0, 8.0]
    assert [(r[0], r[2], r[4]) for r in rows] == [("rate_limited", None, None), ("rate_limited", None, None), ("success", 1000, 0.0003)]
    assert external.unfenced(answer[0]) == "{}"

    def wrong(prompt):
        raise external.Fatal("key")

    assert external.call(wrong, "p", "mini", sleep=waits.append)[1:3] == ("error", 1)
    assert external.ping(lambda p: {"text": "pong"}) and not external.ping(wrong)
    assert external.embed_query(_lengths, "four") == [4.0]


def fake_client(prompt, schema=None):
    """A deterministic stand-in; it fails on chunks that say so."""
    if "fail" in prompt and not prompt.startswith("{"):
        raise external.Fatal("asked to fail")
    return {"text": json.dumps({"title": prompt[:40], "length": len(prompt), "schema": schema}), "prompt_tokens": max(1, int(len(prompt) / 2.7)), "completion_tokens": 20}


def test_passports(spark):
    rows = [("a", 0, "one"), ("b#1", 0, "x" * 50), ("b#1", 1, "fail"), ("b#1", 2, "y" * 50), ("c", 0, " "), ("c", 1, None), ("d", 0, "fail")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_no int, text string")
    got = {r.doc_id: r for r in external.structured(external.passports(chunks, fake_client, "mini"), "title string, length int, doc_type string").collect()}
    assert set(got) == {"a", "b#1", "c", "d"} and got["a"].value.title == "one" and got["b#1"].value.title.startswith('{"t') and got["b#1"].cost_usd > got["a"].cost_usd > 0
    assert (got["c"].value.doc_type, got["c"].status, got["c"].cost_usd) == ("empty", "skipped", 0.0) and (got["d"].answer, got["d"].status) == (None, "error")
    sent = []
    merged = external.passports(chunks.where("doc_id = 'b#1'"), lambda p: sent.append(p) or fake_client(p), "mini")
    assert merged.count() == 1


def test_structured_answers_and_usage(spark):
    rows = spark.createDataFrame([("a", "hello"), ("b", "fail")], "id string, prompt string")
    asked = external.ask_structured(rows, fake_client, "mini", "title string, length int, schema string")
    got = {r.id: r for r in asked.collect()}
    assert got["a"].value.schema == "title string, length int, schema string" and got["b"].value is None
    facts = {r.doc_id: r for r in external.usage_rows(asked, "agent", "chat", "mini", "https://api.openai.example", collection=F.lit("t1")).collect()}
    assert (facts["a"].provider, facts["a"].status, facts["a"].total_tokens, facts["a"].tender_id, facts["a"].attempt) == ("openai", "success", 21, "t1", 1)
    assert (facts["b"].status, facts["b"].error_message, facts["b"].total_tokens) == ("error", "asked to fail", None)


def test_ocr_and_embeddings(spark):
    images = spark.createDataFrame([("i1", "x.png", "pending"), ("i2", "y.png", "completed"), ("i3", "bad.png", "pending"), ("i4", None, "pending")], "block_id string, image_ref string, ocr_status string")
    assert {tuple(r)[:3] for r in external.recognised(images, _read).collect()} == {("i1", "text of x.png", "completed"), ("i3", None, "skipped")}
    docs = spark.createDataFrame([("d", b"ab"), ("e", b"bad")], "doc_id string, content binary")
    assert [tuple(r) for r in external.recognised_pages(docs, _pages).orderBy("page").collect()] == [("d", 1, "p0"), ("d", 2, "p1")]
    scans = spark.createDataFrame([("d", "d_scan_001", 1), ("d", "d_scan_002", 2), ("d", "x", None)], "doc_id string, block_id string, page int")
    done = spark.createDataFrame([("images/d_scan_001.png",)], "name string")
    drawn = external.rendered_pages(scans, docs, lambda data, page, scale: (b"PNG%d" % page, int(100 * scale), 50), done).collect()
    assert [(r.name, bytes(r.content), r.width_px) for r in drawn] == [("images/d_scan_002.png", b"PNG1", 200)]
    rows = spark.createDataFrame([("a", "xx"), ("b", "y")], "id string, text string")
    assert {r.id: r.vector for r in external.embed(rows, _lengths, batch=1).collect()} == {"a": [2.0], "b": [1.0]}


def test_downloads(spark):
    def fetch(url, headers):
        if url == "down":
            raise OSError("no route")
        assert headers["Authorization"] == "Bearer key"
        return {"a": (200, [b"PK", b"1"]), "b": (401, []), "c": (404, []), "d": (200, []), "e": (503, [b"x"])}[url]

    d = spark.createDataFrame([(u, u, False) for u in ("a", "b", "c", "d", "e", "down")] + [("f", "a", True)], "tender_id string, url string, have boolean")
    got = {r.tender_id: r for r in external.downloads(d, fetch, "key").collect()}
    assert bytes(got["a"].content) == b"PK1" and [got[x].error.split(":")[0] for x in ("b", "c", "d", "e", "down")] == ["Unauthorized", "NotFound", "EmptyBody", "DownloadError", "DownloadError"]
    assert (got["f"].content, got["f"].error) == (None, None) and external.download(fetch, "a", "key", have=True, force=True) == b"PK1"


def test_build_index(spark, tmp_path):
    rows = [("d1", 0, None, "short", "b0"), ("d1", 1, "1", "y" * 60, "b1"), ("d2", 0, "2", "Слово one " * 260, "b2")]
    blocks = spark.createDataFrame(rows, "doc_id string, ord int, section_path string, text string, block_id string")
    assert retrieval.build_index(blocks, _lengths, "lengths", str(tmp_path / "i")) == 2
    index = spark.read.parquet(str(tmp_path / "i" / "chunks"))
    assert {r.chunk_id: (r.vector, len(r.tokens), len(r.text_preview)) for r in index.collect()} == {"d1#0": ([60.0], 1, 60), "d2#0": ([2600.0], 520, 200)}
    config = spark.read.json(str(tmp_path / "i" / "config")).first()
    assert (config.model, config.dim, config.chunks_count, config.docs_indexed) == ("lengths", 1, 2, ["d1", "d2"])
    assert {r.chunk_id: round(r.score, 9) for r in retrieval.search(index, [1.0], None).collect()} == {"d1#0": 1.0, "d2#0": 1.0}  # equal but for the 1e-10 beside each norm
    assert retrieval.search(index, [1.0], 1).count() == 1
    assert retrieval.build_index(blocks, _lengths, "lengths", str(tmp_path / "only"), ["d2"]) == 1
    assert retrieval.build_index(blocks, _lengths, "lengths", str(tmp_path / "no"), ["d9"]) == 0 and not (tmp_path / "no").exists()


def _read(ref):
    if ref == "bad.png":
        raise ValueError("unreadable")
    return f"text of {ref}"


def _pages(data):
    if data == b"bad":
        raise ValueError("unreadable")
    return [(i, f"p{i}") for i in range(len(data))]


def _lengths(texts):
    return [[float(len(t))] for t in texts]


def test_next_free(spark):
    ids = spark.createDataFrame([("user_doc_001",), ("user_doc_003",), ("doc_002",)], "id string")
    assert [r.id for r in ledger.next_free(ids, 3).orderBy("n").collect()] == ["user_doc_002", "user_doc_004", "user_doc_005"]


def test_next_free_beyond_a_span(spark, monkeypatch):
    monkeypatch.setattr(ledger, "SPAN", 4)
    ids = spark.createDataFrame([(f"user_doc_{i:03d}",) for i in range(1, 40) if i not in (17, 30)] + [("user_doc_x",), ("user_doc_0",)], "id string")
    assert [r.n for r in ledger.next_free(ids, 5).orderBy("n").collect()] == [17, 30, 40, 41, 42]
    assert [r.n for r in ledger.next_free(ids.limit(0), 9).orderBy("n").collect()] == list(range(1, 10))


def test_without_match_by_rows(spark, monkeypatch):
    """The tasks' number follows the rows, whatever the bytes; repeated and null keys stay."""
    monkeypatch.setattr(ledger, "ROWS_PER_TASK", 50, raising=False)
    rows = spark.createDataFrame([(i % 300 if i % 7 else None, i) for i in range(600)], "k int, i int")
    others = spark.createDataFrame([(i,) for i in range(0, 300, 2)] * 2 + [(None,)], "k int")
    found = ledger.without_match(rows, others, ["k"])
    assert {r.i for r in found.collect()} == {i for i in range(600) if i % 7 == 0 or i % 300 % 2}
    plan = ledger.without_match(rows, others, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 19)") == 2


def test_updates_insert_nothing(spark):
    current = spark.createDataFrame([("t", "a", "new", 1), (None, "b", "new", 2), ("t", "c", "new", 3)], "tender_id string, doc_id string, parse_status string, n int")
    failed = spark.createDataFrame([("t", "a"), (None, "b"), ("t", "z")], "tender_id string, doc_id string")
    assert {tuple(r) for r in ledger.parse_failed(current, failed, "unsupported").collect()} == {("t", "a", "unsupported", 1), (None, "b", "unsupported", 2), ("t", "c", "new", 3)}
    counted = ["text_blocks_count", "tables_count", "images_count", "total_pages", "estimated_tokens", "parse_duration_ms", "conversion_duration_ms"]
    docs = current.select("*", *[F.lit(0).alias(c) for c in counted], F.lit(None).cast("timestamp").alias("parsed_at"))
    done = failed.select("*", *[F.lit(i).alias(c) for i, c in enumerate(counted)])
    got = {r.doc_id: r for r in ledger.parsed(docs, done, F.lit("2026-01-01").cast("timestamp")).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].parse_status == "parsed" and got["a"].estimated_tokens == 4 and got["a"].parsed_at and got["c"].parsed_at is None


def test_upsert_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    schema = "k int, name string, err string, at int"
    spark.createDataFrame([(1, "a", None, 1), (1, None, "late", 2), (2, "b", None, 1)], schema).coalesce(1).write.parquet(str(source))
    run = lambda: ingest.upsert_stream(ingest.landed(spark, str(source), schema), root, str(tmp_path / "cp"), ["k"], "at", ["name"], ["err"]).awaitTermination()
    run()
    spark.createDataFrame([(2, None, "bad", 9), (3, "c", None, 9)], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    rows = lambda: {(r.k, r.name, r.err) for r in files.read_buckets(spark, root).collect()}
    assert rows() == {(1, None, "late"), (2, "b", "bad"), (3, "c", None)}
    written = [sorted(p.name for p in (tmp_path / "out" / v).glob("bucket=*")) for v in ("v=00000000", "v=00000001")]
    assert len(written[0]) == len(written[1]) == 2 and len(set(written[0]) & set(written[1])) == 1  # the bucket of key 1 isn't written again
    assert files.prune_buckets(spark, root) == 1 and rows() == {(1, None, "late"), (2, "b", "bad"), (3, "c", None)}
    assert files.read_buckets(spark, str(tmp_path / "none")) is None


def test_usage_windows(spark, tmp_path):
    usage = adapters.api_usage(spark, SF)
    usage.coalesce(1).write.parquet(str(tmp_path / "u"))
    stream = ingest.usage_windows(spark.readStream.schema(usage.schema).parquet(str(tmp_path / "u")))
    q = stream.writeStream.format("memory").queryName("usage_w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("usage_w").agg(F.sum("calls")).first()[0] == usage.count()


def test_preview(spark):
    page = files.preview_page(spark.createDataFrame([(1, "<p>b</p>"), (0, "<p>a</p>")], "ord int, html string"), "a <b> & c").first()[0]
    assert "<p>a</p>\n<p>b</p>" in page and "<title>a &lt;b&gt; &amp; c</title>" in page


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("absent", ["docloom.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without_what_the_training_operators_need(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; q = e.queries(); assert 'tender_costs' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["tender_costs", "list_documents"])
def test_pushdown(spark, name):
    from docloom.plans.catalog import QUERIES

    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and ("PushedFilters: [IsNotNull(source)" in plan or name == "tender_costs")
