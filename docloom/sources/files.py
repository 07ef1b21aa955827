"""Files as tables: archives, word-processor and spreadsheet documents, JSON documents; snapshots on the way out."""

from __future__ import annotations

import html as html_module
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import external
from docloom.sources import schemas

MAX_DEPTH = 5
ENTRY = "archive string, path string, depth int, ext string, size long, content binary, error string"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Readers of other archive kinds: extension -> function of bytes that yields (name, bytes).
ARCHIVE_READERS: dict[str, Callable[[bytes], Iterator[tuple[str, bytes]]]] = {}


def repair_name(name: str) -> str:
    """Entry names that were Cyrillic before cp437 got them: UTF-8, cp1251, then cp866, the first that gives Cyrillic letters."""
    try:
        raw = name.encode("cp437")
    except UnicodeEncodeError:
        return name
    for code in "utf8 cp1251 cp866".split():
        try:
            text = raw.decode(code)
        except UnicodeDecodeError:
            continue
        if any("Ѐ" <= c <= "ӿ" for c in text):
            return text
    return name


def safe_path(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def suffix(name: str) -> str:
    m = re.match(r"^.+(\.[^.]+)$", posixpath.basename(name))
    return m[1].lower() if m else ""


def read_zip(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name = info.filename if info.flag_bits & 0x800 else repair_name(info.filename)
            try:
                yield name, z.read(info)
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as e:
                yield name, e


def walk(data: bytes, ext: str, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """path, depth, bytes, error of every document of an archive: a level's files in the order of their paths, then its archives."""
    if depth > MAX_DEPTH:
        return
    reader = read_zip if ext == ".zip" else ARCHIVE_READERS.get(ext)
    if reader is None:
        yield path, depth, None, f"no reader for {ext}"
        return
    try:
        entries = sorted(reader(data), key=lambda e: e[0])
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        yield path, depth, None, str(e)
        return
    nested = []
    for name, body in entries:
        where = posixpath.join(path, name)
        if not safe_path(name):
            yield where, depth, None, "unsafe path"
        elif isinstance(body, Exception):
            yield where, depth, None, str(body)
        elif suffix(name)[1:] in T.ARCHIVES:
            nested.append((where, suffix(name), body))
        elif suffix(name)[1:] in T.NATIVE + T.CONVERTED + T.UNPARSED:
            yield where, depth, body, None
    for where, e, body in nested:
        yield from walk(body, e, where, depth + 1)


def archive_entries(files: DataFrame) -> DataFrame:
    """Every document in the archives of a ``binaryFile`` table (path, content), nested ones too. What can't be read is a row with its error."""

    def run(batches):
        for b in batches:
            out = []
            for archive, data in zip(b["path"], b["content"]):
                for path, depth, body, error in walk(bytes(data), suffix(archive)):
                    out.append((archive, path, depth, suffix(path), len(body) if body is not None else None, body, error))
            yield pd.DataFrame(out, columns=["archive", "path", "depth", "ext", "size", "content", "error"]).astype({"size": "Int64"})

    return files.select("path", "content").mapInPandas(run, ENTRY)


A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
NUMBER = re.compile(r"^(\d+(?:[.]\d+)*)[\s.)]")


def text_of(e, joint: str = "") -> str:
    return joint.join(t.text or "" for t in e.iter(f"{W}t"))


def squeeze(text: str) -> str:
    return re.sub(" {2,}", " ", re.sub("[\r\n]", " ", text)).strip()


def blank_block(kind: str, **fields) -> dict:
    return dict.fromkeys(BLOCK_FIELDS) | {"type": kind} | fields


def docx_table(tbl) -> tuple[list[dict], int]:
    """Rows and width of one table. A cell that goes on from the row above has that one's text; rows without any text go."""
    rows, width, above = [], 0, {}
    for i, tr in enumerate(tbl.findall(f"{W}tr")):
        cells, at = [], 0
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            n = int(span.get(f"{W}val")) if span is not None else 1
            goes_on = merge is not None and merge.get(f"{W}val") != "restart" and at in above
            value = above[at] if goes_on else squeeze(text_of(tc, " "))
            above[at] = value
            cells.append({"value": value, "colspan": n, "rowspan": 1})
            at += n
        width = max(width, at)
        rows.append({"row_type": row_kind([c["value"] for c in cells], at, i == 0), "cells": cells})
    return [r for r in rows if any(c["value"].strip() for c in r["cells"])], width


def row_kind(values: list[str], width: int, first: bool) -> str:
    filled = [v.strip() for v in values if v.strip()]
    return "header" if first else "section" if filled and len(filled) <= 2 and width >= 4 and all(len(v) < 200 for v in filled) else "data"


def docx_tables(tbl) -> list:
    """The table, or, where its first cell holds a table (it only lays out the page), the tables that its cells hold."""
    cells = [tc for tr in tbl.findall(f"{W}tr") for tc in tr.findall(f"{W}tc")]
    if cells and cells[0].find(f"{W}tbl") is not None:
        inner = [t for tc in cells for t in tc.findall(f"{W}tbl")]
        return [t for t in inner if docx_table(t)[0]] or [tbl]
    return [tbl]


def docx_images(z: zipfile.ZipFile) -> dict[str, tuple[str, bytes]]:
    """Relationship id -> MIME type and bytes of every embedded image, in the order of the relationships."""
    names = set(z.namelist())
    if "word/_rels/document.xml.rels" not in names:
        return {}
    kinds = {}
    if "[Content_Types].xml" in names:
        for e in ElementTree.fromstring(z.read("[Content_Types].xml")):
            kinds[e.get("PartName") or "." + (e.get("Extension") or "").lower()] = e.get("ContentType")
    out = {}
    for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels")):
        target = r.get("Target") or ""
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"word/{target}")
        if "image" in (r.get("Type") or "") and r.get("TargetMode") != "External" and part in names:
            out[r.get("Id")] = kinds.get("/" + part) or kinds.get(suffix(part)) or "", z.read(part)
    return out


def docx_blocks(data: bytes, doc_id: str = "doc") -> list[dict]:
    """Paragraphs, tables and images of a word-processor document in their order, with ids and sections.

    Paragraphs and tables are numbered each for themselves. An image stands after the first paragraph that shows it, those that no
    paragraph shows stand at the end. A heading without a number ends the section before it.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else ""
        found = docx_images(z)
    images = {}
    for n, (key, (mime, blob)) in enumerate(found.items(), 1):
        name = f"{doc_id}_img_{n:03d}"
        images[key] = blank_block("image", block_id=name, image_ref=f"images/{name}{T.MIME.get(mime.lower(), '.png')}", ocr_status="pending", blob=blob)
    blocks, section, paragraphs, tables = [], None, 0, 0
    for e in body if body is not None else []:
        if e.tag == f"{W}p" and (text := text_of(e).strip()):
            paragraphs += 1
            style = e.find(f"{W}pPr/{W}pStyle")
            m = re.search(r"heading\s*(\d+)", styles.get(style.get(f"{W}val"), style.get(f"{W}val")) or "", re.I) if style is not None else None
            level, number = min(6, max(1, int(m[1]))) if m else None, NUMBER.match(text)
            section = number[1] if number else None if level else section
            blocks.append(blank_block("text", block_id=f"{doc_id}_b{paragraphs:03d}", content=text, heading_level=level, section_path=section))
            for blip in e.iter(f"{A}blip"):
                shown = images.pop(blip.get(f"{R}embed"), None)
                if shown:
                    blocks.append(shown | {"section_path": section})
        elif e.tag == f"{W}tbl":
            tables += 1
            for i, t in enumerate(docx_tables(e)):
                tables += i > 0
                rows, width = docx_table(t)
                blocks.append(blank_block("table", block_id=f"{doc_id}_tbl_{tables:03d}", section_path=section, col_count=width, rows=rows))
    return [*blocks, *images.values()]


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_blocks(data: bytes, doc_id: str = "doc") -> list[dict]:
    """One table for each sheet that isn't empty; blank rows go. Only a sheet's first row is its header, even where that is blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in i.iter(f"{S}t")) for i in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{S}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        blocks = []
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"), 1):
            target = links[sheet.get(f"{R}id")].lstrip("/")
            rows, width = [], 0
            for i, row in enumerate(ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{S}row")):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{S}c"), 1):
                    v = c.find(f"{S}v")
                    value = "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells[column_number(c.get("r")) if c.get("r") else k] = (shared[int(value)] if c.get("t") == "s" and value else value).strip()
                line = [cells.get(j, "") for j in range(1, max(cells, default=0) + 1)]
                width = max(width, len(line))
                if any(line):
                    rows.append({"row_type": "header" if i == 0 and row.get("r", "1") == "1" else "data", "cells": [{"value": v, "colspan": 1, "rowspan": 1} for v in line]})
            if rows:
                blocks.append(blank_block("table", block_id=f"{doc_id}_sheet_{n:02d}", content=sheet.get("name"), col_count=width, rows=rows))
    return blocks


READERS: dict[str, Callable[[bytes, str], list[dict]]] = {"docx": docx_blocks, "xlsx": xlsx_blocks}
BLOCK_FIELDS = [f.split(" ", 1)[0] for f in re.split(r", (?![^<]*>)", schemas.BLOCK)] + ["blob"]
READ = f"path string, doc_id string, ord int, {schemas.BLOCK}, blob binary, error string"


def read_blocks(documents: DataFrame, readers: dict[str, Callable[[bytes, str], list[dict]]] | None = None, converter: Callable[[bytes, str, str], bytes] | None = None) -> DataFrame:
    """Blocks of (path, content, and doc_id if there) by the reader of each format; an unsupported or broken document is one row with its error.

    Further readers (``pdf``: see operators/pages.py) take bytes and the document's id. Older formats go through the converter (bytes, extension,
    target extension -> bytes) to docx or xlsx, presentations through pptx to pdf, as ``route`` says.
    """
    known = READERS | (readers or {})
    rows = documents.select("path", (F.col("doc_id") if "doc_id" in documents.columns else F.lit("doc")).alias("doc_id"), "content")

    def read(path: str, data: bytes, doc_id: str) -> list[dict]:
        ext = suffix(path)[1:]
        for target in external.conversions(ext):
            if converter is None:
                raise external.ConversionError(f"no converter for .{ext}")
            data, ext = converter(data, ext, target), target
        if ext not in known:
            raise UnsupportedFormat(f"format .{ext} isn't supported")
        return known[ext](data, doc_id)

    def run(batches):
        for b in batches:
            out = []
            for path, doc_id, data in zip(b["path"], b["doc_id"], b["content"]):
                try:
                    found = read(path, bytes(data), doc_id)
                except Exception as e:  # noqa: BLE001  a document's fault is its row's error, never the job's
                    out.append(dict.fromkeys(BLOCK_FIELDS) | {"path": path, "doc_id": doc_id, "ord": None, "error": f"{type(e).__name__}: {e}"[:2000]})
                    continue
                out += [dict.fromkeys(BLOCK_FIELDS) | {"path": path, "doc_id": doc_id, "ord": i, "error": None} | x for i, x in enumerate(found)]
            ints = dict.fromkeys(("ord", "page", "page_end", "heading_level", "col_count"), "Int32")
            yield pd.DataFrame(out, columns=["path", "doc_id", "ord", *BLOCK_FIELDS, "error"], dtype=object).astype(ints)

    return rows.mapInPandas(run, READ)


class UnsupportedFormat(Exception):
    pass


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file; an absent folder is an empty table. Read back in no order: see scanned()."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path, multiLine=True)


def scanned(spark: SparkSession, path: str, schema: str, doc_ids: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """JSON documents of a folder in the order of their file names; doc_ids, if any, keeps only those."""
    rows = read_json(spark, path, schema)
    some = rows if doc_ids is None else rows.where(F.col(key).isin(doc_ids))
    return some.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("file", key).drop("file")


def normal_cell(cell) -> dict:
    """A cell is a string or an object; both become value and spans."""
    if isinstance(cell, dict):
        return {"value": str(cell.get("value", "")), "colspan": int(cell.get("colspan", 1)), "rowspan": int(cell.get("rowspan", 1))}
    return {"value": "" if cell is None else str(cell), "colspan": 1, "rowspan": 1}


def normal_rows(json_rows) -> str:
    """JSON of table rows with every cell an object, for from_json."""
    return json.dumps([{"row_type": r.get("row_type", "data"), "cells": [normal_cell(c) for c in r.get("cells", [])]} for r in json.loads(json_rows or "[]")], ensure_ascii=False)


def write_snapshot(df: DataFrame, root: str, version: int) -> str:
    """A whole new version beside the others; readers take the newest that is complete."""
    path = f"{root}/v={version:08d}"
    df.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [str(s.getPath()) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done)) if done else None


BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, root: str, version: int, keys: list[str], buckets: int = BUCKETS) -> None:
    """A version of those buckets (by a hash of the keys) that df has rows of; others keep the versions they have."""
    df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/v={version:08d}")


def read_buckets(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame | None:
    """The newest complete version of each bucket (of those wanted); None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    newest: dict[int, str] = {}
    for version in sorted((s.getPath() for s in fs.listStatus(p)), key=str):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(version, "_SUCCESS")):
            newest |= {int(str(b.getPath()).rsplit("=", 1)[1]): str(b.getPath()) for b in fs.listStatus(version) if "bucket=" in b.getPath().getName()}
    paths = [x for b, x in sorted(newest.items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def prune_buckets(spark: SparkSession, root: str) -> int:
    """Deletes what newer versions of the buckets have taken the place of; gives the number of folders that went. For when nothing reads the old ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    seen, gone = set(), 0
    for version in sorted((s.getPath() for s in fs.listStatus(p)), key=str, reverse=True):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(version, "_SUCCESS")):
            for b in fs.listStatus(version):
                name = b.getPath().getName()
                if "bucket=" in name:
                    gone += name in seen and fs.delete(b.getPath(), True)
                    seen.add(name)
    return gone


def preview_page(html: DataFrame, title: str) -> DataFrame:
    """One row: the HTML page of (ord, html) blocks."""
    head = f"<!doctype html><html><head><meta charset='utf-8'><title>{html_module.escape(title)}</title></head><body><main>"
    body = html.agg(F.array_sort(F.collect_list(F.struct("ord", "html"))).alias("b"))
    return body.select(F.concat(F.lit(head), F.array_join(F.transform("b", lambda x: x["html"]), "\n"), F.lit("</main></body></html>")).alias("page"))
