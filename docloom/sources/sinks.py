"""Ways out: appended facts, JSON documents, files of bytes, tables as spreadsheets, databases."""

from __future__ import annotations

import io
import logging
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Cell styles by number: 0 none, 1 header, 2 section, 3 data, 4 data of every other row, 5 border alone.
STYLES = f"""<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{MAIN}">
<fonts count="4"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font><font><b/><sz val="10"/><name val="Calibri"/></font><font><sz val="10"/><name val="Calibri"/></font></fonts>
<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF4472C4"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E2F3"/></patternFill></fill></fills>
<borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="6"><xf/><xf fontId="1" fillId="2" borderId="1" applyAlignment="1"><alignment horizontal="center" vertical="center" wrapText="1"/></xf><xf fontId="2" borderId="1" applyAlignment="1"><alignment horizontal="left" vertical="top" wrapText="1"/></xf>
<xf fontId="3" borderId="1" applyAlignment="1"><alignment horizontal="left" vertical="top" wrapText="1"/></xf><xf fontId="3" fillId="3" borderId="1" applyAlignment="1"><alignment horizontal="left" vertical="top" wrapText="1"/></xf><xf borderId="1"/></cellXfs></styleSheet>"""


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def width_of(values: list[str]) -> int:
    """The longest word or a third of the text, within 8..60, and two more within 60."""
    need = [min(max(max(map(len, v.split()), default=0), len(v) // 3), 60) for v in values if v]
    return min(max([8, *need]) + 2, 60)


def sheet(rows: list[dict], col_count: int, spans: bool = True, title: str = "Table") -> bytes:
    """A styled one-sheet workbook of table rows (row_type, cells of value and colspan).

    spans: cells take as many columns as they span, merged, and section rows have a style of their own (tables of word-processor documents);
    otherwise a cell takes one column whatever it spans and section rows look like data (tables of pages).
    """
    lines, merges, columns = [], [], {}
    for i, row in enumerate(rows, 1):
        cells, at = [], 1
        kind = row["row_type"]
        style = 1 if kind == "header" else 2 if kind == "section" and spans else 4 if i % 2 else 3
        for c in row["cells"]:
            n = c["colspan"] if spans else 1
            cells.append(f'<c r="{column_name(at)}{i}" t="inlineStr" s="{style}"><is><t xml:space="preserve">{escape(clean(c["value"]))}</t></is></c>')
            columns.setdefault(at, []).append(c["value"])
            if n > 1:
                merges.append(f'<mergeCell ref="{column_name(at)}{i}:{column_name(at + n - 1)}{i}"/>')
                cells += [f'<c r="{column_name(x)}{i}" s="5"/>' for x in range(at + 1, at + n)]
            at += n
        lines.append(f'<row r="{i}">{"".join(cells)}</row>')
    widths = "".join(f'<col min="{k}" max="{k}" width="{width_of(columns.get(k, []))}" customWidth="1"/>' for k in range(1, col_count + 1))
    pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    body = f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}">{pane}{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{"".join(lines)}</sheetData>'
    body += f'<mergeCells count="{len(merges)}">{"".join(merges)}</mergeCells></worksheet>' if merges else "</worksheet>"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(title, {chr(34): "&quot;"})}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": body,
        "xl/styles.xml": STYLES,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def clean(text: str) -> str:
    """Without the control characters that XML can't hold."""
    return "".join(c for c in text if c >= " " or c in "\t\n\r")


def sheets(blocks: DataFrame, spans: bool = True) -> DataFrame:
    """block_id, name (tables/<block_id>.xlsx) and content of the table blocks (block_id, type, col_count, rows)."""

    def run(batches):
        for b in batches:
            out = []
            for block, n, rows in zip(b["block_id"], b["col_count"], b["rows"]):
                plain = [{"row_type": r["row_type"], "cells": [{"value": c["value"] or "", "colspan": c["colspan"] or 1} for c in r["cells"]]} for r in rows]
                out.append((block, f"tables/{block}.xlsx", sheet(plain, int(n), spans)))
            yield pd.DataFrame(out, columns=["block_id", "name", "content"])

    return blocks.where("type = 'table' AND rows IS NOT NULL").select("block_id", "col_count", "rows").mapInPandas(run, "block_id string, name string, content binary")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes each row's content to root/name, from the tasks; gives name, size. root is a path or a URI that pyarrow knows (file, hdfs, s3, gs; s3a counts as s3)."""

    def run(batches):
        from pyarrow import fs as arrow_fs

        fs, base = arrow_fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1) if "://" in root else f"file://{root}")
        for b in batches:
            for name, content in zip(b["name"], b["content"]):
                path = f"{base}/{name}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(bytes(content))
            yield pd.DataFrame({"name": b["name"], "size": [len(c) for c in b["content"]]})

    return files.select("name", "content").mapInPandas(run, "name string, size long")


def write_images(blocks: DataFrame, root: str) -> DataFrame:
    """The images of read_blocks written under root/<doc_id>/<image_ref>."""
    named = blocks.where("type = 'image' AND blob IS NOT NULL").select(F.concat_ws("/", "doc_id", "image_ref").alias("name"), F.col("blob").alias("content"))
    return write_files(named, root)


def append_facts(rows: DataFrame, root: str) -> bool:
    """Adds rows to a table of facts. The work goes on where that fails: a warning, and False."""
    try:
        rows.write.mode("append").parquet(root)
    except Exception as e:  # noqa: BLE001
        log.warning("facts for %s weren't written: %s", root, str(e)[:500])
        return False
    return True


def json_files(documents: DataFrame, name: str, suffix: str = ".json") -> DataFrame:
    """name, content: each row as a JSON file named by a column, for write_files; nulls are written too."""
    body = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false", "pretty": "true"})
    return documents.select(F.concat(F.col(name).cast("string"), F.lit(suffix)).alias("name"), body.cast("binary").alias("content"))


def documents_of(blocks: DataFrame, source_format: str = "docx") -> DataFrame:
    """One row for each document of read_blocks, its blocks in their order, as JSON documents have them."""
    from docloom.sources.schemas import BLOCK

    fields = [f.split(" ", 1)[0] for f in BLOCK.split(", ")]
    grouped = blocks.where("error IS NULL").groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("b"), F.max("page").alias("total_pages"))
    plain = F.transform("b", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return grouped.select("doc_id", F.element_at(F.split("path", "/"), -1).alias("source_filename"), F.lit(source_format).alias("source_format"), "total_pages", plain.alias("blocks"))


def uploads(files: DataFrame, order: str = "seq") -> DataFrame:
    """name, content of uploaded files (seq, filename, content): ``NNN_<safe name>`` by their order within the upload."""
    from pyspark.sql import Window

    from docloom.functions import text as T

    n = F.row_number().over(Window.partitionBy("upload").orderBy(order)) if "upload" in files.columns else F.row_number().over(Window.orderBy(order))
    name = F.concat(F.format_string("%03d_", n), T.safe_upload_name(F.coalesce("filename", F.lit(T.UPLOADED))))
    return files.select(*(["upload"] if "upload" in files.columns else []), name.alias("name"), "content")


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 10, **options: str) -> DataFrame:
    """A database table by JDBC; with a numeric key and its bounds read in parts, each over a connection of its own."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()
