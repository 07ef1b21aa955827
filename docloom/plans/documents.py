"""Queries over documents as files and pages: blocks of pages, index, names, updates. Imported by the catalog, which they add to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B
from docloom.operators import external
from docloom.operators import ledger as L
from docloom.operators import pages as P
from docloom.operators import retrieval as R
from docloom.sources import adapters as A

from .catalog import _PART, _RUNS, _TOKENS, ORACLES, _line_blocks, _part_rows, _stitch_sql, query

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_PAGES = f"""n AS (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS seq FROM lineitem),
  el AS (SELECT doc_id, seq, (seq - 1) // 3 + 1 AS page, (seq * 7) % 5 AS top, CASE WHEN l_partkey % 7 = 3 THEN 'scan' WHEN l_partkey % 4 = 0 THEN 'text' ELSE 'table' END AS kind,
    CASE WHEN l_partkey % 3 = 0 THEN seq || '. part ' ELSE 'part ' END || l_partkey AS content, l_suppkey % 2 + 3 AS ncols FROM n)"""


def page_elements(spark, sf_dir):
    """Line items as what a page reader finds in the pages of their orders."""
    part, seq = F.col("l_partkey"), F.col("seq")
    rows = A.load(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))).withColumn("ncols", F.col("l_suppkey") % 2 + 3)
    kind = F.when(part % 7 == 3, "scan").when(part % 4 == 0, "text").otherwise("table")
    content = F.concat(F.when(part % 3 == 0, F.concat(seq.cast("string"), F.lit(". part "))).otherwise("part "), part.cast("string"))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "seq", (F.floor((seq - 1) / 3) + 1).cast("int").alias("page"), ((seq * 7) % 5).alias("top"), kind.alias("kind"), content.alias("content"), F.when(kind == "table", _part_rows()).alias("raw_rows"))


_PAGE_BLOCKS = f"""{_PAGES}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, top, CASE kind WHEN 'text' THEN 0 ELSE 1 END, seq) AS pos FROM el WHERE kind <> 'scan'),
  l AS (SELECT *, lag(kind) OVER w AS pk, lag(ncols) OVER w AS pn, lead(page) OVER w AS closed FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  s AS (SELECT *, sum(CASE WHEN kind = 'table' AND NOT coalesce(pk = 'table' AND pn = ncols, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS session FROM l),
  g AS (SELECT doc_id, session, min(pos) AS pos, min(page) AS page, last(closed ORDER BY pos) AS closed, min(ncols) AS ncols, list({_PART} ORDER BY pos) AS parts FROM s WHERE kind = 'table' GROUP BY doc_id, session),
  r AS (SELECT *, {_stitch_sql('parts')} AS rows FROM g),
  t AS (SELECT doc_id, pos, 'table' AS type, page, coalesce(closed, (SELECT max(page) FROM el WHERE el.doc_id = r.doc_id)) AS page_end, ncols, array_to_string(list_transform(range(1, len(rows) + 1), lambda i: CASE WHEN i = 1 THEN 'header' WHEN ncols >= 4 AND len(list_filter(rows[i], lambda c: c <> '')) <= 2 THEN 'section' ELSE 'data' END
      || ':' || array_to_string(rows[i], '|')), chr(10)) AS text, NULL AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM r),
  b AS (SELECT * FROM t UNION ALL SELECT doc_id, pos, 'text', page, NULL, NULL, content, nullif(regexp_extract(content, '^([0-9]+(?:[.][0-9]+)*)[\\s.)]', 1), ''), NULL FROM o WHERE kind = 'text'),
  f AS (SELECT *, row_number() OVER w AS n, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_path FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  c AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k FROM (SELECT DISTINCT doc_id, page FROM el WHERE kind = 'scan'))
  SELECT doc_id, (n - 1)::INT AS ord, CASE type WHEN 'table' THEN printf('%d_tbl_%03d', doc_id, k) ELSE printf('%d_b%03d', doc_id, n) END AS block_id, type, page::INT AS page, page_end::INT AS page_end, section_path, ncols::INT AS col_count, text, NULL AS ocr_status FROM f
  UNION ALL SELECT doc_id, (k - 1 + coalesce((SELECT count(*) FROM f WHERE f.doc_id = c.doc_id), 0))::INT, printf('%d_scan_%03d', doc_id, page), 'image', page::INT, NULL, NULL, NULL, NULL, 'pending' FROM c"""


@query(f"WITH {_PAGE_BLOCKS}")
def page_blocks(spark, sf_dir):
    """Texts, tables over several pages and scans of each order's pages, numbered and in their order."""
    rows = F.array_join(F.transform("rows", lambda r: F.concat(r["row_type"], F.lit(":"), F.array_join(r["cells"], "|"))), "\n")
    blocks = P.page_blocks(page_elements(spark, sf_dir))
    return blocks.select("doc_id", "ord", "block_id", "type", "page", "page_end", "section_path", "col_count", F.when(F.col("type") == "table", rows).otherwise(F.col("content")).alias("text"), "ocr_status")


@query(f"WITH pb AS (WITH {_PAGE_BLOCKS}) SELECT doc_id, ord, block_id, page FROM pb WHERE type = 'image'")
def scan_blocks(spark, sf_dir):
    return P.scan_blocks(page_elements(spark, sf_dir))


@query("""WITH w AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey, l_quantity AS x0, l_quantity + 2 AS x1, l_linenumber * 10.0 AS top, l_linenumber * 10.0 + 8 AS bottom FROM lineitem),
  b AS (SELECT o_orderkey AS page, 0.0 AS x0, (o_orderkey % 50)::DOUBLE AS x1, 15.0 AS top, 45.0 AS bottom FROM orders WHERE o_orderkey % 50 > 0)
  SELECT page, n, l_partkey, x0 FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = w.page AND (w.x0 + w.x1) / 2 >= b.x0 AND (w.x0 + w.x1) / 2 < b.x1 AND (w.top + w.bottom) / 2 >= b.top AND (w.top + w.bottom) / 2 < b.bottom)""")
def text_outside_tables(spark, sf_dir):
    i = A.load(spark, sf_dir, "lineitem")
    words = i.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), "l_partkey", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 2).alias("x1"), (F.col("l_linenumber") * 10.0).alias("top"), (F.col("l_linenumber") * 10.0 + 8).alias("bottom"))
    boxes = A.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.lit(0.0).alias("x0"), (F.col("o_orderkey") % 50).cast("double").alias("x1"), F.lit(15.0).alias("top"), F.lit(45.0).alias("bottom"))
    return P.outside(words, boxes, ["page"]).select("page", "n", "l_partkey", "x0")


@query(f"WITH sc AS ({ORACLES['section_chunks']}) SELECT doc_id || '#' || chunk_no AS chunk_id, doc_id, chunk_no, section_path, text_preview, text_length, len(block_ids)::INT AS n_blocks, {_TOKENS.format('text')} AS tokens FROM sc")
def index_chunks(spark, sf_dir):
    c = R.chunk_corpus(_line_blocks(spark, sf_dir))
    return c.select("chunk_id", "doc_id", "chunk_no", "section_path", "text_preview", "text_length", F.size("block_ids").alias("n_blocks"), "tokens")


def _lengths(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: length, words and lines."""
    return [[float(len(t)), float(len(t.split(" "))), float(t.count("\n"))] for t in texts]


@query(f"WITH sc AS ({ORACLES['section_chunks']}) SELECT 'lengths' AS model, 3 AS dim, count(*) AS chunks_count, list(DISTINCT doc_id ORDER BY doc_id) AS docs_indexed, CAST(sum(length(text)) AS DOUBLE) AS total FROM sc")
def build_index(spark, sf_dir):
    """The index's description from its chunks and vectors, and the sum of the vectors' first numbers."""
    chunks = R.chunk_corpus(_line_blocks(spark, sf_dir)).select("chunk_id", "doc_id", "text")
    index = chunks.join(external.embed(chunks, _lengths, "chunk_id"), "chunk_id")
    return R.config_of(index, "lengths").crossJoin(F.broadcast(index.agg(F.sum(F.col("vector")[0]).cast("double").alias("total"))))


@query(f"WITH {A.API_USAGE} SELECT tender_id, id, 'usage' AS origin FROM api_usage UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey, 'orders' FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT tender_id FROM api_usage)")
def collection_fallback(spark, sf_dir):
    """Each collection's own list, or where that is empty the other one, whole."""
    first = A.api_usage(spark, sf_dir).select("tender_id", "id", F.lit("usage").alias("origin"))
    second = A.load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("tender_id"), F.col("o_orderkey").alias("id"), F.lit("orders").alias("origin"))
    return L.collections_or_fallback(first, second, "tender_id")


@query(f"""WITH {A.TABLE_ROWS}, c AS (SELECT tbl, ord, cells, CASE WHEN ord = 0 THEN 'header' WHEN len(list_filter(cells, lambda c: c <> '')) <= 2 THEN 'section' ELSE 'data' END AS row_type FROM rows_)
  SELECT tbl, list(cells ORDER BY ord) FILTER (row_type = 'header') [1] AS header, count(*) FILTER (row_type = 'data') AS n_data, coalesce(string_agg(array_to_string(cells, '|'), ';' ORDER BY ord) FILTER (row_type = 'section'), '') AS sections FROM c GROUP BY tbl""")
def table_parts(spark, sf_dir):
    """Header, number of data rows and section rows of each table, from its array of rows."""
    rows = A.table_rows(spark, sf_dir).withColumn("row_type", B.row_class(F.col("cells"), F.col("ord") == 0, F.size("cells"), strict=False))
    t = rows.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("ord", "row_type", "cells"))).alias("rows"))
    r = F.col("rows")
    return t.select("tbl", B.header_of(r).alias("header"), F.size(B.rows_of(r, "data")).cast("long").alias("n_data"), F.array_join(F.transform(B.rows_of(r, "section"), lambda x: F.array_join(x["cells"], "|")), ";").alias("sections"))


@query("""WITH b AS (SELECT doc_id, source, lang, [{'type': 'text', 'v': lang}, {'type': 'table', 'v': source}, {'type': 'text', 'v': source}] AS blocks FROM documents)
  SELECT doc_id, list_transform(list_filter(blocks, lambda x: x.type = 'text'), lambda x: x.v) AS texts, len(list_filter(blocks, lambda x: x.type = 'image'))::INT AS images FROM b""")
def blocks_of_kind(spark, sf_dir):
    block = lambda kind, v: F.struct(F.lit(kind).alias("type"), F.col(v).alias("v"))
    blocks = F.array(block("text", "lang"), block("table", "source"), block("text", "source"))
    return A.load(spark, sf_dir, "documents").select("doc_id", F.transform(B.of_kind(blocks, "text"), lambda x: x["v"]).alias("texts"), F.size(B.of_kind(blocks, "image")).alias("images"))


@query(f"WITH {A.TABLE_ROWS} SELECT tbl, ord::INT AS ord, list_transform(list_filter(range(1, len(cells) + 1), lambda i: i = 1 OR cells[i] <> cells[i - 1]), lambda i: cells[i]) AS cells FROM rows_")
def merged_cells(spark, sf_dir):
    """Cells that are listed again for each column that they cover count once; here equal neighbours are taken for one cell."""
    same = F.transform("cells", lambda c: F.struct(c.alias("id"), c.alias("value")))
    return A.table_rows(spark, sf_dir).select("tbl", "ord", F.transform(B.merge_repeated(same), lambda c: c["value"]).alias("cells"))


_UPLOAD = "concat(p_name, ' (', p_size, ')', ['.PDF', '.do cx', '', '.tar.GZ', '.'][(p_partkey % 5) + 1])"


@query(f"""WITH f AS (SELECT p_partkey, {_UPLOAD} AS name FROM part), e AS (SELECT *, regexp_extract(name, '^.+?([.][^.]+)$', 1) AS ending FROM f)
  SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(substr(name, 1, length(name) - length(ending)), '[^._0-9a-zа-яA-ZА-Я-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'uploaded_document') || regexp_replace(lower(ending), '[^a-z0-9.]+', '', 'g') AS name FROM e""")
def upload_names(spark, sf_dir):
    endings = F.array(*map(F.lit, (".PDF", ".do cx", "", ".tar.GZ", ".")))
    name = F.concat("p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"), F.get(endings, (F.col("p_partkey") % 5).cast("int")))
    return A.load(spark, sf_dir, "part").select("p_partkey", T.safe_upload_name(name).alias("name"))


@query("SELECT event_id, ((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 1000)::BIGINT AS elapsed_ms FROM events")
def elapsed_times(spark, sf_dir):
    first = F.min("ts").over(Window.partitionBy("user_id"))
    return A.load(spark, sf_dir, "events").select("event_id", T.elapsed_ms(first, F.col("ts")).alias("elapsed_ms"))


@query("""WITH c AS (SELECT doc_id, quality * 1000 AS tokens FROM labels UNION ALL SELECT item_id + 1000000000, 5 FROM benchmark)
  SELECT d.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'parsed' ELSE d.lang END AS status, CASE WHEN c.doc_id IS NOT NULL THEN c.tokens ELSE d.n_chars END::BIGINT AS tokens, d.source FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def update_parsed(spark, sf_dir):
    """Rows that are there are changed; changes to documents that aren't insert nothing."""
    current = A.load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("status"), F.col("n_chars").alias("tokens"), "source")
    changes = A.load(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 1000).cast("long").alias("tokens"))
    changes = changes.unionByName(A.load(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), F.lit(5).cast("long").alias("tokens")))
    return L.update(current, changes.withColumn("status", F.lit("parsed")), ["doc_id"], ["status", "tokens"])


@query("""WITH cur AS (SELECT source AS k, count(*) AS n, 'old ' || min(lang) AS routing FROM documents GROUP BY source), chg AS (SELECT source AS k, count(*) AS n, 'map of ' || source AS routing FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY source UNION ALL SELECT r_name, 0, 'map of ' || r_name FROM region)
  SELECT coalesce(chg.k, cur.k) AS source, coalesce(chg.n, cur.n) AS passports_count, coalesce(chg.routing, cur.routing) AS routing FROM cur FULL JOIN chg ON cur.k = chg.k""")
def document_map_upsert(spark, sf_dir):
    d, labels = A.load(spark, sf_dir, "documents"), A.load(spark, sf_dir, "labels")
    current = d.groupBy("source").agg(F.count("*").alias("passports_count"), F.concat(F.lit("old "), F.min("lang")).alias("routing"))
    named = d.select("doc_id", "source").join(labels.where("quality = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("passports_count"))
    named = named.unionByName(A.load(spark, sf_dir, "region").select(F.col("r_name").alias("source"), F.lit(0).cast("long").alias("passports_count")))
    return L.upsert(current, named.withColumn("routing", F.concat(F.lit("map of "), "source")), ["source"], [], ["passports_count", "routing"])


@query(f"""WITH {A.NUMBERED_LINES}, k AS (SELECT doc_id, pos, CASE WHEN pos % 8 = 3 THEN 'table' ELSE 'text' END AS kind FROM numbered)
  SELECT doc_id, CAST(pos AS INT) AS pos, CASE kind WHEN 'table' THEN printf('%d_tbl_%03d', doc_id, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos)) ELSE printf('%d_b%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)) END AS block_id FROM k""")
def page_block_ids(spark, sf_dir):
    """Texts numbered by their place among all blocks, as in paged documents."""
    k = A.numbered_lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pos") % 8 == 3, "table").otherwise("text").alias("kind"))
    return B.number_together(k, "doc_id", "pos", "kind").select("doc_id", "pos", "block_id")


@query("SELECT l_orderkey AS page, min(l_linenumber * 10.0) AS top, count(*) AS words FROM lineitem GROUP BY l_orderkey")
def page_tops(spark, sf_dir):
    """Each page's topmost word and number of words."""
    words = A.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 10.0).alias("top"), F.col("l_quantity").alias("x0"), F.lit("w").alias("text"))
    return P.page_text(words, ["page"]).select("page", "top", F.size(F.split("content", "[ \n]")).cast("long").alias("words"))
