"""Queries over the state of collections: gates, counters, merges and responses. Imported by the catalog, which they add to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B
from docloom.operators import ledger as L
from docloom.sources import adapters as A
from docloom.sources.schemas import ROWS, STATUSES

from .catalog import query


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN least(pow(2.0, p_partkey % 6) * 2, 30.0) WHEN p_partkey % 6 < 3 THEN pow(2.0, p_partkey % 6) END AS seconds FROM part""")
def backoff_schedule(spark, sf_dir):
    return A.load(spark, sf_dir, "part").select("p_partkey", T.backoff_seconds(F.col("p_partkey") % 6, F.col("p_size") % 2 == 0).alias("seconds"))


@query("SELECT p_partkey, 'parse_' || ['docx', 'pdf', 'xlsx'][(p_partkey % 3) + 1] AS stage FROM part")
def stage_names(spark, sf_dir):
    ext = F.get(F.array(*map(F.lit, (".docx", ".pdf", ".xlsx"))), (F.col("p_partkey") % 3).cast("int"))
    return A.load(spark, sf_dir, "part").select("p_partkey", T.stage_name(ext).alias("stage"))


@query(f"WITH {A.PARSE_METRICS} SELECT tender_id, count(*) FILTER (status = 'success' AND stage LIKE 'parse%') AS parsed, count(*) FILTER (status = 'success' AND stage NOT LIKE 'parse%') AS other, count(*) FILTER (status = 'error') AS errors FROM parse_metrics GROUP BY tender_id")
def run_counters(spark, sf_dir):
    good, parse = F.col("status") == "success", F.col("stage").startswith("parse")
    return A.parse_metrics(spark, sf_dir).groupBy("tender_id").agg(F.count_if(good & parse).alias("parsed"), F.count_if(good & ~parse).alias("other"), F.count_if(F.col("status") == "error").alias("errors"))


_STATUS_LIST = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"


@query(f"SELECT c_custkey, {_STATUS_LIST}[(c_custkey % {len(STATUSES)}) + 1] AS status, c_custkey % {len(STATUSES)} BETWEEN 2 AND {len(STATUSES) - 2} AS skip_extract FROM customer")
def status_gate(spark, sf_dir):
    """Whether extraction is done already: by the order of the states, not of their names."""
    names = F.array(*map(F.lit, STATUSES))
    status = F.get(names, (F.col("c_custkey") % len(STATUSES)).cast("int"))
    rank = F.array_position(names, F.col("status"))
    done = (rank >= STATUSES.index("extracted") + 1) & (F.col("status") != "failed")
    return A.load(spark, sf_dir, "customer").select("c_custkey", status.alias("status")).withColumn("skip_extract", done)


@query("""WITH o AS (SELECT s_suppkey AS k, s_name AS status, s_nationkey AS n FROM supplier), n AS (SELECT c_nationkey * 7::BIGINT AS k, 'NEW' AS status, CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE count(*) END AS n FROM customer GROUP BY c_nationkey)
  SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, CAST(coalesce(nullif(n.n, 0), o.n) AS INT) AS n FROM o FULL JOIN n ON o.k = n.k""")
def index_merge(spark, sf_dir):
    """The state always follows the change, the count only where the change has one that isn't 0."""
    old = A.load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("status"), F.col("s_nationkey").alias("n"))
    new = A.load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("c"))
    new = new.select((F.col("c_nationkey").cast("long") * 7).alias("k"), F.lit("NEW").alias("status"), F.when(F.col("c_nationkey") % 3 == 0, 0).otherwise(F.col("c")).alias("n"))
    return L.upsert(old, new.withColumn("n", F.nullif("n", F.lit(0))), ["k"], ["status", "n"], [])


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'q' || l.quality END AS doc_type, coalesce('title ' || l.toxic, d.source) AS title FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def passport_upsert(spark, sf_dir):
    """Passport rows replaced by those of JSON documents; a missing title falls back to the file's name."""
    body = F.to_json(F.struct(F.concat(F.lit("q"), "quality").alias("doc_type"), F.concat(F.lit("title "), "toxic").alias("title")))
    read = F.from_json(body, "doc_type string, title string")
    changes = A.load(spark, sf_dir, "labels").select("doc_id", read["doc_type"].alias("doc_type"), read["title"].alias("title"))
    current = A.load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("title"))
    return L.upsert(current, changes, ["doc_id"], ["title"], ["doc_type"])


_STAMPS = " || ',' || ".join(f"""coalesce('"{s}":"' || strftime(max(queued_at) FILTER (status = '{s}'), '%Y-%m-%d %H:%M:%S') || '"', '"{s}":null')""" for s in L.JOB_STATUSES)


@query(f"""WITH {A.PIPELINE_JOBS} SELECT tender_id, count(*) FILTER (status = 'completed') AS document_count, '{{' || {_STAMPS} || '}}' AS timestamps FROM jobs GROUP BY tender_id""")
def status_response(spark, sf_dir):
    jobs = A.pipeline_jobs(spark, sf_dir)
    times = L.status_times(jobs.withColumn("at", F.col("queued_at")), L.JOB_STATUSES)
    done = jobs.where("status = 'completed'").groupBy("tender_id").agg(F.count("*").alias("n"))
    stamps = F.map_from_arrays(F.array(*map(F.lit, L.JOB_STATUSES)), F.array(*[F.date_format(f"{s}_at", "yyyy-MM-dd HH:mm:ss") for s in L.JOB_STATUSES]))
    return times.join(done, "tender_id", "left").select("tender_id", F.coalesce("n", F.lit(0)).alias("document_count"), F.to_json(stamps, {"ignoreNullFields": "false"}).alias("timestamps"))


_CELL = """'<' || tag || CASE WHEN x = '' THEN ' colspan="2"' ELSE '' END || CASE WHEN x = 'R' THEN ' rowspan="3"' ELSE '' END || '>' || replace(replace(x, '&', '&amp;'), '<', '&lt;') || '</' || tag || '>'"""


@query(f"""WITH {A.TABLE_ROWS}, c AS (SELECT tbl, ord, cells, CASE WHEN ord = 0 THEN 'th' ELSE 'td' END AS tag, CASE WHEN ord = 0 THEN 'header' WHEN len(list_filter(cells, lambda c: c <> '')) <= 2 THEN 'section' ELSE 'data' END AS row_type FROM rows_),
  t AS (SELECT tbl, string_agg('<tr class="' || row_type || '">' || array_to_string(list_transform(cells, lambda x: {_CELL}), '') || '</tr>', '' ORDER BY ord) AS body FROM c GROUP BY tbl)
  SELECT tbl, '<section class="block ' || 'table' || '-block" data-block-id="t' || tbl || '"><div class="block-meta">block: t' || tbl || '</div><table>' || body || '</table></section>' AS html FROM t""")
def render_tables(spark, sf_dir):
    """Blank cells span two columns and cells of one flag three rows, as the rules for cells with spans have it; others have no attributes."""
    rows = A.table_rows(spark, sf_dir).withColumn("row_type", B.row_class(F.col("cells"), F.col("ord") == 0, F.size("cells"), strict=False))
    span = lambda v: F.struct(v.alias("value"), F.when(v == "", 2).otherwise(1).alias("colspan"), F.when(v == "R", 3).otherwise(1).alias("rowspan"))
    t = rows.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("ord", "row_type", F.transform("cells", span).alias("cells")))).alias("rows")).withColumn("bid", F.concat(F.lit("t"), F.col("tbl").cast("string")))
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("int")
    return t.select("tbl", B.block_html(F.lit("table"), F.col("bid"), none, F.lit(0), F.col("rows"), none, T.metadata_line(F.col("bid"), nothing, nothing, none)).alias("html"))


@query("""SELECT page_id, '<section class="block image-block" data-block-id="p' || page_id || '"><div class="block-meta">block: p' || page_id || '</div>' || CASE WHEN page_id % 3 <> 0 THEN '<img src="' || replace(url, '&', '&amp;') || '" alt="p' || page_id || '" />' ELSE '' END
  || CASE WHEN page_id % 2 = 0 THEN '<pre class="ocr-text">text &lt;' || page_id || '&gt;</pre>' ELSE '' END || '</section>' AS html FROM pages""")
def render_images(spark, sf_dir):
    bid, none = F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit(None).cast("string")
    ocr = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("text <"), F.col("page_id").cast("string"), F.lit(">")))
    image, meta = F.when(F.col("page_id") % 3 != 0, F.col("url")), T.metadata_line(bid, F.lit(None).cast("int"), F.lit(None).cast("int"), none)
    html = B.block_html(F.lit("image"), bid, none, F.lit(0), F.lit(None).cast(ROWS), F.coalesce(ocr, F.lit("")), meta, image)
    return A.load(spark, sf_dir, "pages").select("page_id", html.alias("html"))


@query("SELECT conv_id, count(*) AS n, list(role ORDER BY turn) AS roles, CAST(sum(trunc(length(text) / CAST(2.7 AS DOUBLE))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    m = A.load(spark, sf_dir, "conversations").withColumn("t", T.estimate_tokens(F.col("text")))
    return m.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.sum("t").alias("tokens")).select("conv_id", "n", F.col("m.role").alias("roles"), "tokens")


@query("SELECT doc_id, substr(text, 1, 200) AS text_preview, length(text)::INT AS text_length FROM documents")
def chunk_preview(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 200).alias("text_preview"), F.length("text").alias("text_length"))


@query("""SELECT o_orderkey AS doc_id, printf('doc_%03d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4, o_orderkey)) AS name FROM orders""")
def document_numbers(spark, sf_dir):
    """Names within each archive (customer), in the order of archive level, then path."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey") % 4, "o_orderkey"))
    return A.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), T.numbered("doc_", n).alias("name"))
