"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B
from docloom.operators import ledger as L
from docloom.operators import retrieval as R
from docloom.sources import adapters as A
from docloom.sources.schemas import ROWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"

# operational analytics


@query(f"""WITH {A.API_USAGE} SELECT tender_id, count(*) AS total_calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(cents) / 100.0 AS total_cost, CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms,
  sum(CASE WHEN action = 'passport' THEN cents ELSE 0 END) / 100.0 AS passport_cost, sum(CASE WHEN action = 'ocr' THEN cents ELSE 0 END) / 100.0 AS ocr_cost,
  sum(CASE WHEN action = 'routing' THEN cents ELSE 0 END) / 100.0 AS routing_cost, sum(CASE WHEN action = 'answer' THEN cents ELSE 0 END) / 100.0 AS answer_cost FROM api_usage GROUP BY tender_id""")
def tender_costs(spark, sf_dir):
    costs = L.collection_costs(A.api_usage(spark, sf_dir))
    return costs.select(*[F.col(c).cast("double").alias(c) if c.endswith("_cost") else c for c in costs.columns])


@query(f"""WITH {A.PARSE_METRICS} SELECT stage, count(*) AS runs, CAST(round(avg(duration_ms)) AS BIGINT) AS avg_ms, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS BIGINT) AS p95_ms,
  max(duration_ms) AS max_ms, count(*) FILTER (status = 'error') AS errors FROM parse_metrics GROUP BY stage""")
def parse_speed(spark, sf_dir):
    return L.stage_speed(A.parse_metrics(spark, sf_dir))


@query(f"""WITH {A.API_USAGE} SELECT id, {STAMP.format('ts')} AS at, tender_id, action, status, duration_ms FROM api_usage
  WHERE status <> 'success' AND ts > (SELECT max(ts) FROM api_usage) - INTERVAL 24 HOURS""")
def recent_errors(spark, sf_dir):
    usage = A.api_usage(spark, sf_dir)
    with_end = usage.crossJoin(F.broadcast(usage.agg(F.max("ts").alias("end"))))
    return L.recent_errors(with_end, F.col("end")).select("id", stamp("ts").alias("at"), "tender_id", "action", "status", "duration_ms")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def tender_lookup(spark, sf_dir):
    return A.load(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"""WITH {A.API_USAGE}, t AS (SELECT CAST(c_custkey AS VARCHAR) AS tender_id FROM customer)
  SELECT tender_id, coalesce((SELECT sum(cents) FROM api_usage u WHERE u.tender_id = t.tender_id), 0) / 100.0 AS total_cost FROM t""")
def finalize_cost(spark, sf_dir):
    collections = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tender_id"))
    return L.collection_total(A.api_usage(spark, sf_dir), collections).withColumn("total_cost", F.col("total_cost").cast("double"))


@query(f"WITH {A.PIPELINE_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY queued_at DESC, id DESC) AS n FROM jobs) SELECT tender_id, id, status, CAST(priority AS INT) AS priority FROM r WHERE n = 1")
def latest_job(spark, sf_dir):
    return L.latest(A.pipeline_jobs(spark, sf_dir), ["tender_id"], F.desc("queued_at"), F.desc("id")).select("tender_id", "id", "status", "priority")


@query(f"""WITH {A.PIPELINE_JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY queued_at DESC, id DESC) AS n FROM jobs)
  SELECT CAST(c_custkey AS VARCHAR) AS tender_id, c_mktsegment AS segment, r.id AS job_id, r.status AS job_status FROM customer LEFT JOIN r ON r.tender_id = CAST(c_custkey AS VARCHAR) AND r.n = 1""")
def status_with_latest_job(spark, sf_dir):
    last = L.latest(A.pipeline_jobs(spark, sf_dir), ["tender_id"], F.desc("queued_at"), F.desc("id"))
    c = A.load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tender_id"), F.col("c_mktsegment").alias("segment"))
    return c.join(last, "tender_id", "left").select("tender_id", "segment", F.col("id").alias("job_id"), F.col("status").alias("job_status"))


@query(f"WITH {A.PIPELINE_JOBS} SELECT id, tender_id, CAST(priority AS INT) AS priority FROM jobs WHERE status = 'queued' ORDER BY priority DESC, queued_at, id LIMIT 10")
def queue_topk(spark, sf_dir):
    return L.queue_order(A.pipeline_jobs(spark, sf_dir), 10).select("id", "tender_id", "priority")


@query(f"""WITH {A.PIPELINE_JOBS} SELECT tender_id, {', '.join(f"strftime(max(queued_at) FILTER (status = '{s}'), '%Y-%m-%d %H:%M:%S') AS {s}_at" for s in L.JOB_STATUSES)} FROM jobs GROUP BY tender_id""")
def status_pivot(spark, sf_dir):
    times = L.status_times(A.pipeline_jobs(spark, sf_dir).withColumn("at", F.col("queued_at")), L.JOB_STATUSES)
    return times.select("tender_id", *[stamp(f"{s}_at").alias(f"{s}_at") for s in L.JOB_STATUSES])


@query(f"""WITH {A.PIPELINE_JOBS} SELECT tender_id, arg_max(status, id) AS status, CASE WHEN arg_max(status, id) = 'failed' THEN substr(repeat('failed job ' || max(id) || ' ', 300), 1, 2000) END AS message, count(*) AS events FROM jobs GROUP BY tender_id""")
def job_state(spark, sf_dir):
    jobs = A.pipeline_jobs(spark, sf_dir).groupBy("tender_id").agg(F.max_by("status", "id").alias("status"), F.max("id").alias("id"), F.count("*").alias("events"))
    text = F.repeat(F.concat(F.lit("failed job "), F.col("id").cast("string"), F.lit(" ")), F.lit(300))
    return jobs.select("tender_id", "status", F.when(F.col("status") == "failed", F.substring(text, 1, 2000)).alias("message"), "events")


# documents as a collection


@query("SELECT source, count(*) AS document_count, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents GROUP BY source")
def tender_sizes(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("document_count"), F.sum("n_chars").alias("total_size"))


@query(f"""WITH {A.NUMBERED_LINES}, k AS (SELECT doc_id, line, CASE WHEN pos % 8 = 3 THEN 'table' WHEN pos % 8 = 5 THEN 'image' ELSE 'text' END AS kind FROM numbered)
  SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (kind = 'text') AS text_blocks, count(*) FILTER (kind = 'table') AS table_blocks, count(*) FILTER (kind = 'image') AS image_blocks,
  CAST(trunc((sum(CASE WHEN kind = 'text' THEN length(line) ELSE 0 END) + greatest(count(*) FILTER (kind = 'text') - 1, 0)) / CAST(2.7 AS DOUBLE)) AS INT) AS estimated_tokens FROM k GROUP BY doc_id""")
def doc_block_counts(spark, sf_dir):
    kind = F.when(F.col("pos") % 8 == 3, "table").when(F.col("pos") % 8 == 5, "image").otherwise("text")
    n = {k: F.count_if(F.col("kind") == k) for k in ("text", "table", "image")}
    chars = F.sum(F.when(F.col("kind") == "text", F.length("line")).otherwise(0)) + F.greatest(n["text"] - 1, F.lit(0))
    return A.numbered_lines(spark, sf_dir).withColumn("kind", kind).groupBy("doc_id").agg(
        F.count("*").alias("total_blocks"), *[v.alias(f"{k}_blocks") for k, v in n.items()], F.floor(chars / F.lit(T.CHARS_PER_TOKEN)).cast("int").alias("estimated_tokens")
    )


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id")
def list_documents(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id")


@query("SELECT doc_id, quality AS value, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, -1, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def source_fallback(spark, sf_dir):
    first = A.load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("value"), F.lit("labels").alias("origin"))
    return L.or_fallback(first, A.load(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("value"), F.lit("documents").alias("origin")), ["doc_id"])


@query("SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_anti_join(spark, sf_dir):
    return L.without_match(A.load(spark, sf_dir, "documents").select("doc_id", "n_chars"), A.load(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT o_orderkey AS k, 'order without lines' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'line without order' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def fk_orphans(spark, sf_dir):
    o, i = A.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), A.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    return L.without_match(o, i, ["k"]).withColumn("problem", F.lit("order without lines")).unionByName(L.without_match(i, o, ["k"]).distinct().withColumn("problem", F.lit("line without order")))


# text and scalar functions


@query(f"WITH {A.NUMBERED_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, sec AS section FROM nums WHERE sec IS NOT NULL")
def section_number(spark, sf_dir):
    numbered = A.numbered_lines(spark, sf_dir).where(F.col("line").rlike(r"(?U)^\s*\p{Nd}+(?:[.]\p{Nd}+)*[\s.)]"))  # the cheap test first: the number itself is cut out of few lines
    return numbered.select("doc_id", "pos", T.section_number(F.col("line")).alias("section")).where(F.col("line").isNotNull() & T.section_number(F.col("line")).isNotNull())


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\r\n]', ' ', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


_TOKENS = "list_transform(regexp_extract_all({}, '([0-9A-Za-zЁёА-Яа-я]+)', 1), lambda x: lower(x))"


@query(f"SELECT conv_id, turn, {_TOKENS.format('text')} AS tokens FROM conversations")
def tokenize(spark, sf_dir):
    return A.load(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("tokens"))


@query(f"WITH t AS (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents) SELECT doc_id, tokens, CAST(len(tokens) AS INT) AS n_tokens FROM t WHERE len(tokens) > 0")
def bm25_corpus(spark, sf_dir):
    some = A.load(spark, sf_dir, "documents").where(T.has_tokens(F.col("text")))
    return some.select("doc_id", T.tokens(F.col("text")).alias("tokens")).withColumn("n_tokens", F.size("tokens"))


_TOK = "CAST(trunc(length(text) / CAST(2.7 AS DOUBLE)) AS INT)"


@query(f"SELECT doc_id, {_TOK} AS tokens, {_TOK} <= 120380 AS fits FROM documents")
def estimate_tokens(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.fits_context(F.col("text")).alias("fits"))


@query(r"SELECT doc_id, CASE WHEN regexp_replace(t, '^\s+|\s+$', '', 'g') = '' THEN 'skip' WHEN trunc(length(t) / CAST(2.7 AS DOUBLE)) <= 120380 THEN 'single' ELSE 'chunked' END AS strategy FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ' WHEN doc_id % 9 = 1 THEN repeat(text, 200) ELSE text END AS t FROM documents)")
def passport_strategy(spark, sf_dir):
    i = F.col("doc_id") % 9
    t = F.when(i == 0, " ").when(i == 1, F.repeat("text", F.lit(200))).otherwise(F.col("text"))
    return A.load(spark, sf_dir, "documents").select("doc_id", T.passport_strategy(t).alias("strategy"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(least(greatest(p_size % 10, 1), 6) AS INT) END AS level FROM part")
def heading_level(spark, sf_dir):
    style = F.when(F.col("p_size") % 3 == 0, "Normal").otherwise(F.concat(F.lit("Heading "), (F.col("p_size") % 10).cast("string")))
    return A.load(spark, sf_dir, "part").select("p_partkey", T.heading_level(style).alias("level"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    return A.load(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query("SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^._0-9a-zа-яA-ZА-Я-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'uploaded_document') AS name FROM pages")
def safe_name(spark, sf_dir):
    return A.load(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


_NAME_SQL = "concat(regexp_replace(p_name, ' ', '_', 'g'), ['.PDF', '.docx', '.zip', '.xls', '', '.tar.7z', '.md'][(p_partkey % 7) + 1])"


def _file_names(spark, sf_dir):
    endings = F.array(*map(F.lit, (".PDF", ".docx", ".zip", ".xls", "", ".tar.7z", ".md")))
    return A.load(spark, sf_dir, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.get(endings, (F.col("p_partkey") % 7).cast("int"))).alias("name"))


_EXT_SQL = r"lower(regexp_extract(regexp_extract(name, '([^/]*)$', 1), '^.+(\.[^.]+)$', 1))"


@query(f"SELECT p_partkey, {_EXT_SQL} AS ext FROM (SELECT p_partkey, {_NAME_SQL} AS name FROM part)")
def file_ext(spark, sf_dir):
    return _file_names(spark, sf_dir).select("p_partkey", T.extension(F.col("name")).alias("ext"))


def _in(names):
    return "(" + ", ".join(f"'.{n}'" for n in names) + ")"


@query(f"""WITH e AS (SELECT p_partkey, {_EXT_SQL} AS ext FROM (SELECT p_partkey, {_NAME_SQL} AS name FROM part))
  SELECT p_partkey, CASE WHEN ext IN {_in(T.ARCHIVES)} THEN 'archive' WHEN ext IN {_in(T.NATIVE + T.CONVERTED + T.UNPARSED)} THEN 'document' ELSE 'ignored' END AS class,
  CASE WHEN ext IN {_in(T.NATIVE)} THEN substr(ext, 2) WHEN ext IN ('.doc', '.odt', '.rtf') THEN 'docx' WHEN ext IN ('.xls', '.ods') THEN 'xlsx' WHEN ext IN ('.ppt', '.odp', '.pptx') THEN 'pdf' ELSE 'unsupported' END AS reader FROM e""")
def ext_classify(spark, sf_dir):
    e = T.extension(F.col("name"))
    return _file_names(spark, sf_dir).select("p_partkey", T.extension_class(e).alias("class"), T.route(e).alias("reader"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' WHEN 2 THEN '.emf' ELSE '.png' END AS ext FROM part")
def mime_map(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("image/png", "IMAGE/JPEG", "image/x-emf", "image/unknown")))
    return A.load(spark, sf_dir, "part").select("p_partkey", T.image_extension(F.get(kinds, F.col("p_size") % 4)).alias("ext"))


@query("""SELECT event_id, regexp_replace(props, '^\\s+|\\s+$', '', 'g') AS body, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events""")
def json_unfence(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), "props"))
    return A.load(spark, sf_dir, "events").select("event_id", T.unfence(fenced).alias("body")).withColumn("k", F.from_json("body", "k int")["k"])


# sections and numbering


def _sections(spark, sf_dir):
    return A.numbered_lines(spark, sf_dir).withColumn("sec", T.section_number(F.col("line")))


@query(f"WITH {A.NUMBERED_LINES} SELECT doc_id, CAST(pos AS INT) AS pos, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM nums")
def section_fill(spark, sf_dir):
    return B.fill_section(_sections(spark, sf_dir), ["doc_id"], "pos", "sec").select("doc_id", "pos", "section")


@query(f"""WITH {A.NUMBERED_LINES}, g AS (SELECT *, sum(CASE WHEN is_heading AND sec IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM nums)
  SELECT doc_id, CAST(pos AS INT) AS pos, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id, r ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM g""")
def section_fill_reset(spark, sf_dir):
    return B.fill_section_reset(_sections(spark, sf_dir), ["doc_id"], "pos", "sec", "is_heading").select("doc_id", "pos", "section")


_RUNS = f"""{A.NUMBERED_LINES}, c AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM nums),
  r AS (SELECT *, sum(CASE WHEN sec IS NOT NULL AND sec IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run,
    coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), '__header__') AS label FROM c)"""


@query(f"WITH {_RUNS} SELECT doc_id, CAST(run AS BIGINT) AS run, label, min(pos)::INT AS first_pos, count(*) AS n_lines FROM r GROUP BY doc_id, run, label")
def section_runs(spark, sf_dir):
    return B.section_runs(_sections(spark, sf_dir), ["doc_id"], "pos", "sec").groupBy("doc_id", "run", "label").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines"))


_KIND_SQL = "CASE WHEN pos % 8 = 3 THEN 'table' ELSE 'text' END"


@query(f"""WITH {A.NUMBERED_LINES}, k AS (SELECT doc_id, pos, {_KIND_SQL} AS kind FROM numbered)
  SELECT doc_id, CAST(pos AS INT) AS pos, kind, printf(CASE kind WHEN 'table' THEN '%d_tbl_%03d' ELSE '%d_b%03d' END, doc_id, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos)) AS block_id FROM k""")
def block_ids(spark, sf_dir):
    k = A.numbered_lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("pos") % 8 == 3, "table").otherwise("text").alias("kind"))
    return B.number_blocks(k, "doc_id", "pos", "kind")


@query("""WITH u AS (SELECT DISTINCT l_orderkey AS n FROM lineitem), f AS (SELECT unnest(generate_series(1, (SELECT count(*) FROM u) + 25)) AS n)
  SELECT n::INT AS n, printf('user_doc_%03d', n) AS id FROM f WHERE n NOT IN (SELECT n FROM u) ORDER BY n LIMIT 25""")
def next_free_ids(spark, sf_dir):
    """Orders without line items leave gaps among the numbers in use."""
    ids = A.load(spark, sf_dir, "lineitem").select(F.format_string("user_doc_%03d", "l_orderkey").alias("id"))
    return L.next_free(ids, 25)


# packing lines, chunks, text of blocks

_PACK_ONE = """list_transform(string_split({t}, chr(10)), lambda l: {{'done': []::VARCHAR[], 'cur': [l], 'n': length(l)::BIGINT}})"""


def _pack_sql(t, limit):
    return f"""list_reduce({_PACK_ONE.format(t=t)}, lambda s, x: CASE WHEN s.n + x.n > {limit} AND len(s.cur) > 0
      THEN {{'done': list_append(s.done, array_to_string(s.cur, chr(10))), 'cur': x.cur, 'n': x.n + 1}} ELSE {{'done': s.done, 'cur': list_concat(s.cur, x.cur), 'n': s.n + x.n + 1}} END, {{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0::BIGINT}})"""


@query(f"WITH p AS (SELECT doc_id, {_pack_sql('text', 2000)} AS s FROM documents), c AS (SELECT doc_id, list_append(s.done, array_to_string(s.cur, chr(10))) AS chunks FROM p) SELECT doc_id, unnest(range(len(chunks)))::INT AS chunk_no, unnest(chunks) AS chunk FROM c")
def line_packer(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(B.pack_lines(F.col("text"))).alias("chunk_no", "chunk"))


def _overlap_sql(t, limit, overlap):
    full = f"s.n + x.n + 1 > {limit} AND len(s.cur) > 0"
    kept = f"len(list_filter(range(1, len(s.cur) + 1), lambda j: list_sum(list_transform(s.cur[len(s.cur) - j + 1:], lambda y: length(y))) <= {overlap}))"
    tail = f"s.cur[len(s.cur) - {kept} + 1:]"
    return f"""list_reduce({_PACK_ONE.format(t=t)}, lambda s, x: CASE WHEN {full}
      THEN {{'done': list_append(s.done, array_to_string(s.cur, chr(10))), 'cur': list_concat({tail}, x.cur), 'n': (coalesce(list_sum(list_transform({tail}, lambda y: length(y))), 0) + x.n + 1)::BIGINT}}
      ELSE {{'done': s.done, 'cur': list_concat(s.cur, x.cur), 'n': s.n + x.n + 1}} END, {{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0::BIGINT}})"""


@query(f"WITH p AS (SELECT doc_id, {_overlap_sql('text', int(600 * T.CHARS_PER_TOKEN), 200)} AS s FROM documents), c AS (SELECT doc_id, list_append(s.done, array_to_string(s.cur, chr(10))) AS chunks FROM p) SELECT doc_id, unnest(range(len(chunks)))::INT AS chunk_no, unnest(chunks) AS chunk FROM c")
def overlap_packer(spark, sf_dir):
    return A.load(spark, sf_dir, "documents").select("doc_id", F.posexplode(B.pack_overlapping(F.col("text"), int(600 * T.CHARS_PER_TOKEN))).alias("chunk_no", "chunk"))


def _line_blocks(spark, sf_dir):
    rows = _sections(spark, sf_dir).select("doc_id", F.col("pos").alias("ord"), F.col("line").alias("text"), F.col("sec").alias("section_path"), F.lit("text").alias("kind"))
    return B.number_blocks(rows, "doc_id", "ord", "kind")


@query(f"""WITH {_RUNS}, b AS (SELECT *, printf('%d_b%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS bid FROM r),
  j AS (SELECT doc_id, run, any_value(label) AS label, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (trim(line) <> ''), '') AS full_, list(bid ORDER BY pos) FILTER (trim(line) <> '') AS block_ids FROM b GROUP BY doc_id, run),
  f AS (SELECT * FROM j WHERE length(full_) >= 50),
  s AS (SELECT *, CASE WHEN length(full_) > 2000 THEN {_pack_sql('full_', 2000)} END AS s FROM f),
  p AS (SELECT doc_id, run, label, block_ids, CASE WHEN s IS NULL THEN [full_] ELSE list_append(s.done, array_to_string(s.cur, chr(10))) END AS parts FROM s),
  u AS (SELECT doc_id, run, label, block_ids, unnest(range(len(parts))) AS i, unnest(parts) AS text FROM p)
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, i) - 1)::INT AS chunk_no, CASE WHEN i > 0 THEN label || '#' || i ELSE label END AS section_path, text, substr(text, 1, 200) AS text_preview, length(text)::INT AS text_length, block_ids FROM u""")
def section_chunks(spark, sf_dir):
    return B.section_chunks(_line_blocks(spark, sf_dir))


_TBL = f"{A.TABLE_ROWS}, tb AS (SELECT tbl, list(cells ORDER BY ord) AS rows FROM rows_ GROUP BY tbl)"


def _tables(spark, sf_dir):
    rows = A.table_rows(spark, sf_dir).groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("ord", "cells"))).alias("r"))
    return rows.select("tbl", F.transform("r", lambda x: x["cells"]).alias("rows"))


@query(f"WITH {_TBL} SELECT tbl, array_to_string(list_transform(rows, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM tb")
def block_to_text(spark, sf_dir):
    return _tables(spark, sf_dir).select("tbl", B.block_text(F.lit("table"), F.lit(None).cast("string"), F.col("rows"), F.lit(None).cast("string")).alias("text"))


_CLASS = "CASE WHEN ord = 0 THEN 'header' WHEN len(list_filter(cells, lambda c: trim(c) <> '')) BETWEEN 1 AND 2 AND len(cells) >= 4 AND len(list_filter(cells, lambda c: length(trim(c)) >= 200)) = 0 THEN 'section' ELSE 'data' END"


def _classed(spark, sf_dir):
    rows = A.table_rows(spark, sf_dir).withColumn("row_type", B.row_class(F.col("cells"), F.col("ord") == 0, F.size("cells")))
    return rows.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("ord", "row_type", "cells"))).alias("rows"))


_DOC_TEXT = f"""{A.TABLE_ROWS}, c AS (SELECT tbl, ord, cells, {_CLASS} AS row_type FROM rows_),
  d AS (SELECT tbl, '[Table: 4 columns, ' || count(*) || ' rows]' || chr(10) || string_agg('  ' || row_type || ': ' || array_to_string(list_transform(cells, lambda x: substr(x, 1, 50)), ' | '), chr(10) ORDER BY ord) FILTER (ord < 3) ||
    CASE WHEN count(*) > 3 THEN chr(10) || '  ... ' || (count(*) - 3) || ' more rows' ELSE '' END AS table_text FROM c GROUP BY tbl)"""


@query(f"WITH {_DOC_TEXT} SELECT tbl, '## Order ' || tbl || chr(10) || table_text || chr(10) || '[OCR (page ' || (tbl % 7 + 1) || ')]' || chr(10) || 'scan of order ' || tbl AS text FROM d")
def doc_to_text(spark, sf_dir):
    t, none = _classed(spark, sf_dir), F.lit(None).cast("string")
    no_rows = F.lit(None).cast("array<struct<row_type:string,cells:array<string>>>")
    key = F.col("tbl").cast("string")
    parts = F.array(
        B.prompt_text(F.lit("text"), F.concat(F.lit("Order "), key), F.lit(2), no_rows, none, F.lit(1)),
        B.prompt_text(F.lit("table"), none, F.lit(0), F.col("rows"), none, F.lit(1)),
        B.prompt_text(F.lit("image"), none, F.lit(0), no_rows, F.concat(F.lit("scan of order "), key), (F.col("tbl") % 7 + 1).cast("int")),
    )
    return t.select("tbl", F.array_join(parts, "\n").alias("text"))


# tables


@query(f"WITH {A.TABLE_ROWS} SELECT tbl, ord::INT AS ord, {_CLASS} AS row_type FROM rows_")
def row_class_docx(spark, sf_dir):
    return A.table_rows(spark, sf_dir).select("tbl", "ord", B.row_class(F.col("cells"), F.col("ord") == 0, F.size("cells")).alias("row_type"))


@query(f"WITH {A.TABLE_ROWS} SELECT tbl, ord::INT AS ord, CASE WHEN ord = 0 THEN 'header' WHEN len(list_filter(cells, lambda c: trim(c) <> '')) <= 2 AND len(cells) >= 4 THEN 'section' ELSE 'data' END AS row_type FROM rows_")
def row_class_pdf(spark, sf_dir):
    return A.table_rows(spark, sf_dir).select("tbl", "ord", B.row_class(F.col("cells"), F.col("ord") == 0, F.size("cells"), strict=False).alias("row_type"))


_SPANS = f"{A.TABLE_ROWS}, sp AS (SELECT tbl, ord, list_transform(cells, lambda c: CASE WHEN c = '' THEN 2 ELSE 1 END) AS spans FROM rows_)"


def _spans(spark, sf_dir):
    return A.table_rows(spark, sf_dir).select("tbl", "ord", F.transform("cells", lambda c: F.when(c == "", 2).otherwise(1)).alias("spans"))


@query(f"WITH {_SPANS} SELECT tbl, max(list_sum(spans))::INT AS col_count FROM sp GROUP BY tbl")
def table_width(spark, sf_dir):
    return _spans(spark, sf_dir).groupBy("tbl").agg(F.collect_list("spans").alias("s")).select("tbl", B.table_width(F.col("s")).alias("col_count"))


@query(f"WITH {_SPANS}, e AS (SELECT tbl, ord, spans, unnest(range(len(spans))) AS i FROM sp) SELECT tbl, ord::INT AS ord, i::INT AS cell, (1 + coalesce(list_sum(spans[1:i]), 0))::INT AS start_col, spans[i + 1]::INT AS colspan FROM e")
def colspan_grid(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("starts", B.grid_starts(F.col("spans")))
    return s.select("tbl", "ord", F.posexplode(F.arrays_zip("starts", "spans")).alias("cell", "z")).select("tbl", "ord", "cell", F.col("z.starts").alias("start_col"), F.col("z.spans").alias("colspan"))


@query(r"""WITH c AS (SELECT p_brand, p_name AS v FROM part UNION ALL SELECT p_brand, p_type FROM part UNION ALL SELECT p_brand, repeat('x', p_size * 2) FROM part),
  n AS (SELECT p_brand, max(least(greatest(list_max(list_transform(regexp_split_to_array(v, '\s+'), lambda w: length(w))), length(v) // 3), 60)) AS m FROM c WHERE v <> '' GROUP BY p_brand)
  SELECT p_brand, least(greatest(m, 8) + 2, 60)::INT AS width FROM n""")
def col_widths(spark, sf_dir):
    p = A.load(spark, sf_dir, "part").select("p_brand", F.explode(F.array("p_name", "p_type", F.repeat(F.lit("x"), F.col("p_size") * 2))).alias("v"))
    return p.groupBy("p_brand").agg(F.collect_list("v").alias("cells")).select("p_brand", B.column_width(F.col("cells")).alias("width"))


_PAIRS = f"{A.TABLE_ROWS}, pr AS (SELECT tbl, ord, cells AS b, lag(cells) OVER (PARTITION BY tbl ORDER BY ord) AS a FROM rows_)"


@query(f"""WITH {_PAIRS} SELECT tbl, ord::INT AS ord, list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' AND b[i] <> '' THEN a[i] || ' ' || b[i] WHEN a[i] <> '' THEN a[i] ELSE b[i] END) AS merged
  FROM pr WHERE a IS NOT NULL AND len(a) = len(b) AND len(list_filter(b, lambda c: c <> '')) > 0""")
def split_row_merge(spark, sf_dir):
    w = Window.partitionBy("tbl").orderBy("ord")
    pairs = A.table_rows(spark, sf_dir).withColumn("a", F.lag("cells").over(w)).where("a IS NOT NULL")
    return pairs.select("tbl", "ord", B.merge_split_row(F.col("a"), F.col("cells")).alias("merged")).where("merged IS NOT NULL")


_ELEMENTS = """el AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq,
  CASE WHEN l_partkey % 4 = 0 THEN 'text' ELSE 'table' END AS kind, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 2 + 3 END AS ncols FROM lineitem)"""


def _elements(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    kind = F.when(F.col("l_partkey") % 4 == 0, "text").otherwise("table")
    return A.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).alias("seq"), kind.alias("kind"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") % 2 + 3).alias("ncols"),
    )


@query(f"""WITH {_ELEMENTS}, l AS (SELECT *, lag(kind) OVER w AS pk, lag(ncols) OVER w AS pn FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
  s AS (SELECT *, sum(CASE WHEN kind = 'table' AND NOT coalesce(pk = 'table' AND pn = ncols, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM l)
  SELECT doc_id, session::BIGINT AS session, min(ncols)::BIGINT AS ncols, min(seq)::INT AS first_seq, count(*) AS n_parts FROM s WHERE kind = 'table' GROUP BY doc_id, session""")
def table_stitch_sessions(spark, sf_dir):
    s = B.stitch_sessions(_elements(spark, sf_dir))
    return s.groupBy("doc_id", "session").agg(F.min("ncols").alias("ncols"), F.min("seq").alias("first_seq"), F.count("*").alias("n_parts"))


def _stitch_sql(parts):
    """The parts' rows folded into the first's: a repeated header goes, and a row that the next part goes on with is put together."""
    more = "CASE WHEN len(p) > 1 AND list_transform(a[1], lambda c: trim(c)) = list_transform(p[1], lambda c: trim(c)) THEN p[2:] ELSE p END"
    cell = "CASE WHEN a[-1][i] <> '' AND m[1][i] <> '' THEN trim(a[-1][i] || ' ' || m[1][i]) WHEN a[-1][i] <> '' THEN a[-1][i] ELSE m[1][i] END"
    one = f"list_transform(range(1, len(m[1]) + 1), lambda i: {cell})"
    joined = f"CASE WHEN len(a[-1]) = len(m[1]) AND len(list_filter(m[1], lambda c: c <> '')) > 0 THEN list_concat(list_append(a[1:len(a) - 1], {one}), m[2:]) ELSE list_concat(a, m) END"
    return f"list_reduce({parts}, lambda a, p: list_transform([{more}], lambda m: {joined})[1])"


_PART = "[list_transform(range(1, ncols + 1), lambda i: 'h' || i), list_transform(range(1, ncols + 1), lambda i: CASE WHEN i % 2 = 1 THEN 'c' || i ELSE seq::VARCHAR END)]"


@query(f"""WITH {_ELEMENTS}, l AS (SELECT *, lag(kind) OVER w AS pk, lag(ncols) OVER w AS pn FROM el WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
  s AS (SELECT *, sum(CASE WHEN kind = 'table' AND NOT coalesce(pk = 'table' AND pn = ncols, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS session FROM l),
  g AS (SELECT doc_id, session::BIGINT AS session, list({_PART} ORDER BY seq) AS parts FROM s WHERE kind = 'table' GROUP BY doc_id, session)
  SELECT doc_id, session, {_stitch_sql('parts')} AS rows FROM g""")
def table_stitch(spark, sf_dir):
    s = B.stitch_sessions(_elements(spark, sf_dir))
    return B.stitch(s.withColumn("rows", _part_rows()), ["doc_id", "session"])


def _part_rows():
    row = F.transform(F.sequence(F.lit(1), F.col("ncols")), lambda i: F.when(i % 2 == 1, F.concat(F.lit("c"), i.cast("string"))).otherwise(F.col("seq").cast("string")))
    return F.array(F.transform(F.sequence(F.lit(1), F.col("ncols")), lambda i: F.concat(F.lit("h"), i.cast("string"))), row)


@query(f"WITH {_ELEMENTS} SELECT doc_id, seq::INT AS seq, row_number() OVER (PARTITION BY doc_id ORDER BY (seq * 7) % 5, CASE kind WHEN 'text' THEN 0 ELSE 1 END, seq)::INT AS place FROM el")
def page_order(spark, sf_dir):
    top = (F.col("seq") * 7) % 5
    w = Window.partitionBy("doc_id").orderBy(top, F.when(F.col("kind") == "text", 0).otherwise(1), "seq")
    return _elements(spark, sf_dir).select("doc_id", "seq", F.row_number().over(w).alias("place"))


@query("""WITH a AS (SELECT l_orderkey AS page, sum(abs(l_quantity * 10) * abs(l_partkey % 40)) AS area FROM lineitem GROUP BY l_orderkey)
  SELECT o_orderkey AS page, area FROM orders JOIN a ON page = o_orderkey WHERE length(trim(CASE WHEN o_orderkey % 2 = 0 THEN repeat('word ', 20) ELSE ' short ' END)) < 50 AND area > 100.0 * 80.0 * 0.5""")
def scan_pages(spark, sf_dir):
    pages = A.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.when(F.col("o_orderkey") % 2 == 0, F.repeat(F.lit("word "), F.lit(20))).otherwise(" short ").alias("text"), F.lit(100.0).alias("width"), F.lit(80.0).alias("height"))
    images = A.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.lit(0.0).alias("x0"), (F.col("l_quantity") * 10).alias("x1"), F.lit(0).alias("top"), (F.col("l_partkey") % 40).alias("bottom"))
    return B.scan_pages(pages, images, ["page"]).select("page", "area")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity - 10.0 AS x0, l_discount * 100 - 2.0 AS top, l_quantity * 3 AS x1, l_tax * 900 AS bottom FROM lineitem),
  c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(x0, 0.0) AS x0, greatest(top, 0.0) AS top, least(x1, 100.0) AS x1, least(bottom, 60.0) AS bottom FROM b)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x0, 6) AS x0, round(top, 6) AS top, round(x1, 6) AS x1, round(bottom, 6) AS bottom FROM c WHERE x0 < x1 AND top < bottom""")
def bbox_clamp(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    box = B.clamp_box(F.col("l_quantity") - 10.0, F.col("l_discount") * 100 - 2.0, F.col("l_quantity") * 3, F.col("l_tax") * 900, F.lit(100.0), F.lit(60.0))
    return A.load(spark, sf_dir, "lineitem").select(*keys, box.alias("b")).where("b IS NOT NULL").select(*keys, *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "top", "x1", "bottom")])


@query(f"WITH {A.TABLE_ROWS} SELECT tbl, printf('sheet_%02d', (tbl % 97)::INT) AS sheet, count(*) FILTER (len(list_filter(cells, lambda c: c <> '')) > 0) AS n_rows, max(len(cells))::INT AS col_count FROM rows_ GROUP BY tbl")
def sheet_blocks(spark, sf_dir):
    r = A.table_rows(spark, sf_dir).withColumn("cells", F.transform("cells", T.cell_text)).where(F.exists("cells", lambda c: c != ""))
    return r.groupBy("tbl").agg(F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("col_count")).select("tbl", F.format_string("sheet_%02d", (F.col("tbl") % 97).cast("int")).alias("sheet"), "n_rows", "col_count")


# retrieval


@query("SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 10")
def rerank_topk(spark, sf_dir):
    e = A.load(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").select("embedding").first()
    return R.rerank(e, asked[0] if asked else [], "embedding", "vec_id", 10).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT count(*) AS chunks, count(DISTINCT label) AS documents, max(len(embedding))::INT AS dim FROM embeddings")
def index_config(spark, sf_dir):
    return R.index_config(A.load(spark, sf_dir, "embeddings"), "label", "embedding")


# blocks out


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (3, 17, 4)")
def block_filter(spark, sf_dir):
    blocks = A.load(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("doc_id").cast("string").alias("block_id"))
    return B.pick_blocks(blocks, [" 3, 17,", "4,none"]).select("doc_id", "n_chars")


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH {A.NUMBERED_LINES}, b AS (SELECT doc_id, pos, line, sec, is_heading, printf('%d_b%03d', doc_id, pos + 1) AS bid, pos // 10 + 1 AS page FROM nums)
  SELECT doc_id, CAST(pos AS INT) AS pos, '<section class="block ' || 'text' || '-block" data-block-id="' || bid || '"><div class="block-meta">block: ' || bid || ' | page: ' || page || CASE WHEN pos % 10 = 9 THEN '-' || (page + 1) ELSE '' END ||
    CASE WHEN sec IS NOT NULL THEN ' | section: ' || sec ELSE '' END || '</div>' || CASE WHEN is_heading THEN '<h2>' ELSE '<p>' END || {_ESC.format('line')} || CASE WHEN is_heading THEN '</h2>' ELSE '</p>' END || '</section>' AS html FROM b""")
def render_blocks(spark, sf_dir):
    page = F.floor(F.col("pos") / 10).cast("int") + 1
    b = _sections(spark, sf_dir).withColumns({"bid": F.format_string("%d_b%03d", "doc_id", F.col("pos") + 1), "page": page, "page_end": F.when(F.col("pos") % 10 == 9, page + 1).otherwise(page)})
    none = F.lit(None).cast(ROWS)
    meta = T.metadata_line(F.col("bid"), F.col("page"), F.col("page_end"), F.col("sec"))
    return b.select("doc_id", "pos", B.block_html(F.lit("text"), F.col("bid"), F.col("line"), F.when(F.col("is_heading"), 2).otherwise(0), none, F.lit(None).cast("string"), meta).alias("html"))


_LABELLED = """lb AS (SELECT d.doc_id, d.source, d.lang, d.n_chars, CASE WHEN l.quality = 1 THEN 'specification' ELSE 'other' END AS doc_type FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _passports(spark, sf_dir):
    d = A.load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(A.load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "n_chars", F.when(F.col("quality") == 1, "specification").otherwise("other").alias("doc_type"))


@query(f"""WITH {_LABELLED} SELECT source, '# Document map of ' || source || chr(10) || chr(10) || string_agg('## [' || doc_id || '] ' || doc_type || chr(10) || 'Language: ' || lang || chr(10) || 'Length: ' || n_chars || chr(10), chr(10) ORDER BY doc_id) AS routing FROM lb GROUP BY source""")
def routing_text(spark, sf_dir):
    p = _passports(spark, sf_dir).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", "doc_type", "lang", "n_chars"))).alias("p"))
    one = lambda x: F.concat(F.lit("## ["), x["doc_id"].cast("string"), F.lit("] "), x["doc_type"], F.lit("\nLanguage: "), x["lang"], F.lit("\nLength: "), x["n_chars"].cast("string"), F.lit("\n"))
    return p.select("source", F.concat(F.lit("# Document map of "), "source", F.lit("\n\n"), F.array_join(F.transform("p", one), "\n")).alias("routing"))


@query(f"WITH {_LABELLED} SELECT source, count(*) AS n, list(doc_id ORDER BY doc_id) AS doc_ids, list(doc_type ORDER BY doc_id) AS doc_types FROM lb GROUP BY source")
def document_map(spark, sf_dir):
    m = _passports(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc_id", "doc_type"))).alias("p"))
    return m.select("source", "n", F.col("p.doc_id").alias("doc_ids"), F.col("p.doc_type").alias("doc_types"))


@query("""WITH ocr AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
  SELECT d.doc_id, CASE WHEN ocr.doc_id IS NOT NULL THEN 'completed' ELSE 'skipped' END AS ocr_status, ocr.q::INT AS q FROM documents d LEFT JOIN ocr ON ocr.doc_id = d.doc_id""")
def page_match_left(spark, sf_dir):
    pages = A.load(spark, sf_dir, "documents").select("doc_id")
    found = A.load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("q"), F.lit(True).alias("hit"))
    return pages.join(found, "doc_id", "left").select("doc_id", F.when(F.col("hit"), "completed").otherwise("skipped").alias("ocr_status"), "q")


@query("""WITH f AS (SELECT l_partkey, min(l_orderkey) AS k FROM lineitem GROUP BY l_partkey)
  SELECT p_partkey, k AS used_by, CASE WHEN k IS NULL THEN 'appended' ELSE 'inline' END AS place FROM part LEFT JOIN f ON l_partkey = p_partkey""")
def consume_once(spark, sf_dir):
    first = A.load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("used_by"))
    return A.load(spark, sf_dir, "part").select("p_partkey").join(first, "p_partkey", "left").withColumn("place", F.when(F.col("used_by").isNull(), "appended").otherwise("inline"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'image' WHEN p_size % 5 <> 0 THEN 'scan' END AS kind FROM part WHERE p_size % 3 <> 0 OR p_size % 5 <> 0")
def ocr_split(spark, sf_dir):
    p = A.load(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("images/"), "p_name")).alias("image_ref"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("page"))
    kind = F.when(F.col("image_ref").isNotNull(), "image").when(F.coalesce("page", F.lit(0)) != 0, "scan")
    return p.select("p_partkey", kind.alias("kind")).where("kind IS NOT NULL")


# prices and URLs


@query(f"""WITH {A.API_USAGE} SELECT id, CASE WHEN coalesce(total_tokens, 0) > 0 AND k % 5 <> 4 THEN floor((total_tokens * 2 + coalesce(CASE WHEN k % 3 <> 0 THEN k * 2 END, 0) * 5 + 5) / 10) / 1000000.0 END AS cost FROM api_usage""")
def llm_cost(spark, sf_dir):
    model = F.when(F.col("k") % 5 == 4, "unknown").otherwise("grok-4-fast")
    return A.api_usage(spark, sf_dir).select("id", T.llm_cost(model, F.col("total_tokens"), F.when(F.col("k") % 3 != 0, F.col("k") * 2)).cast("double").alias("cost"))


@query(f"WITH {A.API_USAGE} SELECT id, CASE WHEN k % 5 <> 4 THEN k * 2000 / 1000000.0 END AS cost FROM api_usage WHERE action = 'ocr'")
def ocr_cost(spark, sf_dir):
    model = F.when(F.col("k") % 5 == 4, "unknown").otherwise("ocr-latest")
    return A.api_usage(spark, sf_dir).where("action = 'ocr'").select("id", T.ocr_cost(model, F.col("k")).cast("double").alias("cost"))


@query("SELECT p_type, p_brand, count(*) AS n, CASE p_brand WHEN 'Brand#1' THEN 10 WHEN 'Brand#2' THEN 20 END AS price FROM part GROUP BY p_type, p_brand")
def price_lookup_broadcast(spark, sf_dir):
    prices = spark.createDataFrame([("Brand#1", 10), ("Brand#2", 20)], "p_brand string, price int")
    return A.load(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n")).join(F.broadcast(prices), "p_brand", "left").select("p_type", "p_brand", "n", "price")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'mistral' WHEN 1 THEN 'openai' ELSE 'xai' END AS provider FROM pages")
def provider_of(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("https://api.MISTRAL.example/", "https://api.openai.example/", "https://api.other.example/"))), (F.col("page_id") % 3).cast("int"))
    return A.load(spark, sf_dir, "pages").select("page_id", T.provider(name).alias("provider"))


_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


@query(f"SELECT page_id, {_HOST_SQL} AS host, {_HOST_SQL} = 'example.org' OR {_HOST_SQL} LIKE '%.example.org' OR {_HOST_SQL} LIKE '%.example.net' OR {_HOST_SQL} = 'example.net' AS bypass FROM pages")
def host_suffix_match(spark, sf_dir):
    return A.load(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.host_in(F.col("url"), ["example.org", "Example.NET"]).alias("bypass"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '://', '://user:pw' || page_id || '@'), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\1***@') AS redacted FROM pages")
def redact_url(spark, sf_dir):
    secret = F.concat(F.regexp_extract("url", "^([A-Za-z]+://)", 1), F.lit("user:pw"), F.col("page_id").cast("string"), F.lit("@"), F.regexp_replace("url", "^[A-Za-z]+://", ""))
    return A.load(spark, sf_dir, "pages").select("page_id", T.redact(secret).alias("redacted"))


# upserts and rules

_CHANGES = """cur AS (SELECT s_suppkey AS k, s_name AS name, 'supplier' AS segment, CASE WHEN s_nationkey % 4 = 0 THEN 'old error' END AS error FROM supplier),
  chg AS (SELECT c_nationkey * 7 AS k, CASE WHEN min(c_custkey) % 2 = 0 THEN upper(min(c_name)) || '!' END AS name, CASE WHEN count(*) % 2 = 0 THEN min(c_mktsegment) END AS segment, CASE WHEN count(*) % 3 = 0 THEN 'new error' END AS error FROM customer GROUP BY c_nationkey)"""


def _changes(spark, sf_dir):
    """Suppliers, and changes drawn from the customers of each nation, some to suppliers that are there and some to new ones."""
    s, c = A.load(spark, sf_dir, "supplier"), A.load(spark, sf_dir, "customer")
    current = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("segment"), F.when(F.col("s_nationkey") % 4 == 0, "old error").alias("error"))
    n = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"), F.min("c_name").alias("name"), F.min("c_mktsegment").alias("segment"), F.count("*").alias("n"))
    changes = n.select((F.col("c_nationkey").cast("long") * 7).alias("k"), F.when(F.col("first") % 2 == 0, F.concat(F.upper("name"), F.lit("!"))).alias("name"), F.when(F.col("n") % 2 == 0, F.col("segment")).alias("segment"), F.when(F.col("n") % 3 == 0, "new error").alias("error"))
    return current, changes


@query(f"WITH {_CHANGES} SELECT coalesce(chg.k, cur.k) AS k, coalesce(chg.name, cur.name) AS name, coalesce(chg.segment, cur.segment) AS segment, CASE WHEN chg.k IS NOT NULL THEN chg.error ELSE cur.error END AS error FROM cur FULL JOIN chg ON cur.k = chg.k")
def upsert_coalesce(spark, sf_dir):
    return L.upsert(*_changes(spark, sf_dir), ["k"], ["name", "segment"], ["error"])


@query(f"WITH {_CHANGES} SELECT coalesce(chg.k, cur.k) AS k, CASE WHEN chg.k IS NOT NULL THEN chg.name ELSE cur.name END AS name, CASE WHEN chg.k IS NOT NULL THEN chg.segment ELSE cur.segment END AS segment, CASE WHEN chg.k IS NOT NULL THEN chg.error ELSE cur.error END AS error FROM cur FULL JOIN chg ON cur.k = chg.k")
def upsert_lww(spark, sf_dir):
    return L.upsert(*_changes(spark, sf_dir), ["k"], [], ["name", "segment", "error"])


@query("SELECT p_partkey, CASE WHEN p_type = p_brand THEN [p_brand, 'x'] ELSE [p_brand, 'x', p_type] END AS merged FROM part")
def ordered_union(spark, sf_dir):
    return A.load(spark, sf_dir, "part").select("p_partkey", T.merge_ordered(F.array("p_brand", F.lit("x")), F.array("p_type", "p_brand", F.lit("x"))).alias("merged"))


@query(f"""WITH {A.API_USAGE} SELECT 'action' AS rule, count(*) FILTER (NOT action IN ('passport', 'ocr', 'routing')) AS n FROM api_usage UNION ALL SELECT 'status', count(*) FILTER (NOT status IN ('success', 'error')) FROM api_usage
  UNION ALL SELECT 'tokens', count(*) FILTER (NOT total_tokens < 90) FROM api_usage""")
def check_violations(spark, sf_dir):
    rules = {"action": F.col("action").isin("passport", "ocr", "routing"), "status": F.col("status").isin("success", "error"), "tokens": F.col("total_tokens") < 90}
    return L.violations(A.api_usage(spark, sf_dir), rules)


from . import documents, lifecycle  # noqa: E402, F401  they add their queries
