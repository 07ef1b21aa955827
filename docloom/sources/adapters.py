"""The synthetic tables read as the engine's relations, in Spark and as SQL for the checks."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers look for this package where the driver found it, besides what they were started or shipped with."""
    environment = spark.sparkContext.environment
    if ROOT not in (paths := environment.get("PYTHONPATH", "").split(os.pathsep)):
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def api_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "passport").when(kind == "click", "ocr").when(kind == "view", "routing").when(kind == "signup", "answer").when(kind == "error", "chat")
    bad = F.when(F.col("k") % 3 == 0, "error").when(F.col("k") % 3 == 1, "timeout").otherwise("rate_limited")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("tender_id"), action.alias("action"), F.when(kind == "error", bad).otherwise("success").alias("status"), "k",
        F.when(kind != "click", F.col("k")).alias("total_tokens"), (F.round(F.col("value") * 100).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(10,6)").alias("cost_usd"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
    )


API_USAGE = """
ev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INT) AS k FROM events),
api_usage AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS tender_id,
  CASE event_type WHEN 'purchase' THEN 'passport' WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'routing' WHEN 'signup' THEN 'answer' WHEN 'error' THEN 'chat' END AS action,
  CASE WHEN event_type <> 'error' THEN 'success' WHEN k % 3 = 0 THEN 'error' WHEN k % 3 = 1 THEN 'timeout' ELSE 'rate_limited' END AS status, k,
  CASE WHEN event_type <> 'click' THEN k END AS total_tokens, CAST(round(value * 100) AS BIGINT) AS cents, CAST(floor(value * 10) AS INT) AS duration_ms FROM ev)
"""

STAGES = {"purchase": "parse_docx", "click": "ocr", "view": "parse_pdf", "signup": "passport", "error": "parse_xlsx"}


def parse_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("tender_id"), F.try_element_at(stage, "event_type").alias("stage"),
        F.floor(F.col("value") * 10).cast("int").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )


PARSE_METRICS = """
parse_metrics AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS tender_id,
  CASE event_type WHEN 'purchase' THEN 'parse_docx' WHEN 'click' THEN 'ocr' WHEN 'view' THEN 'parse_pdf' WHEN 'signup' THEN 'passport' WHEN 'error' THEN 'parse_xlsx' END AS stage,
  CAST(floor(value * 10) AS INT) AS duration_ms, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status FROM events)
"""


def pipeline_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = api_usage(spark, sf_dir)
    status = F.when(F.col("k") % 4 == 0, "queued").when(F.col("k") % 4 == 1, "running").when(F.col("k") % 4 == 2, "completed").otherwise("failed")
    return u.select("id", "tender_id", status.alias("status"), (F.col("k") % 11).alias("priority"), F.col("ts").alias("queued_at"))


PIPELINE_JOBS = (
    API_USAGE
    + """, jobs AS (SELECT id, tender_id, CASE k % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, k % 11 AS priority, ts AS queued_at FROM api_usage)"""
)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    text = F.when(pos % 4 == 1, F.concat(F.floor(pos / 4 + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc_id", "pos", text.alias("line"), (pos % 8 == 0).alias("is_heading"))


NUMBERED_LINES = """
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
numbered AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN (pos // 4 + 1) || '. ' || line ELSE line END AS line, pos % 8 = 0 AS is_heading FROM ln),
nums AS (SELECT *, nullif(regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^([0-9]+(?:[.][0-9]+)*)[\\s.)]', 1), '') AS sec FROM numbered)
"""


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl (order), ord, cells (strings): each order's distinct line items, in the order of all their columns; a header row first."""
    i = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").cast("string").alias("q"), "l_returnflag").distinct()
    ordered = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "q", "l_returnflag")
    blank = lambda c, cond: F.when(cond, "").otherwise(c)
    n = F.col("l_partkey")
    body = i.select(
        F.col("l_orderkey").alias("tbl"), F.row_number().over(ordered).alias("ord"),
        F.array(F.col("l_linenumber").cast("string"), blank(n.cast("string"), n % 5 == 0), blank(F.col("q"), n % 5 == 0), blank(F.col("l_returnflag"), n % 3 == 0)).alias("cells"),
    )
    head = i.select(F.col("l_orderkey").alias("tbl")).distinct().select("tbl", F.lit(0).alias("ord"), F.array(*map(F.lit, ("line", "part", "qty", "flag"))).alias("cells"))
    return head.unionByName(body)


TABLE_ROWS = """
li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_returnflag FROM lineitem),
rows_ AS (SELECT l_orderkey AS tbl, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, q, l_returnflag) AS ord,
   [CAST(l_linenumber AS VARCHAR), CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE q END, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE l_returnflag END] AS cells FROM li
  UNION ALL SELECT DISTINCT l_orderkey, 0, ['line', 'part', 'qty', 'flag'] FROM li)
"""
