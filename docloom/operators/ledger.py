"""Cost, latency and job analytics, upserts and validation over the operational relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ["passport", "ocr", "routing", "answer", "chat", "embedding"]
JOB_STATUSES = ["queued", "running", "completed", "failed"]


def collection_costs(usage: DataFrame) -> DataFrame:
    """Calls, tokens, cost and time by collection; null collections are a group of their own."""
    part = lambda a: F.sum(F.when(F.col("action") == a, F.col("cost_usd")).otherwise(F.lit(0).cast("decimal(10,6)")))
    return usage.groupBy("tender_id").agg(
        F.count("*").alias("total_calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("total_cost"), F.sum("duration_ms").alias("total_duration_ms"),
        *[part(a).alias(f"{a}_cost") for a in ("passport", "ocr", "routing", "answer")],
    )


def stage_speed(metrics: DataFrame) -> DataFrame:
    """Runs, rounded mean, exact 95th percentile (half to even) and maximum of the duration, and errors, by stage."""
    return metrics.groupBy("stage").agg(
        F.count("*").alias("runs"), F.round(F.avg("duration_ms")).cast("long").alias("avg_ms"), F.bround(F.percentile("duration_ms", F.lit(0.95))).cast("long").alias("p95_ms"),
        F.max("duration_ms").alias("max_ms"), F.count_if(F.col("status") == "error").alias("errors"),
    )


def recent_errors(usage: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """What failed after as_of - hours (strictly), the latest first."""
    return usage.where((F.col("status") != "success") & (F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS"))).orderBy(F.desc("ts"))


def collection_total(usage: DataFrame, collections: DataFrame) -> DataFrame:
    """Each collection's total cost, 0 where it has no calls."""
    cost = usage.groupBy("tender_id").agg(F.sum("cost_usd").alias("c"))
    return collections.join(cost, "tender_id", "left").select("tender_id", F.coalesce("c", F.lit(0).cast("decimal(20,6)")).alias("total_cost"))


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def queue_order(jobs: DataFrame, limit: int) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy(F.desc("priority"), "queued_at", "id").limit(limit)


def status_times(events: DataFrame, statuses: list[str]) -> DataFrame:
    """One column per status: when a collection last came to it."""
    return events.groupBy("tender_id").agg(*[F.max(F.when(F.col("status") == s, F.col("at"))).alias(f"{s}_at") for s in statuses])


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], keep_old: list[str], overwrite: list[str]) -> DataFrame:
    """current with changes (unique keys). keep_old columns take a change unless it is null; overwrite columns take it anyway."""
    c, n = current.alias("c"), changes.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    new = F.col("n.__new").isNotNull()
    return c.join(n, on, "full_outer").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"c.{k}")).alias(k) for k in keys],
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"c.{k}")).alias(k) for k in keep_old],
        *[F.when(new, F.col(f"n.{k}")).otherwise(F.col(f"c.{k}")).alias(k) for k in overwrite],
    )


#: Rows that a task of without_match sorts, about. Spark sizes tasks by bytes shuffled, and bare keys are so few of them that a task would get ever more rows.
ROWS_PER_TASK = 1 << 20


def without_match(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without one of others by keys. Both are counted first, so that the number of tasks, not their size, follows the tables."""
    n = -(-(rows.count() + others.count()) // ROWS_PER_TASK) or 1
    return rows.repartition(n, *keys).join(others.select(*keys).repartition(n, *keys), keys, "left_anti")


def or_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of first; for keys that it lacks, those of second."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, rows that break it (a null condition doesn't), for every rule."""
    counted = rows.agg(*[F.count_if(~c).alias(r) for r, c in rules.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("x")).select("x.rule", "x.n")


SPAN = 1 << 16


def next_free(existing: DataFrame, wanted: int, prefix: str = "user_doc_") -> DataFrame:
    """The wanted least numbers from 1 that no id of existing (prefix and digits) has, as ids.

    Numbers are counted by spans of SPAN; only the first spans that have enough free ones are listed number by number.
    """
    used = existing.select(F.regexp_extract("id", f"^{prefix}(\\d+)$", 1).try_cast("long").alias("n")).where("n > 0").distinct().withColumn("span", F.floor((F.col("n") - 1) / SPAN))
    taken = used.groupBy("span").agg(F.count("*").alias("taken"))
    spans = existing.sparkSession.range(1).crossJoin(F.broadcast(taken.agg(F.coalesce(F.max("span"), F.lit(-1)).alias("last")))).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1 + wanted // SPAN)).alias("span"))
    free = spans.join(taken, "span", "left").select("span", (F.lit(SPAN) - F.coalesce("taken", F.lit(0))).alias("free")).where("free > 0")
    before = F.coalesce(F.sum("free").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = free.withColumn("before", before).where(F.col("before") < wanted).select("span")
    numbers = first.select("span", F.explode(F.sequence(F.col("span") * SPAN + 1, (F.col("span") + 1) * SPAN)).alias("n"))
    return numbers.join(used.select("n"), "n", "left_anti").orderBy("n").limit(wanted).select(F.col("n").cast("int").alias("n"), F.format_string(f"{prefix}%03d", "n").alias("id"))


def update(current: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """current with the columns of changes (unique keys) where there is one; a change without a row to change is lost, as an update's is."""
    n = changes.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__new"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return current.join(n, on, "left").select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns])


def parsed(documents: DataFrame, changes: DataFrame, at) -> DataFrame:
    """Documents after reading: changes has tender_id, doc_id and what was counted. The status becomes parsed."""
    counted = ["text_blocks_count", "tables_count", "images_count", "total_pages", "estimated_tokens", "parse_duration_ms", "conversion_duration_ms"]
    done = changes.withColumn("parse_status", F.lit("parsed")).withColumn("parsed_at", at)
    return update(documents, done, ["tender_id", "doc_id"], ["parse_status", *counted, "parsed_at"])


def parse_failed(documents: DataFrame, failed: DataFrame, status: str = "failed") -> DataFrame:
    return update(documents, failed.withColumn("parse_status", F.lit(status)), ["tender_id", "doc_id"], ["parse_status"])


def collections_or_fallback(first: DataFrame, second: DataFrame, collection: str) -> DataFrame:
    """Of each collection the rows of first if it has any there, else those of second: a list that is empty falls back whole."""
    return or_fallback(first, second, [collection])
