"""Streams: landed change files upserted into a snapshot, and windowed usage with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators import ledger
from docloom.sources.files import bucket_of, read_buckets, write_buckets


def upsert_stream(changes: DataFrame, root: str, checkpoint: str, keys: list[str], order: str, keep_old: list[str], overwrite: list[str]) -> StreamingQuery:
    """Each micro-batch's last row per key goes into a new version of those buckets of the snapshot under root that it touches; the others aren't
    rewritten. A batch that runs again finds its version and stops. Read with files.read_buckets."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/v={number:08d}/_SUCCESS")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return
        last = ledger.latest(batch, keys, F.desc(order), *[F.col(c).asc_nulls_last() for c in [*keep_old, *overwrite]]).drop(order)
        touched = [r[0] for r in last.select(bucket_of(keys)).distinct().collect()]  # at most BUCKETS numbers
        current = read_buckets(spark, root, touched)
        write_buckets(ledger.upsert(current if current is not None else last.limit(0), last, keys, keep_old, overwrite), root, number, keys)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(usage: DataFrame, width: str = "1 hour", late: str = "2 hours", at: str = "ts") -> DataFrame:
    """Calls, tokens and errors by action and window; rows later than the watermark are dropped once their window is closed."""
    timed = usage.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), "action").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.count_if(F.col("status") != "success").alias("errors"))


def landed(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
