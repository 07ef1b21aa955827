"""Tables, the shared folder and Arrow plumbing for the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow. Workers look for this package where the driver found it, besides what they were started or shipped with."""
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one is set on a local master; on a cluster that is an error,
    as its executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="docloom-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Paths of the tables that stored() made and nobody deleted, in their order.
_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet to a fresh path of the shared folder and reads it back, so lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession, since: int, kept: DataFrame) -> None:
    """Deletes the tables that stored() made after the first ``since`` of them, but for the one that kept reads. For when what they led to is stored itself."""
    files = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in kept.inputFiles()}
    for path in _made[since:]:
        if path.split(":", 1)[-1].lstrip("/") not in files:
            delete(spark, path)


def made() -> int:
    return len(_made)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by stored() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docloom/" in path:
            delete(df.sparkSession, path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under names of its own, so other columns can't clash. Rows without an id are left out."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose fn gives, for each batch, any number of dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                yield out if isinstance(out, pa.RecordBatch) else as_batch(out, arrow_schema)

    return map_batches(df, run, spark_schema)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        c = columns[f.name]
        if isinstance(c, (pa.Array, pa.ChunkedArray)):
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            arrays.append(c if c.type == f.type else c.cast(f.type))
        else:
            arrays.append(pa.array(c, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from values laid end to end."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def key_groups(batches: Iterable[pa.RecordBatch], key: str | list[str]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by the key columns, cut anew so that no key's rows are in two of them."""
    names = [key] if isinstance(key, str) else key
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(names, columns)):
            yield joined(held)
            held = []
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], 0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
