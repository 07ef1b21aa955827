"""The corpus pipeline: documents without a language go, one document of each near-duplicate group stays, passages that an
earlier document has are cut, and what is left is packed into power-of-two sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import language_id, near_dedup, packing, substring_dedup
from docloom.llm.common import made, stored, swept, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("substring_dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and read again before the next, and its working tables go then.

    Null, empty and blank texts go at the first stage, rows without id stay through all; of rows with one id one stays (near_dedup). Very long texts are
    read whole. An empty table gives no rows. Documents' other columns are kept until the last stage, which ignores them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        docs = stored(stage(spark, docs, sf_dir), name)
        swept(spark, before, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
