"""Retrieval: cosine rerank, token corpus and index description."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B
from docloom.operators import external

EPSILON = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rerank(candidates: DataFrame, query: list[float], vector: str, order: str, k: int | None) -> DataFrame:
    """Cosine with the query, best first, ties in the order of ``order``; k None or 0 gives all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = lambda v: F.sqrt(dot(v, v)) + EPSILON
    scored = candidates.withColumn("score", dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q))).orderBy(F.desc("score"), order)
    return scored.limit(k) if k else scored


def index_config(chunks: DataFrame, doc: str, vector: str) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct(doc).alias("documents"), F.max(F.size(vector)).alias("dim"))


def chunk_corpus(blocks: DataFrame, doc_ids: list | None = None, key: str = "doc_id") -> DataFrame:
    """Chunks of the blocks (doc_id, ord, block_id, section_path, text) of all documents, or of those wanted, with chunk_id and tokens."""
    some = blocks if not doc_ids else blocks.where(F.col(key).isin(doc_ids))
    chunks = B.section_chunks(some, key)
    return chunks.withColumn("chunk_id", F.format_string("%s#%d", F.col("doc_id").cast("string"), "chunk_no")).withColumn("tokens", T.tokens(F.col("text")))


def config_of(index: DataFrame, model: str) -> DataFrame:
    """model, dim, chunks_count, docs_indexed (sorted); no row where there is no chunk."""
    found = index.agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("chunks_count"), F.array_sort(F.collect_set("doc_id")).alias("docs_indexed"))
    return found.where("chunks_count > 0").select(F.lit(model).alias("model"), "dim", "chunks_count", "docs_indexed")


def build_index(blocks: DataFrame, client: Callable[[list[str]], list[list[float]]], model: str, root: str, doc_ids: list | None = None) -> int:
    """Chunks of the blocks with their vectors, mapping and tokens as one Parquet dataset, root/chunks, and root/config as JSON; gives the number of chunks.

    Where there is none, nothing is written. The mapping keeps a preview of the text and its length, not the text.
    """
    spark = blocks.sparkSession
    chunks = chunk_corpus(blocks, doc_ids)
    if chunks.isEmpty():
        return 0
    vectors = external.embed(chunks.select("chunk_id", "text"), client, "chunk_id")
    kept = chunks.join(vectors, "chunk_id").select("chunk_id", "doc_id", "chunk_no", "section_path", "text_preview", "text_length", "block_ids", "tokens", "vector")
    kept.write.mode("overwrite").parquet(f"{root}/chunks")
    index = spark.read.parquet(f"{root}/chunks")
    config_of(index, model).write.mode("overwrite").json(f"{root}/config")
    return index.count()


def search(index: DataFrame, vector: list[float], k: int | None = 10) -> DataFrame:
    """The index's chunks nearest to a query's vector."""
    return rerank(index, vector, "vector", "chunk_id", k).select("chunk_id", "doc_id", "section_path", "score")
