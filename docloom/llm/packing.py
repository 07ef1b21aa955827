"""Sequence packing by power-of-two decomposition.

A document of L tokens is split into pieces whose lengths are the powers of two of L's binary form (longest first; what
exceeds the longest allowed length is first cut into pieces of that length). Pieces of equal length share a bucket, so a
batch of a bucket needs no padding and no sequence holds text of two documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map
from .textkernel import Words, runs, utf8

MAX_LOG2 = 13
TOKENS_PER_BATCH = 1 << 16
DOCS_PER_SLICE = 4096


def piece_lengths(counts: np.ndarray, max_log2: int = MAX_LOG2) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents of these token counts, laid end to end, and how many each document has."""
    top = 1 << max_log2
    bits = (counts[:, None] >> np.arange(max_log2 - 1, -1, -1)) & 1
    width = bits.shape[1]
    number = counts // top + bits.sum(1)
    whole = np.repeat(np.arange(len(counts)), counts // top)
    row, column = np.nonzero(bits)
    lengths = np.concatenate([np.full(len(whole), top), 1 << (width - 1 - column)])
    order = np.argsort(np.concatenate([whole, row]), kind="stable")
    return lengths[order], number


def decompose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_log2: int = MAX_LOG2) -> DataFrame:
    """doc_id, piece (from 0), bucket (log2 of the length), start (first token), n_tokens, text.

    Tokens are words (without ASCII white space), each with the white space before it, the last also with that after it, so
    that a document's pieces in order give exactly its text. Null, empty and blank texts have no pieces. A null id is
    kept as it is. Repeated rows are split each. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("__text"))
        for i, j in runs(offsets, 1 << 23):
            part, base = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            words = Words(part, base)
            counts = np.diff(words.first)
            lengths, number = piece_lengths(counts, max_log2)
            owner = np.repeat(np.arange(j - i), number)
            before = np.cumsum(lengths) - lengths
            start = before - words.first[:-1][owner]
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
            head = np.where(piece == 0, base[:-1][owner], words.end[before - 1])
            tail = np.where(start + lengths == counts[owner], base[1:][owner], words.end[before + lengths - 1])
            size = tail - head
            blank = np.repeat(counts == 0, np.diff(base))
            body = part[~blank] if blank.any() else part
            text = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
            yield {
                "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(owner)), "piece": piece, "bucket": np.log2(lengths).astype(np.int32),
                "start": start, "n_tokens": lengths, "text": text,
            }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))
    return arrow_map(rows, run, "doc_id long, piece int, bucket int, start int, n_tokens int, text string")


def decompose_tokens(docs: DataFrame, id_col: str, tokens_col: str, max_log2: int = MAX_LOG2) -> DataFrame:
    """decompose() for a column of token arrays; ``tokens`` in place of ``text``. A null array has no pieces."""
    n = F.size("__tokens")
    powers = F.array(*[F.lit(1 << b) for b in range(max_log2 - 1, -1, -1)])
    lengths = F.concat(F.array_repeat(F.lit(1 << max_log2), F.shiftright(n, max_log2)), F.filter(powers, lambda v: n.bitwiseAND(v) > 0))
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(tokens_col, F.array().cast(docs.schema[tokens_col].dataType)).alias("__tokens"))
    pieces = split.select("doc_id", "__tokens", lengths.alias("__lengths")).select("doc_id", "__tokens", "__lengths", F.posexplode("__lengths").alias("piece", "n_tokens"))
    start = F.expr("aggregate(slice(__lengths, 1, piece), 0, (a, x) -> a + x)")
    return pieces.select("doc_id", "piece", F.round(F.log2("n_tokens")).cast("int").alias("bucket"), start.alias("start"), "n_tokens", F.slice("__tokens", start + 1, F.col("n_tokens")).alias("tokens"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens_col: str | None = None, max_log2: int = MAX_LOG2, tokens_per_batch: int = TOKENS_PER_BATCH, docs_per_slice: int = DOCS_PER_SLICE) -> DataFrame:
    """decompose() with places: batch (string ``<bucket>-<slice>-<number>``) and slot (from 0) in it. All sequences of a batch
    have one length, and a batch holds at most tokens_per_batch tokens (one sequence at least).

    Each bucket is cut by a hash of the document's id into as many slices as the table has docs_per_slice documents, and
    numbered within them, so a task's share doesn't grow with the table; only the last batch of a bucket's slice may
    not be full. The order is by id, piece, contents; rows without id share slice 0. An empty table gives no rows.
    """
    slices = max(1, -(-docs.count() // docs_per_slice))
    rows = decompose_tokens(docs, id_col, tokens_col, max_log2) if tokens_col else decompose(docs, id_col, text_col, max_log2)
    hashed = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long")
    number = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("doc_id", "piece", "tokens" if tokens_col else "text")) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(tokens_per_batch) / F.col("n_tokens"))).cast("int")
    return (
        rows.withColumn("slice", F.coalesce(F.pmod(hashed, F.lit(slices)), F.lit(0)).cast("int"))
        .withColumn("n", number)
        .withColumn("batch", F.concat_ws("-", "bucket", "slice", F.floor(F.col("n") / per).cast("string")))
        .withColumn("slot", F.pmod("n", per).cast("int"))
        .drop("n", "slice")
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))


WORD = "[ \\t\\n\\r\\f\\v]*[^ \\t\\n\\r\\f\\v]+"
SQL = f"""
WITH slices AS (SELECT greatest(1, ceil(count(*) / {DOCS_PER_SLICE}.0))::BIGINT AS k FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w FROM documents),
p AS (
  SELECT doc_id, text, w, len(w) AS c, list_concat(list_transform(range(len(w) // {1 << MAX_LOG2}), lambda i: {1 << MAX_LOG2}::BIGINT),
    list_filter([{", ".join(f"{1 << b}::BIGINT" for b in range(MAX_LOG2 - 1, -1, -1))}], lambda v: (len(w) & v) > 0)) AS ls
  FROM t WHERE len(w) > 0),
e AS (SELECT doc_id, text, w, c, ls, unnest(range(len(ls))) AS piece FROM p),
x AS (SELECT doc_id, text, w, c, piece, ls[piece + 1] AS n, coalesce(list_sum(ls[1:piece]), 0)::BIGINT AS s FROM e),
y AS (
  SELECT doc_id, piece, log2(n)::INT AS bucket, s AS start, n AS n_tokens,
    array_to_string(w[s + 1:s + n], '') || CASE WHEN s + n = c THEN substr(text, length(array_to_string(w, '')) + 1) ELSE '' END AS text,
    coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT % (SELECT k FROM slices), 0) AS slice
  FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY bucket, slice ORDER BY doc_id, piece, text) - 1 AS k, greatest(1, {TOKENS_PER_BATCH} // n_tokens) AS per FROM y)
SELECT doc_id, piece::INT AS piece, bucket, start::INT AS start, n_tokens::INT AS n_tokens, text, bucket || '-' || slice || '-' || (k // per) AS batch, (k % per)::INT AS slot FROM z
"""
