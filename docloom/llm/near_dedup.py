"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's signature has ``COORDINATES`` minima of hashed word shingles. Each (coordinate, value) is a posting key.
Two documents are near duplicates when at least ``THRESHOLD`` coordinates agree. The join counts collisions exactly:

* equal signatures are folded first, so a group of copies costs one signature, however large it is;
* a pair with t agreeing coordinates shares t keys that occur at least twice. With a document's m such keys in the order
  of rising frequency, one shared key must be among its first m-t+1 (prefix filter). Only these are posted, and a document
  with m < t is skipped altogether;
* posting lists with the same members are compared once, and long lists block by block (links.py);
* within a posting list the agreeing coordinates are counted at once over all partners; a pair that an earlier shared
  prefix key has already counted is skipped.

No list or partner is capped. Links are counted and joined into classes; pairs aren't listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, stored
from .links import classes, linked, weighed
from .textkernel import Words, runs, shingles, utf8

COORDINATES = 64
THRESHOLD = 32
SHINGLE = 2
SEED = 20240601


def multipliers(n: int = COORDINATES) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature_matrix(raw: np.ndarray, offsets: np.ndarray, n: int = COORDINATES, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the documents that have a word, and their positions."""
    words = Words(raw, offsets)
    grams, bounds = shingles(words.hashes(letters_only=True), words.first, k)
    rows = np.flatnonzero(np.diff(bounds) > 0)
    out = np.empty((len(rows), n), np.uint32)
    for j, a in enumerate(multipliers(n)):
        out[:, j] = np.minimum.reduceat(((grams * a) >> np.uint64(32)).astype(np.uint32), bounds[:-1][rows]) if len(rows) else 0
    return out, rows


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = COORDINATES, k: int = SHINGLE) -> DataFrame:
    """id, h (hash of the signature), sig (n little-endian 32-bit minima); both null for documents without words."""

    def run(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("text"))
        ids = batch.column("id").to_numpy()
        for i, j in runs(offsets):
            sig, rows = signature_matrix(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n, k)
            every: list[bytes | None] = [None] * (j - i)
            for r, x in zip(rows.tolist(), sig):
                every[r] = x.tobytes()
            yield {"id": ids[i:j], "sig": every}

    return arrow_map(id_and_text(docs, id_col, text_col), run, "id long, sig binary").withColumn("h", F.when(F.col("sig").isNotNull(), F.xxhash64("sig")))


def _agreeing(n: int, threshold: int):
    bit = np.uint64(1) << np.arange(n, dtype=np.uint64)

    def compare(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, n)
        in_prefix = (batch.column("mask").to_numpy().view(np.uint64)[:, None] & bit) != 0
        coordinate = batch.column("key")[0].as_py() >> 32
        theirs = np.ascontiguousarray(sig[right])
        step = max(1, (1 << 22) // (len(right) * n))
        for x in range(0, len(left), step):
            some = left[x : x + step]
            same = sig[some][:, None, :] == theirs[None]
            near = same.sum(2, dtype=np.int32) >= threshold
            if left is right:
                near &= some[:, None] < right
            i, j = np.nonzero(near)
            if len(i):
                shared = same[i, j] & in_prefix[some[i]] & in_prefix[right[j]]
                here = shared.argmax(1) == coordinate
                yield some[i[here]], right[j[here]]

    return compare


def signature_links(reps: DataFrame, n: int = COORDINATES, threshold: int = THRESHOLD) -> DataFrame:
    """h, near, links of the rows (h, sig, weight; h unique) whose signatures agree with others on at least threshold coordinates."""
    assert 0 < threshold <= n <= 64

    def explode(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        values = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, n).astype(np.int64)
        keys = values + (np.arange(n, dtype=np.int64) << 32)
        yield {"key": keys.ravel(), "h": np.repeat(batch.column("h").to_numpy(), n)}

    postings = arrow_map(reps.select("h", "sig"), explode, "key long, h long")
    often = postings.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    prefix = stored(
        postings.join(often, "key")
        .groupBy("h")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("ks"))
        .where(F.size("ks") >= threshold)
        .select("h", F.expr(f"transform(slice(ks, 1, size(ks) - {threshold - 1}), x -> x.key)").alias("keys"))
        .withColumn("mask", F.expr("aggregate(keys, 0L, (m, k) -> m | shiftleft(1L, cast(shiftright(k, 32) as int)))")),
        "prefixes",
    )
    return linked(prefix.select("h", F.explode("keys").alias("key")), prefix.select("h", "mask").join(reps, "h"), ["key"], _agreeing(n, threshold))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = COORDINATES, threshold: int = THRESHOLD, k: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: a row for each document.

    Two documents are linked where their signatures agree on at least threshold of n coordinates. n_links counts the others that a document is
    linked to, n_copies those of them with the very same signature; class_id is the least id that chains of links lead to.

    Null or blank text: a class of its own, without links. Null id: left out. Repeated rows of one id and signature count
    once; an id with texts of several signatures has a row for each, and they are linked like those of others. Texts shorter than a shingle: one
    shingle of all words. Very long texts are read whole. Empty table: no rows. Other columns are ignored.
    """
    sigs = stored(signatures(docs, id_col, text_col, n, k), "signatures")
    members = sigs.select("id", "h").distinct()
    reps = stored(sigs.where("h IS NOT NULL").groupBy("h").agg(F.any_value("sig").alias("sig")).join(weighed(members.where("h IS NOT NULL")).drop("rep"), "h"), "representatives")
    return classes(members, signature_links(reps, n, threshold))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each class of near_classes() the document with the least id stays.

    Documents without text or id stay; of rows with one and the same id, one stays (its least text). Other columns are kept, whatever their names.
    """
    names = docs.columns
    hidden = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    gone = near_classes(docs, id_col, text_col).groupBy("doc_id").agg(F.min("class_id").alias("class_id")).where("doc_id <> class_id").select("doc_id")
    kept = hidden.join(gone, hidden[key].cast("long") == gone["doc_id"], "left_anti")
    again = hidden.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 AND {key} IS NOT NULL").select(key)
    if not again.isEmpty():
        first = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first())
        single = kept.join(again, key, "left_semi").withColumn("place", F.row_number().over(first)).where("place = 1")
        kept = kept.join(again, key, "left_anti").select(*hidden.columns).unionByName(single.select(*hidden.columns))
    return kept.select(*hidden.columns).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_classes(table(spark, sf_dir, "documents"))
