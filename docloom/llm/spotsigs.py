"""Document fingerprints by SpotSigs.

A spot signature is an anchor (a very common word) and the chain of the next ``CHAIN`` content words after it; words of the
common-word list are passed over. A document is the set of its signatures; one without any is the set of its chains of CHAIN + 1
words of whatever kind, so that its copies are found too. Documents are linked where their sets have a Jaccard similarity of at least
``THRESHOLD``, exactly:

* equal sets are folded first;
* documents are partitioned by set length, so that a partition's pairs can only be with itself and the next one;
* a document needs ceil(threshold * size) signatures that others have too. With m such signatures in the order of rising
  frequency, one that a partner shares is among the first m - ceil(threshold * size) + 1; only these are posted, and
  posting lists with the same members are compared once, long ones block by block (links.py);
* within a list, pairs whose lengths alone rule the threshold out are pruned, the others' overlaps are counted together. A pair
  counts in the partition of the longer document, under the least posted signature that both have.

No list is capped. Links are counted and joined into classes; pairs aren't listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, lists, stored
from .links import classes, linked, weighed
from .textkernel import STEP, Words, mix, runs, shingles, utf8

ANCHORS = ["the", "is", "der", "ist", "le", "est", "el", "los"]
COMMON = """a an and are as at be by for from he in is it of on or that the this to was were which with
der die das und in den von zu mit sich im für des auf ist nicht dem ein eine als
de la le et les des en un du que est une pour qui dans par au sur pas avec
el los las y se del por con una no para su es al lo""".split()
CHAIN = 3
THRESHOLD = 0.5


def word_hashes(words: list[str]) -> np.ndarray:
    raw, offsets = utf8(pa.array(words))
    return Words(raw, offsets).hashes(letters_only=True)


def signatures(raw: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, common: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Distinct signature hashes of each document, sorted, end to end, and their bounds."""
    n = len(offsets) - 1
    words = Words(raw, offsets)
    h = words.hashes(letters_only=True)
    content = np.flatnonzero(~np.isin(h, common))
    doc = words.doc()
    spot = np.flatnonzero(np.isin(h, anchors))
    after = np.searchsorted(content, spot, "right")
    fits = after + chain <= len(content)
    spot, after = spot[fits], after[fits]
    if len(spot):
        inside = doc[content[after + chain - 1]] == doc[spot]
        spot, after = spot[inside], after[inside]
    value = h[spot]
    for i in range(chain):
        value = value * STEP + h[content[after + i]]
    grams, bounds = shingles(h, words.first, chain + 1)
    none = np.ones(n, bool)
    none[doc[spot]] = False
    every = np.repeat(np.arange(n), np.diff(bounds))
    fallback = none[every]
    value, d = np.concatenate([mix(value), mix(grams[fallback])]), np.concatenate([doc[spot], every[fallback]])
    if not len(d):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    value = value.view(np.int64)
    order = np.lexsort((value, d))
    value, d = value[order], d[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (np.diff(d) != 0) | (value[1:] != value[:-1])
    return value[keep], np.searchsorted(d[keep], np.arange(n + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: list[str] | None = None, common: list[str] | None = None, chain: int = CHAIN) -> DataFrame:
    """id, spots (sorted signature hashes as longs, none for documents without words)."""
    a, c = word_hashes(anchors or ANCHORS), word_hashes([*(common or COMMON), *(anchors or ANCHORS)])

    def run(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("text"))
        for i, j in runs(offsets):
            spots, bounds = signatures(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], a, c, chain)
            yield {"id": batch.column("id").slice(i, j - i), "spots": lists(spots, bounds, pa.int64())}

    return arrow_map(id_and_text(docs, id_col, text_col), run, "id long, spots array<long>")


def _overlapping(threshold: float):
    def compare(batch: pa.RecordBatch, left: np.ndarray, right: np.ndarray):
        part, spot = batch.column("part")[0].as_py(), batch.column("spot")[0].as_py()
        size, home = batch.column("size").to_numpy().astype(np.int64), batch.column("home").to_numpy()
        overlap = common(batch.column("spots"), left, right, None)
        larger = np.maximum(size[left][:, None], size[right])
        union = size[left][:, None] + size[right] - overlap
        near = (overlap > 0) & (np.minimum(size[left][:, None], size[right]) >= threshold * larger) & (overlap >= threshold * union)
        near &= np.maximum(home[left][:, None], home[right]) == part
        if left is right:
            near &= left[:, None] < right
        if near.any():
            near &= common(batch.column("posted"), left, right, spot) == 0
        i, j = np.nonzero(near)
        yield left[i], right[j]

    def common(sets: pa.ListArray, left: np.ndarray, right: np.ndarray, below: int | None) -> np.ndarray:
        """How many elements (less than below) each two rows share."""
        bounds, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        row = np.repeat(np.arange(len(sets)), np.diff(bounds))
        values = values[bounds[0] : bounds[-1]]
        if below is not None:
            row, values = row[values < below], values[values < below]
        distinct, element = np.unique(values, return_inverse=True)
        shared = np.bincount(element, minlength=len(distinct)) > 1
        number = np.cumsum(shared) - 1
        row, element = row[shared[element]], number[element[shared[element]]]
        order = np.argsort(element, kind="stable")
        row, element = row[order], element[order]
        counts = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(shared.sum()), 4096):
            i, j = np.searchsorted(element, [lo, lo + 4096])
            matrix = np.zeros((len(sets), min(4096, int(shared.sum()) - lo)), np.float32)
            matrix[row[i:j], element[i:j] - lo] = 1
            counts += matrix[left] @ matrix[right].T
        return counts.astype(np.int64)

    return compare


def set_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """h, near, links of the rows (h, spots, weight; h unique) whose sets have a Jaccard similarity >= threshold (above 0) with others."""
    assert 0 < threshold <= 1
    ratio = -math.log(threshold) or 1.0
    sized = sets.select("h", F.size("spots").alias("size"), "spots", F.floor(F.log(F.size("spots").cast("double")) / F.lit(ratio) + F.lit(1e-9)).cast("int").alias("home"))
    posts = sized.select("h", "home", "size", F.explode("spots").alias("spot"))
    often = posts.groupBy("spot").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.col("size") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    prefix = stored(
        posts.join(often, "spot")
        .groupBy("h", "home", "size")
        .agg(F.array_sort(F.collect_list(F.struct("df", "spot"))).alias("ks"))
        .where(F.size("ks") >= need)
        .select("h", "home", "size", F.transform(F.slice("ks", F.lit(1), F.size("ks") - need + 1), lambda k: k["spot"]).alias("posted")),
        "prefixes",
    )
    keys = prefix.select("h", F.explode(F.array("home", F.col("home") + 1)).alias("part"), "posted").select("h", "part", F.explode("posted").alias("spot"))
    return linked(keys, prefix.join(sets, "h"), ["part", "spot"], _overlapping(threshold))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, chain: int = CHAIN, anchors: list[str] | None = None, common: list[str] | None = None) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: a row for each document.

    Documents are linked where their sets' Jaccard similarity is at least threshold. n_links counts the others that a document is linked to, n_copies those of
    them with the very same set; class_id is the least id that chains of links lead to.

    Null and blank texts: a class of their own, without links. Anchorless texts are sets of word chains, shorter ones of one chain
    of all words. Null ids are left out. Repeated rows of one id count once; the signatures of an id's several texts are joined.
    Very long texts are read whole. Empty table: no rows. Other columns are ignored.
    """
    prints = fingerprints(docs, id_col, text_col, anchors, common, chain)
    repeated = docs.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select("id")
    if not repeated.isEmpty():
        several = prints.join(repeated, "id", "left_semi").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("spots"))
        prints = prints.join(repeated, "id", "left_anti").select("id", "spots").unionByName(several)
    sets = stored(prints.select("id", F.when(F.size("spots") > 0, F.col("spots")).alias("spots")).withColumn("h", F.when(F.col("spots").isNotNull(), F.xxhash64("spots"))), "spots")
    members = sets.select("id", "h")
    reps = weighed(members.where("h IS NOT NULL"))
    folded = stored(sets.join(reps, "h").where("id = rep").select("h", "spots", "weight"), "folded")
    return classes(members, set_links(folded, threshold))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return similar(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"
    upper, space = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[ \\t\\n\\r\\f\\v]+"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(translate(text, '{upper}', '{upper.lower()}'), '{space}'), lambda x: x <> ''), lambda x: regexp_replace(x, '[!-/:-@\\[-`{{-~]', '', 'g')) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
k AS (SELECT *, CASE WHEN w IN {quoted([*COMMON, *ANCHORS])} THEN 0 ELSE 1 END AS is_content FROM w),
m AS (SELECT *, sum(is_content) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM k),
c AS (SELECT doc_id, seen, {", ".join(f"lead(w, {j}) OVER (PARTITION BY doc_id ORDER BY i) AS c{j}" for j in range(CHAIN))}, count(*) OVER (PARTITION BY doc_id) AS n FROM m WHERE is_content = 1),
anchored AS (SELECT DISTINCT m.doc_id, concat_ws(' ', m.w, {", ".join(f"c{j}" for j in range(CHAIN))}) AS spot FROM m JOIN c ON c.doc_id = m.doc_id AND c.seen = m.seen + 1 WHERE m.w IN {quoted(ANCHORS)} AND c.seen + {CHAIN - 1} <= c.n),
bare AS (SELECT doc_id, ws FROM t WHERE len(ws) > 0 AND doc_id NOT IN (SELECT doc_id FROM anchored)),
s AS (SELECT * FROM anchored UNION SELECT doc_id, array_to_string(ws[i:i + {CHAIN}], ' ') FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {CHAIN}) + 1)) AS i FROM bare)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.spot = b.spot AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b, o = x.n AND o = y.n AS same FROM p JOIN z x ON x.doc_id = p.a JOIN z y ON y.doc_id = p.b WHERE o >= {THRESHOLD} * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT q.a AS doc_id, q.class_id, coalesce(l.n_links, 0) AS n_links, coalesce(l.n_copies, 0) AS n_copies FROM (SELECT a, min(b) AS class_id FROM r GROUP BY a) q
LEFT JOIN (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS n_copies FROM e GROUP BY a) l ON l.a = q.a
"""


SQL = _sql()
