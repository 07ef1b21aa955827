"""Similarity links between signatures, counted and joined into classes without listing pairs.

Signatures are posted under keys. The members of a posting list are cut into blocks of about ``BLOCK`` by a hash, and each pair of
blocks is a task of its own, so a list that a third of all signatures share is spread. A task compares its blocks, and gives for each
signature the number of its links and one partner to which a chain of links leads, never the pairs themselves. Every pair counts under
one key alone: the caller's comparison leaves it out elsewhere. Lists with the same members are compared once, under their least key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, dropped, key_groups, map_batches, stored

BLOCK = 1024
FOUND = pa.schema([("h", pa.int64()), ("near", pa.int64()), ("links", pa.int64())])


def united(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """parent (roots of all, the least of each set) once i and j are joined pairwise."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def linked(posts: DataFrame, carried: DataFrame, keys: list[str], compare: Callable, block: int | None = None) -> DataFrame:
    """h, near, links for every signature h that has a link (stored).

    posts: keys and h. carried: h (unique), weight (documents that have it) and what ``compare`` needs. compare(batch, left, right) is
    given one task's rows and the row numbers of its two blocks (the same twice where a block meets itself) and yields arrays
    of row numbers (i, j) of linked pairs, those of a block with itself in one order only.
    """
    size = block or BLOCK
    lists = posts.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y")).where("n > 1")
    least = F.min(keys[0]).alias(keys[0]) if len(keys) == 1 else F.min(F.struct(*keys)).alias("k")
    once = lists.groupBy("n", "x", "y").agg(least).select(*(keys if len(keys) == 1 else ["k.*"]), F.ceil(F.col("n") / F.lit(size)).cast("int").alias("blocks"))
    member = posts.join(once, keys).withColumn("own", F.pmod(F.xxhash64("h", F.lit(2)), F.col("blocks")).cast("int")).select(*keys, "h", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = member.select(*keys, "h", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side")).join(carried, "h")
    task = [*keys, "p", "q"]

    def run(batches):
        for group in key_groups(batches, task):
            columns = [group.column(k).to_numpy() for k in task]
            new = np.ones(group.num_rows, bool)
            new[1:] = np.any([np.diff(c) != 0 for c in columns], 0)
            at = np.append(np.flatnonzero(new), group.num_rows)
            side = group.column("side").to_numpy(zero_copy_only=False)
            for a, b in zip(at[:-1], at[1:]):
                if b - a < 2:
                    continue
                some, here, p, q = group.slice(a, b - a), np.arange(b - a), columns[-2][a], columns[-1][a]
                left, right = (here, here) if p == q else (here[~side[a:b]], here[side[a:b]])
                weight = some.column("weight").to_numpy()
                parent, links = here.copy(), np.zeros(b - a, np.int64)
                for i, j in compare(some, left, right):
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    parent = united(parent, i, j)
                has = links > 0
                if has.any():
                    h = some.column("h").to_numpy()
                    yield as_batch({"h": h[has], "near": h[parent[has]], "links": links[has]}, FOUND)

    found = map_batches(rows.repartition(*task).sortWithinPartitions(*task), run, "h long, near long, links long")
    return stored(found.groupBy("h", "near").agg(F.sum("links").alias("links")), "links")


def components(pairs: DataFrame) -> DataFrame:
    """Connected components of pairs (a, b): id, root (least id of the component), for every id of a pair.

    Alternating large-star and small-star steps by grouped minima that are joined back; every round's edges are a stored table.
    """
    edges = stored(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = least.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = stored(small, "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        dropped(edges)
        edges = new
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def weighed(members: DataFrame) -> DataFrame:
    """h, weight (documents) and rep (least id) of members (id, h)."""
    return members.groupBy("h").agg(F.count("*").alias("weight"), F.min("id").alias("rep"))


def classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, class_id (least id of those that chains of links and equal signatures join), n_links (others that it is linked to), n_copies (those of
    them with its own signature), for each of members (id, h; h null: a document without signature, a class of its own)."""
    some = members.where("h IS NOT NULL")
    reps = weighed(some)
    roots = components(found.select(F.col("h").alias("a"), F.col("near").alias("b"))).select(F.col("id").alias("h"), "root")
    rooted = reps.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("class_id")), "root").join(found.groupBy("h").agg(F.sum("links").alias("links")), "h", "left")
    each = some.join(named.select("h", "class_id", "weight", F.coalesce("links", F.lit(0)).alias("links")), "h")
    alone = members.where("h IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_copies"))
    return each.select(F.col("id").alias("doc_id"), "class_id", (F.col("weight") - 1 + F.col("links")).alias("n_links"), (F.col("weight") - 1).alias("n_copies")).unionByName(alone)
