"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees labels a vector with a long hash string of ``SYMBOLS`` symbols of five bits. A symbol is a cross-polytope hash: the largest of
16 random projections by magnitude, and its sign. (Bits of random hyperplanes are such strings too, but need some three times as many
comparisons here.) A tree is its sorted labels. A query descends to the vectors whose labels share its own label's longest prefixes,
and then all trees ascend together, one bit at a time, until the vectors that share the prefix number at least ``ENOUGH`` over all trees. Those,
each once, are compared with the query by cosine; the best k stay.

Labels travel without vectors, packed by batches of vectors. Trees are cut into blocks of about ``PER_BLOCK`` labels by their first bits, which is
as far as a query ascends; a block that has more, since vectors crowd there, is spread over several tasks, which all answer its
queries. Vectors are cut into blocks by a hash of the id, and a vector or query is sent once to each block that compares it. Equal
vectors are indexed by their k + 1 least ids, which are all that can be among the k best, and ask together, so no group of copies is
compared with itself.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, as_batch, key_groups, lists, map_batches, stored
from .textkernel import mix

K = 10
EVERY = 20
TREES = 96
SYMBOLS = 6
ENOUGH = 12000
PROJECTIONS = 16
SYMBOL_BITS = 5
BITS = SYMBOLS * SYMBOL_BITS
PER_BLOCK = 1 << 16
VECTORS_PER_TASK = 1 << 15
SEED = 97


def projections(tree: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree]).standard_normal((dim, SYMBOLS * PROJECTIONS)).astype(np.float32)


def labels(unit: np.ndarray, tree: int) -> np.ndarray:
    """The hash string of each vector in a tree, as a number of BITS bits."""
    y = (unit @ projections(tree, unit.shape[1])).reshape(len(unit), SYMBOLS, PROJECTIONS)
    at = np.abs(y).argmax(2)
    symbol = at * 2 + (np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] > 0)
    return symbol @ (np.int64(1) << np.arange(BITS - SYMBOL_BITS, -1, -SYMBOL_BITS, dtype=np.int64))


def usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows whose vector has dim finite numbers, not all of them 0."""
    ids, vectors = batch.column("id").to_numpy(), batch.column("vec")
    size = np.array([len(v) if v is not None else -1 for v in vectors.to_pylist()]) if vectors.null_count else np.diff(vectors.offsets.to_numpy())
    fits = np.flatnonzero(size == dim)
    if not len(fits):
        return ids[:0], np.zeros((0, dim), np.float32)
    m = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((m * m).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return ids[fits][good], (m[good] / norm[good, None]).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def packed(rows: DataFrame, key: str, dim: int, shared: int, level: str | None = None) -> DataFrame:
    """For the vectors of a batch and a block of a tree: block, cell (any number), n, code (sorted labels), key and level (in that order), packed."""

    def run(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        unit, ids = matrix(batch.column("vec"), dim), batch.column(key).to_numpy()
        levels = batch.column(level).to_numpy().astype(np.int64) if level else None
        for tree in range(TREES):
            code = labels(unit, tree)
            order = np.argsort(code, kind="stable")
            code, mine = code[order], ids[order]
            block = code >> (BITS - shared)
            cuts = np.append(np.flatnonzero(np.r_[True, np.diff(block) != 0]), len(code))
            spans = list(zip(cuts[:-1], cuts[1:]))
            yield {
                "block": (np.int64(tree) << 32) | block[cuts[:-1]], "cell": [int.from_bytes(os.urandom(7), "little") for _ in spans], "n": np.diff(cuts),
                "code": [squeezed(np.diff(code[a:b], prepend=0).astype(np.int32)) for a, b in spans], "key": [squeezed(mine[a:b]) for a, b in spans],
                "level": [squeezed(levels[order][a:b]) if level else None for a, b in spans],
            }

    return arrow_map(rows, run, "block long, cell long, n int, code binary, key binary, level binary")


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def codes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.int32).astype(np.int64))


def keys(data: bytes | None, n: int) -> np.ndarray:
    return np.zeros(n, np.int64) if data is None else np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.int64)


def ranges(sorted_codes: np.ndarray, asked: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes that share the first bits bits with each asked one begin and end."""
    drop = BITS - np.asarray(bits, np.int64)
    low = asked >> drop << drop
    return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, low + (np.int64(1) << drop))


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = 1, enough: int | None = None, per_block: int | None = None, per_task: int = VECTORS_PER_TASK) -> DataFrame:
    """vec_id, neighbour, rank (from 1), cosine: up to k nearest others of every vector whose id is divisible by ``every``, among all
    vectors; equal cosines go to the lower id.

    Null ids are left out; null, zero and not finite vectors, and those not of the commonest length (the longer of two), neither
    ask nor answer. Repeated rows of one id and vector count once; of an id with several vectors each asks, the nearest answers, and
    an id is never its own neighbour and is given once for each that asks. An empty table gives no rows; a single vector has no neighbours.
    While all trees' roots together hold no more than ``enough`` labels, all vectors are compared. Other columns are ignored.
    """
    enough, per_block = enough or ENOUGH, per_block or PER_BLOCK
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim, n = (sizes[0], sizes[1]) if sizes and sizes[0] else (1, 0)
    shared = min(BITS, max(0, math.ceil(math.log2(max(1, n) / per_block))))

    homes = max(1, -(-n // per_task))

    def normal(batch: pa.RecordBatch):
        ids, unit = usable(batch, dim)
        yield {"id": ids, "vec": [v.tobytes() for v in unit], "home": (mix(ids.astype(np.uint64)) % np.uint64(homes)).astype(np.int32)}

    every_row = stored(arrow_map(rows, normal, "id long, vec binary, home int").withColumn("vk", F.xxhash64("vec")).distinct(), "vectors")
    least = Window.partitionBy("vk").orderBy("id")
    index = stored(every_row.withColumn("place", F.row_number().over(least)).where(f"place <= {k + 1}").select("id", "vec", "home"), "index")
    who = every_row.where(F.col("id") % every == 0)
    asks = stored(who.groupBy("vk").agg(F.any_value("vec").alias("vec")), "queries")

    tree = stored(packed(index.select("id", "vec"), "id", dim, shared).drop("level"), "trees")
    parts = tree.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(per_block)).cast("int").alias("parts"))
    columns = ["block", "part", "ask", "n", "code", "key", "level"]
    cells = tree.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int")).withColumn("ask", F.lit(False)).withColumn("level", F.lit(None).cast("binary"))

    def with_trees(questions: DataFrame, labels_: DataFrame) -> DataFrame:
        """What each task needs: a part of a block, and the questions of the block."""
        asked = questions.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ask", F.lit(True))
        return labels_.select(*columns).unionByName(asked.select(*columns)).repartition("block", "part").sortWithinPartitions("block", "part")

    def blocks(batches):
        """Of each task: sorted labels and their keys; the labels, keys and levels that ask."""
        for group in key_groups(batches, ["block", "part"]):
            b, p = group.column("block").to_numpy(), group.column("part").to_numpy()
            cuts = np.append(np.flatnonzero(np.r_[True, (np.diff(b) != 0) | (np.diff(p) != 0)]), len(b))
            for i, j in zip(cuts[:-1], cuts[1:]):
                got: dict[bool, list] = {False: [], True: []}
                for r in group.slice(i, j - i).to_pylist():
                    got[r["ask"]].append((codes(r["code"], r["n"]), *[keys(r[c], r["n"]) for c in ("key", "level")]))
                if got[True] and got[False]:
                    (code, key, _), (asked, ask, level) = (map(np.concatenate, zip(*got[x])) for x in (False, True))
                    order = np.argsort(code, kind="stable")
                    yield code[order], key[order], asked, ask, level

    def count(batches):
        schema = pa.schema([("vk", pa.int64()), ("n", pa.list_(pa.int64()))])
        for code, _, asked, ask, _ in blocks(batches):
            c = np.stack([np.subtract(*ranges(code, asked, bits)[::-1]) for bits in range(shared, BITS + 1)], 1)
            yield as_batch({"vk": ask, "n": lists(c.ravel(), np.arange(len(ask) + 1) * c.shape[1], pa.int64())}, schema)

    bare = cells.withColumn("key", F.lit(None).cast("binary"))
    counted = map_batches(with_trees(packed(asks, "vk", dim, shared), bare), count, "vk long, n array<long>")
    total = counted.groupBy("vk").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(BITS - shared + 1)]).alias("n"))
    last = F.expr(f"coalesce(array_max(filter(transform(n, (c, i) -> if(c >= {enough}, i, null)), x -> x IS NOT NULL)), 0)")
    reach = stored(total.select("vk", (last + shared).cast("int").alias("level")).join(asks, "vk"), "reach")

    def gather(batches):
        schema = pa.schema([("home", pa.int32()), ("vk", pa.int64()), ("ids", pa.list_(pa.int64()))])
        for code, key, asked, ask, level in blocks(batches):
            home = (mix(key.astype(np.uint64)) % np.uint64(homes)).astype(np.int64)
            low, high = ranges(code, asked, level)
            for i in range(0, len(asked), 1024):
                lo, n = low[i : i + 1024], (high - low)[i : i + 1024]
                who_ = np.repeat(np.arange(len(n)), n)
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                if homes > 1:
                    order = np.lexsort((home[at], who_))
                    who_, at = who_[order], at[order]
                if len(at):
                    cuts = np.flatnonzero(np.r_[True, (np.diff(who_) != 0) | (np.diff(home[at]) != 0)])
                    yield as_batch({"home": home[at[cuts]], "vk": ask[i : i + 1024][who_[cuts]], "ids": lists(key[at], np.append(cuts, len(at)), pa.int64())}, schema)

    asked_for = stored(map_batches(with_trees(packed(reach, "vk", dim, shared, "level"), cells), gather, "home int, vk long, ids array<long>"), "candidates")
    none = {"kind": F.lit(0), "vk": F.lit(0).cast("long"), "id": F.lit(0).cast("long"), "vec": F.lit(None).cast("binary"), "ids": F.lit(None).cast("array<long>")}
    there = asked_for.select("home", "vk").distinct().join(asks, "vk").withColumn("kind", F.lit(1))
    every_kind = [t.withColumns({c: v for c, v in none.items() if c not in t.columns}).select("home", *none) for t in (index, there, asked_for.withColumn("kind", F.lit(2)))]
    work = every_kind[0].unionByName(every_kind[1]).unionByName(every_kind[2]).repartition("home").sortWithinPartitions("home", "kind", "vk")

    def compare(batches):
        schema = pa.schema([("vk", pa.int64()), ("id", pa.int64()), ("cosine", pa.float32())])
        now, held, asked, open_, vk = None, [], {}, [], None

        def answer():
            nonlocal open_
            if open_:
                chosen = np.zeros(len(held[2]), bool)
                chosen[np.searchsorted(held[2], np.concatenate(open_))] = True
                at = np.flatnonzero(chosen[held[3]])
                cosine = held[1][at] @ asked[vk]
                ids, cosine = best(held[0][at], cosine, k + 1)
                open_ = []
                return as_batch({"vk": np.full(len(ids), vk), "id": ids, "cosine": cosine}, schema)

        for batch in batches:
            home, kind, key = (batch.column(c).to_numpy() for c in ("home", "kind", "vk"))
            cuts = np.append(np.flatnonzero(np.r_[True, (np.diff(home) != 0) | (np.diff(kind) != 0)]), len(home)) if len(home) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(i, j - i)
                if home[i] != now:
                    if (x := answer()) is not None:
                        yield x
                    now, held, asked = home[i], [], {}
                if kind[i] == 0:
                    held.append((part.column("id").to_numpy(), matrix(part.column("vec"), dim)))
                elif kind[i] == 1:
                    asked |= dict(zip(key[i:j].tolist(), matrix(part.column("vec"), dim)))
                else:
                    if isinstance(held, list):
                        ids, m = map(np.concatenate, zip(*held))
                        order = np.argsort(ids, kind="stable")
                        held = (ids[order], m[order], *np.unique(ids[order], return_inverse=True))
                    column = part.column("ids")
                    bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
                    for n_, q in enumerate(key[i:j].tolist()):
                        if q != vk and (x := answer()) is not None:
                            yield x
                        vk = q
                        open_.append(values[bounds[n_] : bounds[n_ + 1]])
        if (x := answer()) is not None:
            yield x

    found = map_batches(work, compare, "vk long, id long, cosine float")
    nearest = found.groupBy("vk").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("id")))).alias("near"))
    mine = who.select("id", "vk").join(nearest, "vk").select(F.col("id").alias("vec_id"), F.expr(f"slice(filter(near, x -> x.id <> id), 1, {k})").alias("near"))
    return mine.select("vec_id", F.posexplode("near").alias("place", "x")).select("vec_id", F.col("x.id").alias("neighbour"), (F.col("place") + 1).alias("rank"), (-F.col("x.far")).alias("cosine"))


def best(ids: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of the greatest cosines, each id once, equal ones in the order of ids."""
    some = np.flatnonzero(cosine >= np.partition(cosine, len(cosine) - 4 * k)[len(cosine) - 4 * k]) if len(cosine) > 4 * k else np.arange(len(cosine))
    order = some[np.lexsort((ids[some], -cosine[some]))]
    _, first = np.unique(ids[order], return_index=True)
    if len(first) < k and len(some) < len(cosine):  # one id has many vectors
        order = np.lexsort((ids, -cosine))
        _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], cosine[order]


def query(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by EVERY asks, all answer."""
    from .common import table

    return neighbours(table(spark, sf_dir, "embeddings"), every=EVERY)
