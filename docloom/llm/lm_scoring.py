"""Language-model scores by Katz back-off over words.

Tokens are words (maximal runs without ASCII white space, told apart by 64-bit hashes) and one end mark a document; each is predicted from the
ORDER - 1 tokens before it (begin marks stand before the first). All n-grams of all documents are counted, none is capped. Counts up to GT_MAX are discounted
by Good-Turing; what a context's discounts leave is shared among the tokens not seen after it, in the proportion of the
next shorter context's probabilities, by a weight that makes each context's probabilities sum to exactly one:

    P(w | h) = d(c) c(hw) / c(h)                    if hw was seen
             = alpha(h) P(w | h without its first)  otherwise, alpha = (1 - sum of seen P) / (1 - sum of the same in the shorter context)

A context none of whose counts is discounted counts one unseen token more, so alpha is positive. Words that the corpus hasn't are one unknown token more, so
no context has seen every token; single tokens back off to the uniform distribution over all of them.

``train`` stores the tables of all orders: (g, logp) and (ctx, logalpha), in partitions by the key, of single tokens and of bigrams' contexts; and blocks of packed codes,
bucketed by part, that have all trigrams and bigrams of their contexts with their counts. From these, the discounts and the bigrams of its part, a block's reader has the log-probabilities of both orders
and the weights of trigrams' contexts, so these aren't written as numbers of eight bytes each. ``score`` sends the tokens of any texts to the blocks of their contexts, which
look them up from the highest order down; bigrams not found go on to the tables of contexts and single tokens as joins. Nothing that grows with the corpus is broadcast:
the BOOK commonest words that have short codes are a fixed number.

The query trains on a corpus and scores its documents by those tables.

``own_scores`` is a shortcut for that, which builds no tables and no weights. All the documents' n-grams are among those counted, so the highest order has them
all, and a trigram's and its context's counts and the discounts are all that the definition needs: the rows are those of train and score (a
test compares them) without storing the tables. Each token is sent once to the task of its context, packed with others of its batch, and comes back as sums by document.
"""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, dropped, id_and_text, key_groups, map_batches, shared_dir, stored
from .textkernel import STEP, Words, mix, runs, utf8

ORDER = 3
GT_MAX = 5
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
RUN_BYTES = 1 << 20
GROUP_BYTES = 1 << 24
PART_BYTES = 8 << 20
ROWS_PER_PARTITION = 1 << 21
BOOK = 1 << 18


def sequences(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """The order symbols that end at each token (words and end marks), oldest first, and the number of tokens of each document."""
    words = Words(raw, offsets)
    n, pad = len(offsets) - 1, order - 1
    symbols = np.full(len(words) + n * (pad + 1), BEGIN, np.uint64)
    symbols[np.arange(len(words)) + words.doc() * (pad + 1) + pad] = words.hashes(lower=False)
    symbols[words.first[1:] + np.arange(1, n + 1) * (pad + 1) - 1] = END
    keep = np.ones(len(symbols), bool)
    for i in range(pad):
        keep[words.first[:-1] + np.arange(n) * (pad + 1) + i] = False
    at = np.flatnonzero(keep)
    return [symbols[at - i] for i in range(pad, -1, -1)], np.diff(words.first) + 1


def gram(symbols: list[np.ndarray], n: int) -> np.ndarray:
    """Key of some symbols in a row (0 for none)."""
    h = np.zeros(n, np.uint64)
    for s in symbols:
        h = mix(h * STEP + s)
    return h.view(np.int64)


def discounts(numbers: list[int]) -> list[float]:
    """d(1)..d(k) from the numbers of n-grams seen 1..k+1 times. A ratio that isn't between 0 and 1 (sparse counts) gives 1."""
    k = len(numbers) - 1
    n1, last = numbers[0], (k + 1) * numbers[k]
    out = []
    for r in range(1, k + 1):
        d = 1.0
        if n1 > 0 and numbers[r - 1] > 0 and numbers[r] > 0 and n1 != last:
            d = ((r + 1) * numbers[r] / (r * numbers[r - 1]) - last / n1) / (1 - last / n1)
        out.append(d if 0 < d < 1 else 1.0)
    return out


def in_partitions(table: DataFrame, key: str, name: str, rows: int) -> DataFrame:
    """The table, of about so many rows, stored in partitions by key of about ROWS_PER_PARTITION rows, each sorted."""
    spark = table.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    parts = max(1, -(-rows // ROWS_PER_PARTITION))
    table.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part", key).write.partitionBy("part").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


class Book:
    """Short codes for the commonest words, by rank; all others are rare and numbered after them, in each cell anew, by a list of their hashes. Only a way to write
    words in few bytes: what is counted and scored doesn't depend on it."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        self.rank = np.argsort(words).astype(np.uint32)
        self.rising = words[self.rank]

    def code(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the hashes of the rare words in the order of theirs."""
        at = np.minimum(np.searchsorted(self.rising, words), self.n - 1)
        rest = self.rising[at] != words
        code = self.rank[at]
        rare, where = np.unique(words[rest], return_inverse=True)
        code[rest] = self.n + where
        return code, rare

    def sealed(self, columns: list[np.ndarray], rare: np.ndarray) -> tuple[bytes, list[np.ndarray]]:
        """The hashes of those rare words that the columns have, and the columns with these numbered anew in the same order."""
        used = np.unique(np.concatenate([c[c >= self.n] for c in columns]))
        out = []
        for c in columns:
            c, high = c.copy(), c >= self.n
            c[high] = self.n + np.searchsorted(used, c[high])
            out.append(c)
        return put(np.diff(rare[used - self.n], prepend=np.uint64(0))), out

    def opened(self, lists: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of several cells' lists of rare words: one list of them all, and for each cell the codes in it of its own list."""
        hashes = [np.cumsum(got(x)) for x in lists]
        rare = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        return rare, [(self.n + np.searchsorted(rare, h)).astype(np.uint32) for h in hashes]

    def renumbered(self, codes: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """Codes with those of rare words replaced."""
        out, high = codes.astype(np.uint32), codes >= self.n
        out[high] = rare[codes[high] - self.n]
        return out


def put(values: np.ndarray) -> bytes:
    """Whole numbers, packed byte by byte of their places; the number of them and of bytes of each stand before."""
    v = np.ascontiguousarray(values, np.uint64)
    wide = max(1, -(-int(v.max()).bit_length() // 8)) if len(v) else 1
    return len(v).to_bytes(7, "little") + bytes([wide]) + squeezed(v.view(np.uint8).reshape(-1, 8)[:, :wide].T, np.uint8)


def got(data: bytes) -> np.ndarray:
    n, wide = int.from_bytes(data[:7], "little"), data[7]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :wide] = loosened(data[8:], n * wide, np.uint8).reshape(wide, n).T
    return out.view(np.uint64).ravel()


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row is the first or differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], 0)
    return new


def distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns of codes, sorted, and the sums of n over them."""
    if not len(n):
        return columns, n
    bits = max(int(c.max()) for c in columns).bit_length()
    if bits * len(columns) <= 64:
        key = np.zeros(len(n), np.uint64)
        for c in columns:
            key = key << np.uint64(bits) | c.astype(np.uint64)
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = np.flatnonzero(changes(*columns))
    return [c[at] for c in columns], np.add.reduceat(n[order], at)


def put_rows(columns: list[np.ndarray]) -> list[bytes]:
    """Sorted rows, each column by its steps where the columns before it stay the same."""
    out, same = [], np.zeros(len(columns[0]), bool)
    same[1:] = True
    for c in columns:
        c = c.astype(np.int64)
        step = c.copy()
        step[1:] -= np.where(same[1:], c[:-1], 0)
        out.append(put(step.view(np.uint64)))
        same &= ~changes(c)
    return out


def got_rows(data: list[bytes]) -> list[np.ndarray]:
    out, first = [], None
    for x in data:
        step = got(x)
        total = np.cumsum(step)
        if first is not None and len(step):
            at = np.flatnonzero(first)
            total -= np.repeat(total[at] - step[at], np.diff(np.append(at, len(step))))
        out.append(total.astype(np.uint32))
        first = changes(out[-1]) if first is None else first | changes(out[-1])
    return out


def groups_of(batches, seen, size: int):
    """ids, tokens and numbers of tokens of groups of documents; seen gives each run's tokens another form."""
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        for i, j in runs(offsets, size):
            some, base, words, each = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], [], []
            for x, y in runs(base, RUN_BYTES):
                symbols, n = sequences(some[base[x] : base[y]], base[x : y + 1] - base[x], 1)
                words.append(symbols[0])
                each.append(n)
            yield batch.column("id").to_numpy()[i:j], *seen(np.concatenate(words)), np.concatenate(each)


def unigrams(rows: DataFrame) -> DataFrame:
    def run(batches):
        for _, words, n, _ in groups_of(batches, lambda w: np.unique(w, return_counts=True), GROUP_BYTES):
            yield as_batch({"w": words.view(np.int64), "c": n}, pa.schema([("w", pa.int64()), ("c", pa.int64())]))

    return stored(map_batches(rows, run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "unigrams")


class Places:
    """Which part a trigram belongs to: that of its middle word, so a part has all trigrams and bigrams of its contexts. The trigrams of a word that would
    fill several parts are spread over some by their first words; these parts have all its bigrams each, and the first of them is their owner."""

    def __init__(self, book: Book, counts: np.ndarray, tokens: int):
        self.parts = max(1, -(-tokens // ROWS_PER_PARTITION))
        self.book, self.spread = book, np.minimum(1 + counts // (2 * ROWS_PER_PARTITION), self.parts).astype(np.uint64)

    def of(self, first: np.ndarray, middle: np.ndarray, rare: np.ndarray) -> np.ndarray:
        words, parts = np.concatenate([self.book.words, rare]), np.uint64(self.parts)
        return ((words[middle] % parts + (words[first] >> np.uint64(20)) % self.wide(middle)) % parts).astype(np.int32)

    def wide(self, middle: np.ndarray) -> np.ndarray:
        return np.where(middle < self.book.n, self.spread[np.minimum(middle, self.book.n - 1)], np.uint64(1))


def trigrams(book: Book, code: np.ndarray, each: np.ndarray) -> list[np.ndarray]:
    """Codes of the middle, first and last words of the trigrams that end at each token."""
    begin = int(book.code(np.array([BEGIN]))[0][0])
    out, at = [code], np.cumsum(each) - each
    for _ in range(ORDER - 1):
        before = np.roll(out[-1], 1)
        before[at] = begin
        out.append(before)
    return [out[1], out[2], out[0]]


CELL = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("rare", pa.binary()), ("s2", pa.binary()), ("s1", pa.binary()), ("s3", pa.binary()), ("n", pa.binary())])
ASKED = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("ids", pa.binary()), ("rare", pa.binary()), ("s2", pa.binary()), ("s1", pa.binary()), ("s3", pa.binary()), ("doc", pa.binary()), ("n", pa.binary())])
BLOCK = pa.schema([("part", pa.int32()), ("rare", pa.binary()), *[(c, pa.binary()) for c in ("s2", "s1", "s3", "n", "t2", "t3", "m")], ("n2", pa.list_(pa.int64())), ("n3", pa.list_(pa.int64()))])
TOLD = pa.schema([("batch", pa.int64()), ("docs", pa.int32()), ("ids", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("values", pa.binary()), ("at", pa.binary()), ("missed", pa.int64()), *[(c, pa.binary()) for c in ("miss", "m2", "m3")]])


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)


def each_of(batches, key: str):
    """The rows of each value of a key by which the batches are sorted."""
    for group in key_groups(batches, key):
        at = np.flatnonzero(changes(group.column(key).to_numpy()))
        for i, j in zip(at, np.append(at[1:], len(group))):
            yield group.slice(i, j - i)


def by_part(part: np.ndarray):
    """Each part and where its rows are, in their order."""
    order = np.argsort(part, kind="stable")
    at = np.flatnonzero(changes(part[order])) if len(part) else []
    for i, j in zip(at, np.append(at[1:], len(part)) if len(part) else []):
        yield int(part[order[i]]), order[i:j]


def counted(rows: DataFrame, places: Places) -> DataFrame:
    """Blocks: of each part its different trigrams and bigrams with their counts, by codes, and how many were seen 1, 2 .. times."""
    book = places.book
    heavy = bool((places.spread > 1).any())

    def cells(batches):
        for _, code, rare, each in groups_of(batches, book.code, GROUP_BYTES):
            columns, n = distinct(trigrams(book, code, each), np.ones(len(code), np.int64))
            for part, at in by_part(places.of(columns[1], columns[0], rare)):
                listed, mine = book.sealed([c[at] for c in columns], rare)
                s2, s1, s3 = put_rows(mine)
                yield as_batch({"part": [part], "kind": [0], "rare": [listed], "s2": [s2], "s1": [s1], "s3": [s3], "n": [put(n[at])]}, CELL)

    def pairs(batches):
        for _, code, rare, each in groups_of(batches, book.code, GROUP_BYTES):
            s2, _, s3 = trigrams(book, code, each)
            at = places.wide(s2) > 1
            (s2, s3), n = distinct([s2[at], s3[at]], np.ones(int(at.sum()), np.int64))
            words = np.concatenate([book.words, rare]).view(np.int64)
            yield as_batch({"x": words[s2], "y": words[s3], "c": n}, pa.schema([("x", pa.int64()), ("y", pa.int64()), ("c", pa.int64())]))

    def copies(batches):
        for batch in batches:
            x, rare = book.code(np.concatenate([batch.column(c).to_numpy() for c in ("x", "y")]).view(np.uint64))
            (s2, s3), n = distinct([x[: len(batch)], x[len(batch) :]], batch.column("c").to_numpy())
            wide = places.wide(s2).astype(np.int64)
            row = np.repeat(np.arange(len(s2)), wide)
            step = np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)
            home = (book.words[s2] % np.uint64(places.parts)).astype(np.int64)
            for part, at in by_part((home[row] + step) % places.parts):
                listed, mine = book.sealed([s2[row[at]], s3[row[at]]], rare)
                y2, y3 = put_rows(mine)
                yield as_batch({"part": [part], "kind": [1], "rare": [listed], "s2": [y2], "s1": [None], "s3": [y3], "n": [put(n[row[at]])]}, CELL)

    def gathered(group: pa.RecordBatch, kind: int, names: list[str], common: list[np.ndarray]):
        columns, n = [[] for _ in names], [np.zeros(0, np.int64)]
        for r, codes in zip(group.to_pylist(), common):
            if r["kind"] == kind:
                for out, c in zip(columns, got_rows([r[x] for x in names])):
                    out.append(book.renumbered(c, codes))
                n.append(got(r["n"]).astype(np.int64))
        return distinct([np.concatenate([np.zeros(0, np.uint32), *c]) for c in columns], np.concatenate(n))

    def add(batches):
        for group in each_of(batches, "part"):
            part = group.column("part")[0].as_py()
            rare, common = book.opened(group.column("rare").to_pylist())
            three, n = gathered(group, 0, ["s2", "s1", "s3"], common)
            alone = places.wide(three[0]) == 1
            two, m = distinct([three[0][alone], three[2][alone]], n[alone])
            more, more_m = gathered(group, 1, ["s2", "s3"], common)
            two, m = distinct([np.concatenate([x, y]) for x, y in zip(two, more)], np.concatenate([m, more_m]))
            numbers = lambda c: np.bincount(c[c <= GT_MAX + 1], minlength=GT_MAX + 2)[1:]
            mine = np.concatenate([book.words, rare])[two[0]] % np.uint64(places.parts) == part
            s2, s1, s3 = put_rows(three)
            t2, t3 = put_rows(two)
            listed = put(np.diff(rare, prepend=np.uint64(0)))
            yield as_batch({"part": [part], "rare": [listed], "s2": [s2], "s1": [s1], "s3": [s3], "n": [put(n)], "t2": [t2], "t3": [t3], "m": [put(m)], "n2": [numbers(m[mine])], "n3": [numbers(n)]}, BLOCK)

    sent = map_batches(rows, cells, spark_schema(CELL))
    if heavy:
        each = map_batches(rows, pairs, "x long, y long, c long").groupBy("x", "y").agg(F.sum("c").alias("c"))
        sent = sent.unionByName(map_batches(each, copies, spark_schema(CELL)))
    made_ = map_batches(sent.repartition("part").sortWithinPartitions("part"), add, spark_schema(BLOCK))
    spark, name = rows.sparkSession, f"docloom_blocks_{uuid.uuid4().hex}"
    made_.write.bucketBy(places.parts, "part").option("path", f"{shared_dir(spark)}/docloom/{name}").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of a table with a path of its own, the files stay
    return blocks


class Block:
    """A part's tables of the two highest orders, of a model with the discounts d2 and d3: log-probabilities of its bigrams and trigrams, log-weights of its trigrams' contexts."""

    def __init__(self, r: dict, places: Places, d2: list[float], d3: list[float]):
        book = places.book
        self.rare, _ = book.opened([r["rare"]])
        self.words = np.concatenate([book.words, self.rare])
        self.s2, self.s1, self.s3 = got_rows([r["s2"], r["s1"], r["s3"]])
        self.t2, self.t3 = got_rows([r["t2"], r["t3"]])
        at2, of2, self.mass2, self.base2, self.p2 = kept(changes(self.t2), got(r["m"]), d2)
        at3, of3, mass, base, p3 = kept(changes(self.s2, self.s1), got(r["n"]), d3)
        self.at2, self.at3, self.v2, self.v3 = at2, at3, np.log(self.p2), np.log(p3)
        self.two = self.t2.astype(np.uint64) << np.uint64(32) | self.t3
        self.context = self.s2[at3].astype(np.uint64) << np.uint64(32) | self.s1[at3]
        self.three = of3.astype(np.uint64) << np.uint64(32) | self.s3
        below = self.p2[np.searchsorted(self.two, self.s2.astype(np.uint64) << np.uint64(32) | self.s3)]
        left = 1 - np.bincount(of3, below, len(at3)) if len(at3) else np.zeros(0)
        self.alpha = np.log((1 - mass / base) / left)
        self.mine = self.words[self.t2] % np.uint64(places.parts) == r["part"]

    def find(self, s2: np.ndarray, s1: np.ndarray, s3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of trigrams by this block's codes (2**32 - 1: a word that it hasn't): that of the trigram, else its context's weight and the bigram's; and which have no bigram, whose value is the weight alone."""
        value, missed = np.zeros(len(s2)), np.zeros(len(s2), bool)
        if not len(self.context):
            return value, ~missed
        context = s2.astype(np.uint64) << np.uint64(32) | s1
        h = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        seen = self.context[h] == context
        key = np.where(seen, h, len(self.context)).astype(np.uint64) << np.uint64(32) | s3
        at = np.minimum(np.searchsorted(self.three, key), len(self.three) - 1)
        there = self.three[at] == key
        value[there] = self.v3[at[there]]
        rest = np.flatnonzero(~there)
        if len(rest):
            value[rest] = np.where(seen[rest], self.alpha[h[rest]], 0.0)
            two = s2[rest].astype(np.uint64) << np.uint64(32) | s3[rest]
            at = np.minimum(np.searchsorted(self.two, two), len(self.two) - 1)
            there = self.two[at] == two
            value[rest[there]] += self.v2[at[there]]
            missed[rest[~there]] = True
        return value, missed


def kept(first: np.ndarray, c: np.ndarray, d: list[float]):
    """Of counts, of which some are the first of a context: these, the context of each, contexts' masses and bases, and the probabilities."""
    c = c.astype(np.int64)
    factor = np.append(1.0, d)[np.where(c < len(d) + 1, c, 0)]
    at, of = np.flatnonzero(first), np.cumsum(first) - 1
    if not len(at):
        return at, of, np.zeros(0), np.zeros(0), np.zeros(0)
    total, mass = np.add.reduceat(c, at), np.add.reduceat(factor * c, at)
    base = total + (mass >= total)
    return at, of, mass, base, factor * c / base[of]


class Model(tuple):
    """(kinds, tables) of train, with the blocks that hold the tables of the two highest orders."""

    blocks: DataFrame
    places: Places
    d: list[list[float]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GT_MAX) -> Model:
    """The number of kinds of tokens, and for each order from 1 the tables (g, logp) and (ctx, logalpha).

    Rows without id or text don't count; repeated rows count each. An empty table leaves the uniform distribution over the unknown token and the end mark. Other columns are ignored.
    """
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL")
    words = unigrams(rows)
    one = words.agg(F.count("*").alias("kinds"), F.sum("c").alias("total"), *[F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, k + 2)]).first()
    kinds, total = max(1, one["kinds"]) + 1, one["total"] or 0
    d = [discounts(list(one[2:]))]
    off = lambda c, d: F.element_at(F.array(*map(F.lit, [*d, 1.0])), F.least(c, F.lit(k + 1)).cast("int"))
    mass = words.agg(F.sum(off(F.col("c"), d[0]) * F.col("c")).alias("mass")).first()["mass"] or 0.0
    base = total + (mass >= total)
    p1 = off(F.col("c"), d[0]) * F.col("c") / F.lit(float(base))
    common = words.orderBy(F.desc("c"), "w").limit(BOOK).toArrow()
    top, counts = common.column("w").to_numpy().view(np.uint64), common.column("c").to_numpy()
    top, counts = np.append(top, BEGIN), np.append(counts, 0)
    places = Places(Book(top), counts, total)
    q = np.append(1.0, d[0])[np.where(counts <= k, counts, 0)] * counts / base
    blocks = counted(rows, places)
    numbers = blocks.agg(*[F.sum(F.col(n)[r]).alias(f"{n}_{r}") for n in ("n2", "n3") for r in range(k + 1)]).first()
    d += [discounts([x or 0 for x in numbers[: k + 1]]), discounts([x or 0 for x in numbers[k + 1 :]])]
    d2, d3 = d[1:]

    def view(fn, schema: str) -> DataFrame:
        kinds_ = {"long": pa.int64(), "double": pa.float64()}
        arrow = pa.schema([(c, kinds_[t]) for c, t in (x.split() for x in schema.split(", "))])

        def run(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    yield from (as_batch(out, arrow) for out in fn(Block(r, places, d2, d3)))

        return map_batches(blocks.drop("n2", "n3"), run, schema)

    def bigrams(b: Block):
        yield {"s2": b.words[b.t2[b.mine]].view(np.int64), "s3": b.words[b.t3[b.mine]].view(np.int64), "v": b.v2[b.mine]}

    def all_trigrams(b: Block):
        yield {"s1": b.words[b.s1].view(np.int64), "s2": b.words[b.s2].view(np.int64), "s3": b.words[b.s3].view(np.int64), "v": b.v3}

    def weights(b: Block):
        yield {"s1": b.words[b.s1[b.at3]].view(np.int64), "s2": b.words[b.s2[b.at3]].view(np.int64), "v": b.alpha}

    def lower(b: Block):
        """Of each middle word: what its bigrams leave, and their single tokens' probabilities, of the common ones summed up, of others as rows to join."""
        mine = b.mine[b.at2]
        known = b.t3 < places.book.n
        below = np.bincount(np.cumsum(changes(b.t2)) - 1, np.where(known, q[np.minimum(b.t3, places.book.n - 1)], 0), len(b.at2)) if len(b.at2) else np.zeros(0)
        ctx = b.words[b.t2].view(np.int64)
        n = int(mine.sum())
        yield {"ctx": ctx[b.at2][mine], "w": pa.nulls(n, pa.int64()), "q": below[mine], "rest": (1 - b.mass2 / b.base2)[mine]}
        some = b.mine & ~known
        n = int(some.sum())
        yield {"ctx": ctx[some], "w": b.words[b.t3[some]].view(np.int64), "q": pa.nulls(n, pa.float64()), "rest": pa.nulls(n, pa.float64())}

    parts = stored(view(lower, "ctx long, w long, q double, rest double"), "lower")
    rare = parts.where("w IS NOT NULL").select("ctx", "w").join(words.select("w", p1.alias("q")), "w").select("ctx", "q", F.lit(None).cast("double").alias("rest"))
    at = parts.where("w IS NULL").select("ctx", "q", "rest").unionByName(rare).groupBy("ctx").agg(F.sum("q").alias("below"), F.max("rest").alias("rest"))
    contexts2 = in_partitions(at.select(F.xxhash64("ctx").alias("ctx"), F.log(F.col("rest") / (1 - F.col("below"))).alias("v")), "ctx", "contexts2", one["kinds"])
    dropped(parts)
    grams1 = in_partitions(words.select(F.xxhash64("w").alias("g"), F.log(p1).alias("v")), "g", "grams1", one["kinds"])
    spark = docs.sparkSession
    alpha = [(0, float(np.log((1 - mass / base) / (1 - one["kinds"] / kinds))))] if total else []
    contexts1 = spark.createDataFrame(alpha, "ctx long, v double")
    dropped(words)
    grams2 = view(bigrams, "s2 long, s3 long, v double").select(F.xxhash64("s2", "s3").alias("g"), "v")
    grams3 = view(all_trigrams, "s1 long, s2 long, s3 long, v double").select(F.xxhash64("s1", "s2", "s3").alias("g"), "v")
    contexts3 = view(weights, "s1 long, s2 long, v double").select(F.xxhash64("s1", "s2").alias("ctx"), "v")
    model = Model((kinds, [(grams1, contexts1), (grams2, contexts2), (grams3, contexts3)]))
    model.blocks, model.places, model.d = blocks, places, d
    cleaned(spark)
    return model


def cleaned(spark) -> None:
    """Lets Spark delete the shuffle files of what nothing refers to any more, which it does in the background when its driver collects garbage; Python's own references go first, a moment later."""
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()
        time.sleep(0.3)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words and the end mark), logprob (natural, of the whole document), bits_per_token, perplexity.

    Null text: no row. Empty or blank text: the end mark alone. Null ids are left out; repeated rows are scored each. Very long texts are
    scored whole. Other columns are ignored; an empty table gives no rows.
    """
    kinds, tables = model
    places, (_, d2, d3) = model.places, model.d
    book = places.book
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL")

    def ask(batches):
        """Cells: of a group of documents (told by task and number), the trigrams that belong to one part, by document."""
        task, number = TaskContext.get().partitionId(), 0
        for ids, code, rare, each in groups_of(batches, book.code, GROUP_BYTES):
            columns = trigrams(book, code, each)
            doc, first = np.repeat(np.arange(len(ids)), each), True
            for part, at in by_part(places.of(columns[1], columns[0], rare)):
                listed, (s2, s1, s3) = book.sealed([c[at] for c in columns], rare)
                of = np.flatnonzero(changes(doc[at]))
                row = {"part": part, "batch": task << 32 | number, "docs": len(ids), "ids": squeezed(ids, np.int64) if first else None, "rare": listed, "s2": put(s2), "s1": put(s1), "s3": put(s3)}
                row |= {"doc": put(np.diff(doc[at][of], prepend=0)), "n": put(np.diff(np.append(of, len(at))))}
                yield as_batch({c: [v] for c, v in row.items()}, ASKED)
                first = False
            number += 1

    def look(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        """The values of the cells' trigrams, in their order, by the part's block."""
        block = Block(blocks.to_pylist()[0], places, d2, d3) if len(blocks) else None
        out = []
        for r in asked.to_pylist():
            hashes = np.cumsum(got(r["rare"]))
            s2, s1, s3 = (got(r[c]).astype(np.uint32) for c in ("s2", "s1", "s3"))
            value, missed = np.zeros(len(s2)), np.ones(len(s2), bool)
            if block:
                at = np.minimum(np.searchsorted(block.rare, hashes), max(0, len(block.rare) - 1))
                there = block.rare[at] == hashes if len(block.rare) else np.zeros(len(hashes), bool)
                codes = np.where(there, book.n + at, (1 << 32) - 1).astype(np.uint32)
                value, missed = block.find(*(book.renumbered(c, codes) for c in (s2, s1, s3)))
            doc = np.repeat(np.cumsum(got(r["doc"])), got(r["n"]).astype(np.int64))
            values, where = np.unique(value, return_inverse=True)
            row = {c: r[c] for c in ("batch", "docs", "ids", "doc", "n")} | {"values": squeezed(values, np.float64), "at": put(where), "missed": int(missed.sum())}
            own = np.concatenate([book.words, hashes]) if missed.any() else hashes
            row |= {"miss": put(doc[missed]), "m2": put(own[s2[missed]]), "m3": put(own[s3[missed]])}
            out.append(as_batch({c: [v] for c, v in row.items()}, TOLD))
        return pa.Table.from_batches(out, TOLD)

    asked = map_batches(rows, ask, spark_schema(ASKED))
    cleaned(docs.sparkSession)
    told = stored(asked.groupBy("part").cogroup(model.blocks.drop("n2", "n3").groupBy("part")).applyInArrow(look, spark_schema(TOLD)), "told")
    cleaned(docs.sparkSession)
    answer = pa.schema([("batch", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("logprob", pa.float64())])

    def finish(batches):
        for group in each_of(batches, "batch"):
            ids, n, total = None, 0, 0.0
            for r in group.to_pylist():
                docs_, doc, each = r["docs"], np.cumsum(got(r["doc"])).astype(np.int64), got(r["n"]).astype(np.int64)
                ids = loosened(r["ids"], docs_, np.int64) if r["ids"] is not None else ids
                at = got(r["at"]).astype(np.int64)
                values = loosened(r["values"], int(at.max()) + 1, np.float64)
                n = n + np.bincount(doc, each, docs_)
                total = total + np.bincount(np.repeat(doc, each), values[at], docs_)
            yield as_batch({"batch": np.full(len(ids), group.column("batch")[0].as_py()), "doc": np.arange(len(ids)), "doc_id": ids, "n_tokens": n.astype(np.int64), "logprob": total}, answer)

    done = map_batches(told.drop("missed", "miss", "m2", "m3").repartition("batch").sortWithinPartitions("batch"), finish, spark_schema(answer))
    if told.agg(F.sum("missed").alias("n")).first()["n"]:
        lost = pa.schema([("batch", pa.int64()), ("doc", pa.int64()), ("s2", pa.int64()), ("s3", pa.int64())])

        def unseen(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    doc = got(r["miss"]).view(np.int64)
                    yield as_batch({"batch": np.full(len(doc), r["batch"]), "doc": doc, "s2": got(r["m2"]).view(np.int64), "s3": got(r["m3"]).view(np.int64)}, lost)

        (grams1, contexts1), (_, contexts2) = tables[0], tables[1]
        alpha = next((r["v"] for r in contexts1.collect()), 0.0)
        rest = map_batches(told.where("missed > 0").select("batch", "miss", "m2", "m3"), unseen, spark_schema(lost))
        rest = rest.withColumns({"ctx": F.xxhash64("s2"), "g": F.xxhash64("s3")}).join(contexts2.select("ctx", F.col("v").alias("weight")), "ctx", "left").join(grams1, "g", "left")
        value = F.coalesce("weight", F.lit(0.0)) + F.coalesce("v", F.lit(alpha - float(np.log(kinds))))
        done = done.join(rest.groupBy("batch", "doc").agg(F.sum(value).alias("more")), ["batch", "doc"], "left").withColumn("logprob", F.col("logprob") + F.coalesce("more", F.lit(0.0)))
    return per_token(done.select("doc_id", "n_tokens", "logprob"))


def per_token(found: DataFrame) -> DataFrame:
    nats = -F.col("logprob") / F.col("n_tokens")
    return found.withColumn("bits_per_token", nats / F.lit(float(np.log(2)))).withColumn("perplexity", F.exp(nats))


def sums(context: np.ndarray, word: np.ndarray, doc: np.ndarray, docs: int, named: int, k: int = GT_MAX):
    """Of all tokens of some contexts, by document: the tokens seen r times (rows 1..k; row 0: all tokens), the sum of log c - log c(h), and
    the sums of log c(h) - log(c(h) + 1) of those contexts of which no count is in ``named``, by the bits of their counts up to k; and the numbers of n-grams seen 1..k+1 times."""
    order = np.lexsort((word, context))
    context, word, doc = context[order], word[order], doc[order]
    first = np.ones(len(order), bool)
    first[1:] = context[1:] != context[:-1]
    other = first.copy()
    other[1:] |= word[1:] != word[:-1]
    gram_ = np.cumsum(other) - 1
    c = np.bincount(gram_)
    at = np.flatnonzero(first)
    total = np.diff(np.append(at, len(order)))
    low = np.where(c <= k, c, 0)
    bits = np.bitwise_or.reduceat(np.where(low > 0, 1 << np.maximum(low - 1, 0), 0), gram_[at])
    of = low[gram_]
    n = np.stack([np.bincount(doc, minlength=docs), *[np.bincount(doc[of == r], minlength=docs) for r in range(1, k + 1)]])
    a = np.bincount(doc, np.log(c)[gram_] - np.repeat(np.log(total), total), docs)
    rest = np.repeat((bits & named) == 0, total)
    key, where = np.unique(doc[rest] * (1 << k) + np.repeat(bits, total)[rest], return_inverse=True)
    b = np.bincount(where, np.repeat(-np.log1p(1 / total), total)[rest], len(key))
    return n, a, key // (1 << k), key % (1 << k), b, np.bincount(c[c <= k + 1], minlength=k + 2)[1:]


def squeezed(values: np.ndarray, kind) -> bytes:
    return pa.compress(np.ascontiguousarray(values, kind).tobytes(), "zstd", asbytes=True)


def loosened(data: bytes, n: int, kind) -> np.ndarray:
    t = np.dtype(kind)
    return np.frombuffer(pa.decompress(data, n * t.itemsize, "zstd", asbytes=True), t)


def planes(rising: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: their differences byte by byte, so that the high bytes, which hardly vary, pack."""
    steps = np.diff(rising, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return squeezed(steps.T, np.uint8)


def unplaned(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(loosened(data, 8 * n, np.uint8).reshape(8, n).T).view(np.uint64).ravel())


def width(kinds: int):
    return np.uint16 if kinds <= 1 << 16 else np.uint32


def own_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, k: int = GT_MAX) -> DataFrame:
    """score() of docs by the model that train() makes of them, with the same columns and rules."""
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(1)).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // PART_BYTES))

    def pack(batches):
        """Cells: of a group of documents (told by task and number), the tokens whose contexts belong to one part, by document."""
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids = batch.column("id").to_numpy()
            for i, j in runs(offsets, GROUP_BYTES):
                some, base = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                contexts, words, each = [], [], []
                for x, y in runs(base, RUN_BYTES):
                    symbols, n = sequences(some[base[x] : base[y]], base[x : y + 1] - base[x], order)
                    contexts.append(gram(symbols[:-1], len(symbols[0])).view(np.uint64))
                    words.append(symbols[-1])
                    each.append(n)
                context, word = np.concatenate(contexts), np.concatenate(words)
                del contexts, words, symbols
                doc = np.repeat(np.arange(j - i, dtype=np.int32), np.concatenate(each))
                part = (context % np.uint64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[by], np.arange(parts + 1))
                out = {c: [] for c in cell.names}
                for p in np.flatnonzero(np.diff(bounds)):
                    m = by[bounds[p] : bounds[p + 1]]
                    row = [int(p), task << 32 | number, j - i, squeezed(ids[i:j], np.int64) if not out["part"] else None, squeezed(np.bincount(doc[m], minlength=j - i), np.uint32)]
                    for values in (context, word):
                        kinds, at = np.unique(values[m], return_inverse=True)
                        row += [len(kinds), planes(kinds), squeezed(at, width(len(kinds)))]
                    for c, v in zip(out, row):
                        out[c].append(v)
                number += 1
                yield as_batch(out, cell)

    packed = [(name + x, kind) for name in ("context", "word") for x, kind in (("_kinds", "int"), ("s", "binary"), ("", "binary"))]
    cell = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("docs", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), *[(c, pa.int32() if kind == "int" else pa.binary()) for c, kind in packed]])
    sent = map_batches(rows.select("id", "text"), pack, "part int, batch long, docs int, ids binary, n binary, " + ", ".join(f"{c} {kind}" for c, kind in packed))
    sent = sent.repartition(parts, "part").sortWithinPartitions("part")
    back = pa.schema([("batch", pa.int64()), ("docs", pa.int32()), ("ids", pa.binary()), ("n", pa.binary()), ("a", pa.binary()), ("extra", pa.int32()), ("doc", pa.binary()), ("bits", pa.binary()), ("b", pa.binary()), ("numbers", pa.list_(pa.int64()))])
    fields = "batch long, docs int, ids binary, n binary, a binary, extra int, doc binary, bits binary, b binary, numbers array<long>"

    def summed(named: int) -> tuple[DataFrame, list[float]]:
        def add(batches):
            for group in key_groups(batches, "part"):
                contexts, words, doc, base = [], [], [], 0
                got = group.to_pylist()
                for r in got:
                    n = loosened(r["n"], r["docs"], np.uint32)
                    for values, name in ((contexts, "context"), (words, "word")):
                        kinds = r[f"{name}_kinds"]
                        values.append(unplaned(r[f"{name}s"], kinds)[loosened(r[name], int(n.sum()), width(kinds))])
                    doc.append(np.repeat(np.arange(base, base + r["docs"]), n))
                    base += r["docs"]
                n, a, at, bits, b, numbers = sums(np.concatenate(contexts), np.concatenate(words), np.concatenate(doc), base, named, k)
                base = 0
                for r in got:
                    mine, edges = slice(base, base + r["docs"]), np.searchsorted(at, [base, base + r["docs"]])
                    x = slice(*edges)
                    row = {"batch": r["batch"], "docs": r["docs"], "ids": r["ids"], "n": squeezed(n[:, mine], np.uint32), "a": squeezed(a[mine], np.float64), "extra": int(edges[1] - edges[0])}
                    row |= {"doc": squeezed(at[x] - base, np.int32), "bits": squeezed(bits[x], np.int32), "b": squeezed(b[x], np.float64), "numbers": None if base else numbers}
                    yield as_batch({c: [v] for c, v in row.items()}, back)
                    base += r["docs"]

        table = stored(map_batches(sent, add, fields), "sums")
        numbers = table.where("numbers IS NOT NULL").agg(*[F.sum(F.col("numbers")[r]) for r in range(k + 1)]).first()
        return table, discounts([x or 0 for x in numbers])

    table, d = summed(1)
    if d[0] == 1:
        table, d = summed(0)
    discounted = sum(1 << r for r in range(k) if d[r] < 1)
    answer = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("logprob", pa.float64())])

    def finish(batches):
        for group in key_groups(batches, "batch"):
            key = group.column("batch").to_numpy()
            cuts = np.append(np.flatnonzero(np.r_[True, np.diff(key) != 0]), len(key))
            for i, j in zip(cuts[:-1], cuts[1:]):
                ids, n, total = None, 0, 0.0
                for r in group.slice(i, j - i).to_pylist():
                    docs_ = r["docs"]
                    ids = loosened(r["ids"], docs_, np.int64) if r["ids"] is not None else ids
                    n = n + loosened(r["n"], (k + 1) * docs_, np.uint32).reshape(k + 1, docs_).astype(np.int64)
                    total = total + loosened(r["a"], docs_, np.float64)
                    undiscounted = (loosened(r["bits"], r["extra"], np.int32) & discounted) == 0
                    total += np.bincount(loosened(r["doc"], r["extra"], np.int32)[undiscounted], loosened(r["b"], r["extra"], np.float64)[undiscounted], docs_)
                yield as_batch({"doc_id": ids, "n_tokens": n[0], "logprob": total + np.log(d) @ n[1:]}, answer)

    done = map_batches(table.drop("numbers").repartition("batch").sortWithinPartitions("batch"), finish, "doc_id long, n_tokens long, logprob double")
    return per_token(done)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document by the back-off model of them all; logprob to 3 places, bits_per_token to 6, perplexity to 4."""
    from .common import table

    places = {"logprob": 3, "bits_per_token": 6, "perplexity": 4}
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs)).withColumns({c: F.round(c, n) for c, n in places.items()})


def _sql() -> str:
    """The definition for trigrams: discounts from the numbers of trigrams, contexts' totals, and no trigram that isn't there."""
    last = f"({GT_MAX + 1} * n[{GT_MAX + 1}] / n[1]::DOUBLE)"
    ratio = f"(({{r}} + 1) * n[{{r}} + 1] / ({{r}} * n[{{r}}])::DOUBLE - {last}) / (1 - {last})"
    given = f"n[1] > 0 AND n[{{r}}] > 0 AND n[{{r}} + 1] > 0 AND n[1] <> {GT_MAX + 1} * n[{GT_MAX + 1}]"
    d = ", ".join(f"CASE WHEN {given.format(r=r)} AND {ratio.format(r=r)} > 0 AND {ratio.format(r=r)} < 1 THEN {ratio.format(r=r)} ELSE 1 END" for r in range(1, GT_MAX + 1))
    numbers = ", ".join(f"count(*) FILTER (c = {r})" for r in range(1, GT_MAX + 2))
    return f"""
WITH t AS (SELECT doc_id, list_concat(['b', 'b'], list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> ''), lambda x: 'w' || x), ['e']) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t),
g AS (SELECT doc_id, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM i),
c AS (SELECT x, y, z, count(*) AS c FROM g GROUP BY x, y, z),
n AS (SELECT [{numbers}] AS n FROM c),
d AS (SELECT [{d}] AS d FROM n),
k AS (SELECT x, y, z, c, c * CASE WHEN c <= {GT_MAX} THEN d[c] ELSE 1 END AS kept FROM c, d),
h AS (SELECT x, y, sum(c) AS total, sum(kept) AS mass FROM k GROUP BY x, y),
p AS (SELECT k.x, k.y, k.z, ln(kept / (total + CASE WHEN mass >= total THEN 1 ELSE 0 END)) AS v FROM k JOIN h ON k.x = h.x AND k.y = h.y),
s AS (SELECT doc_id, count(*) AS n_tokens, sum(v) AS logprob FROM g JOIN p ON g.x = p.x AND g.y = p.y AND g.z = p.z GROUP BY doc_id)
SELECT doc_id, n_tokens, round(logprob, 3) AS logprob, round(-logprob / n_tokens / ln(2), 6) AS bits_per_token, round(exp(-logprob / n_tokens), 4) AS perplexity FROM s
"""


SQL = _sql()
