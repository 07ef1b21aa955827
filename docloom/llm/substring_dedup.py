"""Passages that recur across documents, by repeated-phrase automata.

A passage is a union of windows of ``PHRASE + WINDOW - 1`` = 51 consecutive words, each of which documents of two ids have.
Words are split at ASCII white space, however much of it. All such windows are found, in every document that has them, and nothing else:

1. Fingerprint: each window selects its least phrase of ``PHRASE`` words (by hash, the leftmost of equals). Equal windows select equal
   phrases, so a window recurs only if its phrase is selected in documents of two ids. Equal texts are read once, for all their ids.
2. Confirm and compile: the phrases selected in two ids, taken from the document with the least id (their owner), are sharded into
   Aho-Corasick automata (pyahocorasick) of bounded size; the phrases of an owner that has very many are spread over several shards.
3. Stream: every document that can hold one of a shard's phrases is read whole against its automaton, which locates all their occurrences.
4. Windows: those around located phrases are compared by 64-bit hashes over all documents. Each recurs if it is in two ids, and
   belongs to the least of them. A batch of documents sends every distinct window once, so a window that a third of all documents
   have reaches its task once for each batch. What is found returns to the batch, where windows that touch join into passages.

A popular shard is copied to several tasks, so its documents are spread. No count is capped.
"""

from __future__ import annotations

import os

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_batch, id_and_text, key_groups, map_batches, stored
from .textkernel import Words, powers, runs, spans, utf8

PHRASE = 32
WINDOW = 20
PHRASES_PER_SHARD = 4000
DOCS_PER_TASK = 4000
WINDOWS_PER_ROW = 1 << 17
WINDOWS_PER_PART = 1 << 20
PLACES = 28
ALONE = np.iinfo(np.int64).min

BLANKS = str.maketrans({c: " " for c in map(chr, (9, 10, 11, 12, 13))})


def sliding(values: np.ndarray, w: int, reduce) -> np.ndarray:
    """reduce over each of the len(values) - w + 1 windows."""
    span, out = 1, values
    while span * 2 <= w:
        out = reduce(out[:-span], out[span:])
        span *= 2
    return reduce(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


class Prints:
    """Phrases and windows of some documents laid end to end.

    ``value`` is the hash of the phrase that begins at each word, ``select`` the word at which each window's selected phrase begins;
    ``fits`` marks the windows that lie in one document.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, phrase: int = PHRASE, window: int = WINDOW):
        self.words, self.size = Words(raw, offsets), phrase + window - 1
        hashes = self.words.hashes(lower=False)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(len(hashes) + 1)[0][: len(hashes)])])
        self.doc = self.words.doc()
        n, windows = len(hashes) - phrase + 1, len(hashes) - self.size + 1
        if windows < 1:
            self.value, self.select, self.fits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
            return
        at = np.arange(n)
        value = spans(self.sums, at, at + phrase) >> np.uint64(1)
        key = (value >> np.uint64(PLACES - 1) << np.uint64(PLACES)) | at.astype(np.uint64)
        key[self.doc[:n] != self.doc[phrase - 1 :]] = np.uint64(2**64 - 1)
        self.value = value.astype(np.int64)
        self.select = (sliding(key, window, np.minimum) & np.uint64((1 << PLACES) - 1)).astype(np.int64)
        self.fits = self.doc[:windows] == self.doc[self.size - 1 :]

    def selected(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """document, hash and first word (in its document) of the selected phrases; equal ones of a document once, where the first is."""
        at = np.unique(self.select[self.fits])
        d, v = self.doc[at], self.value[at]
        order = np.lexsort((at, v, d))
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(d[order]) != 0) | (np.diff(v[order]) != 0)
        at = at[order[first]]
        return self.doc[at], self.value[at], at - self.words.first[self.doc[at]]

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at these words."""
        return spans(self.sums, starts, starts + self.size).astype(np.int64)


def split(text: str) -> list[str]:
    return [w for w in text.translate(BLANKS).split(" ") if w]


class Automaton:
    """Aho-Corasick automaton of one shard's phrases."""

    def __init__(self):
        self.machine, self.made = ahocorasick.Automaton(), False

    def add(self, phrase: str) -> None:
        self.machine.add_word(phrase, len(phrase))

    def found(self, words: list[str]) -> np.ndarray:
        """The words at which a phrase begins, rising."""
        if not self.made:
            self.machine.make_automaton()
            self.made = True
        if self.machine.kind != ahocorasick.AHOCORASICK:
            return np.zeros(0, np.int64)
        hits = [(last + 1 - size, last + 1) for last, size in self.machine.iter(" ".join(words))]
        if not hits:
            return np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        s, e = np.array(hits, np.int64).T
        at, to = np.searchsorted(starts, s), np.searchsorted(ends, e)
        whole = (at < len(starts)) & (to < len(ends))
        whole[whole] = (starts[at[whole]] == s[whole]) & (ends[to[whole]] == e[whole])
        return np.unique(at[whole])


def confirmed(rows: DataFrame, phrase: int, window: int) -> tuple[DataFrame, DataFrame]:
    """fp, tk, id, at of all selected phrases; and fp, owner, shard of those selected in two ids (stored)."""

    def select(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("text"))
        ids, texts = batch.column("id").to_numpy(), batch.column("tk").to_numpy()
        for i, j in runs(offsets):
            d, v, at = Prints(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], phrase, window).selected()
            yield {"fp": v, "tk": texts[i:j][d], "id": ids[i:j][d], "at": at}

    posts = arrow_map(rows, select, "fp long, tk long, id long, at int")
    twice = stored(posts.groupBy("fp").agg(F.min("id").alias("owner"), F.max("id").alias("b")).where("owner < b").select("fp", "owner"), "confirmed")
    shards = max(1, -(-twice.count() // PHRASES_PER_SHARD))
    pieces = twice.groupBy("owner").agg(F.ceil(F.count("*") / F.lit(PHRASES_PER_SHARD)).alias("pieces"))
    shard = F.pmod(F.xxhash64("owner", F.pmod("fp", F.col("pieces"))), F.lit(shards)).cast("int")
    return posts, twice.join(pieces, "owner").select("fp", "owner", shard.alias("shard"))


def located(rows: DataFrame, phrase: int, window: int) -> DataFrame:
    """Rows of up to WINDOWS_PER_ROW windows around located phrases: batch (unique), doc (tk), a and b (least and greatest id) and n
    (windows) of some documents, and of each window its hash h, first word w, and first and last character s and e, packed."""
    members = rows.groupBy("tk").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    posts, phrases = confirmed(rows, phrase, window)
    held = stored(posts.join(phrases, "fp").join(members, "tk").where("id = a").drop("a"), "phrases")
    load = held.groupBy("shard").agg(F.ceil(F.countDistinct("tk") / F.lit(DOCS_PER_TASK)).cast("int").alias("copies"))
    routes = held.groupBy("tk", "id", "shard").agg(F.max("b").alias("b")).join(load, "shard").groupBy("tk", "id").agg(F.max("b").alias("b"), F.collect_list(F.struct("shard", "copies")).alias("routes"))
    own = held.where("id = owner").join(load, "shard").groupBy("tk", "id").agg(F.collect_list(F.struct("shard", "copies", "at")).alias("own"))
    read = rows.join(routes.join(own, ["tk", "id"], "left"), ["tk", "id"])

    def expand(batch: pa.RecordBatch):
        names = ("shard", "part", "kind", "tk", "a", "b", "text")
        out, size = {k: [] for k in names}, 0

        def add(*row):
            for k, v in zip(names, row):
                out[k].append(v)

        for tk, a, b, text, routed, mine in zip(*(batch.column(k).to_pylist() for k in ("tk", "id", "b", "text", "routes", "own"))):
            for r in routed:
                add(r["shard"], tk % r["copies"], 1, tk, a, b, text)
                size += len(text)
            if mine:
                words = split(text)
                for x in mine:
                    pattern = " ".join(words[x["at"] : x["at"] + phrase])
                    for part in range(x["copies"]):
                        add(x["shard"], part, 0, tk, None, None, pattern)
                    size += x["copies"] * len(pattern)
            if size > 1 << 23:
                yield out
                out, size = {k: [] for k in names}, 0
        yield out

    work = arrow_map(read, expand, "shard int, part long, kind int, tk long, a long, b long, text string")
    work = work.repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    schema = pa.schema([("batch", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("doc", "a", "b", "n")], *[(c, pa.binary()) for c in ("h", "w", "s", "e")]])

    def locate(batches):
        now, machine = None, None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(shard)]):
                if (shard[i], part[i]) != now:
                    now, machine = (shard[i], part[i]), Automaton()
                first = i + int(np.searchsorted(kind[i:j], 1))
                for pattern in batch.column("text").slice(i, first - i).to_pylist():
                    machine.add(pattern)
                raw, offsets = utf8(batch.column("text").slice(first, j - first))
                for x, y in runs(offsets):
                    some = batch.slice(first + x, y - x)
                    yield from around(machine, some, raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])

    def around(machine, docs: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray):
        prints = Prints(raw, offsets, phrase, window)
        first, hit = prints.words.first, np.zeros(len(prints.value), bool)
        for d, text in enumerate(docs.column("text").to_pylist()):
            if first[d + 1] - first[d] >= prints.size:
                hit[first[d] + machine.found(split(text))] = True
        at = np.flatnonzero(prints.fits)
        at = at[hit[prints.select[at]]]
        if not len(at):
            return
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        doc = prints.doc[at]
        zero = chars[offsets[:-1]][doc]
        s, e = chars[prints.words.start[at]] - zero, chars[prints.words.end[at + prints.size - 1]] - zero
        h, w = prints.windows(at), at - first[doc]
        for i in range(0, len(at), WINDOWS_PER_ROW):
            m = slice(i, i + WINDOWS_PER_ROW)
            d, n = np.unique(doc[m], return_counts=True)
            keys = {"doc": docs.column("tk"), "a": docs.column("a"), "b": docs.column("b")}
            row = {k: [v.to_numpy()[d]] for k, v in keys.items()} | {"n": [n], "batch": [int.from_bytes(os.urandom(8), "little", signed=True)]}
            yield as_batch(row | {"h": [h[m].tobytes()], "w": [small(w[m])], "s": [small(s[m])], "e": [small(e[m])]}, schema)

    kinds = "batch long, doc array<long>, a array<long>, b array<long>, n array<long>, h binary, w binary, s binary, e binary"
    return stored(map_batches(work, locate, kinds), "located")


def small(values: np.ndarray) -> bytes:
    """Numbers that rise slowly, compressed."""
    return pa.compress(np.diff(values, prepend=0).astype(np.int32).tobytes(), "zstd", asbytes=True)


def large(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.int32).astype(np.int64))


def cells(row: dict, parts: int):
    """Distinct windows of a row in the order of part and hash: hash, part, least and greatest id, and the place of each of the row's windows."""
    h = np.frombuffer(row["h"], np.int64)
    a, b = (np.repeat(np.array(row[c], np.int64), row["n"]) for c in ("a", "b"))
    part = h % parts
    order = np.lexsort((h, part))
    first = np.ones(len(h), bool)
    first[1:] = np.diff(h[order]) != 0
    at = np.flatnonzero(first)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[order][at], part[order][at], np.minimum.reduceat(a[order], at), np.maximum.reduceat(b[order], at), place


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int64).tobytes(), "zstd", asbytes=True)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrase: int = PHRASE, window: int = WINDOW) -> DataFrame:
    """doc_id, first_doc, start, end (code points, end exclusive), n_words of every passage.

    Of each document, the windows of phrase + window - 1 words that a document of another id has too; those with one and the same
    least id that has them (first_doc, the document's own id in the first document) join where they overlap or touch.

    Null, empty and shorter texts have none. Repeated rows with one id count as one document: a window only in rows of one id doesn't
    recur, one that others have is located in each of its texts, given once for each. Any white space counts as one blank.
    Null ids are left out; an empty table gives no rows; other columns are ignored.
    """
    return _spans(docs, id_col, text_col, phrase, window).select("doc_id", "first_doc", "start", "end", "n_words")


def _spans(docs: DataFrame, id_col: str, text_col: str, phrase: int = PHRASE, window: int = WINDOW) -> DataFrame:
    """passages() with tk, the hash of the text that they are in."""
    rows = id_and_text(docs, id_col, text_col).where("text IS NOT NULL").withColumn("tk", F.xxhash64("text"))
    table, size = located(rows, phrase, window), phrase + window - 1
    total = table.agg(F.sum(F.octet_length("h"))).first()[0] or 0
    parts = max(1, -(-total // (8 * WINDOWS_PER_PART)))

    def send(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            h, part, a, b, _ = cells(row, parts)
            cuts = np.flatnonzero(np.diff(part)) + 1
            out = {k: [] for k in ("part", "batch", "h", "a", "b")}
            for i, j in zip([0, *cuts], [*cuts, len(h)]):
                for k, v in zip(out, (int(part[i]), row["batch"], h[i:j].tobytes(), squeezed(a[i:j]), squeezed(b[i:j]))):
                    out[k].append(v)
            yield out

    answer = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("first", pa.binary())])

    def decide(batches):
        for group in key_groups(batches, "part"):
            got = group.to_pylist()
            h = [np.frombuffer(r["h"], np.int64) for r in got]
            a, b = (np.concatenate([np.frombuffer(pa.decompress(r[c], 8 * len(x), "zstd", asbytes=True), np.int64) for r, x in zip(got, h)]) for c in ("a", "b"))
            _, kind = np.unique(np.concatenate(h), return_inverse=True)
            least, most = np.full(kind.max() + 1, np.iinfo(np.int64).max), np.full(kind.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(least, kind, a)
            np.maximum.at(most, kind, b)
            first = np.where(least < most, least, ALONE)[kind]
            bounds = np.cumsum([0, *map(len, h)])
            yield as_batch({"batch": [r["batch"] for r in got], "part": [r["part"] for r in got], "first": [squeezed(first[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]}, answer)

    sent = arrow_map(table.select("batch", "a", "b", "n", "h"), send, "part long, batch long, h binary, a binary, b binary")
    told = map_batches(sent.repartition("part").sortWithinPartitions("part"), decide, "batch long, part long, first binary")
    told = told.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "first"))).alias("told"))

    def join(batch: pa.RecordBatch):
        for row in batch.to_pylist():
            h, part, _, _, place = cells(row, parts)
            width = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(h)]]))
            first = np.concatenate([np.frombuffer(pa.decompress(x["first"], 8 * int(k), "zstd", asbytes=True), np.int64) for x, k in zip(row["told"], width)])[place]
            doc = np.repeat(np.arange(len(row["n"])), row["n"])
            w, s, e = (large(row[c], len(first)) for c in ("w", "s", "e"))
            keep = np.flatnonzero(first != ALONE)
            if len(keep):
                order = keep[np.lexsort((w[keep], first[keep], doc[keep]))]
                doc, first, w, s, e = doc[order], first[order], w[order], s[order], e[order]
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(doc) != 0) | (np.diff(first) != 0) | (np.diff(w) > size)
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(order)) - 1
                yield {"tk": np.array(row["doc"], np.int64)[doc[at]], "first_doc": first[at], "w": w[at], "to": w[last] + size, "start": s[at], "end": e[last]}

    parts_of = arrow_map(table.join(told, "batch"), join, "tk long, first_doc long, w long, to long, start int, end int")
    schema = pa.schema([("tk", pa.int64()), ("first_doc", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32())])

    def merge(batches):
        for group in key_groups(batches, "tk"):
            tk, first, w, to, start, end = (group.column(c).to_numpy() for c in ("tk", "first_doc", "w", "to", "start", "end"))
            new = np.ones(len(tk), bool)
            new[1:] = (np.diff(tk) != 0) | (np.diff(first) != 0)
            at = np.flatnonzero(new)
            level = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(tk)))) << 40
            reach = np.maximum.accumulate(to + level)
            new[1:] |= (w + level)[1:] > reach[:-1]
            at = np.flatnonzero(new)
            yield as_batch({"tk": tk[at], "first_doc": first[at], "start": start[at], "end": np.maximum.reduceat(end, at), "n_words": np.maximum.reduceat(to, at) - w[at]}, schema)

    merged = map_batches(parts_of.repartition("tk").sortWithinPartitions("tk", "first_doc", "w"), merge, "tk long, first_doc long, start int, end int, n_words int")
    return merged.join(rows.select("tk", F.col("id").alias("doc_id")).distinct(), "tk")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs without the passages that a document with a lower id has too; a document of which nothing but white space is left goes.

    The first document keeps its text. Untouched rows stay as they are (nulls, empty and blank texts and rows without id too); n_chars, if
    there, follows the new text. Of rows with one id each loses the passages of its own text; rows that are quite equal stay as many as they are.
    An empty table gives none; other columns are kept, whatever their names.
    """
    names = docs.columns
    hidden = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    spans_ = _spans(docs, id_col, text_col).where("first_doc < doc_id").groupBy("tk", "doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    on = (F.xxhash64(hidden[text]) == spans_["tk"]) & (hidden[key].cast("long") == spans_["doc_id"])
    both = hidden.join(spans_, on, "left").select(*hidden.columns, "cuts")
    fields = docs.schema

    def run(batches):
        for batch in batches:
            cuts = batch.column("cuts").to_pylist()
            hit = np.array([c is not None for c in cuts], bool)
            columns = {k: batch.column(i) for i, k in enumerate(names)}
            keep = np.ones(len(cuts), bool)
            if hit.any():
                texts = columns[text_col].to_pylist()
                for i in np.flatnonzero(hit):
                    texts[i] = without(texts[i], [(x["start"], x["end"]) for x in cuts[i]])
                    keep[i] = bool(texts[i].strip())
                kind = columns[text_col].type
                columns[text_col] = pa.array(texts, kind)
                if chars_col in columns:
                    new = pc.utf8_length(columns[text_col]).cast(columns[chars_col].type)
                    columns[chars_col] = pc.if_else(pa.array(hit), new, columns[chars_col])
            yield pa.RecordBatch.from_arrays([columns[k] for k in names], names=names).filter(pa.array(keep))

    return map_batches(both, run, fields)


def without(text: str, spans_: list[tuple[int, int]]) -> str:
    at, out = 0, []
    for s, e in sorted(spans_):
        out.append(text[at : max(at, s)])
        at = max(at, e)
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return passages(table(spark, sf_dir, "documents"))


_SPACE = "[ \\t\\n\\r\\f\\v]"
SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_SPACE}*[^ \\t\\n\\r\\f\\v]+') AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_transform(parts, lambda x: regexp_replace(x, '^{_SPACE}+', '')) AS ws, parts FROM t WHERE len(parts) >= {PHRASE + WINDOW - 1}),
u AS (SELECT doc_id, unnest(ws) AS w, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM p),
c AS (SELECT doc_id, i, w, sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM u),
v AS (SELECT doc_id, i, stop - length(w) AS start, lead(stop, {PHRASE + WINDOW - 2}) OVER (PARTITION BY doc_id ORDER BY i) AS stop, list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {PHRASE + WINDOW - 2} FOLLOWING) AS window_ FROM c),
h AS (SELECT window_, min(doc_id) AS first_doc FROM v WHERE stop IS NOT NULL GROUP BY window_ HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT v.doc_id, v.i, h.first_doc, v.start, v.stop FROM v JOIN h ON v.window_ = h.window_ WHERE v.stop IS NOT NULL),
g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, first_doc ORDER BY i) <= {PHRASE + WINDOW - 1} THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first_doc ORDER BY i) AS run FROM g)
SELECT doc_id, first_doc, min(start)::INT AS start, max(stop)::INT AS "end", (max(i) - min(i) + {PHRASE + WINDOW - 1})::INT AS n_words FROM r GROUP BY doc_id, first_doc, run
"""
