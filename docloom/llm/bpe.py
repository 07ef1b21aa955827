"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library encodes. A pre-token never spans the border between a visible character and the blank after it,
so a text is split there into chunks, every distinct chunk of a batch is encoded once, and the chunks' ids are laid out by
document again: the ids are those of the whole text. Chunks seen before are kept by hash in a bounded table of the worker.

Decoding reverses the byte table: each token's characters stand for bytes, the bytes are joined, and only then read as
UTF-8, so a character split between tokens is whole again. Character offsets come from the byte lengths of the tokens and
the positions of the bytes that begin a character: a token covers the characters of which it holds a byte.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .textkernel import SPACE, prefix, runs, spans, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
KNOWN_CHUNKS = 1 << 19
BATCH_BYTES = 1 << 20

CLOSED = np.zeros(256, bool)
CLOSED[33:127] = True


def byte_table() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable Latin-1 characters are themselves, other bytes follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


class Codec:
    def __init__(self, path: str = VOCABULARY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        table = byte_table()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
        size = max([*model["model"]["vocab"].values(), *special]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["model"]["vocab"].items():
            self.bytes[i] = special.get(i) or bytes(table[c] for c in token)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def chunks(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which a chunk begins: each text, and each blank after a visible character (ASCII, or Latin and
        other two-byte letters, none of which is white space)."""
        begin = np.zeros(len(raw) + 1, bool)
        begin[offsets] = True
        if len(raw) > 2:
            closed = CLOSED[raw]
            closed[1:] |= (raw[1:] >= 128) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
            begin[1:-1] |= SPACE[raw[1:]] & closed[:-1]
        return np.flatnonzero(begin[:-1])

    def look_up(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of each chunk in the worker's table, after encoding those that are new."""
        hashes, first, inverse = np.unique(spans(prefix(raw), start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > KNOWN_CHUNKS:
            self.forget()
        at = np.searchsorted(self.keys, hashes)
        new = (at == len(self.keys)) | (self.keys[np.minimum(at, max(0, len(self.keys) - 1))] != hashes) if len(self.keys) else np.ones(len(hashes), bool)
        if new.any():
            data = raw.tobytes()
            texts = [data[s:e].decode() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            base = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.int32, int(count.sum()))])
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.first = np.concatenate([self.first, base])[order]
            self.count = np.concatenate([self.count, count])[order]
            at = np.searchsorted(self.keys, hashes)
        return at[inverse]

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids end to end and their bounds per document."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = self.chunks(raw, offsets)
        end = np.append(start[1:], len(raw))
        row = self.look_up(raw, start, end)
        count = self.count[row]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[row] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes end to end and their bounds per document."""
        size = self.length[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.start[ids] - upto[:-1], size) + np.arange(upto[-1])], upto[bounds]

    def char_offsets(self, ids: np.ndarray, bounds: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token, counted within its document."""
        upto = np.concatenate([[0], np.cumsum(self.length[ids])])
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        begin, end = np.minimum(upto[:-1], len(raw)), np.minimum(upto[1:], len(raw))
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        base = starts[offsets[:-1]][doc]
        inside = np.zeros(len(raw) + 1, np.int64)
        inside[:-1] = (raw & 0xC0) == 0x80
        return starts[begin] - inside[begin] - base, starts[end] - base


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, starts, ends (character offsets of each token), exact (decoding gives the text's bytes back).

    Null text: null n_tokens, ids, starts and ends, exact is true. Empty text: empty lists. Null ids and repeated rows are
    kept, one row out for one in. Strings of special tokens in a text are ordinary text. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))

    def run(batch: pa.RecordBatch):
        c = codec(vocabulary)
        texts = batch.column("__text")
        raw, offsets = utf8(texts)
        for i, j in runs(offsets, BATCH_BYTES):
            part, base = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            ids, bounds = c.encode(part, base)
            back, ends = c.decode(ids, bounds)
            if not (np.array_equal(back, part) and np.array_equal(ends, base)):
                ids, bounds = direct(c, texts.slice(i, j - i))
                back, ends = c.decode(ids, bounds)
            exact = np.array([ends[k + 1] - ends[k] == base[k + 1] - base[k] and np.array_equal(back[ends[k] : ends[k + 1]], part[base[k] : base[k + 1]]) for k in range(j - i)], bool)
            first, last = c.char_offsets(ids, bounds, part, base)
            null = texts.slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
            mask = pa.array(null)
            columns = {"ids": ids, "starts": first, "ends": last}
            n = np.diff(bounds)
            yield {
                "doc_id": batch.column("doc_id").slice(i, j - i), "n_tokens": pa.array(n, pa.int32(), mask=null), "exact": exact,
                **{k: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32()), mask=mask) for k, v in columns.items()},
            }

    return arrow_map(rows, run, "doc_id long, n_tokens int, ids array<int>, starts array<int>, ends array<int>, exact boolean")


def direct(c: Codec, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text by itself: the fallback where two chunks of a batch have one hash."""
    found = [x.ids for x in c.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
    return np.array([i for x in found for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text. A null list gives a null text; bytes that aren't UTF-8 (a list cut inside a character) become U+FFFD; an id
    outside the vocabulary and a null in a list stand for no bytes. Null document ids and repeated rows are kept, one row out for one in; an empty
    table gives none; very long lists are decoded whole; other columns are ignored."""
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batch: pa.RecordBatch):
        c = codec(vocabulary)
        out = []
        for x in batch.column("__ids").to_pylist():
            out.append(None if x is None else b"".join(c.bytes[i] for i in x if i is not None and 0 <= i < len(c.bytes)).decode("utf-8", "replace"))
        yield {"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())}

    return arrow_map(rows, run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode(table(spark, sf_dir, "documents"))
