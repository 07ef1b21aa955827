"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW``; one pass runs forwards, one backwards, and a linear layer over both
states labels every byte with a language or ``und`` (no language). A document's probabilities are the means over all its
bytes; the state begins anew in each window. Training is backpropagation through time in numpy with Adam, on a bounded sample of
labelled rows: at most ``ROWS_PER_LANGUAGE`` documents of each value of the label column (those least in a hash of the id), all of their
windows, and half as many noise windows for ``und`` as an average language has (besides the rows labelled ``und``). ``WORKERS`` tasks train on a
share of the sample each, and their weights are averaged after each of ``ROUNDS`` rounds, so the driver holds weights alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, lists, map_batches, stored
from .textkernel import runs, utf8

WINDOW = 64
HIDDEN = 12
PAD = 256
ROWS_PER_LANGUAGE = 400
STEPS = 400
BROADCAST_ROWS = 100_000
WORKERS = 4
ROUNDS = 4
BATCH = 256
UNKNOWN = "und"
REJECT = 0.8


def gate(x: np.ndarray) -> np.ndarray:
    """A piecewise linear sigmoid."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def squash(x: np.ndarray) -> np.ndarray:
    """Softsign: like the hyperbolic tangent, at a fraction of its cost."""
    return x / (np.abs(x) + np.float32(1))


class Network:
    """Weights: x (2, 3H, 257) input to update, reset and candidate gates; u (2, 3H, H) recurrent; c (2, H, 1) candidate's
    recurrent bias; w (C, 2H) and b (C, 1) the label layer. The first axis is the direction."""

    def __init__(self, labels: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        f = np.float32
        self.p = {
            "x": rng.normal(0, 0.3, (2, 3 * hidden, 257)).astype(f),
            "u": rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(f),
            "c": np.zeros((2, hidden, 1), f),
            "w": rng.normal(0, 0.2, (len(labels), 2 * hidden)).astype(f),
            "b": np.zeros((len(labels), 1), f),
        }

    def inputs(self, bytes_: np.ndarray, t: int) -> np.ndarray:
        last = len(bytes_) - 1 - t
        return np.stack([np.take(self.p["x"][0], bytes_[t], 1), np.take(self.p["x"][1], bytes_[last], 1)])

    def states(self, bytes_: np.ndarray, tape: list | None = None) -> np.ndarray:
        """bytes_: (T, N). Gives (T, 2, H, N): both directions' states after the byte at each position."""
        T, N = bytes_.shape
        h, u, c = self.h, self.p["u"], self.p["c"]
        s = np.zeros((2, h, N), np.float32)
        out = np.empty((T, 2, h, N), np.float32)
        for t in range(T):
            a = self.inputs(bytes_, t)
            r = np.matmul(u, s)
            a[:, : 2 * h] += r[:, : 2 * h]
            zr = gate(a[:, : 2 * h])
            q = r[:, 2 * h :] + c
            n = squash(a[:, 2 * h :] + zr[:, h:] * q)
            new = n + zr[:, :h] * (s - n)
            if tape is not None:
                tape.append((s, zr, q, n))
            s = new
            out[t, 0], out[T - 1 - t, 1] = s[0], s[1]
        return out

    def fast_states(self, bytes_: np.ndarray) -> np.ndarray:
        """states() without a tape: the gates' slope and offset are folded into the weights and all buffers are reused."""
        T, N = bytes_.shape
        h = self.h
        scale = np.ones((1, 3 * h, 1), np.float32)
        scale[:, : 2 * h] = 0.25
        x = self.p["x"] * scale
        x[:, : 2 * h] += 0.5
        u, c = self.p["u"] * scale, self.p["c"]
        s = np.zeros((2, h, N), np.float32)
        a, r, n = np.empty((2, 3 * h, N), np.float32), np.empty((2, 3 * h, N), np.float32), np.empty((2, h, N), np.float32)
        zr, z, reset, an, q = a[:, : 2 * h], a[:, :h], a[:, h : 2 * h], a[:, 2 * h :], r[:, 2 * h :]
        gates = r[:, : 2 * h]
        out = np.empty((T, 2, h, N), np.float32)
        for t in range(T):
            np.take(x[0], bytes_[t], 1, out=a[0], mode="clip")
            np.take(x[1], bytes_[T - 1 - t], 1, out=a[1], mode="clip")
            np.matmul(u, s, out=r)
            zr += gates
            np.maximum(zr, 0, out=zr)
            np.minimum(zr, 1, out=zr)
            q += c
            q *= reset
            q += an
            np.abs(q, out=n)
            n += 1
            np.divide(q, n, out=n)
            s -= n
            s *= z
            s += n
            out[t, 0], out[T - 1 - t, 1] = s[0], s[1]
        return out

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, C, N): label probabilities of every position."""
        T, _, h, N = states.shape
        logits = np.matmul(self.p["w"], states.reshape(T, 2 * h, N)) + self.p["b"]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradients(self, bytes_: np.ndarray, target: np.ndarray) -> tuple[dict, float]:
        """Loss (mean cross-entropy of the positions that aren't padding) and its gradients through time."""
        T, N = bytes_.shape
        h, u = self.h, self.p["u"]
        tape: list = []
        states = self.states(bytes_, tape)
        p = self.probabilities(states)
        valid = (bytes_ != PAD).astype(np.float32)
        total = max(1.0, float(valid.sum()))
        at = p[:, target, np.arange(N)]
        loss = -float((np.log(at + 1e-9) * valid).sum()) / total
        p[:, target, np.arange(N)] -= 1
        p *= (valid / np.float32(total))[:, None, :]
        flat = states.reshape(T, 2 * h, N)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"] = np.einsum("tcn,tsn->cs", p, flat, optimize=True)
        g["b"] = p.sum((0, 2))[:, None]
        dstates = np.matmul(self.p["w"].T, p).reshape(T, 2, h, N)
        every = np.empty((2, T, 3 * h, N), np.float32)
        ds = np.zeros((2, h, N), np.float32)
        ut = u.transpose(0, 2, 1)
        for t in range(T - 1, -1, -1):
            s, zr, q, n = tape[t]
            ds = ds + np.stack([dstates[t, 0], dstates[T - 1 - t, 1]])
            z, r = zr[:, :h], zr[:, h:]
            dn = ds * (1 - z) * (1 - np.abs(n)) ** 2
            dgate = np.concatenate([ds * (s - n), dn * q], 1) * np.float32(0.25)
            dgate *= (zr > 0) & (zr < 1)
            dq = dn * r
            da = np.concatenate([dgate, dn], 1)
            dr = np.concatenate([dgate, dq], 1)
            g["u"] += np.matmul(dr, s.transpose(0, 2, 1))
            g["c"] += dq.sum(2, keepdims=True)
            every[0, t], every[1, T - 1 - t] = da[0], da[1]
            ds = ds * z + np.matmul(ut, dr)
        row = bytes_.ravel()
        order = np.argsort(row, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])
        gx = np.zeros((2, 257, 3 * h), np.float32)
        for d in (0, 1):
            gx[d, row[order][cut]] = np.add.reduceat(every[d].transpose(0, 2, 1).reshape(T * N, 3 * h)[order], cut, 0)
        g["x"] = gx.transpose(0, 2, 1)
        return g, loss

    def fit(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 11, rate: float = 0.03, done: int = 0, total: int | None = None) -> float:
        """windows: (M, T) bytes, target: (M,) label numbers. Adam with a falling rate, these being the steps after ``done`` of total; gives the last steps' mean loss."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(windows), min(batch, len(windows)))
            g, loss = self.gradients(np.ascontiguousarray(windows[pick].T), target[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            lr = rate * min(1, i / 10) * (1 - 0.95 * (done + i) / (total or steps))
            for k, v in g.items():
                v = v * min(1, 1 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                self.p[k] = (self.p[k] - lr * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))

    def documents(self, raw: np.ndarray, offsets: np.ndarray, group: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the mean probabilities (D, C) and the numbers of bytes with each label (D, C)."""
        sizes = np.diff(offsets)
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = offsets[:-1][owner] + within * WINDOW
        stop = np.minimum(start + WINDOW, offsets[1:][owner])
        C = len(self.labels)
        sums, labels = np.zeros((len(owner), C)), np.zeros((len(owner), C), np.int64)
        padded = np.concatenate([raw.astype(np.int16), np.full(WINDOW, PAD, np.int16)])
        for i in range(0, len(owner), group):
            a, e = start[i : i + group], stop[i : i + group]
            at = a + np.arange(WINDOW)[:, None]
            valid = at < e
            block = np.where(valid, padded[at], PAD).astype(np.intp)
            p = self.probabilities(self.fast_states(block))
            p *= valid[:, None]
            sums[i : i + group] = p.sum(0).T
            best = np.where(valid, p.argmax(1), C)
            labels[i : i + group] = np.stack([(best == c).sum(0) for c in range(C)], 1)
        total = np.zeros((len(sizes), C))
        seen = np.zeros((len(sizes), C), np.int64)
        some = np.flatnonzero(count)
        if len(some):
            first = (np.cumsum(count) - count)[some]
            total[some] = np.add.reduceat(sums, first, 0)
            seen[some] = np.add.reduceat(labels, first, 0)
        mean = total / np.maximum(sizes, 1)[:, None]
        return mean, seen


def noise(n: int, rng: np.random.Generator) -> np.ndarray:
    """Windows in no language: random bytes, digits and signs, random letters of many scripts' bytes, runs of one byte."""
    kinds = [
        rng.integers(0, 256, (n, WINDOW)),
        rng.choice(np.frombuffer(b"0123456789 .,:;-+/*=%&#()[]{}<>\n\t|_$@!?", np.uint8), (n, WINDOW)),
        rng.choice(np.frombuffer(b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ0123456789+/=", np.uint8), (n, WINDOW)),
        np.repeat(rng.integers(33, 127, (n, 1)), WINDOW, 1),
        rng.integers(128, 192, (n, WINDOW)) + 64 * (np.arange(WINDOW) % 2 == 0),
    ]
    kind = rng.integers(0, len(kinds), n)
    return np.choose(kind[:, None], kinds).astype(np.int16)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, text of the bounded training sample: rows with an id, a label and a text, the least in a hash of the id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    key = rows.select("id", "lang", F.xxhash64("text").alias("t"))
    ids = stored(key.withColumn("k", F.row_number().over(order_of("t"))).where(f"k <= {ROWS_PER_LANGUAGE}").select("id", "lang", "t").distinct(), "sampled")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return stored(rows.withColumn("t", F.xxhash64("text")).join(few, ["id", "lang", "t"], "left_semi"), "sample")


def order_of(text_hash: str):
    return Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", text_hash)


def windows_of(texts: list[str]) -> np.ndarray:
    """All windows of some texts; the last of each is padded."""
    raw, offsets = utf8(pa.array(texts, pa.large_string()))
    count = -(-np.diff(offsets) // WINDOW)
    start = np.repeat(offsets[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    padded = np.concatenate([raw.astype(np.int16), np.full(WINDOW, PAD, np.int16)])
    return np.where(at < np.repeat(offsets[1:], count)[:, None], padded[at], PAD).astype(np.int16)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """None where no row has a label and a text."""
    rows = sample(docs, id_col, text_col, lang_col)
    labels = sorted({r[0] for r in rows.select("lang").distinct().collect()} - {UNKNOWN})
    if not labels and rows.isEmpty():
        return None
    net = Network([*labels, UNKNOWN])
    number = {x: i for i, x in enumerate(net.labels)}
    share = rows.withColumn("worker", F.pmod(F.xxhash64("t", "id"), F.lit(WORKERS)).cast("int")).repartition(WORKERS, "worker").sortWithinPartitions("worker", "id", "t")
    steps = STEPS // ROUNDS // 2
    for done in range(ROUNDS):
        weights = {k: v.copy() for k, v in net.p.items()}

        def learn(batches):
            texts: list[str] = []
            langs: list[str] = []
            for batch in batches:
                texts += batch.column("text").to_pylist()
                langs += batch.column("lang").to_pylist()
            if not texts:
                return
            rng = np.random.default_rng([5, done, len(texts)])
            some = {x: windows_of([t for t, own in zip(texts, langs) if own == x]) for x in sorted(set(langs))}
            each = max(64, sum(map(len, some.values())) // len(some))
            picked = [(w[rng.integers(0, len(w), each)], number[x]) for x, w in some.items()] + [(noise(each // 2, rng), len(labels))]
            mine = Network(net.labels)
            mine.p = {k: v.copy() for k, v in weights.items()}
            mine.fit(np.concatenate([w for w, _ in picked]), np.concatenate([np.full(len(w), n) for w, n in picked]), steps, seed=11 + done, done=done * steps, total=ROUNDS * steps)
            flat = np.concatenate([mine.p[k].ravel() for k in sorted(mine.p)]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()], pa.binary())], names=["w"])

        found = [np.frombuffer(r[0], np.float32) for r in map_batches(share.select("text", "lang"), learn, "w binary").collect()]
        mean, at = np.mean(found, 0), 0
        for k in sorted(net.p):
            net.p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape).astype(np.float32)
            at += net.p[k].size
    return net


def predictions(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, prob, probs (by label, in the order of labels), label_bytes (bytes with each label), labels, accepted.

    Null, empty and blank texts: ``und`` with probability 1, not accepted. A document is accepted unless the
    pooled probability of ``und`` reaches ``REJECT``. Without a network (no labelled rows) the label is null and every document is accepted.
    Rows without id are left out; repeated rows are labelled each; very long texts are read whole; an empty table gives no rows. Of
    equal probabilities the first label in the alphabet counts (``und`` last), for a byte as for a document.
    """
    rows = id_and_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch):
        raw, offsets = utf8(batch.column("text"))
        for i, j in runs(offsets):
            probs, seen, best, ok = judge(net, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n, C = probs.shape
            names = pa.array([*net.labels, None] if net else [None])
            bounds = np.arange(n + 1) * C
            yield {
                "doc_id": batch.column("id").slice(i, j - i),
                "lang_pred": names.take(pa.array(best)),
                "prob": probs[np.arange(n), best] if C else np.ones(n),
                "probs": lists(probs.ravel(), bounds, pa.float64()),
                "label_bytes": lists(seen.ravel(), bounds, pa.int64()),
                "labels": pa.array([net.labels if net else []] * n, pa.list_(pa.string())),
                "accepted": ok,
            }

    return arrow_map(rows, run, "doc_id long, lang_pred string, prob double, probs array<double>, label_bytes array<long>, labels array<string>, accepted boolean")


def judge(net: Network | None, raw: np.ndarray, offsets: np.ndarray):
    n = len(offsets) - 1
    if net is None:
        return np.zeros((n, 0)), np.zeros((n, 0), np.int64), np.zeros(n, int), np.ones(n, bool)
    from .textkernel import Words

    probs, seen = net.documents(raw, offsets)
    blank = np.diff(Words(raw, offsets).first) == 0
    probs[blank] = 0
    probs[blank, -1] = 1
    best = probs.argmax(1)
    return probs, seen, best, probs[:, -1] < REJECT


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, unchanged, whose language is found; those that predictions() doesn't accept go.

    Null, empty and blank texts go. Rows without id are judged too, repeated rows each for itself; very long texts are read whole. A probability of ``und`` of exactly
    ``REJECT`` goes. An empty table gives none; without labelled rows all rows stay. All columns are kept, whatever their names.
    """
    net = train(docs, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(text_col))
            for i, j in runs(offsets, 1 << 22):
                *_, ok = judge(net, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array(ok))

    return map_batches(docs, run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return predictions(docs, train(docs))
