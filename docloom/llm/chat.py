"""Chat formatting: a hidden Markov model over lines recovers the roles of a raw transcript, which is then rendered in one form.

States are (role, begins a turn or goes on), for the roles system, user and assistant. Of each line the model sees the
speaker marker at its start (if any) together with whether a blank line stands before it, and its shape (length class, question
mark). The two features are independent given the state. Start, transition and emission probabilities are counted over all labelled
conversations (smoothed by a few lines with the markers that their states
suggest, and with the shapes and moves that all roles have in common), in Spark; Viterbi finds the likeliest states of all transcripts of a batch at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

ROLES = ["system", "user", "assistant"]
ALIASES = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "q", "question", "customer", "prompter"],
    "assistant": ["assistant", "ai", "bot", "a", "answer", "agent", "model"],
}
_ROLE_OF = {a: i for i, r in enumerate(ROLES) for a in ALIASES[r]}
_NAMES = "|".join(sorted(map(re.escape, _ROLE_OF), key=len, reverse=True))
MARKER = re.compile(rf"^[ \t]*(?:<\|(?P<a>{_NAMES})\|>|\[(?P<b>{_NAMES})\]:?|#{{2,}}[ \t]*(?P<c>{_NAMES})[ \t]*:?(?=[ \t]|$)|\*\*(?P<d>{_NAMES}):?\*\*:?|(?P<e>{_NAMES})[ \t]*:)[ \t]*", re.IGNORECASE)
STYLES = ["{name}: ", "### {name}\n", "<|{name}|>\n", "[{name}] ", "**{name}:** ", "\n"]
_WRITTEN = {"system": "System", "user": "User", "assistant": "Assistant"}
SHAPES = 8
FEATURES = (15, SHAPES)
STATES = 2 * len(ROLES)
FOLDS = 8
#: Lines of each state that are taken to have been seen: beginnings with their own role's marker, others without one.
SEEN = 24
PRIOR = np.zeros((STATES, FEATURES[0]))
for _r in range(len(ROLES)):
    PRIOR[2 * _r, 3 * (_r + 1) : 3 * (_r + 2)] = SEEN / 3
    PRIOR[2 * _r + 1, [0, 1, 2, 12, 13, 14]] = SEEN / 6


def transcript(turns: list[tuple[str | None, str]], style: str) -> tuple[str, list[int], list[int]]:
    """Raw text of a conversation; the state (2 * role, + 1 where a turn goes on; -1 without a role) of each of its lines."""
    lines, states = [], []
    for role, text in turns:
        body = (style.format(name=_WRITTEN[role]) if role in _WRITTEN else "\n" if lines else "") + text
        own = body.split("\n")
        blank = 1 if own[0] == "" and (style == "\n" or role not in _WRITTEN) and len(own) > 1 else 0
        if blank and not lines:
            own, blank = own[1:], 0
        r = ROLES.index(role) if role in _WRITTEN else -1
        before = states[-1] | 1 if states and states[-1] >= 0 else -1
        states += [before] * blank + ([2 * r] + [2 * r + 1] * (len(own) - blank - 1) if r >= 0 else [-1] * (len(own) - blank))
        lines += own
    return "\n".join(lines), states


def features(text: str) -> np.ndarray:
    """(lines, 2): marker (role + 1; 0 none in a transcript without any, 4 none in one that has some) together with the line
    before (0 not blank, 1 blank, 2 there is none), and shape."""
    lines = text.split("\n")
    marker, before, shape = np.zeros((3, len(lines)), np.int64)
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        marker[i] = _ROLE_OF[m[m.lastgroup].lower()] + 1 if m else 0
        before[i] = 2 if i == 0 else not lines[i - 1].strip()
        n = len(line)
        shape[i] = 0 if not line.strip() else 1 + min(2, (n > 40) + (n > 160)) * 2 + line.rstrip().endswith("?")
    if marker.any():
        marker[marker == 0] = 4
    return np.stack([marker * 3 + before, shape], 1)


def conversations(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (in the order of turn, then role and text). Rows without a conv_id are left out, a null text is empty."""
    t = table.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    return t.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def written(table: DataFrame, **columns: str) -> DataFrame:
    """conv_id, transcript, states: each conversation as raw text in one of STYLES (chosen by its id), with every line's state. A turn whose role isn't
    one of ROLES (a tool's, say, or null) is written without a marker, its lines have no state and don't count in fit(). Repeated turns are written each;
    columns other than the four are ignored, whatever their names."""

    def run(batch: pa.RecordBatch):
        texts, states = [], []
        for key, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
            t, s = transcript([(x["role"], x["text"]) for x in turns], STYLES[key % len(STYLES)])
            texts.append(t)
            states.append(s)
        yield {"conv_id": batch.column("conv_id"), "transcript": texts, "states": states}

    return arrow_map(conversations(table, **columns), run, "conv_id long, transcript string, states array<int>")


class Model:
    """Log probabilities: start (S,), move (S, S), emit one (S, values) per feature."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        log = lambda c: np.log((c + 1) / (c + 1).sum(-1, keepdims=True))
        kind, role = np.arange(STATES) % 2, np.arange(STATES) // 2
        shape, step = np.zeros((STATES, SHAPES)), np.zeros((STATES, STATES))
        to = np.where(role[:, None] != role, 2 + kind, kind)  # own beginning, own going on, another's beginning (and what can't be)
        for k in (0, 1):  # what holds for all roles' beginnings, or for all their other lines
            seen = emit[1][kind == k].sum(0)
            shape[kind == k] = SEEN * seen / max(1, seen.sum())
            for t in (0, 1, 2):
                step[(kind == k)[:, None] & (to == t)] = SEEN * move[(kind == k)[:, None] & (to == t)].sum() / max(1, move[kind == k].sum()) / max(1, (to[kind == k][0] == t).sum())
        self.start, self.move, self.emit = log(start), log(move + step), [log(emit[0] + PRIOR), log(emit[1] + shape)]
        going = np.arange(STATES)
        self.start[going % 2 == 1] = -np.inf
        for s in range(STATES):
            self.move[s, (going % 2 == 1) & (going // 2 != s // 2)] = -np.inf

    def viterbi(self, observed: list[np.ndarray]) -> list[np.ndarray]:
        """Likeliest states of each transcript; ties go to the lower state. Transcripts step together, longest first."""
        if not observed:
            return []
        size = np.array([len(o) for o in observed])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([observed[i] for i in order]) if size.sum() else np.zeros((0, len(FEATURES)), np.int64)
        scores = sum(e[:, flat[:, k]] for k, e in enumerate(self.emit)).T
        left = size[order]
        first = np.cumsum(left) - left
        back = np.zeros((len(flat), STATES), np.int8)
        best = self.start + np.zeros((len(left), STATES))
        alive = int((left > 0).sum())
        best[:alive] += scores[first[:alive]]
        for t in range(1, int(left[0])):
            active = int(np.searchsorted(-left, -t, "left"))
            paths = best[:active, :, None] + self.move
            back[first[:active] + t] = paths.argmax(1)
            best[:active] = paths.max(1) + scores[first[:active] + t]
        state = best.argmax(1)
        states = np.zeros(len(flat), np.int64)
        for t in range(int(left[0]) - 1, -1, -1):
            active = int(np.searchsorted(-left, -t, "left"))
            states[first[:active] + t] = state[:active]
            state[:active] = back[first[:active] + t, state[:active]]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
        for k, i in enumerate(order):
            out[i] = states[first[k] : first[k] + left[k]]
        return out


def counted(labelled: DataFrame, fold: str | None = None) -> dict[int, np.ndarray]:
    """Counts of starts, moves and emissions over all rows of (transcript, states), end to end, by the value of a column (0 without one)."""
    rows = labelled.select("transcript", "states", (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))

    def run(batch: pa.RecordBatch):
        for f in sorted(set(batch.column("fold").to_pylist())):
            some = batch.filter(pc.equal(batch.column("fold"), f))
            start, move, emit = np.zeros(STATES, np.int64), np.zeros((STATES, STATES), np.int64), [np.zeros((STATES, v), np.int64) for v in FEATURES]
            for text, states in zip(some.column("transcript").to_pylist(), some.column("states").to_pylist()):
                s, o = np.array(states, np.int64), features(text)
                known = s >= 0
                if len(s) and known[0]:
                    start[s[0]] += 1
                pair = known[1:] & known[:-1]
                np.add.at(move, (s[:-1][pair], s[1:][pair]), 1)
                for k, e in enumerate(emit):
                    np.add.at(e, (s[known], o[known, k]), 1)
            every = np.concatenate([start, move.ravel(), *[e.ravel() for e in emit]])
            yield {"fold": np.full(len(every), f), "i": np.arange(len(every)), "c": every}

    out: dict[int, np.ndarray] = {}
    for f, i, c in arrow_map(rows, run, "fold int, i int, c long").groupBy("fold", "i").agg(F.sum("c")).collect():  # a few hundred numbers a fold
        out.setdefault(f, np.zeros(sum(SIZES)))[i] = c
    return out


SIZES = [STATES, STATES * STATES, *[STATES * v for v in FEATURES]]


def model_of(counts: np.ndarray) -> Model:
    start, move, *emit = np.split(counts, np.cumsum(SIZES)[:-1])
    return Model(start, move.reshape(STATES, STATES), [e.reshape(STATES, -1) for e in emit])


def fit(labelled: DataFrame) -> Model:
    """The model of all rows of (transcript, states); lines without a state (-1) don't count."""
    return model_of(counted(labelled).get(0, np.zeros(sum(SIZES))))


def turns_of(text: str, states: np.ndarray) -> list[tuple[str, str]]:
    """(role, content): lines from one turn's beginning to the next, without markers and the blank lines around them."""
    out: list[tuple[str, list[str]]] = []
    for line, s in zip(text.split("\n"), states.tolist()):
        if s % 2 == 0 or not out:
            m = MARKER.match(line)
            out.append((ROLES[s // 2], [line[m.end() :] if m and _ROLE_OF[m[m.lastgroup].lower()] == s // 2 else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(lines).strip("\n")) for role, lines in out]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form; its own marks inside a text are broken by a blank."""
    safe = lambda t: t.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")
    return "".join(f"<|im_start|>{role}\n{safe(text)}<|im_end|>\n" for role, text in turns)


def formatted(transcripts: DataFrame, model: Model | list[Model], id_col: str = "conv_id", text_col: str = "transcript", fold: str | None = None) -> DataFrame:
    """conv_id, n_turns, roles, rendered. With a list of models, each row is read by the one that its column ``fold`` gives the place of.

    Null or blank transcript: no turns and the empty string. Null ids and repeated rows are kept, one row out for one in. Very
    long transcripts are read whole. Equal likelihoods go to the first role in ROLES. Other columns are ignored.
    """
    rows = transcripts.select(F.col(id_col).cast("long").alias("conv_id"), F.col(text_col).alias("__text"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))
    models = model if isinstance(model, list) else [model]

    def run(batch: pa.RecordBatch):
        texts, folds = [t if t and t.strip() else "" for t in batch.column("__text").to_pylist()], batch.column("fold").to_numpy()
        for i in range(0, len(texts), 512):
            some, of = texts[i : i + 512], folds[i : i + 512]
            seen = [features(t) if t else np.zeros((0, len(FEATURES)), np.int64) for t in some]
            paths: list = [None] * len(some)
            for f in np.unique(of):
                mine = np.flatnonzero(of == f)
                for n, path in zip(mine, models[f].viterbi([seen[n] for n in mine])):
                    paths[n] = path
            found = [turns_of(t, p) if t else [] for t, p in zip(some, paths)]
            yield {"conv_id": batch.column("conv_id").slice(i, 512), "n_turns": [len(f) for f in found], "roles": [[r for r, _ in f] for f in found], "rendered": [render(f) for f in found]}

    return arrow_map(rows, run, "conv_id long, n_turns int, roles array<string>, rendered string")


def query(spark, sf_dir: str) -> DataFrame:
    """Every conversation written as a raw transcript, its roles recovered from the text alone, and rendered. Each of FOLDS parts (by a hash of the id) is read
    by the model of the other parts' labels, so no transcript is decoded by counts of its own."""
    from .common import stored, table

    raw = stored(written(table(spark, sf_dir, "conversations")).withColumn("fold", F.pmod(F.xxhash64("conv_id"), F.lit(FOLDS)).cast("int")), "transcripts")
    counts = counted(raw, "fold")
    total = sum(counts.values(), np.zeros(sum(SIZES)))
    return formatted(raw, [model_of(total - counts.get(f, 0)) for f in range(FOLDS)], fold="fold")
