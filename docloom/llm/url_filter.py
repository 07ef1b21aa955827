"""URL filters by a bit-parallel wildcard automaton.

All glob rules (``*`` any run, ``?`` any one character, a backslash makes the next character plain; a rule must cover the
whole URL) lie end to end in one bit vector of as many 64-bit words as it takes. A rule of m characters has m + 1 states. Per
character c of a URL one Shift-And step moves all rules at once:

    D = ((D << 1) & accepts[c]) | (D & loops)

where the shift carries from word to word and ``loops`` has the states that a star follows. A batch of URLs, longest
first, steps together; those that have ended drop out. URLs are made canonical first (built-in expressions).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: id, glob, action. A URL is blocked if a block rule matches and no allow rule does.
RULES: list[tuple[int, str, str]] = [
    (1, "*.doubleclick.net/*", "block"), (2, "*://ads.*", "block"), (3, "*://ad?.*", "block"), (4, "*/adserver/*", "block"), (5, "*/banner/*", "block"),
    (6, "*/tracking/*", "block"), (7, "*/pixel.gif*", "block"), (8, "*://m.*.example.net/*", "block"), (9, "*\\?*ref=*", "block"), (10, "*&ref=*", "block"),
    (11, "*/login*", "block"), (12, "*/signup*", "block"), (13, "*/cart/*", "block"), (14, "*/checkout/*", "block"), (15, "*/wp-admin/*", "block"),
    (16, "*/cgi-bin/*", "block"), (17, "*.exe", "block"), (18, "*.zip", "block"), (19, "*.jp?g", "block"), (20, "*.png", "block"),
    (21, "*\\?page=?", "block"), (22, "*\\?page=?&*", "block"), (23, "*://*/*/1??", "block"), (24, "http://*.example.org/de/*", "block"), (25, "*/es/?", "block"),
    (26, "*.html", "allow"), (27, "https://www.*/en/*", "allow"), (28, "*://blog.*", "allow"), (29, "*://*.example.com/fr/*", "allow"), (30, "*/robots.txt", "allow"),
    (31, "*sessionid=*", "block"), (32, "*/print/*", "block"), (33, "*\\?*sort=*", "block"), (34, "*/tag/*/page/*", "block"), (35, "*://*:8080/*", "block"),
    (36, "*/casino*", "block"), (37, "*poker*", "block"), (38, "*/share\\?*", "block"), (39, "ftp://*", "block"), (40, "*://??.wikipedia.org/*", "allow"),
]

STEP_URLS = 8192


def canonical(url: Column) -> Column:
    """Trimmed; scheme and host in lower case; no default port, fragment or utm_ parameters; at least ``/`` as the path."""
    u = F.regexp_replace(F.regexp_replace(url, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""), "#.*$", "")
    head = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    rest = F.substr(u, F.length(head) + 1)
    head = F.regexp_replace(F.regexp_replace(F.lower(head), "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    rest = F.regexp_replace(F.regexp_replace(rest, "([?&])(utm_[A-Za-z]+=[^&]*(&|$))+", "$1"), "[?&]$", "")
    return F.concat(head, F.when((head != "") & ~rest.startswith("/"), F.concat(F.lit("/"), rest)).otherwise(rest))


class Automaton:
    def __init__(self, rules: list[tuple[int, str, str]]):
        states: list[str | None] = []
        loops: list[bool] = []
        starts, finals, self.ids = [], [], []
        any_char = ""
        for number, glob, _ in rules:
            starts.append(len(states))
            states.append(None)
            loops.append(False)
            i = 0
            while i < len(glob):
                c = glob[i]
                if c == "*":
                    loops[-1] = True
                else:
                    if c == "\\" and i + 1 < len(glob):
                        i += 1
                        states.append(glob[i])
                    else:
                        states.append(any_char if c == "?" else c)
                    loops.append(False)
                i += 1
            finals.append(len(states) - 1)
            self.ids.append(number)
        self.words = max(1, -(-len(states) // 64))
        self.alphabet = np.array(sorted({ord(s) for s in states if s}), np.int64)
        accepts = np.zeros((len(self.alphabet) + 1, self.words * 64), bool)
        for k, s in enumerate(states):
            if s == any_char and s is not None:
                accepts[:, k] = True
            elif s is not None:
                accepts[np.searchsorted(self.alphabet, ord(s)), k] = True
        bits = lambda rows: np.packbits(rows, axis=-1, bitorder="little").view("<u8")
        one = lambda at: np.isin(np.arange(self.words * 64), at)
        self.accepts, self.loops, self.start = bits(accepts), bits(one([k for k, x in enumerate(loops) if x])), bits(one(starts))
        self.final_word, self.final_bit = np.array(finals, np.int64) // 64, (np.array(finals, np.int64) % 64).astype(np.uint64)

    def matches(self, urls: list[str]) -> np.ndarray:
        """(URLs, rules) truth table."""
        n = len(urls)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        points = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if len(self.alphabet):
            at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
            kind = np.where(self.alphabet[at] == points, at, len(self.alphabet))
        else:
            kind = np.zeros(len(points), np.int64)
        first = (np.cumsum(size) - size)[order]
        left = size[order]
        d = np.tile(self.start, (n, 1))
        for t in range(int(left[0]) if n else 0):
            active = int(np.searchsorted(-left, -t, "left"))
            now = d[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.accepts[kind[first[:active] + t]]
            moved |= now & self.loops
            d[:active] = moved
        out = np.empty((n, len(self.ids)), bool)
        out[order] = (d[:, self.final_word] >> self.final_bit) & np.uint64(1) if len(self.ids) else out[order]
        return out


def filtered(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[int, str, str]] | None = None) -> DataFrame:
    """page_id, canonical, rules (ids of all rules that match, rising), blocked.

    Null URL: null canonical, no rules, not blocked. An empty URL is matched as the empty string. Null ids and repeated rows are
    kept, one row out for one in. Other columns are ignored. Rules of one id count as one.
    """
    rules = RULES if rules is None else rules
    machine = Automaton(rules)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), canonical(F.col(url_col)).alias("canonical"))
    ids = np.array(machine.ids, np.int64)
    allow = np.array([a == "allow" for *_, a in rules], bool)

    def run(batch: pa.RecordBatch):
        for i in range(0, batch.num_rows, STEP_URLS):
            part = batch.slice(i, STEP_URLS)
            urls = part.column("canonical").to_pylist()
            hit = machine.matches([u or "" for u in urls])
            hit[[u is None for u in urls]] = False
            yield {
                "page_id": part.column("page_id"), "canonical": part.column("canonical"),
                "rules": [sorted({int(x) for x in ids[row]}) for row in hit], "blocked": hit[:, ~allow].any(1) & ~hit[:, allow].any(1),
            }

    return arrow_map(rows, run, "page_id long, canonical string, rules array<int>, blocked boolean")


def like(glob: str) -> str:
    """The LIKE pattern (escape character !) of a glob."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c in "*?":
            out += "%" if c == "*" else "_"
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out += "!" + c if c in "!%_" else c
        i += 1
    return out


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return filtered(table(spark, sf_dir, "pages"))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, like(g).replace("'", "''"), a) for i, g, a in RULES)
SQL = f"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'), '#.*$', '') AS u FROM pages),
h AS (SELECT page_id, u, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*') AS h0 FROM u),
p AS (SELECT page_id,
  regexp_replace(regexp_replace(lower(h0), '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1') AS h,
  regexp_replace(regexp_replace(substr(u, length(h0) + 1), '([?&])(utm_[A-Za-z]+=[^&]*(&|$))+', '\\1', 'g'), '[?&]$', '') AS r FROM h),
c AS (SELECT page_id, h || CASE WHEN h <> '' AND NOT starts_with(r, '/') THEN '/' || r ELSE r END AS canonical FROM p),
rules(id, pattern, action) AS (VALUES {_VALUES})
SELECT page_id, canonical, coalesce(list_sort(list(id::INT) FILTER (id IS NOT NULL)), []) AS rules,
  coalesce(bool_or(action = 'block'), false) AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
FROM c LEFT JOIN rules ON canonical LIKE pattern ESCAPE '!' GROUP BY page_id, canonical
"""
