"""Secret scans: fixed patterns, and guess-cost segmentation of values in credential contexts.

A value's guess cost is the cheapest way to write it as words, dates, repeats, keyboard walks and
brute-force spans, by dynamic programming over its positions; costs are log10 of the guesses and add
up. A value that costs many guesses is a secret; a placeholder or a plain word is not.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhouse.llm.shared import as_texts, map_slices

# Fixed values of the base contract, in the order in which ties of a start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ with shorter matches dropped: a match is always a whole run
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

#: Words that stand before a value: of the base pattern and others.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access_key|private_key|auth(?:orization)?|bearer|credentials?)["']?(?:\x20*([:=]|=>|\bis\b)|\x20)\x20*["']?([!#-&(-;=?-~]{6,})""", re.IGNORECASE | re.ASCII)

#: From this log10 of guesses on, a value in a context of assignment is a secret.
MIN_GUESSES = 9.0
#: A repeat's unit has at most so many characters.
UNIT = 8

# Frequent words of passwords and placeholders, most frequent first.
WORDS = (
    "password pass admin welcome login user test demo example sample secret token changeme default root guest qwerty letmein dragon monkey master "
    "hello shadow sunshine princess football baseball superman batman summer winter spring autumn monday friday love iloveyou freedom whatever "
    "michael jordan hunter ranger buster soccer hockey killer george andrew charlie thomas robert daniel jessica ashley nicole computer internet "
    "server database system service account access public private key value string number none null true false undefined placeholder your my the "
    "this that insert here enter replace company corp home house money apple google orange banana cookie cheese pepper ginger flower purple silver "
    "golden diamond crystal tiger lion eagle falcon phoenix thunder storm star moon night light dark black white blue green red happy lucky magic "
    "power strong super mega new old temp temporary backup dev prod stage local remote client api auth bearer basic"
).split()
_RANK = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_LEET = str.maketrans("0134578@$!", "oieastbasi")

# The rows of a keyboard, as walked from left to right; digits and letters are walks too.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "0123456789", "abcdefghijklmnopqrstuvwxyz")


def _steps() -> frozenset[str]:
    """Pairs of keys that follow each other along a row, or stand below each other."""
    pairs = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
    pairs |= {a + b for up, down in zip(ROWS[:3], ROWS[1:4], strict=True) for i, b in enumerate(down) for a in up[i : i + 2]}
    return frozenset(pairs | {p[::-1] for p in pairs})


_NEXT = _steps()
_YEAR = re.compile(r"(?:19|20)[0-9]{2}")
_DATES = (re.compile(r"(?:19|20)[0-9]{2}([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])"), re.compile(r"(?:0[1-9]|[12][0-9]|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)[0-9]{2}"))
#: log10 of about 120 years, and of the days of a year in either order and some ways to part them.
_YEARS, _DAYS = 2.1, math.log10(365) + 0.6


def _single(c: str) -> float:
    """log10 of the characters of c's class, the guesses of brute force for it."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 4.0


class _Ends:
    """Ends of spans that start further left, of which a span from i costs log10((end - i) / unit) besides the end's own cost; those that another beats from now on are dropped."""

    def __init__(self, unit: int, least: int):
        self.unit, self.least, self.found = unit, least, []  # (end, cost), by falling end; costs rise

    def add(self, end: int, cost: float) -> None:
        found = self.found
        while found and found[-1][1] >= cost:
            found.pop()
        if not any(c + math.log10((e - end) / self.unit + self.least) <= cost for e, c in found):
            found.append((end, cost))

    def best(self, i: int) -> tuple[float, int]:
        return min(((c + math.log10((e - i) / self.unit), e) for e, c in self.found), default=(math.inf, 0))


def suffixes(value: str, words: dict[str, float] | None = None) -> tuple[list[float], list[tuple[str, int]]]:
    """For each position, log10 of the guesses that the value costs at least from there on, and the kind and end of the first segment."""
    ranks = _RANK if words is None else words
    longest = _LONGEST if words is None else max(map(len, words), default=0)
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(_LEET)
    best: list[float] = [math.inf] * n + [0.0]
    step: list[tuple[str, int]] = [("", 0)] * (n + 1)

    def offer(kind: str, i: int, j: int, cost: float) -> None:
        if cost < best[i]:
            best[i], step[i] = cost, (kind, j)

    # for each length of a unit: how many characters from i on equal those a unit later, the unit's cost, and ends by remainder
    equal, unit_cost, repeats = [0] * (UNIT + 1), [0.0] * (UNIT + 1), [[] for _ in range(UNIT + 1)]
    walk, same_case, walks, plain_walks = 0, 0, _Ends(1, 3), _Ends(1, 3)  # keys of the walk from i on, and those up to one in another case
    for i in range(n - 1, -1, -1):
        offer("brute", i, i + 1, best[i + 1] + _single(value[i]))
        for j in range(i + 3, min(n, i + longest) + 1):
            if (rank := ranks.get(plain[i:j])) is not None:
                changed = (value[i:j] != low[i:j]) + sum(a != b for a, b in zip(low[i:j], plain[i:j], strict=True))
                offer("word", i, j, best[j] + 1.0 + rank + changed * math.log10(2))
        if value[i].isdigit():
            if _YEAR.match(value, i):
                offer("date", i, i + 4, best[i + 4] + _YEARS)
            for date in _DATES:
                if m := date.match(value, i):
                    offer("date", i, m.end(), best[m.end()] + _YEARS + _DAYS)
        if not (walk and low[i] + low[i + 1] in _NEXT):
            walk, same_case, walks, plain_walks = 0, 0, _Ends(1, 3), _Ends(1, 3)
        walk += 1
        for u in range(1, min(UNIT, n - 1 - i) + 1):
            if value[i] != value[i + u]:
                equal[u] = 0
                continue
            equal[u] += 1
            least = 3 if u == 1 else 2
            if equal[u] < (least - 1) * u:
                continue
            if equal[u] == (least - 1) * u:
                unit_cost[u], repeats[u] = sum(map(_single, value[i : i + u])), [_Ends(u, least) for _ in range(u)]
                if any(u % d == 0 and equal[d] >= u - d for d in range(1, u)):  # the shorter unit is cheaper for the same spans
                    repeats[u] = []
            if not repeats[u]:
                continue
            ends, j = repeats[u][i % u], i + least * u
            if not (step[j][0] == "walk" and walk > least * u):  # else the walk from i on is cheaper
                ends.add(j, best[j])
            cost, j = ends.best(i)
            offer("repeat", i, j, cost + unit_cost[u])
        if value[i] == low[i]:
            same_case += 1
        else:
            same_case, plain_walks = 0, _Ends(1, 3)
        for keys, ends, more in ((walk, walks, math.log10(2)), (same_case, plain_walks, 0.0)):
            if keys >= 3:
                ends.add(i + 3, best[i + 3])
                cost, j = ends.best(i)
                offer("walk", i, j, cost + math.log10(47) + more)
    return best, step


def segment(value: str, words: dict[str, float] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that a value costs at least, and the segments (kind, start, end) of that way; kinds: word, date, repeat, walk, brute."""
    best, step = suffixes(value, words)
    found, i = [], 0
    while i < len(value):
        kind, j = step[i]
        if found and kind == "brute" and found[-1][0] == "brute":
            found[-1] = ("brute", found[-1][1], j)
        else:
            found.append((kind, i, j))
        i = j
    return best[0], found


#: Values up to so many characters are remembered, and so many of them, which bounds the memory.
REMEMBERED, REMEMBERED_CHARS = 1 << 10, 256


@lru_cache(maxsize=REMEMBERED)
def _remembered(value: str) -> list[float]:
    return suffixes(value)[0]


def _guesses(value: str) -> list[float]:
    return _remembered(value) if len(value) <= REMEMBERED_CHARS else suffixes(value)[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, sorted."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    return sorted(found)


def guess_spans(text: str, least: float = MIN_GUESSES) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, log10 guesses) of values in credential contexts that cost so many guesses; where nothing but a space leads to the value, it must hold a digit too."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    out, at, taken, known = [], 0, 0, (0, 0, [0.0])
    # the search goes on at the value's start: a credential word there opens a context of its own
    while m := CONTEXT.search(text, at):
        at = m.start(2)
        value = m.group(2).rstrip(".,;:!?)&#%$*")
        end = at + len(value)
        inner = CONTEXT.match(text, at)
        if end <= taken or inner and inner.start(2) >= end:  # inside a secret, or only the word before the next value
            continue
        cost = 0.0
        if len(value) >= ASSIGN_CHARS and (m.group(1) or any(c.isdigit() for c in value)):
            if end != known[1]:  # else the rest of a value whose every rest is known
                known = (at, end, _guesses(value))
            cost = known[2][at - known[0]]
        if cost >= least:
            out.append((at, 3, end, cost))
            taken, at = end, max(at, m.end(2) - 16)  # only a word that ends the value can lead to another behind it
    return out


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in (x[:3] for x in spans))


def scan_secrets(docs: DataFrame, least: float = MIN_GUESSES) -> DataFrame:
    """For each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess and max_guesses (log10; 0 without such a value).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. Null text: empty, with
    no spans. Texts are read whole. Repeated rows repeat; an empty table gives no rows; other columns are
    ignored.
    """

    def work(batch: pa.RecordBatch) -> dict:
        rows = []
        for text in as_texts(batch.column(1)):
            base, more = base_spans(text), guess_spans(text, least)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted([*base, *(x[:3] for x in more)])), len(more), max((x[3] for x in more), default=0.0)))
        columns = list(zip(*rows, strict=True))
        return dict(zip(("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guesses"), [batch.column(0), *map(list, columns)], strict=True))

    return map_slices(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guesses double")


def masked(text: str, mask: str = "[SECRET]", least: float = MIN_GUESSES) -> str:
    """The text with every span, overlapping ones taken together, replaced by the mask; of an assignment only the value goes."""
    cuts = []
    for start, kind, end in base_spans(text):
        m = ASSIGN.match(text, start) if kind == 0 else None
        cuts.append((m.start(2) if m else start, end))
    cuts += [(s, e) for s, _, e, _ in guess_spans(text, least)]
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", least: float = MIN_GUESSES) -> DataFrame:
    """docs with the spans of secrets in text replaced by mask; a null text stays null, and the other columns pass through as they are."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(lambda x: None if x is None else masked(x, mask, least))

    return docs.withColumn("text", cover("text"))
