"""License scans: exact phrases of words, and fuzzy search of short notices.

A notice that may differ by e edits is split into e + 1 pieces: any match within e edits holds one
piece unchanged (pigeonhole). The pieces of all notices are found in one pass of an Aho-Corasick
automaton; around each, the regex library's bounded-error matching verifies the notice and gives its
span and number of edits.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyhouse.llm.shared import as_bytes, map_slices

# Fixed values of the base contract: phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices, their labels and the edits (of characters) that a match may have.
NOTICES = (
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("creative commons attribution noncommercial", "cc-by-nc", 3),
    ("this work is dedicated to the public domain", "public-domain", 4),
    ("all rights reserved", "all-rights-reserved", 1),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 6),
    ("this software is provided as is without any express or implied warranty", "zlib", 6),
    ("this is free and unencumbered software released into the public domain", "unlicense", 6),
    ("cc0 1 0 universal", "cc0", 1),
    ("creative commons zero", "cc0", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 3),
    ("creative commons attribution noderivatives", "cc-by-nd", 3),
    ("boost software license", "bsl", 2),
    ("european union public licence", "eupl", 2),
    ("common development and distribution license", "cddl", 3),
    ("server side public license", "sspl", 2),
    ("business source license", "busl", 2),
    ("the artistic license", "artistic", 2),
    ("do what the fuck you want to public license", "wtfpl", 3),
)

_BLANK = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in range(256))


def words_of(data: bytes) -> list[bytes]:
    """Words of UTF-8 text, A-Z in lower case; ASCII signs and spaces separate."""
    return data.translate(_BLANK).split()


@lru_cache(maxsize=4)
def _search(notices: tuple):
    seeds = ahocorasick.Automaton()
    held: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for n, (text, _, edits) in enumerate(notices):
        size, rest = divmod(len(text), edits + 1)
        at = 0
        for k in range(edits + 1):
            end = at + size + (k < rest)
            held.setdefault(text[at:end], []).append((n, at))
            at = end
        # spaces that must be there: a window's end hides what follows, so a negative look-ahead would take it for a word's end
        patterns.append(regex.compile(rf"(?e)(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?= )"))
    for seed, uses in held.items():
        seeds.add_word(seed, (len(seed), uses))
    seeds.make_automaton()
    return seeds, patterns


def fuzzy_notices(text: str, notices: tuple = NOTICES) -> list[tuple[int, int, int, int]]:
    """(notice, start, end, edits) of the places of notices in text (words joined by single spaces), leftmost first for each notice, not overlapping; only places at word bounds."""
    seeds, patterns = _search(notices)
    text = f" {text} "
    windows: dict[int, list[list[int]]] = {}
    for last, (size, uses) in seeds.iter(text):
        begin = last + 1 - size
        for n, at in uses:
            whole, edits = len(notices[n][0]), notices[n][2]
            lo, hi = max(0, begin - at - edits), min(len(text), begin - at + whole + edits + 1)
            mine = windows.setdefault(n, [])
            if mine and lo <= mine[-1][1]:
                mine[-1][0], mine[-1][1] = min(mine[-1][0], lo), max(mine[-1][1], hi)
            else:
                mine.append([lo, hi])
    out = []
    for n, mine in sorted(windows.items()):
        for lo, hi in mine:
            at = lo
            while at < hi and (m := patterns[n].search(text, at, hi)):
                start, end = m.span()
                at = max(end, start + 1)
                out.append((n, start - 1, end - 1, sum(m.fuzzy_counts)))
    return out


def scan(data: bytes, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> tuple:
    """(n_words, places of phrases as (first word, label), fuzzy places as (label, first word, end word, edits, score))."""
    words = words_of(data)
    joined = b" " + b" ".join(words) + b" "
    base = []
    for phrase, label in phrases.items():
        needle, at, places = b" " + phrase.encode() + b" ", -1, []
        while (at := joined.find(needle, at + 1)) >= 0:
            places.append(at)
        if places:
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            base += [(k, label) for k in np.searchsorted(spaces, places).tolist()]
    text = joined[1:-1].decode("utf-8", "replace")
    found = fuzzy_notices(text, notices)
    if not found:
        return len(words), sorted(base), []
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
    first, last = (np.searchsorted(spaces, [x[k] for x in found]).tolist() for k in (1, 2))
    return len(words), sorted(base), [(notices[n][1], a, b + 1, edits, 1 - edits / len(notices[n][0])) for (n, _, _, edits), a, b in zip(found, first, last, strict=True)]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and notices (label, first_word, end_word, edits of each fuzzy place).

    score is 1 with a base phrase, else the best share of unchanged characters among the fuzzy places,
    else 0. Null text: empty, which has no words and no places (first_word and last_word null, labels '').
    Texts are read whole. Repeated rows repeat; an empty table gives no rows; other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> dict:
        found = [scan(x, phrases, notices) for x in as_bytes(batch.column(1))]
        return {
            "doc_id": batch.column(0),
            "n_words": [n for n, _, _ in found],
            "n_base": [len(b) for _, b, _ in found],
            "first_word": [b[0][0] if b else None for _, b, _ in found],
            "last_word": [b[-1][0] if b else None for _, b, _ in found],
            "base_labels": [",".join(sorted({x for _, x in b})) for _, b, _ in found],
            "labels": [",".join(sorted({x for _, x in b} | {x[0] for x in f})) for _, b, f in found],
            "score": [1.0 if b else max((x[4] for x in f), default=0.0) for _, b, f in found],
            "notices": [[{"label": x[0], "first_word": x[1], "end_word": x[2], "edits": x[3]} for x in f] for _, _, f in found],
        }

    return map_slices(docs.selectExpr("cast(doc_id as bigint) as doc_id", "text"), work, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,first_word:int,end_word:int,edits:int>>")
