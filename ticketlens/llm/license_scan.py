"""License scans: fuzzy search for short notices.

Each notice may be misspelt by up to ``k`` edits.  Cut in ``k + 1`` pieces, at
least one piece of any such occurrence is intact (pigeonhole).  One
Aho-Corasick pass over the normalised text finds the intact pieces; around
each, the regex library's bounded-error matching verifies the notice and
reports the span and its edits.  Words of a span that equal the notice (no
edits, whole words) are *base* places.

Defined results: null text is empty; texts without words give no span; every
row is handled alone, so ties, repeated rows and other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .decontaminate import words

SPAN_TYPE = ("struct<n_words:bigint,spans:array<struct<label:string,notice:string,first_word:bigint,"
             "last_word:bigint,edits:int,exact:boolean>>>")


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    base: bool = False


#: Notices searched for, their labels and the edits allowed.
NOTICES = (
    Notice("mit license", "mit", 1, True),
    Notice("apache license", "apache", 2, True),
    Notice("general public license", "gpl", 2, True),
    Notice("permission is hereby granted free of charge to any person", "mit", 4),
    Notice("licensed under the apache license version 2 0", "apache-2.0", 3),
    Notice("gnu general public license version 3", "gpl-3.0", 3),
    Notice("gnu general public license version 2", "gpl-2.0", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("mozilla public license", "mpl", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 4),
    Notice("licensed under cc by nc 4 0", "cc-by-nc-4.0", 2),
    Notice("licensed under cc by sa 4 0", "cc-by-sa-4.0", 2),
    Notice("creative commons attribution", "cc-by", 3),
)


def pieces(text: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` nearly equal parts of the notice with their offsets."""
    n, parts = len(text), edits + 1
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(cuts[i], text[cuts[i]:cuts[i + 1]]) for i in range(parts)]


@lru_cache(maxsize=4)
def _search(notices: tuple[Notice, ...]):
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, notice in enumerate(notices):
        for offset, piece in pieces(notice.text, notice.edits):
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, uses in seeds.items():
        automaton.add_word(piece, (len(piece), uses))
    automaton.make_automaton()
    # whole words; BESTMATCH is not needed, ENHANCEMATCH trims a match to its fewest edits
    fuzzy = [regex.compile(rf"(?e)(?<!\S)(?:{regex.escape(n.text)}){{e<={n.edits}}}(?!\S)") for n in notices]
    return automaton, fuzzy


def scan(text: str, notices: tuple[Notice, ...] = NOTICES):
    """(number of words, [(notice, start word, last word, edits, exact)])."""
    automaton, fuzzy = _search(notices)
    ws = words(text)
    if not ws:
        return 0, []
    line = b" ".join(ws).decode("utf-8", "surrogatepass")
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, (size, uses) in automaton.iter(line):
        start = end - size + 1
        for k, offset in uses:
            notice = notices[k]
            # wherever the match starts, its neighbours must be in view
            lo = max(0, start - offset - notice.edits - 1)
            hi = start - offset + len(notice.text) + notice.edits + 1
            windows.setdefault(k, []).append((lo, hi))
    found: list[tuple] = []
    for k, spans in windows.items():
        for lo, hi in _merged(spans):
            found += _verify(line, notices[k], fuzzy[k], lo, min(len(line), hi))
    out = []
    at = word = 0
    for lo, hi, notice, edits, exact in sorted(set(found), key=lambda m: (m[0], m[1], m[2].text)):
        word += line.count(" ", at, lo)
        at = lo
        out.append((notice, word, word + line.count(" ", lo, hi), edits, exact))
    return len(ws), out


def _merged(spans: list[tuple[int, int]]):
    """Overlapping windows as one, in order."""
    spans = sorted(spans)
    lo, hi = spans[0]
    for a, b in spans[1:]:
        if a > hi:
            yield lo, hi
            lo, hi = a, b
        hi = max(hi, b)
    yield lo, hi


def _verify(line: str, notice: Notice, fuzzy, lo: int, hi: int) -> list[tuple]:
    """Occurrences of one notice inside a window of the line."""
    found, taken = [], []
    at = line.find(notice.text, lo, hi)
    while at >= 0:
        end = at + len(notice.text)
        if (at == 0 or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
            found.append((at, end, notice, 0, True))
            taken.append((at, end))
        at = line.find(notice.text, at + 1, hi)
    for a, b in _free(lo, hi, taken):
        for m in fuzzy.finditer(line, a, b):
            if m.start() < m.end():
                found.append((m.start(), m.end(), notice, sum(m.fuzzy_counts), False))
    return found


def _free(lo: int, hi: int, taken: list[tuple[int, int]]):
    for a, b in sorted(taken):
        if lo < a:
            yield lo, a
        lo = max(lo, b)
    if lo < hi:
        yield lo, hi


def scan_column(text: Column, notices: tuple[Notice, ...] = NOTICES) -> Column:
    """``struct<n_words, spans>`` of a text column."""
    @F.pandas_udf(SPAN_TYPE)
    def scanned(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            n, spans = scan(t, notices) if t is not None else (0, [])
            out.append((n, [{"label": s[0].label, "notice": s[0].text, "first_word": s[1], "last_word": s[2],
                             "edits": s[3], "exact": s[4]} for s in spans]))
        return pd.DataFrame(out, columns=["n_words", "spans"])
    return scanned(text)
