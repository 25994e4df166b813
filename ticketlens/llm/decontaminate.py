"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items form one suffix automaton.  The
words of each document stream through it; at every word the longest suffix
that occurs in some item is known.  Where that length reaches the window, the
last ``window`` words stand in the items kept at that automaton state.  Items
shorter than the window count as one window of their own length.

An automaton is built from a *block* of items with a bounded number of words
(``BLOCK_WORDS``).  The blocks are written to the shared folder; the driver
reads one at a time and sends it to the workers, and a worker holds the
automaton of one block.  A benchmark of several blocks takes one pass over the
texts per block, which writes the matches of the texts that have any; what the
passes found is put together by the digest of the text.

Defined results: null or wordless texts and items match nothing; an item with a
null id is matched, counted and cut like others, all such items being one
without a name; repeated items share states and are all reported; rows are
independent of each other, so null and repeated document ids do not matter;
empty tables match nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path
from .common import Scratch, fresh, give_back, stored

#: Words of one automaton: about 100 bytes of state each in every worker.
BLOCK_WORDS = 200_000

#: The contract's words are runs of a-z (after folding A-Z),
#: 0-9 and every non-ASCII character.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_IN_TEXT = re.compile(_WORD)

_SPANS = T.ArrayType(T.StructType().add("start", T.LongType()).add("stop", T.LongType()))
MATCH_TYPE = ("struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,"
              "items:array<string>>")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that hold
    each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for name, ws in items:
            if ws:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in ws]
                coded.append((name, ids))
                self._insert(ids)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        self._top = self._window_states()
        self.found: list[set[str] | None] = [None] * len(self.next)
        self.short: list[list[tuple[int, str]] | None] = [None] * len(self.next)
        for name, ids in coded:
            state = 0
            for i, t in enumerate(ids):
                state = self.next[state][t]
                if i + 1 >= window:
                    at = self._top[state]
                    if self.found[at] is None:
                        self.found[at] = set()
                    self.found[at].add(name)
            if len(ids) < window:
                if self.short[state] is None:
                    self.short[state] = []
                self.short[state].append((len(ids), name))
        self._share_short_items()

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, state: int, via: int, target: int) -> int:
        """The part of ``target`` that is no longer than what ``state``
        reaches through ``via``: itself, or a new state split off."""
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = part
        while state >= 0 and self.next[state].get(via) == target:
            self.next[state][via] = part
            state = self.link[state]
        return part

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for t in ids:
            known = self.next[last].get(t)
            if known is not None:
                last = self._split(last, t, known)
                continue
            new, at = self._state(self.length[last] + 1, 0, {}), last
            while at >= 0 and t not in self.next[at]:
                self.next[at][t] = new
                at = self.link[at]
            if at >= 0:
                self.link[new] = self._split(at, t, self.next[at][t])
            last = new

    def _by_length(self) -> list[int]:
        return sorted(range(len(self.length)), key=self.length.__getitem__)

    def _window_states(self) -> list[int]:
        """For each state, the ancestor that holds its suffix of ``window`` words."""
        top = list(range(len(self.length)))
        for s in self._by_length():
            up = self.link[s]
            if up >= 0 and self.length[up] >= self.window:
                top[s] = top[up]
        return top

    def _share_short_items(self) -> None:
        """Give every state the short items that end its suffixes."""
        for s in self._by_length():
            up = self.link[s]
            if up > 0 and self.short[up]:
                self.short[s] = (self.short[s] or []) + self.short[up]

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside occurring windows, and the items."""
        spans: list[list[int]] = []
        items: set[str] = set()
        if not self.shortest or len(ws) < self.shortest:
            return [], items
        ids = np.fromiter(map(self.vocab.get, ws, repeat(-1)), np.int64, len(ws))
        unknown = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        # a window lies within one run of known words
        for r in np.flatnonzero(np.diff(unknown) > self.shortest):
            lo, hi = int(unknown[r]) + 1, int(unknown[r + 1])
            self._stream(ids[lo:hi].tolist(), lo, spans, items)
        return [(a, b) for a, b in spans], items

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], items: set[str]) -> None:
        edges, link, lengths = self.next, self.link, self.length
        window, top, found, short = self.window, self._top, self.found, self.short
        state = matched = 0
        for i, t in enumerate(ids, at + 1):
            to = edges[state].get(t)
            while to is None and state:
                state = link[state]
                matched = lengths[state]
                to = edges[state].get(t)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            hit = 0
            if matched >= window:
                items |= found[top[state]]
                hit = window
            if short[state]:
                for n, name in short[state]:
                    if n <= matched:
                        items.add(name)
                        hit = max(hit, n)
            if hit:
                if spans and spans[-1][1] >= i - hit:
                    spans[-1][1] = i
                    # an earlier, shorter hit may start after this one
                    while len(spans) > 1 and spans[-2][1] >= i - hit:
                        spans.pop()
                        spans[-1][1] = i
                    spans[-1][0] = min(spans[-1][0], i - hit)
                else:
                    spans.append([i - hit, i])


#: The automaton of the block that this worker reads at present.
_held: dict[tuple[str, int], ItemAutomaton] = {}


def _automaton(block: Block, window: int) -> ItemAutomaton:
    key = (block.name, window)
    if key not in _held:
        _held.clear()
        _held[key] = ItemAutomaton([(name, words(text)) for name, text in block.items], window)
    return _held[key]


@dataclass(frozen=True)
class Block:
    """Items ``(id or None, text)`` of one automaton, and a name for them."""
    name: str
    items: list[tuple[str | None, str]]


@dataclass(frozen=True)
class ItemBlocks:
    """The benchmark in the shared folder, one folder a block."""
    rows: DataFrame
    count: int

    def read(self, number: int) -> Block:
        found = sorted(((r["item"], r["text"]) for r in self.rows.where(F.col("block") == number).collect()),
                       key=lambda r: (r[0] is None, r[0] or "", r[1]))
        return Block(hashlib.sha256(repr(found).encode("utf-8", "surrogatepass")).hexdigest(), found)


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                block_words: int = BLOCK_WORDS) -> ItemBlocks:
    """The items in blocks of about ``block_words`` words (one larger item
    is a block of its own), counted as they are matched.  Blocks are formed by
    hash."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(_WORD)).cast("long"))).first()[0] or 0
    n = max(1, -(-int(total) // block_words))
    path = scratch_path(spark, "benchmark-blocks")
    rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)).cast("int")).write.partitionBy("block").parquet(path)
    return ItemBlocks(spark.read.schema("item string, text string, block int").parquet(path), n)


def _matcher(shared, window: int):
    @F.pandas_udf(MATCH_TYPE)
    def matches(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(shared.value, window)
        out = []
        for text in texts:
            ws = words(text) if text is not None else []
            spans, found = automaton.match(ws)
            out.append((len(ws), [{"start": a, "stop": b} for a, b in spans],
                        sorted(found, key=lambda name: (name is None, name or ""))))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])
    return matches


def with_matches(docs: DataFrame, blocks: ItemBlocks, column: str, text: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with a column ``struct<n_words, spans, items>``: merged spans
    of word positions [start, stop) inside occurring windows, and the ids of
    the items with such windows, sorted (a null at the end for items without)."""
    sc = docs.sparkSession.sparkContext
    body = F.col(f"`{text}`")
    if blocks.count == 1:
        return docs.withColumn(column, _matcher(sc.broadcast(blocks.read(0)), window)(body))
    keys = F.xxhash64(F.lit(1), body), F.xxhash64(F.lit(2), body)
    texts = docs.where(body.isNotNull()).select(keys[0].alias("k1"), keys[1].alias("k2"), body.alias("text"))
    scratch = Scratch(docs.sparkSession)
    found = None
    for number in range(blocks.count):
        shared = sc.broadcast(blocks.read(number))
        hits = texts.select("k1", "k2", _matcher(shared, window)("text").alias("m")).where(F.size("m.items") > 0)
        part = scratch.stored(hits.dropDuplicates(["k1", "k2"]).select("k1", "k2", "m.spans", "m.items"), "benchmark-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    every = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    k1, k2, match = fresh("k1"), fresh("k2"), fresh("match")
    merged = stored(every.select(F.col("k1").alias(k1), F.col("k2").alias(k2),
                                 F.struct(united("spans").alias("spans"), "items").alias(match)), "benchmark-matches")
    scratch.clear()
    marked = docs.withColumns({k1: keys[0], k2: keys[1]}).join(merged, [k1, k2], "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>"), F.array().cast("array<string>")
    made = F.struct(
        F.coalesce(F.regexp_count(body, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(f"{match}.spans", none[0]).alias("spans"), F.coalesce(f"{match}.items", none[1]).alias("items"))
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], made.alias(column))


@F.pandas_udf(_SPANS)
def united(spans: pd.Series) -> pd.Series:
    """The spans in order, those that touch or overlap as one."""
    out = []
    for found in spans:
        done: list[list[int]] = []
        for start, stop in sorted((s["start"], s["stop"]) for s in found):
            if done and done[-1][1] >= start:
                done[-1][1] = max(done[-1][1], stop)
            else:
                done.append([start, stop])
        out.append([{"start": a, "stop": b} for a, b in done])
    return pd.Series(out)


def n_hit(match: Column) -> Column:
    return F.aggregate(match["spans"], F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def without(text: str, cuts) -> str:
    """The text without the given word spans, other characters untouched
    (a cut leaves one space where words remain on both sides)."""
    at = [m.span() for m in _WORD_IN_TEXT.finditer(text)]
    kept, begin = [], 0
    for start, stop in cuts:
        kept.append(text[begin:at[start][0]].rstrip())
        begin = at[stop - 1][1]
    kept.append(text[begin:].lstrip())
    return " ".join(k for k in kept if k)


@F.pandas_udf(T.StringType())
def cut_spans(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text without its spans."""
    out = [text if text is None or cuts is None or len(cuts) == 0 else without(text, [(c["start"], c["stop"]) for c in cuts])
           for text, cuts in zip(texts, spans)]
    return pd.Series(out, dtype=object)


def _cutter(shared, window: int, max_coverage: float):
    """UDF: whether a text stays, and what is left of it if any word is hit.
    Counted as not deterministic, so that the plan runs it in one place: every
    further one is a Python worker more beside each task."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value, window)
        for texts in batches:
            out = []
            for text in texts:
                ws = words(text) if text is not None else []
                spans, _ = automaton.match(ws)
                stays = sum(stop - start for start, stop in spans) <= len(ws) * max_coverage
                out.append((stays, without(text, spans) if stays and spans else None))
            yield pd.DataFrame(out, columns=["stays", "text"])
        give_back()
    return F.pandas_udf(run, "struct<stays:boolean,text:string>").asNondeterministic()


def decontaminate(docs: DataFrame, blocks: ItemBlocks, text: str = "text", window: int = 10,
                  max_coverage: float = 0.5) -> DataFrame:
    """Remove the spans of benchmark text from each document; a document of
    which more than ``max_coverage`` of the words is hit goes as a whole.
    The columns are those of ``docs``; clean documents are unchanged."""
    m = fresh("match")
    body = F.col(f"`{text}`")
    if blocks.count == 1:
        shared = docs.sparkSession.sparkContext.broadcast(blocks.read(0))
        marked = docs.withColumn(m, _cutter(shared, window, max_coverage)(body)).where(F.col(m)["stays"])
        left = F.coalesce(F.col(m)["text"], body)
        return marked.select(*[left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
    marked = with_matches(docs, blocks, m, text, window)
    hit = n_hit(F.col(m))
    cut = F.when(hit > 0, cut_spans(body, F.col(m)["spans"])).otherwise(body)
    return marked.where(hit <= F.col(m)["n_words"] * max_coverage).select(
        *[cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
