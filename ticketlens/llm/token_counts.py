"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of ordinary length is encoded as it is.  A huge one is cut into chunks
that overlap by ``OVERLAP`` characters, which are dealt out over the cluster
and encoded with offsets, each on its own.  Where two neighbours overlap, both
know where their pre-tokens (the units inside which tokens are merged) begin.
The first place at which both begin one is the splice: the left chunk counts up
to it, the right one from it on.

Why a common boundary is proven stable.  The chunk on the left agrees with the
whole text since its own left splice, and a boundary at least ``margin``
characters before its end cannot change with more text: a match of the byte
level pattern that ends before the chunk does looks at most three characters
ahead, and an added token that crossed the boundary would lie in the chunk as a
whole.  From a true boundary on, the split depends on the text to the right
only, so the right chunk agrees with the whole text from there.  Boundaries of
tokens that are none of pre-tokens are never used.

Where no boundary is common (a run of letters or blanks longer than the
overlap), the documents concerned are cut anew, chunks and overlaps ``WIDEN``
times as long, until they align or are one chunk.

Pre-tokens are also what makes counting cheap: they repeat, and the library's
count of one is remembered by the worker.  Texts of the characters in ``_PLAIN``
are split by the byte-level pattern here; any other text, and one that spells an
added token, goes through the library as a whole.

The argument needs a byte-level pattern without normaliser and added tokens
that match by their text alone and cannot overlap (:attr:`Vocabulary.splits`).
Texts are encoded whole with any other tokenizer, and with SentencePiece models.

Chunks are named by the digest of their text, so equal texts are encoded once
and a recomputed task gives the same rows.

Defined results: a null text has 0 bytes and 0 tokens, like an empty one; ids
are not looked at, so null and repeated ones are rows like others; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, fresh, stored

#: Characters of a chunk besides its overlap, and of the overlap.
STEP = 1 << 15
OVERLAP = 1 << 9
WIDEN = 4
#: Characters of chunks in one batch.
_BATCH = 1 << 20
#: The byte-level pattern looks so many characters beyond a match.
_LOOK_AHEAD = 3

#: Counts of pre-tokens that a worker remembers.
REMEMBERED = 1 << 19

#: The byte-level pattern, over characters whose classes are the
#: same in every version of Unicode (Latin, its numbers and blanks).
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", " \\t\\n\\r"
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

_SEAMS = "array<struct<at:int,before:bigint>>"
_loaded: dict = {}
_known: dict[str, int] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file, as it is sent to the workers: one small file, its
    size is that of the vocabulary."""
    kind: str
    blob: bytes

    @staticmethod
    def read(path: str) -> Vocabulary:
        """``.json`` files are for tokenizers, ``.model`` files for sentencepiece."""
        kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        with open(path, "rb") as f:
            return Vocabulary(kind, f.read())

    @cached_property
    def _specials(self) -> list[str]:
        """The texts of the added tokens."""
        return [t["content"] for t in json.loads(self.blob).get("added_tokens") or []] if self.kind == "tokenizers" else []

    @cached_property
    def splits(self) -> bool:
        """Can huge texts be encoded in chunks?"""
        if self.kind != "tokenizers":
            return False
        spec = json.loads(self.blob)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) \
                or pre.get("add_prefix_space") or model.get("dropout"):
            return False
        plain = not any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip"))
        return plain and _apart(self._specials)

    @cached_property
    def margin(self) -> int:
        """Characters before the end of a chunk whose split may still change."""
        return max([_LOOK_AHEAD, *map(len, self._specials)])

    def encoder(self):
        name = hashlib.sha256(self.blob).digest()
        if name not in _loaded:
            _loaded.clear()
            _known.clear()
            if self.kind == "sentencepiece":
                import sentencepiece
                _loaded[name] = sentencepiece.SentencePieceProcessor(model_proto=self.blob)
            else:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark has a task for every core
                import tokenizers
                _loaded[name] = tokenizers.Tokenizer.from_str(self.blob.decode("utf-8"))
                _loaded[name].no_truncation()
                _loaded[name].no_padding()
        return _loaded[name]

    def _library(self, texts: list[str]) -> list[int]:
        if self.kind == "sentencepiece":
            return [len(ids) for ids in self.encoder().encode(texts, num_threads=1)]
        return [len(e) for e in self.encoder().encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, where they can be told here."""
        if self.splits and _PLAIN.fullmatch(text) and not any(a in text for a in self._specials):
            return _SPLIT.findall(text)
        return None

    def _learn(self, pieces: set[str]) -> None:
        """The counts of these pieces are known from here on."""
        if len(_known) + len(pieces) > REMEMBERED:
            _known.clear()
        new = list(pieces - _known.keys())
        _known.update(zip(new, self._library(new)))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size >= _BATCH:
                out += self._counted(part)
                part, size = [], 0
        return out + self._counted(part)

    def _counted(self, texts: list[str]) -> list[int]:
        self.encoder()
        split = [self.pieces(t) for t in texts]
        self._learn(set().union(*[p for p in split if p is not None]))
        others = iter(self._library([t for t, p in zip(texts, split) if p is None]))
        return [next(others) if p is None else sum(map(_known.__getitem__, p)) for p in split]

    def boundaries(self, chunk: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Tokens of a chunk; where its pre-tokens begin; the tokens before each."""
        encoder = self.encoder()
        pieces = self.pieces(chunk)
        if pieces is not None:
            self._learn(set(pieces))
            n = np.fromiter(map(_known.__getitem__, pieces), np.int64, len(pieces))
            length = np.fromiter(map(len, pieces), np.int64, len(pieces))
            return int(n.sum()), np.cumsum(length) - length, np.cumsum(n) - n
        found = encoder.encode(chunk, add_special_tokens=False)
        words = np.fromiter(found.word_ids, np.int64, len(found))
        first = np.flatnonzero(np.diff(words, prepend=-1))
        offsets = found.offsets
        return len(found), np.fromiter((offsets[i][0] for i in first), np.int64, len(first)), first


def _apart(added: list[str]) -> bool:
    """No two occurrences of added tokens can share a character."""
    return not any(a and (a != b and a in b or any(b.startswith(a[i:]) for i in range(1, len(a))))
                   for a in added for b in added)


def cut(text: str, step: int, overlap: int) -> list[str]:
    """The chunks of a text; the last one is longer than the overlap."""
    starts = range(0, max(1, len(text) - overlap), step)
    return [text[s:s + step + overlap] if s != starts[-1] else text[s:] for s in starts]


def _cutter(step: int, overlap: int):
    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for name, text in zip(batch["name"], batch["text"]):
                chunks = cut(text, step, overlap)
                for k, chunk in enumerate(chunks):
                    rows.append((name, k, k + 1 == len(chunks), chunk))
                    size += len(chunk)
                    if size >= _BATCH:
                        yield pd.DataFrame(rows, columns=["name", "k", "last", "chunk"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=["name", "k", "last", "chunk"])
    return run


def _encoded(shared, step: int, overlap: int):
    def seams(at, before, low, high):
        inside = (at >= low) & (at <= high)
        return [{"at": int(a) - low, "before": int(b)} for a, b in zip(at[inside], before[inside])]

    def run(batches):
        vocabulary = shared.value
        margin = vocabulary.margin
        for batch in batches:
            rows = []
            for name, k, last, chunk in zip(batch["name"], batch["k"], batch["last"], batch["chunk"]):
                n, at, before = vocabulary.boundaries(chunk)
                head = seams(at, before, 0, overlap) if k else []
                tail = [] if last else seams(at, before, step, min(step + overlap, len(chunk) - margin))
                rows.append((name, k, last, n, head, tail))
            yield pd.DataFrame(rows, columns=["name", "k", "last", "n", "head", "tail"])
    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """``name, n_tokens`` from the encoded chunks; null where two neighbours
    have no boundary in common.  A window holds the chunks of one text, as
    numbers."""
    after = F.lead("head").over(Window.partitionBy("name").orderBy("k"))
    seam = chunks.select("name", "n", "last", "tail", after.alias("head"))
    at = F.array_min(F.array_intersect("tail.at", "head.at"))
    before = lambda side: F.element_at(F.map_from_entries(side), at)
    counted = F.when(F.col("last"), F.col("n")).otherwise(before("tail") - before("head"))
    return seam.select("name", counted.alias("n")).groupBy("name").agg(
        F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def _huge(docs: DataFrame, shared, step: int, overlap: int, scratch: Scratch) -> DataFrame:
    """``name, n_tokens`` of the distinct texts of ``docs(name, text)``."""
    done = None
    pending = docs
    while True:
        chunks = pending.mapInPandas(_cutter(step, overlap), "name string, k int, last boolean, chunk string")
        # deals the chunks of a text out over the tasks, and keeps one of equal ones
        chunks = chunks.dropDuplicates(["name", "k"])
        encoded = scratch.stored(chunks.mapInPandas(
            _encoded(shared, step, overlap), f"name string, k int, last boolean, n bigint, head {_SEAMS}, tail {_SEAMS}"),
            "tokens-chunks")
        found = stored(_spliced(encoded), "tokens-spliced")
        whole = found.where("n_tokens is not null")
        done = whole if done is None else done.unionByName(whole)
        failed = found.where("n_tokens is null").select("name")
        if failed.isEmpty():
            return done
        step, overlap = step * WIDEN, overlap * WIDEN
        pending = docs.join(failed, "name", "left_semi")


def token_counts(docs: DataFrame, vocabulary: Vocabulary, keep: list[str], text: str = "text",
                 step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` of every row, with ``n_bytes`` (UTF-8) and
    ``n_tokens`` of its text, begin, end and added tokens not counted but
    where the text spells them and the library finds them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    body = fresh("text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    n_bytes = F.octet_length(body).cast("long").alias("n_bytes")

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.counts(texts.tolist()), dtype="int64")

    if not vocabulary.splits:
        return rows.select("*", n_bytes, counted(body).alias("n_tokens")).drop(body)
    is_huge = F.char_length(body) > step + overlap
    ordinary = rows.where(~is_huge).select("*", n_bytes, counted(body).alias("n_tokens")).drop(body)
    huge = rows.where(is_huge).select("*", n_bytes, F.sha2(F.col(body).cast("binary"), 256).alias("name"))
    scratch = Scratch(docs.sparkSession)
    totals = _huge(huge.select("name", F.col(body).alias("text")), shared, step, overlap, scratch)
    scratch.clear()
    own = fresh("name")
    huge = huge.drop(body).withColumnRenamed("name", own)
    return ordinary.unionByName(huge.join(totals.withColumnRenamed("name", own), own).drop(own))
