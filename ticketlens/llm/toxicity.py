"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features are the presence of word unigrams, bigrams and skip-grams (one and
two words left out), hashed to ``BITS`` bits.  FTRL keeps two numbers per
coordinate: its learning rate shrinks with the squared gradients of that
coordinate, and the L1 term sets the weight of every coordinate with little
evidence to exactly zero, so only a few weights are collected and broadcast.

Bounds (parameters): the model is fitted on at most about ``sample_rows``
labelled documents and about ``sample_bytes`` of their text, chosen by a hash of
the id (all, if that is within both), in one task.  The task turns each batch of
texts into feature numbers as it comes, at most four a word, and holds those and
the two coordinate arrays; it goes through the sample in the order of another
hash.

Defined results: null and empty texts score the bias alone; without any
labelled row or any document every score is 0.  A document labelled both ways
counts as toxic; repeated rows of an id count once, with the smallest text; null
ids and labels are not learned from.  Only the columns named are used, whatever
others there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import _FOLD
from .hashing import mix, words_of

BITS = 24
#: Bytes of text turned into features at once.
SLICE = 1 << 20

_A, _B = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


@dataclass(frozen=True)
class Ftrl:
    """Learning rates and penalties, per coordinate."""
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.0
    epochs: int = 4


def normalised(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) if text else b""


def slices(texts):
    """Consecutive texts of about SLICE bytes (one longer text alone)."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature index, position of the text) of every feature occurrence."""
    h, offsets = words_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    found, at = [mix(h)], [doc]
    for gap in (1, 2, 3):
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        found.append(mix(h[same] * _A + h[same + gap] * _B + np.uint64(gap)))
        at.append(doc[same])
    index = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    return index, np.concatenate(at)


def _train(rows: list[tuple[np.ndarray, float]], ftrl: Ftrl) -> pd.DataFrame:
    """The non-zero weights, the bias under index -1, from the distinct
    features and the label of each document."""
    z = np.zeros(1 << BITS, np.float32)
    n = np.zeros(1 << BITS, np.float32)
    bias_z = bias_n = 0.0

    def weight(z, n):
        return np.where(np.abs(z) <= ftrl.l1, 0.0, -(z - np.sign(z) * ftrl.l1)
                        / ((ftrl.beta + np.sqrt(n)) / ftrl.alpha + ftrl.l2))

    def bias() -> float:
        return -bias_z / ((ftrl.beta + bias_n ** 0.5) / ftrl.alpha)

    for index, label in (row for _ in range(ftrl.epochs) for row in rows):
        zi, ni = z[index], n[index]
        w, b = weight(zi, ni), bias()
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ftrl.alpha * w
        n[index] = ni + g * g
        bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n ** 0.5) / ftrl.alpha * b
        bias_n += g * g
    if not rows:
        return pd.DataFrame({"index": np.zeros(0, np.int64), "weight": np.zeros(0)})
    kept = np.flatnonzero(np.abs(z) > ftrl.l1)
    return pd.DataFrame({"index": np.append(kept, -1), "weight": np.append(weight(z[kept], n[kept]), bias())})


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = 10_000, sample_bytes: int = 1 << 26, ftrl: Ftrl = Ftrl()) -> dict[int, float]:
    """Non-zero weights by feature index (bias: -1), learned from the
    labelled documents given (the caller leaves held-out rows away)."""
    known = (labels.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{label}`").alias("label"))
             .where(F.col("doc").isNotNull() & F.col("label").isin(0, 1))
             .groupBy("doc").agg(F.max("label").cast("double").alias("label")))
    texts = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    lengths = texts.select("doc", F.octet_length("text").alias("bytes")).join(known, "doc").groupBy("doc").agg(
        F.max("bytes").alias("bytes"))
    rows, size = lengths.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    share = min(1.0, sample_rows / max(1, rows), sample_bytes / max(1, size))
    chosen = known.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < share * 1_000_000)
    rows = (texts.join(F.broadcast(chosen), "doc")   # about sample_rows ids and flags
            .groupBy("doc", "label").agg(F.min("text").alias("text")))
    stream = (rows.select("label", "text", F.xxhash64("doc", F.lit("order")).alias("at"))
              .repartition(1).sortWithinPartitions("at"))

    def train(batches):
        rows = [(np.unique(features([normalised(t)])[0]).astype(np.int32), y)
                for b in batches for t, y in zip(b["text"], b["label"])]
        yield _train(rows, ftrl)

    weights = stream.select("text", "label").mapInPandas(train, "index bigint, weight double").collect()
    return {r["index"]: r["weight"] for r in weights}


class Scorer:
    def __init__(self, weights: dict[int, float]):
        self.bias = weights.get(-1)
        self.index = np.array(sorted(i for i in weights if i >= 0), np.int64)
        self.weight = np.array([weights[i] for i in self.index], np.float64)
        self.maybe = np.zeros(1 << 16, bool)      # a cheap first test on the low bits
        self.maybe[self.index & 0xFFFF] = True

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        sums = []
        for part in slices(map(normalised, texts)):
            index, doc = features(part)
            near = np.flatnonzero(self.maybe[index & 0xFFFF])
            index, doc = index[near], doc[near]
            if len(self.index):
                place = np.minimum(np.searchsorted(self.index, index), len(self.index) - 1)
                hit = self.index[place] == index
                pairs = np.unique(doc[hit] * len(self.index) + place[hit])   # presence, not counts
                sums.append(np.bincount(pairs // len(self.index), self.weight[pairs % len(self.index)], len(part)))
            else:
                sums.append(np.zeros(len(part)))
        total = np.concatenate(sums) if sums else np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(total + self.bias, -35, 35)))


def score(text: Column, shared) -> Column:
    """Probability of the toxic label; ``shared`` is a broadcast of the weights."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(Scorer(shared.value)(list(texts)))
    return scored(text)
