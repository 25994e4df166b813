"""Language identification by word-first backoff.

A known word scores its per-language log frequency.  An unseen word falls
back to its character n-grams (with word borders), from the longest order
down: the first order with a known n-gram decides, with the mean of the
per-language log frequencies of its known n-grams.  A text's score is the
posterior of the best language under equal priors, over the whole text.

Bounds (parameters): the model is fitted on at most ``docs_per_lang`` labelled
documents of each language, chosen by a hash of the id (fewer documents are
all used), and keeps the ``top_words`` and ``top_grams`` most frequent entries
per language, so what is broadcast does not grow with the corpus.

A word of more than ``MAX_WORD`` letters is never a known word: its n-grams are
learned and score it like those of an unseen one.  They are taken from pieces of
``PIECE`` letters, so no row or array grows with the length of a word.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text when nothing was learned (an empty table, or no languages).
Ties go to the first language in code point order.  Rows are scored one by one,
repeated rows are learned as often as they stand; only the columns named are
used, whatever others there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stored

UNDETERMINED = "und"
MAX_ORDER = 4
MAX_WORD = 64
#: Starting places of n-grams in one piece of a word.
PIECE = 4096
#: Scores of unseen words kept by one worker between texts.
CACHED_WORDS = 100_000

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]          # word -> row of ``rows``
    grams: list[dict[str, int]]    # by order - 1
    rows: np.ndarray               # log frequencies, one column per language


def fit(labelled: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang",
        docs_per_lang: int = 4000, top_words: int = 20_000, top_grams: int = 5_000) -> Model:
    """Learn from the rows given (the caller leaves held-out rows away)."""
    known = labelled.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    known = known.where(F.col("lang").isNotNull())
    share = {r["lang"]: min(1.0, docs_per_lang / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return Model([], {}, [{} for _ in range(MAX_ORDER)], np.zeros((0, 0), np.float32))
    keep = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    chosen = F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < keep * 1_000_000
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counts = stored(known.where(chosen).select("lang", words.alias("gram"))
                    .groupBy("lang", "gram").count(), "langid-words")
    # a piece holds the n-grams that start at its first PIECE letters
    bordered = F.concat(F.lit("_"), "gram", F.lit("_"))
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("bordered") - 1) / PIECE).cast("int")),
                       lambda k: F.substr("bordered", k * PIECE + 1, F.lit(PIECE + MAX_ORDER - 1)))
    pieces = (counts.select("lang", "count", bordered.alias("bordered"))
              .select("lang", "count", F.explode(cuts).alias("piece")))

    def inside(n: int) -> Column:
        """The n-grams of a piece; a shorter one gives its rest, dropped below."""
        starts = F.sequence(F.lit(1), F.least(F.greatest(F.length("piece") - (n - 1), F.lit(1)), F.lit(PIECE)))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.col("piece").substr(i, F.lit(n)).alias("gram")))

    every = F.flatten(F.array(*[inside(n) for n in range(1, MAX_ORDER + 1)]))
    grams = (pieces.select("lang", "count", F.explode(every).alias("p"))
             .where(F.length("p.gram") == F.col("p.n"))
             .groupBy("lang", F.col("p.n").alias("n"), F.col("p.gram").alias("gram"))
             .agg(F.sum("count").alias("count")))
    langs = sorted(share)
    model = Model(langs, {}, [], np.zeros((0, len(langs)), np.float32))
    _add(model, model.words, counts.where(F.length("gram") <= MAX_WORD), top_words)
    table = stored(grams, "langid-grams")
    for n in range(1, MAX_ORDER + 1):
        model.grams.append({})
        _add(model, model.grams[-1], table.where(F.col("n") == n), top_grams)
    return model


def _add(model: Model, entries: dict[str, int], counts: DataFrame, top: int) -> None:
    """Log frequencies of the most frequent entries of any language."""
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("count").alias("t")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top).select("gram").distinct()
    found = counts.join(best, "gram", "left_semi").select("gram", "lang", "count").toPandas()
    names = sorted(found["gram"].unique())
    column = {lang: i for i, lang in enumerate(model.langs)}
    seen = np.zeros((len(names), len(model.langs)))
    start = len(model.rows)
    entries.update({g: start + i for i, g in enumerate(names)})
    seen[[entries[g] - start for g in found["gram"]], [column[x] for x in found["lang"]]] = found["count"]
    total = np.array([totals.get(lang, 0) for lang in model.langs]) + 0.5 * max(1, len(names))
    model.rows = np.concatenate([model.rows, np.log((seen + 0.5) / total).astype(np.float32)])


class Scorer(dict):
    """word -> row of scores; unseen words are scored once and remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self._forget()

    def _forget(self) -> None:
        """Start from the model's own words again."""
        self.clear()
        self.update(self.model.words)
        self.rows = self.model.rows
        self.used = len(self.rows)

    def __missing__(self, word: str) -> int:
        row = self._backoff(f"_{word}_")
        if self.used == len(self.rows):
            grown = np.empty((max(1024, 2 * self.used), self.rows.shape[1]), np.float32)
            grown[:self.used] = self.rows[:self.used]
            self.rows = grown
        self.rows[self.used] = row
        self[word] = self.used
        self.used += 1
        return self.used - 1

    def _backoff(self, word: str):
        for n in range(MAX_ORDER, 0, -1):
            grams = self.model.grams[n - 1]
            known = [grams[g] for i in range(len(word) - n + 1) if (g := word[i:i + n]) in grams]
            if known:
                return self.model.rows[known].mean(axis=0, dtype=np.float64)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.model.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0
        if self.used > len(self.model.rows) + CACHED_WORDS:
            self._forget()
        usual = [w for w in words if len(w) <= MAX_WORD]
        at = np.fromiter(map(self.__getitem__, usual), np.int64, len(usual))
        logs = self.rows[at].sum(axis=0, dtype=np.float64)
        for w in words if len(usual) < len(words) else ():
            if len(w) > MAX_WORD:
                logs = logs + self._backoff(f"_{w}_")
        best = int(np.argmax(logs))
        return self.model.langs[best], float(1.0 / np.exp(logs - logs[best]).sum())


def predict(text: Column, shared) -> Column:
    """``struct<lang, score>`` of a text column; ``shared`` is a broadcast
    :class:`Model`.  A scorer and its remembered words live for one task."""
    @F.pandas_udf("struct<lang:string,score:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])
        del scorer
        give_back()
    return scored(text)
