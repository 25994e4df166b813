"""Match a table of text patterns against a table of names, exactly.

A question batch names customers by *pattern* (case-insensitive search), so
"which customers does each pattern match" is a join on containment.  The
distinct patterns of a small batch form an automaton (Aho-Corasick) through
which every distinct name streams once: it reports the patterns inside the name,
however many there are and whatever their lengths.  Nothing but the distinct
names and the matches is shuffled.

An automaton holds a bounded number of characters (``BLOCK_CHARS``), so neither
the driver nor a worker holds more than that of them.  The patterns of a larger
batch are joined, by equality, with the parts of the distinct names that are as
long as some pattern: names are read once however many patterns there are, and
a name has no more parts than its length and the distinct lengths allow.

"." is the only wildcard a question can carry.  Such a pattern is looked up by
its longest literal run, and its matches are then verified; a pattern of nothing
but wildcards has an empty run, which every name holds.

Case is ignored by one rule on every path (``fold_case``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_case
from ..session import write_table

#: Characters of the patterns of an automaton (some 50 bytes of state each).
BLOCK_CHARS = 1 << 20


def _longest_run(folded: Column) -> Column:
    """The longest part of a pattern without a wildcard (the first of them)."""
    runs = F.split(folded, r"\.")
    return F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))


def _wildcard_search(folded: Column, pattern: Column) -> Column:
    """Search with "." as any character but a line end; all else is literal."""
    literal = F.regexp_replace(pattern, r"([^.])", r"\\Q$1\\E")
    return F.regexp_like(folded, F.concat(F.lit("(?d)"), literal))


def _held(shared):
    """UDF: the distinct probes that a name holds.  The automaton is built once
    per task."""
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick
        automaton = ahocorasick.Automaton()
        always = [p for p in shared.value if not p]
        for probe in shared.value:
            if probe:
                automaton.add_word(probe, probe)
        if len(automaton):
            automaton.make_automaton()
        for names in batches:
            yield pd.Series([always + sorted({p for _, p in automaton.iter(n)} if len(automaton) else ()) for n in names])
    return F.pandas_udf(held, "array<string>")


def _parts(name: Column, lengths: list[int]) -> Column:
    """The distinct parts of a name that have one of these lengths."""
    def of_length(n: int) -> Column:
        if n == 0:
            return F.array(F.lit(""))
        last = F.length(name) - (n - 1)
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.substring(name, at, F.lit(n)))
    return F.array_distinct(F.concat(*map(of_length, lengths)))


def match_patterns(patterns: DataFrame, names: DataFrame, pattern_col: str = "pattern",
                   name_col: str = "name", regex: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Distinct (pattern, name) pairs where the pattern occurs in the name,
    ignoring case.

    ``regex=True``: "." in a pattern is a wildcard (the pattern language of
    the questions); ``False``: every character is literal.  NULL patterns and
    names never match.
    """
    spark = patterns.sparkSession
    pats = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern IS NOT NULL").distinct()
    pats = pats.withColumn("_folded", fold_case("pattern"))
    pats = pats.withColumn("_probe", _longest_run(F.col("_folded")) if regex else F.col("_folded"))
    pats = spark.read.schema("pattern string, _folded string, _probe string").parquet(write_table(pats, "patterns"))
    probes = pats.select("_probe").distinct()
    lengths = probes.groupBy(F.length("_probe").alias("length")).count().collect()

    nms = names.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("_name", fold_case("name"))
    if sum(r["length"] * r["count"] for r in lengths) <= block_chars:
        held = _held(spark.sparkContext.broadcast(sorted(r[0] for r in probes.collect())))("_name")
    else:
        # written, so that a name is folded once and not for each of its parts
        nms = spark.read.schema("name string, _name string").parquet(write_table(nms, "names"))
        held = _parts(F.col("_name"), sorted(r["length"] for r in lengths))
    met = nms.select("name", "_name", F.explode(held).alias("_probe"))
    pairs = pats.join(met, "_probe")
    if regex:
        wild = F.col("_folded") != F.col("_probe")
        pairs = pairs.where(~wild | _wildcard_search(F.col("_name"), F.col("_folded")))
    return pairs.select("pattern", "name")
