"""A training-corpus pipeline over the documents table.

Five stages, each an operator of ``ticketlens.llm``; every stage reads what its
predecessor wrote and its decisions take effect:

1. language identification: texts without a determined language go;
2. n-gram Jaccard join (five words, 0.8): one document of each group stays;
3. benchmark decontamination: spans of benchmark windows are cut out, and a
   document that mostly consists of them goes;
4. PII: validated private values become pseudonyms;
5. mixing to target weights: blocks of words in output shards.

All stages but the last return the columns of documents (``n_chars`` follows
the text).  The last returns ``shard, position, source, doc_ids, n_words,
text``.  No stage can be stated in SQL in reasonable time, so there is no
oracle; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import fresh, is_training_row, prepare, release, stored, table
from ticketlens.llm.decontaminate import decontaminate, item_blocks
from ticketlens.llm.language_id import UNDETERMINED, fit, predict
from ticketlens.llm.mixing import blocks_and_slots, mix, size_documents, source_targets, texts_of
from ticketlens.llm.ngram_join import Jaccard, near_duplicates, row_key
from ticketlens.llm.pii import pseudonymise
from ticketlens.llm.queries import PSEUDONYM_KEY

#: A language counts as determined from this posterior on.
LEAST_SCORE = 0.5

ORACLE_SQL = None


def _begin(spark: SparkSession) -> None:
    """What earlier stages left behind goes before the next one starts."""
    prepare(spark)
    release(spark)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    of = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(of), F.col("n_chars")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is determined."""
    _begin(spark)
    model = spark.sparkContext.broadcast(
        fit(docs.where(is_training_row(F.col("doc_id"))).select("doc_id", "text", "lang")))
    found = fresh("lang")
    marked = docs.withColumn(found, predict(F.col("text"), model))
    return marked.where((F.col(f"{found}.lang") != UNDETERMINED) & (F.col(f"{found}.score") >= LEAST_SCORE)).drop(found)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies
    (null ids last, ties by a hash of id and text, equal rows once); documents
    without words are no copies of each other and all stay."""
    _begin(spark)
    found = stored(near_duplicates(docs, Jaccard(words=5, share=80)), "pipeline-groups")
    first = (found.where("component is not null").groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "key2")).alias("first")))
    chosen = first.select("first.key", "first.key2", F.lit(True)).union(
        found.where("component is null").select("key", "key2", F.lit(False)).distinct())
    key, key2, worded = fresh("key"), fresh("key2"), fresh("worded")
    chosen = stored(chosen.toDF(key, key2, worded), "pipeline-chosen")
    names = row_key(F.col("doc_id"), F.col("text"))
    kept = docs.withColumns({key: names[0], key2: names[1]}).join(chosen, [key, key2])
    # a repeated row has the key of its first one
    once = kept.where(F.col(worded)).dropDuplicates([key, key2]).unionByName(kept.where(~F.col(worded)))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out."""
    _begin(spark)
    return _counted(decontaminate(docs, item_blocks(table(spark, sf_dir, "benchmark")), window=10, max_coverage=0.5))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace private values by pseudonyms."""
    _begin(spark)
    return _counted(pseudonymise(docs, PSEUDONYM_KEY))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, one row per slot of an output shard, with its text."""
    _begin(spark)
    sized = size_documents(docs)
    sources = source_targets(sized)
    mixed = mix(*blocks_and_slots(sized, sources, texts=texts_of(docs))).join(sources.select("src", "source"), "src")
    return mixed.select(
        "shard", "position", "source", F.array_distinct("pieces.doc_id").alias("doc_ids"),
        F.aggregate("pieces.n_words", F.lit(0).cast("long"), lambda n, w: n + w).alias("n_words"),
        F.array_join("pieces.text", " ").alias("text"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("pii", pii_stage),
    ("source_mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and
    read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
