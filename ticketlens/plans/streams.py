"""Streaming queries: ticket / question files written by Spark from the test
tables into the shared folder in two drops, then processed incrementally."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..session import scratch_path, write_table
from ..sources.testdata import tickets
from ..streaming import live_reports as LR
from .questions import _bank_texts
from .registry import ORACLE, register

SPLIT_YEAR = 1997


def _stream_rate(spark, sf):
    """Two refreshes of the same streaming query: the second run restarts
    from the checkpoint, reads only the files that arrived since, and
    continues from the restored per-year state."""
    t = tickets(spark, sf, [R.YEAR, *R.STATUS_FLAGS])
    path, ckpt = scratch_path(spark, "ticket_drops"), scratch_path(spark, "ckpt")
    early = F.col(R.YEAR) <= SPLIT_YEAR
    out = None
    for drop in (early, ~early | early.isNull()):
        t.where(drop).write.mode("append").parquet(path)
        stream = LR.read_ticket_stream(spark, path, t.schema)
        out = LR.run_to_table(LR.status_by_period_stream(stream),
                              scratch_path(spark, "ticket_status"), ckpt)
    return out


def _stream_answers(spark, sf):
    """Questions arrive in two drops; each refresh answers only the new ones."""
    bank = spark.read.parquet(write_table(_bank_texts(spark, sf), "questions"))
    qpath, ckpt = scratch_path(spark, "question_drops"), scratch_path(spark, "ckpt")
    out = scratch_path(spark, "answers")
    t = tickets(spark, sf, [R.CUSTOMER, *R.PERIODS])
    cubes = LR.static_count_cubes(t)
    short = F.length("question") < 40
    for drop in (short, ~short):
        bank.where(drop).write.mode("append").parquet(qpath)
        qs = spark.readStream.schema(bank.schema).parquet(qpath)
        LR.answer_questions_stream(qs, t, out, ckpt, cubes=cubes).awaitTermination()
    return spark.read.parquet(out).drop("batch_id")


# same results as the batch reports, so the same oracle text
register("stream_success_rate_by_year", ORACLE["success_rate_by_year"])(_stream_rate)
register("stream_answer_count_questions", ORACLE["answer_count_questions"])(_stream_answers)
