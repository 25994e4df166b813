"""Reports over data that keeps arriving (Structured Streaming).

The dashboard re-reads its whole export on every refresh.  Here new ticket
files and new question files are processed incrementally:

* ``status_by_period_stream`` keeps the done / failed / rejected counts per
  period as streaming aggregation state (only the per-period counters are
  state, never the tickets) and recomputes the success rate per trigger.
* ``answer_questions_stream`` answers each micro-batch of questions with the
  batch operators against the (static) tickets: ``foreachBatch`` writes each
  batch's answers to its own ``batch_id`` folder with overwrite, so a replayed
  batch after a failure rewrites the same folder (idempotent sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import roles as R
from ..operators import questions as ask
from ..session import spread, write_table
from ..operators.reports import FAIL, OK, REJECTED, SUCCESS_PCT, status_aggs, success_pct


def read_ticket_stream(spark: SparkSession, path: str, schema: StructType,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of role-named ticket rows from Parquet files landing in ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def status_by_period_stream(tickets: DataFrame, period: str = R.YEAR) -> DataFrame:
    """Running A2 (success rate by period) over a ticket stream."""
    R.require(tickets, period, *R.STATUS_FLAGS)
    g = tickets.where(F.col(period).isNotNull()).groupBy(period).agg(*status_aggs())
    handled = F.col(OK) + F.col(FAIL) + F.col(REJECTED)
    return g.withColumn(SUCCESS_PCT, success_pct(F.col(OK), handled, 2, zero_when_empty=False))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process everything available now, write the result table of the last
    trigger to ``path`` and return it as a static DataFrame.  Nothing passes
    through the driver; a trigger replayed after a failure overwrites the
    same table."""
    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = (stream.writeStream.outputMode(mode).foreachBatch(replace)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def static_count_cubes(tickets: DataFrame) -> dict:
    """Pre-aggregate the static tickets once (counts per customer × periods,
    written to the shared folder) for all micro-batches and restarts.  A batch
    rolls up the grouping sets that its questions use, and no others."""
    return {"fine": tickets.sparkSession.read.parquet(write_table(ask.fine_counts(tickets), "cube_fine"))}


def answer_questions_stream(questions: DataFrame, tickets: DataFrame, out_path: str,
                            checkpoint: str, text_col: str = "question", cubes: dict | None = None):
    """Start a query answering arriving counting questions (Q8) in micro-batches.

    Every micro-batch joins against the static pre-aggregate ``cubes``
    (computed here when not given) instead of re-reading the tickets."""
    if cubes is None:
        cubes = static_count_cubes(tickets)

    def answer(batch: DataFrame, batch_id: int) -> None:
        # the parsed batch feeds several branches of the answer plan: keep it
        # for the duration of this micro-batch only (bounded by the trigger)
        parsed = ask.parse_questions(spread(batch), text_col).persist()
        try:
            out = ask.answer_count_questions(tickets, parsed, text_col, cubes=cubes)
            out.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        finally:
            parsed.unpersist()

    return (questions.writeStream.foreachBatch(answer)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
