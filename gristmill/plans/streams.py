"""Streaming queries over the driver's tables; without SQL, as their sinks are files of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import table
from gristmill.streaming import feedback as fb


def _log(spark: SparkSession, d: str) -> DataFrame:
    return fb.stream(spark, d, "events", table(spark, d, "events").schema)


def events_idle_stream(spark: SparkSession, d: str) -> DataFrame:
    return fb.drained(fb.idle_sessions(_log(spark, d), "user_id", "ts"), "append")


def feedback_stream_fold(spark: SparkSession, d: str) -> DataFrame:
    return fb.drained(fb.current_state(_log(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "value"), "complete")


def undo_stream(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d).select("user_id", "ts", "event_id", "value", (F.col("event_id") % 5 == 0).alias("undo"))
    return fb.drained(fb.undo_stack(log, "user_id", ["ts", "event_id"], "value", "undo"), "update", ["user_id"])


QUERIES = {f.__name__: f for f in (events_idle_stream, feedback_stream_fold, undo_stream)}
#: In complete mode the stream's last state is the batch fold.
ORACLE = {"feedback_stream_fold": "select user_id, event_type, last(value order by ts, event_id) as value, count(*) as n_changes from events group by all"}
