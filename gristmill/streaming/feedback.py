"""The review log as a stream: idle sessions, current state, and an undo stack per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from gristmill.session import scratch


def stream(spark: SparkSession, sf_dir: str, name: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A table's files as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(sf_dir)


def drained(result: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Runs a streaming query over all there is and returns what it wrote. Each batch is a folder of its own, written
    anew if the batch is repeated; in complete mode the last batch counts, in update mode the last row of each key."""
    spark = result.sparkSession
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/n={number}")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    schema = StructType([*result.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("_batch") == F.col("_last")).drop("_last")
    elif mode == "update" and key:
        fields = [c for c in rows.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max(F.struct("_batch", *(c for c in fields if c != "_batch"))).alias("x")).select(*key, "x.*")
    return rows.drop("_batch")


def idle_sessions(events: DataFrame, by: str, at: str, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that the watermark has closed."""
    seen = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return seen.groupBy(by, F.session_window(at, idle).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")


def current_state(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The latest value per key, kept in state; the streaming form of review.last_write."""
    return log.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_l"), F.count("*").alias("n_changes")).select(*keys, F.col(f"_l.{value}").alias(value), "n_changes")


def undo_stack(log: DataFrame, key: str, order: list[str], value: str, is_undo: str, depth: int = 200) -> DataFrame:
    """Per key the current value after pushes and undos; at most `depth` earlier values can be brought back. Events of
    a batch are applied in their order."""

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (stack,) = state.get if state.exists else ([],)
        stack = list(stack)
        rows = pd.concat(list(batches)).sort_values(order)
        for v, undo in zip(rows[value], rows[is_undo], strict=True):
            if undo:
                stack = stack[:-1]
            else:
                stack = [*stack, float(v)][-depth - 1 :]
        state.update((stack,))
        yield pd.DataFrame({key: [group[0]], "value": [stack[-1] if stack else None], "depth": [len(stack)]}).astype({"value": "float64"})

    kind = dict(log.dtypes)[key]
    return log.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, value double, depth int", "stack array<double>", "update", GroupStateTimeout.NoTimeout)
