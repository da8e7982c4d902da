"""A store that learns an extent from sessions: each session's value is merged once, weighted by its count, and what was
learned before counts for MOST_PRIOR rows at most.

The order of sessions matters, as a later one weighs more, so a key's sessions are folded in that order: one row per
session and key, however many measurements lie behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PRIOR = 60  # fixed value


def merged(old: Column, new: Column) -> Column:
    """Structs (long_mm, short_mm, n): the mean weighted by counts, the old one's capped; 2 decimals, half to even."""
    n0 = F.least(old["n"], F.lit(MOST_PRIOR).cast("long"))
    mean = lambda c: F.bround((old[c] * n0 + new[c] * new["n"]) / (n0 + new["n"]), 2)
    return F.when(old.isNull(), new).otherwise(F.struct(mean("long_mm").alias("long_mm"), mean("short_mm").alias("short_mm"), (n0 + new["n"]).alias("n")))


def learn(store: DataFrame | None, sessions: DataFrame, key: str, order: str) -> DataFrame:
    """store (key, long_mm, short_mm, n, upto), sessions (key, order, long_mm, short_mm, n) -> the store after them.

    upto: the largest order that has been learned. A session at or below it changes nothing, so a batch that is repeated,
    in whole or in part, is harmless, and so is one that comes twice under its order (the smallest value counts). Sessions
    without a value, or without rows, are left out."""
    value = F.struct(F.col("long_mm").cast("double").alias("long_mm"), F.col("short_mm").cast("double").alias("short_mm"), F.col("n").cast("long").alias("n"))
    some = sessions.where(F.col(key).isNotNull() & F.col(order).isNotNull() & F.col("long_mm").isNotNull() & F.col("short_mm").isNotNull() & (F.col("n") > 0))
    once = some.groupBy(key, F.col(order).alias("_o")).agg(F.min(value).alias("_v"))
    new = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", "_v"))).alias("_s"))
    if store is None:
        both = new.withColumns({"_old": F.lit(None).cast("struct<long_mm:double,short_mm:double,n:bigint>"), "_upto": F.lit(None).cast(dict(sessions.dtypes)[order])})
    else:
        known = store.select(F.col(key).alias("_k"), value.alias("_old"), F.col("upto").alias("_upto"))
        both = known.join(new, F.col("_k") == F.col(key), "full").withColumn(key, F.coalesce(key, "_k"))
    later = F.filter(F.coalesce("_s", F.array().cast(new.schema["_s"].dataType)), lambda s: F.col("_upto").isNull() | (s["_o"] > F.col("_upto")))
    folded = both.withColumn("_s", later).withColumn("_v", F.aggregate("_s", F.col("_old"), lambda a, s: merged(a, s["_v"])))
    return folded.select(key, "_v.long_mm", "_v.short_mm", "_v.n", F.greatest("_upto", F.try_element_at("_s", F.lit(-1))["_o"]).alias("upto"))
