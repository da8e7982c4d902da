"""Review state: the append-only log folded into current state, plans, differences and lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# How far a session has come, for choosing among several that hold one item.
PHASE_RANK = {"applied": 3, "locked": 2, "reviewing": 1}
MOVES = {("analyzing", "reviewing"), ("reviewing", "locked"), ("locked", "applied"), ("locked", "apply_failed"), ("locked", "reviewing"), ("applied", "reviewing"), ("apply_failed", "reviewing"), ("reviewing", "analyzing")}


def last_write(log: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The latest value per key; null is a value (it clears). Combines on the map side."""
    latest = F.max(F.struct(*order, F.struct(value).alias("_v")))
    return log.groupBy(*keys).agg(latest.alias("_l"), F.count("*").alias("n_changes")).select(*keys, F.col(f"_l._v.{value}").alias(value), "n_changes")


def undo_last(log: DataFrame, keys: list[str], order: list[str], value: str, depth: int = 1) -> DataFrame:
    """The value before the last `depth` changes of each key; null if there was none."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    old = log.withColumn("_k", back).where(F.col("_k") <= depth + 1)
    return old.groupBy(*keys).agg(F.max(F.when(F.col("_k") == depth + 1, F.col(value))).alias(value))


def newest(log: DataFrame, most: int, order: list[str], by: list[str]) -> DataFrame:
    """The last `most` entries of each key, as an undo stack or log ring keeps them."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order)))
    return log.withColumn("_k", back).where(F.col("_k") <= most).drop("_k")


def best_state(rows: DataFrame, key: list[str], rank: Column, tie: list[str]) -> DataFrame:
    """One row per key: that of highest rank, then of the last of `tie`."""
    order = Window.partitionBy(*key).orderBy(rank.desc(), *(F.col(c).desc() for c in tie))
    return rows.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def plan_diff(now: DataFrame, applied: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """now with `changed`: never applied, or any field different, nulls being equal to each other."""
    old = applied.select(key, F.lit(True).alias("_was"), *(F.col(f).alias(f"_old_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    joined = now.join(old, key, "left")
    return joined.withColumn("was_applied", F.col("_was").isNotNull()).withColumn("changed", ~(F.col("was_applied") & same)).drop("_was", *(f"_old_{f}" for f in fields))


def file_action(apply: Column, changed: Column, was_applied: Column, exists: Column) -> Column:
    return F.when(apply, F.when(changed | ~exists, "write").otherwise("keep")).otherwise(F.when(was_applied & exists, "remove").otherwise("skip"))


def will_apply(decision: Column, error: Column, has_crop: Column, group: Column, manual: Column, compatible: Column) -> Column:
    """Not skipped, no error, a crop, a target that takes it, and, if red, made by hand or accepted."""
    weak = (group == "red") & ~manual & ~decision.eqNullSafe(F.lit("accept"))
    return ~decision.eqNullSafe(F.lit("skip")) & error.isNull() & has_crop & ~weak & compatible


def effective_group(override: Column, automatic: Column) -> Column:
    return F.when(override.isin("green", "yellow", "red"), override).otherwise(automatic)


def merge(old: DataFrame, new: DataFrame, key: str, keep: Column, fields: list[str]) -> DataFrame:
    """Keyed upsert: rows of new for which keep holds replace or join old's, the others delete theirs."""
    n = new.select(key, F.lit(True).alias("_new"), keep.alias("_keep"), *(F.col(f).alias(f"_n_{f}") for f in fields))
    both = old.join(n, key, "full_outer").where(F.col("_new").isNull() | F.col("_keep"))
    return both.select(key, *(F.when(F.col("_new"), F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields))


def sessions(events: DataFrame, by: list[str], at: str, idle: str = "30 minutes") -> DataFrame:
    """Batch form of session windows: a new one when the gap to the previous event is `idle` or more."""
    order = Window.partitionBy(*by).orderBy(at)
    new = F.when(F.lag(at).over(order).isNull() | (F.col(at) >= F.lag(at).over(order) + F.expr(f"interval {idle}")), 1).otherwise(0)
    marked = events.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order))
    return marked.groupBy(*by, "_s").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("_s")


def expired(last_seen: DataFrame, at: str, now: Column, days: int = 14, locked: Column | None = None) -> DataFrame:
    """Rows untouched for more than `days`, locked ones excepted."""
    old = F.col(at) < now - F.expr(f"interval {days} days")
    return last_seen.where(old & ~locked if locked is not None else old)


def contained(sets: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Keys all of whose items are among wanted's (relational division by anti join)."""
    missing = sets.join(wanted.select(item).distinct(), item, "left_anti").select(key).distinct()
    return sets.select(key).distinct().join(missing, key, "left_anti")


def transitions(phases: DataFrame, key: str, order: str, phase: str) -> DataFrame:
    """Each step with whether it is allowed, and the revision, which reopening raises."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(phase).over(w)
    allowed = before.isNull() | F.concat_ws(">", before, phase).isin(*(f"{a}>{b}" for a, b in sorted(MOVES)))
    opened = F.when((F.col(phase) == "reviewing") & before.isin("locked", "applied", "apply_failed"), 1).otherwise(0)
    return phases.withColumns({"before": before, "allowed": allowed, "_o": opened}).withColumn("revision", 1 + F.sum("_o").over(w)).drop("_o")


def move_size(rows: DataFrame, key: str, group: str, reference: DataFrame) -> DataFrame:
    """rows (key, group, cx, cy, w, h, manual) get the long and short side of their group's reference (one per group),
    keeping centre and orientation; rows made by hand and the reference itself stay."""
    ref = reference.select(F.col(group), F.col(key).alias("_ref"), F.greatest("w", "h").alias("_l"), F.least("w", "h").alias("_s"))
    out = rows.join(ref, group, "left")
    moves = F.col("_ref").isNotNull() & (F.col("_ref") != F.col(key)) & ~F.col("manual")
    wide = F.col("w") >= F.col("h")
    new_w = F.when(moves, F.when(wide, F.col("_l")).otherwise(F.col("_s"))).otherwise(F.col("w"))
    new_h = F.when(moves, F.when(wide, F.col("_s")).otherwise(F.col("_l"))).otherwise(F.col("h"))
    return out.withColumns({"new_w": new_w, "new_h": new_h, "moved": moves}).drop("_ref", "_l", "_s")


def moves(log: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """How often each state is followed by each other one."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    steps = log.withColumn("came_from", before).where(F.col("came_from") != F.col(state))
    return steps.groupBy("came_from", F.col(state).alias("went_to")).agg(F.count("*").alias("n"))
