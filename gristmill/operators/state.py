"""Changes of a session's state, the joins of its read model, and small summaries, as projections and keyed joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.robust import running

# Tolerances of size and place against the roll, and the dead zone of a bias in pixels.
SIZE_OK, GOOD, PLACE_OK, DEAD_ZONE = 0.20, 0.15, 0.12, 2


def freeze(entries: DataFrame, by: list[str], key: str, fields: list[str]) -> DataFrame:
    """One row per plan (by): its entries' number, the SHA-256 of their canonical JSON in order of key, and complete. A
    plan's entries are gathered in a row, as its document holds them; nothing else is."""
    entry = F.to_json(F.struct(*(F.col(c) for c in sorted([key, *fields]))), {"ignoreNullFields": "false"})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), entry.alias("e")))), lambda x: x["e"])
    frozen = F.sha2(F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")), 256)
    return entries.groupBy(*by).agg(F.count("*").alias("n"), frozen.alias("plan_sha256"), F.lit(True).alias("complete"))


def add_images(known: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """items (by, path) that known (by, id, path) lacks, once each, with ids that continue at the largest, in order of
    path, the status pending and the phase analyzing; what is known stays as it is."""
    top = known.groupBy(by).agg(F.max("id").alias("_top"))
    new = items.select(by, "path").distinct().join(known.select(by, "path"), [by, "path"], "left_anti").join(top, by, "left")
    nth = F.row_number().over(Window.partitionBy(by).orderBy("path"))
    return new.select(by, (F.coalesce("_top", F.lit(0)) + nth).cast("long").alias("id"), "path", F.lit("pending").alias("status"), F.lit("analyzing").alias("phase"))


def detected(images: DataFrame, results: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Detections by key over images (key, method, status, error, fields): what was made by hand keeps its fields, and
    an image without a result gets an error."""
    new = results.select(key, F.lit(True).alias("_met"), *(F.col(f).alias(f"_n_{f}") for f in fields))
    both = images.join(new, key, "left")
    manual = F.coalesce(F.col("method") == "manual", F.lit(False))
    missed = F.col("_met").isNull()
    kept = [F.when(manual | missed, F.col(f)).otherwise(F.col(f"_n_{f}")).alias(f) for f in fields]
    return both.select(key, "method", *kept, F.when(missed, "error").otherwise("ok").alias("status"), F.when(missed, "no result").alias("error"))


def accepted(images: DataFrame, proposals: DataFrame, accept: DataFrame, key: str, value: str) -> DataFrame:
    """Proposals stay beside the value until their key is among accept's, when they take its place."""
    both = images.join(proposals.select(key, F.col(value).alias("proposal")), key, "left").join(accept.select(key, F.lit(True).alias("_yes")), key, "left")
    takes = F.col("_yes") & F.col("proposal").isNotNull()
    return both.withColumns({value: F.when(takes, F.col("proposal")).otherwise(F.col(value)), "accepted": F.coalesce(takes, F.lit(False)), "proposal": F.when(F.coalesce(takes, F.lit(False)), F.lit(None)).otherwise(F.col("proposal"))}).drop("_yes")


def retried(images: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Those named are pending again and without an error."""
    both = images.join(ids.select(key, F.lit(True).alias("_again")), key, "left")
    return both.withColumns({"status": F.when(F.col("_again"), "pending").otherwise(F.col("status")), "error": F.when(F.col("_again"), F.lit(None)).otherwise(F.col("error"))}).drop("_again")


def analysis_done(images: DataFrame) -> DataFrame:
    """What is still pending has failed."""
    left = F.col("status") == "pending"
    return images.withColumns({"error": F.when(left, "not analysed").otherwise(F.col("error")), "status": F.when(left, "error").otherwise(F.col("status"))})


def settings(green: Column, yellow: Column) -> Column:
    """Thresholds to 3 decimals, yellow no higher than green."""
    g, y = F.bround(green, 3), F.bround(yellow, 3)
    return F.struct(g.alias("t_green"), F.least(y, g).alias("t_yellow"))


def stale(mode: Column, size: Column, mtime: Column, size_now: Column, mtime_now: Column) -> Column:
    """The file is gone or differs in size or in time to a thousandth; in folder mode nothing is stale."""
    at = lambda t: F.bround(t, 3)
    return (mode != "folder") & (size_now.isNull() | ~size.eqNullSafe(size_now) | ~at(mtime).eqNullSafe(at(mtime_now)))


def enriched(images: DataFrame, results: DataFrame, references: DataFrame, path: str, key: str) -> DataFrame:
    """images with the earlier detection of their path and the reference of their key, where there is one."""
    return images.join(results, path, "left").join(references, key, "left")


def reported(plan: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """plan with the target's status, ok where it says nothing; only what is ok or skipped counts as applied."""
    return plan.join(report.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("ok"))).withColumn("counts", F.col("status").isin("ok", "skipped"))


def without_reference(images: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return images.join(references.select(key).distinct(), key, "left_anti")


def near_size(w: Column, h: Column, long: Column, short: Column, share: float = SIZE_OK) -> Column:
    """Both sides within the share of the roll's; share GOOD for what may teach the roll."""
    return (F.abs(F.greatest(w, h) - long) <= share * long) & (F.abs(F.least(w, h) - short) <= share * short)


def near_place(cx: Column, cy: Column, roll_cx: Column, roll_cy: Column) -> Column:
    """The centre, as shares of the image, lies near the roll's; true where the roll has none."""
    return roll_cx.isNull() | ((F.abs(cx - roll_cx) < PLACE_OK) & (F.abs(cy - roll_cy) < PLACE_OK))


def roll_evidence(fits: DataFrame, by: str) -> DataFrame:
    """fits (by, edge, dw, dh) -> the median edge, and the larger of the medians' distances from 0 as the pull."""
    return fits.groupBy(by).agg(F.median("edge").alias("edge"), F.greatest(F.abs(F.median("dw")), F.abs(F.median("dh"))).alias("pull"))


def correction_summary(diffs: DataFrame, by: list[str], axes: dict[str, tuple[str, str]]) -> DataFrame:
    """Per axis of corrections the least, largest, mean and median, and which way detections lean: axes maps a column to
    what a mean below and above the dead zone is called."""
    aggs = []
    for c, (low, high) in axes.items():
        mean = F.avg(c)
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.bround(mean, 6).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.when(mean < -DEAD_ZONE, low).when(mean > DEAD_ZONE, high).otherwise("ok").alias(f"{c}_bias")]
    return diffs.groupBy(*by).agg(*aggs)


def least_threshold(rows: DataFrame, by: list[str], score: str, hit: str, target: float, least: int = 5) -> DataFrame:
    """Per group the smallest of its scores, rounded to 4 decimals, at or above which at least `least` rows lie and the
    share of hits reaches the target. Rows are counted per score first; candidates and counts then meet in one order.
    A score's ten thousands are rounded half to even as the double they are, as SQL does; bround would round its digits."""
    x, zero = F.col(score).cast("double"), F.lit(0).cast("long")
    counted = F.struct(x.alias("_x"), F.lit(0).alias("_mark"), F.lit(1).cast("long").alias("_n"), F.col(hit).cast("long").alias("_h"))
    mark = F.struct((F.rint(x * 10000) / 10000).alias("_x"), F.lit(1).alias("_mark"), zero.alias("_n"), zero.alias("_h"))
    both = rows.select(*by, F.explode(F.array(counted, mark)).alias("_r")).select(*by, "_r.*").groupBy(*by, "_x", "_mark").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"))
    both = running(both, by, "_x", ["_n", "_h"], descending=True, ties=("_mark",))
    both = both.withColumnsRenamed({"_run__n": "n_above", "_run__h": "hits"})
    good = both.where((F.col("_mark") == 1) & (F.col("n_above") >= least) & (F.col("hits") >= target * F.col("n_above")))
    best = F.min(F.struct(F.col("_x").alias("t"), "n_above", "hits"))
    return good.groupBy(*by).agg(best.alias("b")).select(*by, "b.t", "b.n_above", "b.hits")


def first_errors(rows: DataFrame, by: list[str], order: list[str], most: int = 8) -> DataFrame:
    """Rows with an error before others, each in order; the first `most` of a group."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("error").isNull(), *order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)


def relabelled(labels: Column, remove: Column, add: Column) -> Column:
    """A sorted set of labels less some, with one more."""
    return F.sort_array(F.array_union(F.array_except(labels, remove), F.array(add)))


def updated(old: Column, new: Column) -> Column:
    """A map with another's entries over its own."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
