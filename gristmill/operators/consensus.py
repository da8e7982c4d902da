"""Group consensus: shape, buckets of alike groups, pooled limits, priors and the confidence built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.robust import running

# Ramp end points and weights of the confidence formula.
TRUST, CLAMP, ASPECT = (0.55, 0.85, 0.15, 1.0), (0.03, 0.07, 1.0, 0.4), (0.03, 0.10, 1.0, 0.4)
SCORE, CONTRAST = (0.30, 0.60, 0.6, 1.0), (8.0, 22.0, 0.45)


def ramp(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear from (x0, y0) to (x1, y1), constant outside; a step at x1 if x0 = x1."""
    if x0 == x1:
        return F.when(x >= x1, F.lit(y1)).otherwise(F.lit(y0))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - x0) / (x1 - x0)))
    return y0 + share * (y1 - y0)


def reliability(trust: Column, clamp: Column, aspect: Column) -> Column:
    return ramp(trust, *TRUST) * ramp(clamp, *CLAMP) * ramp(aspect, *ASPECT)


def exposure(contrast: Column) -> Column:
    """An unmeasurable contrast (null) is not a contrast of 0, though both get the floor."""
    low, width, floor = CONTRAST
    return F.when(contrast.isNull(), floor).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(floor), floor + 0.55 * (contrast - low) / width)))


def confidence(size_agree: Column, edge: Column, contrast: Column, roll: Column) -> Column:
    raw = (0.5 * size_agree + 0.5 * edge) * exposure(contrast) * roll
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 3)


def scaled_roll_factor(score: Column, agree: Column) -> Column:
    return F.when(agree < 0.002, 1.0).otherwise(ramp(score, *SCORE))


def scale_accepted(pitch: Column, agree: Column, score: Column, n: Column) -> Column:
    """Agreement decides at both ends, the score in between and where agreement is unknown."""
    need = 0.30 + F.when(n < 3, 0.20).otherwise(0.0)
    return F.coalesce(F.when(pitch.isNull(), False).when(agree > 0.02, False).when(agree < 0.002, True).otherwise(score >= need), F.lit(False))


# Steps of the shape's deviation, and of the area's share for well and badly shaped candidates.
def shape_deviation(width: Column, height: Column, target: float) -> Column:
    """Relative distance of width / height to the nearer of target and 1 / target."""
    aspect = width / height
    return F.least(F.abs(aspect - target) / target, F.abs(aspect - 1 / target) * target)


def candidate_score(deviation: Column, area: Column, wide_margin: Column) -> Column:
    """A product over the shape's deviation, the share of the area and the margin; 3 decimals."""
    shape = F.when(deviation < 0.05, 1.0).when(deviation < 0.15, 0.90).when(deviation < 0.30, 0.65).otherwise(0.3)
    near = F.when((area > 0.20) & (area < 0.99), 1.0).when(area >= 0.99, 0.85).otherwise(0.75)
    far = F.when((area > 0.30) & (area < 0.92), 1.0).when((area > 0.15) & (area < 0.95), 0.75).otherwise(0.4)
    margin = F.when(wide_margin, 1.0).when((deviation < 0.10) & (area > 0.90), 0.90).otherwise(0.8)
    return F.bround(F.least(F.lit(1.0), shape * F.when(deviation < 0.10, near).otherwise(far) * margin), 3)


def candidate_confidence(geometry: Column, edge: Column, interior: Column, exterior: Column, deviation: Column) -> Column:
    evidence = 0.50 * edge + 0.20 * interior + 0.15 * exterior
    return F.bround((0.35 * geometry + 0.65 * evidence) * F.greatest(F.lit(0.7), 1 - 3 * deviation), 3)


def aspect_consensus(rows: DataFrame, by: list[str], aspect: str, contrast: str, tie: str, fallback: float = 1.5) -> DataFrame:
    """Aspects of 1 or more; with three or more, the median of those within 10 % of the one of largest |contrast| (the
    first by `tie`), 4 decimals; else the fallback."""
    norm = rows.where((F.col(aspect) > 0) & F.col(contrast).isNotNull()).withColumn("_a", F.when(F.col(aspect) >= 1, F.col(aspect)).otherwise(1 / F.col(aspect)))
    best = norm.groupBy(*by).agg(F.count("*").alias("n_valid"), F.max(F.struct(F.abs(contrast).alias("c"), (-F.col(tie)).alias("t"), "_a")).alias("_b"))
    near = F.when(F.abs(F.col("_a") - F.col("_b._a")) <= 0.10 * F.col("_b._a"), F.col("_a"))
    out = norm.join(best, by).groupBy(*by, "n_valid").agg(F.median(near).alias("_m"))
    measured = F.col("n_valid") >= 3
    every = rows.select(*by).distinct().join(out, by, "left")
    return every.select(*by, F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.when(measured, F.bround("_m", 4)).otherwise(fallback).alias("aspect_ratio"), F.when(measured, "measured").otherwise("fallback").alias("origin"))


def buckets(groups: DataFrame, value: str, gap: float = 0.08) -> DataFrame:
    """A new bucket wherever a group's value exceeds the previous one's by more than the share `gap`. One row per group
    is sorted, not the rows behind it."""
    order = Window.orderBy(value)
    return groups.withColumn("_new", F.when((F.col(value) - F.lag(value).over(order)) / F.lag(value).over(order) > gap, 1).otherwise(0)).withColumn("bucket", F.sum("_new").over(order)).drop("_new")


def pool_clamp(rows: DataFrame, group: str, bucket: str, value: str, least: int = 10, above: float = 1.03, parts: int = 256) -> DataFrame:
    """Per group: its median, and the median of all other groups in its bucket if they have `least` rows; a median more
    than `above` times the pool's is brought down to it, never up.

    No group meets the others' rows. A bucket's values have running counts; a group's own values cut the line into pieces
    in which the others' count is the bucket's less a constant, so in each piece the others' middle is at a known place of
    the bucket's order. Places are looked up in one pass over values and pieces together, in `parts` blocks of places."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(bucket, group, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(bucket).agg(F.sum("c").alias("total"))
    values = running(counts.groupBy(bucket, value).agg(F.sum("c").alias("c")), [bucket], value, ["c"]).join(totals, bucket)
    values = values.select(bucket, F.col(value).alias("v"), (F.col("_run_c") - F.col("c")).alias("first"), F.col("_run_c").alias("end"), "total")

    line = Window.partitionBy(bucket, group).orderBy(value)
    own = counts.withColumns({"upto": F.sum("c").over(line), "next": F.lead(value).over(line)})
    sizes = own.groupBy(bucket, group).agg(F.sum("c").alias("n"), F.min(value).alias("least"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    own = own.join(sizes.select(bucket, group, "n"), [bucket, group])
    medians = own.groupBy(bucket, group, "n").agg(at(F.floor((F.col("n") - 1) / 2)).alias("lo"), at(F.floor(F.col("n") / 2)).alias("hi")).select(bucket, group, "n", ((F.col("lo") + F.col("hi")) / 2).alias("own"))
    none = F.lit(None).cast(dict(rows.dtypes)[value])
    pieces = own.select(bucket, group, "n", F.col("upto").alias("less"), F.col(value).alias("from"), F.col("next").alias("to"))
    pieces = pieces.unionByName(sizes.select(bucket, group, "n", F.lit(0).cast("long").alias("less"), none.alias("from"), F.col("least").alias("to"))).join(totals, bucket)
    pieces = pieces.withColumn("m", F.col("total") - F.col("n")).where(F.col("m") >= least)
    middle = F.explode(F.array(F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)))
    asked = pieces.withColumn("k", middle).withColumn("place", F.col("k") + F.col("less")).where("place < total")

    block = lambda p: F.floor(p * parts / F.col("total"))
    spread = values.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1)))).select(bucket, "block", F.col("first").alias("at"), "v")
    looked = asked.select(bucket, block(F.col("place")).alias("block"), F.col("place").alias("at"), group, "m", "k", "from", "to")
    both = spread.unionByName(looked, allowMissingColumns=True)
    # a value's first place comes before the places asked for that it covers
    order = Window.partitionBy(bucket, "block").orderBy("at", F.col("m").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("seen", F.last("v", ignorenulls=True).over(order)).where("m is not null")
    fits = (F.col("from").isNull() | (F.col("seen") >= F.col("from"))) & (F.col("to").isNull() | (F.col("seen") < F.col("to")))
    ends = found.where(fits).groupBy(bucket, group, "m", "k").agg(F.min("seen").alias("seen"))
    pool = ends.groupBy(bucket, group, "m").agg(((F.min("seen") + F.max("seen")) / 2).alias("pool"))
    out = medians.join(pool, [bucket, group], "left")
    return out.select(bucket, group, "n", "own", "pool", F.when(F.col("own") > above * F.col("pool"), F.col("pool")).otherwise(F.col("own")).alias("clamped"))


def position_prior(rows: DataFrame, by: list[str], position: str, good: Column) -> DataFrame:
    """The median position over good rows, null if there is none."""
    return rows.groupBy(*by).agg(F.median(F.when(good, F.col(position))).alias("prior"), F.count_if(good).alias("n_good"))


def majority(rows: DataFrame, by: list[str], is_first: Column) -> DataFrame:
    """Whether at least half of a group's rows are of the first kind."""
    return rows.groupBy(*by).agg((2 * F.count_if(is_first) >= F.count("*")).alias("first_kind"))
