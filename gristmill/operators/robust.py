"""Robust statistics per group. Every function takes rows, grouping columns and the value's name, and aggregates on the
map side where the statistic allows it. Order-based ones sort a group's rows by window, which spills; none collects a
group into a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ONE_TASK = 1_000_000  # fixed value: rows of a group that one task may order, spilling where it has to


def median_or_zero(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The median, 0 for a group without values."""
    return rows.groupBy(*by).agg(F.coalesce(F.median(value), F.lit(0.0)).alias("median"))


def upper_median(rows: DataFrame, by: list[str], value: str, least: int = 1) -> DataFrame:
    """The element at n // 2 of the sorted values (from 0), for groups of `least` values or more."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    ranked = rows.where(F.col(value).isNotNull()).withColumns({"_k": F.row_number().over(w) - 1, "_n": n})
    return ranked.where((F.col("_k") == F.floor(F.col("_n") / 2)) & (F.col("_n") >= least)).select(*by, F.col(value).alias("upper_median"), F.col("_n").alias("n"))


def quartile(rows: DataFrame, by: list[str], value: str, q: float = 0.25) -> DataFrame:
    """A linearly interpolated quantile."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("quantile"))


def dense_center(rows: DataFrame, by: list[str], value: str, share: float = 0.035) -> DataFrame:
    """The median inside the densest window of width share * median; leftmost on ties. Up to two values: the median.

    Frame bounds are constants, so values are divided by their group's band first."""
    mids = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).alias("_m"), F.count("*").alias("n"))
    small = mids.where((F.col("n") <= 2) | (F.col("_m") <= 0)).select(*by, F.col("_m").alias("center"), "n")
    big = mids.where((F.col("n") > 2) & (F.col("_m") > 0))
    scaled = rows.join(big, by).withColumn("_v", F.col(value) / (F.col("_m") * share))
    dense = F.count("*").over(Window.partitionBy(*by).orderBy("_v").rangeBetween(0, 1))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_c").desc(), "_v"))
    starts = scaled.withColumn("_c", dense).withColumn("_r", first).where("_r = 1").select(*by, F.col("_v").alias("_lo"))
    inside = scaled.join(starts, by).where("_v between _lo and _lo + 1")
    return inside.groupBy(*by).agg(F.median(value).alias("center"), F.first("n").alias("n")).unionByName(small)


def chains(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Clusters of values whose gaps to the next are at most `width`: chain (from 1, ascending), n, median, low, high."""
    order = Window.partitionBy(*by).orderBy(value)
    gap = F.when(F.col(value) - F.lag(value).over(order) <= width, 0).otherwise(1)
    marked = rows.where(F.col(value).isNotNull()).withColumn("_new", gap).withColumn("chain", F.sum("_new").over(order))
    return marked.groupBy(*by, "chain").agg(F.count("*").alias("n"), F.median(value).alias("median"), F.min(value).alias("low"), F.max(value).alias("high"))


def largest_chain(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """The chain with most values, the first on ties."""
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "chain"))
    return chains(rows, by, value, width).withColumn("_r", best).where("_r = 1").select(*by, "n", "median")


def mad_trust(rows: DataFrame, by: list[str], value: str, full: int = 8) -> DataFrame:
    """Median absolute deviation, its share of the median, and trust max(.4, 1 - 2 spread) * min(1, n / full)."""
    mids = rows.groupBy(*by).agg(F.median(value).alias("center"), F.count(value).alias("n"))
    mad = rows.join(mids, by).groupBy(*by, "center", "n").agg(F.median(F.abs(F.col(value) - F.col("center"))).alias("mad"))
    spread = F.col("mad") / F.col("center")
    trust = F.greatest(F.lit(0.4), 1 - 2 * spread) * F.least(F.lit(1.0), F.col("n") / full)
    return mad.where("center > 0").select(*by, "n", "center", "mad", trust.alias("trust"))


def weighted_median(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """The first value, ascending, at which the running weight reaches half the total."""
    per = rows.groupBy(*by, value).agg(F.sum(weight).alias("_w"))  # equal values first: fewer rows to sort
    run = F.sum("_w").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("_w").over(Window.partitionBy(*by))
    return per.withColumns({"_run": run, "_total": total}).where("_run >= _total / 2").groupBy(*by).agg(F.min(value).alias("weighted_median"))


def weighted_update(prior: float, prior_n: int, value: float, n: int, cap: int = 60) -> tuple[float, int]:
    """A count-weighted mean whose prior counts for `cap` at most."""
    k = min(prior_n, cap)
    return (prior * k + value * n) / (k + n), k + n


def met(rows: DataFrame, few: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of few, by keys that may be null."""
    named = few.withColumnsRenamed({c: f"_key_{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    return rows.join(named, same, how).drop(*(f"_key_{i}" for i in range(len(by))))


def ranged(rows: DataFrame, by: list[str], value: str, parts: int = 256, most: int = ONE_TASK) -> DataFrame:
    """rows with _b, the range of their value: null in groups of at most `most` rows, which are not cut; in others about
    `parts` to a group, cut where a mergeable sketch of its values says. Equal values share a range. Sketches are made,
    and their cuts sent to all tasks, for groups of more than `most` rows only."""
    large = rows.groupBy(*by).agg(F.count("*").alias("_size")).where(F.col("_size") > most)
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    cuts = met(rows, F.broadcast(large), by).groupBy(*by).agg(F.percentile_approx(value, shares, 10_000).alias("_cuts"), F.lit(True).alias("_large"))
    place = F.when(F.col("_large"), F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.lit(0)))
    return met(rows, F.broadcast(cuts), by, "left").withColumn("_b", place).drop("_cuts", "_large")


def running(rows: DataFrame, by: list[str], value: str, totals: list[str], descending: bool = False, ties: tuple[str, ...] = (), most: int = ONE_TASK) -> DataFrame:
    """rows with _run_<t> for each total t: its sum over the rows of the group up to this one, in order of value and ties.
    A group of more than `most` rows is summed by ranges of values first, so that a window holds a range of it."""
    placed = ranged(rows, by, value, most=most)
    way = lambda c: F.col(c).desc() if descending else F.col(c)
    before = Window.partitionBy(*by).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    each = placed.where("_b is not null").groupBy(*by, "_b").agg(*(F.sum(t).alias(f"_of_{t}") for t in totals))
    each = each.select(*by, "_b", *(F.sum(f"_of_{t}").over(before).alias(f"_before_{t}") for t in totals))
    within = Window.partitionBy(*by, "_b").orderBy(way(value), *ties).rowsBetween(Window.unboundedPreceding, 0)
    # at most 256 rows for each group of more than `most`
    out = met(placed, F.broadcast(each), [*by, "_b"], "left").withColumns({f"_run_{t}": F.coalesce(f"_before_{t}", F.lit(0)) + F.sum(t).over(within) for t in totals})
    return out.drop("_b", *(f"_before_{t}" for t in totals))


def bin_of(value: Column) -> Column:
    """A whole number that never falls as the value rises: its sign and the 64th part of an octave it lies in. NaN is last."""
    v = value.cast("double")
    size = lambda x: (F.floor(F.least(F.log2(x), F.lit(1100.0)) * 64) + 100_000).cast("int")
    return F.when(F.isnan(v), 1_000_000).when(v > 0, size(v)).when(v < 0, -size(-v)).when(v == 0, 0)


def median_of_bins(rows: DataFrame, bins: DataFrame, by: list[str], value: str) -> DataFrame:
    """exact_median, from bins (by, _bin, c: how many values `bin_of` puts there)."""
    up = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select(*by, "_bin", F.sum("c").over(up).alias("_upto"), "c", F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = sums.where((F.col("_upto") > low) & (F.col("_upto") - F.col("c") <= high)).select(*by, "_bin", "n", (F.col("_upto") - F.col("c")).alias("_under"))
    near = met(rows.where(F.col(value).isNotNull()).select(*by, value, bin_of(F.col(value)).alias("_bin")), F.broadcast(middle), [*by, "_bin"])
    run = running(near.groupBy(*by, "_bin", "n", "_under", value).agg(F.count("*").alias("c")), [*by, "_bin"], value, ["c"])
    at = lambda k: F.min(F.when(F.col("_under") + F.col("_run_c") > k, F.col(value)))
    ends = run.groupBy(*by, "n").agg(at(low).alias("lo"), at(high).alias("hi"))
    return ends.select(*by, "n", ((F.col("lo") + F.col("hi")) / 2).alias("median"))


def exact_median(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, median of the values that are not null, for groups few enough that two rows of each can go to every task.
    Values are counted in bins, and only those in the bins that hold the middle are counted one by one and ordered, in
    ranges if they are many, so no task holds all values of a group, as it does with an exact percentile."""
    bins = rows.where(F.col(value).isNotNull()).groupBy(*by, bin_of(F.col(value)).alias("_bin")).agg(F.count("*").alias("c"))
    return median_of_bins(rows, bins, by, value)
