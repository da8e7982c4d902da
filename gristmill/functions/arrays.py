"""Profiles held as arrays of doubles, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def highpass(xs: Column, k: int) -> Column:
    """Each value less the centred moving sum over k (made odd, 3 at least) divided by k; beyond the ends are zeros."""
    k = max(3, int(k) | 1)
    half = k // 2
    near = lambda i: F.slice(xs, F.greatest(F.lit(1), i + 1 - half), F.least(i, F.lit(half)) + half + 1)
    return F.transform(xs, lambda x, i: x - total(near(i)) / k)


def steps(xs: Column) -> Column:
    """Absolute differences of neighbours."""
    return F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.abs(F.element_at(xs, i + 1) - F.element_at(xs, i)))


def outer_peaks(xs: Column, share: float = 0.3) -> Column:
    """First and last place (from 0) whose step exceeds the share of the largest step."""
    def of(d: Column) -> Column:
        high = F.filter(F.transform(d, lambda x, i: F.when(x > share * F.array_max(d), i)), lambda i: i.isNotNull())
        return F.struct(F.array_min(high).alias("first"), F.array_max(high).alias("last"))

    return F.element_at(F.transform(F.array(steps(xs)), of), 1)


def below(xs: Column, level: float) -> Column:
    """First and last place (from 0) whose value lies below the level; nulls if none does."""
    low = F.filter(F.transform(xs, lambda x, i: F.when(x < level, i)), lambda i: i.isNotNull())
    return F.element_at(F.transform(F.array(low), lambda p: F.struct(F.array_min(p).alias("first"), F.array_max(p).alias("last"))), 1)


def longest_run(xs: Column, level: float, least: int = 1) -> Column:
    """Start and length of the first longest run of values above the level; null if shorter than `least`."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(-1).alias("start"), F.lit(0).alias("length"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x > level, a["run"] + 1).otherwise(0)
        better = run > a["length"]
        return F.struct((a["i"] + 1).alias("i"), run.alias("run"), F.when(better, a["i"] - run + 1).otherwise(a["start"]).alias("start"), F.when(better, run).otherwise(a["length"]).alias("length"))

    return F.aggregate(xs, zero, step, lambda a: F.when((a["length"] >= least) & (a["length"] > 0), F.struct(a["start"].alias("start"), a["length"].alias("length"))))


def local_peak(xs: Column, first: int = 2) -> Column:
    """Place (from 0) and value of the first strongest positive value that is above its two neighbours to the left and not
    below those to the right; null if none."""
    at = lambda i: F.element_at(xs, i + 1)
    places = F.filter(F.sequence(F.lit(max(2, first)), F.size(xs) - 3), lambda i: (at(i) > 0) & (at(i) > at(i - 1)) & (at(i) >= at(i + 1)) & (at(i) > at(i - 2)) & (at(i) >= at(i + 2)))
    best = F.array_max(F.transform(places, lambda i: F.struct(at(i).alias("v"), (-i).alias("m"))))
    return F.when(F.size(places) > 0, F.struct((-best["m"]).alias("place"), best["v"].alias("value")))


def autocorrelation(xs: Column, lag: int) -> Column:
    """Mean product of values `lag` apart, over the mean square; 0 for a constant zero."""
    n = F.size(xs)
    pairs = F.zip_with(F.slice(xs, F.lit(1), n - lag), F.slice(xs, F.lit(lag + 1), n - lag), lambda a, b: a * b)
    power = total(F.transform(xs, lambda x: x * x)) / n
    return F.when(power > 0, total(pairs) / (n - lag) / power).otherwise(0.0)


def theil_sen_slope(xs: Column) -> Column:
    """The median slope over all pairs of places. Pairs are formed within one short profile."""
    at = lambda i: F.element_at(xs, i + 1)
    last = F.size(xs) - 1
    slopes = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: (at(j) - at(i)) / (j - i))))
    return F.element_at(F.transform(F.array(F.array_sort(slopes)), lambda s: (F.element_at(s, (F.floor((F.size(s) - 1) / 2) + 1).cast("int")) + F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))) / 2), 1)
