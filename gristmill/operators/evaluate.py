"""Evaluation of scored rows against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.operators.robust import bin_of, exact_median, median_of_bins, running
from gristmill.session import scratch

TOLERANCE = 60.0  # fixed value: pixels at a long edge of 2000


def hit(dw: Column, dh: Column, tolerance: Column | float = TOLERANCE) -> Column:
    """Both size deltas below the tolerance; null deltas are misses."""
    return F.coalesce((F.abs(dw) < tolerance) & (F.abs(dh) < tolerance), F.lit(False))


def strict_hit(dx: Column, dy: Column, dw: Column, dh: Column, tolerance: Column | float = TOLERANCE) -> Column:
    return hit(dw, dh, tolerance) & hit(dx, dy, tolerance)


def tolerance(width: Column, height: Column) -> Column:
    """TOLERANCE, scaled from a long edge of 2000."""
    return TOLERANCE * F.greatest(width, height) / 2000


def band(conf: Column, green: float = 0.5, yellow: float = 0.3) -> Column:
    return F.when(conf >= green, "green").when(conf >= yellow, "yellow").otherwise("red")


def symptom(size_hit: Column, position_hit: Column) -> Column:
    return F.when(size_hit & position_hit, "ok").when(~size_hit & ~position_hit, "size+position").when(~size_hit, "size").otherwise("position at correct size")


def grid_counts(rows: DataFrame, low: int, high: int, step: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (conf, hit) -> per threshold t in hundredths: rows and hits at or above it. Each row is counted once, at the
    highest threshold it meets (a shuffle of one row per group and threshold); a running sum does the rest, instead of
    a join of all rows with the grid."""
    top = (high - low) // step
    t = lambda k: (F.lit(low) + k * step) / F.lit(100.0)
    near = F.least(F.floor((F.col("conf") * 100 - low) / step), F.lit(top)).cast("int")
    # exact against t = k / 100 whatever the rounding of conf * 100
    level = F.when(F.col("conf") < t(near), near - 1).when((near < top) & (F.col("conf") >= t(near + 1)), near + 1).otherwise(near)
    counts = rows.select(*by, level.alias("k"), "hit").where("k >= 0").groupBy(*by, "k").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("h"))
    marks = (rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()).select(*by, F.explode(F.sequence(F.lit(0), F.lit(top))).alias("k"))
    up = Window.partitionBy(*by).orderBy(F.col("k").desc())
    full = marks.join(counts, [*by, "k"], "left")
    return full.select(*by, "k", t(F.col("k")).alias("t"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n"), F.coalesce(F.sum("h").over(up), F.lit(0)).alias("n_hits"))


def sweep(rows: DataFrame, low: int = 25, high: int = 100, step: int = 5) -> DataFrame:
    """t, n, n_hits, precision, recall for thresholds that any row meets."""
    hits = rows.agg(F.sum(F.col("hit").cast("long")).alias("all_hits"))
    out = grid_counts(rows, low, high, step).where("n > 0").crossJoin(F.broadcast(hits))  # one row
    return out.select("t", "n", "n_hits", (F.col("n_hits") / F.col("n")).alias("precision"), (F.col("n_hits") / F.col("all_hits")).alias("recall"))


def smallest_threshold(rows: DataFrame, precision: float, least: int = 5) -> DataFrame:
    """The smallest t of .30 .. 1.00 whose rows are precise enough and many enough; no row if there is none."""
    fit = grid_counts(rows, 30, 100, 1).where((F.col("n") >= least) & (F.col("n_hits") >= precision * F.col("n")))
    return fit.orderBy("t").limit(1).select("t", "n", "n_hits")


def best_recall(rows: DataFrame, precision: float) -> DataFrame:
    """The score at which recall is largest among those precise enough, the highest on ties; from counts per distinct
    score."""
    per = rows.groupBy(F.lit(0).alias("_all"), "conf").agg(F.count("*").alias("_n"), F.sum(F.col("hit").cast("long")).alias("_h"))
    run = running(per, ["_all"], "conf", ["_n", "_h"], descending=True).select("conf", F.col("_run__n").alias("n"), F.col("_run__h").alias("n_hits"))
    return run.where(F.col("n_hits") >= precision * F.col("n")).orderBy(F.col("n_hits").desc(), F.col("conf").desc()).limit(1)


def auc(rows: DataFrame, by: list[str], score: str, positive: str) -> DataFrame:
    """P(score of a positive > score of a negative) + half the ties, from counts per distinct score; null if a class is
    empty."""
    per = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("q"))
    won = running(per, by, score, ["q"]).withColumn("w", F.col("p") * (F.col("_run_q") - F.col("q") + F.col("q") / 2))
    return won.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("w").alias("w")).select(*by, "n_pos", "n_neg", F.try_divide(F.col("w"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def confusion(rows: DataFrame) -> DataFrame:
    """Band by hit or miss, all six cells."""
    cells = rows.groupBy(band(F.col("conf")).alias("band"), "hit").agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    every = spark.createDataFrame([(b, h) for b in ("green", "yellow", "red") for h in (True, False)], "band string, hit boolean")
    return every.join(cells, ["band", "hit"], "left").select("band", "hit", F.coalesce("n", F.lit(0)).alias("n"))


def leave_one_out(rows: DataFrame, group: str, precision: float, least: int = 5) -> DataFrame:
    """Per group: the threshold that smallest_threshold picks on all other groups, and how it does on this one. The
    others' counts are the totals less the group's own, so no group is joined with another's rows."""
    own = grid_counts(rows, 30, 100, 1, (group,))
    total = own.groupBy("k").agg(F.sum("n").alias("tn"), F.sum("n_hits").alias("th"))
    others = own.join(total, "k").withColumns({"on": F.col("tn") - F.col("n"), "oh": F.col("th") - F.col("n_hits")})
    fits = (F.col("on") >= least) & (F.col("oh") >= precision * F.col("on"))
    pick = others.groupBy(group).agg(F.min(F.when(fits, F.struct("t", "n", "n_hits"))).alias("x"))
    size = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    return size.join(pick, group).select(group, F.col("x.t").alias("t"), "n", "hits", F.coalesce("x.n", F.lit(0)).alias("green"), F.coalesce("x.n_hits", F.lit(0)).alias("green_hits"))


def split_eval(rows: DataFrame, tuning: Column, precision: float, least: int = 5) -> DataFrame:
    """The threshold picked on the tuning rows, reported on both parts."""
    parts = rows.withColumn("part", F.when(tuning, "tuning").otherwise("holdout"))
    chosen = smallest_threshold(parts.where("part = 'tuning'"), precision, least).select(F.col("t").alias("chosen"))
    green = F.col("conf") >= F.col("chosen")
    return parts.crossJoin(F.broadcast(chosen)).groupBy("part", F.col("chosen").alias("t")).agg(
        F.count("*").alias("n"), F.count_if(F.col("hit")).alias("hits"), F.count_if(green).alias("green"), F.count_if(green & F.col("hit")).alias("green_hits"))


def bias(rows: DataFrame, deltas: list[str]) -> DataFrame:
    """Per delta column: n, median, mean, min, max. The deltas are written once, as making them may cost more than the two
    scans of them: one that counts and sums bins, one for the values near the middle."""
    folder = scratch(rows.sparkSession, "deltas")
    rows.select(*deltas).write.parquet(folder)
    kept = rows.sparkSession.read.schema(rows.select(*deltas).schema).parquet(folder)
    long = kept.select(F.explode(F.array(*(F.struct(F.lit(d).alias("delta"), F.col(d).alias("v")) for d in deltas))).alias("x")).select("x.*")
    part = [F.count("v").alias("c"), F.sum("v").alias("_sum"), F.min("v").alias("_low"), F.max("v").alias("_high")]
    bins = long.groupBy("delta", bin_of(F.col("v")).alias("_bin")).agg(*part)  # nulls are a bin of their own, of none
    told = bins.groupBy("delta").agg(F.sum("c").alias("n"), F.round(F.try_divide(F.sum("_sum"), F.sum("c")), 6).alias("mean"), F.min("_low").alias("low"), F.max("_high").alias("high"))
    mid = median_of_bins(long, bins.where("c > 0").select("delta", "_bin", "c"), ["delta"], "v").drop("n")
    return told.join(mid, "delta", "left").select("delta", "n", "median", "mean", "low", "high")


def summary(rows: DataFrame, by: str, value: str, hit: str) -> DataFrame:
    """Per value of `by`, which is never null, and for all rows (null): n, hits, median of the value."""
    each = rows.withColumn("_part", F.explode(F.array(F.col(by), F.lit("")))).select("_part", F.col(value).alias("_v"), F.col(hit).alias("_h"))
    counts = each.groupBy("_part").agg(F.count("*").alias("n"), F.count_if("_h").alias("hits"))
    return counts.join(exact_median(each, ["_part"], "_v").select("_part", F.col("median").alias("mid")), "_part", "left").select(F.nullif("_part", F.lit("")).alias(by), "n", "hits", "mid")


def baseline_gate(now: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """now and baseline (key, hits): groups that ran, with whether they fall below their baseline."""
    return now.join(baseline.select(key, F.col("hits").alias("expected")), key).select(key, "hits", "expected", (F.col("hits") < F.col("expected")).alias("worse"))


def weakest_factor(names: list[str]) -> Column:
    """The name of the smallest of the columns, the first named on ties."""
    return F.array_min(F.array(*(F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(names))))["name"]


def learned_extent(rows: DataFrame, least: int = 3) -> DataFrame:
    """rows (w_mm, h_mm) made by hand on reliable scales: upper medians of the long and the short side of frames of the
    usual shape, 2 decimals; no row with fewer than `least`. Counts per distinct value find the hundredth of a millimetre
    that holds the middle, and only its values are ranked."""
    long, short = F.greatest("w_mm", "h_mm"), F.least("w_mm", "h_mm")
    shape = long / F.greatest(short, F.lit(1e-6))
    fit = rows.select(long.alias("l"), short.alias("s")).where((shape > 0.6) & (shape < 2.0) & (F.col("l") > 30))
    both = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("v")), F.struct(F.lit("s").alias("side"), F.col("s").alias("v"))))
    per = fit.select(both.alias("x")).groupBy("x.side", "x.v").agg(F.count("*").alias("k")).withColumn("b", F.floor(F.col("v") * 100))
    up = Window.partitionBy("side").orderBy("b")  # over at most one row per hundredth of a millimetre
    sums = per.groupBy("side", "b").agg(F.sum("k").alias("bk")).withColumns({"upto": F.sum("bk").over(up), "n": F.sum("bk").over(Window.partitionBy("side"))})
    place = F.floor(F.col("n") / 2) + 1
    middle = sums.where((F.col("n") >= least) & (F.col("upto") >= place) & (F.col("upto") - F.col("bk") < place))
    own = Window.partitionBy("side").orderBy("v")
    run = per.join(F.broadcast(middle), ["side", "b"]).withColumn("run", F.col("upto") - F.col("bk") + F.sum("k").over(own))
    at = lambda side: F.bround(F.min(F.when((F.col("side") == side) & (F.col("run") >= place), F.col("v"))), 2)
    return run.groupBy("n").agg(at("l").alias("long_mm"), at("s").alias("short_mm"))


def scaled_reference(box: Column, width: Column, height: Column, edge: int = 2000) -> Column:
    """A box struct in pixels, scaled so that the long edge is `edge`, half to even."""
    k = edge / F.greatest(width, height).cast("double")
    return F.struct(*(F.bround(box[c] * k).cast("int").alias(c) for c in ("x", "y", "width", "height")))
