"""Choosing rows: top-k, strided samples, precedence, reuse, greedy clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int = 8) -> DataFrame:
    """The first k rows of each group; Spark prunes them before the exchange."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def strided(rows: DataFrame, by: list[str], order: list[str], n: int = 12) -> DataFrame:
    """Every max(1, count // n)-th row of each group, n at most."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    return ranked.where((F.col("_k") % step == 0) & (F.col("_k") / step < n)).drop("_k", "_n")


def precedence(parts: list[DataFrame], key: str, tie: str) -> DataFrame:
    """Union in which the first part that has a key wins."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("priority", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    best = Window.partitionBy(key).orderBy("priority", tie)
    return every.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def reusable(now: DataFrame, before: DataFrame, key: list[str], stamp: str, done: Column) -> DataFrame:
    """now with `reuse`: an earlier result exists for the key, made from the same stamp and complete."""
    old = before.where(done).select(*key, F.col(stamp).alias("_old"))
    return now.join(old, key, "left").withColumn("reuse", F.coalesce(F.col("_old") == F.col(stamp), F.lit(False))).drop("_old")


def leaders(boxes: DataFrame, by: list[str], order: list[str], fields: list[str], within: float) -> DataFrame:
    """Greedy clustering in order: a row joins the first leader from which no field differs by `within` or more, else
    it leads. The order decides, so a group's rows are folded one by one, in a sorted array of that group (a group is
    one item's candidates, a few dozen)."""
    row = F.struct(*(F.col(c) for c in (*order, *fields)))
    group = boxes.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = "array<struct<" + ",".join(f"{f}:double" for f in fields) + ",n:int>>"

    def step(acc: Column, r: Column) -> Column:
        near = lambda lead: F.forall(F.array(*(F.abs(lead[f] - r[f].cast("double")) < within for f in fields)), lambda b: b)
        first = F.array_position(F.transform(acc, near), True)
        grown = F.transform(acc, lambda lead, i: F.struct(*(lead[f].alias(f) for f in fields), F.when(i + 1 == first, lead["n"] + 1).otherwise(lead["n"]).alias("n")))
        lead = F.struct(*(r[f].cast("double").alias(f) for f in fields), F.lit(1).alias("n"))
        return F.when(first > 0, grown).otherwise(F.concat(acc, F.array(lead)))

    folded = group.select(*by, F.aggregate("rows", F.expr(f"cast(array() as {kind})"), step).alias("leads"))
    return folded.select(*by, F.posexplode("leads").alias("leader", "x")).select(*by, "leader", "x.*")


def votes(rows: DataFrame, by: list[str], choice: str, order: list[str]) -> DataFrame:
    """The choice with most rows, ties to the earlier in `order`."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(choice))
    counts = rows.groupBy(*by, choice).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", (-place).alias("p"), choice)).alias("x")).select(*by, F.col(f"x.{choice}").alias(choice), F.col("x.n").alias("n"))
