"""Logistic models of many sets of groups at once, fitted by sums over all rows: no group is gathered in a task."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.state import least_threshold
from gristmill.session import scratch

MOST_GROUPS = 64


def groups_of(rows: DataFrame, group: str) -> list:
    """The groups in order; an error if there are more than MOST_GROUPS, as there is a model for each two of them."""
    found = [r[0] for r in rows.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(MOST_GROUPS + 1).collect()]
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of {group}")
    return found


def numbered(rows: DataFrame, group: str, names: list, features: list[str], hit: str) -> DataFrame:
    """g (the group's number), x (the features), y of the rows of these groups that have all of them; written once to the
    shared folder, as each step reads them."""
    spark = rows.sparkSession
    number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(group)) - 1
    fine = F.forall(F.array(*(F.col(f).cast("double") for f in features)), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    out = rows.where(F.col(group).isNotNull() & F.col(hit).isNotNull() & fine).select(number.cast("int").alias("g"), F.array(*(F.col(f).cast("double") for f in features)).alias("x"), F.col(hit).cast("double").alias("y"))
    path = scratch(spark, "models")
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


class Models:
    """members: which groups (second axis) each model (first) is of."""

    def __init__(self, rows: DataFrame, members: np.ndarray, d: int, l2: float = 0.5, steps: int = 60):
        self.members = members
        count, hits, mean, square = self._moments(rows, d)
        n = np.maximum(members @ count, 1)
        self.n, self.hits = members @ count, members @ hits
        self.mean = (members @ (mean * count[:, None])) / n[:, None]
        # squares about each group's mean, and of the groups' means about the model's
        apart = np.einsum("mg,mgd->md", members * count, (mean[None] - self.mean[:, None]) ** 2)
        self.scale = np.sqrt((members @ square + apart) / n[:, None]) + 1e-9
        self.weights = np.zeros((len(members), d + 1))
        both = (self.hits > 0) & (self.hits < self.n)
        alone = ~both & (self.n > 0)
        self.weights[alone, d] = np.log((self.hits[alone] + 0.5) / (self.n[alone] - self.hits[alone] + 0.5))
        self._newton(rows, both, l2, steps)

    def _moments(self, rows: DataFrame, d: int):
        """Of each group: rows, hits, means, and sums of squares about the means."""
        per = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("y").alias("h"), *(F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)), *(F.var_pop(F.col("x")[k]).alias(f"v{k}") for k in range(d)))
        k = self.members.shape[1]
        count, hits, mean, square = np.zeros(k), np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
        for r in per.collect():
            count[r["g"]], hits[r["g"]] = r["n"], r["h"]
            mean[r["g"]], square[r["g"]] = r[3 : 3 + d], np.array(r[3 + d :]) * r["n"]
        return count, hits, mean, square

    def _z(self, x: np.ndarray, m: int) -> np.ndarray:
        return np.column_stack([(x - self.mean[m]) / self.scale[m], np.ones(len(x))])

    def _sums(self, rows: DataFrame, weights: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of each of these models: the loss, its gradient and its Hessian, summed over its rows."""
        d = weights.shape[1]
        width, z, members = 1 + d + d * d, self._z, self.members

        def run(batches):
            total = np.zeros((len(which), width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                g, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(len(g), -1)
                for i, m in enumerate(which):
                    own = members[m][g]
                    if own.any():
                        v, t = z(x[own], m), y[own]
                        s = np.clip(v @ weights[m], -40, 40)
                        p = 1 / (1 + np.exp(-s))
                        total[i] += np.concatenate([[np.logaddexp(0, s).sum() - t @ s], v.T @ (p - t), ((v * (p * (1 - p))[:, None]).T @ v).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

        out = np.zeros(len(which) * width)
        for r in rows.select("g", "x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(len(which), width)

    def _newton(self, rows: DataFrame, open_: np.ndarray, l2: float, steps: int) -> None:
        """Newton steps of all models at once; a model whose loss did not fall halves its step."""
        d = self.weights.shape[1]
        ridge = np.diag([l2] * (d - 1) + [1e-9])
        which = np.flatnonzero(open_)
        tried, state, length = self.weights.copy(), {}, dict.fromkeys(which.tolist(), 1.0)
        for _ in range(steps):
            if not len(which):
                return
            still = []
            for m, sums in zip(which.tolist(), self._sums(rows, tried, which), strict=True):
                w = tried[m]
                loss = sums[0] + w @ ridge @ w / 2
                if m not in state or loss <= state[m][0]:
                    step = np.linalg.solve(sums[1 + d :].reshape(d, d) + ridge, sums[1 : 1 + d] + ridge @ w)
                    state[m], length[m] = (loss, step), 1.0
                    self.weights[m] = w
                else:
                    length[m] /= 2
                move = length[m] * state[m][1]
                if np.abs(move).max() > 1e-9:
                    tried[m] = self.weights[m] - move
                    still.append(m)
            which = np.array(still, int)

    def scored(self, rows: DataFrame, of: list[list[tuple[int, int]]]) -> DataFrame:
        """rows -> g, y, left, score: for a row of group g, one for each (left, model) of of[g]. A model without rows says
        0.5."""
        z, weights = self._z, self.weights

        def run(batches):
            for batch in batches:
                g, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                x = batch.column(1).flatten().to_numpy().reshape(len(g), -1)
                for k in np.unique(g):
                    own = g == k
                    for left, m in of[k]:
                        score = 1 / (1 + np.exp(-np.clip(z(x[own], m) @ weights[m], -40, 40)))
                        yield pa.RecordBatch.from_arrays([pa.array(g[own]), pa.array(y[own]), pa.array(np.full(own.sum(), left, np.int32)), pa.array(score)], names=["g", "y", "left", "score"])

        return rows.select("g", "x", "y").mapInArrow(run, "g int, y double, left int, score double")


def fitted(features: list[str], l2: float = 0.5) -> Callable[[DataFrame, str, list], DataFrame]:
    """A scorer that learns: (rows, group, names) -> g, y, left, score, where a row of group g is scored for each group
    left out by a model that has seen neither. There is a model without each group and one without each two, at most
    MOST_GROUPS * (MOST_GROUPS + 1) / 2, all fitted together: a Newton step is one scan that sends a few numbers for each
    model and task."""

    def seen(rows: DataFrame, group: str, names: list) -> DataFrame:
        k = len(names)
        data = numbered(rows, group, names, features, "hit")
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        at = {p: m for m, p in enumerate(pairs)}
        members = np.ones((len(pairs), k), bool)
        for m, (i, j) in enumerate(pairs):
            members[m, [i, j]] = False
        of = [[(left, at[min(left, g), max(left, g)]) for left in range(k)] for g in range(k)]
        return Models(data, members, len(features), l2).scored(data, of)

    return seen


def fixed(formula: Column) -> Callable[[DataFrame, str, list], DataFrame]:
    """A scorer that learns nothing: its formula, the same whatever is left out. Rows without a score are left out."""

    def seen(rows: DataFrame, group: str, names: list) -> DataFrame:
        number = F.array_position(F.array(*(F.lit(n) for n in names)), F.col(group)) - 1
        score = formula.cast("double")
        fine = rows.where(F.col(group).isNotNull() & F.col("hit").isNotNull() & score.isNotNull() & ~F.isnan(score))
        lefts = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("left")
        told = fine.select(number.cast("int").alias("g"), F.col("hit").cast("double").alias("y"), score.alias("score"))
        return told.select("g", "y", lefts, "score")

    return seen


def compared(rows: DataFrame, group: str, scorers: dict[str, Callable[[DataFrame, str, list], DataFrame]], precision: float, least: int = 5) -> DataFrame:
    """Per scorer and group left out: the threshold picked on the scores of the other groups' rows, and how it does on the
    group itself. rows (group, hit and what the scorers read) are labelled references. Each row is scored once for each
    group, and scores are counted before they are shuffled."""
    names = groups_of(rows, group)
    if not names:
        empty = f"scorer string, {group} {dict(rows.dtypes)[group]}, t double, n long, hits long, green long, green_hits long"
        return rows.sparkSession.createDataFrame([], empty)
    parts = [f(rows, group, names).select(F.lit(name).alias("scorer"), "g", "y", "left", "score") for name, f in scorers.items()]
    seen = reduce(DataFrame.unionByName, parts).withColumn("hit", F.col("y") == 1)
    inner = least_threshold(seen.where("left <> g"), ["scorer", "left"], "score", "hit", precision, least).select("scorer", F.col("left").alias("g"), "t")
    own = seen.where("left = g").join(inner, ["scorer", "g"], "left")
    green = F.coalesce(F.col("score") >= F.col("t"), F.lit(False))
    out = own.groupBy("scorer", "g").agg(F.first("t").alias("t"), F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if(green).alias("green"), F.count_if(green & F.col("hit")).alias("green_hits"))
    return out.select("scorer", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("g") + 1).alias(group), "t", "n", "hits", "green", "green_hits")


def nested_leave_one_out(rows: DataFrame, group: str, features: list[str], precision: float, least: int = 5) -> DataFrame:
    """`compared` for one logistic model of these features; rows with nulls among them are left out."""
    return compared(rows, group, {"": fitted(features)}, precision, least).drop("scorer")


def logistic_by_group(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Per group: n, and the weights (of standardised features) and bias of a model of its own."""
    names = groups_of(rows, group)
    models = Models(numbered(rows, group, names, features, "hit"), np.eye(len(names), dtype=bool), len(features))
    out = [(n, int(models.n[i]), *(round(float(w), 6) for w in models.weights[i])) for i, n in enumerate(names) if models.n[i]]
    schema = f"{group} {dict(rows.dtypes)[group]}, n long, {', '.join(f'w_{f} double' for f in features)}, bias double"
    return rows.sparkSession.createDataFrame(out, schema)
