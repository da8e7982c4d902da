"""Sums over partitions against plain loops: medians, running totals, pools and models."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.functions.raster import fit_logistic
from gristmill.operators import consensus as co
from gristmill.operators import models
from gristmill.operators import robust as ro


def test_medians_and_running_totals(spark):
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, m)) if rng.random() > 0.1 else None) for g, m in (("a", 3), ("b", 5000), (None, 40), ("c", 1)) for _ in range(700 if g != "c" else 1)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r["median"]) for r in ro.exact_median(df, ["g"], "v").collect()}
    for g in ("a", "b", None, "c"):
        vs = [v for k, v in rows if k == g and v is not None]
        assert not vs or got[g] == (len(vs), statistics.median(vs))
    ones = df.where("v is not null").withColumn("k", F.lit(1))
    for down in (False, True):
        run = ro.running(ones, ["g"], "v", ["k"], descending=down).groupBy("g", "v").agg(F.max("_run_k").alias("r")).collect()
        assert all(r.r == sum(1 for k, v in rows if k == r.g and v is not None and (v >= r.v if down else v <= r.v)) for r in run)


@pytest.mark.parametrize("parts", [1, 7, 256])
def test_pools_of_other_groups(spark, parts):
    rng = random.Random(parts)
    rows = [(b, g, float(rng.choice([rng.randint(0, 30), 5])) if rng.random() > 0.05 else None) for b in range(3) for g in range(b, b + 6) for _ in range(rng.randint(1, 40))]
    rows += [(9, 1, 4.0)] * 3 + [(9, 2, 1.0)] * 12 + [(8, 1, 2.0)]
    got = {(r.b, r.g): (r.n, r.own, r.pool, r.clamped) for r in co.pool_clamp(spark.createDataFrame(rows, "b int, g int, v double"), "g", "b", "v", parts=parts).collect()}
    want = {}
    for b, g in {(b, g) for b, g, v in rows if v is not None}:
        own, others = ([v for x, y, v in rows if v is not None and x == b and (y == g) == same] for same in (True, False))
        pool = statistics.median(others) if len(others) >= 10 else None
        mine = statistics.median(own)
        want[b, g] = (len(own), mine, pool, pool if pool is not None and mine > 1.03 * pool else mine)
    assert got == want


def nested_plainly(data, features, precision, least=5):
    """Each model anew, on the rows it may see."""

    def scores(train, test):
        if not len(train):
            return np.full(len(test), 0.5)
        w, b, mean, scale = fit_logistic(train[features].to_numpy(), train["hit"].to_numpy(float))
        return 1 / (1 + np.exp(-((test[features].to_numpy() - mean) / scale @ w + b)))

    out = {}
    for left in sorted(data["g"].unique()):
        own, others = data[data.g == left], data[data.g != left]
        parts = [part.assign(score=scores(others[others.g != g], part)) for g, part in others.groupby("g")]
        inner = pd.concat(parts) if parts else others.assign(score=0.5)
        cuts = sorted(inner["score"].round(4).unique())
        t = next((c for c in cuts if (inner.score >= c).sum() >= least and inner[inner.score >= c]["hit"].mean() >= precision), None)
        green = own[scores(others, own) >= t] if t is not None else own[:0]
        out[left] = (t, len(own), int(own.hit.sum()), len(green), int(green.hit.sum()))
    return out


@pytest.mark.parametrize("groups", [1, 2, 4])
def test_nested_models(spark, groups):
    rng = np.random.default_rng(groups)
    n = 240
    data = pd.DataFrame({"g": rng.choice([f"g{i}" for i in range(groups)], n), "a": rng.normal(0, 1, n), "b": rng.normal(5, 3, n)})
    data["hit"] = data.a + 0.2 * data.b + rng.normal(0, 0.7, n) > 0.8
    if groups == 4:
        data.loc[data.g == "g3", "hit"] = True
    df = spark.createDataFrame(data).repartition(3)
    got = {r.g: r for r in models.nested_leave_one_out(df, "g", ["a", "b"], 0.9).collect()}
    want = nested_plainly(data, ["a", "b"], 0.9)
    assert set(got) == set(want)
    for g, (t, *counts) in want.items():
        assert [got[g].n, got[g].hits, got[g].green, got[g].green_hits] == counts
        assert got[g].t is None if t is None else abs(got[g].t - t) < 1e-4


def test_models_of_groups(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 300), "a": rng.normal(2, 1, 300), "b": rng.normal(0, 9, 300)})
    data["hit"] = (data.a > 2) ^ (rng.random(300) < 0.2)
    data.loc[data.g == "z", "hit"] = False
    got = {r.g: r for r in models.logistic_by_group(spark.createDataFrame(data), "g", ["a", "b"]).collect()}
    for g, part in data.groupby("g"):
        w, b, _, _ = fit_logistic(part[["a", "b"]].to_numpy(), part.hit.to_numpy(float))
        assert np.allclose([got[g].w_a, got[g].w_b, got[g].bias], [*w, b], atol=1e-5) and got[g].n == len(part)
    many = spark.range(100).selectExpr("id as g", "1.0 as a", "true as hit")
    with pytest.raises(ValueError):
        models.logistic_by_group(many, "g", ["a"])
    assert models.logistic_by_group(many.where("false"), "g", ["a"]).count() == 0
