"""Registered queries read their whole tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import evaluate as ev
from gristmill.plans import catalogue


@pytest.fixture(scope="module")
def items(spark, tmp_path_factory):
    """Line items of orders below and above 2000, with keys of every last digit."""
    at, rng = tmp_path_factory.mktemp("items"), random.Random(4)
    rows = [(o, k, float(rng.randint(1, 50)), rng.randint(0, 10) / 100) for o in (1, 10, 1999, 2000, 2001, 54_321, 600_007) for k in range(1, rng.randint(3, 8))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double").write.parquet(f"{at}/lineitem.parquet")
    return str(at), rows


def test_greedy_leaders_of_every_order(spark, items):
    at, rows = items
    want = []
    for o in {r[0] for r in rows}:
        leads = []
        for _, _, x, d in sorted(r for r in rows if r[0] == o):
            near = next((m for m in leads if abs(m[0] - x) < 10 and abs(m[1] - d * 100) < 10), None)
            if near:
                near[2] += 1
            else:
                leads.append([x, d * 100, 1])
        want += [(o, i, *m) for i, m in enumerate(leads)]
    assert sorted(map(tuple, catalogue.QUERIES["greedy_leaders"](spark, at).select("l_orderkey", "leader", "x", "y", "n").collect())) == sorted(want)


def test_crop_straightened_of_every_order(spark, items):
    at, _ = items
    rows = {(r.l_orderkey, r.l_linenumber): r for r in catalogue.QUERIES["crop_straightened"](spark, at).collect()}
    crops = {(r.l_orderkey, r.l_linenumber) for r in catalogue.QUERIES["crop_orientation"](spark, at).collect()}
    assert rows.keys() == crops and {k[0] % 10 for k in crops} >= {0, 1, 7, 9}
    for (_, k), r in rows.items():
        a, (l, t, right, b) = math.radians(k * 1.5 - 4), r.crop  # noqa: E741
        c, s = abs(math.cos(a)), abs(math.sin(a))
        w, h = 3000 * c + 2000 * s, 3000 * s + 2000 * c

        def moved(box, w0, h0, w1, h1, a):
            x, y = ((box[0] + box[2]) / 2 - 0.5) * w0, ((box[1] + box[3]) / 2 - 0.5) * h0
            bw, bh = min((box[2] - box[0]) * w0, w1), min((box[3] - box[1]) * h0, h1)
            left = min(max(w1 / 2 + x * math.cos(a) - y * math.sin(a) - bw / 2, 0), w1 - bw)
            top = min(max(h1 / 2 + x * math.sin(a) + y * math.cos(a) - bh / 2, 0), h1 - bh)
            return [left / w1, top / h1, (left + bw) / w1, (top + bh) / h1]

        assert r.straight == pytest.approx(moved((l, t, right, b), 3000, 2000, w, h, -a), abs=2e-5)
        assert r.back == pytest.approx(moved(r.straight, w, h, 3000, 2000, a), abs=2e-5)


def test_learned_extent_of_all_orders(spark, tmp_path):
    """Orders whose keys do not divide by 50, many alike; ranked without a window over all rows."""
    rng = random.Random(6)
    prices = [rng.choice([310_000.0, 452_000.5, rng.uniform(200_000, 900_000)]) for _ in range(301)]
    spark.createDataFrame([(50 * i + 1 + i % 49, p) for i, p in enumerate(prices)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    sides = [(max(w, h), min(w, h)) for w, h in ((p / 10007, p / 15013 + 3) for p in prices)]
    fit = [s for s in sides if 0.6 < s[0] / s[1] < 2 and s[0] > 30]
    got = catalogue.QUERIES["learned_extent"](spark, str(tmp_path))
    want = [round(sorted(s[k] for s in fit)[len(fit) // 2], 2) for k in (0, 1)]
    assert [tuple(r) for r in got.select("n", "long_mm", "short_mm").collect()] == [(len(fit), *want)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(side" in plan


def test_learned_extent_of_few(spark):
    rows = spark.createDataFrame([(36.0, 24.0), (36.0, 24.0), (35.0, 25.0), (10.0, 9.0)], "w_mm double, h_mm double")
    assert [tuple(r) for r in ev.learned_extent(rows).select("n", "long_mm", "short_mm").collect()] == [(3, 36.0, 24.0)]
    assert ev.learned_extent(rows, 4).count() == ev.learned_extent(rows.where("false")).count() == 0
