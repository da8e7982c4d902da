"""Rolls and sessions against plain versions."""

import random
import statistics

from pyspark.sql import functions as F

from gristmill.operators import rolls as ro


def test_film_analysis_by_hand(spark):
    rng, rows = random.Random(3), []
    for film in "abcdef":
        for image in range(rng.randint(1, 12)):
            rows.append((film, image, True, rng.choice([0.0, 300.0, 310.0, 200.0]), float(rng.randint(190, 210))))
            rows += [(film, image, False, float(rng.randint(100, 320)), 200.0) for _ in range(rng.randint(0, 3))]
    rows.append(("none", 1, True, 0.0, 5.0))
    want = {}
    for film in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == film]
        sized = [(max(w / h, h / w), ref, w, h) for _, _, ref, w, h in own if w and h]
        values, best = sorted(a for a, *_ in sized), (None, 0)
        for width in (0.03, 0.05, 0.10, 0.15):
            runs = []
            for v in values:
                if runs and v - runs[-1][-1] <= width:
                    runs[-1].append(v)
                else:
                    runs.append([v])
            top = max(runs, key=len, default=[])
            if len(top) > best[1]:
                best = statistics.median(top), len(top)
        near = [(w, h) for a, ref, w, h in sized if ref and abs(a - best[0]) / max(best[0], 0.1) < 0.15]
        near = near or [(max(w, h), min(w, h)) for _, ref, w, h in sized if ref]
        size = tuple(int(statistics.median(x)) for x in zip(*near, strict=True)) if near else (None, None)
        want[film] = (None if best[0] is None else round(best[0], 4), *size, len({r[1] for r in own}), len(sized), best[1], round(best[1] / max(len(sized), 1), 2))
    table = spark.createDataFrame(rows, "film string, image int, refined boolean, w double, h double")
    assert {r.film: tuple(r)[1:] for r in ro.film_analysis(table, "film", "image").collect()} == want


def test_one_frame_needs_an_accepted_scale(spark):
    rows = spark.createDataFrame([(f, 300.0, 200.0) for f in "abc"] + [("d", 200.0, x) for x in (300.0, 303.0, 500.0)], "film string, w double, h double")
    known = spark.createDataFrame([("a", 0.1, 0.001, 0.0, None), ("b", 0.1, 0.01, 0.4, 0.5)], "film string, pitch double, agree double, score double, aspect double")
    got = {r.film: tuple(r)[1:] for r in ro.roll_sizes(rows, "film", known).collect()}
    assert got == {"a": (1, 300.0, 200.0, 1.5), "d": (3, 301.5, 200.0, 301.5 / 200)}


def test_undo_of_several_images(spark):
    history = spark.createDataFrame([("s", 1, 1), ("s", 1, 2), ("s", 2, 2), ("s", 2, 3), ("s", 3, 4), ("t", 1, 2)], "session string, op int, id int")
    back = lambda chosen=None: sorted(tuple(r)[:3] for r in ro.undone(history, ["session"], "op", "id", chosen).select("session", "op", "id", "reverted").where("reverted").collect())
    assert back() == [("s", 3, 4), ("t", 1, 2)]
    assert back(spark.createDataFrame([("s", 1), ("s", 2)], "session string, id int")) == [("s", 2, 2)]
    assert back(spark.createDataFrame([("s", 9)], "session string, id int")) == []
    assert ro.undone(history, ["session"], "op", "id").count() == 6


def test_tables_without_rows(spark):
    rows = spark.createDataFrame([], "film string, image int, refined boolean, w double, h double")
    known = spark.createDataFrame([], "film string, pitch double, agree double, score double, aspect double")
    assert ro.film_analysis(rows, "film", "image").count() == ro.roll_sizes(rows, "film", known).count() == 0
    lines = spark.createDataFrame([("r", 1, "WARN: x")], "run string, n int, line string")
    assert tuple(ro.progress(lines, ["run"], "n").first()) == ("r", None, None, None, None, None, None, 1)
    assert ro.head_of(rows.select("film"), ["film"]).count() == 0


def test_reference_box_is_turned_back(spark):
    crop = F.array(*map(F.lit, (0.25, 0.25, 0.75, 0.75)))
    of = lambda r: tuple(spark.range(1).select(ro.reference_box(crop, F.lit(r), F.lit(400.0), F.lit(200.0)).alias("b")).first().b)
    assert of(None) == of(0.0005) == (100, 50, 200, 100)
    assert of(90.0) == (150, 0, 100, 200)
