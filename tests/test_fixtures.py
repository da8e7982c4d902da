"""Small inputs with known results."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.functions import geometry as ge
from gristmill.functions import detect, raster
from gristmill.functions import text as tx
from gristmill.operators import consensus as co
from gristmill.operators import evaluate as ev
from gristmill.operators import review as rv
from gristmill.operators import robust as ro
from gristmill.operators import selection as se
from gristmill.sources import files as fs


def strip(seed: int, pitch: float, phase: float = 0.0, height: int = 534, width: int = 800) -> np.ndarray:
    """A noisy strip with bright holes every `pitch` pixels near its long edges, and a frame's worth of content."""
    rng = np.random.default_rng(seed)
    g = 90 + rng.normal(0, 6, (height, width))
    g[height // 4 : -height // 4, width // 8 : -width // 8] += 40
    for x in np.arange(phase, width - 10, pitch):
        for top in (int(height * 0.02), int(height * 0.93)):
            g[top : top + 20, int(x) : int(x) + 9] = 235
    return np.clip(g, 0, 255).astype(np.uint8)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_bands(spark):
    df = spark.createDataFrame([(0.9,), (0.4,), (0.1,), (0.5,), (0.3,), (None,)], "c double")
    assert [r[0] for r in df.select(ev.band(F.col("c"))).collect()] == ["green", "yellow", "red", "green", "yellow", "red"]


def test_hits(spark):
    df = spark.createDataFrame([(200.0, 0.0, 0.0, 0.0), (0.0, 0.0, 59.9, 0.0), (0.0, 0.0, 60.0, 0.0), (0.0, 0.0, None, 0.0)], "dx double, dy double, dw double, dh double")
    got = df.select(ev.hit(F.col("dw"), F.col("dh")), ev.strict_hit(*(F.col(c) for c in ("dx", "dy", "dw", "dh")))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, True), (False, False), (False, False)]


def test_scale_gate(spark):
    cases = [(1.0, 0.001, 0.0, 9, True), (1.0, 0.05, 0.9, 9, False), (1.0, 0.001, 0.15, 9, True), (1.0, 0.008, 0.15, 9, False), (1.0, 0.008, 0.5, 9, True), (1.0, None, 0.1, 9, False), (1.0, None, 0.35, 2, False), (None, 0.001, 0.9, 9, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p double, a double, s double, n int, want boolean")
    got = df.select("i", "want", co.scale_accepted(F.col("p"), F.col("a"), F.col("s"), F.col("n")).alias("got")).orderBy("i").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_convention():
    assert ro.weighted_update(36.0, 30, 37.0, 10) == (36.25, 40)


def test_dense_center_against_brute_force(spark):
    rng = random.Random(3)
    groups = {g: [round(rng.gauss(100, 8) + 60 * (rng.random() < 0.2), 2) for _ in range(rng.randint(1, 30))] for g in range(40)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, v double")

    def brute(vs):
        vs = sorted(vs)
        mid = statistics.median(vs)
        if len(vs) <= 2:
            return mid
        best = max(range(len(vs)), key=lambda i: (sum(vs[i] <= w <= vs[i] + 0.035 * mid for w in vs), -i))
        return statistics.median([w for w in vs if vs[best] <= w <= vs[best] + 0.035 * mid])

    got = {r.g: r.center for r in ro.dense_center(df, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    assert all(abs(got[g] - brute(vs)) < 1e-9 for g, vs in groups.items())


def test_robust_on_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (1, 4.0), (2, None)], "g int, v double")
    assert values(ro.median_or_zero(df, ["g"], "v"), "g", "median") == [(1, 4.0), (2, 0.0)]
    none = df.where("g = 9")
    assert ro.dense_center(none, ["g"], "v").count() == ro.chains(none, ["g"], "v", 1).count() == ro.weighted_median(none, ["g"], "v", "v").count() == 0


def test_leaders_against_brute_force(spark):
    rng = random.Random(1)
    boxes = [(g, k, rng.uniform(0, 40), rng.uniform(0, 40)) for g in range(12) for k in range(rng.randint(1, 9))]
    got = {}
    for r in se.leaders(spark.createDataFrame(boxes, "g int, k int, x double, y double"), ["g"], ["k"], ["x", "y"], 12.0).collect():
        got.setdefault(r.g, []).append((r.leader, r.x, r.y, r.n))
    for g in {b[0] for b in boxes}:
        leads = []
        for _, _, x, y in sorted(b for b in boxes if b[0] == g):
            near = next((m for m in leads if abs(m[0] - x) < 12 and abs(m[1] - y) < 12), None)
            if near:
                near[2] += 1
            else:
                leads.append([x, y, 1])
        assert sorted(got[g]) == [(i, *m) for i, m in enumerate(leads)]


def test_auc_is_pairwise(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 9) / 3, rng.random() < 0.4) for _ in range(90)]
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in p for b in q) / len(p) / len(q)
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 1.0, True)], "g string, s double, y boolean")
    got = {r.g: r.auc for r in ev.auc(df, ["g"], "s", "y").collect()}
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_roll_size(spark):
    df = spark.createDataFrame([(1, "r", 0.5, 0.5, 0.6, 0.4, False), (2, "r", 0.5, 0.5, 0.3, 0.5, False), (3, "r", 0.5, 0.5, 0.1, 0.2, True), (4, "s", 0.5, 0.5, 0.9, 0.1, False)], "id int, g string, cx double, cy double, w double, h double, manual boolean")
    got = values(rv.move_size(df, "id", "g", df.where("id = 1")), "id", "new_w", "new_h", "moved")
    assert got == [(1, 0.6, 0.4, False), (2, 0.4, 0.6, True), (3, 0.1, 0.2, False), (4, 0.9, 0.1, False)]


def test_crops(spark):
    one = spark.range(1)
    lit = lambda *x: [F.lit(float(v)) for v in x]
    assert one.select(ge.clamped(*lit(-1, 0, 2, 1)).alias("c")).first().c == [0.0, 0.0, 1.0, 1.0]
    assert one.select(ge.clamped(*lit(0.5, 0, 0.5, 1)).alias("c")).first().c is None
    p = one.select(ge.to_pixels(F.array(*lit(0.1, 0.3, 0.9, 0.9)), F.lit(3000), F.lit(2000)).alias("p")).first().p
    assert tuple(p) == (300, 600, 2400, 1200)
    there = ge.to_straight(F.array(*lit(0.3, 0.3, 0.6, 0.7)), *lit(3000, 2000), F.lit(4.0))
    back = one.select(ge.from_straight(there, *lit(3000, 2000), F.lit(4.0)).alias("b")).first().b
    assert np.allclose(back, [0.3, 0.3, 0.6, 0.7], atol=2e-5)


def test_natural_order(spark):
    names = ["img10", "img9", "IMG1", "a2b10", "a2b9"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(tx.natural_key(F.col("n"))).collect()] == ["a2b9", "a2b10", "IMG1", "img9", "img10"]


def test_discovery(spark, tmp_path):
    for p in ("1/a.NEF", "1/a.jpg", "1/b.tif", "2/c.arw", "2/.hidden.jpg", "out/gristmill-output", "out/x.jpg", "1/deep/y.jpg", "1/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    found = fs.rolls(fs.listing(spark, str(tmp_path)), str(tmp_path))
    assert values(found, "rel", "roll") == [("1/a.NEF", "1"), ("1/b.tif", "1"), ("2/c.arw", "2")]


def test_log_and_manifest(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"t":"2024-01-01T00:00:00Z","rev":1,"id":"a","event":"crop","from":null,"to":[0,0,1,1]}\nbroken\n')
    assert values(fs.feedback_log(spark, str(tmp_path / "log.jsonl")), "id", "to") == [("a", "[0,0,1,1]")]
    plan = spark.createDataFrame([("f", "r", "green", True, 0.9, None)], "file string, film string, label string, apply boolean, confidence double, angle double")
    fs.write_manifest(plan, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m/crops.csv")).first()
    assert back["apply"] == "1" and back["angle"] is None and len(back) == len(fs.MANIFEST)


@pytest.mark.parametrize("phase", range(0, 60, 10))
def test_pitch(phase):
    found = raster.roll_pitch([strip(k, 59.2, phase + k) for k in range(4)])
    assert abs(found["pitch"] / 59.2 - 1) < 0.01 and found["score"] >= 0.5 and found["agree"] < 0.002


def test_pitch_that_alternates():
    assert raster.roll_pitch([strip(k, 59.2 if k % 2 else 66.0) for k in range(4)])["agree"] > 0.02


def test_area_mean_keeps_the_mean():
    g = np.random.default_rng(0).integers(0, 255, (37, 53)).astype(float)
    assert raster.area_mean(g, 10, 20).mean() == pytest.approx(g.mean())
    assert np.allclose(raster.area_mean(g, 37, 53), g)


def test_rotation_and_fits():
    g = np.zeros((40, 60))
    g[10:30, 20:40] = 200
    assert raster.rotated(g, 0).shape == g.shape and np.allclose(raster.rotated(g, 0), g)
    assert raster.rotated(g, 90).shape == (60, 40)
    u = np.arange(20.0)
    v = 3 * u + 1
    v[4] = 90
    slope, base, share = raster.theil_sen(u, v, 0.5)
    assert (round(slope, 9), round(base, 9), share) == (3, 1, 0.95)
    assert raster.theil_sen(u[:5], v[:5], 1) is None


def test_measure_gives_reasons():
    assert raster.measure_image(np.zeros((100, 100), np.uint8)) == {"valid": False, "reason": "no strip"}
    assert raster.measure_image(np.full((200, 200), 120, np.uint8))["reason"] == "low contrast"


def test_detectors_on_a_clear_frame():
    g = np.full((300, 420), 12, np.uint8)
    g[45:245, 60:360] = 170
    for f in detect.DETECTORS.values():
        assert any(max(abs(p - q) for p, q in zip(b, (60, 45, 300, 200), strict=True)) <= 3 for b in f(g)), f.__name__
    best = detect.best_box(g)
    assert max(abs(p - q) for p, q in zip(best["box"], (60, 45, 300, 200), strict=True)) <= 2 and len(best["methods"]) == 4
    assert best["orientation"] == "Landscape" and best["geometry"] == 1.0
    assert detect.best_box(np.zeros((200, 300), np.uint8))["confidence"] < 0.5 < best["confidence"]


def test_regions():
    m = np.zeros((8, 9), bool)
    m[1:4, 1:3] = m[3, 1:6] = m[1:4, 5] = True
    m[6:, 7:] = True
    assert sorted(detect.regions(m)) == [(1, 1, 5, 3, 11), (7, 6, 2, 2, 4)]


def test_last_steps(spark):
    x = '<x history_end="3"><rdf:li num="0" operation="crop" multi_priority="0" p="a"/><rdf:li num="1" operation="crop" multi_priority="1"/><rdf:li num="2" operation="crop" multi_priority="0" p="b"/><rdf:li num="3" operation="crop" multi_priority="0" p="c"/>'
    got = spark.createDataFrame([(x,), ("",)], "h string").select(tx.last_steps(F.col("h")).alias("m")).collect()
    assert set(got[0].m) == {"crop/0", "crop/1"} and 'p="b"' in got[0].m["crop/0"] and got[1].m == {}


def test_scaled_reference(spark):
    df = spark.createDataFrame([((300, 600, 2400, 1201),)], "b struct<x:int,y:int,width:int,height:int>")
    assert tuple(df.select(ev.scaled_reference(F.col("b"), F.lit(3000), F.lit(2000)).alias("r")).first().r) == (200, 400, 1600, 801)


def test_film_darker_than_its_holder():
    g = np.full((400, 600), 240, np.uint8)
    g[20:380, 30:570] = 20
    g[60:340, 80:520] = 90
    m = raster.measure_image(g)
    assert (m["x"], m["y"], m["width"], m["height"], m["contrast"]) == (80, 60, 440, 280, 70.0)
    g[60:340, 80:520] = 5
    assert raster.measure_image(g)["contrast"] == -15.0


def test_edges_are_signed():
    g = np.full((200, 200), 10, np.uint8)
    g[50:150, 50:150] = 200
    up, down = raster.edge_evidence(g, 50, 50, 100, 100), raster.edge_evidence(210 - g, 50, 50, 100, 100)
    assert up == {"edge": 1.0, "interior": 1.0, "exterior": round(1 - 10 / 120, 3)} and down["edge"] == 0.0 and down["exterior"] == 0.0
    assert raster.edge_evidence(g, 300, 0, 5, 5) == {"edge": 0.0, "interior": 0.0, "exterior": 0.0}
    assert raster.edge_evidence(np.full((50, 50), 80, np.uint8), 0, 0, 50, 50)["exterior"] == 0.5


def test_peak_on_a_plateau():
    assert raster.peak(np.array([0, 0, 1.0, 1.0, 0, 0, 0]), 2) == (2.5, 1.0)
    assert raster.peak(np.array([-3, -3, -1.0, -2, -3, -3]), 2) is None


def test_rolls_are_numbered(spark):
    from gristmill.sources import files

    paths = ["/a/r/2.jpg", "/a/r/1.nef", "/a/r/1.jpg", "/a/0.x3f", "/a/q/5.raw", "/a/q/.6.jpg"]
    got = files.rolls(spark.createDataFrame([(p,) for p in paths], "path string"), "/a")
    assert sorted((r.id, r.path) for r in got.collect()) == [(1, "/a/0.x3f"), (2, "/a/r/1.nef"), (3, "/a/r/2.jpg")]


def test_canonical_sha(spark):
    import hashlib
    import json

    row = {"b": 'x "ü"\n', "a": 3, "c": None, "d": True}
    df = spark.createDataFrame([tuple(row.values())], "b string, a long, c string, d boolean")
    got = df.select(tx.canonical_sha256({k: F.col(k) for k in row}).alias("h")).first().h
    assert got == hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
