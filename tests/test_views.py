"""The read model, what reviews get, reports, probes, protocol lines and scorers, case by case."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import models
from gristmill.operators import rasters as ra
from gristmill.operators import rolls as ro
from gristmill.operators import views as vi

CROP = "crop array<double>"
IMAGE = f"""id long, film string, filename string, status string, error string, decision string, group_override string, target_reason string, has_export boolean,
detected struct<{CROP}, confidence: double, method: string, reasons: array<string>, conf_parts: map<string,double>, skew: struct<deg: double, conf: double, lines: map<string,array<array<double>>>, straight: struct<deg: double, {CROP}>>>,
straighten struct<deg: double>, manual struct<{CROP}, deg: double>, proposal struct<{CROP}, confidence: double, method: string, reasons: array<string>, error: string>, export_size struct<width: int, height: int>"""
FIELDS = ("id", "film", "filename", "status", "error", "decision", "group_override", "target_reason", "has_export", "detected", "straighten", "manual", "proposal", "export_size")
REVIEW = "key string, manual_crop struct<x:int,y:int,width:int,height:int>, is_problem boolean, confirmed boolean, tilt_deg double, manual_crop_straight struct<crop:array<double>,width:int,height:int>, note string"
BOX = [0.2, 0.2, 0.8, 0.8]


def found(conf=0.9, deg=None, sure=0.9, straight=None, crop=BOX):
    return (crop, conf, "edge", None, None, None if deg is None else (deg, sure, {"top": [[0.5, 0.5], [1.0, 0.5]]}, straight))


def images(spark, *rows):
    return spark.createDataFrame([tuple({"id": i, "film": "f", "filename": f"{i}.jpg", **r}.get(k) for k in FIELDS) for i, r in enumerate(rows)], IMAGE.replace(": ", ":").replace("crop array", "crop: array"))


def view(spark, *rows):
    return [r.asDict(True) for r in vi.public_images(images(spark, *rows)).orderBy("id").collect()]


def test_view_of_an_image_without_anything(spark):
    (v,) = view(spark, {"film": None, "filename": None})
    assert tuple(v) == vi.VIEW and (v["group"], v["auto_group"], v["target_ok"], v["apply"], v["has_export"], v["reasons"]) == ("red", "red", True, False, False, [])
    assert all(v[k] is None for k in ("crop", "detected_crop", "manual_crop", "view_size", "skew_lines", "proposal", "ref", "straighten", "confidence"))
    assert vi.public_images(images(spark, {}).where("false")).count() == 0


def test_view_turns_with_the_image(spark):
    size = (1000, 1000)
    flat, off, explicit, unsure, own, bare = view(
        spark, {"detected": found(), "export_size": size}, {"detected": found(deg=2.0), "export_size": size, "straighten": (None,)}, {"detected": found(deg=2.0), "export_size": size, "straighten": (90.0,)},
        {"detected": found(deg=2.0, sure=0.1), "export_size": size}, {"detected": found(deg=2.0, straight=(2.1, [0.3, 0.3, 0.7, 0.7])), "export_size": size}, {"detected": found(deg=2.0)},
    )
    assert [v["straighten"] for v in (flat, off, explicit, unsure, own, bare)] == [None, None, 90.0, None, 2.0, 2.0]
    assert flat["crop"] == off["crop"] == unsure["crop"] == bare["crop"] == BOX and bare["view_size"] is None and flat["view_size"] == [1000.0, 1000.0]
    assert explicit["crop"] == BOX and explicit["skew_lines"] == {"top": [[0.5, 0.5], [0.5, 0.0]]}  # a quarter turn of a centred square
    side = 1000 * (math.cos(math.radians(2)) + math.sin(math.radians(2)))
    assert own["crop"] == [0.3, 0.3, 0.7, 0.7] and own["view_size"] == [round(side, 1)] * 2 and off["skew_lines"] == {"top": [[0.5, 0.5], [1.0, 0.5]]}


def test_view_by_hand(spark):
    size = (2000, 1000)
    same, near, kept, skipped, broken, refused, red, offered, failed = view(
        spark, {"detected": found(), "manual": (BOX, None), "export_size": size}, {"detected": found(crop=[0.2, 0.2, 0.82, 0.9]), "manual": (BOX, None), "export_size": size},
        {"detected": found(deg=3.0), "manual": (BOX, 3.0), "export_size": size}, {"detected": found(), "decision": "skip"}, {"detected": found(), "status": "error"}, {"detected": found(), "target_reason": "not_raw"},
        {"detected": found(conf=None), "decision": "accept", "group_override": "odd"}, {"proposal": (BOX, 0.5, "m", ["r"], None)}, {"proposal": (BOX, 0.5, "m", ["r"], "no")},
    )
    assert same["ref"] == {"dx": 0, "dy": 0, "dw": 0, "dh": 0, "tol": 60.0, "hit": True, "strict": True, "score": 0.0} and same["apply"]
    assert (near["ref"]["dw"], near["ref"]["dh"], near["ref"]["hit"], near["ref"]["score"]) == (40, 100, False, 1.67)
    assert kept["crop"] == BOX and kept["ref"]["dx"] != 0  # set in the turned frame: the reference is turned back
    assert not any(v["apply"] for v in (skipped, broken, refused)) and red["apply"] and red["group"] == "red"
    assert offered["proposal"] == {"crop": BOX, "confidence": 0.5, "method": "m", "reasons": ["r"], "error": None}
    assert failed["proposal"] == {"crop": None, "confidence": None, "method": None, "reasons": None, "error": "no"}


def test_review_target(spark):
    size = (1000, 500)
    new = images(
        spark, {"manual": (BOX, None), "export_size": size}, {"detected": found(deg=90.0), "decision": "accept", "export_size": size}, {"group_override": "red"}, {"manual": (BOX, None)}, {"detected": found()},
    )
    old = [("f/0.jpg", None, None, True, 7.0, (BOX, 1, 2), "kept"), ("g/0.jpg", (1, 2, 3, 4), None, None, 1.0, (BOX, 1, 2), None)]
    got = {r.key: r for r in vi.review_target(new, spark.createDataFrame(old, REVIEW)).collect()}
    assert set(got) == {"f/0.jpg", "f/1.jpg", "f/2.jpg", "g/0.jpg"}
    a, b, c, d = (got[k] for k in sorted(got))
    assert tuple(a.manual_crop) == (200, 100, 600, 300) and (a.is_problem, a.confirmed, a.tilt_deg, a.manual_crop_straight, a.note) == (True, True, None, None, "kept")
    assert b.confirmed and b.tilt_deg == 90.0 and (b.manual_crop_straight.width, b.manual_crop_straight.height) == (500, 1000)
    assert c.is_problem and c.manual_crop is None and (d.tilt_deg, tuple(d.manual_crop)) == (1.0, (1, 2, 3, 4))
    assert {r.key for r in vi.review_target(new, spark.createDataFrame([], REVIEW)).collect()} == {"f/0.jpg", "f/1.jpg", "f/2.jpg"}


def test_report(spark):
    schema = "auto string, final string, has_detection boolean, corrected boolean, strict_hit boolean, conf double, symptom string, a double, b double"
    rows = [("green", "red", True, True, False, 0.9, "size", 0.5, 0.5), ("green", "green", True, True, None, 0.7, "size", 0.1, 0.2), ("green", None, False, True, False, None, None, None, None), ("red", "green", True, None, False, None, "size", 0.1, None)]
    got = {r.auto: r[1:] for r in vi.feedback_groups(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"green": (2, 2, 1, 0.8), "yellow": (0, 0, 0, None), "red": (1, 0, 0, None)}
    counts = {tuple(r) for r in vi.feedback_counts(spark.createDataFrame(rows, schema), ["a", "b"]).collect()}
    assert counts == {("move", "green->red", 1), ("move", "red->green", 1), ("symptom", "size", 1), ("weakest", "a", 1)}
    assert vi.false_greens(spark.createDataFrame(rows, schema)).count() == 2
    none = spark.createDataFrame([], schema)
    assert [r.n for r in vi.feedback_groups(none).collect()] == [0, 0, 0] and vi.feedback_counts(none, ["a", "b"]).count() == 0


def test_probes_of_written_sidecars(spark, tmp_path):
    (tmp_path / "r").mkdir()
    texts = {"a.NEF.xmp": vi.DT, "a.xmp": vi.CRS, "r/b.xmp": "x" * 9000 + vi.CRS, "c.NEF.xmp": "x" * (vi.HEAD - 5) + vi.DT, ".d.xmp": vi.CRS, "e.xmp": "", "_h.xmp": vi.CRS, "f.txt": vi.CRS}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "g.xmp").write_bytes(b"\xff\xfe" + vi.CRS.encode())
    names = ["a.NEF", "r/b.NEF", "c.NEF", ".d", "e.JPG", "f.NEF", "g.NEF", "_h.NEF"]
    paths = spark.createDataFrame([(f"{tmp_path}/{n}", n) for n in names] + [(None, "none"), (f"{tmp_path}/a.NEF", "again")], "path string, name string")
    got = {r.name: (r.sidecar and r.sidecar[len(str(tmp_path)) + 1 :], r.has_adobe, r.has_darktable) for r in vi.sidecar_probes(paths, vi.sidecars(paths)).collect()}
    assert got == {
        "a.NEF": ("a.NEF.xmp", True, True), "again": ("a.NEF.xmp", True, True), "r/b.NEF": ("r/b.xmp", True, False), "c.NEF": ("c.NEF.xmp", False, False), ".d": (".d.xmp", True, False),
        "e.JPG": ("e.xmp", False, False), "f.NEF": (None, False, False), "g.NEF": ("g.xmp", True, False), "none": (None, False, False), "_h.NEF": ("_h.xmp", True, False),
    }


def test_protocol_is_read_back(spark):
    rows = [(1, "total", [9], None), (2, "step", [1, 9], None), (3, "warn", None, "a\r\nb"), (4, "step", [2, 9], None), (5, "done", [3, 4, 2], None), (6, "info", [], "queue=x"), (7, "step", [3], None), (8, "odd", [1], "x")]
    lines = spark.createDataFrame(rows, "i int, kind string, numbers array<long>, text string").select(F.lit(1).alias("run"), "i", vi.protocol_line(F.col("kind"), F.col("numbers"), F.col("text")).alias("line"))
    assert [r.line for r in lines.orderBy("i").collect()] == ["BATCHINFO total=9", "PROGRESS 1/9", "WARN a b", "PROGRESS 2/9", "BATCHDONE green=3 yellow=4 red=2", "BATCHINFO queue=x", None, None]
    (got,) = ro.progress(lines, ["run"], "i").collect()
    assert got.asDict() == {"run": 1, "step": 2, "of": 9, "images": 9, "green": 3, "yellow": 4, "red": 2, "warnings": 1}


def test_scorers_side_by_side(spark):
    rng = random.Random(1)
    rows = [(g, x := rng.random(), rng.random() < x) for g in "abcd" for _ in range(30)] + [("e", 0.5, True), (None, 0.9, True), ("a", None, True), ("b", 0.3, None)]
    df = spark.createDataFrame(rows, "g string, x double, hit boolean")
    got = {(r.scorer, r.g): r for r in models.compared(df, "g", {"x": models.fixed(F.col("x")), "lr": models.fitted(["x"])}, 0.7).collect()}
    alone = {r.g: tuple(r) for r in models.nested_leave_one_out(df, "g", ["x"], 0.7).collect()}
    assert {g: tuple(r)[1:] for (s, g), r in got.items() if s == "lr"} == alone
    whole = [r for r in rows if None not in r]
    for g in "abcde":
        rest, own = ([r for r in whole if (r[0] == g) == same] for same in (False, True))
        fits = [t for t in sorted({round(x, 4) for _, x, _ in rest}) if len(up := [h for _, x, h in rest if x >= t]) >= 5 and sum(up) >= 0.7 * len(up)]
        green = [h for _, x, h in own if fits and x >= fits[0]]
        assert tuple(got["x", g])[2:] == (fits[0] if fits else None, len(own), sum(h for *_, h in own), len(green), sum(green))
    assert models.compared(df.where("false"), "g", {"x": models.fixed(F.col("x"))}, 0.7).count() == 0


@pytest.mark.parametrize("noise", [0, 4])
def test_overrides_of_detection(spark, noise):
    gray = np.full((240, 240), 235)
    gray[8:232, 8:232] = 30
    gray[60:200, 50:190] = 140  # a square, whose shape costs confidence at 1.5
    gray += np.random.default_rng(2).integers(-noise, noise + 1, gray.shape)
    rows = [(1, None, False, False), (2, None, True, False), (3, 1.0, False, True), (4, None, None, None)]
    rows = [(i, 240, 240, gray.ravel().tolist(), *o) for i, *o in rows] + [(5, 5, 5, [50] * 25, None, None, None), (6, 240, 240, None, None, None, None)]
    df = spark.createDataFrame(rows, "image long, height int, width int, pixels array<int>, target double, no_penalty boolean, one_stage boolean")
    got = {r.image: r for r in ra.detected(df).collect()}
    assert got[2].confidence > got[1].confidence == got[4].confidence and got[3].way is None and got[1].way
    assert got[5].error == "no candidate" and got[6].error == "no pixels" and got[5].x is None
    dump = [r for r in ra.dumped(df).collect() if r.image == 3]
    assert [r.rank for r in dump] == list(range(len(dump))) and dump[-1].method == "refined" and all(0 <= v <= 1 for r in dump for v in r.crop)
    assert {r.image for r in ra.dumped(df).select("image").collect()} == {1, 2, 3, 4}
