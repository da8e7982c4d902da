"""Images: kernels against plain loops, rules by cases, files that a test writes."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import TINY

from gristmill.functions import content, raster
from gristmill.functions import tilt as tl
from gristmill.operators import rasters as ra
from gristmill.plans import rasters as plan
from gristmill.sources import images as im


def grays(spark, level, zoom=4):
    for r in plan._images(spark, TINY, level).collect():
        g = np.array(r.pixels).reshape(r.height, r.width)
        yield r.image, np.kron(g, np.ones((zoom, zoom), int)), (r.x, r.y, r.w, r.h)


def plain_line(edges, start, length, at, near):
    """Every angle and offset in turn."""
    scores = []
    for a in range(73):
        slope = math.tan(math.radians(-9 + a * 0.25))
        for off in range(-near, near + 1, 2):
            total = n = 0
            for k in range(48):
                u = start + (0.06 + 0.88 * k / 47) * length
                p, q = round(at + off + slope * (u - (start + length / 2))), round(u)
                if 0 <= p < edges.shape[0] and 0 <= q < edges.shape[1]:
                    total += min(edges[p, q], 60.0)
                    n += 1
            scores.append((total / max(n, 1), slope, at + off))
    best = max(scores, key=lambda s: s[0])
    return best[1], best[2], best[0] / max(float(np.median([s[0] for s in scores])), 1e-6)


def test_lines_of_all_images(spark):
    """Both sides of each image of the table, against loops."""
    met = 0
    for _, g, (x, y, w, h) in grays(spark, plan._LEVEL):
        maps = tl.edge_maps(g)
        for edges, start, length, at in ((maps["down"], x, w, y), (maps["right"].T, y, h, x + w)):
            got, want = tl.strongest_line(edges, start, length, at, 10), plain_line(edges, start, length, at, 10)
            assert got is not None and np.allclose(got, want, atol=1e-9), (got, want)
            met += 1
    assert met == 2 * spark.read.parquet(f"{TINY}/embeddings.parquet").selectExpr("count(distinct vec_id div 64)").first()[0]


def test_edge_maps_by_hand():
    g = np.random.default_rng(1).integers(0, 255, (20, 23)).astype(float)
    mirror = lambda i, n: (-i if i < 0 else 2 * n - 2 - i if i >= n else i)
    h, w = g.shape
    taps = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(-6, 7)]
    taps = [t / sum(taps) for t in taps]
    at = lambda m, y, x: m[mirror(y, h)][mirror(x, w)]
    a = [[sum(t * at(g, y + k, x) for t, k in zip(taps, range(-6, 7), strict=True)) for x in range(w)] for y in range(h)]
    b = [[sum(t * at(a, y, x + k) for t, k in zip(taps, range(-6, 7), strict=True)) for x in range(w)] for y in range(h)]
    s = [[abs(sum((at(b, y + 1, x + k) - at(b, y - 1, x + k)) * f for k, f in ((-1, 1), (0, 2), (1, 1)))) / 4 for x in range(w)] for y in range(h)]
    m = [[sum(at(s, y + i, x + j) for i in range(-2, 3) for j in range(-2, 3)) / 25 for x in range(w)] for y in range(h)]
    assert np.allclose(tl.edge_maps(g)["down"], m)


def frame(turn, noise=4, h=300, w=400):
    yy, xx = np.mgrid[0:h, 0:w]
    c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    u, v = (xx - w / 2) * c + (yy - h / 2) * s, -(xx - w / 2) * s + (yy - h / 2) * c
    g = np.where((abs(u) < 130) & (abs(v) < 90), 170, 40) + np.random.default_rng(3).normal(0, noise, (h, w))
    return np.clip(g, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("turn", [-4, -1.5, 0, 0.7, 3])
def test_tilt_of_drawn_frames(turn):
    found = tl.tilt_and_box(frame(turn), 70, 60, 260, 180)
    assert abs(found["deg"] - turn) < 0.15 and found["conf"] > 0.7 and set(found["lines"]) == set(found["sides"])
    assert (found["box"] is None) == (abs(found["deg"]) < 0.3)
    if found["box"]:
        assert abs(found["box"][2] - 260) <= 4 and abs(found["box"][3] - 180) <= 4


def test_tilt_that_is_not_reported(monkeypatch):
    flat = np.full((200, 200), 90, np.uint8)
    assert tl.tilt(flat, 20, 20, 150, 150)["deg"] is None
    side = lambda turn, share: {"turn": turn, "share": share, "ends": [(0, 0), (1, 1)]}
    for sides, deg in (({"top": side(1.0, 0.9), "left": side(1.3, 0.9)}, 1.0), ({"top": side(1.0, 0.9), "left": side(1.5, 0.9)}, None), ({"top": side(1.0, 0.9), "left": side(5.0, 0.9)}, None), ({"top": side(1.0, 0.9), "left": side(1.5, 0.6), "right": side(7.0, 0.9), "bottom": side(1.2, 0.9)}, 1.2)):
        monkeypatch.setattr(tl, "side_lines", lambda *_, s=sides: s)
        assert tl.tilt(flat, 0, 0, 9, 9)["deg"] == deg
    assert tl.tilt(flat, 0, 0, 9, 9)["conf"] == round((0.9 + 0.6 + 0.9) / 4, 3)


def held(h, w, box, level, film=35, holder=0):
    g = np.full((h, w), film, np.uint8)
    x, y, bw, bh = box
    g[y : y + bh, x : x + bw] = level
    if holder:
        g[:holder], g[-holder:] = 240, 240
    return g


def test_second_stage_branch_by_branch():
    find = lambda g, **k: content.refined_content(g, 0, 0, g.shape[1], g.shape[0], **k)
    assert find(held(200, 300, (30, 20, 240, 160), 120)) == (30, 20, 240, 160, "span")
    assert content.refined_content(held(200, 300, (30, 20, 240, 160), 120), 10, 10, 280, 180) == (30, 20, 240, 160, "span")
    dim = held(200, 300, (30, 20, 240, 160), 55)  # 20 above the film: only the lower level finds it
    assert find(dim) == (30, 20, 240, 160, "loose")
    assert find(np.full((200, 300), 35, np.uint8)) == (0, 0, 300, 200, "kept")
    assert find(held(200, 300, (100, 90, 60, 15), 120)) == (0, 0, 300, 200, "kept")  # less than 30 % of the box
    # a dark band across the image's upper half: too wide until it grows back over what is just above the film
    band = held(400, 620, (30, 20, 560, 360), 120)
    band[20:90, 30:590] = 54
    assert find(band)[4] == "span" and find(band, target=1.5)[4] == "span grown"
    assert find(band, target=1.5)[1] < find(band)[1] and abs(find(band, target=1.5)[2] / find(band, target=1.5)[3] - 1.5) < 0.25
    # a narrow bright part: the width follows from the film's height
    narrow = held(200, 300, (75, 20, 160, 160), 95)
    narrow[:, 290:] = 240  # the holder
    assert find(narrow) == (75, 20, 160, 160, "span")
    assert find(narrow, target=1.3) == (15, 0, 260, 200, "span strip")  # as wide as the film's height asks for, about its middle
    # a given border level
    assert find(dim, border=10.0)[4] in ("span", "loose")


def test_deviation_and_means_directly():
    g = np.random.default_rng(4).integers(0, 255, (40, 50))
    smooth = g.astype(float)
    for axis in (0, 1):
        smooth = tl.filtered(smooth, tl.gaussian(1.2), axis)
    wide = np.pad(smooth, 3, "reflect")
    want = np.array([[wide[y : y + 7, x : x + 7].std() for x in range(50)] for y in range(40)])
    assert np.allclose(content.deviation(g), want)
    sums = content.Sums(g)
    for t, b, l, r in ((0, 40, 0, 50), (3, 9, 20, 21), (39, 40, 49, 50)):
        assert math.isclose(sums.of(t, b, l, r), g[t:b, l:r].mean())


def test_texture_of_drawn_frames():
    rng = np.random.default_rng(5)
    g = np.full((200, 260), 100.0)
    g[40:160, 50:210] += rng.normal(0, 30, (120, 160))
    inside, near = content.content_signals(g, 50, 40, 160, 120)
    off, far = content.content_signals(g, 70, 55, 110, 80)
    assert inside > 0.7 and near > 0.5 and off < 0.6 and far < near
    assert content.content_signals(np.full((30, 30), 7), 0, 0, 30, 30)[0] == 0.5


def test_slanted_frames_are_found(spark):
    got = {r.image: r for r in plan.raster_frames(spark, TINY).collect()}
    turns = {i: math.degrees(math.atan((i % 7 - 3) / 24)) for i in got}
    assert len(got) >= 6 and all(abs(got[i].deg - t) <= 1.5 for i, t in turns.items())
    whole = [r for r in got.values() if r.image < 7]
    assert all(abs(r.x - 10) <= 5 and abs(r.y - 12) <= 5 for r in whole)


def test_images_without_pixels(spark):
    rows = [(1, None, None, None), (2, 2, 3, [1, 2, 3]), (3, 0, 0, []), (4, 30, 30, [7] * 900)]
    df = spark.createDataFrame([(*r, 5, 5, 20, 20) for r in rows], "image long, height int, width int, pixels array<int>, x int, y int, w int, h int")
    got = {r.image: r.error for r in ra.texture(df).collect()}
    assert got == {1: "no pixels", 2: "no pixels", 3: "no pixels", 4: None}
    assert ra.texture(df.where("false")).count() == 0 and ra.equalised(ra.pixels(df.where("image = 4"))).select("e").distinct().count() == 1


def test_formats_rule_by_rule(spark):
    schema = "roll string, aspect double, mm_px double, raw_long double, open boolean"
    rolls = [("usual", 1.5, 4.0, None, True), ("closed", 2.7, 4.0, None, False), ("unknown", 2.7, 4.0, None, None), ("wide", 1.0, 4.0, 146.0, True), ("square", 1.9, 4.0, 94.0, True), ("none", 1.9, 4.0, 120.0, True), ("edges", 1.0, 6.0, 120.0, True), ("edges2", 1.0, 6.0, None, True)]
    yy, xx = np.mgrid[0:200, 0:300]
    drawn = lambda w, h: np.where((abs(xx - 150) < w / 2) & (abs(yy - 100) < h / 2), 60, 20).ravel().tolist()
    images = [("edges", f"{k}.png", 200, 300, drawn(144, 144)) for k in range(8)] + [("edges2", "a.png", 200, 300, drawn(216, 144)), ("edges2", "b.png", None, None, None)]
    got = ra.roll_formats(spark.createDataFrame(rolls, schema), spark.createDataFrame(images, "roll string, path string, height int, width int, pixels array<int>"))
    assert {r.roll: (r.format, r.why) for r in got.collect()} == {"usual": ("3:2", "aspect"), "closed": ("3:2", "aspect"), "unknown": ("3:2", "aspect"), "wide": ("3:2", "length"), "square": ("square", "length"), "none": ("3:2", "edges"), "edges": ("square", "edges"), "edges2": ("3:2", "edges")}


def png(pixels):
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def tiff(pixels):
    h, w = pixels.shape
    entries = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, h * w)]
    body = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)
    data = pixels.tobytes() + b"\0" * (h * w % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + body


def test_images_are_read(spark, tmp_path):
    rng = np.random.default_rng(6)
    one, two, three = rng.integers(0, 256, (12, 17), np.uint8), rng.integers(0, 256, (9, 8), np.uint8), rng.integers(0, 256, (7, 5, 3), np.uint8)
    large = rng.integers(0, 256, (60, 90), np.uint8)
    (tmp_path / "sub").mkdir()
    for name, data in (("a.png", png(one)), ("b.tif", tiff(two)), ("sub/c.png", png(three)), ("d.png", png(one)[:40]), ("e.jpg", b"no image"), ("f.png", png(large))):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in im.images(spark, str(tmp_path), most_side=45).collect()}
    level = lambda r: np.array(r.pixels).reshape(r.height, r.width)
    assert (level(got["a.png"]) == one).all() and (level(got["b.tif"]) == two).all()
    red, green, blue = (three[:, :, k].astype(int) for k in range(3))
    assert (level(got["c.png"]) == (blue * 1868 + green * 9617 + red * 4899 + 8192) // 16384).all()
    assert got["d.png"].error and got["d.png"].pixels is None and got["e.jpg"].error
    assert got["f.png"].scale == 0.5 and (level(got["f.png"]) == np.rint(large.reshape(30, 2, 45, 2).mean((1, 3)))).all()


def test_read_images_feed_the_kernels(spark, tmp_path):
    for k in range(4):
        g = np.full((240, 300), 90, np.uint8)
        for x in range(7 * k, 290, 28):
            g[5:17, x : x + 8] = g[224:236, x : x + 8] = 235
        (tmp_path / f"{k}.png").write_bytes(png(g))
    rows = im.images(spark, str(tmp_path)).orderBy("path").collect()
    assert abs(raster.roll_pitch([np.array(r.pixels).reshape(r.height, r.width) for r in rows])["pitch"] - 28) < 0.2


def exif(order, value, nested=False, tag=0x0112):
    mark = b"II" if order == "<" else b"MM"
    entry = struct.pack(order + "HHIHH", tag, 3, 1, value, 0)
    if not nested:
        return mark + struct.pack(order + "HIH", 42, 8, 1) + entry + struct.pack(order + "I", 0)
    link = struct.pack(order + "HHII", 0x8769, 4, 1, 26)
    return mark + struct.pack(order + "HIH", 42, 8, 1) + link + struct.pack(order + "I", 0) + struct.pack(order + "H", 1) + entry + struct.pack(order + "I", 0)


def jpeg(head, before=b""):
    segment = b"\xff\xe1" + struct.pack(">H", len(head) + 8) + b"Exif\0\0" + head
    return b"\xff\xd8" + before + segment + b"\xff\xda\0\2"


def test_orientations(spark):
    app0 = b"\xff\xe0\0\x06JFIF\xff"
    cases = {f"{o}{v}{n}{b}": (jpeg(exif(o, v, n), app0 if b else b""), v) for o in "<>" for v in range(1, 9) for n in (0, 1) for b in (0, 1)}
    cases |= {f"tiff{v}": (exif(">", v), v) for v in range(1, 9)}
    cases |= {"zero": (jpeg(exif("<", 0)), None), "nine": (jpeg(exif("<", 9)), None), "none": (jpeg(exif("<", 3, tag=0x010F)), None), "cut": (jpeg(exif("<", 3))[:24], None), "empty": (b"", None), "null": (None, None), "text": (b"hello", None), "loop": (jpeg(b"II" + struct.pack("<HIHI", 42, 8, 0, 8)), None), "pixels first": (b"\xff\xd8\xff\xda\0\2" + jpeg(exif("<", 3))[2:], None), "zero length": (b"\xff\xd8\xff\xe0\0\0" + jpeg(exif("<", 3))[2:], None), "far": (jpeg(b"II" + struct.pack("<HI", 42, 10**9)), None)}
    df = spark.createDataFrame([(k, bytearray(v[0]) if v[0] is not None else None) for k, v in cases.items()], "path string, content binary")
    assert {r.path: r.orientation for r in im.orientations(df).collect()} == {k: v[1] for k, v in cases.items()}
