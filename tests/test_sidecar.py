"""Sidecar texts and binary parameters against plain versions."""

import base64
import math
import random
import struct
import zlib

from pyspark.sql import functions as F

from gristmill.functions import sidecar as sc

PROFILE = "[General]\nColorLabel=0\n\n[Crop]\nEnabled=false\n X = 3 \n\n\n[Exposure]\nX=9\n"


def _set(spark, text, section, values):
    return spark.createDataFrame([(text,)], "t string").select(sc.ini_set(F.col("t"), section, {k: F.lit(v) for k, v in values.items()})).first()[0]


def test_keys_are_replaced_or_follow_their_section(spark):
    got = _set(spark, PROFILE, "Crop", {"Enabled": "true", "X": "7", "W": "100"})
    assert got == "[General]\nColorLabel=0\n\n[Crop]\nEnabled=true\nX=7\nW=100\n\n\n[Exposure]\nX=9\n"


def test_missing_section_is_added(spark):
    assert _set(spark, "[General]\nA=1", "Crop", {"X": "1", "Y": "2"}) == "[General]\nA=1\n\n[Crop]\nX=1\nY=2\n"
    assert _set(spark, None, "Crop", {"X": "1"}) == _set(spark, "", "Crop", {"X": "1"}) == "[Crop]\nX=1\n"


def test_section_met_twice(spark):
    assert _set(spark, "[A]\nx=1\n[B]\ny=1\n[A]\nx=2\n\n", "A", {"x": "9", "z": "0"}) == "[A]\nx=9\n[B]\ny=1\n[A]\nx=2\nz=0\n\n"
    assert _set(spark, "x=1\n[A]\n", "A", {"x": "9"}) == "x=1\n[A]\nx=9\n"


def test_little_floats(spark):
    rng = random.Random(1)
    rows = [tuple(struct.unpack("<4f", rng.randbytes(16))) for _ in range(300)] + [(0.0, 1.0, -2.5, 1e-45), (math.inf, -math.inf, 3.4e38, 1e-38)]
    packed = [struct.pack("<4f", *r) for r in rows]
    got = spark.createDataFrame([(p.hex(), "gz05" + base64.b64encode(zlib.compress(p)).decode()) for p in packed], "h string, z string")
    plain = [r[0] for r in got.select(sc.little_floats(F.col("h"), 4)).collect()]
    assert [[None if math.isnan(x) else x for x in r] for r in plain] == [[None if math.isnan(x) else x for x in struct.unpack("<4f", p)] for p in packed]
    assert [r[0] for r in got.select(sc.inflated(F.col("z"))).collect()] == [p.hex() for p in packed]
    bad = spark.createDataFrame([("zz",), ("00",), ("gz05????",), (None,)], "h string")
    assert [r[0] for r in bad.select(sc.little_floats(sc.inflated(F.col("h")), 1)).collect()] == [None] * 4


def test_history_crop(spark):
    p = lambda *v: struct.pack("<4f", *v).hex()
    steps = [("crop", True, p(0, 0, 1, 1)), ("crop", True, p(0.25, 0, 1, 1)), ("crop", False, p(0.5, 0, 1, 1)), ("ashift", True, p(1.5, 0, 0, 0)), ("ashift", True, p(-0.5, 0, 0.25, 0)), ("crop", True, "00")]
    table = spark.createDataFrame([(steps,), ([],)], "e array<struct<operation:string,enabled:boolean,params:string>>")
    assert [tuple(r[0]) for r in table.select(sc.history_crop(F.col("e"))).collect()] == [([0.25, 0.0, 1.0, 1.0], 1.0, True, 1), (None, None, False, 0)]


def test_tiff_orientation(spark):
    def file(end, value, tag=0x0112, kind=3, pad=0, extra=0):
        entries = [struct.pack(end + "HHIHH", 0x0100, 3, 1, 77, 0)] * extra + [struct.pack(end + "HHIHH", tag, kind, 1, value, 0)]
        return {"<": b"II", ">": b"MM"}[end] + b"\x2a\x00" + struct.pack(end + "I", 8 + pad) + b"\0" * pad + struct.pack(end + "H", len(entries)) + b"".join(entries)

    files = [(file("<", 6), 6), (file(">", 8, pad=9, extra=3), 8), (file("<", 9), None), (file(">", 3, kind=4), None), (file("<", 3, tag=1), None), (file("<", 6)[:-5], None), (b"", None), (b"\xff\xd8", None), (None, None), (b"II\x2a\x00\xff\xff\xff\xff", None)]
    table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(files)], "i int, c binary")
    got = dict(table.select("i", sc.tiff_orientation(F.col("c"))).collect())
    assert got == {i: want for i, (_, want) in enumerate(files)}
