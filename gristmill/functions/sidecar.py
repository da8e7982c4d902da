"""Sidecar texts and binary parameters as columns: sections of key=value lines, little-endian floats, TIFF orientation."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SECTION = r"^\s*\[([^\]]+)\]\s*$"
ORIENTATION, SHORT = 0x0112, 3  # fixed values: the tag, and the type it must have
TRIVIAL = 1e-3  # fixed value: edges of a crop nearer than this to the image's are none


def ini_set(text: Column, section: str, values: dict[str, Column]) -> Column:
    """text with keys of a [section] set. The first line of each key is replaced, wherever the section goes on; keys it
    lacks follow its last line that is not blank; a missing section is added at the end, after a blank line. All other
    lines stay. A null text is empty."""
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    lines = F.split(F.regexp_replace(whole, r"\n\z", ""), "\n")
    lines = F.when(whole == "", F.array().cast("array<string>")).otherwise(lines)
    is_head = lambda x: x.rlike(SECTION)
    name = lambda x: F.regexp_extract(x, SECTION, 1)
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<line:string,inside:boolean>>").alias("out"))
    # one pass marks each line with whether it belongs to the section
    step = lambda s, x: F.struct(
        F.when(is_head(x), F.concat(F.lit("["), name(x))).otherwise(s["now"]).alias("now"),
        F.concat(s["out"], F.array(F.struct(x.alias("line"), (F.when(is_head(x), F.concat(F.lit("["), name(x))).otherwise(s["now"]) == f"[{section}").alias("inside")))).alias("out"),
    )
    marked = F.aggregate(lines, start, step)["out"]

    key = lambda r: F.trim(F.substring_index(r["line"], "=", 1))
    number = lambda r, i: F.struct(i.alias("i"), r["line"].alias("line"), r["inside"].alias("inside"), F.when(r["inside"] & ~is_head(r["line"]) & r["line"].contains("="), key(r)).alias("key"))

    def places(rows: Column) -> Column:
        """The rows with where each key is first set; one value, so that it is bound once below."""
        first = lambda k: F.array_min(F.transform(F.filter(rows, lambda r: r["key"] == k), lambda r: r["i"]))
        end = F.array_max(F.transform(F.filter(rows, lambda r: r["inside"] & (F.trim(r["line"]) != "")), lambda r: r["i"]))
        return F.struct(rows.alias("rows"), F.array(*map(first, values)).alias("at"), end.alias("end"))

    def written(s: Column) -> Column:
        def line(r: Column) -> Column:
            new = r["line"]
            for n, (k, v) in enumerate(values.items()):
                new = F.when(r["i"] == s["at"][n], F.concat(F.lit(f"{k}="), v)).otherwise(new)
            return new

        rest = F.filter(F.array(*(F.when(s["at"][n].isNull(), F.concat(F.lit(f"{k}="), v)) for n, (k, v) in enumerate(values.items()))), lambda x: x.isNotNull())
        return F.struct(F.transform(s["rows"], line).alias("lines"), rest.alias("rest"), s["end"].alias("end"))

    def joined(s: Column) -> Column:
        # a head belongs to its section, so a section that is there has an end
        new, rest = s["lines"], s["rest"]
        within = F.concat(F.slice(new, 1, s["end"] + 1), rest, F.slice(new, s["end"] + 2, F.size(new) + 1))
        gap = F.when((F.size(new) > 0) & (F.trim(F.element_at(new, -1)) != ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(s["end"].isNotNull(), within).when(F.size(rest) > 0, F.concat(new, gap, F.array(F.lit(f"[{section}]")), rest)).otherwise(new)

    bound = F.transform(F.array(F.transform(marked, number)), places)
    out = F.transform(F.transform(bound, written), joined)[0]
    return F.concat(F.array_join(out, "\n"), F.lit("\n"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def little_floats(hexed: Column, n: int) -> Column:
    """The first n little-endian floats of a hexadecimal text; null if it is shorter or no such text."""
    valid = hexed.rlike("^([0-9a-fA-F]{2})*$") & (F.length(hexed) >= 8 * n)

    byte = lambda i, k: F.substring(hexed, 8 * i + 1 + 2 * k, 2)
    # outside the lambda, as the text may come from a Python function
    words = F.array(*(F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long") for i in range(n)))

    def number(bits: Column) -> Column:
        sign = F.when(bits >= 2**31, -1.0).otherwise(1.0)
        rest = bits.bitwiseAND(F.lit(2**23 - 1))
        finite = lambda power: F.when(power == 0, rest * 2.0**-149).otherwise((rest + 2**23) * F.pow(F.lit(2.0), power - 150))
        told = lambda power: F.when(power == 255, F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).otherwise(finite(power))
        return sign * bound(F.shiftright(bits, 23).bitwiseAND(F.lit(255)), told)

    return F.when(valid, F.transform(words, number))


def inflated(params: Column) -> Column:
    """Parameters as hexadecimal text: those that begin with gz are, after four characters, base64 of a zlib stream. What
    cannot be read is null."""

    @F.pandas_udf("string")
    def inflate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64
        import binascii
        import zlib

        def one(p):
            try:
                return zlib.decompress(base64.b64decode(p[4:])).hex() if p else None
            except (binascii.Error, zlib.error, ValueError):
                return None

        for part in parts:
            yield part.map(one, na_action="ignore")

    packed = params.startswith("gz")
    return F.when(packed, inflate(F.when(packed, params))).otherwise(F.lower(params))


def history_crop(entries: Column) -> Column:
    """entries (operation, enabled, params: hexadecimal) in order -> crop: edges of the last crop that is on and leaves
    something out; n: how many such; rotation: the sum of those of ashift entries that are on; complex: whether one of
    them does more than turn."""
    values = F.transform(F.filter(entries, lambda e: e["enabled"]), lambda e: F.struct(e["operation"].alias("op"), little_floats(e["params"], 4).alias("v")))
    read = F.filter(values, lambda e: e["v"].isNotNull())
    ends = (0.0, 0.0, 1.0, 1.0)
    any_ = lambda v, to: F.exists(F.zip_with(v, F.array(*map(F.lit, to)), lambda a, b: F.abs(a - b) > TRIVIAL), lambda x: x)

    def sorted_out(read: Column) -> Column:
        crops = F.filter(read, lambda e: (e["op"] == "crop") & any_(e["v"], ends))
        return F.struct(crops.alias("crops"), F.filter(read, lambda e: e["op"] == "ashift").alias("turns"))

    def told(s: Column) -> Column:
        crops, turns = s["crops"], s["turns"]
        rotation = F.when(F.size(turns) > 0, F.aggregate(turns, F.lit(0.0), lambda s, e: s + e["v"][0]))
        more = F.exists(turns, lambda e: any_(F.slice(e["v"], 2, 3), (0.0, 0.0, 0.0)))
        return F.struct(F.try_element_at(crops, F.lit(-1))["v"].alias("crop"), rotation.alias("rotation"), F.coalesce(more, F.lit(False)).alias("complex"), F.size(crops).alias("n"))

    return bound(bound(read, sorted_out), told)


def tiff_orientation(content: Column) -> Column:
    """The orientation 1 to 8 in the first directory of a file with a TIFF head (its magic number may differ), else
    null. Only the head and the directory are decoded, each once."""

    def number(raw: Column, little: Column, size: int) -> Column:
        turned = F.concat(*(F.substring(raw, 2 * k + 1, 2) for k in reversed(range(size))))
        return F.when(F.length(raw) == 2 * size, F.conv(F.when(little, turned).otherwise(raw), 16, 10).try_cast("int"))

    hexed = lambda c, at, size: F.hex(F.substring(c, at + 1, F.lit(size)))
    wanted = {end: struct.pack(end + "HH", ORIENTATION, SHORT).hex() for end in "<>"}

    def directory(c: Column, head: Column, start: Column) -> Column:
        little = head.startswith("4949")

        def value(count: Column) -> Column:
            entries = F.transform(F.sequence(F.lit(0), count - 1), lambda i: hexed(c, start + 2 + 12 * i, 12))
            met = F.filter(entries, lambda h: (F.length(h) == 24) & h.startswith(F.when(little, wanted["<"]).otherwise(wanted[">"])))
            first = F.try_element_at(met, F.lit(1))
            return F.when((count >= 1) & (count <= 1000), bound(number(F.substring(first, 17, 4), little, 2), lambda v: F.when(v.between(1, 8), v)))

        return bound(number(hexed(c, start, 2), little, 2), value)

    def opened(c: Column, head: Column) -> Column:
        # no file goes on behind the largest int, where places would overflow
        start = number(F.substring(head, 9, 8), head.startswith("4949"), 4)
        return F.when(head.startswith("4949") | head.startswith("4D4D"), bound(start, lambda at: F.when(at < 2**31 - 20_000, directory(c, head, at))))

    return bound(content, lambda c: bound(F.hex(F.substring(c, 1, 8)), lambda head: opened(c, head)))
