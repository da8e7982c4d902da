"""Image files as tables of grey levels, and the orientation that a file's head states."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import raster

#: The weights of blue, green and red in grey, in 16384ths, and the longest side that is kept.
WEIGHTS, MOST_SIDE = (1868, 9617, 4899), 2000
SCHEMA = "path string, height int, width int, scale double, pixels array<int>, error string"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Levels of an image whose bytes are its channels, pixel by pixel, blue first; a fourth channel is ignored."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int32)
    return x[:, :, 0] if channels < 3 else (x[:, :, :3] @ np.array(WEIGHTS, np.int32) + 8192) >> 14


def images(spark: SparkSession, folder: str, most_side: int = MOST_SIDE) -> DataFrame:
    """path, height, width, scale, pixels, error of every file below a folder: decoded by Spark's own reader (JPEG, PNG,
    TIFF, BMP, GIF), made grey and, where a side is longer than most_side, smaller by means of areas as it is read. A file
    that cannot be decoded has nulls and an error."""
    read = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():  # one image at a time, as each is large
                out = {"path": row["origin"], "height": None, "width": None, "scale": None, "pixels": None, "error": None}
                if row["height"] < 0:
                    out["error"] = "no image"
                else:
                    g = grey(row["data"], row["height"], row["width"], row["nChannels"])
                    scale = min(1.0, most_side / max(g.shape))
                    if scale < 1:
                        g = np.rint(raster.area_mean(g, *(max(1, int(n * scale)) for n in g.shape))).astype(np.int32)
                    out |= {"height": g.shape[0], "width": g.shape[1], "scale": scale, "pixels": g.ravel()}
                kinds = {"path": pa.string(), "height": pa.int32(), "width": pa.int32(), "scale": pa.float64(), "pixels": pa.list_(pa.int32()), "error": pa.string()}
                yield pa.RecordBatch.from_arrays([pa.array([out[k]], t) for k, t in kinds.items()], names=list(kinds))

    return read.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, SCHEMA)


def _directory(data: bytes, base: int, at: int, order: str, seen: set[int], depth: int = 0) -> int | None:
    """The orientation in the directory at an offset, else in those nested in it or next to it. Each is read once."""
    if depth > 4 or at in seen or base + at + 2 > len(data) or at < 8:
        return None
    seen.add(at)
    (n,) = struct.unpack_from(order + "H", data, base + at)
    below = []
    for k in range(n):
        place = base + at + 2 + 12 * k
        if place + 12 > len(data):
            return None
        tag, kind, count = struct.unpack_from(order + "HHI", data, place)
        if tag == 0x0112 and kind == 3 and count >= 1:
            (value,) = struct.unpack_from(order + "H", data, place + 8)
            if 1 <= value <= 8:
                return value
        if tag in (0x8769, 0x014A) and kind == 4 and count == 1:
            below.append(struct.unpack_from(order + "I", data, place + 8)[0])
    after = base + at + 2 + 12 * n
    if after + 4 <= len(data):
        below.append(struct.unpack_from(order + "I", data, after)[0])
    return next((v for b in below if (v := _directory(data, base, b, order, seen, depth + 1))), None)


def _tiff(data: bytes, base: int) -> int | None:
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None or len(data) < base + 8:
        return None
    mark, at = struct.unpack_from(order + "HI", data, base + 2)
    return _directory(data, base, at, order, set()) if mark == 42 else None


def stated_orientation(data: bytes | None) -> int | None:
    """1 to 8 from a TIFF's directories, or from the directories in a JPEG's segments; None if none states it."""
    if not data:
        return None
    if data[:2] != b"\xff\xd8":
        return _tiff(data, 0)
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xFF:  # padding before a marker
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):  # the image's end, or its pixels
            return None
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers that stand alone
            at += 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            # offsets count from the segment's own head, and nothing beyond it is read
            found = _tiff(data[: at + 2 + length], at + 10)
            if found:
                return found
        if length < 2:
            return None
        at += 2 + length
    return None


def orientations(files: DataFrame, head: int = 1 << 20) -> DataFrame:
    """files (path, content) -> path, orientation, from the first `head` bytes of each, where heads are."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stated_orientation(c.as_py()) for c in batch.column(1)], pa.int32())], names=["path", "orientation"])

    return files.select("path", F.substring("content", 1, head).alias("content")).mapInArrow(run, "path string, orientation int")
