"""Images as tables. `images` have a row each (image, height, width, pixels: grey levels row by row); `pixels` have a row
for each pixel (image, y, x, v). Equalisation and voting for lines are joins and groupings of pixels; what needs an
image as a whole is a kernel of functions.tilt and functions.content, applied to one image at a time in Arrow batches.

An image without pixels (null, or not as many as its sides say) has nulls and the reason in `error`; a kernel's failure
has too, so no task is repeated for one bad image."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gristmill.functions import content, detect, raster
from gristmill.functions import tilt as tl
from gristmill.operators.selection import strided

LEVELS = 256


def pixels(images: DataFrame, key: str = "image") -> DataFrame:
    each = images.select(key, "width", F.posexplode("pixels").alias("i", "v"))
    return each.select(key, F.expr("cast(i div width as int)").alias("y"), F.expr("cast(i % width as int)").alias("x"), F.col("v").cast("int").alias("v"))


def _mirrored(at: Column, n: Column, total: Column) -> Column:
    """The places up to total that show place `at` of n, when what lies beyond n is its mirror image."""
    shown = lambda q: F.when(n == 1, 0).otherwise(F.when(F.pmod(q, 2 * n - 2) < n, F.pmod(q, 2 * n - 2)).otherwise(2 * n - 2 - F.pmod(q, 2 * n - 2)))
    beyond = F.when(total > n, F.filter(F.sequence(n, F.greatest(n, total - 1)), lambda q: (q < total) & (shown(q) == at))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(at), beyond)


def equalised(px: DataFrame, clip: float = 4.0, tiles: int = 8) -> DataFrame:
    """pixels -> pixels with e, their level after contrast-limited adaptive equalisation.

    The image is cut into tiles x tiles equal parts (mirrored where it has to be longer); each part's histogram is cut
    off at clip times its mean and what is cut is dealt out again evenly; its running sum is the part's look-up table.
    A pixel takes the mean of the four nearest parts' tables, weighted by how near their middles are. All in integers,
    halves to even."""
    sizes = px.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    sizes = sizes.withColumns({"th": F.ceil(F.col("h") / tiles).cast("int"), "tw": F.ceil(F.col("w") / tiles).cast("int")})
    rows = px.join(sizes, "image")
    seen = rows.withColumn("my", F.explode(_mirrored(F.col("y"), F.col("h"), F.col("th") * tiles))).withColumn("mx", F.explode(_mirrored(F.col("x"), F.col("w"), F.col("tw") * tiles)))
    parts = seen.groupBy("image", "th", "tw", F.expr("cast(my div th as int)").alias("ty"), F.expr("cast(mx div tw as int)").alias("tx"), "v").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(1), F.floor(F.lit(float(clip)) * F.col("th") * F.col("tw") / LEVELS).cast("int"))
    parts = parts.withColumn("limit", limit).withColumn("kept", F.least("n", "limit"))
    tables = parts.groupBy("image", "th", "tw", "ty", "tx").agg(F.sum(F.col("n") - F.col("kept")).alias("cut"), F.map_from_entries(F.collect_list(F.struct("v", "kept"))).alias("has"))
    levels = tables.select("image", "th", "tw", "ty", "tx", "cut", F.col("has"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("v"))
    levels = levels.withColumn("n", F.coalesce(F.try_element_at("has", F.col("v")), F.lit(0))).drop("has")
    below = Window.partitionBy("image", "ty", "tx").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.expr(f"cut % {LEVELS}")
    dealt = F.when(rest > 0, F.least(rest, F.floor(F.col("v") / F.greatest(F.lit(1), F.floor(F.lit(LEVELS) / rest))) + 1)).otherwise(0)
    total = F.sum("n").over(below) + (F.col("v") + 1) * F.expr(f"cut div {LEVELS}") + dealt
    tables = levels.select("image", "ty", "tx", "v", F.bround(total * (LEVELS - 1) / (F.col("th") * F.col("tw"))).cast("int").alias("e"))

    def near(at: str, part: str) -> Column:
        """The two parts whose middles are nearest, and how much of 2 * part each has."""
        return F.expr(f"""transform(array(0, 1), k -> struct(
            cast(greatest(0, least({tiles - 1}, cast(floor((2 * {at} - {part}) / (2 * {part})) as int) + k)) as int) as t,
            if(k = 1, pmod(2 * {at} - {part}, 2 * {part}), 2 * {part} - pmod(2 * {at} - {part}, 2 * {part})) as m))""")

    met = rows.select("image", "y", "x", "v", "th", "tw", F.explode(near("y", "th")).alias("a"), near("x", "tw").alias("b")).withColumn("b", F.explode("b"))
    met = met.select("image", "y", "x", "v", (4 * F.col("th") * F.col("tw")).alias("whole"), F.col("a.t").alias("ty"), F.col("b.t").alias("tx"), (F.col("a.m") * F.col("b.m")).alias("m"))
    joined = met.join(tables, ["image", "ty", "tx", "v"])
    return joined.groupBy("image", "y", "x", "v").agg(F.bround(F.sum(F.col("m") * F.col("e")) / F.first("whole")).cast("int").alias("e"))


#: Cosine and sine of -10..10 degrees in 4096ths.
ANGLES = [(k, round(4096 * float(np.cos(np.radians(k)))), round(4096 * float(np.sin(np.radians(k))))) for k in range(-10, 11)]


def line_votes(px: DataFrame, share: float = 0.5, least: float = 0.25) -> DataFrame:
    """pixels -> image, level, deg, rho, votes, place: straight lines up to 10 degrees off level or upright.

    A pixel whose step to the next one across is at least `share` of the image's largest votes for every line through
    it, one for each whole degree: rho is a line's distance from the origin. Lines with votes from `least` of the shorter
    side stay. place: where a line crosses the image's middle. Votes are combined before they are shuffled."""
    sizes = px.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    steps = []
    for level, across, along in ((True, "y", "x"), (False, "x", "y")):
        follow = Window.partitionBy("image", along).orderBy(across)
        steps.append(px.select("image", F.lit(level).alias("level"), F.col(across).alias("a"), F.col(along).alias("u"), F.abs(F.lead("v").over(follow) - F.col("v")).alias("step")).where("step > 0"))
    steps = steps[0].unionByName(steps[1])
    strong = steps.groupBy("image", "level").agg(F.max("step").alias("most"))
    strong = steps.join(strong, ["image", "level"]).where(F.col("step") >= F.lit(share) * F.col("most"))
    angles = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("deg", "c", "s"), t, strict=True))) for t in ANGLES))
    votes = strong.select("image", "level", "a", "u", F.explode(angles).alias("t")).groupBy("image", "level", F.col("t.deg").alias("deg"), F.col("t.c").alias("c"), F.col("t.s").alias("s"), F.floor(F.expr("(a * t.c - u * t.s + 2048) / 4096")).alias("rho")).agg(F.count("*").alias("votes"))
    lines = votes.join(sizes, "image").where(F.col("votes") >= F.lit(least) * F.least("h", "w"))
    middle = F.when(F.col("level"), F.col("w")).otherwise(F.col("h"))
    place = F.floor((F.col("rho") * 4096 + F.floor(middle / 2) * F.col("s")) / F.col("c"))
    return lines.select("image", "level", "deg", "rho", "votes", place.alias("place"), "h", "w")


def line_frame(lines: DataFrame, apart: float = 0.05) -> DataFrame:
    """line_votes -> image, x, y, width, height, deg: between the outermost groups of lines. Lines whose places are no
    more than `apart` of the side from the next one's are a group, which has the place of the line with most votes; deg is
    that of the top line. Images without two groups each way are left out."""
    side = F.when(F.col("level"), F.col("h")).otherwise(F.col("w"))
    # within one image: at most its sides' length of places
    order = Window.partitionBy("image", "level").orderBy("place", "deg", "rho")
    grouped = lines.withColumn("new", (F.col("place") - F.lag("place").over(order) > F.lit(apart) * side).cast("int"))
    grouped = grouped.withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(order))
    best = grouped.groupBy("image", "level", "group").agg(F.max(F.struct("votes", (-F.abs("deg")).alias("m"), (-F.col("deg")).alias("n"), (-F.col("rho")).alias("r"), "place")).alias("b"))
    ends = best.groupBy("image").agg(*(f(F.when(F.col("level") == level, F.col("b.place"))).alias(name) for name, f, level in (("top", F.min, True), ("bottom", F.max, True), ("left", F.min, False), ("right", F.max, False))), F.min(F.when(F.col("level"), F.struct("b.place", (-F.col("b.n")).alias("deg")))).alias("t"))
    fine = ends.where("top < bottom and left < right")
    return fine.select("image", (F.col("left") + 1).alias("x"), (F.col("top") + 1).alias("y"), (F.col("right") - F.col("left")).alias("width"), (F.col("bottom") - F.col("top")).alias("height"), "t.deg")


def per_image(images: DataFrame, keep: tuple[str, ...], kernel: Callable[[np.ndarray, dict], dict], schema: str, zoom: int = 1) -> DataFrame:
    """images -> the columns of keep and of schema, and error. kernel(gray, the row's other columns) gives a dict. zoom:
    each pixel is repeated so many times both ways."""
    others = [c for c in images.columns if c not in ("pixels", "height", "width")]
    kept = images.select(*(F.col(c) for c in keep)).schema.fields
    out = StructType([*kept, *StructType.fromDDL(f"{schema}, error string").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out)
        for batch in batches:
            names = batch.schema.names
            rest = batch.select([n for n in names if n != "pixels"]).to_pylist()
            found = []
            for i, row in enumerate(rest):
                levels = batch.column(names.index("pixels"))[i]
                told = {k: row[k] for k in keep}
                try:
                    if not levels.is_valid or not row["height"] or not row["width"] or len(levels) != row["height"] * row["width"]:
                        raise ValueError("no pixels")
                    gray = levels.values.to_numpy(zero_copy_only=False).reshape(row["height"], row["width"])
                    told |= kernel(np.repeat(np.repeat(gray, zoom, 0), zoom, 1), row)
                except (ValueError, ArithmeticError, LookupError) as e:
                    told["error"] = str(e)[:200] or type(e).__name__
                found.append(told)
            yield pa.RecordBatch.from_arrays([pa.array([f.get(n) for f in found], kinds.field(n).type) for n in kinds.names], schema=kinds)

    return images.select(*others, "height", "width", "pixels").mapInArrow(run, out)


_BOX = ("x", "y", "w", "h")


def tilts(images: DataFrame, zoom: int = 1) -> DataFrame:
    """images with boxes (x, y, w, h) -> image, deg, conf, spread, sides and lines, and where |deg| is worth it the box on the
    straightened image and its score."""

    def kernel(gray: np.ndarray, row: dict) -> dict:
        out = tl.tilt_and_box(gray, *(row[c] for c in _BOX))
        return out | {"sides": list(out["sides"].items()), "lines": [(k, [c for p in v for c in p]) for k, v in out["lines"].items()]}

    return per_image(images, ("image",), kernel, "deg double, conf double, spread double, sides map<string,double>, lines map<string,array<double>>, box array<int>, box_score double", zoom)


def refined(images: DataFrame, zoom: int = 1) -> DataFrame:
    """images with boxes and, if known, the film's border level and target (nulls: not) -> image, x, y, w, h, way."""

    def kernel(gray: np.ndarray, row: dict) -> dict:
        found = content.refined_content(gray, *(row[c] for c in _BOX), row.get("border"), row.get("target"))
        return dict(zip((*_BOX, "way"), found, strict=True))

    return per_image(images, ("image",), kernel, "x int, y int, w int, h int, way string", zoom)


def detected(images: DataFrame, zoom: int = 1) -> DataFrame:
    """images with their overrides (target: the film's shape, 1.5 where null; border: its level, null if not known;
    no_penalty, one_stage: false where null) -> image, the box of both stages or of the first alone, its confidence, the
    methods that found it and how the second stage ended (null without it). No candidate: nulls, and an error."""

    def kernel(gray: np.ndarray, row: dict) -> dict:
        found = detect.best_box(gray, row.get("target") or 1.5, not row.get("no_penalty"))
        if found is None:
            raise ValueError("no candidate")
        box, way = found["box"], None
        if not row.get("one_stage"):
            *box, way = content.refined_content(gray, *box, row.get("border"), row.get("target"))
        return dict(zip(_BOX, map(int, box), strict=True)) | {"confidence": found["confidence"], "methods": found["methods"], "way": way}

    return per_image(images, ("image",), kernel, "x int, y int, w int, h int, confidence double, methods array<string>, way string", zoom)


def dumped(images: DataFrame, zoom: int = 1) -> DataFrame:
    """images with the film's shape (target, 1.5 where null) -> image, rank, crop (of 1), confidence, method: all candidates,
    best first, and last the best one after the second stage, whose method is refined."""

    def kernel(gray: np.ndarray, row: dict) -> dict:
        small, _ = raster.detection_size(gray)
        target = row.get("target") or 1.5
        kept = detect.candidates(small, target)
        boxes = [(k["box"], k["confidence"], k["methods"][0]) for k in kept]
        if kept:
            *box, _ = content.refined_content(small, *kept[0]["box"], None, target)
            boxes.append((box, kept[0]["confidence"], "refined"))
        high, wide = small.shape
        crop = lambda x, y, w, h: [float(x / wide), float(y / high), float((x + w) / wide), float((y + h) / high)]
        return {"found": [{"rank": i, "crop": crop(*b), "confidence": conf, "method": name} for i, (b, conf, name) in enumerate(boxes)]}

    out = per_image(images, ("image",), kernel, "found array<struct<rank:int,crop:array<double>,confidence:double,method:string>>", zoom)
    return out.select("image", F.explode("found").alias("f")).select("image", "f.*")


def texture(images: DataFrame, zoom: int = 1) -> DataFrame:
    """images with boxes -> image, content, agree."""
    kernel = lambda gray, row: dict(zip(("content", "agree"), content.content_signals(gray, *(row[c] for c in _BOX)), strict=True))
    return per_image(images, ("image",), kernel, "content double, agree double", zoom)


def roll_formats(rolls: DataFrame, images: DataFrame, long_mm: float = 36.0, short_mm: float = 24.0, square_aspect: float = 1.0, sample: int = 6) -> DataFrame:
    """rolls (roll, aspect, mm_px, raw_long, open: whether both formats are possible), images (roll, path, height, width,
    pixels) -> roll, format ("3:2" or "square"), why.

    An aspect near 3:2 decides; else the roll's raw length, if it is within 8 % of one format and more than 20 % off the
    other; else edges: the format whose centred frames have the better median score over `sample` images of the roll,
    where a square needs 0.05 more. Only rolls that edges decide have images opened."""
    off = lambda mm: F.abs(F.col("raw_long") - mm * F.col("mm_px")) / (mm * F.col("mm_px"))
    wide, square = F.coalesce(off(long_mm), F.lit(1.0)), F.coalesce(off(short_mm * square_aspect), F.lit(1.0))
    usual = ~F.coalesce("open", F.lit(False)) | F.col("aspect").between(1.38, 1.62)
    decided = F.when(usual, F.struct(F.lit("3:2").alias("format"), F.lit("aspect").alias("why")))
    decided = decided.when((wide < 0.08) & (square > 0.20), F.struct(F.lit("3:2").alias("format"), F.lit("length").alias("why")))
    decided = decided.when((square < 0.08) & (wide > 0.20), F.struct(F.lit("square").alias("format"), F.lit("length").alias("why")))
    told = rolls.withColumn("_d", decided)
    few = strided(images.select("roll", "path").join(told.where("_d is null").select("roll", "mm_px"), "roll"), ["roll"], ["path"], sample)
    few = images.join(few, ["roll", "path"])

    def kernel(gray: np.ndarray, row: dict) -> dict:
        short = short_mm * row["mm_px"]
        return {"wide": content.edges_for(gray, long_mm * row["mm_px"], short), "square": content.edges_for(gray, short * square_aspect, short)}

    seen = per_image(few.select("roll", "mm_px", "height", "width", "pixels"), ("roll",), kernel, "wide double, square double")
    edges = seen.groupBy("roll").agg(F.median("wide").alias("e_wide"), F.median("square").alias("e_square"))
    by_edges = F.struct(F.when(F.coalesce(F.col("e_square") > F.col("e_wide") + 0.05, F.lit(False)), "square").otherwise("3:2").alias("format"), F.lit("edges").alias("why"))
    return told.join(edges, "roll", "left").withColumn("_d", F.coalesce("_d", by_edges)).select("roll", "_d.format", "_d.why")


def reduced(px: DataFrame, most: float = raster.MOST_PIXELS) -> DataFrame:
    """pixels -> image, y, x, v (double), scale: images of more than `most` pixels made smaller, each new pixel the mean of
    what it covers, partial pixels counting in part."""
    sizes = px.groupBy("image").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(most)) / (F.col("h") * F.col("w"))))
    sizes = sizes.withColumn("scale", scale).withColumns({"nh": F.greatest(F.lit(1), F.floor(F.col("h") * F.col("scale"))).cast("int"), "nw": F.greatest(F.lit(1), F.floor(F.col("w") * F.col("scale"))).cast("int")})

    def shares(at: str, n: str, new: str) -> Column:
        """The new places that a pixel reaches, and how much of it each has, in units of 1 / new."""
        first, last = f"({at} * {new}) div {n}", f"(({at} + 1) * {new} - 1) div {n}"
        return F.expr(f"transform(sequence({first}, {last}), q -> struct(cast(q as int) as q, least((q + 1) * {n}, ({at} + 1) * {new}) - greatest(q * {n}, {at} * {new}) as m))")

    met = px.join(sizes, "image").select("image", "v", "scale", "h", "w", F.explode(shares("y", "h", "nh")).alias("a"), shares("x", "w", "nw").alias("b")).withColumn("b", F.explode("b"))
    weighted = F.sum(F.col("v").cast("long") * F.col("a.m") * F.col("b.m")) / F.first(F.col("h").cast("long") * F.col("w"))
    return met.groupBy("image", F.col("a.q").alias("y"), F.col("b.q").alias("x")).agg(weighted.alias("v"), F.first("scale").alias("scale"))
