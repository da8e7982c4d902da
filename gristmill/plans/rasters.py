"""Images over the driver's tables. Sixty-four embeddings in a row are an image of 64 x 64 pixels: their components, as
levels, lie over a frame that is turned a little, more or less by the image's number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import detect, raster
from gristmill.operators import rasters as ra
from gristmill.session import table

SIDE = 64
#: The frame, in 24ths of a pixel so that its turn stays whole: twelve rows and ten columns from the border.
_INSIDE = """24 * y >= 288 + (x - 32) * turn and 24 * y < 1248 + (x - 32) * turn and 24 * x >= 240 - (y - 32) * turn and 24 * x < 1296 - (y - 32) * turn"""
_LEVEL = f"case when {_INSIDE} then 160 else 60 end + noise"
#: Film in a bright holder, with the image a little brighter than the film.
_HELD = f"case when y < 3 or y >= 61 or x < 3 or x >= 61 then 235 when {_INSIDE} then 90 else 30 end + noise div 2"
#: Holes along the long edges.
_HOLED = "case when (y < 4 or y >= 60) and (x + 3 * image) % pitch < 2 then 235 else 90 end + noise"


def _pixels(spark: SparkSession, d: str, level: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.expr(f"vec_id div {SIDE}").alias("image"), F.expr(f"cast(vec_id % {SIDE} as int)").alias("y"), F.posexplode("embedding").alias("x", "e"))
    rows = rows.withColumns({"noise": F.expr("coalesce(cast(floor(cast(nanvl(e, 0) as double) * 40) as int), 0)"), "turn": F.expr("cast(image % 7 as int) - 3"), "pitch": F.expr("cast(image div 4 % 4 as int) + 5")})
    return rows.select("image", "y", "x", F.greatest(F.lit(0), F.least(F.lit(255), F.expr(level))).cast("int").alias("v"))


def _images(spark: SparkSession, d: str, level: str) -> DataFrame:
    """A row per image, four times as large for the kernels, with a box a little beside its frame."""
    px = _pixels(spark, d, level)
    lines = px.groupBy("image", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("line"))
    whole = lines.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"))
    return whole.select(
        "image", F.size("lines").alias("height"), F.lit(SIDE).alias("width"), F.flatten(F.transform("lines", lambda p: p["line"])).alias("pixels"),
        *(F.expr(f"cast({v} as int)").alias(c) for c, v in (("x", "39 + image % 3"), ("y", "47 + image % 4"), ("w", "178"), ("h", "161"))),
    )


def raster_tilt(spark: SparkSession, d: str) -> DataFrame:
    """The turn of each image's frame, and the box found again on the straightened image."""
    return ra.tilts(_images(spark, d, _LEVEL), zoom=4).select("image", "deg", "conf", "spread", "sides", "box", "box_score", "error")


def raster_refined(spark: SparkSession, d: str) -> DataFrame:
    """First and second stage of detection: the best box, then the image within it."""
    find = lambda gray, row: dict(zip(("x", "y", "w", "h"), found["box"], strict=True)) if (found := detect.best_box(gray)) else {}
    held = _images(spark, d, _HELD)
    first = ra.per_image(held, ("image",), find, "x int, y int, w int, h int", zoom=4)
    boxed = held.drop("x", "y", "w", "h").join(first.drop("error").where("x is not null"), "image")
    return ra.refined(boxed.withColumn("target", F.lit(1.1)), zoom=4)


def raster_texture(spark: SparkSession, d: str) -> DataFrame:
    return ra.texture(_images(spark, d, _LEVEL), zoom=4).select("image", F.round("content", 6).alias("content"), F.round("agree", 6).alias("agree"))


def raster_equalised(spark: SparkSession, d: str) -> DataFrame:
    return ra.equalised(_pixels(spark, d, _LEVEL)).select("image", "y", "x", "v", "e")


def raster_lines(spark: SparkSession, d: str) -> DataFrame:
    return ra.line_votes(_pixels(spark, d, _LEVEL)).select("image", "level", "deg", "rho", "votes", "place")


def raster_frames(spark: SparkSession, d: str) -> DataFrame:
    return ra.line_frame(ra.line_votes(_pixels(spark, d, _LEVEL)))


def raster_reduced(spark: SparkSession, d: str) -> DataFrame:
    return ra.reduced(_pixels(spark, d, _LEVEL), 1000).select("image", F.col("y").cast("int"), F.col("x").cast("int"), F.round("v", 6).alias("v"), F.round("scale", 9).alias("scale"))


def raster_measure(spark: SparkSession, d: str) -> DataFrame:
    """Shape and contrast of the image in its holder, and its box made to meet the edges."""

    def kernel(gray, row):
        m = raster.measure_image(gray)
        box = raster.refined_box(gray, m["x"] + 5, m["y"] - 4, m["width"] - 8, m["height"] + 6) if m["valid"] else [None] * 5
        return {"valid": m["valid"], "aspect": m.get("aspect"), "contrast": m.get("contrast"), **dict(zip(("x", "y", "width", "height", "score"), box, strict=True))}

    return ra.per_image(_images(spark, d, _HELD).drop("x", "y", "w", "h"), ("image",), kernel, "valid boolean, aspect double, contrast double, x int, y int, width int, height int, score double", zoom=4)


def raster_detect(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of each image that are kept, best first."""
    fields = ("rank", "x", "y", "width", "height", "confidence", "orientation", "n_methods")

    def kernel(gray, row):
        rows = ((i, *c["box"], c["confidence"], c["orientation"], len(c["methods"])) for i, c in enumerate(detect.candidates(gray)))
        return {"found": [dict(zip(fields, r, strict=True)) for r in rows]}

    schema = "found array<struct<rank:int,x:int,y:int,width:int,height:int,confidence:double,orientation:string,n_methods:int>>"
    kept = ra.per_image(_images(spark, d, _HELD).drop("x", "y", "w", "h"), ("image",), kernel, schema, zoom=4)
    return kept.select("image", F.explode("found").alias("f")).select("image", "f.*")


def _overridden(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d, _HELD).drop("x", "y", "w", "h")
    return images.withColumns({"target": F.expr("if(image % 3 = 0, null, 1.1D)"), "border": F.expr("if(image % 5 = 0, 30D, null)"), "no_penalty": F.col("image") % 2 == 0, "one_stage": F.col("image") % 4 == 1})


def raster_detected(spark: SparkSession, d: str) -> DataFrame:
    """Each image's box under overrides of its own."""
    return ra.detected(_overridden(spark, d), zoom=4)


def raster_dumped(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of each image as shares of it, and the best one refined."""
    return ra.dumped(_overridden(spark, d), zoom=4)


def raster_pitch(spark: SparkSession, d: str) -> DataFrame:
    """Four images are a roll: the period of the holes along its edges."""
    holed = _images(spark, d, _HOLED).select(F.expr("image div 4").alias("roll"), "image", "height", "width", "pixels")

    def measure(pdf):
        import numpy as np
        import pandas as pd

        grays = [np.kron(np.array(r.pixels).reshape(r.height, r.width), np.ones((4, 4))) for r in pdf.sort_values("image").itertuples()]
        found = raster.roll_pitch(grays) or {}
        return pd.DataFrame([{"roll": pdf.roll.iloc[0], "drawn": 4.0 * (pdf.roll.iloc[0] % 4 + 5), **{k: found.get(k) for k in ("pitch", "score", "agree")}}])

    return holed.groupBy("roll").applyInPandas(measure, "roll long, drawn double, pitch double, score double, agree double")


def raster_format(spark: SparkSession, d: str) -> DataFrame:
    """Wide or square, for rolls of four images: by the aspect, the raw length or the edges."""
    images = _images(spark, d, _LEVEL).select(F.expr("image div 4").alias("roll"), F.format_string("%06d", "image").alias("path"), "height", "width", "pixels")
    rolls = images.select("roll").distinct().select("roll", (1.0 + F.col("roll") % 5 / 4).alias("aspect"), F.lit(1.5).alias("mm_px"), F.when(F.col("roll") % 3 == 0, 53.0).when(F.col("roll") % 3 == 1, 35.0).alias("raw_long"), F.lit(True).alias("open"))
    return ra.roll_formats(rolls, images)


QUERIES = {f.__name__: f for f in (raster_tilt, raster_refined, raster_texture, raster_equalised, raster_lines, raster_frames, raster_reduced, raster_measure, raster_detect, raster_detected, raster_dumped, raster_pitch, raster_format)}

_PX = f"""
raw as (select vec_id // {SIDE} as image, vec_id % {SIDE} as y, unnest(range(0, len(embedding))) as x, unnest(embedding) as e from embeddings),
named as (select image, y, x, cast(floor(cast(e as double) * 40) as int) as noise, image % 7 - 3 as turn from raw),
px as materialized (select image, cast(y as int) as y, cast(x as int) as x, cast(greatest(0, least(255, {_LEVEL})) as int) as v from named),
size as (select image, max(y) + 1 as h, max(x) + 1 as w from px group by image)
"""
_COS = ", ".join(f"({k}, {c}, {s})" for k, c, s in ra.ANGLES)

_EQUALISED = f"""
with {_PX},
t as (select *, cast(ceil(h / 8) as int) as th, cast(ceil(w / 8) as int) as tw from size),
wide as (
  select image, th, tw, p.my, q.mx from t, lateral (select unnest(range(0, 8 * th)) as my) as p, lateral (select unnest(range(0, 8 * tw)) as mx) as q),
shown as (
  select wide.*, px.v from wide join size using (image) join px on px.image = wide.image
    and px.y = case when my < h then my else 2 * h - 2 - my end and px.x = case when mx < w then mx else 2 * w - 2 - mx end),
hist as (select image, th, tw, my // th as ty, mx // tw as tx, v, count(*) as n from shown group by all),
lim as (select *, greatest(1, cast(floor(4.0 * th * tw / 256) as int)) as m from hist),
cut as (select image, th, tw, ty, tx, sum(greatest(0, n - m)) as cut from lim group by all),
lev as (select cut.*, l.v as v from cut, lateral (select unnest(range(0, 256)) as v) as l),
tot as (
  select lev.*, sum(coalesce(least(lim.n, lim.m), 0)) over (partition by lev.image, lev.ty, lev.tx order by lev.v) + (lev.v + 1) * (lev.cut // 256)
    + case when lev.cut % 256 > 0 then least(lev.cut % 256, lev.v // greatest(1, 256 // (lev.cut % 256)) + 1) else 0 end as s
  from lev left join lim on lim.image = lev.image and lim.ty = lev.ty and lim.tx = lev.tx and lim.v = lev.v),
lut as materialized (select image, ty, tx, v, cast(round_even(cast(s * 255 as double) / (th * tw), 0) as int) as e from tot),
nb as (
  select px.*, th, tw, a.k as ka, b.k as kb, cast(floor((2 * y - th) / (2 * th)) as int) as fy, cast(floor((2 * x - tw) / (2 * tw)) as int) as fx
  from px join t using (image), (values (0), (1)) as a(k), (values (0), (1)) as b(k)),
wt as (
  select *, greatest(0, least(7, fy + ka)) as ty, greatest(0, least(7, fx + kb)) as tx,
    case ka when 1 then 2 * y - th - 2 * th * fy else 2 * th - (2 * y - th - 2 * th * fy) end as my,
    case kb when 1 then 2 * x - tw - 2 * tw * fx else 2 * tw - (2 * x - tw - 2 * tw * fx) end as mx
  from nb)
select wt.image, wt.y, wt.x, wt.v, cast(round_even(cast(sum(my * mx * lut.e) as double) / any_value(4 * th * tw), 0) as int) as e
from wt join lut using (image, ty, tx, v) group by wt.image, wt.y, wt.x, wt.v
"""

_LINES = f"""
with {_PX}, ang(deg, c, s) as (values {_COS}),
st as (
  select image, true as level, y as a, x as u, abs(lead(v) over (partition by image, x order by y) - v) as step from px
  union all select image, false, x, y, abs(lead(v) over (partition by image, y order by x) - v) from px),
strong as (select *, max(step) over (partition by image, level) as most from st qualify step > 0 and step >= 0.5 * most),
votes as (
  select image, level, deg, c, s, cast(floor((a * c - u * s + 2048) / 4096) as bigint) as rho, count(*) as votes from strong, ang group by all),
lines as materialized (
  select image, level, cast(deg as bigint) as deg, rho, votes, h, w,
    cast(floor((rho * 4096 + (case when level then w else h end // 2) * s) / c) as bigint) as place
  from votes join size using (image) where votes >= 0.25 * least(h, w))
"""
ORACLE = {
    "raster_equalised": _EQUALISED,
    "raster_lines": f"{_LINES} select image, level, deg, rho, votes, place from lines",
    "raster_frames": f"""{_LINES},
g as (select *, sum(new) over o as grp from (
  select *, coalesce(cast(place - lag(place) over o > 0.05 * case when level then h else w end as int), 0) as new from lines window o as (partition by image, level order by place, deg, rho))
  window o as (partition by image, level order by place, deg, rho)),
b as (select * from g qualify row_number() over (partition by image, level, grp order by votes desc, abs(deg), deg, rho, place desc) = 1),
e as (
  select image, min(place) filter (level) as t, max(place) filter (level) as u, min(place) filter (not level) as l, max(place) filter (not level) as r,
    arg_min(deg, place) filter (level) as deg from b group by image)
select image, l + 1 as x, t + 1 as y, r - l as width, u - t as height, deg from e where t < u and l < r""",
    "raster_reduced": f"""
with {_PX},
s as (select *, least(1, sqrt(1000.0 / (h * w))) as scale from size),
n as (select *, greatest(1, cast(floor(h * scale) as int)) as nh, greatest(1, cast(floor(w * scale) as int)) as nw from s),
o as (select n.*, a.q as y, b.q as x from n, lateral (select unnest(range(0, nh)) as q) as a, lateral (select unnest(range(0, nw)) as q) as b)
select o.image, cast(o.y as int) as y, cast(o.x as int) as x, round(scale, 9) as scale,
  round(sum(v * (least((px.y + 1) * nh, (o.y + 1) * h) - greatest(px.y * nh, o.y * h)) * (least((px.x + 1) * nw, (o.x + 1) * w) - greatest(px.x * nw, o.x * w))) / any_value(h * w), 6) as v
from o join px on px.image = o.image and px.y * nh < (o.y + 1) * h and (px.y + 1) * nh > o.y * h and px.x * nw < (o.x + 1) * w and (px.x + 1) * nw > o.x * w
group by o.image, o.y, o.x, scale""",
}
