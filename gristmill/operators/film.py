"""Films as a whole, their reviews, and what is written for an image: projections, keyed joins and group medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import text as tx
from gristmill.sources.files import RAWS

# How far a film's crops may lie from its medians, a film's aspect from its own, an image's from the film's.
APART, ASPECT_APART, MATCHING = 0.15, 0.15, 0.20
KEPT = (".jpg", ".jpeg", ".png", ".tif", ".tiff")  # fixed value: copies keep these extensions
CELLS = 60  # fixed value: cells of a progress strip


def line_groups(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Groups of positions whose gap to the one before is below width: group (from 1, ascending), n, mean."""
    order = Window.partitionBy(*by).orderBy(value)
    apart = F.when(F.col(value) - F.lag(value).over(order) < width, 0).otherwise(1)
    placed = rows.where(F.col(value).isNotNull()).withColumn("_new", apart).withColumn("group", F.sum("_new").over(order))
    return placed.groupBy(*by, "group").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def consistent(rows: DataFrame, film: str, aspects: DataFrame) -> DataFrame:
    """rows (film, x, y, width, height, img_w, img_h, confidence) and aspects (film, aspect): a crop that lies farther
    than APART from its film's median, in shares of the image, takes the median at a confidence a tenth lower. Films of
    fewer than three crops stay, as do those whose known aspect their crops do not show. Images without a size are
    taken to reach 100 pixels beyond the crop for the shares, and as wide and high as the crop is wide for the new crop."""
    wide = lambda a: F.greatest(a, 1 / a)
    sized = (F.col("img_w") > 0) & (F.col("img_h") > 0)
    sides = {"x": "img_w", "y": "img_h", "width": "img_w", "height": "img_h"}
    of = {"img_w": F.col("x") + F.col("width") + 100, "img_h": F.col("y") + F.col("height") + 100}
    share = {f"_{c}": F.col(c) / F.when(sized, F.col(s)).otherwise(of[s]) for c, s in sides.items()}
    known = rows.join(aspects.select(film, wide(F.col("aspect")).alias("_film")), film, "left")
    shares = known.withColumns({**share, "_a": wide(F.col("width") / F.greatest("height", F.lit(1)))})
    fits = F.count_if(F.abs(F.col("_a") - F.col("_film")) / F.col("_film") < MATCHING)
    mids = shares.groupBy(film).agg(*(F.median(f"_{c}").alias(f"_m_{c}") for c in sides), F.median("_a").alias("_ma"), F.first("_film").alias("_f"), F.count("*").alias("_n"), fits.alias("_fits"))
    shows = F.col("_f").isNull() | ((F.abs(F.col("_ma") - F.col("_f")) / F.col("_f") <= ASPECT_APART) & (F.col("_fits") >= 3))
    both = shares.join(mids.where((F.col("_n") >= 3) & shows), film, "left")
    apart = F.greatest(*(F.abs(F.col(f"_{c}") - F.col(f"_m_{c}")) / F.greatest(f"_m_{c}", F.lit(0.01)) for c in sides))
    moved = F.coalesce(F.col("_n").isNotNull() & (apart > APART), F.lit(False))
    onto = {c: F.when(moved, F.floor(F.col(f"_m_{c}") * F.coalesce(s, "width"))).otherwise(F.col(c)) for c, s in sides.items()}
    lower = F.bround(F.greatest(F.lit(0.3), F.col("confidence") * 0.9), 3)
    done = both.withColumns({"_moved": moved, **{f"_to_{c}": v for c, v in onto.items()}})
    keep = [c for c in rows.columns if c not in (*sides, "confidence")]
    return done.select(*keep, *(F.col(f"_to_{c}").alias(c) for c in sides), F.when(F.col("_moved"), lower).otherwise(F.col("confidence")).alias("confidence"), F.col("_moved").alias("moved"))


def with_aspect(measured: DataFrame, aspects: DataFrame, film: str, default: float) -> DataFrame:
    """measured (film, valid, contrast) with its film's aspect, else the default; the contrast only where valid."""
    both = measured.join(aspects.select(film, F.col("aspect").alias("_a")), film, "left")
    return both.withColumns({"aspect": F.coalesce("_a", F.lit(default)), "contrast": F.when(F.col("valid"), F.col("contrast"))}).drop("_a")


def reviewed(images: DataFrame, reviews: DataFrame) -> DataFrame:
    """images (key, manual, detected, sized, decision, group, group_override, deg) upserted into reviews (key,
    manual_crop, is_problem, confirmed, tilt_deg). A manual crop becomes the reference, of a red image a problem too; an
    accepted detection becomes a confirmed one; an image made red is a problem. A new reference brings its angle, and
    without one the old goes; so does manual_crop_straight, where images have it as straight. Reviews of other images stay."""
    red = F.col("group") == "red"
    kind = (
        F.when(F.col("manual").isNotNull() & F.col("sized"), "manual")
        .when((F.col("decision") == "accept") & F.col("detected").isNotNull() & F.col("sized"), "accept")
        .when(red & (F.col("group_override") == "red"), "red")
    )
    brought = {"tilt_deg": "deg"} | ({"manual_crop_straight": "straight"} if "straight" in images.columns else {})
    new = images.select("key", kind.alias("_kind"), F.coalesce(red, F.lit(False)).alias("_red"), "manual", "detected", *brought.values()).where("_kind is not null")
    both = reviews.join(new, "key", "full")
    crop = F.when(F.col("_kind") == "manual", F.col("manual")).when(F.col("_kind") == "accept", F.col("detected")).otherwise(F.col("manual_crop"))
    problem = F.when((F.col("_kind") == "red") | ((F.col("_kind") == "manual") & F.col("_red")), True).otherwise(F.col("is_problem"))
    tilt = [F.when(F.col("_kind").isin("manual", "accept"), F.when(F.col("deg") != 0, F.col(v))).otherwise(F.col(c)).alias(c) for c, v in brought.items()]
    rest = [c for c in reviews.columns if c not in ("key", "manual_crop", "is_problem", "confirmed", *brought)]
    return both.select("key", *rest, crop.alias("manual_crop"), problem.alias("is_problem"), F.when(F.col("_kind") == "accept", True).otherwise(F.col("confirmed")).alias("confirmed"), *tilt)


def listed(results: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """results (key, needs_review) with the views that show them: review, ok and problem; all shows every one."""
    both = results.join(reviews.select(key, "is_problem"), key, "left")
    problem = F.coalesce("is_problem", F.lit(False))
    needs = F.coalesce("needs_review", F.lit(False)) | problem
    return both.withColumns({"in_review": needs, "in_ok": ~needs, "in_problem": problem}).drop("is_problem")


def review_counts(shown: DataFrame) -> DataFrame:
    return shown.agg(F.count("*").alias("total"), F.count_if("in_problem").alias("problems"), F.count_if(~F.col("in_problem")).alias("ok"))


def review_lines(results: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """A line of a Markdown table for each result that a review calls a problem, notes or crops."""
    both = results.join(reviews, key)
    problem, noted = F.coalesce("is_problem", F.lit(False)), F.length(F.coalesce("note", F.lit(""))) > 0
    cropped = F.col("crop_w").isNotNull()
    status = F.when(problem, "Problem").when(noted, "Notiz").otherwise("Crop-Adj")
    size = F.when(cropped, F.concat_ws("x", "crop_w", "crop_h")).otherwise("-")
    cells = [F.col(key).cast("string"), F.format_string("%.3f", "confidence"), F.col("method"), F.coalesce("orientation", F.lit("")), status, size, F.coalesce("note", F.lit(""))]
    line = F.concat(F.lit("| "), *(x for c in cells[:-1] for x in (c, F.lit(" | "))), cells[-1], F.lit(" |"))
    return both.where(problem | noted | cropped).select(key, line.alias("line"))


def weak_agreement(rows: DataFrame, film: str, hit: Column) -> DataFrame:
    """Hits among rows that are not missing, per film and (film null) over all."""
    return rows.where(~F.col("missing")).rollup(film).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))


def scorers(conf: Column, size: Column, edge: Column, exposure: Column) -> dict[str, Column]:
    """The fixed formulas that calibration compares; those it fits come from logistic regression."""
    half = 0.5 * size + 0.5 * edge
    return {"current": conf, "edge": edge, "v2": half, "v3": half * exposure}


def samples(results: DataFrame, references: DataFrame, order: str, tolerance: float) -> DataFrame:
    """references (key "film/file", w, h) met by results (filename, width, height, parts) on the name alone, of equal
    names the last: the parts of those that have them, and whether both sides are within the tolerance."""
    last = results.groupBy("filename").agg(F.max_by(F.struct("width", "height", "parts"), order).alias("r"))
    named = references.where(F.col("w").isNotNull()).withColumn("filename", F.regexp_extract("key", "(?s)^[^/]*/(.*)$", 1))
    hit = (F.abs(F.col("r.width") - F.col("w")) < tolerance) & (F.abs(F.col("r.height") - F.col("h")) < tolerance)
    return named.join(last, "filename").where("r.width is not null and r.parts is not null").select("key", F.col("r.parts").alias("parts"), hit.cast("double").alias("y"))


def would_apply(decision: Column, status: Column, detected: Column, manual: Column, group: Column) -> Column:
    """A report's view: no skips, errors or images without a crop; red ones only by hand or accepted."""
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    barred = is_(decision, "skip") | is_(status, "error") | (detected.isNull() & manual.isNull())
    return ~barred & ~(is_(group, "red") & manual.isNull() & ~is_(decision, "accept"))


def not_compatible(path: Column) -> Column:
    """Why a sidecar cannot be written: not_raw, also for DNG, which holds its own; else null."""
    ext = tx.extension(path)
    return F.when(~ext.isin(*RAWS) | (ext == ".dng"), "not_raw")


def history_steps(apply: Column, crop: Column, angle: Column, was_applied: Column, was_angle: Column) -> Column:
    """The steps (operation, enabled) that a plan's entry appends to an image's history."""
    step = lambda op, on: F.struct(F.lit(op).alias("operation"), F.lit(on).alias("enabled"))
    some = lambda c: F.coalesce(c != 0, F.lit(False))
    none = F.array().cast("array<struct<operation:string,enabled:boolean>>")
    off = F.when(some(was_angle), F.array(step("ashift", False))).otherwise(none)
    turn = F.when(some(angle), F.array(step("ashift", True))).otherwise(off)
    yes = F.coalesce(apply, F.lit(False)) & crop.isNotNull()
    return F.when(yes, F.concat(turn, F.array(step("crop", True)))).when(was_applied, F.concat(off, F.array(step("crop", False)))).otherwise(none)


def copy_names(images: DataFrame, order: str) -> DataFrame:
    """images (id, film, filename) with the path of their copy: raw files become JPEG, and of equal paths all but the
    first get their id."""
    folder = F.trim(F.regexp_replace("film", r"(?U)[^\w.\- ]+", "_"))
    ext = tx.extension(F.col("filename"))
    name = images.withColumns({"_d": F.when(folder == "", "film").otherwise(folder), "_s": tx.stem(F.col("filename")), "_e": F.when(ext.isin(*KEPT), ext).otherwise(".jpg")})
    nth = F.row_number().over(Window.partitionBy("_d", "_s", "_e").orderBy(order))
    return name.withColumn("copy", F.concat("_d", F.lit("/"), "_s", F.when(nth > 1, F.concat(F.lit("__"), F.col("id").cast("string"))).otherwise(""), "_e")).drop("_d", "_s", "_e")


def strip_cells(total: Column, share: Column) -> Column:
    """A progress strip: as many cells as images, 1 to CELLS, true as far as the work has come."""
    n = F.greatest(F.lit(1), F.least(total, F.lit(CELLS))).cast("int")
    filled = F.floor(share * n + 1e-9)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i < filled)
