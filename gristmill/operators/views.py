"""What a session shows of each image, what its review writes back, a report over corrected rows, probes for sidecars and
lines of the run protocol. The view is one projection; the rest are keyed joins and counts that combine before the
exchange."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import geometry as ge
from gristmill.functions.xmp import CRS, DT
from gristmill.operators import evaluate as ev
from gristmill.operators import film as fi
from gristmill.operators import review as rv
from gristmill.operators.robust import exact_median

# How far a corrected detection's angle may lie from the present one, the least change of angle that moves
# a manual crop, and how many characters of a sidecar are probed.
SAME_ANGLE, MOVES, HEAD = 0.15, 0.005, 4096
GROUPS = ("green", "yellow", "red")
VIEW = (
    "target_ok", "target_reason", "id", "filename", "film", "status", "error", "group", "auto_group", "confidence", "method", "reasons", "conf_parts",
    "skew", "detected_crop", "straighten", "view_size", "skew_lines", "manual_crop", "crop", "decision", "proposal", "ref", "apply", "export_size", "has_export",
)


def _auto_group(green: float, yellow: float) -> Column:
    """By confidence, 0 where it is not given; red without a detection."""
    conf = F.coalesce("detected.confidence", F.lit(0.0))
    return F.when(F.col("detected").isNull(), "red").otherwise(ev.band(conf, green, yellow))


def _bound(f: Callable[..., Column], first: Column, *rest: Column) -> Column:
    """f of columns that are computed once, however often f names them; null where the first is null."""
    whole = F.struct(*(v.alias(f"c{i}") for i, v in enumerate((first, *rest))))
    return F.transform(F.array(whole), lambda s: F.when(s["c0"].isNotNull(), f(*(s[f"c{i}"] for i in range(len(rest) + 1)))))[0]


def placed(images: DataFrame, green: float = 0.5, yellow: float = 0.3) -> DataFrame:
    """images with straighten (the angle, null if off), their crops in the present frame (detected_crop, manual_crop as
    it was set, crop) and in the original one (orig_crop), auto_group and group.

    images: id, film, filename, status, error, detected (crop, confidence, method, reasons, conf_parts, skew (deg, conf,
    lines, straight (deg, crop))), straighten (deg; null: automatic, with a null deg: off), manual (crop, deg), decision,
    group_override, export_size (width, height). Crops are four numbers. All may be null but id; without a size nothing
    is turned."""
    c = F.col
    w, h = (c(f"export_size.{s}").cast("double") for s in ("width", "height"))
    auto = ge.straight_degrees(c("detected.skew.deg"), c("detected.skew.conf"), c("straighten").isNotNull(), c("straighten.deg"))
    out = images.withColumns({"_deg": F.nullif(auto, F.lit(0.0)), "_w": w, "_h": h})
    out = out.withColumn("_turn", F.when(c("export_size").isNotNull(), c("_deg")))
    # the manual crop goes back to the frame it was set in, then to the present one
    was = F.coalesce("manual.deg", F.lit(0.0))
    moves = c("export_size").isNotNull() & (F.abs(F.coalesce("_deg", F.lit(0.0)) - was) > MOVES)
    turn = lambda way, crop, deg: _bound(way, crop, c("_w"), c("_h"), deg)
    flat = F.when(moves & (was != 0), turn(ge.from_straight, c("manual.crop"), was)).otherwise(c("manual.crop"))
    near = F.abs(c("detected.skew.straight.deg") - c("_turn")) < SAME_ANGLE
    seen = F.when(c("_turn").isNull(), c("detected.crop")).when(near, c("detected.skew.straight.crop")).otherwise(turn(ge.to_straight, c("detected.crop"), c("_turn")))
    out = out.withColumns({"_flat": flat, "_moves": moves, "detected_crop": seen})
    by_hand = F.when(c("_moves") & c("_deg").isNotNull(), turn(ge.to_straight, c("_flat"), c("_deg"))).otherwise(c("_flat"))
    out = out.withColumn("crop", F.when(c("manual").isNotNull(), by_hand).otherwise(c("detected_crop")))
    back = F.when(c("_turn").isNotNull(), turn(ge.from_straight, c("crop"), c("_turn"))).otherwise(c("crop"))
    own = _auto_group(green, yellow)
    out = out.withColumns({"orig_crop": back, "manual_crop": c("manual.crop"), "auto_group": own, "group": rv.effective_group(c("group_override"), own)})
    return out.withColumn("straighten", c("_deg")).drop("_deg", "_flat", "_moves")


def deviation(found: Column, reference: Column, width: Column, height: Column) -> Column:
    """Two boxes in pixels: the differences, the tolerance, size hit, strict hit, and the largest difference in tolerances."""
    tol = ev.tolerance(width, height)
    d = {f"d{n}": found[k] - reference[k] for n, k in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))}
    worst = F.greatest(*map(F.abs, d.values()))
    told = {"tol": F.bround(tol, 1), "hit": ev.hit(d["dw"], d["dh"], tol), "strict": ev.strict_hit(*d.values(), tol), "score": F.bround(worst / tol, 2)}
    return F.struct(*(v.alias(k) for k, v in (d | told).items()))


def public_images(images: DataFrame, green: float = 0.5, yellow: float = 0.3) -> DataFrame:
    """The read model of images: the columns of VIEW. Beside what `placed` takes: target_reason (why the target can't take
    it, null if it can), proposal (crop, confidence, method, reasons, error), has_export. A proposal with an error shows
    only that; proposals, lines and crops are in the straightened frame where there is one. ref is how far the detection
    lies from the reference drawn by hand, in the original frame; null without both or without a size."""
    c = F.col
    rows = placed(images, green, yellow)
    point = lambda p: ge.point_to_straight(p, c("_w"), c("_h"), c("_turn"))
    lines = F.when(c("_turn").isNull(), c("detected.skew.lines")).otherwise(F.transform_values("detected.skew.lines", lambda _, v: F.transform(v, point)))
    offered = F.when(c("_turn").isNull(), c("proposal.crop")).otherwise(_bound(ge.to_straight, c("proposal.crop"), c("_w"), c("_h"), c("_turn")))
    shown = {"crop": offered, **{k: c(f"proposal.{k}") for k in ("confidence", "method", "reasons")}}
    failed = c("proposal.error").isNotNull()
    proposal = F.when(c("proposal").isNotNull(), F.struct(*(F.when(~failed, v).alias(k) for k, v in shown.items()), c("proposal.error").alias("error")))
    both = c("detected").isNotNull() & c("manual").isNotNull() & c("export_size").isNotNull()
    wide = lambda deg, w, h: F.transform(F.array(*(ge.straight_size(w, h, deg)[n] for n in ("width", "height"))), lambda v: F.bround(v, 1))
    view = F.when(c("_turn").isNull(), F.array("_w", "_h")).otherwise(_bound(wide, c("_turn"), c("_w"), c("_h")))
    rows = rows.withColumns({
        "_found": F.when(both, _bound(ge.to_pixels, c("detected.crop"), c("_w"), c("_h"))), "_wanted": F.when(both, _bound(ge.to_pixels, c("orig_crop"), c("_w"), c("_h"))),
        "skew_lines": lines, "_shown": proposal, "view_size": F.when(c("export_size").isNotNull(), view), "target_ok": c("target_reason").isNull(),
    })
    broken = F.when(c("status") == "error", F.lit("error"))
    applies = rv.will_apply(c("decision"), broken, c("crop").isNotNull(), c("group"), c("manual").isNotNull(), c("target_ok"))
    rows = rows.withColumns({
        "ref": _bound(deviation, c("_found"), c("_wanted"), c("_w"), c("_h")), "apply": applies, "proposal": c("_shown"), "skew": c("detected.skew"),
        "confidence": c("detected.confidence"), "method": c("detected.method"), "conf_parts": c("detected.conf_parts"),
        "reasons": F.coalesce("detected.reasons", F.array().cast("array<string>")), "has_export": F.coalesce("has_export", F.lit(False)),
    })
    return rows.select(*VIEW)


def review_target(images: DataFrame, reviews: DataFrame, green: float = 0.5, yellow: float = 0.3) -> DataFrame:
    """Images as `placed` takes them, upserted into reviews (key "film/file", manual_crop in pixels, is_problem, confirmed,
    tilt_deg, manual_crop_straight (crop, width, height)) as film.reviewed does. References lie in the original frame; a
    straightened image's also bring its angle, and its crop and size in the straightened frame."""
    c = F.col
    rows = placed(images, green, yellow)
    side = lambda size, n: F.bround(size[n]).cast("int").alias(n)
    within = lambda crop, w, h, deg: F.struct(crop.alias("crop"), *(side(ge.straight_size(w, h, deg), n) for n in ("width", "height")))
    pixels = F.when(c("export_size").isNotNull(), _bound(ge.to_pixels, c("orig_crop"), c("_w"), c("_h")))
    rows = rows.select(
        F.concat_ws("/", "film", "filename").alias("key"), F.when(c("manual").isNotNull(), pixels).alias("manual"), F.when(c("detected").isNotNull(), pixels).alias("detected"),
        c("export_size").isNotNull().alias("sized"), "decision", "group", "group_override", F.coalesce("_turn", F.lit(0.0)).alias("deg"), _bound(within, c("crop"), c("_w"), c("_h"), c("_turn")).alias("straight"),
    )
    return fi.reviewed(rows, reviews)


def _wrong() -> Column:
    """Corrected, and not by so little that it was a strict hit; an unknown one counts as a hit."""
    return F.coalesce(F.col("corrected"), F.lit(False)) & ~F.coalesce("strict_hit", F.lit(True))


def feedback_groups(rows: DataFrame) -> DataFrame:
    """rows (auto, has_detection, corrected, strict_hit, conf) -> of each automatic group, present or not: rows with a
    detection, how many were corrected, how many of these by much, the median confidence (null without any)."""
    seen = rows.where("has_detection")
    counts = seen.groupBy("auto").agg(F.count("*").alias("n"), F.count_if("corrected").alias("corrected"), F.count_if(_wrong()).alias("bad"))
    mid = exact_median(seen, ["auto"], "conf").select("auto", F.col("median").alias("median_conf"))
    every = rows.sparkSession.createDataFrame([(g,) for g in GROUPS], "auto string")
    return every.join(counts, "auto", "left").join(mid, "auto", "left").na.fill(0, ["n", "corrected", "bad"])


def feedback_counts(rows: DataFrame, factors: list[str]) -> DataFrame:
    """rows (auto, final, corrected, strict_hit, symptom, factors) -> kind, name, n: moves between groups, symptoms of
    false greens, and the weakest factor of rows corrected by much, of equal ones the first named; rows that have none of
    the factors say nothing. One count of at most three names a row, combined before the exchange."""
    c, wrong = F.col, _wrong()
    lowest = F.array_min(F.filter(F.array(*(F.struct(c(f).cast("double").alias("v"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, f in enumerate(factors))), lambda x: x["v"].isNotNull()))
    named = {"move": F.when(c("auto") != c("final"), F.concat_ws("->", "auto", "final")), "symptom": F.when(wrong & (c("auto") == "green"), c("symptom")), "weakest": F.when(wrong, lowest["name"])}
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in named.items()))).alias("x")).select("x.*")
    return each.where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))


def false_greens(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("auto") == "green") & _wrong())


def without_extension(path: Column) -> Column:
    """As a path is split: a name's leading dots begin no extension."""
    return F.regexp_replace(path, r"([^/.][^/]*)\.[^./]*$", "$1")


def _candidates(path: Column) -> Column:
    return F.array(F.concat(path, F.lit(".xmp")), F.concat(without_extension(path), F.lit(".xmp")))


def sidecars(images: DataFrame) -> DataFrame:
    """path, text of the sidecars that images (path, local or a URI) have. Tasks open them one at a time under the names
    they may have, as Spark's readers pass over empty files and names that begin with a dot or an underscore. Bytes that
    are no UTF-8 become replacement characters; a file that cannot be read has a null text."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                if not store.get_file_info(at).is_file:
                    continue
                try:
                    with store.open_input_stream(at) as f:
                        text = f.read().decode("utf-8", "replace")
                except OSError:
                    text = None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], names=["path", "text"])

    names = images.where("path is not null").select(F.explode(_candidates(F.col("path"))).alias("path")).distinct()
    return names.mapInArrow(run, "path string, text string")


def sidecar_probes(images: DataFrame, texts: DataFrame) -> DataFrame:
    """images (path) with sidecar (the one named by the whole name, else by the name without its extension, else null),
    has_adobe (the latter holds settings of raw conversion) and has_darktable (the former names its program near its
    start). texts (path, text) are reduced to two flags before the join, so that no text is shuffled; of rows of one path
    any may set a flag, a null text sets none."""
    near = F.contains(F.substring("text", 1, HEAD), F.lit(DT))
    flags = texts.groupBy(F.col("path").alias("_at")).agg(F.coalesce(F.bool_or(F.contains("text", F.lit(CRS))), F.lit(False)).alias("_crs"), F.coalesce(F.bool_or(near), F.lit(False)).alias("_dt"))
    asked = images.select("path").where("path is not null").distinct().select("path", F.posexplode(_candidates(F.col("path"))).alias("_nth", "_at"))
    met = asked.join(flags, "_at", "left")
    there = F.col("_crs").isNotNull()
    yes = lambda nth, flag: F.coalesce(F.bool_or((F.col("_nth") == nth) & F.col(flag)), F.lit(False))
    found = met.groupBy("path").agg(F.min(F.when(there, F.struct("_nth", "_at")))["_at"].alias("sidecar"), yes(1, "_crs").alias("has_adobe"), yes(0, "_dt").alias("has_darktable"))
    return images.join(found, "path", "left").na.fill(False, ["has_adobe", "has_darktable"])


def protocol_line(kind: Column, numbers: Column, text: Column) -> Column:
    """A line of the run protocol: step k of n, total, done (green, yellow, red), warn or info with a text, whose line
    breaks become spaces; null for other kinds and where a number is missing. rolls.progress reads them back."""
    at = lambda i: F.get(numbers, F.lit(i)).cast("string")
    flat = F.regexp_replace(text, r"[\r\n]+", " ")
    lines = {
        "step": F.concat(F.lit("PROGRESS "), at(0), F.lit("/"), at(1)), "total": F.concat(F.lit("BATCHINFO total="), at(0)),
        "done": F.concat(F.lit("BATCHDONE green="), at(0), F.lit(" yellow="), at(1), F.lit(" red="), at(2)),
        "warn": F.concat(F.lit("WARN "), flat), "info": F.concat(F.lit("BATCHINFO "), flat),
    }
    out = F.lit(None).cast("string")
    for name, line in lines.items():
        out = F.when(kind == name, line).otherwise(out)
    return out
