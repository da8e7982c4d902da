"""Rolls as wholes: their sizes and aspects, what a session shows and undoes of them, and the references learned from
them. Keyed joins and aggregates; what needs order sorts one roll's rows in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import geometry as ge
from gristmill.functions import text as tx
from gristmill.operators import consensus as co
from gristmill.operators import evaluate as ev
from gristmill.operators import review as rv
from gristmill.operators import robust as ro

# Gaps tried for clusters of aspects, how near a frame's aspect must be, and what a convention may hold.
WIDTHS, NEAR = (0.03, 0.05, 0.10, 0.15), 0.15
LONG_MM, SHORT_MM = (33.0, 40.0), (22.0, 27.0)
# The mode of each target that is not standalone, and the text of a skipped entry.
MODES = {"darktable": "darktable", "reviews": "folder"}
CHANGED = "Datei seit der Analyse geaendert"


def roll_sizes(rows: DataFrame, film: str, known: DataFrame) -> DataFrame:
    """rows (film, w, h) -> the dense centres of the long and the short sides of rolls of three frames or more, or whose
    scale in known (film, pitch, agree, score, aspect) is accepted; bucket_aspect is the known aspect or theirs, 1 or more."""
    sized = rows.where((F.col("w") > 0) & (F.col("h") > 0))
    long = ro.dense_center(sized.select(film, F.greatest("w", "h").alias("_x")), [film], "_x").select(film, F.col("center").alias("long"), "n")
    short = ro.dense_center(sized.select(film, F.least("w", "h").alias("_x")), [film], "_x").select(film, F.col("center").alias("short"))
    both = long.join(short, film).join(known, film, "left")
    aspect = F.coalesce(F.nullif("aspect", F.lit(0.0)), F.col("long") / F.greatest("short", F.lit(1.0)))
    kept = both.where((F.col("n") >= 3) | co.scale_accepted(F.col("pitch"), F.col("agree"), F.col("score"), F.col("n")))
    return kept.select(film, "n", "long", "short", F.greatest(aspect, 1 / aspect).alias("bucket_aspect"))


def film_analysis(rows: DataFrame, film: str, image: str) -> DataFrame:
    """rows (film, image, refined, w, h) -> the film's aspect, the median of the largest chain of aspects over WIDTHS
    (the smaller width, then the lower chain, on ties), and the median size of refined frames near it, of all refined
    ones (long side as width) where none is near. One sort serves all widths; chains are counted before one is chosen."""
    ratio = F.col("w") / F.col("h")
    seen = rows.where((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_a", F.greatest(ratio, 1 / ratio))
    order = Window.partitionBy(film).orderBy("_a")
    gap = F.col("_a") - F.lag("_a").over(order)
    apart = seen.select(film, "_a", *(F.when(gap <= w, 0).otherwise(1).alias(f"_n{i}") for i, w in enumerate(WIDTHS)))
    summed = apart.select(film, "_a", *(F.sum(f"_n{i}").over(order).alias(f"_c{i}") for i in range(len(WIDTHS))))
    chained = summed.select(film, "_a", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"_c{i}").alias("c")) for i in range(len(WIDTHS))))).alias("x"))
    chains = chained.groupBy(film, "x.i", "x.c").agg(F.count("*").alias("k"), F.min("_a").alias("low"), F.max("_a").alias("high"))
    best = chains.groupBy(film).agg(F.min(F.struct((-F.col("k")).alias("m"), "i", "c", "low", "high")).alias("b")).select(film, (-F.col("b.m")).alias("cluster_size"), "b.low", "b.high")
    near = seen.join(best, film)
    mode = near.where(F.col("_a").between(F.col("low"), F.col("high"))).groupBy(film, "cluster_size").agg(F.median("_a").alias("_m"))
    frames = seen.where("refined").join(mode, film)
    fits = F.abs(F.col("_a") - F.col("_m")) / F.greatest("_m", F.lit(0.1)) < NEAR
    sizes = frames.groupBy(film).agg(
        *(F.floor(F.coalesce(F.median(F.when(fits, F.col(c))), F.median(whole))).alias(n) for n, c, whole in (("width", "w", F.greatest("w", "h")), ("height", "h", F.least("w", "h"))))
    )
    images = rows.groupBy(film).agg(F.countDistinct(image).alias("n_images"), F.count_if((F.col("w") > 0) & (F.col("h") > 0)).alias("n_candidates"))
    out = images.join(mode, film, "left").join(sizes, film, "left")
    size = F.coalesce("cluster_size", F.lit(0))
    return out.select(film, F.bround("_m", 4).alias("aspect_ratio"), "width", "height", "n_images", "n_candidates", size.alias("cluster_size"), F.bround(size / F.greatest("n_candidates", F.lit(1)), 2).alias("cluster_coverage"))


def undone(history: DataFrame, by: list[str], op: str, key: str, chosen: DataFrame | None = None) -> DataFrame:
    """history (by, op, key, ...), a row per item that an operation changed, with `reverted`: of each `by` the whole last
    operation, or, with chosen (by, key), the chosen items of the last operation that touched one of them."""
    if chosen is None:
        marked = history.withColumn("_c", F.lit(True))
    else:
        marked = history.join(chosen.select(*by, key).distinct().withColumn("_c", F.lit(True)), [*by, key], "left")
    last = marked.where("_c").groupBy(*by).agg(F.max(op).alias("_last"))
    both = marked.join(last, by, "left")
    return both.withColumn("reverted", F.coalesce(F.col("_c") & (F.col(op) == F.col("_last")), F.lit(False))).drop("_c", "_last")


def gallery_counts(images: DataFrame, by: list[str]) -> DataFrame:
    """images (proposal, group, manual, decision, status, film): what a gallery's bar and a run's report count."""
    hand = F.col("manual").isNotNull()
    return images.groupBy(*by).agg(
        F.count("proposal").alias("proposals"), F.count_if(F.col("group") == "yellow").alias("yellow"), F.count_if(F.col("group") == "red").alias("red"), F.count_if(hand).alias("corrected"),
        F.count_if(~hand & (F.col("decision") == "accept")).alias("accepted"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "error")), F.countDistinct("film").alias("films"),
    )


def manual_differences(results: DataFrame, reviews: DataFrame, key: str, order: str) -> DataFrame:
    """Manual crops (mx, my, mw, mh) less detected ones (x, y, width, height) of equal key, of several results the last."""
    fields = ("x", "y", "width", "height", "method", "confidence")
    last = results.groupBy(key).agg(F.max(F.struct(order, *fields)).alias("r"))
    both = reviews.where(F.col("mw").isNotNull()).join(last, key)
    sides = {"dx": ("mx", "x"), "dy": ("my", "y"), "dw": ("mw", "width"), "dh": ("mh", "height")}
    return both.select(key, *((F.col(m) - F.col(f"r.{a}")).alias(n) for n, (m, a) in sides.items()), F.coalesce("r.method", F.lit("?")).alias("method"), F.coalesce("r.confidence", F.lit(0)).alias("confidence"))


def labelled(results: DataFrame, images: DataFrame, order: str, green: float = 0.5, yellow: float = 0.3) -> DataFrame:
    """results (filename, x, width, confidence) that have a crop give the first image of their name a band."""
    first = images.groupBy("filename").agg(F.min(order).alias(order))
    found = results.where("x is not null and width is not null").join(first, "filename")
    return found.select("filename", order, ev.band(F.coalesce("confidence", F.lit(0.0)), green, yellow).alias("label"))


def ground_truth(rows: DataFrame, states: DataFrame, order: str, edge: int = 2000) -> DataFrame:
    """rows (path, film, file, session, w, h, corrected, manual, will_apply, phase, final, moved) and states (path, nth,
    detected): references at a long edge of `edge`, strong from corrections, weak from detections that were applied or
    locked. Of equal keys the last row counts, of equal paths the first state."""
    first = states.groupBy("path").agg(F.min_by("detected", "nth").alias("detected"))
    both = rows.join(first, "path", "left")
    strong = F.col("corrected") & F.col("manual").isNotNull()
    weak = F.col("will_apply") & F.col("detected").isNotNull() & F.col("phase").isin("applied", "locked")
    box = F.when(strong, F.col("manual")).otherwise(ge.to_pixels(F.col("detected"), F.col("w"), F.col("h")))
    side = lambda c: F.bround(F.col(c) * (edge / F.greatest("w", "h").cast("double"))).cast("int")
    new = both.where(strong | weak).select(
        F.concat("film", F.lit("/"), tx.stem(F.col("file")), F.lit(".jpg")).alias("key"), F.col(order).alias("_o"), F.when(strong, "manual_crop").otherwise("accepted_crop").alias("kind"),
        ev.scaled_reference(box, F.col("w"), F.col("h"), edge).alias("crop"), side("w").alias("w"), side("h").alias("h"),
        F.when(strong, (F.col("final") == "red") & F.col("moved")).alias("is_problem"), F.concat(F.lit("companion:"), "session").alias("source"),
    )
    fields = ("kind", "crop", "w", "h", "is_problem", "source")
    return new.groupBy("key").agg(F.max(F.struct("_o", *fields)).alias("v")).select("key", *(F.col(f"v.{c}").alias(c) for c in fields))


def exported(rows: DataFrame) -> DataFrame:
    """Corrections alone, in pixels of their export."""
    source = F.concat(F.lit("companion:"), "session").alias("source")
    return rows.where(F.col("corrected") & F.col("manual").isNotNull()).select(F.concat_ws("/", "film", "file").alias("key"), F.col("manual").alias("manual_crop"), "w", "h", "path", source)


def all_results(kept: DataFrame, fresh: DataFrame, errors: DataFrame) -> DataFrame:
    """Reused and new results and failures as one table; what a part lacks is null. Writers order it by film and name."""
    return kept.unionByName(fresh, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)


def review_list(results: DataFrame, threshold: float) -> DataFrame:
    """Results below the threshold, the least certain first."""
    return results.where(F.col("confidence") < threshold).orderBy("confidence")


def head_of(rows: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """The first rows of a report, each with how many follow the last of them."""
    more = F.greatest(F.lit(0), rows.agg(F.count("*").alias("n")).scalar() - most)
    return rows.orderBy(*order).limit(most).withColumn("more", more)


def newest_session(sessions: DataFrame, items: DataFrame, have: DataFrame, target: str, folder: str) -> DataFrame:
    """The last of the standalone sessions (session, mode, target, folder) for this target and folder all of whose items
    (session, path), one at least, are at hand."""
    fits = sessions.where((F.col("mode") == "standalone") & (F.col("target") == target) & (F.col("folder") == folder))
    whole = rv.contained(items.join(fits.select("session"), "session", "left_semi"), "session", "path", have)
    return whole.agg(F.max("session").alias("session"))


def plan_checks(plan: DataFrame, library: DataFrame) -> DataFrame:
    """plan (id, path, size, changed) against library (id, folder, filename, file_size, null where the file is gone): what
    bars an entry, status and message; both null where nothing does. One join stands for a search of the folders
    concerned and then of all."""
    both = plan.join(library.withColumn("_met", F.lit(True)), "id", "left")
    other = F.concat_ws("/", "folder", "filename") != F.col("path")
    bars = ((~F.col("changed"), "skipped", "unchanged"), (F.col("_met").isNull(), "error", "image not found in library"), (other, "error", "file moved or renamed"), (F.col("size").isNotNull() & ~F.col("file_size").eqNullSafe(F.col("size")), "skipped", "file changed since export"))
    status = message = F.lit(None).cast("string")
    for bar, what, why in reversed(bars):
        status, message = F.when(bar, what).otherwise(status), F.when(bar, why).otherwise(message)
    return both.select("id", status.alias("status"), message.alias("message"))


def imported(images: DataFrame, rolls: DataFrame, folders: DataFrame) -> DataFrame:
    """Paths of images (film_id, filename) in rolls (film_id, folder) whose folder is among folders (folder)."""
    return images.join(rolls.join(folders.select("folder"), "folder", "left_semi"), "film_id").select(F.concat_ws("/", "folder", "filename").alias("path"))


def progress(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """lines (by, order, line) of a run's protocol -> the last step of how many, images, warnings, and the final bands."""
    kinds = {"step": (r"^PROGRESS (\d+)/(\d+)", ("step", "of")), "total": (r"BATCHINFO total=(\d+)", ("images",)), "done": (r"BATCHDONE green=(\d+) yellow=(\d+) red=(\d+)", ("green", "yellow", "red"))}
    last = (F.max(F.when(F.col("line").rlike(pattern), F.struct(order, "line"))).alias(f"_{kind}") for kind, (pattern, _) in kinds.items())
    told = lines.groupBy(*by).agg(*last, F.count_if(F.col("line").startswith("WARN")).alias("warnings"))
    numbers = (F.regexp_extract(F.col(f"_{kind}.line"), pattern, i + 1).cast("long").alias(name) for kind, (pattern, names) in kinds.items() for i, name in enumerate(names))
    return told.select(*by, *numbers, "warnings")


def public_state(sessions: DataFrame, images: DataFrame, history: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """sessions (key, target) with their images' bands, whether there is something to undo, and what was applied: its
    revision, and its target where that is another than now."""
    bands = images.groupBy(key).agg(F.count("*").alias("images"), *(F.count_if(F.col("group") == g).alias(g) for g in ("green", "yellow", "red")))
    undo = history.select(key).distinct().withColumn("can_undo", F.lit(True))
    was = applied.select(key, F.col("target").alias("_was"), F.col("revision").alias("applied_revision"))
    both = sessions.join(bands, key, "left").join(undo, key, "left").join(was, key, "left").na.fill(0, ["images", "green", "yellow", "red"]).na.fill(False, ["can_undo"])
    return both.withColumn("applied_target", F.when(F.col("_was") != F.col("target"), F.col("_was"))).drop("_was")


def conventions(rows: DataFrame) -> DataFrame:
    """rows (long_mm, short_mm, n) that a 35 mm frame can have; n is 1 where it is not given."""
    fits = F.col("long_mm").between(*LONG_MM) & F.col("short_mm").between(*SHORT_MM)
    return rows.where(fits).withColumn("n", F.coalesce(F.col("n"), F.lit(1)).cast("long"))


def factor_rows(results: DataFrame, deltas: DataFrame, order: str, factors: list[str]) -> DataFrame:
    """deltas (key "film/file", film, hit, missing) met by the last result of the file's name that has its factors."""
    last = results.groupBy("filename").agg(F.max(F.struct(order, "confidence", *factors)).alias("r"))
    named = deltas.where(~F.col("missing")).withColumn("filename", F.regexp_extract("key", "(?s)^[^/]*/(.*)$", 1))
    whole = named.join(last, "filename").select("key", "film", "hit", F.col("r.confidence").alias("conf"), F.array(*(F.col(f"r.{c}") for c in factors)).alias("x"))
    return whole.where(~F.exists("x", lambda v: v.isNull()))


def films_with_references(strong: DataFrame, weak: DataFrame) -> DataFrame:
    return strong.select("key").unionByName(weak.select("key")).select(F.split_part("key", F.lit("/"), F.lit(1)).alias("film")).distinct()


def needs_neutralizing(entries: Column, operations: list[str]) -> Column:
    """Some entry (operation, enabled) of these operations is on."""
    return F.coalesce(F.exists(entries, lambda e: e["enabled"] & e["operation"].isin(*operations)), F.lit(False))


def skip_message(reason: Column) -> Column:
    return F.when(reason == "changed", CHANGED)


def mode_for(target: Column) -> Column:
    out = F.lit("standalone")
    for name, mode in MODES.items():
        out = F.when(target == name, mode).otherwise(out)
    return out


def target_for(mode: Column) -> Column:
    out = F.lit("json")
    for name, of in MODES.items():
        out = F.when(mode == of, name).otherwise(out)
    return out


def export_name(stem: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(stem, r"[^\p{L}\p{N}_.\-]+", "_"), F.lit("__"), key.cast("string"), F.lit(".jpg"))


def reference_box(crop: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A crop in pixels of the image as it is, turned back first if it was drawn on a straightened one. Edges and extents
    are rounded apart."""
    side = lambda v: F.bround(v).cast("int")
    at = lambda c, i: F.element_at(c, i)
    pixels = lambda c: F.struct(
        side(at(c, 1) * width).alias("x"), side(at(c, 2) * height).alias("y"), side((at(c, 3) - at(c, 1)) * width).alias("width"), side((at(c, 4) - at(c, 2)) * height).alias("height")
    )
    turned = F.when(F.abs(rotation) > 1e-3, ge.from_straight(crop, width, height, rotation)).otherwise(crop)
    return F.transform(F.array(turned), pixels)[0]  # bound once: its expression is large
