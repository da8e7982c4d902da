"""Discovery of image folders, read models of stored documents, and small sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions import text as tx

# Extensions, and the file that marks an output folder.
IMAGES = (".jpg", ".jpeg", ".tif", ".tiff", ".png")
RAWS = (".nef", ".cr2", ".cr3", ".arw", ".raf", ".orf", ".rw2", ".dng", ".pef", ".srw", ".erf", ".kdc", ".3fr", ".mos", ".iiq", ".x3f")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of all files below a folder; contents are not read. Spark's readers skip files
    whose names begin with a dot or an underscore, so the marker of an output folder must not."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")


def rolls(files: DataFrame, root: str, extensions: tuple[str, ...] = IMAGES + RAWS, marker: str = "gristmill-output") -> DataFrame:
    """Images directly in the root or one folder below it, with their roll; hidden files and output folders are left
    out; where a raw file has a twin, the twin goes; ids from 1 in order of path."""
    rel = F.substring_index(F.regexp_replace("path", "^file:/+", "/"), root.rstrip("/") + "/", -1)
    every = files.withColumn("rel", rel).withColumn("roll", F.when(F.instr("rel", "/") > 0, F.substring_index("rel", "/", 1)).otherwise(F.element_at(F.split(F.lit(root.rstrip("/")), "/"), -1)))
    marked = every.where(tx.basename(F.col("rel")) == marker).select("roll").distinct()
    shown = every.where((F.size(F.split("rel", "/")) <= 2) & ~tx.basename(F.col("rel")).startswith(".") & tx.extension(F.col("rel")).isin(*extensions)).join(marked, "roll", "left_anti")
    # numbered in one task: a folder's listing comes from the driver and is no larger than what it holds
    return without_twins(shown).withColumn("id", F.row_number().over(Window.orderBy("path")).cast("long"))


def without_twins(files: DataFrame) -> DataFrame:
    """files (path, ...): those that are raw, or have no raw file of their stem."""
    named = files.withColumn("_stem", F.lower(tx.stem(F.col("path")))).withColumn("_raw", tx.extension(F.col("path")).isin(*RAWS))
    raws = named.where("_raw").select("_stem").distinct()
    kept = named.where("_raw").unionByName(named.where(~F.col("_raw")).join(raws, "_stem", "left_anti"))
    return kept.drop("_stem", "_raw")


def roll_names(files: DataFrame) -> DataFrame:
    """files (collection, roll): a roll's name has its collection before it where another collection has such a roll."""
    many = files.select("collection", "roll").distinct().groupBy("roll").agg((F.count("*") > 1).alias("_many"))
    return files.join(many, "roll").withColumn("name", F.when("_many", F.concat_ws(" ", "collection", "roll")).otherwise(F.col("roll"))).drop("_many")


def target(files: DataFrame) -> DataFrame:
    """files (path, has_pp3, has_adobe, has_darktable): the output format that fits them, one row."""
    raw = tx.extension(F.col("path")).isin(*RAWS)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return files.agg(F.when(any_(F.col("has_pp3")), "rawtherapee").when(any_(raw & F.col("has_adobe")), "xmp").when(any_(F.col("has_darktable")), "darktable_xmp").when(any_(raw), "json").otherwise("copies").alias("target"))


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with `from` and `to` as JSON text; malformed lines are dropped."""
    schema = "t timestamp, rev int, id string, film string, file string, event string, `from` string, `to` string, confidence double, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null").drop("_corrupt_record")


def references(reviews: DataFrame, feedback: DataFrame, present: DataFrame) -> DataFrame:
    """Strong references by key (feedback over reviews), of files that exist."""
    both = reviews.withColumn("_p", F.lit(1)).unionByName(feedback.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    fields = [c for c in both.columns if c not in ("key", "_p")]
    best = both.groupBy("key").agg(F.min(F.struct("_p", *fields)).alias("x")).select("key", *(F.col(f"x.{c}").alias(c) for c in fields))
    return best.join(present.select("key"), "key", "left_semi")


def document(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A JSON document of an object or an array of them, directly in the folder; no rows if it is absent, and none for
    what cannot be read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", name).json(folder)


def last_results(results: DataFrame, order: str) -> DataFrame:
    """Of results (film, filename, ...) the last by order for each film and name."""
    rest = [c for c in results.columns if c not in ("film", "filename")]
    latest = results.groupBy("film", "filename").agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return latest.select("film", "filename", *(F.col(f"_r.{c}").alias(c) for c in rest))


def splits(documents: DataFrame) -> DataFrame:
    """documents (tuning, holdout: lists of films) -> film, split."""
    films = lambda c: documents.select(F.explode(c).alias("film"), F.lit(c).alias("split"))
    return films("tuning").unionByName(films("holdout"))


def sessions_below(files: DataFrame) -> DataFrame:
    """The folders that hold a state.json directly, in order of path."""
    return files.where(tx.basename(F.col("path")) == "state.json").select(F.regexp_replace("path", "/[^/]*$", "").alias("session")).distinct().orderBy("session")


MANIFEST = ("file", "film", "label", "apply", "confidence", "angle", "left", "top", "right", "bottom", "x", "y", "width", "height", "copy")


def write_manifest(plan: DataFrame, folder: str) -> None:
    """The plan as JSON lines and as CSV with fixed columns, null as the empty text and apply as 0 or 1."""
    rows = plan.select(*(F.col(c) if c in plan.columns else F.lit(None).cast("string").alias(c) for c in MANIFEST))
    rows.write.mode("overwrite").json(f"{folder}/crops.json")
    rows.withColumn("apply", F.col("apply").cast("int")).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(f"{folder}/crops.csv")
