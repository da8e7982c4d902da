"""String, path and JSON functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def roll_matches(name: Column, wanted: list[str]) -> Column:
    """The name is a wanted one, or ends with a space and a wanted one."""
    return F.exists(F.array(*map(F.lit, wanted)), lambda w: (name == w) | name.endswith(F.concat(F.lit(" "), w)))


def slug(name: Column) -> Column:
    """A folder's name: runs of other characters than letters, digits, _ . - and spaces become one _."""
    clean = F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}_.\- ]+", "_"))
    return F.when(clean == "", "film").otherwise(clean)


def slugs(names: DataFrame, name: str) -> DataFrame:
    """Each distinct name with a folder of its own: of names that share a slug, in order, the second gets _2, and so on."""
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(name))
    numbered = names.select(name).distinct().withColumn("_base", slug(F.col(name))).withColumn("_nth", nth)
    return numbered.select(name, F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("_", "_base", "_nth")).alias("slug"))


def natural_key(name: Column, width: int = 12) -> Column:
    """Lower-cased, every run of digits padded with zeros, so that text order is numeric order."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0+(\d{{{width}}})(?!\d)", "$1")


def canonical_sha256(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON object with sorted keys: numbers and booleans bare, texts escaped, nulls kept."""
    return F.sha2(F.to_json(F.struct(*(v.alias(k) for k, v in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def attribute(markup: Column, name: str) -> Column:
    """The first value of an attribute, the empty text if there is none."""
    return F.regexp_extract(markup, rf'\b{name}="([^"]*)"', 1)


def disabled(history: Column, operations: list[str]) -> Column:
    """enabled="1" becomes "0" in entries whose operation is listed."""
    names = "|".join(operations)
    return F.regexp_replace(history, rf'(operation="(?:{names})"[^>]*enabled=)"1"', '$1"0"')


def last_steps(history: Column) -> Column:
    """Of a history's entries (<rdf:li .../>), in order, the last one per operation and instance among those numbered
    below history_end; as a map from "operation/instance" to the entry."""
    end = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(history, r'history_end="(\d+)"', 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(10**9))
    entries = F.regexp_extract_all(history, F.lit(r"(<rdf:li\b[^>]*/>)"), F.lit(1))
    valid = F.filter(entries, lambda e: (attribute(e, "num") != "") & (F.coalesce(F.try_to_number(F.nullif(attribute(e, "num"), F.lit("")), F.lit("999999999")).cast("int"), F.lit(10**9)) < end))
    key = lambda e: F.concat_ws("/", attribute(e, "operation"), attribute(e, "multi_priority"))
    later = F.filter(valid, lambda e, i: ~F.exists(F.slice(valid, i + 2, F.size(valid)), lambda o: key(o) == key(e)))
    return F.map_from_arrays(F.transform(later, key), later)
