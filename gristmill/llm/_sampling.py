"""Bounded, deterministic samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_labelled(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` labelled documents, those first by a hash of the id; of a document labelled more
    than once, the largest label that is not null."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(most)


def sampled(docs: DataFrame, labels: DataFrame, label: str, most: int, most_chars: int = 200_000) -> DataFrame:
    """(doc_id, text, label) of those documents; of several texts under one id, that with the smallest hash. Texts of more
    than most_chars are not learned from, so a sample has a bound in characters too. The sample's ids, whose number `most`
    bounds, are broadcast; texts stay where they are read."""
    chosen = first_labelled(labels, label, most).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    met = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return met.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
