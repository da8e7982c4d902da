"""Models fitted per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import models
from gristmill.plans.evaluation import scored
from gristmill.session import table


def logistic_by_group(spark: SparkSession, d: str) -> DataFrame:
    """A logistic model of the hit per language, on two signals of the labelled documents."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.log1p("n_chars").alias("a"), (F.size(F.split("text", "\n")) / F.greatest(F.lit(1), F.col("n_chars"))).alias("b"))
    rows = docs.join(scored(spark, d).select("doc_id", "hit"), "doc_id")
    return models.logistic_by_group(rows, "lang", ["a", "b"])


QUERIES = {f.__name__: f for f in (logistic_by_group,)}
ORACLE: dict[str, str] = {}
