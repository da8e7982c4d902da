"""From raw documents to packed sequences. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import mixing, ngram_join, packing, pii, quality_rules
from gristmill.llm._common import IdSet, chosen, fresh_dir, saved
from gristmill.llm.queries import POLICY, pii_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text")
    return quality_rules.apply_policy(quality_rules.ledger(rows, keep=("_row",)), POLICY).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one with the smallest id stays (of several
    texts under that id, or of texts without one, that with the smallest hash). Documents without words stay. Rows are
    judged by id and text together and chosen where they are read, so texts are not shuffled, but for those that repeat
    the id and text of one that stays."""
    found = ngram_join.components(docs, n=5, percent=80).where("n_shingles > 0").groupBy("group", "doc_id", "row_key").agg(F.count("*").alias("rows"))
    found = saved(found)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))
    leaders = found.groupBy("group").agg(first.alias("leader")).select(F.col("group").alias("of"), F.col("leader.row_key").alias("stays"))
    judged = found.join(leaders, F.col("group") == F.col("of"))
    stay = chosen(docs, IdSet(judged.where("row_key <> stays").select("row_key")), False, ngram_join.row_key())
    repeated = judged.where("row_key = stays and rows > 1").select("row_key")
    if repeated.isEmpty():
        return stay
    twice = IdSet(repeated)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    copies = chosen(stay, twice, True, ngram_join.row_key()).select(row, ngram_join.row_key().alias("_key"), others.alias("_others"))
    one = copies.groupBy("_key").agg(F.min_by("_row", "_others").alias("_row"))
    return chosen(stay, twice, False, ngram_join.row_key()).unionByName(one.select("_row.*"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows."""
    out = pii.pseudonymise(docs, pii_key(spark)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a shard's run in part."""
    return mixing.select_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its ids and its place."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("private_data", private_data),
    ("mixing", mixture),
    ("packing", packed),
]

#: Near-duplicate groups and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
