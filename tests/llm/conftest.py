import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood near town"
ROWS = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "one", "en", None, 3), (5, LONG, "en", "b", len(LONG)),
    (6, PROSE, "en", "b", 9), (6, PROSE, "en", "b", 9), (7, PROSE, "en", "", 9), (None, PROSE, "en", "b", 9), (None, "nobody's text", None, None, None),
    (8, "\U0001f600 café 你好​ x\x1cy", "zz", "c", 12), (9, PROSE.replace("fox", "cat"), "en", "c", 9),
]
#: Names that operators use for their own columns.
CLASH = ["size", "n_words", "kept", "fail_bits", "row", "_row", "was", "new", "pii_found", "score", "set_id", "n", "i", "s", "z", "epochs", "_id", "label", "hash", "shard", "end", "start", "length", "piece", "bucket", "target"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may be wrong with them, and columns named like the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"mine {c}").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.where("false")
