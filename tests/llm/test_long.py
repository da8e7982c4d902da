"""Very long texts and conversations, each within seconds."""

import time

import pytest
from pyspark.sql import functions as F
from test_brute_force import shifted

from gristmill.llm import chat, pii, quality_rules

MB = 1_000_000


def within(seconds, run):
    began = time.time()
    out = run()
    assert time.time() - began < seconds
    return out


@pytest.mark.parametrize("text", ["x a@b" + ".c" * (MB // 2) + ".com 7", "x " + "a" * MB + "@b.com 7", "a." * (MB // 2), "9" * MB, "1.2." * (MB // 4) + "@", "sk-" * (MB // 3)])
def test_long_runs_hold_no_personal_data(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert within(30, lambda: pii.pseudonymise(df, "k").first()).pii_found in (0, 1)


def test_long_secret(spark):
    value = "aB3" * 70
    rows = [(1, f"token={value}"), (2, "token=" + "a1" * (MB // 8)), (3, "me@mail.example.com...and 1.2.3.4")]
    got = within(30, lambda: {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()})
    assert got[1] == "token=" + shifted(value, "k", "secret") and len(got[2]) == len(rows[1][1])
    assert got[3].endswith(tuple("0123456789")) and "...and " in got[3] and "mail.example" not in got[3] and "1.2.3.4" not in got[3]


@pytest.mark.parametrize("word", ["A" * MB + "b", "a" * MB, "!" * MB, "A" * MB])
def test_long_words(spark, word):
    book = quality_rules.ledger(spark.createDataFrame([(1, word)], "doc_id long, text string"))
    assert within(20, lambda: book.first()).n_upper_words == (word == "A" * MB)


def test_long_conversation(spark):
    n = 10_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    df = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("text </s> "), F.col("id"), F.lit(" " * 80)).alias("text"))
    r = within(40, lambda: chat.read_back(chat.format_conversations(df)).first())
    assert len(r.turns) == n and len(r.loss_spans) == n // 2
    assert r.loss_text == "".join(f"text </s> {k}" + " " * 80 for k in range(1, n, 2))
