"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: all words are shared among the sources by weight; a source's target stops at `max_epochs` times its own size
and the excess is shared again among the rest by weight. Seats are blocks of `block_words` words. They go to sources by
highest quotients target / (2 * seats + 1), then, within a source, to its shards by their sizes in the same way, giving
an integer quota per shard. A shard is a ring of its documents in seeded order; the quota takes whole turns of the ring
and then the blocks that follow a seeded starting block, so at most two documents of a shard are taken in part.

A source whose target is `max_epochs` times its size is taken that often as a whole.

Scale: documents are shuffled as (source, shard, id, size, hash) only. A source has as many shards as the square root of
its documents, dealt by a hash of id and text, so a source with most of all rows is spread over more tasks the larger it
is, and neither a shard nor the list of a source's shards, apportioned in one task, grows as fast as the source. The
driver sees one row per source (the dimension for which weights are given) and refuses more than `max_sources`; the plan
of that many rows is broadcast only where Spark finds it small.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in order; rows
that repeat an id are told apart by their texts, and rows that repeat both are documents of their own that are taken
alike but for the order of their other columns, so reruns agree; a table without words takes nothing; extra columns,
whatever their names, are passed through by `select_texts` and ignored by `mix`.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gristmill.llm._common import SPACE, words

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: list[int], weights: list[float], max_epochs: int = 3) -> list[float]:
    """Each source's share of sum(sizes) by weight, none above max_epochs times its size."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), [i for i, n in enumerate(sizes) if n > 0]
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * per > max_epochs * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * per
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2 * have + 1), ties to the earlier party. Starts from the quotas of one
    common divisor and then gives or takes back single seats, which leads to the same seats as dealing one by one."""
    votes = np.asarray(votes, float)
    if seats <= 0 or not votes.sum():
        return np.zeros(len(votes), np.int64)
    have = np.floor(votes / (votes.sum() / seats) + 0.5).astype(np.int64)
    short = seats - int(have.sum())
    if short > 0:
        heap = [(-v / (2 * int(h) + 1), i) for i, (v, h) in enumerate(zip(votes, have, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(short):
            i = heap[0][1]
            have[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * int(have[i]) + 1), i))
    elif short < 0:
        heap = [(v / (2 * int(h) - 1), -i) for i, (v, h) in enumerate(zip(votes, have, strict=True)) if h > 0]
        heapq.heapify(heap)
        for _ in range(-short):
            i = -heap[0][1]
            have[i] -= 1
            heapq.heapreplace(heap, (votes[i] / (2 * int(have[i]) - 1), -i)) if have[i] else heapq.heappop(heap)
    return have


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3, block_words: int = 8, seed: int = 17, max_sources: int = 1_000_000) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, text_hash, source_size, target, taken, and how: epochs (whole copies),
    part_start and part_words (a run of words that follows, from its first word) and wrap_words (words of a second run,
    from the text's start, where the ring's run ends in the document in which it began)."""
    named = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    named = named.withColumn("hash", F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1).cast("long")), "text_hash"))
    per_source = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = sorted(((r["source"], r["source_size"], r["n"]) for r in per_source.limit(max_sources + 1).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; weights are given for coarser ones")
    goal = targets([r[1] for r in found], [weights[i % len(weights)] for i in range(len(found))], max_epochs)
    seats = sainte_lague(np.array(goal), round(sum(goal) / block_words))
    plan = docs.sparkSession.createDataFrame(
        [(s, n, g, int(q), math.isqrt(c - 1) + 1, g >= max_epochs * n) for (s, n, c), g, q in zip(found, goal, seats, strict=True)],
        "p_source string, source_size long, target double, seats long, n_shards long, whole boolean",
    )
    dealt = named.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    dealt = dealt.withColumn("shard", F.pmod(F.shiftright("hash", 20), F.col("n_shards")))

    def quota(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("shard", kind="stable")
        return pd.DataFrame({"q_source": g["source"], "q_shard": g["shard"], "shard_words": g["shard_words"], "quota": sainte_lague(g["shard_words"].to_numpy(), int(g["seats"].iloc[0]))})

    schema = T.StructType([T.StructField("q_source", T.StringType()), T.StructField("q_shard", T.LongType()), T.StructField("shard_words", T.LongType()), T.StructField("quota", T.LongType())])
    shards = dealt.groupBy("source", "shard", "seats").agg(F.sum("size").alias("shard_words")).groupBy("source").applyInPandas(quota, schema)
    ring = Window.partitionBy("source", "shard").orderBy("hash", "doc_id", "text_hash")
    placed = dealt.withColumn("end", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(shards, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")))
    lng = lambda text: F.expr(f"cast({text} as bigint)")
    out = (
        placed.withColumn("start", F.col("end") - F.col("size"))
        .withColumn("epochs", lng(f"if(whole, {max_epochs}, least({max_epochs}, (quota * {block_words}) div greatest(shard_words, 1)))"))
        .withColumn("run", lng(f"case when epochs >= {max_epochs} then 0 else least(shard_words, quota * {block_words} - epochs * shard_words) end"))
        .withColumn("n_blocks", lng(f"greatest(1, (shard_words + {block_words - 1}) div {block_words})"))
        .withColumn("first", F.pmod(F.xxhash64(F.lit(seed), F.lit("start"), "source", "shard"), F.col("n_blocks")) * block_words)
        .withColumn("part_at", F.greatest("start", "first"))
        .withColumn("part_words", F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), F.col("first") + F.col("run")) - F.col("part_at")))
        .withColumn("wrap_words", F.greatest(F.lit(0).cast("long"), F.least(F.col("end"), F.col("first") + F.col("run") - F.col("shard_words")) - F.col("start")))
    )
    return out.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.col("part_words") + F.col("wrap_words")).alias("taken"),
        "epochs", (F.col("part_at") - F.col("start")).alias("part_start"), "part_words", "wrap_words",
    )


def select_texts(docs: DataFrame, **params) -> DataFrame:
    """The mix as rows with the columns of docs: a row per whole copy, and one for each part. A part that is a whole
    text is the text itself; others are their words, one space between. Rows are joined to their decisions by id, source,
    size and text; n_chars, where docs has it, follows the text."""
    mixed = mix(docs, **params).where("taken > 0")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # nulls as values of their own, so that both sides meet in the partitions by which they are numbered
    keys = lambda size, told: (F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("doc_id").isNull().alias("no_i"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"), size.alias("z"), told.alias("t"))
    names = ["i", "no_i", "s", "no_s", "z", "t"]
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    rows = docs.select(*keys(word_count(F.col("text")), F.xxhash64("text")), row.alias("row"), others.alias("others"))
    # rows that agree in id, source and text are paired by number, in the order of their other columns
    number = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy(*names).orderBy(*by)))
    how = ("epochs", "part_start", "part_words", "wrap_words")
    a, b = number(rows, "others").alias("a"), number(mixed.select(*keys(F.col("size"), F.col("text_hash")), *how), *how).alias("b")
    on = F.col("a.nth") - F.col("b.nth") == 0  # no key of the join, which would deal both sides out again
    for c in names:
        on &= F.col(f"a.{c}") == F.col(f"b.{c}")
    both = a.join(b, on).select("a.row", "a.z", "b.epochs", "b.part_start", "b.part_words", "b.wrap_words")
    none = F.expr("cast(array() as array<string>)")
    cut = lambda start, n: F.when(F.col(n) == F.col("z"), F.col("row.text")).otherwise(F.array_join(F.slice(words(F.col("row.text")), (start + 1).cast("int"), F.col(n).cast("int")), " "))
    part = lambda start, n: F.when(F.col(n) > 0, F.array(cut(start, n))).otherwise(none)
    copies = F.concat(F.array_repeat(F.col("row.text"), F.col("epochs").cast("int")), part(F.col("part_start"), "part_words"), part(F.lit(0), "wrap_words"))
    out = both.select("row", F.explode(copies).alias("text"))
    now = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*(now[c].alias(c) if c in now else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
