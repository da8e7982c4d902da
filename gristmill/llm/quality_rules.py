r"""Quality rules as a bitmask ledger, with Spark expressions only.

`ledger` evaluates every rule once per document and stores the measurements and one failure bit per rule. Policies are
rows of data: a version and the mask of rules it enforces. `apply_policy` is a bitwise AND, `ablations` sums of bitwise
tests, so a new policy or an ablation never reads a text again.

Defined cases: a null text has no words and no lines; a text without words fails the base rules by its length;
measurements that divide by a word or line count are 0 where that count is 0; repeated rows are judged one by one;
other columns, whatever their names, are ignored by `ledger`; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import SPACE, let, words

SYMBOLS = "[#*$%&|<>]"


def _repeated(ws: Column) -> Column:
    """Words that stand in a 3-word window found twice or more. Windows that differ by hash differ; only texts with
    equal hashes sort their windows' words, neighbours in that order being compared in full."""
    last = F.size(ws) - 2
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)))

    def slow(hs: Column) -> Column:
        """Only windows whose hash is repeated are spelt out: equal windows have equal hashes."""
        order = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda o: F.filter(o, lambda x, k: (x["h"] == F.get(o, k - 1)["h"]) | (x["h"] == F.get(o, k + 1)["h"]))
        spelt = lambda o: F.array_sort(F.transform(near(o), lambda x: F.struct(F.array_join(F.slice(ws, x["i"] + 1, 3), " ").alias("g"), x["i"].alias("i"))))
        twice = lambda o: F.filter(o, lambda x, k: (x["g"] == F.get(o, k - 1)["g"]) | (x["g"] == F.get(o, k + 1)["g"]))
        at = lambda o: F.array_sort(F.transform(o, lambda x: x["i"]))
        covered = lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x)
        return let(order, lambda o: let(spelt(o), lambda s: let(at(twice(s)), covered)))

    fast = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(slow(hs)))
    return F.when(last < 1, F.lit(0)).otherwise(fast).cast("long")


@dataclass(frozen=True)
class Rule:
    """bit: place in the mask, never reused. fails: over the measurements' columns."""

    bit: int
    name: str
    fails: str


#: Rules refer to measurements only. A bit keeps its meaning in every version of a policy.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbol_heavy", "10 * n_symbols > n_words"),
    Rule(3, "shouting", "2 * n_upper_words > n_words and n_words >= 50"),
    Rule(4, "mean_word_length", "word_chars > 15 * n_words or (word_chars < 2 * n_words)"),
    Rule(5, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(6, "no_letters", "10 * n_alpha_words < 5 * n_words"),
    Rule(7, "exclaiming", "3 * n_exclaimed > n_words"),
    Rule(8, "separator_table", "10 * n_bar_words > 2 * n_words"),
)
BASE_MASK = 0b11
#: Version 2 judges length and repetition by the base rules and junk by its marks.
POLICIES = {1: BASE_MASK, 2: sum(1 << r.bit for r in RULES)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_alpha_words", "n_exclaimed", "n_bar_words")


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    count = lambda xs, test: F.size(F.filter(xs, test))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).alias("n_words"),
            F.char_length(F.array_join(ws, "")).alias("word_chars"),
            _repeated(ws).alias("n_repeat_words"),
            count(ws, lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}") & (F.char_length(w) > 1)).alias("n_upper_words"),
            count(ws, lambda w: w.rlike(r"\p{L}")).alias("n_alpha_words"),
            count(ws, lambda w: w.endswith("!!")).alias("n_exclaimed"),
            count(ws, lambda w: w == "|").alias("n_bar_words"),
        )

    out = docs.select(
        *keep,
        let(words(F.col("text")), of).alias("w"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS + "+", ""))).alias("n_symbols"),
        let(lines, lambda xs: F.struct(F.size(xs).alias("n"), (F.size(xs) - F.size(F.array_distinct(xs))).alias("dup"))).alias("l"),
    )
    source = {"n_symbols": "n_symbols", "n_lines": "l.n", "n_dup_lines": "l.dup"}
    return out.select(*keep, *(F.col(source.get(m, f"w.{m}")).cast("long").alias(m) for m in MEASURES))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs (doc_id, text) -> the kept columns, every measurement, fail_bits."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES))
    return measured(docs, keep).withColumn("fail_bits", bits.cast("long"))


def apply_policy(book: DataFrame, version: int) -> DataFrame:
    """Adds base_failed and kept under the given version, whose mask always includes the base rules."""
    hit = lambda mask: F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) != 0
    return book.withColumns({"base_failed": hit(BASE_MASK), "kept": ~hit(POLICIES[version] | BASE_MASK)})


def ablations(book: DataFrame) -> DataFrame:
    """Per policy version and rule: documents that fail the rule, and those the policy rejects for this rule alone.
    One pass over the ledger; each task sends one row."""
    aggs = []
    for v, mask in POLICIES.items():
        for r in (r for r in RULES if mask >> r.bit & 1):
            under = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
            aggs += [F.sum(F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) / (1 << r.bit)).cast("long").alias(f"f_{v}_{r.bit}"), F.sum((under == (1 << r.bit)).cast("long")).alias(f"a_{v}_{r.bit}")]
    rows = [F.struct(F.lit(v).alias("version"), F.lit(r.name).alias("rule"), F.coalesce(f"f_{v}_{r.bit}", F.lit(0).cast("long")).alias("n_failed"), F.coalesce(f"a_{v}_{r.bit}", F.lit(0).cast("long")).alias("n_failed_alone")) for v, mask in POLICIES.items() for r in RULES if mask >> r.bit & 1]
    return book.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
