r"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted; runs of one role become a block:

    <s>[ROLE]role[/ROLE]text[TURN]text</s>

Inside roles and texts, every control string gets one backslash more after its first character ("</s>" becomes
"<\/s>", "<\/s>" becomes "<\\/s>"), so no text can end a block and reading back is exact.

Defined cases: a null text is the empty text; a null role is written as the control string [NULL] and read back as
null; turns that tie on the turn number are ordered by role and text; repeated rows are turns of their own; rows with
a null conv_id form one conversation; other columns are ignored; an empty table gives no rows. One row per
conversation is the result, so a conversation must fit a row; no other key gathers rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import let

#: Spans that are folded, or cut from one piece of the text, together.
CHUNK = 128

#: Strings that mark structure, here or in common chat templates.
CONTROL_TAILS = ("s>", "INST]", "ROLE]", "TURN]", "NULL]")
_TAIL = "(/?(?:" + "|".join(t.replace("]", r"\]") for t in CONTROL_TAILS) + "))"
ESCAPE = (r"([<\[])(\\*)" + _TAIL, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + _TAIL, "$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def chunks(xs: Column) -> Column:
    """xs, CHUNK by CHUNK."""
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(CHUNK))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda k: F.slice(xs, k, CHUNK))


def sums_before(xs: Column) -> Column:
    """For each of an array of longs, the sum of those before it. A fold copies what it has made so far, so it is done in
    chunks and over the chunks' totals."""

    def running(ys: Column, start: Column) -> Column:
        return F.slice(F.aggregate(ys, F.array(start), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y))), F.lit(1), F.size(ys))

    zero = F.lit(0).cast("long")
    totals = lambda cs: F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, y: a + y))
    inner = lambda cs, offsets: F.flatten(F.transform(cs, lambda c, k: running(c, F.get(offsets, k))))
    return let(chunks(xs), lambda cs: let(running(totals(cs), zero), lambda offsets: inner(cs, offsets)))


def _block(run: Column) -> Column:
    role = F.coalesce(escape(run[0]["role"]), F.lit("[NULL]"))
    return F.struct(
        F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]")).alias("head"),
        F.transform(run, lambda t: escape(t["text"])).alias("texts"),
        F.coalesce(run[0]["role"] == "assistant", F.lit(False)).alias("loss"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, formatted, loss_spans: 0-based code point start and length of each
    assistant text within formatted."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def blocks(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | ~F.get(ts, i)["role"].eqNullSafe(F.get(ts, i - 1)["role"]))
        return let(starts, lambda s: F.transform(s, lambda a, k: let(F.slice(ts, a + 1, F.coalesce(F.get(s, k + 1), F.size(ts)) - a), _block)))

    def spans(bs: Column) -> Column:
        """Starts are sums of the lengths before; a block is its head, its texts with [TURN] between, and </s>."""
        cut = F.flatten(F.transform(bs, lambda b: F.transform(b["texts"], lambda x, i: F.struct(
            F.when(i == 0, F.char_length(b["head"])).otherwise(len("[TURN]")).cast("long").alias("before"),
            F.char_length(x).cast("long").alias("length"),
            F.when(i == F.size(b["texts"]) - 1, len("</s>")).otherwise(0).cast("long").alias("after"),
            b["loss"].alias("loss"),
        ))))
        each = lambda cs: F.transform(cs, lambda c: c["before"] + c["length"] + c["after"])
        placed = lambda cs, starts: F.transform(cs, lambda c, i: F.struct((F.get(starts, i) + c["before"]).alias("start"), c["length"].alias("length"), c["loss"].alias("loss")))
        mine = lambda xs: F.transform(F.filter(xs, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
        return let(cut, lambda cs: let(sums_before(each(cs)), lambda starts: mine(placed(cs, starts))))

    text = lambda bs: F.array_join(F.transform(bs, lambda b: F.concat(b["head"], F.array_join(b["texts"], "[TURN]"), F.lit("</s>"))), "")
    out = sorted_turns.select("conv_id", let(blocks(F.col("turns")), lambda bs: F.struct(text(bs).alias("formatted"), spans(bs).alias("loss_spans"))).alias("o"))
    return out.select("conv_id", "o.formatted", "o.loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans -> also turns (role, text) and loss_text, both unescaped."""

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)
        body = F.regexp_replace(block, r"(?s)^<s>\[ROLE\].*?\[/ROLE\]", "")
        named = F.when(role != "[NULL]", unescape(role))
        return let(named, lambda r: F.transform(F.split(body, r"\[TURN\]", -1), lambda x: F.struct(r.alias("role"), unescape(x).alias("text"))))

    blocks = F.filter(F.split("formatted", "</s>"), lambda b: b != "")
    cut = lambda text, start, n: F.substring(text, (start + 1).cast("int"), n.cast("int"))

    def under_mask(spans: Column) -> Column:
        """The texts of a chunk of spans, cut from the piece of the text that holds them: a cut walks from the start."""
        first, last = spans[0]["start"], F.element_at(spans, -1)
        piece = cut(F.col("formatted"), first, last["start"] + last["length"] - first)
        return let(piece, lambda p: F.array_join(F.transform(spans, lambda s: unescape(cut(p, s["start"] - first, s["length"]))), ""))

    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, turns)), "loss_text": F.array_join(F.transform(chunks(F.col("loss_spans")), under_mask), "")})
