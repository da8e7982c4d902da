r"""Interpolated modified Kneser-Ney model of any order from 2, counted by Spark, kept as sorted hash arrays that workers map.

A text is its words (runs of characters other than ASCII white space, A-Z lower-cased) and one end; a start stands
before the first. Words are 64-bit hashes. With c a bigram's count, c(h) its history's and D(c) the discounts,

    P(w|h) = (c - D(c)) / c(h) + back(h) * P1(w)        back(h) = (D1*N1(h) + D2*N2(h) + D3*N3+(h)) / c(h)
    P1(w)  = (t - d(t)) / T    + back1   / (V + 1)      t: histories that w follows, T: their sum

so a word never met has back1 / (V + 1), and a history never met gives P1. Discounts come from the counts of counts.
At a higher order c counts n-grams and P1 is the probability of the order below, whose c is the number of distinct
words before the n-gram, but its plain count where it begins with the start. A token too near the start for an order
has its probability from the order below. Each order has discounts of its own.

Building: each task counts the n-grams of its texts in sorted runs and cuts the runs by ranges of the history's hash;
runs of a range meet in one task, which merges them and writes the range's n-grams (hash and count) and history
figures as files. From them the next lower order is counted by an exchange of the same kind, down to bigrams. The words' numbers of histories are summed in a second exchange of the same kind, which writes the
range's vocabulary. Only sums (counts of counts) reach the driver. Range after range, the files are sorted arrays.
Scoring maps them into memory and looks up a chunk's sorted words and bigrams; texts are read where they lie.

There is a range for every RANGE_CHARS characters of text, and no fewer than spark.sql.shuffle.partitions, so what a task holds does not grow with the corpus. A history with a third of all tokens has at most one row per
distinct follower, task and run. Files carry their range in their name and are moved into place when complete, so a
task that runs again writes the same files. They are written below spark.checkpoint.dir; where that is no local or
mounted path, workers read each range into memory instead of mapping it.

Defined cases: a null or empty text is the end alone; repeated rows count each time; without any training text every
probability is 1 / (V + 1) = 1; words whose hashes agree are one word (for a billion words, one pair in 40 tables).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import fresh_dir, give_back, in_range, mixed, ranges_for, read_array, saved, token_chunks, worker_state, write_arrays

START, END = 0x9AE16A3B2F90404F, 0xC949D7C7509E6557  # hashes of no word but by chance
STEP = 0x9E3779B97F4A7C15
#: Counts of n-grams are kept in a byte; those of this and more in 64 bits beside it.
MANY = 255
#: Characters of training text to a range.
RANGE_CHARS = 20_000_000


# Runs: n-grams as one array per word, the last being the token, and their counts.


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def packed(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """columns are sorted; equal histories are written once."""
    first = _changes(columns[:-1])
    each = np.diff(np.r_[first, len(n)])
    small = n.max(initial=0) < 256
    head = np.array([len(first), len(n), small], np.int64)
    return b"".join(x.tobytes() for x in (head, *(c[first] for c in columns[:-1]), each.astype(np.uint32), columns[-1], n.astype(np.uint8 if small else np.uint64)))


def unpacked(blob: bytes, width: int = 2) -> tuple[np.ndarray, ...]:
    """The columns (width of them) and the counts."""
    a, b, small = map(int, np.frombuffer(blob, np.int64, 3))
    at = 24 + 8 * a * (width - 1)
    each = np.frombuffer(blob, np.uint32, a, at)
    cur = np.frombuffer(blob, np.uint64, b, at + 4 * a)
    n = np.frombuffer(blob, np.uint8 if small else np.uint64, b, at + 4 * a + 8 * b)
    return *(np.repeat(np.frombuffer(blob, np.uint64, a, 24 + 8 * a * i), each) for i in range(width - 1)), cur, n.astype(np.uint64)


def counted(*columns: np.ndarray, n: np.ndarray | None = None, by: int | None = None) -> tuple[np.ndarray, ...]:
    """Distinct n-grams, sorted by the range of their history, then by their words, with their summed counts."""
    where = [in_range(history(columns[:-1]), by)] if by and len(columns) > 2 else []  # one word's hashes are sorted by range
    order = np.lexsort((*columns[::-1], *where))
    columns = [c[order] for c in columns]
    first = _changes(columns)
    sums = np.diff(np.r_[first, len(order)]).astype(np.uint64) if n is None else np.add.reduceat(n[order], first) if len(first) else n
    return *(c[first] for c in columns), sums


def history(columns) -> np.ndarray:
    """One hash of the words before the token; that of one word is its own."""
    h = columns[-1]
    for c in reversed(columns[:-1]):
        h = pair_key(c, h)
    return h


def pair_key(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    return mixed(prev * np.uint64(STEP) + cur)


def with_ends(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts one after another -> histories, tokens (each text's words and its end), and the texts' offsets."""
    lengths = np.diff(ends) + 1
    at = np.r_[0, np.cumsum(lengths)]
    cur = np.empty(at[-1], np.uint64)
    last = at[1:] - 1
    inner = np.ones(len(cur), bool)
    inner[last] = False
    cur[inner], cur[last] = words, np.uint64(END)
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[at[:-1]] = np.uint64(START)
    return prev, cur, at


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of Chen and Goodman; where a count of counts is 0, the share of the count that plain absolute discounting takes."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def with_history(prev: np.ndarray, cur: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """The order - 1 words before each token, farthest first, with starts before the text, and the token."""
    columns = [cur, prev]
    while len(columns) < order:
        far = np.empty_like(cur)
        far[1:] = columns[-1][:-1]
        far[at[:-1]] = np.uint64(START)
        columns.append(far)
    return columns[::-1]


@dataclass(frozen=True)
class Model:
    path: str
    ranges: int
    tokens: int
    distinct: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    followed: int  # T: distinct bigrams
    spare: float  # back1
    high_discounts: tuple[tuple[float, float, float], ...] = ()  # of orders 3, 4, ...
    filled: dict[str, frozenset[int]] = field(default_factory=dict)  # by kind of file: the ranges that have one


BLOBS = "pid int, kind string, blob binary, n1 long, n2 long, n3 long, n4 long, n3up long, types long, tokens long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.binary(), *[pa.int64()] * 7]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in BLOBS.split(", ")])


def fit(texts: DataFrame, run_tokens: int = 2_000_000, order: int = 2) -> Model:
    """texts (text): the training rows. run_tokens: tokens that a task sorts at once. order: words of an n-gram."""
    if order < 2:
        raise ValueError(f"order {order}")
    spark = texts.sparkSession
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    path, ranges = fresh_dir(spark, "kneser-ney"), ranges_for(spark, chars, RANGE_CHARS)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, ends in token_chunks(batches, (), run_tokens):
            yield from dealt(counted(*with_history(*with_ends(words, ends), order), by=ranges), "run")

    def dealt(rows: tuple[np.ndarray, ...], kind: str) -> Iterator[pa.RecordBatch]:
        """Rows of counted(), a blob for each range of their history (or word)."""
        *columns, n = rows
        at = np.searchsorted(in_range(history(columns[:-1]), ranges), np.arange(ranges + 1))
        for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                yield _rows([(p, kind, packed([c[a:b] for c in columns], n[a:b]), *[0] * 7)])

    def merging(width: int):
        def joined(a, b):
            *columns, n = (np.concatenate(x) for x in zip(a, b, strict=True))
            return counted(*columns, n=n)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The runs of one range, pair after pair of runs of like size, so that little is held twice."""
            pid, stack = 0, []
            for batch in batches:
                pid = batch.column(0)[0].as_py()
                for blob in batch.column(batch.schema.get_field_index("blob")):
                    stack.append(unpacked(blob.as_py(), width))
                    while len(stack) > 1 and len(stack[-2][0]) < 2 * len(stack[-1][0]):
                        b, a = stack.pop(), stack.pop()
                        stack.append(joined(a, b))
            while len(stack) > 1:
                b, a = stack.pop(), stack.pop()
                stack.append(joined(a, b))
            *columns, n = stack.pop()
            cur = columns[-1]
            if width == order > 2:  # the words' own counts; at order 2 a word's count is that of its history
                yield from words_of(cur, n, "count")
            if width > 2:  # n-grams of two starts are of the order below, with their own counts
                real = columns[1] != np.uint64(START)
                yield from dealt(counted(*columns[1:], n=np.where(real, np.uint64(1), n), by=ranges), "run")
                columns, n = [c[real] for c in columns], n[real]
                cur = columns[-1]
            told = history(columns[:-1])
            key = pair_key(told, cur)
            sort = np.argsort(key)
            key, often = key[sort], n[sort]
            many = often >= MANY
            write_arrays(path, f"{_name('pairs', width)}-{pid}", {"key": key, "n": np.minimum(often, MANY).astype(np.uint8), "many": key[many], "times": often[many]})
            del key, sort, often, many
            first = _changes(columns[:-1])
            each = lambda x: np.add.reduceat(x.astype(np.uint64), first) if len(first) else np.empty(0, np.uint64)
            told = told[first]
            sort = np.argsort(told)
            figures = {"w": told, "c": each(n), "n1": each(n == 1), "n2": each(n == 2), "n3": each(n > 2)}
            write_arrays(path, f"{_name('history', width)}-{pid}", {k: x[sort] for k, x in figures.items()})
            ends_here = n[cur == np.uint64(END)].sum()
            yield _rows([(pid, "sum", int(ends_here).to_bytes(8, "little"), *_of_counts(n), int((n > 2).sum()), len(n), int(n.sum()))])
            if width == 2:
                yield from words_of(cur, None, "word")
            del columns, n, cur, told, sort, figures
            give_back()

        return merge

    def words_of(cur: np.ndarray, n: np.ndarray | None, kind: str) -> Iterator[pa.RecordBatch]:
        """How many n-grams end in each word, or the sums of n."""
        ws, t = counted(cur, n=n)
        zero = np.zeros(len(ws), np.uint64)
        at = np.searchsorted(in_range(ws, ranges), np.arange(ranges + 1))
        for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if a < b:
                yield _rows([(p, kind, packed([ws[a:b], zero[a:b]], t[a:b]), *[0] * 7)])

    def by_range(df: DataFrame, f) -> DataFrame:
        """f over each range's rows. repartition by id puts whole ranges into partitions of their own."""
        return df.repartitionById(ranges, F.col("pid")).mapInArrow(_skip_empty(f), BLOBS)

    names = ("n1", "n2", "n3", "n4", "n3up", "types", "tokens")
    top = level = saved(by_range(texts.select("text").mapInArrow(runs, BLOBS), merging(order)))
    totals, high_filled = [], {}
    for width in range(order, 1, -1):
        if width < order:
            level = saved(by_range(level.where("kind = 'run'"), merging(width)))
        if width > 2:
            high_filled[_name("pairs", width)] = {r["pid"] for r in level.where("kind = 'sum'").select("pid").collect()}
        totals.append(level.where("kind = 'sum'").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first())
    merged, total = level if order == 2 else level.unionByName(top.where("kind = 'count'")), totals[-1]
    high_d = tuple(discounts(x["n1"], x["n2"], x["n3"], x["n4"]) for x in reversed(totals[:-1]))
    pair_d = discounts(total["n1"], total["n2"], total["n3"], total["n4"])
    documents, filled = 0, {}
    for r in merged.where("kind = 'sum'").select("pid", "blob").collect():  # a row for each range
        documents += int.from_bytes(r["blob"], "little")
        filled.setdefault("pairs", set()).add(r["pid"])

    def vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, parts, counts, summed = 0, [], [], False
        for batch in batches:
            pid = batch.column(0)[0].as_py()
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(batch.schema.get_field_index("blob")), strict=True):
                if kind == "word":
                    parts.append(unpacked(blob.as_py()))
                elif kind == "count":
                    counts.append(unpacked(blob.as_py()))
                else:
                    summed = True
        summed_words = lambda xs: (lambda w, _, n: counted(w, n=n))(*(np.concatenate(x) for x in zip(*xs, strict=True))) if xs else (np.empty(0, np.uint64),) * 2
        ws, t = summed_words(parts)
        h = {k: read_array(path, f"history-{pid}.{k}", "u8") if summed else np.empty(0, np.uint64) for k in ("w", "c", "n1", "n2", "n3")}
        every = np.union1d(ws, h["w"])
        history, back, follows = np.zeros(len(every), np.uint64), np.ones(len(every)), np.zeros(len(every), np.uint64)
        follows[np.searchsorted(every, ws)] = t
        at = np.searchsorted(every, h["w"])
        history[at] = h["c"]
        back[at] = sum(d * h[k] for d, k in zip(pair_d, ("n1", "n2", "n3"), strict=True)) / np.maximum(h["c"], np.uint64(1))
        tokens = history.copy()
        tokens[every == np.uint64(END)] = documents
        tokens[every == np.uint64(START)] = 0
        if order > 2:  # histories hold numbers of distinct words here
            met, c = summed_words(counts)
            tokens[:] = 0
            tokens[np.searchsorted(every, met)] = c
        write_arrays(path, f"words-{pid}", {"w": every, "c": tokens, "h": history, "t": follows, "back": back})
        real = follows[follows > 0]
        yield _rows([(pid, "sum", b"", *_of_counts(real), int((real > 2).sum()), len(real), int(tokens.sum()))])

    sums = by_range(merged.select("pid", "kind", F.when(F.col("kind") != "sum", F.col("blob")).alias("blob"), *(F.col(c) for c in ("n1", "n2", "n3", "n4", "n3up", "types", "tokens"))), vocabulary)
    v = sums.agg(F.collect_set("pid").alias("pids"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n3up", "types", "tokens"))).first()
    filled = {**filled, **high_filled, "words": set(v["pids"])}
    filled |= {k.replace("pairs", "history"): x for k, x in filled.items() if k.startswith("pairs")}
    word_d = discounts(v["n1"], v["n2"], v["n3"], v["n4"])
    spare = (word_d[0] * v["n1"] + word_d[1] * v["n2"] + word_d[2] * v["n3up"]) / total["types"] if total["types"] else 1.0
    return Model(path, ranges, v["tokens"], v["types"], pair_d, word_d, total["types"], spare, high_d, {k: frozenset(x) for k, x in filled.items()})


def _name(kind: str, width: int) -> str:
    return kind if width == 2 else f"{kind}{width}"


def _skip_empty(f):
    """f over a partition's batches, unless there are none; each partition holds one range."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            seen.update(b.column(0).unique().to_pylist())
            if len(seen) > 1:
                raise ValueError(f"ranges {sorted(seen)} in one partition")
            if b.num_rows:
                yield b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = checked(batches)
        first = next(some, None)
        if first is not None:
            from itertools import chain

            yield from f(chain([first], some))

    return run


class Reader:
    """The arrays of a model, each range mapped when first needed."""

    kinds = {"words": {"w": "u8", "c": "u8", "h": "u8", "t": "u8", "back": "f8"}, "pairs": {"key": "u8", "n": "u1", "many": "u8", "times": "u8"}, "history": {"w": "u8", "c": "u8", "n1": "u8", "n2": "u8", "n3": "u8"}}

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def arrays(self, kind: str, pid: int) -> dict[str, np.ndarray] | None:
        if (kind, pid) not in self.maps:
            # a range that no word, or no history, falls into has no files; any other file that is missing is an error
            there = pid in self.model.filled.get(kind, ())
            self.maps[kind, pid] = {k: read_array(self.model.path, f"{kind}-{pid}.{k}", t) for k, t in self.kinds[kind.rstrip("0123456789")].items()} if there else None
        return self.maps[kind, pid]

    def find(self, kind: str, pids: np.ndarray, keys: np.ndarray, wanted: tuple[str, ...], default: dict) -> dict[str, np.ndarray]:
        """Values of sorted (pids, keys)."""
        out = {k: np.full(len(keys), default[k], np.float64) for k in wanted}
        name = "key" if kind.startswith("pairs") else "w"
        for pid in np.unique(pids):
            a, b = np.searchsorted(pids, [pid, pid + 1])
            found = self.arrays(kind, int(pid))
            if found is None or not len(found[name]):
                continue
            at = np.minimum(np.searchsorted(found[name], keys[a:b]), len(found[name]) - 1)
            hit = found[name][at] == keys[a:b]
            for k in wanted:
                out[k][a:b][hit] = found[k][at[hit]]
            if name == "key":
                many = a + np.flatnonzero(out["n"][a:b] == MANY)
                out["n"][many] = found["times"][np.searchsorted(found["many"], keys[many])]
        return out

    def log10(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of each token (with_history): the model's log10 probability and its count in training."""
        m, (prev, cur) = self.model, columns[-2:]
        every, where = np.unique(np.concatenate([cur, [np.uint64(START)]]), return_inverse=True)
        w = self.find("words", in_range(every, m.ranges), every, ("c", "h", "t", "back"), {"c": 0, "h": 0, "t": 0, "back": 1})
        low = np.maximum(w["t"] - np.select([w["t"] == 1, w["t"] == 2, w["t"] > 2], m.word_discounts, 0.0), 0) / max(m.followed, 1) + m.spare / (m.distinct + 1)
        own = where[:-1]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[prev == np.uint64(START)] = where[-1]
        key, pid = pair_key(prev, cur), in_range(prev, m.ranges)
        order = np.lexsort((key, pid))
        n = np.empty(len(key))
        n[order] = self.find("pairs", pid[order], key[order], ("n",), {"n": 0})["n"]
        high = (n - np.select([n == 1, n == 2, n > 2], m.pair_discounts, 0.0)) / np.maximum(w["h"][before], 1)
        p = high + w["back"][before] * low[own]
        for width, cuts in enumerate(m.high_discounts, 3):
            words = columns[-width:]
            told = history(words[:-1])
            keys, back = np.unique(told, return_inverse=True)
            h = self.find(f"history{width}", in_range(keys, m.ranges), keys, ("c", "n1", "n2", "n3"), dict.fromkeys(("c", "n1", "n2", "n3"), 0))
            key, pid = pair_key(told, cur), in_range(told, m.ranges)
            order = np.lexsort((key, pid))
            n = np.empty(len(key))
            n[order] = self.find(f"pairs{width}", pid[order], key[order], ("n",), {"n": 0})["n"]
            c = h["c"][back]
            spare = sum(d * h[k] for d, k in zip(cuts, ("n1", "n2", "n3"), strict=True))[back]
            met = (c > 0) & (words[1] != np.uint64(START))
            p = np.where(met, (n - np.select([n == 1, n == 2, n > 2], cuts, 0.0) + spare * p) / np.maximum(c, 1), p)
        return np.log10(p), w["c"][own]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, base_score (add-one unigrams), score; log10."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        readers = state.setdefault("kneser_ney", {})
        if model.path not in readers:
            readers.clear()
            readers[model.path] = Reader(model)
        for rows, words, ends in token_chunks(batches, ("doc_id",), 1_000_000):
            prev, cur, at = with_ends(words, ends)
            logs, c = readers[model.path].log10(with_history(prev, cur, at, 2 + len(model.high_discounts)))
            base = np.log10((c + 1) / (model.tokens + model.distinct + 1))
            total = lambda x: np.add.reduceat(x, at[:-1])  # noqa: B023, E731
            columns = [pa.array([r[0] for r in rows], pa.int64()), np.diff(at), total((c > 0).astype(np.int64)), total(base), total(logs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
