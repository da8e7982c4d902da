"""Best-fit packing of tokenised documents by bin completion.

Which sequence a piece goes to depends on its length alone, so the plan is made on the histogram of lengths, at most
`capacity` rows whatever the corpus: around the largest length left, undominated fillings of the rest are enumerated,
when they are asked for, and the chosen one is used as often as the counts allow. Branch and bound goes back over these
choices; a branch is cut once its waste exceeds what a better solution than the incumbent may waste. The first incumbent
is best-fit decreasing. Pieces then find their place by their rank among those of equal length.

Scale: texts are tokenised where they are read and never shuffled. Pieces (40 bytes each) are ranked within (length,
bucket), so a length that a third of all pieces share is ranked by as many tasks as there are buckets. The plan is a
table of at most a few times `capacity` rows.

Defined cases: a null or empty text is the end id alone; repeated rows are packed one by one; a text that holds the
string of a special token is ordinary text; other columns are ignored; no documents, no rows. `max_looks` bounds the
search and thereby how good the plan is, never which pieces it places.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import give_back, saved, worker_state

CAPACITY, END_ID = 2048, 0
CACHED_WORDS = 200_000
#: Texts whose pieces are held at once.
PORTION = 500


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Pieces(dict):
    """A word with the space before it -> its ids as little-endian bytes. Byte-level pre-tokenising never looks across
    a single space between two other characters, so texts split there can be encoded word by word. A word that begins
    or ends with white space has no entry of its own (None), and its text is encoded whole. Words met for the first
    time go through tiktoken over the same file's vocabulary, which gives the ids of the tokenizers library in a
    fifth of its time; tests hold the two against each other."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # byte-level vocabularies write a byte that does not print as the next free character from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes | None:
        ids = None if not word or word[0].isspace() or word[-1].isspace() else array("I", self.words.encode_ordinary(" " + word)).tobytes()
        if len(self) < CACHED_WORDS and len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.whole(text)
        try:
            return b"".join([self.whole(first), *map(self.__getitem__, rest)])
        except TypeError:
            return self.whole(text)


def encoder(path: str) -> Pieces:
    key = f"pieces:{path}"
    state = worker_state()
    if key not in state:
        state[key] = Pieces(path)
        give_back()  # reading the vocabulary takes several times what is kept of it
    return state[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: whole capacities, the shorter rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, piece, start, length, ids_crc32, and ids (little-endian uint32) if asked for."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        for batch in (b.slice(a, PORTION) for b in batches for a in range(0, b.num_rows, PORTION)):
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = (encode(t) if (t := text.as_py()) else b"") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id.as_py(), k, start, length, zlib.crc32(part), *([part] if with_ids else [])))
            columns = list(zip(*out, strict=True)) or [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# The plan.


@dataclass(frozen=True)
class Pattern:
    """A filling, as (length, times) from the longest, and how many sequences use it."""

    items: tuple[tuple[int, int], ...]
    times: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Each item, longest first, into the fullest sequence that takes it. Equal sequences are handled together."""
    open_: dict[int, list[list]] = {}  # room left -> [items, how many]
    rooms: list[int] = []
    done: list[Pattern] = []

    def put(items: tuple, room: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([items, n])
        elif n:
            done.append(Pattern(items, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                put(((size, per),), capacity - per * size, left // per)
                if left % per:
                    put(((size, left % per),), capacity - size * (left % per), 1)
                break
            room = rooms[at]
            items, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            per = room // size
            full = min(n, left // per)
            put((*items, (size, per)), room - per * size, full)
            left -= full * per
            n -= full
            if n and left and left < per:
                put((*items, (size, left)), room - left * size, 1)
                left, n = 0, n - 1
            put(items, room, n)
    done += [Pattern(items, n) for groups in open_.values() for items, n in groups]
    return done


def _grown(left: list[int], present: int, room: int, big: int, allowed: int, items: tuple, tick) -> Iterator[tuple[int, tuple]]:
    """(waste, items) of ways to fill room, wasting at most `allowed`, with lengths in the bit set `present`, longest
    first; one `big` is in use already."""
    tick()
    below = present & (2 << room) - 1
    if room <= allowed:
        yield room, items
    while below:
        s = below.bit_length() - 1
        below ^= 1 << s
        most = min(left[s] - (s == big), room // s)
        if not below and most * s < room - allowed:
            return
        for times in range(most, 0, -1):
            yield from _grown(left, below, room - times * s, big, allowed, (*items, (s, times)), tick)


def fillings(left: list[int], present: int, room: int, big: int, allowed: int, width: int, tick) -> Iterator[tuple[int, tuple]]:
    """All undominated fillings of the room beside one `big`, as (waste, items): longest items first, and of each
    `width` in turn (or as soon as two of them waste nothing) the least waste first. A filling is left out if a length that is still
    there fits into its waste, or if one of its items can be exchanged for such a longer one. Nothing is enumerated
    before it is asked for."""

    def dominated(items: tuple, waste: int) -> bool:
        use = dict(items)
        use[big] = use.get(big, 0) + 1
        for s in (0, *(s for s, _ in items)):
            longer = present >> s + 1 & (1 << waste) - 1
            while longer:
                t = s + longer.bit_length()
                if left[t] > use.get(t, 0):
                    return True
                longer ^= 1 << longer.bit_length() - 1
        return False

    window: list[tuple[int, tuple]] = []
    try:
        for waste, items in _grown(left, present, room, big, allowed, (), tick):
            if not waste or not dominated(items, waste):
                window.append((waste, items))
                if len(window) >= width or sum(w == 0 for w, _ in window) > 1:
                    yield from sorted(window, key=lambda f: f[0])
                    window = []
    except _Enough:
        yield from sorted(window, key=lambda f: f[0])
        raise
    yield from sorted(window, key=lambda f: f[0])


class _Enough(Exception):
    """A filling took more looks than it may."""


def _search(counts: dict[int, int], capacity: int, fewest: int, width: int, per: int, budget: int) -> tuple[list[Pattern] | None, bool, int]:
    """Depth first. Returns a plan of fewer than `fewest` sequences, or None; whether any enumeration was cut short; and
    the looks taken. One array of counts is changed and restored, so memory follows the depth and not the nodes."""
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    left = [0] * (capacity + 1)
    present = 0
    for s, n in counts.items():
        left[s], present = n, present | 1 << s
    best, cut, looks, used, waste = None, False, 0, 0, 0
    done: list[Pattern] = []

    def options() -> Iterator[tuple[int, int, tuple]]:
        nonlocal cut
        mine = 0

        def tick() -> None:
            nonlocal looks, mine
            looks, mine = looks + 1, mine + 1
            if mine > per or looks > budget:
                raise _Enough

        big = present.bit_length() - 1
        try:
            for w, items in fillings(left, present, capacity - big, big, (fewest - 1) * capacity - total - waste, width, tick):
                yield big, w, items
        except _Enough:
            cut = True

    frames = [options()]
    while frames and fewest > bound:
        big, w, items = next(frames[-1], (0, 0, ()))
        allowed = (fewest - 1) * capacity - total - waste
        if big and w > allowed:
            continue
        if not big:
            frames.pop()
            if done:
                p, w = done.pop()
                for s, k in p.items:
                    left[s] += k * p.times
                    present |= 1 << s
                used, waste = used - p.times, waste - w * p.times
            continue
        use = dict(items)
        use[big] = use.get(big, 0) + 1
        times = min(left[s] // k for s, k in use.items())
        times = min(times, allowed // w) if w else times
        for s, k in use.items():
            left[s] -= k * times
            if not left[s]:
                present ^= 1 << s
        done.append((Pattern(tuple(sorted(use.items(), reverse=True)), times), w))
        used, waste = used + times, waste + w * times
        if not present and used < fewest:
            best, fewest = [p for p, _ in done], used
        frames.append(options() if present else iter(()))
    return best, cut, looks


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_looks: int = 2_000_000, width: int = 4) -> list[Pattern]:
    """Patterns that use every count up, in as few sequences as the search finds. Each enumeration of fillings may first
    take some hundreds of looks; as long as one was cut short and max_looks allow, the search is run again with more."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    best = best_fit_decreasing(counts, capacity)
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    per = 500
    while sum(p.times for p in best) > bound and max_looks > 0:
        found, cut, looks = _search(counts, capacity, sum(p.times for p in best), width, per, max_looks)
        best, max_looks, per = found or best, max_looks - max(looks, 1), per * 8
        if not cut:
            break
    return best


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Per length and range of ranks lo..: sequence = base + (rank - lo) // per, offset = off + (rank - lo) % per * length."""
    rows, taken, base = [], {}, 0
    for p in patterns:
        off = 0
        for size, per in p.items:
            lo = taken.get(size, 0)
            rows.append((size, lo, base, per, off))
            taken[size] = lo + per * p.times
            off += size * per
        base += p.times
    rows.sort()
    names = ("length", "lo", "base", "per", "off")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T.copy(), strict=True))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, max_looks: int = 2_000_000, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset. Computes the pieces once, into the shared folder, to count their lengths."""
    spark = docs.sparkSession
    cut_up = saved(pieces(docs, vocabulary, capacity, with_ids))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows are told apart by where they are in the files, so copies under one id, or under none, do not meet in one bucket
    cut_up = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    counts = cut_up.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = slots(plan(histogram, capacity, max_looks))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut_up.withColumn("nth", F.row_number().over(own)).join(firsts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("nth") - 1).cast("long"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = cut_up.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table["length"] << 44 | table["lo"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            nth = rank - table["lo"][at]
            sequence = table["base"][at] + nth // table["per"][at]
            offset = table["off"][at] + nth % table["per"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema)
