"""Repeated passages by prefix-partitioned suffix trees over words.

A window is 50 consecutive words of a document. The strings are suffixes that start at window starts, and a tree over
them need be no deeper than a window: a node of depth 50 with leaves in more than one document is a repeat, and runs of
such nodes along a document are the maximal repeats. Four steps find them without gathering all suffixes:

1. Every window has a sync word position: of the 41 runs of 10 words in it, the first with the smallest hash. It depends
   on the window's words alone, so equal windows have it in the same place. Consecutive windows share it; together they
   are a fragment: its suffixes, as the words from the first window's start to the last one's end. One scan writes each
   document's fragments to the shared folder: the hash of the 10 words (the prefix that partitions), 128 bits that name
   the fragment's words, and where it is. That is one row for about 21 suffixes.
2. A prefix that one document alone has can't hold a repeat and goes, as a branch without inner nodes. If all fragments
   of a prefix are the same, the tree is a single path, and no words are needed.
3. Fragments of the other prefixes are merged where they are the same (with the smallest id that has them), so that a
   group of copies, however large, is one fragment. A prefix with more than `most` different fragments is lengthened:
   suffixes at nearby places before the sync position go together, at first 8 and at last one, by the hash of the words
   that all of these have in common, so prefixes have 10, 43 or 50 words. At 50 nothing is left to tell apart, so every
   group is bounded by `most`, and none is cut off.
4. The words of one example of each fragment left are read, dealt by prefix, and a subtree is built for as many prefixes
   as fit in memory together: suffixes are ordered by ranks over 1, 2, 4, ... words, as in the construction of suffix
   arrays; leaves that agree over 50 words hang below one deep node, which takes the smallest id below it.

A window goes if the smallest id of its node is smaller than its document's. Only documents that lose something are read
again; their texts meet their windows by a join on the document.

Words are compared by 64-bit hashes and merged fragments by 128 bits of them; prefixes only deal out. Texts are read
whole. A hot prefix, passage or group of copies is combined before it is shuffled, and joins with it have one row of the
hot key on the other side, where adaptive execution splits skew.

Defined cases: a null text has no words, nothing to remove, and the empty text's digest. Documents of fewer than 50 words
lose nothing. Windows within one document, or in rows with the same id, don't count against each other; a null id is
neither smaller nor larger than another, so such rows lose nothing and cost nobody anything. Repeated rows are returned as
often as they occur. Very long texts are one row's work. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import IdSet, Scratch, WordHashes, chosen, give_back, mixed, worker_state

WINDOW, GRAM = 50, 10
#: Windows that may share a sync position: offsets 0 to SPREAD - 1.
SPREAD = WINDOW - GRAM + 1
#: How many offsets go together at each length of prefix.
WIDTHS = (SPREAD, 8, 1)
M1, M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

FRAGMENTS = "array<struct<lo:int,hi:int,off:int,prefix:long,f1:long,f2:long>>"
BOOK = f"doc_id long, text_key long, n_words long, sha string, fragments {FRAGMENTS}"


def text_key() -> Column:
    """With the id, it names a row; rows that share both are the same document."""
    return F.xxhash64(F.lit(11), "text")


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(words: list[bytes]) -> np.ndarray:
    get = worker_state().setdefault("word_hashes", WordHashes()).__getitem__
    return np.fromiter(map(get, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any run of words, as a polynomial of their hashes modulo 2^64."""

    def __init__(self, h: np.ndarray, base: int):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
        self.back = powers(pow(base, -1, 2**64), len(h) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def fragments(h: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The fragments of documents whose words lie one after the other in h: doc (its number), lo, hi (first and last
    window start, in the document), off (of the sync position from lo), prefix, f1, f2."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    last = ends - WINDOW  # the last window start of a document, if it isn't before its begin
    room = np.zeros(len(h) + 1, np.int64)
    has = last >= begins
    np.add.at(room, begins[has], 1)
    np.add.at(room, last[has] + 1, -1)
    starts = np.flatnonzero(np.cumsum(room) > 0)
    if not len(starts):
        none = np.empty(0, np.int64)
        return dict.fromkeys(("doc", "lo", "hi", "off", "prefix", "f1", "f2"), none)
    one, at = Ranges(h, M1), np.arange(len(h) - GRAM + 1)
    rank = one.of(at, at + GRAM)
    views = np.lib.stride_tricks.sliding_window_view(rank, SPREAD)
    sync = np.concatenate([views[i : i + 65_536].argmin(1) for i in range(0, len(views), 65_536)])[starts] + starts
    first = np.flatnonzero(np.concatenate([[True], sync[1:] != sync[:-1]]))
    lo, hi, p = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1], sync[first]
    doc = np.searchsorted(ends, lo, "right")
    # the place of the sync position is part of the name
    f1, f2 = one.of(lo, hi + WINDOW) ^ mixed((p - lo).astype(np.uint64)), Ranges(h, M2).of(lo, hi + WINDOW)
    return {"doc": doc, "lo": lo - begins[doc], "hi": hi - begins[doc], "off": p - lo, "prefix": rank[p].view(np.int64), "f1": f1.view(np.int64), "f2": f2.view(np.int64)}


def book_of(docs: DataFrame, most_words: int = 200_000, most_rows: int = 512) -> DataFrame:
    """Every row's words, digest and fragments; texts are read once, whole, and their words dealt with as soon as there
    are most_words of them."""

    def told(ids, keys, n_words, digests, hashes):
        # words of rows without an id take no part
        taken = [h if i is not None else h[:0] for i, h in zip(ids, hashes, strict=True)]
        found = fragments(np.concatenate(taken), np.cumsum([len(h) for h in taken]))
        ends = np.searchsorted(found["doc"], np.arange(len(ids) + 1))
        kinds = {"lo": np.int32, "hi": np.int32, "off": np.int32, "prefix": np.int64, "f1": np.int64, "f2": np.int64}
        items = pa.StructArray.from_arrays([pa.array(found[k].astype(t)) for k, t in kinds.items()], names=list(kinds))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
            names=["doc_id", "text_key", "n_words", "sha", "fragments"],
        )

    def run(batches):
        rows: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i in range(batch.num_rows):
                words = split(batch.column(1)[i].as_py())
                for to, v in zip(rows, (ids[i], keys[i], len(words), hashlib.sha256(b" ".join(words)).hexdigest(), hashed(words)), strict=True):
                    to.append(v)
                held += len(words)
                if held >= most_words or len(rows[0]) >= most_rows:
                    yield told(*rows)
                    rows, held = ([], [], [], [], []), 0
        if rows[0]:
            yield told(*rows)
        rows = words = None
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("text_key")).mapInArrow(run, BOOK)


PIECES = "prefix long, level int, f1 long, f2 long, m0 long, lo int, hi int, shift int, off int, words binary"


def _words_of(met: DataFrame) -> DataFrame:
    """text, pieces array<struct<lo, hi, off, prefix, f1, f2, m0>> -> PIECES of the first level."""

    def run(batches):
        for batch in batches:
            texts, all_pieces = batch.column(0), batch.column(1)
            out: list[tuple] = []
            for i in range(batch.num_rows):
                h = hashed(split(texts[i].as_py()))
                for p in all_pieces[i].as_py():
                    out.append((p["prefix"], 0, p["f1"], p["f2"], p["m0"], p["lo"], p["hi"], 0, p["off"], h[p["lo"] : p["hi"] + WINDOW].tobytes()))
                    if len(out) >= 4096:
                        yield _pieces(out)
                        out = []
            yield _pieces(out)
        give_back()

    return met.select("text", "pieces").mapInArrow(run, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


def lengthened(piece: dict, width: int) -> list[tuple]:
    """A piece as pieces of suffixes whose places before the sync position are `width` together, under longer prefixes."""
    h, out = np.frombuffer(piece["words"], np.uint64), []
    ranges = Ranges(h, M1)
    sync, n = piece["off"], piece["hi"] - piece["lo"] + 1
    for g in range(-(-SPREAD // width)):
        # suffixes with offsets first..last before the sync position: starts sync - last .. sync - first within the piece
        first, last = g * width, min(SPREAD, (g + 1) * width) - 1
        a, b = max(0, sync - last), min(n - 1, sync - first)
        if a > b:
            continue
        shared = np.array([sync - first]), np.array([sync - last + WINDOW])  # all of these suffixes have the words between
        prefix = int((ranges.of(*shared)[:1] ^ mixed(np.array([g * 64 + width], np.uint64))).view(np.int64)[0])
        out.append((prefix, piece["level"] + 1, piece["f1"], piece["f2"], piece["m0"], piece["lo"], piece["lo"] + b - a, piece["shift"] + a, sync - a, h[a : b + WINDOW].tobytes()))
    return out


def _lengthen(pieces: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                yield _pieces([x for piece in batch.slice(i, 512).to_pylist() for x in lengthened(piece, width)])

    return pieces.mapInArrow(run, PIECES)


def deep_nodes(words: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For suffixes that start at `starts` in an array of words: the number of the node of that depth each hangs below.
    Ranks over 2t words order pairs of ranks over t words; numbers follow the suffixes' order."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    t = 1
    while 2 * t <= depth:
        pair = rank[:-t] * (rank.max() + 1) + rank[t:] if len(rank) > t else rank[:0]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        t *= 2
    pair = rank[starts] * (rank.max() + 1) + rank[starts + depth - t]
    return np.unique(pair, return_inverse=True)[1]


def subtrees(pieces: list[tuple[int, int, bytes]]) -> list[int]:
    """For pieces (m0, number of suffixes, words): a bit for each suffix whose deep node has an id below m0."""
    lengths = np.array([len(p[2]) // 8 for p in pieces])
    words = np.frombuffer(b"".join(p[2] for p in pieces), np.uint64)
    counts = np.array([p[1] for p in pieces])
    own = np.repeat(np.arange(len(pieces)), counts)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    node = deep_nodes(words, begin[own] + place)
    m0 = np.array([p[0] for p in pieces], np.int64)
    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, node, m0[own])
    goes = least[node] < m0[own]
    bits = np.zeros(len(pieces), np.int64)
    np.bitwise_or.at(bits, own, np.where(goes, np.int64(1) << place, 0))
    return bits.tolist()


def _grow(pieces: DataFrame, most_words: int = 1_000_000) -> DataFrame:
    """pieces, each prefix in one partition and together -> f1, f2 (the fragment), bits: which of its windows
    have an id below m0. Prefixes are taken together until they have most_words words."""
    schema = "f1 long, f2 long, bits long"

    def run(batches):
        rows: list[tuple] = []
        size, last = 0, None

        def grown():
            bits = subtrees([r[:3] for r in rows])
            hits = [(r[3], r[4], b << r[5]) for r, b in zip(rows, bits, strict=True) if b]
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in range(3)], names=["f1", "f2", "bits"])

        for batch in batches:
            for p in batch.to_pylist():
                if size >= most_words and p["prefix"] != last:
                    yield grown()
                    rows, size = [], 0
                last = p["prefix"]
                rows.append((p["m0"], p["hi"] - p["lo"] + 1, p["words"], p["f1"], p["f2"], p["shift"]))
                size += len(p["words"]) // 8
        if rows:
            yield grown()
        rows = []
        give_back()

    dealt = pieces.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, schema)


def _windows(book: DataFrame, docs: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """book -> doc_id, text_key, lo, gone: for fragments that lose windows, a bit for each of them from lo on."""
    each = book.where("doc_id is not null").select("doc_id", "text_key", F.explode("fragments").alias("f")).select("doc_id", "text_key", "f.*")
    prefixes = each.groupBy("prefix").agg(F.min("doc_id").alias("p0"), F.max("doc_id").alias("p1"), *(fn(c).alias(f"{fn.__name__}_{c}") for c in ("f1", "f2") for fn in (F.min, F.max)))
    shared = prefixes.where("p0 < p1").select(F.col("prefix").alias("of"), "p0", F.expr("min_f1 < max_f1 or min_f2 < max_f2").alias("branches"))
    shared = scratch.save(shared)  # kept apart from the join, which could not split a hot prefix below an aggregate
    met = scratch.save(each.join(shared, F.col("prefix") == F.col("of")).drop("of"))
    every = F.expr("shiftleft(1L, hi - lo + 1) - 1")
    single = met.where("not branches and doc_id > p0").select("doc_id", "text_key", "lo", every.alias("gone"))

    branching = met.where("branches")
    one = scratch.save(branching.groupBy("prefix", "f1", "f2").agg(F.min("doc_id").alias("m0"), F.min(F.struct("doc_id", "text_key", "lo", "hi", "off")).alias("at")))
    examples = one.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.text_key").alias("text_key")).agg(F.collect_list(F.struct("at.lo", "at.hi", "at.off", "prefix", "f1", "f2", "m0")).alias("pieces"))
    pieces = scratch.save(_words_of(_meet(docs, scratch.save(examples))))
    bits = None
    for width in (*WIDTHS[1:], None):
        hot = None
        if width:
            hot = scratch.save(pieces.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("prefix").alias("of")))
            hot = None if hot.isEmpty() else hot
        # suffixes of one window each need no tree: all that share its words hang below one node
        grown = _leaves(pieces) if not width else _grow(pieces.join(hot, F.col("prefix") == F.col("of"), "left_anti") if hot else pieces)
        bits = grown if bits is None else bits.unionByName(grown)
        if not hot:
            break
        pieces = scratch.save(_lengthen(pieces.join(hot, F.col("prefix") == F.col("of"), "left_semi"), width))
    bits = scratch.save(bits.groupBy(F.col("f1").alias("g1"), F.col("f2").alias("g2")).agg(F.bit_or("bits").alias("bits")))
    judged = scratch.save(one.join(bits, F.expr("f1 = g1 and f2 = g2"), "left").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("prefix").alias("of"), "m0", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))
    both = branching.drop("of").join(judged, F.expr("prefix = of and f1 = g1 and f2 = g2"))
    some = both.select("doc_id", "text_key", "lo", F.when(F.col("doc_id") > F.col("m0"), every).otherwise(F.col("bits")).alias("gone")).where("gone <> 0")
    return single.unionByName(some)


def _leaves(pieces: DataFrame) -> DataFrame:
    """The same as _grow where every piece is one window."""
    least = pieces.groupBy(F.col("prefix").alias("of"), F.col("words").alias("whole")).agg(F.min("m0").alias("least"))
    met = pieces.join(least, F.expr("prefix = of and words = whole")).where("least < m0")
    return met.select("f1", "f2", F.expr("shiftleft(1L, shift)").alias("bits"))


def _meet(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """text and the columns of rows (doc_id, text_key, ...), for one document row of each. Rows that others repeat are
    combined before texts are shuffled."""
    named = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"), text_key().alias("_key"))
    some = chosen(named, IdSet(rows.select(F.xxhash64("doc_id", "text_key").alias("id"))), True, F.xxhash64("_doc", "_key"))
    return some.groupBy("_doc", "_key").agg(F.first("text").alias("text")).join(rows, F.expr("_doc = doc_id and _key = text_key")).drop("_doc", "_key")


def _kept(met: DataFrame) -> DataFrame:
    """text, doc_id, text_key, windows array<struct<lo, gone>> -> doc_id, text_key, n_removed, sha."""

    places = np.arange(SPREAD)

    def run(batches):
        for batch in batches:
            texts, windows = batch.column(2), batch.column(3)
            removed, digests = [], []
            for i in range(batch.num_rows):
                words, found = split(texts[i].as_py()), windows[i].values
                lo, gone = (found.field(k).to_numpy() for k in ("lo", "gone"))
                at = (lo[:, None] + places)[(gone[:, None] >> places) & 1 == 1]
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, at, 1)
                np.add.at(change, at + WINDOW, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(words[k] for k in kept.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests)], names=["doc_id", "text_key", "n_removed", "sha"])
        give_back()

    return met.select("doc_id", "text_key", "text", "windows").mapInArrow(run, "doc_id long, text_key long, n_removed long, sha string")


def deduplicate(docs: DataFrame, most: int = 4_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 of every row. most: different fragments below one
    prefix before it is lengthened."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    book = scratch.save(book_of(docs))
    windows = _windows(book, docs, scratch, most)
    lists = scratch.save(windows.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "gone")).alias("windows")))
    kept = _kept(_meet(docs, lists)).withColumnsRenamed({"doc_id": "_doc", "text_key": "_key", "sha": "kept_sha"})
    out = book.drop("fragments").join(kept, F.expr("doc_id = _doc and text_key = _key"), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
