r"""Exact Jaccard self-join of word n-gram sets by universe partitioning, and the groups its links form.

Sets with Jaccard similarity of at least `percent` differ in at most H = (a + b) * (100 - percent) / (100 + percent)
elements. For a band of sizes, hashed shingles are dealt into segments, and each segment gets an allowance: 0 (it must
agree whole, one signature) or 1 (it may differ by one element: its signature and those with one element deleted).
By pigeonhole, if the allowances plus one sum to H + 1 + E, segments worth 1 + E agree within their allowance for any
linked pair. How many segments get which allowance is chosen per band by estimated cost. Signatures that only say
"nothing here" are left out as long as they are worth no more than E in their set, so they never gather unrelated sets.
Small sets are dealt into segments several times; the few for which such signatures are worth more than E every time
(one in a million by design) send them too. A set sends signatures for its own band and for the next, where it
may be the smaller partner.

Equal sets share an id, so copies are joined once. The sets that share a signature are first compared with the first of
them. Only buckets whose other sets then lie in more than one component are looked at again: neighbours in seeded orders
of the bucket are compared, and then, across components, what is still apart. No pair within a component that is already
whole is made, and no link between different components is missed. A pair is a candidate only if it meets bounds by size
and by a 1024-bit parity sketch (differing bits never outnumber differing elements); candidates are compared exactly.

Scale: signatures (16 bytes; about 0.3 per shingle of longer sets) are the one large exchange, sorted by signature and
read as a stream, so a bucket of any size needs no memory. A large bucket is compared across components by pairs of
blocks of `BLOCK` sets, each a key of its own. Texts are never shuffled: sets with a candidate are spelt out where their text
is read, chosen by a set of ids that workers map from the shared folder, and written once as sorted arrays by ranges of
set ids, which the comparison of pairs maps in turn; no pair carries its sets. Superseded tables are deleted at once.

Defined cases: A-Z is lower-cased; texts with fewer than n words have their whole sequence as one shingle; null and
empty texts, or texts of white space, have no shingles and are linked with nothing; repeated rows are rows of one set;
rows with null ids take part, and a component's id is the smallest id that is not null; other columns are ignored.
Shingles and sets are identified by 64-bit hashes; for a billion sets, one chance in 37 that two of them agree.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import IdSet, Scratch, in_range, local_path, members, mixed, ranges_for, read_array, remove_dir, token_chunks, write_arrays
from gristmill.llm.components import connected_components

ODD = np.uint64(0x9E3779B97F4A7C15)
#: 64-bit words of a parity sketch.
WORDS = 16
SKETCH = [f"k{i}" for i in range(WORDS)]
#: Sets of a bucket that are compared with as many others in one group of rows.
BLOCK = 1024
#: What a segment with two shingles or fewer, which gathers unrelated sets, costs in signatures.
CROWD = 8


def most_different(a_plus_b, percent: int):
    """The largest symmetric difference of linked sets with that sum of sizes; works on ints and integer columns' SQL."""
    return a_plus_b * (100 - percent) // (100 + percent)


def band_tops(percent: int, largest: int) -> np.ndarray:
    """Largest size of each band; a set and its smallest linked partner lie in one band or in neighbours."""
    tops = [1]
    while tops[-1] < largest:
        # the next band's smallest size is top + 1; all sizes whose partners reach no lower than this band fit in it
        tops.append(max(tops[-1] + 1, (tops[-1] + 1) * 100 // percent))
    return np.array(tops)


def _too_weak(zeros: int, ones: int, spare: int, load: float) -> float:
    """Chance that empty segments (worth 1), and loose ones that a deletion empties (worth 2), are worth over spare."""
    if zeros + ones == 1:
        return 0.0  # the one segment holds the whole set
    if zeros * math.exp(-load) + 2 * ones * (1 + load) * math.exp(-load) > spare + 1:
        return 1.0
    k = np.arange(spare + 1)
    logs = np.r_[0.0, np.cumsum(np.log(np.arange(1, spare + 1)))]
    poisson = lambda mean: np.exp(k * math.log(mean) - mean - logs) if mean > 0 else (k == 0).astype(float)
    single, double = np.cumsum(poisson(zeros * math.exp(-load))), poisson(ones * (1 + load) * math.exp(-load))
    pairs = np.arange(spare // 2 + 1)
    return max(0.0, 1 - float((double[pairs] * single[spare - 2 * pairs]).sum()))


def allocation(low: int, top: int, percent: int, weak: float = 1e-6) -> tuple[int, int, int, int]:
    """(segments with allowance 0, with allowance 1, E, deals) of least estimated cost for sets of low..top shingles.

    Cost: signatures sent, and lightly filled segments weighted by how many sets they would gather. Small sets are
    dealt out several times, each time by another hash, until the share of sets that are too weak in every deal falls
    below `weak`: one deal in which either set of a linked pair is not too weak suffices."""
    need = most_different(2 * top, percent) + 1
    best = None
    most = need // 2 + 40
    for ones in sorted({0, 1, 2, 3, need // 8, need // 4, (need + 1) // 2}):
        chance = lambda spare, ones=ones: 1.0 if (segments := need + spare - ones) < max(1, ones) else _too_weak(segments - ones, ones, spare, low / segments)
        # of large sets, the least E with which one deal suffices; of small ones, every E with its number of deals
        tried = range(most) if need <= 60 else [min(most, bisect_left(range(most), True, key=lambda e, chance=chance: chance(e) < weak))]
        for spare in tried:
            zeros = need + spare - 2 * ones
            if zeros < 0 or zeros + ones == 0 or (p := chance(spare)) > 0.5:
                continue
            deals = max(1, math.ceil(math.log(weak) / math.log(p))) if p > 0 else 1
            load = top / (zeros + ones)
            light = math.exp(-load) * (1 + load + load * load / 2)
            cost = deals * (zeros * (1 + CROWD * light) + ones * (1 + load + CROWD * light))
            if best is None or cost < best[0]:
                best = (cost, zeros, ones, spare, deals)
            if p < weak:
                break
    # where no E makes weak sets rare, they send what says "nothing here", which is correct at any rate
    return best[1:] if best else (need, 0, 0, 1)


def _bounds(tops: np.ndarray, band: int) -> tuple[int, int]:
    """Sizes that use a band's scheme: its own and those of the band below."""
    return int(tops[band - 2]) + 1 if band >= 2 else 1, int(tops[band])


def shingles(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts one after another -> distinct shingle hashes, sorted by text, and the texts' offsets."""
    lengths = np.diff(ends)
    text = np.repeat(np.arange(len(lengths)), np.where(lengths >= n, lengths - n + 1, 0))
    if len(words) >= n:
        rolling = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            rolling = mixed(rolling * ODD + words[k : len(words) - n + 1 + k])
        starts = np.ones(len(words), bool)
        for k in range(1, n):
            at = ends[1:] - k
            starts[at[(lengths >= k)]] = False
        # the last n - 1 words of each text start no shingle
        h = rolling[starts[: len(rolling)]]
    else:
        h = np.empty(0, np.uint64)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    whole = np.empty(len(short), np.uint64)
    for i, t in enumerate(short):
        x = np.array([lengths[t]], np.uint64)
        for w in words[ends[t] : ends[t + 1]]:
            x = mixed(x * ODD + w)
        whole[i] = x[0]
    text, h = np.concatenate([text, short]), np.concatenate([h, whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(h) else np.empty(0, bool)
    text, h = text[new], h[new]
    return h, np.searchsorted(text, np.arange(len(lengths) + 1))


def set_ids(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    sizes = np.diff(at)
    total = np.zeros(len(sizes), np.uint64)
    total[sizes > 0] = np.add.reduceat(mixed(h ^ ODD), at[:-1][sizes > 0]) if len(h) else 0
    return mixed(total + sizes.astype(np.uint64) * ODD)


def sketches(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WORDS words per set: bit i is the parity of the number of elements dealt to it."""
    bit = (mixed(h + ODD) % np.uint64(64 * WORDS)).astype(np.int64)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bits = 64 * WORDS
    parity = np.bincount(owner * bits + bit, minlength=bits * len(sizes)).astype(np.uint8) & 1 if len(sizes) else np.empty(0, np.uint8)
    return np.packbits(parity.reshape(-1, bits), axis=1, bitorder="little").view("<u8") if len(sizes) else np.empty((0, WORDS), np.uint64)


def signatures(h: np.ndarray, at: np.ndarray, tops: np.ndarray, schemes: dict[int, tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all sets, given as sorted hashes and offsets."""
    sizes = np.diff(at)
    band = np.searchsorted(tops, sizes)
    owners, sigs = [], []
    for scheme in np.unique(np.r_[band[sizes > 0], band[sizes > 0] + 1]):
        zeros, ones, spare, deals = schemes[int(scheme)]
        segments = zeros + ones
        mine = np.flatnonzero((sizes > 0) & ((band == scheme) | (band + 1 == scheme)))
        n = sizes[mine]
        first = np.r_[0, np.cumsum(n)]
        plain = h[np.repeat(at[:-1][mine] - first[:-1], n) + np.arange(first[-1])]
        owner = np.repeat(np.arange(len(mine)), n) * segments
        always_weak, empties = np.ones(len(mine), bool), []
        for deal in range(deals):
            salt = (np.uint64(scheme) << np.uint64(32)) + (np.uint64(deal) << np.uint64(56)) + ODD
            label = lambda cells, salt=salt: mixed((cells % segments).astype(np.uint64) + salt)  # noqa: B023, E731
            name = lambda cells, total, k, label=label: mixed(label(cells) + mixed(total + k.astype(np.uint64) * ODD))
            el = mixed(plain + salt)
            # the first segments have allowance 1
            cell = owner + ((el >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            cell, el = cell[order], mixed(el[order])
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            full, held = cell[start], np.diff(np.r_[start, len(cell)])
            sums = np.add.reduceat(el, start)
            owners.append(mine[full // segments])
            sigs.append(name(full, sums, held))
            loose = full % segments < ones
            if ones:
                per = np.repeat(np.arange(len(start)), held)
                drop = loose[per] & (held[per] > 1)
                owners.append(mine[cell[drop] // segments])
                sigs.append(name(cell[drop], sums[per][drop] - el[drop], held[per][drop] - 1))
            # what says "nothing here": empty segments, and loose ones that one deletion empties
            worth = np.bincount(full // segments, np.where(loose, np.where(held > 1, 2, 0), 1), len(mine))
            always_weak &= zeros + 2 * ones - worth > spare
            empties.append((full, held, name))
        weak = np.flatnonzero(always_weak)
        for full, held, name in empties if len(weak) and segments > 1 else ():
            cells = (weak[:, None] * segments + np.arange(segments)).ravel()
            where = np.searchsorted(full, cells)
            count = np.where(np.r_[full, -1][where] == cells, np.r_[held, 0][where], 0)
            empty = cells[(count == 0) | (count == 1) & (cells % segments < ones)]
            owners.append(mine[empty // segments])
            sigs.append(name(empty, np.zeros(len(empty), np.uint64), np.zeros(len(empty), np.int64)))
    return (np.concatenate(owners), np.concatenate(sigs)) if owners else (np.empty(0, np.int64), np.empty(0, np.uint64))


# The join.


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


BASE = "doc_id long, row_key long, n long, set_id long, " + ", ".join(f"{k} long" for k in SKETCH)


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def described(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, text) -> each row's number of shingles, set id, sketch, and a hash of its id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words, ends in token_chunks(batches, ("doc_id", "row_key"), 250_000, 2_000):
            h, at = shingles(words, ends, n)
            k = sketches(h, at)
            yield _batch(BASE, [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), np.diff(at), _signed(set_ids(h, at)), *(_signed(np.ascontiguousarray(k[:, i])) for i in range(WORDS))])

    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row_key")).mapInArrow(run, BASE)


def indexed(docs: DataFrame, n: int, percent: int, largest: int) -> DataFrame:
    """docs (text) -> (sig, set_id); largest: an upper bound of the sets' sizes."""
    tops = band_tops(percent, largest)
    tops = np.r_[tops, tops[-1] * 100 // percent + 2]
    schemes = {b: allocation(*_bounds(tops, b), percent) for b in range(len(tops))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, ends in token_chunks(batches, (), 100_000):
            h, at = shingles(words, ends, n)
            ids = set_ids(h, at)
            _, one = np.unique(ids, return_index=True)  # copies within a chunk send their signatures once
            sizes = np.diff(at)[one]
            keep = np.concatenate([[0], np.cumsum(sizes)])
            el = h[np.repeat(at[one] - keep[:-1], sizes) + np.arange(keep[-1])]
            owner, sig = signatures(el, keep, tops, schemes)
            for a in range(0, len(sig), 100_000):
                yield _batch("sig long, set_id long", [_signed(sig[a : a + 100_000]), _signed(ids[one][owner[a : a + 100_000]])])

    return docs.select("text").mapInArrow(run, "sig long, set_id long")


class SetStore:
    """Sets' shingles in the shared folder, by ranges of set ids: sorted ids, offsets and shingles, mapped by workers."""

    def __init__(self, docs: DataFrame, wanted: IdSet, n: int, scratch: Scratch, total: int):
        """docs (doc_id, text): spelt are the rows whose doc_id is wanted. Ids may repeat or be null: a text says itself
        which set it spells. total: shingles of the sets wanted; a range is made for each two millions, as a task holds it."""
        self.path, self.ranges = f"{scratch.path}/sets-{scratch.next()}", ranges_for(docs.sparkSession, total, 2_000_000)
        path, ranges = self.path, self.ranges
        rows = "pid int, id long, shingles array<long>"

        def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen = (b.filter(pa.array(members(wanted, b.column(0), wanted.with_null))) for b in batches)
            for _, words, ends in token_chunks(chosen, (), 250_000):
                h, at = shingles(words, ends, n)
                ids = set_ids(h, at)
                yield _batch(rows, [pa.array(in_range(ids, ranges).astype(np.int32)), _signed(ids), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _signed(h))])

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            pids = set()
            for batch in batches:
                pids |= set(batch.column(0).unique().to_pylist())
                for i, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if i not in found:
                        found[i] = x.values.to_numpy()
            if len(pids) > 1:
                raise ValueError(f"ranges {sorted(pids)} in one partition")
            if found:
                ids = np.array(sorted(found), np.int64)
                sets = [found[i] for i in ids.tolist()]
                write_arrays(path, f"sets-{pids.pop()}", {"id": ids, "at": np.r_[0, np.cumsum([len(x) for x in sets])], "h": np.concatenate(sets)})
            yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["n"])

        spelt = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(spell, rows)
        spelt.repartitionById(ranges, F.col("pid")).mapInArrow(write, "n long").agg(F.sum("n")).collect()

    def linked(self, pairs: DataFrame, percent: int) -> DataFrame:
        """Of pairs (a, b) those whose sets, compared in full, are as similar as that."""
        path, ranges = self.path, self.ranges
        most = ranges if local_path(path) else 16  # mapped files take no memory

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple] = {}

            def shelf(pid: int) -> tuple:
                if pid not in held:
                    if len(held) >= most:
                        held.pop(next(iter(held)))
                    held[pid] = tuple(read_array(path, f"sets-{pid}.{k}", "i8") for k in ("id", "at", "h"))
                return held[pid]

            def spelt(ids: np.ndarray, pids: np.ndarray) -> list[np.ndarray]:
                out: list = [None] * len(ids)
                for pid in np.unique(pids):
                    there, at, h = shelf(int(pid))
                    mine = np.flatnonzero(pids == pid)
                    where = np.searchsorted(there, ids[mine])
                    if len(there) and (there[np.minimum(where, len(there) - 1)] != ids[mine]).any() or not len(there):
                        raise ValueError("a set that is to be compared has not been spelt")
                    for k, w in zip(mine.tolist(), where.tolist(), strict=True):
                        out[k] = h[at[w] : at[w + 1]]
                return out

            for batch in batches:
                a, b = (c.to_numpy() for c in batch.columns)
                x, y = (spelt(i, in_range(i.view(np.uint64), ranges)) for i in (a, b))
                same = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
                both = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64)
                keep = 100 * same >= percent * (both - same)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

        return pairs.select("a", "b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")

    def drop(self, docs: DataFrame) -> None:
        remove_dir(docs.sparkSession, self.path)


def _may_link(percent: int, x: str, y: str) -> Column:
    """Bounds that every linked pair meets."""
    differ = " + ".join(f"bit_count({x}.{k} ^ {y}.{k})" for k in SKETCH)
    size = f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
    return F.expr(f"{size} and {differ} <= (({x}.n + {y}.n) * {100 - percent}) div {100 + percent}")


def links(docs: DataFrame, n: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs (doc_id, text) -> base rows (see described), sets (set_id, n, first_doc, sketch) and the sets' components
    (id, component), computed."""
    scratch = Scratch(docs.sparkSession, "join")
    base = scratch.save(described(docs, n))
    sets = base.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in ("n", *SKETCH)))
    sets = scratch.save(sets)
    largest = sets.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    facts = sets.select(F.col("set_id").alias("id"), "n", *SKETCH)

    bucket = Window.partitionBy("sig").orderBy("set_id")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sigs = indexed(docs, n, percent, largest)
    starred = sigs.select("sig", "set_id", F.first("set_id").over(bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("rep"), F.lag("set_id").over(bucket).alias("before"), F.last("set_id").over(whole).alias("end"))
    # of two sets only, nothing is left once the second has been compared with the first
    buckets = scratch.save(starred.where("set_id <> rep and set_id <> before").select("sig", "rep", F.col("set_id").alias("id"), F.expr("before <> rep or set_id <> end").alias("more")))

    def verified(likely: DataFrame) -> DataFrame:
        """Of pairs (a, b) that meet the bounds, those that link; texts are read again for the sets that need it only."""
        likely = scratch.save(likely.distinct())
        if likely.isEmpty():
            return likely
        wanted = likely.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        met = scratch.save(sets.join(wanted, "set_id").select("first_doc", "n"))
        carriers = IdSet(met.select("first_doc"))
        store = SetStore(docs, carriers, n, scratch, met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        out = scratch.save(store.linked(likely, percent))
        carriers.drop()
        store.drop(docs)
        scratch.drop(likely, met)
        return out

    def component_of(rows: DataFrame) -> DataFrame:
        return rows.join(parts, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def joined(more: DataFrame) -> DataFrame:
        """The components after more links."""
        return connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch)

    x, y = facts.alias("x"), facts.alias("y")
    stars = buckets.select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(x, F.col("a") == F.col("x.id")).join(y, (F.col("b") == F.col("y.id")) & _may_link(percent, "x", "y")).select("a", "b")
    parts = connected_components(verified(stars), scratch)

    # the first of a bucket has been compared with all the others; are they of more than one component?
    placed = component_of(buckets.where("more").select("sig", "id"))
    split = placed.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("sig")
    apart = scratch.save(placed.join(split, "sig").select("sig", "id").join(facts, "id"))
    scratch.drop(buckets)
    if apart.isEmpty():
        return base, sets, parts
    # chains through such buckets, in seeded orders
    near = None
    for deal in range(2):
        order = Window.partitionBy("sig").orderBy(F.xxhash64(F.lit(deal), "id"))
        x = F.struct("id", "c", "n", *SKETCH)
        steps = component_of(apart).select(x.alias("x"), F.lag(x).over(order).alias("y")).where(F.col("x.c") != F.col("y.c")).where(_may_link(percent, "x", "y"))
        steps = steps.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        near = steps if near is None else near.unionByName(steps)
    more = verified(near)
    if not more.isEmpty():
        parts = joined(more)
    # what is still apart, by pairs of blocks
    size = Window.partitionBy("sig").orderBy("n", "id")
    blocks = component_of(apart).withColumn("block", F.expr(f"cast((row_number() over (partition by sig order by n, id) - 1) div {BLOCK} as int)"))
    blocks = blocks.withColumn("top", F.max("block").over(size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = blocks.withColumn("with", F.explode(F.sequence("block", "top"))).alias("x")
    y = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), "block"))).alias("y")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") == F.col("y.with")) & (F.col("x.with") == F.col("y.block"))
    on &= (F.col("x.c") != F.col("y.c")) & ((F.col("x.block") < F.col("y.block")) | (F.col("x.id") < F.col("y.id")))
    more = verified(x.join(y, on & _may_link(percent, "x", "y")).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")))
    if not more.isEmpty():
        parts = joined(more)
    scratch.drop(apart)
    return base, sets, parts


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id (the smallest id reachable by links), and for choosing
    among rows: row_key and group, one number per component."""
    base, sets, parts = links(docs, n, percent)
    placed = sets.select("set_id", "first_doc").join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("c", F.coalesce("component", "set_id"))
    smallest = placed.groupBy("c").agg(F.min("first_doc").alias("component_id"))
    ids = placed.join(smallest, "c").select(F.col("set_id").alias("of_set"), F.col("c").alias("group"), "component_id")
    out = base.join(ids, (F.col("set_id") == F.col("of_set")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row_key", "group")
