"""Hard negatives by product quantisation with residual bounds.

A vector of integers is cut into pieces of two components; each piece is replaced by the nearest of 256 integer
codewords, fitted on a bounded sample, so a vector v becomes a byte a piece plus the length of what is left over,
|v - q|, rounded up. For an anchor a, the sum of table look-ups <a, q> is an exact integer, and by Cauchy-Schwarz

    <a, q> - |a| |v - q|  <=  <a, v>  <=  <a, q> + |a| |v - q|

holds whatever the sample was. A positive's window asks for the first few rows of another label with scores between
two limits: rows whose upper bound is below the lower limit, or whose lower bound is above the upper one, are out; of
those that are certainly inside, the third-best lower bound is a threshold that all others must reach. What remains is
scored exactly in integers. The same filter finds the positives.

Codes lie beside their vectors in a table of the shared folder, and neither is sent anywhere: each task scans its rows
in pieces and lets the anchors pass by, in blocks that tasks have written to the shared folder and that workers map. A
task returns a few rows for each anchor, merged by a window per anchor. The stated anchors meet all rows, as the result
is exact; what the codes save is most of the exact scores. No label is gathered anywhere, so a label that a third of all
rows have is like any other.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; nor do null ids and
vectors with a length of more than about 1,100,000, whose scores a long couldn't hold. Of several rows under one id the
smallest (label, vector) counts. Vectors of different dimensions are never compared. Equal scores go to the smaller id.
A dimension that the sample lacks has codes without words: all of the vector is left over, and its rows are scored. An
anchor without other rows of its label, or without rows in a window, has no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import Scratch, fresh_dir, read_array, remove_dir
from gristmill.llm._vectors import first_by_hash, in_pieces, integers, matrix, sound, up, write_blocks

PIECE, WORDS = 2, 256
CODED = "vec_id long, label long, dim int, vector array<long>, code binary, rest double"


def pieces(dim: int) -> list[slice]:
    return [slice(i, min(i + PIECE, dim)) for i in range(0, dim, PIECE)]


def fit_words(x: np.ndarray, seed: int = 13, rounds: int = 8) -> list[np.ndarray]:
    """Integer codewords of each piece, at most 256, by a few rounds of k-means on the sample's rows."""
    rng, out = np.random.default_rng(seed), []
    for at in pieces(x.shape[1]):
        part = np.unique(x[:, at], axis=0)
        words = part[np.sort(rng.permutation(len(part))[:WORDS])].astype(float)
        weight_of = x[:, at].astype(float)
        for _ in range(rounds if len(part) > WORDS else 0):
            own = _nearest(weight_of, words)
            n = np.bincount(own, minlength=len(words))
            for j in range(words.shape[1]):
                words[:, j] = np.where(n > 0, np.bincount(own, weight_of[:, j], len(words)) / np.maximum(n, 1), words[:, j])
        out.append(np.rint(words).astype(np.int64))
    return out


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row the number of a nearest word; rounding may settle near ties either way, which no bound minds."""
    w = words.astype(float)
    own, squares = np.empty(len(x), np.int64), (w * w).sum(1)
    for i in range(0, len(x), 8192):
        own[i : i + 8192] = (squares - 2 * (x[i : i + 8192].astype(float) @ w.T)).argmin(1)
    return own


def encode(x: np.ndarray, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (a byte a piece), and an upper bound on the length of what they leave over."""
    codes, left = np.zeros((len(x), len(words)), np.uint8), np.zeros(len(x), np.int64)
    for j, (at, w) in enumerate(zip(pieces(x.shape[1]), words, strict=True)):
        own = _nearest(x[:, at], w)
        codes[:, j] = own
        d = x[:, at] - w[own]
        left += (d * d).sum(1)
    return codes, np.where(left > 0, up(np.sqrt(left.astype(float))), 0.0)


def looked_up(anchors: np.ndarray, codes: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """<a, q> of each row (first axis) and anchor (second), from tables of each anchor's products with all words."""
    total = np.zeros((len(codes), len(anchors)), np.int64)
    for j, (at, w) in enumerate(zip(pieces(anchors.shape[1]), words, strict=True)):
        total += (w @ anchors[:, at].T)[codes[:, j]]
    return total


def best_within(low: np.ndarray, high: np.ndarray, least: int | None, most: int | None, k: int) -> np.ndarray:
    """Which rows may be among the k best with scores between least and most (None: no limit), given bounds."""
    fits, sure = np.ones(len(low), bool), np.ones(len(low), bool)
    if least is not None:
        fits &= high >= least
        sure &= low >= least
    if most is not None:
        fits &= low <= most
        sure &= high <= most
    certain = low[sure]
    if len(certain) >= k:
        fits &= high >= np.partition(certain, len(certain) - k)[len(certain) - k]
    return np.flatnonzero(fits)


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, label, vector (integers), dim of the rows that take part, once each."""
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(column) & (F.size(column) > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(column).alias("vector"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return one.select("vec_id", "r.label", "r.vector", F.size("r.vector").alias("dim"))


def index(rows: DataFrame, most: int = 20_000, seed: int = 13) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Every row with its codes, and the codewords of each dimension; fitted on at most `most` rows."""
    sample: dict[int, list] = {}
    for r in first_by_hash(rows.select("vec_id", "vector"), most, seed).collect():
        sample.setdefault(len(r["vector"]), []).append(r["vector"])
    words = {d: fit_words(np.array(x, np.int64), seed) for d, x in sample.items()}

    def run(batches):
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                x = matrix(own.column(2), int(d))
                if d in words:
                    codes, rest = encode(x, words[d])
                else:
                    codes, rest = np.zeros((len(x), 0), np.uint8), up(np.sqrt((x * x).sum(1).astype(float)))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(3), own.column(2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)],
                    names=["vec_id", "label", "dim", "vector", "code", "rest"],
                )

    return rows.select("vec_id", "label", "vector", "dim").mapInArrow(run, CODED), words


def _arrays_of(block: pa.Table, dim: int) -> dict[str, np.ndarray]:
    """Anchors (vec_id, label, vector, limits array<long>: pairs of least and most)."""
    limits = block["limits"].to_pylist()
    arrays = {"id": block["vec_id"].to_numpy(), "label": block["label"].to_numpy(), "vector": matrix(block["vector"], dim).ravel(), "limit": np.array([v for x in limits for v in x]), "end": np.cumsum([len(x) for x in limits])}
    return {k: v.astype(np.int64) for k, v in arrays.items()}


def _passed_by(coded: DataFrame, words: dict, anchors: DataFrame, choose, kind: str, chunk: int, per_block: int, per_pass: int = 64) -> tuple[DataFrame, str]:
    """Lets all anchors pass by each task's rows. choose(label, limits, labels, low, high, exact, ids, anchor id) gives
    (slot, row, score) arrays for one anchor -> anchor_id, slot, vec_id, score."""
    spark = coded.sparkSession
    path = fresh_dir(spark, kind)
    blocks = write_blocks(anchors, path, per_block, _arrays_of)

    def scan(table: pa.Table):
        for d in np.unique(table["dim"].to_numpy()):
            own = table.filter(pa.array(table["dim"].to_numpy() == d))
            d = int(d)
            x, ids, labels, rest = matrix(own["vector"], d), own["vec_id"].to_numpy(), own["label"].to_numpy(), own["rest"].to_numpy()
            book = words.get(d, [])
            codes = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(x), len(book))
            for dim, name in blocks:
                if dim != d:
                    continue
                aid, alabel, vectors, limit, end = (read_array(path, f"{name}.{k}", "i8") for k in ("id", "label", "vector", "limit", "end"))
                vectors = np.asarray(vectors).reshape(-1, d)
                begin = np.concatenate([[0], end[:-1]]).astype(np.int64)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for i in range(0, len(aid), per_pass):
                    a = vectors[i : i + per_pass]
                    length = up(np.sqrt((a * a).sum(1).astype(float)))
                    est = looked_up(a, codes, book) if book else np.zeros((len(x), len(a)), np.int64)
                    for j in range(len(a)):
                        off = np.where(rest > 0, np.ceil(up(rest * length[j])), 0).astype(np.int64)
                        score = np.ascontiguousarray(est[:, j])
                        exact = lambda rows, v=a[j]: x[rows] @ v
                        slot, row, s = choose(alabel[i + j], limit[begin[i + j] : end[i + j]], labels, score - off, score + off, exact, ids, aid[i + j])
                        for o, v in zip(out, (np.full(len(row), aid[i + j]), slot, ids[row], s), strict=True):
                            o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(t)) for o, t in zip(out, (np.int64, np.int32, np.int64, np.int64), strict=True)], names=["anchor_id", "slot", "vec_id", "score"])

    return coded.mapInArrow(in_pieces(scan, chunk), "anchor_id long, slot int, vec_id long, score long"), path


def _positives(k: int):
    none = np.empty(0, np.int64)

    def choose(label, limits, labels, low, high, exact, ids, own):
        same = np.flatnonzero((labels == label) & (ids != own))
        rows = same[best_within(low[same], high[same], None, None, k)]
        if not len(rows):
            return none, none, none
        score = exact(rows)
        first = first_k(score, ids[rows], k)
        return np.zeros(len(first), np.int64), rows[first], score[first]

    return choose


def _negatives(k: int):
    def choose(label, limits, labels, low, high, exact, ids, own):
        slots, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(limits):
            other = np.flatnonzero((labels != label) & (high >= limits[::2].min()) & (low <= limits[1::2].max()))
            for s in range(len(limits) // 2):
                least, most = limits[2 * s], limits[2 * s + 1]
                rows = other[best_within(low[other], high[other], least, most, k)] if least <= most else other[:0]
                if len(rows):
                    score = exact(rows)
                    inside = (score >= least) & (score <= most)
                    rows, score = rows[inside], score[inside]
                    first = first_k(score, ids[rows], k)
                    slots.append(np.full(len(first), s))
                    found.append(rows[first])
                    scores.append(score[first])
        return np.concatenate(slots), np.concatenate(found), np.concatenate(scores)

    return choose


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, column: str = "embedding", chunk: int = 32_768, per_block: int = 8_192) -> DataFrame:
    """vectors (vec_id, label, a vector) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each row for which is_anchor (over vec_id) holds and each of its first `positives` rows of the same label by integer
    inner product, the first `negatives` rows of another label whose score is `least` to `most` hundredths of the
    positive's."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    rows = scratch.save(usable(vectors, column))
    coded, words = index(rows)
    coded = scratch.save(coded)
    scratch.drop(rows)
    anchors = coded.where(is_anchor).select("vec_id", "label", "dim", "vector")
    first = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id")
    near, at_first = _passed_by(coded, words, anchors.withColumn("limits", F.array().cast("array<long>")), _positives(positives), "anchors", chunk, per_block)
    found = scratch.save(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives).select("anchor_id", F.col("rank").alias("p"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    remove_dir(vectors.sparkSession, at_first)
    # least <= 100 n / p <= most in integers: n from the ceiling of least * p / 100 to the floor of most * p / 100
    hundredth = lambda times: F.floor(F.lit(times).cast("decimal(3,0)") * F.col("positive_score").cast("decimal(20,0)") / 100)
    window = F.struct("p", (-hundredth(-least)).cast("long").alias("least"), hundredth(most).cast("long").alias("most"))
    limits = found.groupBy("anchor_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(window)), lambda w: F.array(w["least"], w["most"]))).alias("limits"))
    met = anchors.join(limits, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    hard, _ = _passed_by(coded, words, met, _negatives(negatives), "windows", chunk, per_block)
    ranked = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    out = ranked.select(F.col("anchor_id").alias("of"), (F.col("slot") + 1).alias("p_of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(found, (F.col("of") == F.col("anchor_id")) & (F.col("p_of") == F.col("p"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
