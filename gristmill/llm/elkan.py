"""k-means on integer vectors, with Elkan's bounds.

Each vector carries its cluster, an upper bound on the distance to that cluster's centroid, and a lower bound on the
distance to every centroid. A round moves the bounds by how far the centroids went, and then measures a distance only
where they leave something open: a vector stays unmeasured if its upper bound is below half the distance from its
centroid to the nearest other one, and a centroid is skipped if the upper bound is below its lower bound, or below half
the distance between the two centroids. All three tests are strict and all bounds are rounded outwards (square roots
and sums to the next double, kept lower bounds down to the next float), so a centroid that ties is always measured, in
integers, and the smaller number wins. What is returned is exact.

Vectors never move between machines. A round is one scan that writes vectors with their bounds to the shared folder,
from where the next reads them, so a lost executor costs tasks of one round; and one aggregate of exact sums, at most a
row for each cluster and task. The driver holds the centroids alone (k times 64 integers).

Defined cases: vectors that are null, have other than `dim` components, or null or non-finite ones, are left out; so are
those with a length of more than about 1,100,000, whose squared distances a long couldn't hold. Repeated rows are vectors
of their own; a null id is kept and comes last when centroids are chosen; equal hashes are ordered by the components. With
fewer than k vectors each is a centroid; without any the result is empty. An inertia that doesn't fit a long is null.
Columns other than vec_id and the vector are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import Scratch
from gristmill.llm._vectors import down, integers, matrix, sound, up

STATE = "vec_id long, vector array<long>, cluster int, distance long, upper double, lower binary, measured long"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def between(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the distance of each two centroids, and of each to the nearest other one, rounded down."""
    half = np.stack([down(np.sqrt(squared(centroids, c).astype(float))) for c in centroids]) / 2
    alone = half + np.diag(np.full(len(half), np.inf))
    return np.maximum(half, 0), np.maximum(alone.min(1), 0)


def moved(upper: np.ndarray, lower: np.ndarray, cluster: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds once centroids have gone from old to new."""
    far = np.sqrt(squared(new, old).astype(float))
    most = np.where(far > 0, up(far), 0)
    return np.where(most[cluster] > 0, up(upper + most[cluster]), upper), np.maximum(down(lower - most), 0)


def floats_below(x: np.ndarray) -> np.ndarray:
    """The largest floats that are not above the doubles."""
    f = x.astype(np.float32)
    return np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, exact squared distance (-1 where it wasn't measured), bounds, and how many distances were measured, of
    each row. fresh: there is no assignment yet."""
    half, nearest = between(centroids)
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    distance, measured = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)

    def measure(rows: np.ndarray, to) -> np.ndarray:
        d = squared(x[rows], centroids[to])
        measured[rows] += 1
        lower[rows, to] = np.maximum(down(np.sqrt(d.astype(float))), 0)
        return d

    open_ = np.arange(len(x)) if fresh else np.flatnonzero(upper >= nearest[cluster])
    stale = np.ones(len(x), bool)
    for c in range(len(centroids)):
        beyond = (upper[open_] >= lower[open_, c]) & (upper[open_] >= half[cluster[open_], c])
        rows = open_[beyond & (cluster[open_] != c)]
        old = rows[stale[rows]]
        if len(old):  # the upper bound is made exact before a second look
            distance[old] = measure(old, cluster[old])
            upper[old] = up(np.sqrt(distance[old].astype(float)))
            stale[old] = False
            rows = rows[(upper[rows] >= lower[rows, c]) & (upper[rows] >= half[cluster[rows], c])]
        if len(rows):
            d = measure(rows, c)
            better = (d < distance[rows]) | (d == distance[rows]) & (c < cluster[rows])
            won = rows[better]
            cluster[won], distance[won] = c, d[better]
            upper[won] = up(np.sqrt(d[better].astype(float)))
    return cluster, distance, upper, lower, measured


def _batches(batches, columns):
    """Batches without empty ones, as columns."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(c)) for c in columns]


def _first(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, dim = centroids.shape

    def run(batches):
        for ids, vectors in _batches(batches, ("vec_id", "vector")):
            x = matrix(vectors, dim)
            n = len(x)
            yield _written(ids, vectors, *assign(x, centroids, np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k)), True))

    return rows.mapInArrow(run, STATE)


def _written(ids, vectors, cluster, distance, upper, lower, measured) -> pa.RecordBatch:
    kept = [r.tobytes() for r in floats_below(lower)]
    return pa.RecordBatch.from_arrays(
        [ids, vectors, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(upper), pa.array(kept, pa.binary()), pa.array(measured)],
        names=["vec_id", "vector", "cluster", "distance", "upper", "lower", "measured"],
    )


def _next(state: DataFrame, old: np.ndarray, new: np.ndarray, last: bool) -> DataFrame:
    k, dim = new.shape

    def run(batches):
        for ids, vectors, cluster, upper, lower, measured in _batches(batches, ("vec_id", "vector", "cluster", "upper", "lower", "measured")):
            x, was = matrix(vectors, dim), cluster.to_numpy().astype(np.int64)
            bounds = np.frombuffer(b"".join(lower.to_pylist()), np.float32).reshape(-1, k).astype(float)
            high, low = moved(upper.to_numpy(), bounds, was, old, new)
            found, distance, high, low, more = assign(x, new, was, high, low, False)
            if last and len(open_ := np.flatnonzero(distance < 0)):
                distance[open_] = squared(x[open_], new[found[open_]])
            yield _written(ids, vectors, found, distance, high, low, measured.to_numpy() + more)

    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Count and exact componentwise sums of each cluster that has vectors."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for cluster, vectors in _batches(batches, ("cluster", "vector")):
            at, x = cluster.to_numpy(), matrix(vectors, dim)
            for c in np.unique(at):
                own = x[at == c]
                sums[int(c)] = sums.get(int(c), 0) + np.concatenate([[len(own)], own.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = state.select("cluster", "vector").mapInArrow(run, "cluster int, sums array<long>")
    total = parts.groupBy("cluster").agg(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim + 1)))
    return {r[0]: (int(r[1]), [int(v) for v in r[2:]]) for r in total.collect()}


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dim: int = 64, column: str = "embedding") -> DataFrame:
    """vectors (vec_id, a vector) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, measured.

    Centroids start as the k vectors whose ids come first by the SHA-256 of "salt:id"; each round assigns every vector
    to the nearest and puts the floor of the mean in its place, empty clusters excepted; then vectors are assigned once
    more. measured: how many distances the bounds left to be measured for this vector, of k * (rounds + 1)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "elkan")
    kept = vectors.where(sound(column) & (F.size(column) == dim)).select(F.col("vec_id").cast("long").alias("vec_id"), integers(column).alias("vector"))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()
    if not chosen:
        return kept.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256", "0L as measured")
    centroids = np.array([r["vector"] for r in chosen], np.int64)
    state = scratch.save(_first(kept, centroids))
    for i in range(rounds):
        moved_to = centroids.copy()
        for c, (n, sums) in _sums(state, dim).items():
            moved_to[c] = [s // n for s in sums]
        after = scratch.save(_next(state, centroids, moved_to, i == rounds - 1))
        scratch.drop(state)
        state, centroids = after, moved_to
    if not rounds:
        state = scratch.save(_next(state, centroids, centroids, True))
    per = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    fits = lambda s: int(s) if s is not None and s < 2**63 else None
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)
    return state.select(
        "vec_id", "cluster", "distance",
        of([fits(per.get(c)) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(per.values()))).cast("long").alias("inertia"),
        of(digests, "string").alias("centroid_sha256"),
        "measured",
    )
