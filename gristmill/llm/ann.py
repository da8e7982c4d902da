"""Nearest neighbours by randomly rotated one-bit codes.

A vector is brought to length 1, rotated by a fixed random rotation, and kept as the signs of its components, packed
into bits, with one scalar f = <sign vector / sqrt(d), rotated vector>. For a query q (rotated, length 1) with
s = <sign vector / sqrt(d), q>, the cosine is estimated without bias as s / f, and the error of the estimate is beyond

    bound = eps * sqrt((1 - f^2) / f^2) / sqrt(d - 1)

with a chance that falls exponentially in eps^2. The vectors with the largest estimates are measured first; the k-th
best of these is a threshold, and the vectors whose upper bound reaches it are measured as well, exactly, in double
precision on the original vectors. README has the share that is measured and the recall.

Codes lie beside their vectors in a table of the shared folder, computed once, and neither is sent anywhere: tasks write
the queries' vectors to the shared folder in blocks, and each task lets them pass by its rows, a piece of the table at a
time, and returns the k best of each query for each piece. A vector that fills a third of the table is spread like any
other. All of a piece's rows are estimated for every query, as there are no lists of cells, so work grows with queries
times vectors; doubles are touched for the rows that are measured only.

Defined cases: null vectors, those with null or non-finite components and those of length 0 take no part; vectors of
other dimensions are never compared; equal scores go to the smaller id; rows with the query's own id are not its
candidates; of different vectors under one id the smallest in order counts; a null id takes no part; other columns are ignored. Lengths
of any size are fine: vectors are brought to length 1 by their largest component first, so no product overflows or vanishes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm._common import Scratch, fresh_dir, read_array, worker_state
from gristmill.llm._vectors import in_pieces, matrix, write_blocks

#: With it a neighbour is passed over in about 1 of 35 cases, if errors are normal and nothing else measures it.
EPS = 1.9
CODED = "vec_id long, dim int, vector array<double>, code binary, f double"


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, uniform among rotations and reflections."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _rotations(dim: int, seed: int) -> np.ndarray:
    made = worker_state().setdefault("rotations", {})
    if (dim, seed) not in made:
        made[dim, seed] = rotation(dim, seed)
    return made[dim, seed]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles), dim, of the rows that take part, once each."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return v.where(fine & some).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def normalised(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and f of each row."""
    turned = normalised(vectors) @ turn.T
    up = turned > 0
    return np.packbits(up, axis=1), np.where(up, turned, -turned).sum(1) / np.sqrt(vectors.shape[1])


def index(vectors: DataFrame, seed: int = 7) -> DataFrame:
    """Every row's code; nothing is fitted."""

    def run(batches):
        for batch in batches:
            ids, dims, flat = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x = flat.take(pa.array(rows)).flatten().to_numpy().reshape(-1, d)
                code, f = encode(x, _rotations(int(d), seed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(dims[rows], pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), int(d)).cast(pa.list_(pa.float64())), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(f)],
                    names=["vec_id", "dim", "vector", "code", "f"],
                )

    return usable(vectors).select("vec_id", "dim", "vector").mapInArrow(run, CODED)


def search_block(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, f: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, eps: float, seed: int, ahead: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best of each query among one block's vectors: query index, vector index, cosine; and how many vectors were
    measured. ahead: times k vectors are measured to find the threshold."""
    n, dim = x.shape
    unit = normalised(q)
    turned = unit @ _rotations(dim, seed).T
    error = eps * np.sqrt(np.maximum(0, 1 - f * f)) / np.maximum(f, 1e-12) / np.sqrt(max(1, dim - 1))
    # signs as a table look-up per byte: sum over bytes of the query's partial sums for the byte's 256 sign patterns
    patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
    width = bits.shape[1]
    out: list[tuple] = []
    measured = 0
    for i in range(len(qids)):
        padded = np.zeros(width * 8)
        padded[:dim] = turned[i]
        tables = patterns @ padded.reshape(width, 8).T  # 256 x bytes
        estimate = np.zeros(n)
        for b in range(width):
            estimate += tables[bits[:, b], b]
        estimate /= np.sqrt(dim) * np.maximum(f, 1e-12)
        estimate[ids == qids[i]] = -np.inf
        others = ids != qids[i]
        n_others = int(others.sum())
        if not n_others:
            continue
        exact = lambda rows: np.clip(normalised(x[rows]) @ unit[i], -1, 1)  # noqa: B023, E731
        first = min(ahead * k, n_others)
        top = np.argpartition(estimate, n - first)[n - first :]
        some = exact(top)
        kth = np.partition(some, max(0, first - k))[max(0, first - k)] if first >= k else -np.inf
        reach = (estimate + error >= kth) & others
        reach[top] = False
        more = np.flatnonzero(reach)
        measured += first + len(more)
        rows, score = np.concatenate([top, more]), np.concatenate([some, exact(more)])
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), i), rows[best], score[best]))
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), measured) if out else (np.empty(0, int), np.empty(0, int), np.empty(0), 0)


def search(vectors: DataFrame, is_query: Column, k: int = 5, eps: float = EPS, chunk: int = 8192, per_block: int = 8192, seed: int = 7) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest by cosine of each row for which
    is_query (over vec_id) holds, among all rows but its own. chunk: rows that meet a query at once; per_block: queries
    in a file."""
    spark = vectors.sparkSession
    coded = Scratch(spark, "ann").save(index(vectors, seed))
    path = fresh_dir(spark, "queries")
    blocks = write_blocks(coded.where(is_query).select("vec_id", "dim", "vector"), path, per_block, lambda t, d: {"id": t["vec_id"].to_numpy(), "vector": matrix(t["vector"], d, np.float64).ravel()})

    def scan(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for d in np.unique(rows["dim"].to_numpy()).tolist():
            own = rows.filter(pa.array(rows["dim"].to_numpy() == d))
            ids, x, f = own["vec_id"].to_numpy(), matrix(own["vector"], d, np.float64), own["f"].to_numpy()
            bits = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            for dim, name in blocks:
                if dim == d:
                    qids, q = read_array(path, f"{name}.id", "i8"), np.asarray(read_array(path, f"{name}.vector", "f8")).reshape(-1, d)
                    i, j, s, _ = search_block(ids, x, bits, f, qids, q, k, eps, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(qids)[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    near = coded.mapInArrow(in_pieces(scan, chunk), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
