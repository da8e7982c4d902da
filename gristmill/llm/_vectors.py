"""Vectors as integers: what clustering and mining share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._common import write_arrays

#: Squared lengths of integer vectors stay below this, so that 100 inner products, and squared distances, fit a long.
MOST_SQUARED = 8e16


def integers(column: str = "embedding") -> Column:
    """floor(256 * x) of every component, x as double."""
    return F.transform(F.col(column).cast("array<double>"), lambda x: F.floor(x * 256).cast("long"))


def sound(column: str = "embedding") -> Column:
    """Whether a vector is there, has no null or non-finite component, and no length whose square (in 256ths) is beyond
    MOST_SQUARED: a long couldn't hold its distances."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1.2e6))
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.pow(F.coalesce(x, F.lit(0.0)) * 256, F.lit(2.0)))
    return F.coalesce(F.col(column).isNotNull() & fine & (squares <= MOST_SQUARED), F.lit(False))


def up(x: np.ndarray) -> np.ndarray:
    """The next larger double: what is rounded to nearest becomes an upper bound."""
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def matrix(column, dim: int, kind=np.int64) -> np.ndarray:
    """An Arrow list column of equal lengths as rows."""
    flat = column.combine_chunks().flatten() if hasattr(column, "combine_chunks") else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


def first_by_hash(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows, those first by a hash of vec_id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(most)


def write_blocks(rows: DataFrame, path: str, per_block: int, arrays_of) -> list[tuple[int, str]]:
    """rows (vec_id, dim, ...) as arrays in the shared folder, in blocks of about per_block rows of one dimension each
    -> (dimension, name) of each block. arrays_of(Arrow table, dimension) gives a block's arrays by name."""
    blocks = max(1, -(-rows.count() // per_block))

    def write(batches):
        table, made = list(batches), []
        if table:
            table = pa.Table.from_batches(table)
            bid, dims = table["block"].to_numpy(), table["dim"].to_numpy()
            for b, d in sorted({*zip(bid.tolist(), dims.tolist(), strict=True)}):
                write_arrays(path, f"{b}-{d}", arrays_of(table.filter(pa.array((bid == b) & (dims == d))), d))
                made.append((d, f"{b}-{d}"))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.string())], names=["dim", "name"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    return sorted((r["dim"], r["name"]) for r in dealt.mapInArrow(write, "dim int, name string").collect())


def in_pieces(scan, chunk: int):
    """For mapInArrow: scan(table) over about `chunk` rows at a time."""

    def run(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield from scan(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            yield from scan(pa.Table.from_batches(kept))

    return run
