"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class without its brackets.
SPACE = r" \t-\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share. Where spark.checkpoint.dir is unset, one is made here if all runs on this machine, as
    in tests; elsewhere executors would write to folders of their own, so that is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and sc.getCheckpointDir() is None and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gristmill-"))
    return (where or sc.getCheckpointDir()).rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage by files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, on whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in a folder of their own below the shared one, each deleted as soon as it has been superseded."""

    def __init__(self, spark: SparkSession, kind: str):
        self.spark, self.path, self.count = spark, fresh_dir(spark, kind), 0

    def next(self) -> int:
        self.count += 1
        return self.count

    def save(self, df: DataFrame) -> DataFrame:
        """df, computed once and read from its files."""
        path = f"{self.path}/{self.next()}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that save returned and nothing reads any more."""
        for table in tables:
            remove_dir(self.spark, table._scratch_path)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda's variable, unlike a projected column, is never inlined twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def in_fold(doc_id: Column, folds: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder `held`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == held


# What follows runs in Python workers.


def worker_state() -> dict:
    """A dict that lives as long as its Python worker, whichever task made it."""
    import sys
    import types

    return sys.modules.setdefault("_gristmill_worker", types.ModuleType("_gristmill_worker")).__dict__


class WordHashes(dict):
    """Bytes -> 64-bit hash. Remembers up to `most` words; the rest are hashed each time."""

    most = 150_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def give_back() -> None:
    """Freed memory goes back to the system, so that workers that wait for their next task keep little."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def token_chunks(batches, columns, most_tokens: int = 2_000_000, most_texts: int = 20_000):
    """Arrow batches (columns and text) -> (values of the columns as lists, lists of each text's word hashes as one
    uint64 array, offsets). Texts are whole; words are split at ASCII white space after A-Z is lower-cased; a null text
    has none. A chunk ends with the text that reaches most_tokens, or with that number of texts."""
    import numpy as np

    state = worker_state()
    hashes = state.setdefault("word_hashes", WordHashes())
    get = hashes.__getitem__
    kept, arrays, ends, total = [], [], [0], 0
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        rows = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)) if columns else [()] * batch.num_rows
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            arrays.append(np.fromiter(map(get, ws), np.uint64, len(ws)))
            kept.append(rows[i])
            total += len(ws)
            ends.append(total)
            if total >= most_tokens or len(kept) >= most_texts:
                yield kept, np.concatenate(arrays), np.array(ends, np.int64)
                kept, arrays, ends, total = [], [], [0], 0
    if kept:
        yield kept, np.concatenate(arrays), np.array(ends, np.int64)
    kept = arrays = ends = None
    give_back()


def mixed(h):
    """A bijection of uint64 arrays that spreads every bit."""
    import numpy as np

    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


# Arrays in the shared folder.


def local_path(path: str) -> str | None:
    return path if path.startswith("/") else path[len("file:") :].replace("//", "/", 1) if path.startswith("file:/") else None


def write_arrays(path: str, name: str, arrays: dict) -> None:
    """Each of the NumPy arrays as a file name.key, moved into place when complete."""
    import numpy as np
    from pyarrow import fs

    local = local_path(path)
    store, root = (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    for key, values in arrays.items():
        draft = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
        store.move(draft, f"{root}/{name}.{key}")


def read_array(path: str, name: str, kind: str):
    """The array in a file: mapped into memory where the folder is local or mounted, else read."""
    import numpy as np

    local = local_path(path)
    if local:
        import os

        return np.memmap(f"{local}/{name}", kind, "r") if os.path.getsize(f"{local}/{name}") else np.empty(0, kind)
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def ranges_for(spark: SparkSession, n: int, each: int) -> int:
    """How many ranges hold about `each` of n things; no fewer than there are shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def in_range(hashes, ranges: int):
    """The range of each hash; ranges follow the order of the hashes."""
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class IdSet:
    """A set of 64-bit ids of any size in the shared folder: sorted arrays by ranges of the ids' hashes, which workers
    map into memory and search. It lets rows be chosen by id where they are read, without shuffling their texts."""

    def __init__(self, ids: DataFrame):
        """ids: one column of longs; nulls are told by `with_null`."""
        column, spark = ids.columns[0], ids.sparkSession
        self.path, self.ranges = fresh_dir(spark, "ids"), ranges_for(spark, ids.count(), 500_000)
        path, ranges = self.path, self.ranges

        def dealt(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                x = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                pid = np.where(valid, in_range(mixed(x.view(np.uint64)), ranges), ranges)
                yield pa.RecordBatch.from_arrays([pa.array(pid.astype(np.int32)), pa.array(x)], names=["pid", "id"])

        def write(batches):
            import numpy as np
            import pyarrow as pa

            pids, parts = set(), []
            for batch in batches:
                if batch.num_rows:
                    pids |= set(batch.column(0).unique().to_pylist())
                    parts.append(batch.column(1).to_numpy())
            if len(pids) > 1:
                raise ValueError(f"ranges {sorted(pids)} in one partition")
            if parts and min(pids) < ranges:
                write_arrays(path, f"ids-{min(pids)}", {"id": np.unique(np.concatenate(parts))})
            yield pa.RecordBatch.from_arrays([pa.array(sorted(pids), pa.int32())], names=["pid"])

        some = ids.select(F.col(column).cast("long").alias("id")).mapInArrow(dealt, "pid int, id long")
        # the ranges that hold ids: a file that is missing later is an error and not an empty range
        self.filled = frozenset(r["pid"] for r in some.repartitionById(ranges + 1, F.col("pid")).mapInArrow(write, "pid int").collect())
        self.with_null = ranges in self.filled

    def drop(self) -> None:
        """Deletes the files, once no plan needs them."""
        from pyspark.sql import SparkSession as Session

        remove_dir(Session.active(), self.path)


def members(id_set: IdSet, ids, with_null: bool):
    """Which of an Arrow array of ids are in the set; for workers."""
    import numpy as np

    path, ranges, filled = id_set.path, id_set.ranges, id_set.filled
    maps = worker_state().setdefault("id_sets", {})
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    x = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    pid = in_range(mixed(x.view(np.uint64)), ranges)
    hit = np.zeros(len(x), bool)
    for p in np.unique(pid):
        if (path, p) not in maps:
            maps[path, p] = read_array(path, f"ids-{p}.id", "i8") if p in filled else np.empty(0, np.int64)
        there, at = maps[path, p], np.flatnonzero(pid == p)
        if len(there):
            k = np.minimum(np.searchsorted(there, x[at]), len(there) - 1)
            hit[at] = there[k] == x[at]
    return np.where(valid, hit, with_null)


def chosen(rows: DataFrame, ids: IdSet, inside: bool, key: Column) -> DataFrame:
    """The rows whose key is in the set, or is not; rows without a key count as outside."""
    name = "_key"
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = members(ids, batch.column(batch.num_columns - 1), False)
            yield batch.filter(pa.array(keep if inside else ~keep)).select(batch.schema.names[:-1])

    return rows.select("*", key.cast("long").alias(name)).mapInArrow(run, rows.schema)
