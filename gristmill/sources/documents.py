"""Documents written whole or not at all, and logs to which each batch is appended once.

All go through the file system of their path, so they may lie on any store that Spark reaches."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, store, draft, to, overwrite: bool) -> None:
    """draft at its place in one step; an error if something is there already, unless overwrite."""
    jvm = spark.sparkContext._jvm
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.OVERWRITE if overwrite else kinds.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(store.makeQualified(draft), store.makeQualified(to), options)


def write_document(spark: SparkSession, path: str, text: str) -> None:
    """A small document, written beside its place, flushed, and moved there in one step; whoever stops before that leaves
    the old document as it was."""
    fs, store = _store(spark, path)
    draft = fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    _moved(spark, store, draft, fs.Path(path), True)


def read_document(spark: SparkSession, path: str) -> str | None:
    fs, store = _store(spark, path)
    at = fs.Path(path)
    if not store.exists(at):
        return None
    source = store.open(at)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_rows(rows: DataFrame, folder: str) -> str:
    """Rows of any number as JSON lines in a version of their own; a document names the version that counts, and is
    moved in place when all tasks have committed. Readers see the old version or the new one. Returns the version."""
    version = uuid.uuid4().hex
    rows.write.json(f"{folder}/{version}")
    write_document(rows.sparkSession, f"{folder}/current", version)
    return version


def read_rows(spark: SparkSession, folder: str, schema) -> DataFrame:
    version = read_document(spark, f"{folder}/current")
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/{version}")


def append_batch(rows: DataFrame, folder: str, batch: int) -> bool:
    """Appends a batch to a log as JSON lines, once: a batch that has been committed is left as it is (False). A batch that
    was cut off before its commit is written anew; its earlier attempt is never read."""
    spark = rows.sparkSession
    fs, store = _store(spark, folder)
    mark = f"{folder}/commits/{batch:020d}"
    if store.exists(fs.Path(mark)):
        return False
    attempt = uuid.uuid4().hex
    rows.write.json(f"{folder}/rows/{attempt}")
    # one attempt wins: only one can create the mark, and it names the attempt
    draft = fs.Path(f"{folder}/drafts/{attempt}")
    out = store.create(draft, True)
    out.write(bytearray(attempt.encode()))
    out.close()
    store.mkdirs(fs.Path(f"{folder}/commits"))
    try:
        _moved(spark, store, draft, fs.Path(mark), False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def read_log(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All committed batches, with their number."""
    fs, store = _store(spark, folder)
    at = fs.Path(f"{folder}/commits")
    marks = [s.getPath().toString() for s in store.listStatus(at) if s.isFile()] if store.exists(at) else []
    named = sorted((int(m.rsplit("/", 1)[1]), read_document(spark, m)) for m in marks if m.rsplit("/", 1)[1].isdigit())
    if not named:
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    read = spark.read.schema(schema).json([f"{folder}/rows/{attempt}" for _, attempt in named])
    numbers = F.create_map(*(x for n, attempt in named for x in (F.lit(attempt), F.lit(n).cast("long"))))
    return read.withColumn("batch", F.element_at(numbers, F.regexp_extract(F.input_file_name(), "/rows/([0-9a-f]{32})/", 1)))
