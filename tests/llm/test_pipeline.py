"""The pipeline against plain versions of its stages, and whether the rest stands without it."""

import subprocess
import sys

import pytest
from support import TINY
from pyspark.sql import functions as F
from test_brute_force import groups

from gristmill.llm import mixing, packing, pii, queries
from gristmill.llm._common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark):
    docs = table(spark, TINY, "documents")
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, TINY).where("kept").collect()}
    one = corpus_pipeline.quality(spark, docs, TINY)
    assert {r.doc_id for r in one.collect()} == kept and one.columns == docs.columns
    root, _ = groups({r.doc_id: r.text or "" for r in one.collect()}, 5, 80)
    two = corpus_pipeline.near_duplicates(spark, one, TINY).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, r in root.items() if i == r)
    three = corpus_pipeline.private_data(spark, two, TINY).cache()
    want = {r.doc_id: r.text for r in pii.pseudonymise(two, queries.KNOWN_KEY).collect()}
    assert {r.doc_id: r.text for r in three.collect()} == want
    four = corpus_pipeline.mixture(spark, three, TINY).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(three).collect() if r.taken}
    assert {r.doc_id: r.n for r in four.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()} == taken
    enc = packing.encoder(packing.default_vocabulary())
    tokens = sorted((r.doc_id, len(enc.encode(r.text)) // 4 + 1) for r in four.collect())
    out = corpus_pipeline.run(spark, TINY).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {i: sum(n for j, n in tokens if j == i) for i in {j for j, _ in tokens}}
    assert (out.groupby("sequence_id").length.sum() <= packing.CAPACITY).all()


def test_the_rest_stands_alone(tmp_path):
    """A copy without this package and the pipeline still imports and lists its queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/gristmill", tmp_path / "gristmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op')] and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=False).returncode == 0
