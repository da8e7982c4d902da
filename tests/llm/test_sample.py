"""What training samples must hold."""

from gristmill.llm import toxicity


def test_rare_toxic_word(spark):
    """A word in 6 of 8,000 labelled documents, half of which would hold about 3, fewer than a feature needs."""
    toxic = [f"you are a moron {i} sir" for i in range(874)] + [f"that zorgle {i} again" for i in range(6)]
    rows = [(i, t, int(i < len(toxic))) for i, t in enumerate(toxic + [f"the fine day number {i} is long" for i in range(8000 - len(toxic))])]
    both = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    (got,) = toxicity.tag(spark.createDataFrame([(1, "a zorgle here")], "doc_id long, text string"), model).collect()
    assert [(s.start, s.end) for s in got.spans] == [(2, 8)]
