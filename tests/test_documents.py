"""Stored documents, present, absent and broken."""

import json

from gristmill.sources import files as fs


def test_documents(spark, tmp_path):
    rows = [{"film": "a", "filename": "x", "nth": 1, "w": 5}, {"film": "a", "filename": "x", "nth": 2, "w": None}, {"film": "b", "filename": "x", "nth": 3, "w": 7}]
    (tmp_path / "results.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "broken.json").write_text('{"film": ')
    read = lambda name: fs.document(spark, str(tmp_path), name, "film string, filename string, nth int, w int")
    assert read("absent.json").count() == read("broken.json").count() == 0
    assert sorted(map(tuple, fs.last_results(read("results.json"), "nth").collect())) == [("a", "x", 2, None), ("b", "x", 3, 7)]


def test_splits(spark, tmp_path):
    (tmp_path / "splits.json").write_text('{"tuning": ["a", "b"], "holdout": ["c"]}')
    of = lambda name: fs.splits(fs.document(spark, str(tmp_path), name, "tuning array<string>, holdout array<string>"))
    assert sorted(map(tuple, of("splits.json").collect())) == [("a", "tuning"), ("b", "tuning"), ("c", "holdout")]
    assert of("none.json").count() == 0


def test_sessions(spark, tmp_path):
    for at in ("s2", "s1", "empty", "s1/deep"):
        (tmp_path / at).mkdir(exist_ok=True)
    for at in ("s2", "s1"):
        (tmp_path / at / "state.json").write_text("{}")
    (tmp_path / "empty" / "other.json").write_text("{}")
    got = [r.session for r in fs.sessions_below(fs.listing(spark, str(tmp_path))).collect()]
    assert [x.rsplit("/", 1)[1] for x in got] == ["s1", "s2"]
