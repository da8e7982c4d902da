"""Rewritten sidecars against an independent edit of their tree, commits that are cut off or repeated, and polling."""

import struct
import xml.etree.ElementTree as ET

import pytest

from gristmill.functions import xmp
from gristmill.operators import convention as cv
from gristmill.sources import documents as doc
from gristmill.streaming import feedback as fb
from gristmill.streaming import polling

DT, RDF = f"{{{xmp.DT}}}", f"{{{xmp.RDF}}}"
BODY = """<?xml version="1.0" encoding="UTF-8"?>
<!-- <rdf:Description darktable:history_end="9"/> -->
<x:xmpmeta xmlns:x="adobe:ns:meta/">
 <{r}:RDF xmlns:{r}="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:{d}="http://darktable.sf.net/">
  <{r}:Description {r}:about='a &gt; "b"' {d}:history_end='{end}' {d}:history_current_hash="x" other="&#10;1">
   <note><![CDATA[<{d}:history>]]></note>
   <{d}:masks_history><{r}:Seq><{r}:li {d}:mask_num="0"/><{r}:li {d}:mask_num="2"></{r}:li></{r}:Seq></{d}:masks_history>
   <{d}:history><{r}:Seq>
     <{r}:li {d}:num="0" {d}:operation="a>b"/> <{r}:li {d}:num="1" {d}:operation="c"/>
     <{r}:li {d}:num="2" {d}:operation="d"/></{r}:Seq></{d}:history>
   <{d}:colorlabels><{r}:Seq><{r}:li>2</{r}:li><{r}:li> 4 </{r}:li></{r}:Seq></{d}:colorlabels>
  </{r}:Description>
  <{r}:Description {r}:about="second"/>
 </{r}:RDF>
</x:xmpmeta>
<!-- tail -->"""


def tree_edit(text, steps, label):
    """The same edit on a tree, as nested tuples without white space."""
    root = ET.fromstring(text.encode())
    d = next(root.iter(RDF + "Description"))
    items = list(d.find(f"{DT}history/{RDF}Seq")) if d.find(f"{DT}history") is not None else []
    end = int(d.get(DT + "history_end", len(items)))
    numbers = [int(i.get(DT + "num")) for i in items]
    kept = [i for i, n in zip(items, numbers, strict=True) if n < end]
    last = max((n for n in numbers if n < end), default=-1)
    codes = [int(i.text) for i in d.findall(f"{DT}colorlabels/{RDF}Seq/{RDF}li")]
    masks = [m for m in d.findall(f"{DT}masks_history/{RDF}Seq/{RDF}li") if int(m.get(DT + "mask_num")) not in {n for n in numbers if n >= end}]
    return {
        "history": [i.get(DT + "operation") for i in kept] + [s[0] for s in steps], "numbers": [int(i.get(DT + "num")) for i in kept] + [last + 1 + k for k in range(len(steps))],
        "end": last + 1 + len(steps), "labels": sorted({c for c in codes if c > 2} | {xmp.LABELS[label]}), "masks": len(masks),
        "others": {k: v for k, v in d.attrib.items() if k not in (DT + "history_end", DT + "history_current_hash", DT + "xmp_version")}, "note": d.findtext("note"), "count": len(list(root.iter(RDF + "Description"))),
    }


def read_back(text):
    root = ET.fromstring(text.encode())
    d = next(root.iter(RDF + "Description"))
    items = d.findall(f"{DT}history/{RDF}Seq/{RDF}li")
    assert d.get(DT + "history_current_hash") is None and d.get(DT + "xmp_version") == "5"
    return {
        "history": [i.get(DT + "operation") for i in items], "numbers": [int(i.get(DT + "num")) for i in items], "end": int(d.get(DT + "history_end")),
        "labels": [int(i.text) for i in d.findall(f"{DT}colorlabels/{RDF}Seq/{RDF}li")], "masks": len(d.findall(f"{DT}masks_history/{RDF}Seq/{RDF}li")),
        "others": {k: v for k, v in d.attrib.items() if k not in (DT + "history_end", DT + "xmp_version")}, "note": d.findtext("note"), "count": len(list(root.iter(RDF + "Description"))),
    }


@pytest.mark.parametrize("end", [0, 1, 2, 3, 7])
@pytest.mark.parametrize("prefixes", [("rdf", "darktable"), ("r", "dt")])
def test_history_against_a_tree(end, prefixes):
    text = BODY.format(r=prefixes[0], d=prefixes[1], end=end)
    for steps in ([], xmp.steps_of([0, 0.1, 1, 0.9], 1.5, False, None), xmp.steps_of(None, None, True, 2.0)):
        new = xmp.edited_history(text, steps, "yellow")
        assert read_back(new) == tree_edit(text, steps, "yellow")
        assert new.startswith(text[: text.index("history_end='")]) and new.endswith("<!-- tail -->")
        once_more = xmp.edited_history(new, steps, "red")
        assert read_back(once_more) == tree_edit(new, steps, "red")


def test_history_of_little_or_nothing():
    steps = xmp.steps_of([0, 0, 1, 1], None, False, None)
    for text in (None, "", xmp.EMPTY, f'<a><R:RDF xmlns:R="{xmp.RDF}"><R:Description/></R:RDF></a>', xmp.EMPTY.replace('rdf:about=""/>', f'xmlns:darktable="urn:other"><d:history xmlns:d="{xmp.DT}"/></rdf:Description>')):
        got = read_back(xmp.edited_history(text, steps, "green"))
        assert (got["history"], got["numbers"], got["end"], got["labels"]) == (["crop"], [0], 1, [2])
    assert read_back(xmp.edited_history(None, [], "red"))["history"] == []


def test_texts_that_stay(spark):
    bad = {"cut": xmp.EMPTY[:60], "none": "<a/>", "text": "hello", "two roots": xmp.EMPTY * 2, "history": xmp.EMPTY.replace("/>\n </rdf:RDF>", f'><d:history xmlns:d="{xmp.DT}"><d:x/></d:history></rdf:Description>\n </rdf:RDF>')}
    rows = [(k, v, None, None, True, None, "red", 1) for k, v in {**bad, "good": xmp.EMPTY}.items()] + [("label", xmp.EMPTY, None, None, True, None, "blue", 1), ("crop", xmp.EMPTY, [0.1], None, False, None, "red", 1)]
    df = spark.createDataFrame(rows, "path string, text string, crop array<double>, angle double, was_applied boolean, was_angle double, label string, revision int")
    got = {r.path: r for r in xmp.edited(df, "history").collect()}
    assert all(got[k].text is None and got[k].error for k in (*bad, "label", "crop")) and got["good"].error is None
    assert xmp.edited(df.where("false"), "raw").count() == 0


def test_parameters():
    assert struct.unpack("<4f2i", bytes.fromhex(xmp.crop_params(-1, 0.5, 0.2, 0.1))) == pytest.approx((0, 0.5, 0.2, 0.501, 0, 0))
    assert len(xmp.turn_params(2.5)) == 2 * xmp.TURN_BYTES and struct.unpack("<f", bytes.fromhex(xmp.turn_params(2.5))[:4])[0] == 2.5
    names = lambda *a: [(s[0], s[3]) for s in xmp.steps_of(*a)]
    assert names([0, 0, 1, 1], 1.0, False, None) == [("ashift", 1), ("crop", 1)] and names([0, 0, 1, 1], None, True, 2.0) == [("ashift", 0), ("crop", 1)]
    assert names(None, 1.0, True, 2.0) == [("ashift", 0), ("crop", 0)] and names(None, None, True, None) == [("crop", 0)] and names(None, None, False, 3.0) == []


def test_values_go_wherever_they_are_stored():
    text = f"""<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{xmp.RDF}" xmlns:c="{xmp.CRS}" xmlns:xmp="urn:taken">
<rdf:Description c:CropTop='0.3' c:Exposure="1"><c:CropLeft>0.2</c:CropLeft><c:Tone>5</c:Tone></rdf:Description>
<rdf:Description xmlns:k="{xmp.CRS}" k:HasCrop="False" k:Other="2"><k:CropAngle>3</k:CropAngle></rdf:Description></rdf:RDF></x:xmpmeta>"""
    new = xmp.with_values(text, xmp.raw_values([0.1, 0.2, 0.9, 1 / 3], False, "green", 4))
    first, second = list(ET.fromstring(new).iter(RDF + "Description"))
    own = lambda d, uri: {k.split("}")[1]: v for k, v in d.attrib.items() if k.startswith(f"{{{uri}}}")}
    assert own(first, xmp.CRS) == {"HasCrop": "True", "CropLeft": "0.100000", "CropTop": "0.200000", "CropRight": "0.900000", "CropBottom": "0.333333", "CropAngle": "0", "Exposure": "1"}
    assert own(second, xmp.CRS) == {"Other": "2"} and [c.text for c in first] == ["5"] and len(second) == 0
    assert own(first, xmp.XMP) == {"Label": "Green"} and own(first, xmp.OWN) == {"Label": "green", "Revision": "4"}
    assert xmp.with_values(new, xmp.raw_values([0.1, 0.2, 0.9, 1 / 3], False, "green", 4)) == new


def test_documents_are_whole(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/state.json"
    assert doc.read_document(spark, path) is None
    doc.write_document(spark, path, "old ä")
    with monkeypatch.context() as m:
        m.setattr(doc, "_moved", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            doc.write_document(spark, path, "new")
    assert doc.read_document(spark, path) == "old ä"
    doc.write_document(spark, path, "new")
    assert doc.read_document(spark, path) == "new"


def test_rows_are_replaced_whole(spark, tmp_path, monkeypatch):
    one, two = spark.range(5), spark.range(5, 7)
    doc.write_rows(one, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(doc, "write_document", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            doc.write_rows(two, str(tmp_path))
    read = lambda: sorted(r.id for r in doc.read_rows(spark, str(tmp_path), one.schema).collect())
    assert read() == [0, 1, 2, 3, 4]
    doc.write_rows(two, str(tmp_path))
    assert read() == [5, 6] and doc.read_rows(spark, f"{tmp_path}/none", one.schema).count() == 0


def test_batches_are_appended_once(spark, tmp_path, monkeypatch):
    log, rows = str(tmp_path), [spark.range(3), spark.range(10, 12)]
    read = lambda: sorted((r.batch, r.id) for r in doc.read_log(spark, log, rows[0].schema).collect())
    assert read() == [] and doc.append_batch(rows[0], log, 0)
    with monkeypatch.context() as m:
        m.setattr(doc, "_moved", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            doc.append_batch(rows[1], log, 1)
    assert read() == [(0, 0), (0, 1), (0, 2)]
    assert doc.append_batch(rows[1], log, 1) and not doc.append_batch(rows[1], log, 1) and not doc.append_batch(rows[0], log, 0)
    assert read() == [(0, 0), (0, 1), (0, 2), (1, 10), (1, 11)]
    with monkeypatch.context() as m:  # another writer was quicker
        m.setattr(doc, "_store", lambda s, p, f=doc._store: (f(s, p)[0], Never(f(s, p)[1])))
        assert doc.append_batch(rows[0], log, 1) is False
    assert read()[3:] == [(1, 10), (1, 11)]


class Never:
    """A store that does not see what is there."""

    def __init__(self, store):
        self.store = store

    def exists(self, _):
        return False

    def __getattr__(self, name):
        return getattr(self.store, name)


def test_sessions_are_learned_once(spark):
    schema = "film string, at int, long_mm double, short_mm double, n long"
    rows = [("a", 1, 36.0, 24.0, 100), ("a", 2, 35.0, 23.0, 20), ("a", 2, 35.0, 23.0, 20), ("a", 3, None, 24.0, 9), ("b", 1, 30.0, 30.0, 3), ("b", 5, 31.0, 30.5, 0), (None, 1, 1.0, 1.0, 1)]
    sessions = spark.createDataFrame(rows, schema)
    whole = {r.film: tuple(r)[1:] for r in cv.learn(None, sessions, "film", "at").collect()}
    assert whole == {"a": (35.75, 23.75, 80, 2), "b": (30.0, 30.0, 3, 1)}  # 60 of the 100 count beside 20
    store = cv.learn(None, sessions.where("at = 1"), "film", "at")
    for batch in (sessions.where("at = 1"), sessions, sessions, sessions.where("film = 'b'"), sessions.where("false")):
        store = cv.learn(store, batch, "film", "at")
    assert {r.film: tuple(r)[1:] for r in store.collect()} == whole


def listed(spark, folder, k, rows):
    spark.createDataFrame(rows, "path string, stamp timestamp").coalesce(1).write.parquet(f"{folder}/part{k}.parquet")


def test_polled_once_per_change(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("a", at(1)), ("b", at(1)), ("a", at(1))], [("a", at(1)), ("b", at(2))], [("b", at(2)), ("a", at(5)), ("a", at(3)), (None, at(9))], [("a", at(4)), ("c", at(6)), ("b", None)]]
    for k, rows in enumerate(batches):
        listed(spark, tmp_path / "in", k, rows)
    schema = spark.read.parquet(f"{tmp_path}/in/part0.parquet").schema
    seen = []

    def run(n):
        query = polling.changes(fb.stream(spark, f"{tmp_path}/in/*", "part", schema), "path", "stamp").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).start()
        query.awaitTermination()
        return sorted(seen)

    want = sorted([("a", at(1), 1), ("b", at(1), 1), ("b", at(2), 2), ("a", at(3), 2), ("a", at(5), 3), ("c", at(6), 1)])
    assert run(0) == want
    assert run(1) == want  # a restart repeats nothing
    listed(spark, tmp_path / "in", 9, [("a", at(5)), ("b", at(7))])
    assert run(2) == sorted([*want, ("b", at(7), 3)])
