"""Sidecars that are rewritten, logs and documents that are committed once, a store that learns, and polled results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import xmp
from gristmill.operators import convention as cv
from gristmill.session import scratch, table
from gristmill.sources import documents as doc
from gristmill.streaming import feedback as fb
from gristmill.streaming import polling

_CLEAN = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
_OPEN = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{xmp.RDF}"><rdf:Description rdf:about="" xmlns:darktable="{xmp.DT}"'
_CLOSE = "</rdf:Description></rdf:RDF></x:xmpmeta>\n"
_LEFT, _BOTTOM = "(page_id % 2) * 0.25", "case when page_id % 3 = 1 then 0.75 else 0.5 end"


def _sidecars(spark: SparkSession, d: str, raw: bool) -> DataFrame:
    """A sidecar per page, whose description is the page; its history, labels and edit follow from the page's number."""
    text = F.lit(_OPEN)
    escaped = F.regexp_replace("html", _CLEAN, "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(entity))
    about = F.concat(F.lit('<dc:description xmlns:dc="http://purl.org/dc/elements/1.1/">'), escaped, F.lit("</dc:description>"))
    if raw:
        old = F.when(F.col("page_id") % 2 == 0, F.lit(f'<crs:CropLeft xmlns:crs="{xmp.CRS}">0.1</crs:CropLeft>')).otherwise("")
        text = F.concat(text, F.lit(">"), about, old, F.lit(_CLOSE))
    else:
        end = F.when(F.col("page_id") % 7 < 6, F.concat(F.lit(' darktable:history_end="'), (F.col("page_id") % 4).cast("string"), F.lit('"'))).otherwise("")
        entries = F.transform(F.expr("filter(array(0, 1, 2, 3), k -> k < page_id % 5)"), lambda k: F.concat(F.lit('<rdf:li darktable:num="'), k.cast("string"), F.lit('" darktable:operation="x"/>')))
        history = F.concat(F.lit("<darktable:history><rdf:Seq>"), F.array_join(entries, ""), F.lit("</rdf:Seq></darktable:history>"))
        colours = F.lit("<darktable:colorlabels><rdf:Seq><rdf:li>0</rdf:li><rdf:li>3</rdf:li></rdf:Seq></darktable:colorlabels>")
        text = F.concat(text, end, F.lit(' darktable:history_current_hash="a1">'), about, history, colours, F.lit(_CLOSE))
    number = F.col("page_id")
    return table(spark, d, "pages").select(
        number.cast("string").alias("path"), text.alias("text"),
        F.when(number % 3 != 0, F.array(*(F.expr(e).cast("double") for e in (_LEFT, "0", "1", _BOTTOM)))).alias("crop"),
        F.when(number % 4 == 1, 1.5).alias("angle"), (number % 2 == 0).alias("was_applied"), F.lit(None).cast("double").alias("was_angle"),
        F.element_at(F.array(F.lit("red"), F.lit("yellow"), F.lit("green")), (number % 3 + 1).cast("int")).alias("label"), F.lit(7).alias("revision"),
    )


def _digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("path").cast("long").alias("page_id"), F.sha2("text", 256).alias("sha"), F.char_length("text").cast("long").alias("n"), "error")


def sidecar_history(spark: SparkSession, d: str) -> DataFrame:
    return _digest(xmp.edited(_sidecars(spark, d, False), "history"))


def sidecar_raw(spark: SparkSession, d: str) -> DataFrame:
    return _digest(xmp.edited(_sidecars(spark, d, True), "raw"))


def learned_store(spark: SparkSession, d: str) -> DataFrame:
    """Months of orders are sessions of each priority; the second half comes after the first, and all of it once more."""
    month = F.expr("cast(date_format(o_orderdate, 'yyyyMM') as int)")
    rows = table(spark, d, "orders").select("o_orderpriority", month.alias("month"), (F.floor(F.col("o_totalprice")) % 4000).cast("long").alias("v"))
    mean = lambda v: F.bround(F.sum(v) / F.count("*") / 100, 2)
    sessions = rows.groupBy("o_orderpriority", "month").agg(mean(F.col("v")).alias("long_mm"), mean(F.col("v") + 50).alias("short_mm"), F.count("*").alias("n"))
    store = cv.learn(None, sessions.where("month < 199606"), "o_orderpriority", "month")
    for batch in (sessions, sessions.where("month >= 199606"), sessions):
        store = cv.learn(store, batch, "o_orderpriority", "month")
    return store.select("o_orderpriority", F.round("long_mm", 2).alias("long_mm"), F.round("short_mm", 2).alias("short_mm"), "n", "upto")


def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """Events in batches by their type, each appended twice; the log has each once."""
    events = table(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    folder = scratch(spark, "log")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())  # a few kinds
    for number, kind in [*enumerate(types), *enumerate(types)]:
        doc.append_batch(events.where(F.col("event_type") == kind), folder, number)
    log = doc.read_log(spark, folder, events.schema)
    return log.groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"), F.sum("user_id").alias("users"))


def stored_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents written and replaced: the second version is read."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("p"))
    folder = scratch(spark, "rows")
    doc.write_rows(orders.where("o_orderkey < 0"), folder)
    doc.write_rows(orders, folder)
    return doc.read_rows(spark, folder, orders.schema).groupBy((F.col("o_custkey") % 100).alias("c")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def polled_changes(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of an hour are one change of that user's file, listed as often as there are events."""
    log = fb.stream(spark, d, "events", table(spark, d, "events").schema).select("user_id", F.date_trunc("hour", "ts").alias("stamp"))
    return fb.drained(polling.changes(log, "user_id", "stamp"), "append")


QUERIES = {f.__name__: f for f in (sidecar_history, sidecar_raw, learned_store, appended_log, stored_rows, polled_changes)}

_ESCAPED = r"""'<dc:description xmlns:dc="http://purl.org/dc/elements/1.1/">' || replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</dc:description>'"""
_STEP = f"""'<rdf:li darktable:num="' || {{num}} || '" darktable:operation="{{op}}" darktable:enabled="{{on}}" darktable:modversion="{{version}}" darktable:params="' || {{params}} || '" darktable:multi_name="" darktable:multi_name_hand_edited="0" darktable:multi_priority="0" darktable:blendop_version="14" darktable:blendop_params="{xmp.BLEND}"/>'"""
_FLOAT = "case {} when 0 then '00000000' when 0.25 then '0000803e' when 0.5 then '0000003f' when 0.75 then '0000403f' when 1 then '0000803f' end"
_TURN = "'0000c03f' || repeat('00', 12) || '0000e0410000803f0000c8420000803f' || repeat('00', 12) || '0000803f' || repeat('00', 4) || '0000803f' || repeat('00', 4 + 832)"

ORACLE = {
    "sidecar_history": f"""
with k as (select *, page_id % 5 as n, case when page_id % 7 < 6 then page_id % 4 else page_id % 5 end as e from pages),
s as (select *, least(n, e) as after, page_id % 3 <> 0 as cropped, page_id % 4 = 1 and page_id % 3 <> 0 as turned, page_id % 3 = 0 and page_id % 2 = 0 as undone from k),
c as (select *, {_FLOAT.format(_LEFT)} || '00000000' || '0000803f' || {_FLOAT.format(_BOTTOM)} || repeat('00', 8) as params,
  after + case when turned then 1 else 0 end as num, after + case when turned then 2 when cropped or undone then 1 else 0 end as fin from s),
h as (select *, array_to_string(list_transform(range(0, after), lambda i: '<rdf:li darktable:num="' || i || '" darktable:operation="x"/>'), '')
  || case when turned then {_STEP.format(num="after", op="ashift", on=1, version=5, params=f"({_TURN})")} else '' end
  || case when cropped then {_STEP.format(num="num", op="crop", on=1, version=1, params="params")}
          when undone then {_STEP.format(num="num", op="crop", on=0, version=1, params="'00000000000000000000803f0000803f' || repeat('00', 8)")} else '' end as lines from c),
t as (select page_id, '{_OPEN}' || case when page_id % 7 < 6 then ' darktable:history_end="' || fin || '"' else chr(10) || '   darktable:history_end="' || fin || '"' end
  || chr(10) || '   darktable:xmp_version="5">' || {_ESCAPED} || case when lines = '' then '' else '<darktable:history><rdf:Seq>' || lines || '</rdf:Seq></darktable:history>' end
  || '<darktable:colorlabels><rdf:Seq>' || case page_id % 3 when 0 then '<rdf:li>0</rdf:li><rdf:li>3</rdf:li>' when 1 then '<rdf:li>1</rdf:li><rdf:li>3</rdf:li>' else '<rdf:li>2</rdf:li><rdf:li>3</rdf:li>' end
  || '</rdf:Seq></darktable:colorlabels>{_CLOSE}' as text from h)
select page_id, sha256(text) as sha, length(text) as n, cast(null as varchar) as error from t""",
    "sidecar_raw": f"""
with t as (select page_id, '{_OPEN}' || chr(10) || '   xmlns:xmp="{xmp.XMP}"' || chr(10) || '   xmp:Label="' || case page_id % 3 when 0 then 'Red' when 1 then 'Yellow' else 'Green' end || '"'
  || chr(10) || '   xmlns:gm="{xmp.OWN}"' || chr(10) || '   gm:Label="' || case page_id % 3 when 0 then 'red' when 1 then 'yellow' else 'green' end || '"' || chr(10) || '   gm:Revision="7"'
  || case when page_id % 3 <> 0 then chr(10) || '   xmlns:crs="{xmp.CRS}"' || chr(10) || '   crs:HasCrop="True"' || chr(10) || '   crs:CropAngle="0"'
       || chr(10) || '   crs:CropLeft="' || printf('%.6f', cast({_LEFT} as double)) || '"' || chr(10) || '   crs:CropTop="0.000000"' || chr(10) || '   crs:CropRight="1.000000"'
       || chr(10) || '   crs:CropBottom="' || printf('%.6f', cast({_BOTTOM} as double)) || '"'
     when page_id % 2 = 0 then chr(10) || '   xmlns:crs="{xmp.CRS}"' || chr(10) || '   crs:HasCrop="False"' else '' end
  || '>' || {_ESCAPED} || case when page_id % 2 = 0 and page_id % 3 = 0 then '<crs:CropLeft xmlns:crs="{xmp.CRS}">0.1</crs:CropLeft>' else '' end || '{_CLOSE}' as text from pages)
select page_id, sha256(text) as sha, length(text) as n, cast(null as varchar) as error from t""",
    "learned_store": """
with recursive r as (select o_orderpriority, cast(strftime(o_orderdate, '%Y%m') as int) as month, cast(floor(o_totalprice) as bigint) % 4000 as v from orders),
q as (select o_orderpriority, month, round_even(cast(sum(v) as double) / count(*) / 100, 2) as l, round_even(cast(sum(v + 50) as double) / count(*) / 100, 2) as w, count(*) as n from r group by all),
s as (select *, row_number() over (partition by o_orderpriority order by month) as k from q),
f as (
  select o_orderpriority, month, l, w, n, k from s where k = 1
  union all
  select s.o_orderpriority, s.month, round_even((f.l * least(f.n, 60) + s.l * s.n) / (least(f.n, 60) + s.n), 2), round_even((f.w * least(f.n, 60) + s.w * s.n) / (least(f.n, 60) + s.n), 2),
    least(f.n, 60) + s.n, s.k from f join s on s.o_orderpriority = f.o_orderpriority and s.k = f.k + 1)
select o_orderpriority, round(l, 2) as long_mm, round(w, 2) as short_mm, n, month as upto from f qualify row_number() over (partition by o_orderpriority order by k desc) = 1""",
    "appended_log": """select dense_rank() over (order by event_type) - 1 as batch, event_type, count(*) as n, count(distinct event_id) as n_ids, cast(sum(user_id) as bigint) as users from events group by event_type""",
    "stored_rows": "select o_custkey % 100 as c, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from orders group by 1",
    "polled_changes": """select user_id, date_trunc('hour', ts) as stamp, row_number() over (partition by user_id order by date_trunc('hour', ts)) as n from events group by 1, 2""",
}
