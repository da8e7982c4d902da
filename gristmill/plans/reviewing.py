"""Review state, discovery and selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as tx
from gristmill.operators import evaluate as ev
from gristmill.operators import review as rv
from gristmill.operators import selection as se
from gristmill.sources import files as fi
from gristmill.session import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return rv.last_write(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "value")


def undo_last(spark: SparkSession, d: str) -> DataFrame:
    return rv.undo_last(_events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], "value")


def log_ring(spark: SparkSession, d: str) -> DataFrame:
    return rv.newest(_events(spark, d), 3, ["ts", "event_id"], ["user_id"]).select("user_id", "event_id")


def dedupe_best_rank(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return rv.best_state(_events(spark, d), ["user_id"], rank, ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def plan_diff(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a copy applied earlier, which lacks some and differs in others; null angles are equal."""
    angle = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    now = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("apply"), "o_orderpriority", angle.alias("angle"))
    old = now.where("o_orderkey % 5 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise(F.col("o_orderpriority")))
    diff = rv.plan_diff(now, old, "o_orderkey", ["apply", "o_orderpriority", "angle"])
    return diff.select("o_orderkey", "changed", "was_applied", rv.file_action(F.col("apply"), F.col("changed"), F.col("was_applied"), F.col("o_orderkey") % 11 != 0).alias("action"))


def apply_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    group = rv.effective_group(F.when(F.col("l_linenumber") == 1, "green").when(F.col("l_linenumber") == 2, "none"), ev.band(F.col("l_discount") * 10))
    decision = F.when(F.col("l_returnflag") == "A", "accept").when(F.col("l_returnflag") == "R", "skip")
    ok = rv.will_apply(decision, F.when(F.col("l_linenumber") == 6, "broken"), F.col("l_quantity") > 2, group, F.col("l_tax") > 0.07, F.col("l_linestatus") == "O")
    return rows.groupBy(group.alias("grp"), ok.alias("applies")).agg(F.count("*").alias("n"))


def queue_merge(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 2 = 0 or c_custkey % 3 <> 0").select("c_custkey", F.lit("old").alias("band"), F.col("c_acctbal").alias("w"))
    new = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", ev.band(F.col("c_acctbal") / 10000).alias("band"), (F.col("c_acctbal") * 2).alias("w"))
    return rv.merge(old, new, "c_custkey", F.col("band") != "red", ["band", "w"])


def session_idle_30m(spark: SparkSession, d: str) -> DataFrame:
    return rv.sessions(_events(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("at", F.timestamp_micros("at").cast("timestamp_ntz")), ["user_id"], "at").select("user_id", "first", "last", "n")


def ttl_cleanup(spark: SparkSession, d: str) -> DataFrame:
    seen = _events(spark, d).groupBy("user_id").agg(F.max("ts").alias("at"), F.max("event_id").alias("last_id"))
    now = _events(spark, d).agg(F.max("ts").alias("now"))
    return rv.expired(seen.crossJoin(F.broadcast(now)), "at", F.col("now"), 1, F.col("last_id") % 4 == 0).select("user_id", "at")


def resume_superset(spark: SparkSession, d: str) -> DataFrame:
    """Orders all of whose parts belong to the first half of the catalogue."""
    wanted = table(spark, d, "part").where("p_size <= 30").select(F.col("p_partkey").alias("l_partkey"))
    return rv.contained(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", wanted)


def phase_revisions(spark: SparkSession, d: str) -> DataFrame:
    phase = F.element_at(F.array(*map(F.lit, ("reviewing", "locked", "applied", "reviewing", "apply_failed", "analyzing"))), (F.col("event_id") % 6 + 1).cast("int"))
    log = _events(spark, d).select("user_id", "event_id", phase.alias("phase"))
    steps = rv.transitions(log, "user_id", "event_id", "phase")
    return steps.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"), F.max("revision").alias("revision"))


def roll_size(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 9.0).alias("h"), (F.col("l_tax") > 0.06).alias("manual"))
    ref = rows.where("id % 10 = 1")
    return rv.move_size(rows, "id", "l_orderkey", ref).select("id", "new_w", "new_h", "moved")


def moves_counter(spark: SparkSession, d: str) -> DataFrame:
    return rv.moves(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")


def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return se.top_k(rows, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 8)


def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    return se.strided(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


def union_priority(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.char_length("text").cast("long").alias("n"))
    two = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    return se.precedence([one, two], "id", "n")


def incremental_reuse(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("mtime"))
    old = now.where("o_orderkey % 4 <> 0").withColumn("mtime", F.when(F.col("o_orderkey") % 9 == 0, F.lit("1900-01-01").cast("timestamp_ntz")).otherwise(F.col("mtime").cast("timestamp_ntz"))).withColumn("conf", F.when(F.col("o_orderkey") % 10 != 1, 0.5))
    out = se.reusable(now.withColumn("mtime", F.col("mtime").cast("timestamp_ntz")), old, ["o_custkey", "o_orderkey"], "mtime", F.col("conf").isNotNull())
    return out.groupBy("o_custkey").agg(F.count_if("reuse").alias("kept"), F.count_if(~F.col("reuse")).alias("again"))


def greedy_leaders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    return se.leaders(rows, ["l_orderkey"], ["k"], ["x", "y"], 10.0)


def converter_votes(spark: SparkSession, d: str) -> DataFrame:
    return se.votes(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus", ["O", "F", "P"])


def drop_twins(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files: ids divisible by 3 are raw; other ones go where a raw one has their stem."""
    path = F.concat(F.lit("/roll "), (F.col("page_id") % 7).cast("string"), F.lit("/IMG"), F.floor(F.col("page_id") / 2).cast("string"), F.when(F.col("page_id") % 3 == 0, ".NEF").otherwise(".jpg"))
    kept = fi.without_twins(table(spark, d, "pages").select("page_id", path.alias("path")))
    return kept.select("page_id", "path", tx.parent(F.col("path")).alias("roll"), tx.basename(F.col("path")).alias("name"), tx.roll_matches(tx.parent(F.col("path")), ["3", "roll 4"]).alias("wanted"))


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.parent(F.col("url")).alias("parent"), tx.basename(F.col("url")).alias("name"), tx.slug(F.col("url")).alias("slug"))


def folder_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Made-up roll names, several of which lead to one folder name."""
    k = F.col("p_partkey")
    names = F.concat(F.lit("Rölle"), F.when(k % 3 == 0, "?").when(k % 3 == 1, "*").otherwise("_"), (k % 50).cast("string"))
    return tx.slugs(table(spark, d, "part").select(names.alias("name")), "name")


def natural_sort_key(spark: SparkSession, d: str) -> DataFrame:
    key = tx.natural_key(F.regexp_replace("s_name", "#", " "))
    return table(spark, d, "supplier").select("s_suppkey", key.alias("key"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


def xml_attr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.attribute(F.col("html"), "class").alias("class"), tx.attribute(F.col("html"), "href").alias("href"))


def canonical_sha(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", tx.canonical_sha256({"status": F.col("o_orderstatus"), "key": F.col("o_orderkey"), "cust": F.col("o_custkey")}).alias("sha"))


_RANK = "case event_type when 'purchase' then 3 when 'click' then 2 else 1 end"
_CHANGED = "not (o.k is not null and n.a is not distinct from o.a and n.p is not distinct from o.p and n.g is not distinct from o.g)"
_FILES = "f as (select page_id, '/roll ' || (page_id % 7) || '/IMG' || (page_id // 2) || case when page_id % 3 = 0 then '.NEF' else '.jpg' end as path from pages), g as (select *, lower(regexp_replace(path, '\\.[^./]*$', '')) as st, ends_with(path, '.NEF') as raw from f)"

QUERIES = {f.__name__: f for f in (last_write_wins, undo_last, log_ring, dedupe_best_rank, plan_diff, apply_counts, queue_merge, session_idle_30m, ttl_cleanup, resume_superset, phase_revisions, roll_size, moves_counter, top_k_per_group, strided_sample, union_priority, incremental_reuse, greedy_leaders, converter_votes, drop_twins, path_parts, folder_slugs, natural_sort_key, json_props, xml_attr, canonical_sha)}
ORACLE = {
    "last_write_wins": "select user_id, event_type, last(value order by ts, event_id) as value, count(*) as n_changes from events group by all",
    "undo_last": """select user_id, event_type, max(value) filter (k = 2) as value from
(select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as k from events) group by all""",
    "log_ring": "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 3",
    "dedupe_best_rank": f"select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by {_RANK} desc, ts desc, event_id desc) = 1",
    "plan_diff": f"""with n as (select o_orderkey as k, o_orderstatus <> 'P' as a, o_orderpriority as p, case when o_orderkey % 3 = 0 then o_totalprice end as g from orders),
o as (select k, a, case when k % 7 = 0 then 'old' else p end as p, g from n where k % 5 <> 0),
j as (select n.k, n.a, {_CHANGED} as changed, o.k is not null as was from n left join o using (k))
select k as o_orderkey, changed, was as was_applied, case when a then case when changed or k % 11 = 0 then 'write' else 'keep' end
  when was and k % 11 <> 0 then 'remove' else 'skip' end as action from j""",
    "apply_counts": """with r as (select *, case when l_linenumber = 1 then 'green' when l_discount * 10 >= 0.5 then 'green' when l_discount * 10 >= 0.3 then 'yellow' else 'red' end as g from lineitem)
select g as grp, l_returnflag <> 'R' and l_linenumber <> 6 and l_quantity > 2 and not (g = 'red' and not l_tax > 0.07::double and l_returnflag <> 'A') and l_linestatus = 'O' as applies, count(*) as n
from r group by all""",
    "queue_merge": """with o as (select c_custkey as k, 'old' as band, c_acctbal as w from customer where c_custkey % 2 = 0 or c_custkey % 3 <> 0),
n as (select c_custkey as k, case when c_acctbal / 10000 >= 0.5 then 'green' when c_acctbal / 10000 >= 0.3 then 'yellow' else 'red' end as band, c_acctbal * 2 as w from customer where c_custkey % 3 = 0)
select k as c_custkey, band, w from n where band <> 'red' union all select k, band, w from o where k not in (select k from n)""",
    "session_idle_30m": """with g as (select user_id, ts, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minutes then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
s as (select *, sum(b) over (partition by user_id order by ts) as s from g)
select user_id, min(ts) as first, max(ts) as last, count(*) as n from s group by user_id, s""",
    "ttl_cleanup": """with s as (select user_id, max(ts) as "at", max(event_id) as i from events group by 1)
select user_id, "at" from s where "at" < (select max(ts) from events) - interval 1 day and i % 4 <> 0""",
    "resume_superset": """select l_orderkey from lineitem left join (select p_partkey from part where p_size <= 30) on l_partkey = p_partkey group by 1 having count(*) = count(p_partkey)""",
    "phase_revisions": """with p as (select user_id, event_id, ['reviewing', 'locked', 'applied', 'reviewing', 'apply_failed', 'analyzing'][event_id % 6 + 1] as ph from events),
b as (select *, lag(ph) over (partition by user_id order by event_id) as was from p),
a as (select *, was is null or (was || '>' || ph) in ('analyzing>reviewing', 'reviewing>locked', 'locked>applied', 'locked>apply_failed', 'locked>reviewing', 'applied>reviewing', 'apply_failed>reviewing', 'reviewing>analyzing') as ok,
  case when ph = 'reviewing' and was in ('locked', 'applied', 'apply_failed') then 1 else 0 end as o from b)
select user_id, count(*) filter (ok) as allowed, count(*) filter (not ok) as refused, (1 + sum(o))::bigint as revision from a group by 1""",
    "roll_size": """with r as (select l_orderkey * 10 + l_linenumber as id, l_orderkey, l_quantity as w, l_linenumber * 9.0::double as h, l_tax > 0.06::double as manual from lineitem),
f as (select l_orderkey, id as ref, greatest(w, h) as l, least(w, h) as s from r where id % 10 = 1),
m as (select r.*, l, s, ref is not null and ref <> id and not manual as moved from r left join f using (l_orderkey))
select id, case when moved then case when w >= h then l else s end else w end as new_w, case when moved then case when w >= h then s else l end else h end as new_h, moved from m""",
    "moves_counter": """with b as (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) as was from events)
select was as came_from, event_type as went_to, count(*) as n from b where was <> event_type group by all""",
    "top_k_per_group": """select l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() over w as rank from lineitem
window w as (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) qualify rank <= 8""",
    "strided_sample": """with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as k, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, o_orderkey from r where k % greatest(1, n // 4) = 0 and k // greatest(1, n // 4) < 4""",
    "union_priority": """with u as (select item_id as id, length(text) as n, 0 as priority from benchmark union all select doc_id, n_chars, 1 from documents)
select id, n, priority from u qualify row_number() over (partition by id order by priority, n) = 1""",
    "incremental_reuse": """with r as (select o_custkey, o_orderkey % 4 <> 0 and o_orderkey % 10 <> 1 and o_orderkey % 9 <> 0 as reuse from orders)
select o_custkey, count(*) filter (reuse) as kept, count(*) filter (not reuse) as again from r group by 1""",
    "converter_votes": """with c as (select o_custkey, o_orderstatus, count(*) as n from orders group by all)
select o_custkey, o_orderstatus, n from c qualify row_number() over (partition by o_custkey order by n desc, case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end) = 1""",
    "drop_twins": f"""with {_FILES}
select page_id, path, split_part(path, '/', 2) as roll, split_part(path, '/', 3) as name, split_part(path, '/', 2) in ('roll 3', 'roll 4') as wanted
from g where raw or st not in (select st from g where raw)""",
    "path_parts": r"""select page_id, regexp_extract(url, '([^/]+)/[^/]*$', 1) as parent, regexp_extract(url, '([^/]*)$', 1) as name,
  case when trim(regexp_replace(url, '[^\p{L}\p{N}_.\- ]+', '_', 'g')) = '' then 'film' else trim(regexp_replace(url, '[^\p{L}\p{N}_.\- ]+', '_', 'g')) end as slug from pages""",
    "folder_slugs": """with n as (select distinct 'Rölle' || ['?', '*', '_'][p_partkey % 3 + 1] || (p_partkey % 50) as name from part),
b as (select name, replace(replace(name, '?', '_'), '*', '_') as base, row_number() over (partition by base order by name) as k from n)
select name, base || case when k > 1 then '_' || k else '' end as slug from b""",
    "natural_sort_key": """select s_suppkey, 'supplier ' || lpad(s_suppkey::varchar, 12, '0') as key from supplier""",
    "json_props": "select (props->>'$.k')::int as k, count(*) as n from events group by 1",
    "xml_attr": """select page_id, regexp_extract(html, '\\bclass="([^"]*)"', 1) as class, regexp_extract(html, '\\bhref="([^"]*)"', 1) as href from pages""",
    "canonical_sha": """select o_orderkey, sha256('{"cust":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') as sha from orders""",
}
