"""Session state and its joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays as ar
from gristmill.operators import state as st
from gristmill.session import table


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images of a customer's session."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_custkey", k.alias("id"), F.concat(F.lit("/r/"), k.cast("string")).alias("path"), F.when(k % 4 == 0, "manual").alias("method"),
        F.when(k % 3 == 0, "pending").when(k % 7 == 0, "error").otherwise("ok").alias("status"), F.when(k % 7 == 0, "broken").alias("error"), F.col("o_totalprice").alias("crop"),
    )


def plan_freeze(spark: SparkSession, d: str) -> DataFrame:
    return st.freeze(_images(spark, d), ["o_custkey"], "id", ["path", "method", "status"])


def add_images(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    items = images.select("o_custkey", "path").unionByName(images.select("o_custkey", F.concat("path", F.lit("b")).alias("path")))
    return st.add_images(images.where("id % 5 <> 0"), items, "o_custkey")


def detection_upsert(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d)
    return st.detected(images, images.where("id % 6 <> 0").select("id", (F.col("crop") * 2).alias("crop")), "id", ["crop"])


def accept_proposals(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d).select("id", "crop")
    return st.accepted(images, images.where("id % 2 = 0").select("id", (F.col("crop") + 1).alias("crop")), images.where("id % 3 = 0"), "id", "crop")


def retry_and_close(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d).select("id", "status", "error")
    again = st.retried(images, images.where("error is not null and id % 2 = 0"), "id")
    return again.select("id", F.col("status").alias("retried")).join(st.analysis_done(again), "id")


def settings_rule(spark: SparkSession, d: str) -> DataFrame:
    s = st.settings(F.col("l_tax") * 10.00049, F.col("l_discount") * 10.00049)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


def stale_sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    images = table(spark, d, "orders").select("o_orderkey", F.when(k % 5 == 0, "folder").otherwise("standalone").alias("mode"), F.when(k % 13 != 0, k).alias("size"), (k * 0.25).alias("mtime"))
    now = table(spark, d, "orders").where(k % 3 != 0).select("o_orderkey", F.when(k % 13 != 0, k + F.when(k % 7 == 0, 1).otherwise(0)).alias("size_now"), (k * 0.25 + F.when(k % 11 == 0, 0.01).otherwise(0.0001)).alias("mtime_now"))
    return images.join(now, "o_orderkey", "left").select("o_orderkey", st.stale(F.col("mode"), F.col("size"), F.col("mtime"), F.col("size_now"), F.col("mtime_now")).alias("stale"))


def read_model(spark: SparkSession, d: str) -> DataFrame:
    images = _images(spark, d).select("id", "path", F.concat_ws("/", "o_custkey", "id").alias("key"))
    results = _images(spark, d).where("id % 3 <> 0").select("path", F.col("crop").alias("detected"))
    references = _images(spark, d).where("id % 5 = 0").select(F.concat_ws("/", "o_custkey", "id").alias("key"), (F.col("crop") + 1).alias("reference"))
    return st.enriched(images, results, references, "path", "key")


def plan_report(spark: SparkSession, d: str) -> DataFrame:
    report = _images(spark, d).where("id % 2 = 0").select("id", F.when(F.col("id") % 3 == 0, "skipped").when(F.col("id") % 7 == 0, "failed").otherwise("ok").alias("status"))
    return st.reported(_images(spark, d).select("id", "path"), report, "id")


def unreferenced(spark: SparkSession, d: str) -> DataFrame:
    return st.without_reference(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def size_and_place(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("l_quantity"), F.col("l_linenumber") * 7.0
    centre = F.when(F.col("l_orderkey") % 9 != 0, F.lit(0.5))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", st.near_size(w, h, F.lit(30.0), F.lit(20.0)).alias("size_ok"), st.near_size(w, h, F.lit(30.0), F.lit(20.0), st.GOOD).alias("good"),
        st.near_place(w / 50, h / 49, centre, centre).alias("pos_ok"),
    )


def roll_evidence(spark: SparkSession, d: str) -> DataFrame:
    fits = table(spark, d, "lineitem").select("l_suppkey", F.col("l_discount").alias("edge"), (F.col("l_quantity") - 30).alias("dw"), (F.col("l_linenumber") * 9 - F.col("l_quantity")).alias("dh"))
    return st.roll_evidence(fits, "l_suppkey")


def correction_summary(spark: SparkSession, d: str) -> DataFrame:
    diffs = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") - 25).alias("dx"), (F.col("l_linenumber") * 9 - F.col("l_quantity")).alias("dw"))
    return st.correction_summary(diffs, ["l_suppkey"], {"dx": ("left", "right"), "dw": ("narrower", "wider")})


def least_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 100000).alias("score"), (F.col("l_quantity") > 20).alias("hit"))
    return st.least_threshold(rows, ["l_suppkey"], "score", "hit", 0.9)


def first_errors(spark: SparkSession, d: str) -> DataFrame:
    return st.first_errors(_images(spark, d).select("o_custkey", "id", "error"), ["o_custkey"], ["id"])


def label_sets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    labels = F.array((k % 5).cast("int"), (k % 7).cast("int"))
    merged = st.updated(F.create_map(F.lit("a"), k % 3, F.lit("b"), k % 4), F.create_map(F.lit("b"), k % 2, F.lit("c"), k % 6))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(st.relabelled(labels, F.array(F.lit(0), F.lit(1), F.lit(2)), (k % 3).cast("int")), ",").alias("labels"),
        F.arrays_overlap(labels, F.array(F.lit(3), F.lit(6))).alias("touches"), F.concat_ws(",", *(F.element_at(merged, F.lit(x)).cast("string") for x in "abc")).alias("merged"),
    )


def below_level(spark: SparkSession, d: str) -> DataFrame:
    xs = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", ar.below(xs, -100.0).alias("b")).select("vec_id", "b.first", "b.last")


_I = """i as (select o_custkey, o_orderkey as id, '/r/' || o_orderkey as path, case when o_orderkey % 4 = 0 then 'manual' end as method,
  case when o_orderkey % 3 = 0 then 'pending' when o_orderkey % 7 = 0 then 'error' else 'ok' end as status, case when o_orderkey % 7 = 0 then 'broken' end as error, o_totalprice as crop from orders)"""

QUERIES = {f.__name__: f for f in (plan_freeze, add_images, detection_upsert, accept_proposals, retry_and_close, settings_rule, stale_sources, read_model, plan_report, unreferenced, size_and_place, roll_evidence, correction_summary, least_threshold, first_errors, label_sets, below_level)}
ORACLE = {
    "plan_freeze": f"""with {_I} select o_custkey, count(*) as n, sha256('[' || string_agg('{{"id":' || id || ',"method":' || coalesce('"' || method || '"', 'null') || ',"path":"' || path || '","status":"' || status || '"}}', ',' order by id) || ']') as plan_sha256, true as complete from i group by 1""",
    "add_images": f"""with {_I}, n as (select o_custkey, path from i where id % 5 = 0 union all select o_custkey, path || 'b' from i), t as (select o_custkey, max(id) as top from i where id % 5 <> 0 group by 1)
select o_custkey, coalesce(top, 0) + row_number() over (partition by o_custkey order by path) as id, path, 'pending' as status, 'analyzing' as phase from n left join t using (o_custkey)""",
    "detection_upsert": f"""with {_I} select id, method, case when id % 6 = 0 or method = 'manual' then crop else crop * 2 end as crop, case when id % 6 = 0 then 'error' else 'ok' end as status, case when id % 6 = 0 then 'no result' end as error from i""",
    "accept_proposals": f"""with {_I} select id, case when id % 6 = 0 then crop + 1 else crop end as crop, case when id % 2 = 0 and id % 3 <> 0 then crop + 1 end as proposal, id % 6 = 0 as accepted from i""",
    "retry_and_close": f"""with {_I}, r as (select id, case when id % 14 = 0 then 'pending' else status end as retried, case when id % 14 = 0 then null else error end as e from i)
select id, retried, case when retried = 'pending' then 'not analysed' else e end as error, case when retried = 'pending' then 'error' else retried end as status from r""",
    "settings_rule": """select l_orderkey, l_linenumber, round_even(l_tax * 10.00049::double, 3) as t_green, least(round_even(l_discount * 10.00049::double, 3), round_even(l_tax * 10.00049::double, 3)) as t_yellow from lineitem""",
    "stale_sources": "select o_orderkey, o_orderkey % 5 <> 0 and (o_orderkey % 3 = 0 or o_orderkey % 13 = 0 or o_orderkey % 7 = 0 or o_orderkey % 11 = 0) as stale from orders",
    "read_model": f"with {_I} select o_custkey || '/' || id as key, path, id, case when id % 3 <> 0 then crop end as detected, case when id % 5 = 0 then crop + 1 end as reference from i",
    "plan_report": f"""with {_I}, r as (select id, path, case when id % 2 = 0 and id % 3 = 0 then 'skipped' when id % 14 = 0 then 'failed' else 'ok' end as status from i)
select *, status <> 'failed' as counts from r""",
    "unreferenced": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0)",
    "size_and_place": """with r as (select l_orderkey, l_linenumber, l_quantity::double as w, l_linenumber * 7.0::double as h from lineitem)
select l_orderkey, l_linenumber, abs(greatest(w, h) - 30) <= 0.2::double * 30 and abs(least(w, h) - 20) <= 0.2::double * 20 as size_ok,
  abs(greatest(w, h) - 30) <= 0.15::double * 30 and abs(least(w, h) - 20) <= 0.15::double * 20 as good,
  l_orderkey % 9 = 0 or (abs(w / 50 - 0.5::double) < 0.12::double and abs(h / 49 - 0.5::double) < 0.12::double) as pos_ok from r""",
    "roll_evidence": "select l_suppkey, median(l_discount::double) as edge, greatest(abs(median(l_quantity::double - 30)), abs(median(l_linenumber * 9 - l_quantity::double))) as pull from lineitem group by 1",
    "correction_summary": """with r as (select l_suppkey, l_quantity - 25 as dx, l_linenumber * 9 - l_quantity as dw from lineitem)
select l_suppkey, min(dx) as dx_min, max(dx) as dx_max, round_even(avg(dx), 6) as dx_mean, median(dx::double) as dx_median, case when avg(dx) < -2 then 'left' when avg(dx) > 2 then 'right' else 'ok' end as dx_bias,
  min(dw) as dw_min, max(dw) as dw_max, round_even(avg(dw), 6) as dw_mean, median(dw::double) as dw_median, case when avg(dw) < -2 then 'narrower' when avg(dw) > 2 then 'wider' else 'ok' end as dw_bias
from r group by 1""",
    "least_threshold": """with r as (select l_suppkey, l_extendedprice / 100000 as score, l_quantity > 20 as hit from lineitem),
t as (select distinct l_suppkey, round_even(score, 4) as t from r),
c as (select t.l_suppkey, t, count(*) as n_above, count(*) filter (hit) as hits from t join r on t.l_suppkey = r.l_suppkey and r.score >= t.t group by all)
select l_suppkey, t, n_above, hits from c where n_above >= 5 and hits >= 0.9::double * n_above qualify row_number() over (partition by l_suppkey order by t) = 1""",
    "first_errors": f"with {_I} select o_custkey, id, error, row_number() over w::int as nth from i window w as (partition by o_custkey order by error is null, id) qualify nth <= 8".replace("row_number() over w::int", "cast(row_number() over w as int)"),
    "label_sets": """select o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_filter([o_orderkey % 5, o_orderkey % 7], lambda x: x > 2), [o_orderkey % 3]))), ',') as labels,
  list_has_any([o_orderkey % 5, o_orderkey % 7], [3, 6]) as touches, (o_orderkey % 3) || ',' || (o_orderkey % 2) || ',' || (o_orderkey % 6) as merged from orders""",
    "below_level": """with u as (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)
select vec_id, cast(min(i) filter (floor(x::double * 1000) < -100) as int) as first, cast(max(i) filter (floor(x::double * 1000) < -100) as int) as last from u group by 1""",
}
