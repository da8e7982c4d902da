"""Scores against reference labels: sweeps, threshold choices, rank statistics and group-wise validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import evaluate as ev
from gristmill.operators import models
from gristmill.session import table

PRECISION = 0.86


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: a length score in 0..1 as the confidence, good quality as the hit, source as the group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp"), F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("conf"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "grp", "conf", (F.col("quality") == 1).alias("hit"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items against their part's medians."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    mids = items.groupBy("l_partkey").agg(F.median("l_quantity").alias("mq"), F.median("l_extendedprice").alias("mp"))
    return items.join(mids, "l_partkey").select("l_returnflag", "l_linestatus", (F.col("l_quantity") - F.col("mq")).alias("dq"), (F.col("l_extendedprice") - F.col("mp")).alias("dp"))


_SCORED = """scored as (select doc_id, source as grp, least(1.0::double, n_chars::double / 4000.0::double) as conf, quality = 1 as hit
  from documents join labels using (doc_id))"""
_GRID = "grid as (select (30 + i) / 100.0::double as t from range(0, 71) r(i))"
_DELTAS = """mids as (select l_partkey, median(l_quantity) as mq, median(l_extendedprice) as mp from lineitem group by 1),
deltas as (select l_returnflag, l_linestatus, l_quantity - mq as dq, l_extendedprice - mp as dp from lineitem join mids using (l_partkey))"""


def roc_sweep(spark: SparkSession, d: str) -> DataFrame:
    return ev.sweep(scored(spark, d), low=25, high=100, step=5)


def threshold_min_precision(spark: SparkSession, d: str) -> DataFrame:
    return ev.smallest_threshold(scored(spark, d), PRECISION)


def threshold_max_recall(spark: SparkSession, d: str) -> DataFrame:
    return ev.best_recall(scored(spark, d), PRECISION)


def auc_by_signal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    digits = F.char_length(F.regexp_replace("text", "[^0-9]", "")) / F.greatest(F.lit(1), F.char_length("text"))
    signals = {"n_chars": F.col("n_chars").cast("double"), "digit_share": digits, "n_lines": F.size(F.split("text", "\n")).cast("double")}
    long = docs.select((F.col("quality") == 1).alias("pos"), F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), c.alias("score")) for n, c in signals.items()))).alias("x")).select("pos", "x.*")
    return ev.auc(long, ["signal"], "score", "pos")


def three_way_confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(scored(spark, d))


def lofo_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ev.leave_one_out(scored(spark, d), "grp", PRECISION)


def split_eval(spark: SparkSession, d: str) -> DataFrame:
    return ev.split_eval(scored(spark, d), F.col("doc_id") % 2 == 0, PRECISION)


def hit_by_group_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = deltas(spark, d).withColumn("hit", ev.hit(F.col("dq"), F.col("dp") / 1000, 10.0))
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))


def bias_summary(spark: SparkSession, d: str) -> DataFrame:
    return ev.bias(deltas(spark, d), ["dq", "dp"])


def deltas_left_missing(spark: SparkSession, d: str) -> DataFrame:
    """References first: every document, with or without a label."""
    labels = table(spark, d, "labels")
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("missing"), F.sum("quality").alias("good"))


def symptom_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = deltas(spark, d)
    size, position = F.abs("dq") < 10, F.abs("dp") < 5000
    return rows.groupBy(ev.symptom(size, position).alias("symptom"), (size & position).alias("strict")).agg(F.count("*").alias("n"))


def baseline_gate(spark: SparkSession, d: str) -> DataFrame:
    now = scored(spark, d).groupBy("grp").agg(F.count_if(F.col("hit") & (F.col("conf") >= 0.3)).alias("hits"))
    base = scored(spark, d).where("doc_id % 2 = 0").groupBy("grp").agg((2 * F.count_if("hit")).alias("hits"))
    return ev.baseline_gate(now, base, "grp")


def argmin_factor(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("size_agree"), (1 - F.col("l_discount") * 10).alias("edge_score"), (F.col("l_tax") * 12.5).alias("film_trust"))
    return rows.groupBy(ev.weakest_factor(["size_agree", "edge_score", "film_trust"]).alias("factor")).agg(F.count("*").alias("n"))


def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    conf = F.col("conf")
    low = F.when(conf >= 0.9, 0.9).when(conf >= 0.7, 0.7).when(conf >= 0.5, 0.5).otherwise(0.0)
    return scored(spark, d).groupBy(low.alias("low")).agg(F.count("*").alias("n"))


def session_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters by automatic band, with the total."""
    rows = scored(spark, d).withColumn("band", ev.band(F.col("conf")))
    return ev.summary(rows, "band", "conf", "hit")


def nested_lofo(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.log1p("n_chars").alias("a"), (F.size(F.split("text", "\n")) / F.greatest(F.lit(1), F.col("n_chars"))).alias("b"))
    rows = docs.join(scored(spark, d).select("doc_id", "hit"), "doc_id")
    return models.nested_leave_one_out(rows, "lang", ["a", "b"], PRECISION)


def _extents(orders: DataFrame) -> DataFrame:
    return orders.select((F.col("o_totalprice") / 10007).alias("w_mm"), (F.col("o_totalprice") / 15013 + 3).alias("h_mm"))


def learned_extent(spark: SparkSession, d: str) -> DataFrame:
    return ev.learned_extent(_extents(table(spark, d, "orders")))


_PICK = f"n >= 5 and h >= {PRECISION}::double * n"
QUERIES = {f.__name__: f for f in (roc_sweep, threshold_min_precision, threshold_max_recall, auc_by_signal, three_way_confusion, lofo_threshold, split_eval, hit_by_group_rollup, bias_summary, deltas_left_missing, symptom_counts, baseline_gate, argmin_factor, histogram_bins, session_summary, nested_lofo, learned_extent)}
ORACLE = {
    "roc_sweep": f"""with {_SCORED},
grid as (select (100 - 5 * i) / 100.0::double as t from range(0, 16) r(i)),
total as (select count(*) filter (hit) as hits from scored)
select t, count(*) as n, count(*) filter (hit) as n_hits, count(*) filter (hit) / count(*)::double as precision,
  count(*) filter (hit) / (select hits from total)::double as recall
from grid join scored on conf >= t group by t""",
    "threshold_min_precision": f"""with {_SCORED}, {_GRID},
c as (select t, count(*) as n, count(*) filter (hit) as h from grid join scored on conf >= t group by t)
select t, n, h as n_hits from c where {_PICK} order by t limit 1""",
    "threshold_max_recall": f"""with {_SCORED},
c as (select s.conf, (select count(*) from scored r where r.conf >= s.conf) as n, (select count(*) from scored r where r.conf >= s.conf and hit) as h
  from (select distinct conf from scored) s)
select conf, n, h as n_hits from c where h >= {PRECISION}::double * n order by h desc, conf desc limit 1""",
    "auc_by_signal": """with s as (
  select quality = 1 as pos, unnest([{'signal': 'n_chars', 'score': n_chars::double},
    {'signal': 'digit_share', 'score': length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(text))::double},
    {'signal': 'n_lines', 'score': len(string_split(text, chr(10)))::double}], recursive := true)
  from documents join labels using (doc_id)),
r as (select signal, pos, rank() over (partition by signal order by score) + (count(*) over (partition by signal, score) - 1) / 2.0::double as rk from s),
g as (select signal, count(*) filter (pos) as p, count(*) filter (not pos) as q, sum(rk) filter (pos) as rs from r group by signal)
select signal, p as n_pos, q as n_neg, (rs - p * (p + 1) / 2.0::double) / (p * q)::double as auc from g""",
    "three_way_confusion": f"""with {_SCORED},
c as (select unnest(['green', 'yellow', 'red']) as band), e as (select band, hit from c, (select unnest([true, false]) as hit)),
b as (select case when conf >= 0.5 then 'green' when conf >= 0.3 then 'yellow' else 'red' end as band, hit, count(*) as n from scored group by all)
select band, hit, coalesce(n, 0) as n from e left join b using (band, hit)""",
    "lofo_threshold": f"""with {_SCORED}, {_GRID}, g as (select distinct grp from scored),
c as (select g.grp, t, count(*) as n, count(*) filter (hit) as h from g, grid join scored s on s.conf >= t where s.grp <> g.grp group by g.grp, t),
p as (select grp, min(t) as t from c where {_PICK} group by grp)
select s.grp, any_value(p.t) as t, count(*) as n, count(*) filter (hit) as hits,
  count(*) filter (conf >= p.t) as green, count(*) filter (conf >= p.t and hit) as green_hits
from scored s left join p using (grp) group by s.grp""",
    "split_eval": f"""with {_SCORED}, {_GRID},
c as (select t, count(*) as n, count(*) filter (hit) as h from grid join scored on conf >= t where doc_id % 2 = 0 group by t),
p as (select min(t) as t from c where {_PICK})
select case when doc_id % 2 = 0 then 'tuning' else 'holdout' end as part, p.t, count(*) as n, count(*) filter (hit) as hits,
  count(*) filter (conf >= p.t) as green, count(*) filter (conf >= p.t and hit) as green_hits
from scored, p where p.t is not null group by all""",
    "hit_by_group_rollup": f"""with {_DELTAS}
select l_returnflag, l_linestatus, count(*) as n, count(*) filter (abs(dq) < 10 and abs(dp / 1000) < 10) as hits
from deltas group by rollup (l_returnflag, l_linestatus)""",
    "bias_summary": f"""with {_DELTAS}, u as (select 'dq' as delta, dq as v from deltas union all select 'dp', dp from deltas)
select delta, count(v) as n, median(v) as median, round(avg(v), 6) as mean, min(v) as low, max(v) as high from u group by delta""",
    "deltas_left_missing": """select source, count(*) as n, count(*) filter (quality is null) as missing, sum(quality)::bigint as good
from documents left join labels using (doc_id) group by source""",
    "symptom_counts": f"""with {_DELTAS}, s as (select abs(dq) < 10 as a, abs(dp) < 5000 as b from deltas)
select case when a and b then 'ok' when not a and not b then 'size+position' when not a then 'size' else 'position at correct size' end as symptom,
  a and b as strict, count(*) as n from s group by all""",
    "baseline_gate": f"""with {_SCORED},
a as (select grp, count(*) filter (hit and conf >= 0.3) as hits from scored group by grp),
b as (select grp, 2 * count(*) filter (hit) as expected from scored where doc_id % 2 = 0 group by grp)
select grp, hits, expected, hits < expected as worse from a join b using (grp)""",
    "argmin_factor": """with f as (select l_quantity / 50 as a, 1 - l_discount * 10 as b, l_tax * 12.5::double as c from lineitem)
select case when a <= b and a <= c then 'size_agree' when b <= c then 'edge_score' else 'film_trust' end as factor, count(*) as n from f group by 1""",
    "histogram_bins": f"""with {_SCORED}
select case when conf >= 0.9 then 0.9::double when conf >= 0.7 then 0.7 when conf >= 0.5 then 0.5 else 0.0 end as low, count(*) as n from scored group by 1""",
    "session_summary": f"""with {_SCORED}, b as (select *, case when conf >= 0.5 then 'green' when conf >= 0.3 then 'yellow' else 'red' end as band from scored)
select band, count(*) as n, count(*) filter (hit) as hits, median(conf) as mid from b group by grouping sets ((band), ())""",
    "learned_extent": """with r as (select o_totalprice / 10007 as w, o_totalprice / 15013 + 3 as h from orders),
f as (select greatest(w, h) as l, least(w, h) as s from r where greatest(w, h) / greatest(least(w, h), 1e-6) > 0.6 and greatest(w, h) / greatest(least(w, h), 1e-6) < 2.0 and greatest(w, h) > 30)
select count(*) as n, round_even(list_sort(list(l))[count(*) // 2 + 1], 2) as long_mm, round_even(list_sort(list(s))[count(*) // 2 + 1], 2) as short_mm from f having count(*) >= 3""",
}
