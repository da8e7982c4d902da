"""Robust statistics and group consensus over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import consensus as co
from gristmill.operators import robust as ro
from gristmill.session import table


def dense_center(spark: SparkSession, d: str) -> DataFrame:
    return ro.dense_center(table(spark, d, "lineitem").select("l_partkey", "l_extendedprice"), ["l_partkey"], "l_extendedprice")


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Event values in whole hundredths, so that gaps are exact."""
    return table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("v"))


def chain_clusters(spark: SparkSession, d: str) -> DataFrame:
    return ro.chains(_whole(spark, d), ["user_id"], "v", 500).where("n >= 2")


def largest_chain(spark: SparkSession, d: str) -> DataFrame:
    return ro.largest_chain(_whole(spark, d), ["user_id"], "v", 500)


def mad_trust(spark: SparkSession, d: str) -> DataFrame:
    return ro.mad_trust(_whole(spark, d).where("v > 0"), ["user_id"], "v")


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return ro.upper_median(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", 3)


def median_or_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
    return ro.median_or_zero(rows, ["o_custkey"], "v")


def p25_linear(spark: SparkSession, d: str) -> DataFrame:
    return ro.quartile(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return ro.weighted_median(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_quantity")


def aspect_consensus(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 150001.7).alias("aspect"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") % 997).alias("contrast"))
    return co.aspect_consensus(orders, ["o_custkey"], "aspect", "contrast", "o_orderkey")


def format_buckets(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("v"))
    return co.buckets(per, "v", 0.0005)


def cross_group_pool_clamp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("bucket"), F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("v"))
    return co.pool_clamp(rows, "grp", "bucket", "v")


def position_prior(spark: SparkSession, d: str) -> DataFrame:
    return co.position_prior(_whole(spark, d), ["event_type"], "v", F.col("user_id") % 3 == 0)


def majority(spark: SparkSession, d: str) -> DataFrame:
    return co.majority(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "O")


def score_piecewise(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    deviation = co.shape_deviation(F.col("l_quantity") + 25, F.lit(40.0), 1.5)
    score = co.candidate_score(deviation, F.col("l_discount") * 10, F.col("l_tax") > 0.02)
    return rows.groupBy(score.alias("score")).agg(F.count("*").alias("n"))


def candidate_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    conf = co.candidate_confidence(F.col("l_tax") * 12.5, F.col("l_discount") * 10, F.col("l_quantity") / 50, F.lit(0.5), F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", conf.alias("conf"))


def confidence_v4(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    contrast = F.when(F.col("l_linenumber") != 3, F.col("l_quantity"))
    roll = co.reliability(F.col("l_tax") * 12.5, F.col("l_discount"), F.col("l_discount") / 2) * 0.5
    return rows.select("l_orderkey", "l_linenumber", co.confidence(F.col("l_quantity") / 50.0317, F.col("l_discount") * 10, contrast, roll).alias("conf"))


def scale_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    agree = F.when(F.col("l_linenumber") != 2, F.col("l_discount") / 4)
    pitch = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    ok = co.scale_accepted(pitch, agree, F.col("l_tax") * 8, F.col("l_linenumber"))
    factor = F.bround(co.scaled_roll_factor(F.col("l_tax") * 8, F.coalesce(agree, F.lit(1.0))), 6)
    return rows.groupBy(ok.alias("accepted"), factor.alias("factor")).agg(F.count("*").alias("n"))


_V = "v as (select user_id, event_type, event_id, round(value * 100)::bigint as v from events)"
_CHAIN = f"""with {_V}, g as (select *, case when v - lag(v) over w <= 500 then 0 else 1 end as b from v where v is not null window w as (partition by user_id order by v)),
c as (select *, sum(b) over (partition by user_id order by v) as chain from g),
k as (select user_id, chain::bigint as chain, count(*) as n, median(v) as median, min(v) as low, max(v) as high from c group by user_id, chain)"""


def _ramp(x: str, a: float, b: float, c: float, d: float) -> str:
    return f"({c}::double + least(1.0::double, greatest(0.0::double, ({x} - {a}::double) / {b - a!r}::double)) * {d - c!r}::double)"


_SHAPE = "least(abs((l_quantity + 25) / 40.0::double - 1.5::double) / 1.5::double, abs((l_quantity + 25) / 40.0::double - (1 / 1.5::double)) * 1.5::double)"

QUERIES = {f.__name__: f for f in (dense_center, chain_clusters, largest_chain, mad_trust, upper_median, median_or_zero, p25_linear, weighted_median, aspect_consensus, format_buckets, cross_group_pool_clamp, position_prior, majority, score_piecewise, candidate_confidence, confidence_v4, scale_gate)}
ORACLE = {
    "dense_center": """with m as (select l_partkey, median(l_extendedprice) as m, count(*) as n from lineitem group by 1),
s as (select l_partkey, l_extendedprice as v, l_extendedprice / (m * 0.035::double) as x, n from lineitem join m using (l_partkey) where n > 2 and m > 0),
c as (select *, count(*) over (partition by l_partkey order by x range between current row and 1 following) as c from s),
f as (select l_partkey, x as lo from c qualify row_number() over (partition by l_partkey order by c desc, x) = 1)
select l_partkey, median(v) as center, any_value(n) as n from s join f using (l_partkey) where x between lo and lo + 1 group by l_partkey
union all select l_partkey, m, n from m where n <= 2 or m <= 0""",
    "chain_clusters": f"{_CHAIN} select * from k where n >= 2",
    "largest_chain": f"{_CHAIN} select user_id, n, median from k qualify row_number() over (partition by user_id order by n desc, chain) = 1",
    "mad_trust": f"""with {_V}, m as (select user_id, median(v) as center, count(v) as n from v where v > 0 group by 1),
d as (select user_id, n, center, median(abs(v - center)) as mad from v join m using (user_id) where v > 0 group by all)
select user_id, n, center, mad, greatest(0.4::double, 1 - 2 * (mad / center)) * least(1.0::double, n / 8.0::double) as trust from d where center > 0""",
    "upper_median": """select o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] as upper_median, count(*) as n from orders group by 1 having count(*) >= 3""",
    "median_or_zero": "select o_custkey, coalesce(median(o_totalprice) filter (o_orderstatus = 'F'), 0.0::double) as median from orders group by 1",
    "p25_linear": "select o_orderpriority, quantile_cont(o_totalprice, 0.25) as quantile from orders group by 1",
    "weighted_median": """with p as (select l_suppkey, l_discount, sum(l_quantity) as w from lineitem group by all),
r as (select *, sum(w) over (partition by l_suppkey order by l_discount) as run, sum(w) over (partition by l_suppkey) as total from p)
select l_suppkey, min(l_discount) as weighted_median from r where run >= total / 2 group by 1""",
    "aspect_consensus": """with r as (select o_custkey, o_orderkey, o_totalprice / 150001.7::double as a, case when o_orderstatus <> 'P' then o_totalprice % 997 end as c from orders),
n as (select o_custkey, o_orderkey, case when a >= 1 then a else 1 / a end as a, abs(c) as c from r where a > 0 and c is not null),
b as (select o_custkey, count(*) as n_valid, first(a order by c desc, o_orderkey) as best from n group by 1),
m as (select o_custkey, n_valid, median(a) filter (abs(a - best) <= 0.10::double * best) as m from n join b using (o_custkey) group by 1, 2)
select o_custkey, coalesce(n_valid, 0) as n_valid, case when n_valid >= 3 then round_even(m, 4) else 1.5::double end as aspect_ratio,
  case when n_valid >= 3 then 'measured' else 'fallback' end as origin
from (select distinct o_custkey from orders) left join m using (o_custkey)""",
    "format_buckets": """with p as (select c_nationkey, max(c_acctbal) as v from customer where c_acctbal > 0 group by 1),
g as (select *, case when (v - lag(v) over (order by v)) / lag(v) over (order by v) > 0.0005::double then 1 else 0 end as b from p)
select c_nationkey, v, sum(b) over (order by v)::bigint as bucket from g""",
    "cross_group_pool_clamp": """with r as (select l_suppkey % 7 as bucket, l_suppkey as grp, l_quantity as v from lineitem),
o as (select bucket, grp, median(v) as own, count(*) as n from r group by all),
p as (select o.bucket, o.grp, median(r.v) as pool, count(*) as m from o join r on r.bucket = o.bucket and r.grp <> o.grp group by all having count(*) >= 10)
select o.bucket, o.grp, n, own, pool, case when own > 1.03::double * pool then pool else own end as clamped from o left join p using (bucket, grp)""",
    "position_prior": f"with {_V} select event_type, median(v) filter (user_id % 3 = 0) as prior, count(*) filter (user_id % 3 = 0) as n_good from v group by 1",
    "majority": "select o_custkey, 2 * count(*) filter (o_orderstatus = 'O') >= count(*) as first_kind from orders group by 1",
    "score_piecewise": f"""with s as (select {_SHAPE} as d, l_discount * 10 as a, l_tax > 0.02 as m from lineitem)
select round_even(least(1.0::double, (case when d < 0.05 then 1.0::double when d < 0.15 then 0.9 when d < 0.30 then 0.65 else 0.3 end)
  * (case when d < 0.10 then case when a > 0.20 and a < 0.99 then 1.0::double when a >= 0.99 then 0.85 else 0.75 end
     else case when a > 0.30 and a < 0.92 then 1.0::double when a > 0.15 and a < 0.95 then 0.75 else 0.4 end end)
  * (case when m then 1.0::double when d < 0.10 and a > 0.90 then 0.90 else 0.8 end)), 3) as score, count(*) as n from s group by 1""",
    "candidate_confidence": """select l_orderkey, l_linenumber, round_even((0.35::double * (l_tax * 12.5::double)
  + 0.65::double * (0.50::double * (l_discount * 10) + 0.20::double * (l_quantity / 50) + 0.15::double * 0.5::double))
  * greatest(0.7::double, 1 - 3 * l_discount), 3) as conf from lineitem""",
    "confidence_v4": f"""select l_orderkey, l_linenumber, round_even(least(1.0::double, greatest(0.0::double,
  (0.5::double * (l_quantity / 50.0317::double) + 0.5::double * (l_discount * 10))
  * case when l_linenumber = 3 then 0.45::double else least(1.0::double, greatest(0.45::double, 0.45::double + 0.55::double * (l_quantity - 8.0::double) / 22.0::double)) end
  * ({_ramp("l_tax * 12.5::double", 0.55, 0.85, 0.15, 1.0)} * {_ramp("l_discount", 0.03, 0.07, 1.0, 0.4)} * {_ramp("l_discount / 2", 0.03, 0.10, 1.0, 0.4)} * 0.5::double))), 3) as conf from lineitem""",
    "scale_gate": f"""with r as (select case when l_linenumber <> 2 then l_discount / 4 end as agree, case when l_linenumber <> 7 then l_quantity end as pitch, l_tax * 8 as score, l_linenumber as n from lineitem)
select coalesce(case when pitch is null then false when agree > 0.02::double then false when agree < 0.002::double then true else score >= 0.30::double + case when n < 3 then 0.20::double else 0.0::double end end, false) as accepted,
  round_even(case when coalesce(agree, 1.0::double) < 0.002::double then 1.0::double else {_ramp("score", 0.30, 0.60, 0.6, 1.0)} end, 6) as factor, count(*) as n from r group by all""",
}
