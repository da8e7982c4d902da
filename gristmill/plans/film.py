"""Films, their reviews and what is written for an image, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import film as fi
from gristmill.session import table


def line_groups(spark: SparkSession, d: str) -> DataFrame:
    return fi.line_groups(table(spark, d, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 20000.0)


def film_consistency(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("l_orderkey"), lambda x: F.col(x).cast("double")
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", (c("l_linenumber") * 3).alias("x"), (c("l_discount") * 100 + 5).alias("y"), (c("l_quantity") + 40).alias("width"),
        (c("l_linenumber") + 40).alias("height"), F.when(k % 11 != 0, 200.0).alias("img_w"), F.when(k % 11 != 0, 120.0).alias("img_h"), (c("l_tax") * 10).alias("confidence"),
    )
    s = F.col("s_suppkey")
    aspects = table(spark, d, "supplier").where(s % 3 != 0).select(s.alias("l_suppkey"), F.when(s % 3 == 1, 1 / 1.5).otherwise(2.5).alias("aspect"))
    return fi.consistent(rows, "l_suppkey", aspects)


def measured_aspects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    measured = table(spark, d, "orders").select("o_orderkey", "o_custkey", (k % 3 != 0).alias("valid"), F.col("o_totalprice").alias("contrast"))
    return fi.with_aspect(measured, table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("aspect")), "o_custkey", 1.5)


def review_upsert(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    red = F.when(k % 5 == 0, "red")
    images = table(spark, d, "orders").where((k % 2 == 0) | (k % 3 != 0)).select(
        k.alias("key"), F.when(k % 4 == 0, p).alias("manual"), F.when(k % 7 != 0, p + 1).alias("detected"), (k % 11 != 0).alias("sized"), F.when(k % 3 == 0, "accept").alias("decision"),
        F.coalesce(red, F.lit("green")).alias("group"), red.alias("group_override"), (k % 13).cast("double").alias("deg"),
    )
    reviews = table(spark, d, "orders").where(k % 3 == 0).select(k.alias("key"), (p - 1).alias("manual_crop"), F.when(k % 9 == 0, True).alias("is_problem"), F.when(k % 6 == 0, False).alias("confirmed"), F.lit(2.5).alias("tilt_deg"), F.lit("n").alias("note"))
    return fi.reviewed(images, reviews)


def _listed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = table(spark, d, "orders").select("o_orderkey", F.when(k % 7 != 0, k % 3 == 0).alias("needs_review"))
    return fi.listed(results, table(spark, d, "orders").where(k % 4 == 0).select("o_orderkey", (k % 8 == 0).alias("is_problem")), "o_orderkey")


def review_filter(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d)


def review_counts(spark: SparkSession, d: str) -> DataFrame:
    return fi.review_counts(_listed(spark, d))


def review_lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = table(spark, d, "orders").select("o_orderkey", ((k % 1000) / 1000).alias("confidence"), F.lit("edge").alias("method"), F.when(k % 2 == 0, "Landscape").alias("orientation"))
    reviews = table(spark, d, "orders").where(k % 3 == 0).select("o_orderkey", (k % 5 == 0).alias("is_problem"), F.when(k % 7 == 0, "look").alias("note"), F.when(k % 6 == 0, k % 400).alias("crop_w"), F.when(k % 6 == 0, k % 300).alias("crop_h"))
    return fi.review_lines(results, reviews, "o_orderkey")


def weak_agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 5 == 0).alias("missing"), "l_quantity")
    return fi.weak_agreement(rows, "l_suppkey", F.col("l_quantity") < 30)


def scorers(spark: SparkSession, d: str) -> DataFrame:
    c = lambda x: F.col(x).cast("double")
    by = fi.scorers(c("l_tax"), c("l_discount"), c("l_quantity") / 50, c("l_linenumber") / 7)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in by.items()))


def calibration_samples(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    name = F.concat(F.lit("f"), (k % 500).cast("string"))
    results = table(spark, d, "orders").select(k.alias("nth"), name.alias("filename"), F.when(k % 17 != 0, p / 1000).alias("width"), (p / 1500).alias("height"), F.when(k % 13 != 0, k % 10).alias("parts"))
    references = table(spark, d, "orders").select(F.concat(F.lit("r"), k.cast("string"), F.lit("/"), name).alias("key"), F.when(k % 3 != 0, p / 1000).alias("w"), (p / 1500).alias("h"))
    return fi.samples(results, references, "nth", 60.0)


def image_actions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    some = lambda n, v: F.when(k % n == 0, v)
    steps = fi.history_steps(k % 2 == 0, some(3, k), some(5, k % 4), k % 7 == 0, some(4, F.lit(1)))
    path = F.concat(F.lit("/r/a"), F.element_at(F.array(*map(F.lit, (".NEF", ".dng", ".jpg", ""))), (k % 4 + 1).cast("int")))
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(F.transform(steps, lambda s: F.concat(s["operation"], F.lit(":"), s["enabled"].cast("string"))), ",").alias("steps"), fi.not_compatible(path).alias("reason"),
        fi.would_apply(some(3, "skip"), some(11, "error"), some(2, k), some(7, k), some(5, "red")).alias("applies"),
        F.array_join(F.transform(fi.strip_cells(k % 90, (k % 8) / 8), lambda x: x.cast("string")), ",").alias("cells"),
    )


def copy_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("i"), (k % 40).cast("string"), F.element_at(F.array(*map(F.lit, (".NEF", ".JPG", ".gif"))), (k % 3 + 1).cast("int")))
    images = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("c/"), (F.col("o_custkey") % 50).cast("string"), F.lit(" ? ")).alias("film"), name.alias("filename"))
    return fi.copy_names(images, "id")


QUERIES = {f.__name__: f for f in (line_groups, film_consistency, measured_aspects, review_upsert, review_filter, review_counts, review_lines, weak_agreement, scorers, calibration_samples, image_actions, copy_names)}

_LISTED = """l as (select a.o_orderkey, coalesce(a.o_orderkey % 7 <> 0 and a.o_orderkey % 3 = 0, false) or a.o_orderkey % 8 = 0 as in_review, a.o_orderkey % 8 = 0 as in_problem from orders a)"""

ORACLE = {
    "line_groups": """with m as (select o_custkey, o_totalprice as v, case when o_totalprice - lag(o_totalprice) over w < 20000 then 0 else 1 end as b from orders window w as (partition by o_custkey order by o_totalprice)),
g as (select *, sum(b) over (partition by o_custkey order by v) as g from m) select o_custkey, g::bigint as "group", count(*) as n, avg(v) as mean from g group by o_custkey, g""",
    "film_consistency": """with r as (select l_suppkey, l_orderkey, l_linenumber, l_linenumber * 3.0::double as x, l_discount::double * 100 + 5 as y, l_quantity::double + 40 as width, l_linenumber::double + 40 as height,
  case when l_orderkey % 11 <> 0 then 200.0::double end as img_w, case when l_orderkey % 11 <> 0 then 120.0::double end as img_h, l_tax::double * 10 as confidence,
  case when l_suppkey % 3 = 1 then 1 / (1 / 1.5::double) when l_suppkey % 3 = 2 then 2.5::double end as f from lineitem),
s as (select *, x / coalesce(img_w, x + width + 100) as rx, y / coalesce(img_h, y + height + 100) as ry, width / coalesce(img_w, x + width + 100) as rw, height / coalesce(img_h, y + height + 100) as rh,
  greatest(width / height, 1 / (width / height)) as a from r),
m as (select l_suppkey, median(rx) as mx, median(ry) as my, median(rw) as mw, median(rh) as mh from s group by l_suppkey
  having count(*) >= 3 and (any_value(f) is null or (abs(median(a) - any_value(f)) / any_value(f) <= 0.15::double and count(*) filter (abs(a - f) / f < 0.2::double) >= 3))),
t as (select s.*, mx, my, mw, mh, coalesce(greatest(abs(rx - mx) / greatest(mx, 0.01::double), abs(ry - my) / greatest(my, 0.01::double), abs(rw - mw) / greatest(mw, 0.01::double), abs(rh - mh) / greatest(mh, 0.01::double)) > 0.15::double, false) as moved
  from s left join m using (l_suppkey))
select l_suppkey, l_orderkey, l_linenumber, img_w, img_h, moved, case when moved then floor(mx * coalesce(img_w, width)) else x end as x, case when moved then floor(my * coalesce(img_h, width)) else y end as y,
  case when moved then floor(mw * coalesce(img_w, width)) else width end as width, case when moved then floor(mh * coalesce(img_h, width)) else height end as height,
  case when moved then round_even(greatest(0.3::double, confidence * 0.9::double), 3) else confidence end as confidence from t""",
    "measured_aspects": "select o_custkey, o_orderkey, o_orderkey % 3 <> 0 as valid, case when o_orderkey % 3 <> 0 then o_totalprice end as contrast, coalesce(c_acctbal, 1.5) as aspect from orders left join customer on o_custkey = c_custkey and c_custkey % 2 = 0",
    "review_upsert": """with i as (select o_orderkey as k, o_totalprice as p, case when o_orderkey % 2 <> 0 and o_orderkey % 3 = 0 then null when o_orderkey % 4 = 0 and o_orderkey % 11 <> 0 then 'manual'
  when o_orderkey % 3 = 0 and o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 then 'accept' when o_orderkey % 5 = 0 then 'red' end as kind from orders)
select k as key, case when k % 3 = 0 then 'n' end as note, case when kind = 'manual' then p when kind = 'accept' then p + 1 when k % 3 = 0 then p - 1 end as manual_crop,
  case when kind = 'red' or (kind = 'manual' and k % 5 = 0) then true when k % 9 = 0 then true end as is_problem, case when kind = 'accept' then true when k % 6 = 0 then false end as confirmed,
  case when kind in ('manual', 'accept') then case when k % 13 <> 0 then (k % 13)::double end when k % 3 = 0 then 2.5::double end as tilt_deg from i where kind is not null or k % 3 = 0""",
    "review_filter": f"with {_LISTED} select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderkey % 3 = 0 end as needs_review, in_review, not in_review as in_ok, in_problem from l",
    "review_counts": f"with {_LISTED} select count(*) as total, count(*) filter (in_problem) as problems, count(*) filter (not in_problem) as ok from l",
    "review_lines": """with r as (select o_orderkey as k from orders where o_orderkey % 3 = 0)
select k as o_orderkey, '| ' || k || ' | 0.' || lpad((k % 1000)::varchar, 3, '0') || ' | edge | ' || case when k % 2 = 0 then 'Landscape' else '' end || ' | ' || case when k % 5 = 0 then 'Problem' when k % 7 = 0 then 'Notiz' else 'Crop-Adj' end || ' | ' ||
  case when k % 6 = 0 then (k % 400) || 'x' || (k % 300) else '-' end || ' | ' || case when k % 7 = 0 then 'look' else '' end || ' |' as line from r where k % 5 = 0 or k % 7 = 0 or k % 6 = 0""",
    "weak_agreement": "select l_suppkey, count(*) filter (l_quantity < 30) as hits, count(*) as n from lineitem where l_orderkey % 5 <> 0 group by rollup (l_suppkey)",
    "scorers": """with r as (select l_orderkey, l_linenumber, l_tax::double as c, l_discount::double as s, l_quantity::double / 50 as e, l_linenumber::double / 7 as x from lineitem)
select l_orderkey, l_linenumber, c as current, e as edge, 0.5::double * s + 0.5::double * e as v2, (0.5::double * s + 0.5::double * e) * x as v3 from r""",
    "calibration_samples": """with b as (select o_orderkey as k, o_totalprice as p, o_orderkey % 500 as f from orders), l as (select * from b qualify row_number() over (partition by f order by k desc) = 1)
select 'r' || b.k || '/f' || b.f as key, l.k % 10 as parts, case when abs(l.p / 1000 - b.p / 1000) < 60 and abs(l.p / 1500 - b.p / 1500) < 60 then 1.0::double else 0.0::double end as y
from b join l using (f) where b.k % 3 <> 0 and l.k % 17 <> 0 and l.k % 13 <> 0""",
    "image_actions": """with r as (select o_orderkey as k, case when o_orderkey % 4 = 0 then 'ashift:false,' else '' end as off, o_orderkey % 5 = 0 and o_orderkey % 4 <> 0 as turns, greatest(1, least(o_orderkey % 90, 60)) as n from orders)
select k as o_orderkey, case when k % 6 = 0 then case when turns then 'ashift:true,' else off end || 'crop:true' when k % 7 = 0 then off || 'crop:false' else '' end as steps, case when k % 4 <> 0 then 'not_raw' end as reason,
  k % 3 <> 0 and k % 11 <> 0 and (k % 2 = 0 or k % 7 = 0) and not (k % 5 = 0 and k % 7 <> 0) as applies,
  array_to_string(list_transform(range(n), lambda i: case when i < floor((k % 8) / 8::double * n + 1e-9::double) then 'true' else 'false' end), ',') as cells from r""",
    "copy_names": r"""with r as (select o_orderkey as id, 'c/' || (o_custkey % 50) || ' ? ' as film, 'i' || (o_orderkey % 40) as s, (['.NEF', '.JPG', '.gif'])[o_orderkey % 3 + 1] as e from orders),
n as (select id, film, s || e as filename, trim(regexp_replace(film, '[^\w.\- ]+', '_', 'g')) as d, s, case when e = '.JPG' then '.jpg' else '.jpg' end as x from r)
select id, film, filename, d || '/' || s || case when row_number() over (partition by d, s, x order by id) > 1 then '__' || id else '' end || x as copy from n""",
}
