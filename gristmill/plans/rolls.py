"""Rolls, what sessions show and undo of them, and references, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import sidecar as sc
from gristmill.operators import rolls as ro
from gristmill.session import table


def roll_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("w"), (F.col("l_quantity") * 300).alias("h"))
    k = F.col("p_partkey")
    known = table(spark, d, "part").select(k.alias("l_partkey"), F.when(k % 3 != 0, 0.1).alias("pitch"), F.when(k % 4 != 0, (k % 30) / 1000).alias("agree"), ((k % 10) / 10).alias("score"), F.when(k % 5 == 0, F.lit(0.5)).alias("aspect"))
    return ro.roll_sizes(rows, "l_partkey", known)


def film_analysis(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_suppkey", k.alias("image"), (F.col("l_linenumber") == 1).alias("refined"), F.when(k % 17 != 0, F.col("l_quantity") + 60).alias("w"), (F.col("l_linenumber") * 4 + 50).alias("h"))
    return ro.film_analysis(rows, "l_suppkey", "image")


def undo_operations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    history = table(spark, d, "orders").select("o_custkey", (k % 6).alias("op"), k.alias("id"))
    chosen = history.where("id % 5 = 0").select("o_custkey", "id")
    whole = ro.undone(history, ["o_custkey"], "op", "id").withColumnRenamed("reverted", "by_session")
    part = ro.undone(history, ["o_custkey"], "op", "id", chosen).select("id", F.col("reverted").alias("by_selection"))
    return whole.join(part, "id")


def _images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderpriority", k.alias("id"), F.when(k % 3 == 0, k).alias("proposal"), F.element_at(F.array(*map(F.lit, ("green", "yellow", "red"))), (k % 3 + 1).cast("int")).alias("group"),
        F.when(k % 4 == 0, k).alias("manual"), F.when(k % 5 != 0, F.when(k % 5 < 3, "accept").otherwise("skip")).alias("decision"), F.when(k % 7 == 0, "skipped").when(k % 11 == 0, "error").otherwise("ok").alias("status"),
        (k % 13).alias("film"),
    )


def gallery_counts(spark: SparkSession, d: str) -> DataFrame:
    return ro.gallery_counts(_images(spark, d), ["o_orderpriority"])


def manual_differences(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("l_orderkey"), F.col("l_linenumber")
    results = table(spark, d, "lineitem").select(k.alias("key"), c.alias("nth"), (c * 2).alias("x"), (c * 3).alias("y"), F.col("l_quantity").alias("width"), (c * 5).alias("height"), F.when(k % 3 != 0, "edge").alias("method"), F.when(k % 4 != 0, F.col("l_tax")).alias("confidence"))
    o = F.col("o_orderkey")
    reviews = table(spark, d, "orders").select(o.alias("key"), (o % 9).alias("mx"), (o % 7).alias("my"), F.when(o % 5 != 0, o % 50).alias("mw"), (o % 40).alias("mh"))
    return ro.manual_differences(results, reviews, "key", "nth")


def filename_labels(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("o_orderkey"), lambda c: F.concat(F.lit("f"), (c % 700).cast("string"))
    results = table(spark, d, "orders").select(name(k).alias("filename"), F.when(k % 3 != 0, k).alias("x"), F.when(k % 4 != 0, k).alias("width"), F.when(k % 6 != 0, (k % 100) / 100).alias("confidence"))
    images = table(spark, d, "customer").select(name(F.col("c_custkey")).alias("filename"), F.col("c_custkey").alias("id"))
    return ro.labelled(results, images, "id")


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    box = F.struct((k % 90).alias("x"), (k % 80).alias("y"), (k % 700 + 9).alias("width"), (k % 500 + 7).alias("height"))
    return table(spark, d, "orders").select(
        k.alias("nth"), F.concat(F.lit("/p/"), (k % 9000).cast("string")).alias("path"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("film"), F.concat(F.lit("i"), (k % 3).cast("string"), F.lit(".NEF")).alias("file"),
        F.col("o_orderstatus").alias("session"), (k % 1000 + 1001).alias("w"), (k % 600 + 901).alias("h"), (k % 2 == 0).alias("corrected"), F.when(k % 8 != 0, box).alias("manual"), (k % 3 != 0).alias("will_apply"),
        F.element_at(F.array(*map(F.lit, ("applied", "locked", "reviewing"))), (k % 3 + 1).cast("int")).alias("phase"), F.when(k % 5 < 2, "red").otherwise("green").alias("final"), (p > 100000).alias("moved"),
    )


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    states = table(spark, d, "orders").where(k % 4 != 0).select(F.concat(F.lit("/p/"), (k % 9000).cast("string")).alias("path"), k.alias("nth"), F.array((k % 4) / 16, (k % 3) / 16, F.lit(0.5) + (k % 5) / 16, F.lit(0.75)).alias("detected"))
    return ro.ground_truth(_feedback(spark, d), states, "nth").select("key", "kind", "crop.*", "w", "h", "is_problem", "source")


def exported_corrections(spark: SparkSession, d: str) -> DataFrame:
    return ro.exported(_feedback(spark, d)).select("key", "manual_crop.*", "w", "h", "path", "source")


def all_results(spark: SparkSession, d: str) -> DataFrame:
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    part = lambda r, *c: o.where(k % 3 == r).select(F.col("o_custkey").alias("film"), k.alias("filename"), *c)
    return ro.all_results(part(0, F.col("o_totalprice").alias("width")), part(1, (F.col("o_totalprice") * 2).alias("width"), F.lit("edge").alias("method")), part(2, F.lit("broken").alias("error")))


def review_list(spark: SparkSession, d: str) -> DataFrame:
    return ro.review_list(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("confidence")), 0.03)


def plan_head(spark: SparkSession, d: str) -> DataFrame:
    return ro.head_of(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


def newest_session(spark: SparkSession, d: str) -> DataFrame:
    c, o = F.col("c_custkey"), table(spark, d, "orders")
    sessions = table(spark, d, "customer").select(c.alias("session"), F.when(c % 7 != 0, "standalone").otherwise("folder").alias("mode"), F.when(c % 2 == 0, "xmp").otherwise("copies").alias("target"), F.when(c % 5 != 0, "/a").otherwise("/b").alias("folder"))
    items = o.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("path"))
    return ro.newest_session(sessions, items, o.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("path")), "xmp", "/a")


def progress_lines(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("l_linenumber"), lambda c: F.col(c).cast("long").cast("string")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit("BATCHINFO total="), s("l_quantity"))).when(k % 5 == 1, F.concat(F.lit("PROGRESS "), s("l_linenumber"), F.lit("/"), s("l_quantity")))
        .when(k % 5 == 2, F.lit("WARN: x.NEF: broken")).when(k % 5 == 3, F.concat(F.lit("BATCHDONE green="), s("l_quantity"), F.lit(" yellow="), s("l_suppkey"), F.lit(" red=0"))).otherwise(F.lit("PROGRESS ?/?"))
    )
    return ro.progress(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), ["l_orderkey"], "l_linenumber")


def public_state(spark: SparkSession, d: str) -> DataFrame:
    c, images = F.col("c_custkey"), _images(spark, d)
    sessions = table(spark, d, "customer").select(c.alias("o_custkey"), F.when(c % 2 == 0, "xmp").otherwise("json").alias("target"))
    applied = table(spark, d, "customer").where(c % 3 != 0).select(c.alias("o_custkey"), F.when(c % 3 == 1, "xmp").alias("target"), (c % 10).alias("revision"))
    return ro.public_state(sessions, images, images.where("id % 4 = 0"), applied, "o_custkey")


def valid_conventions(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("l_linenumber") != 2, F.col("l_linenumber"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 0.5).alias("long_mm"), (F.col("l_linenumber") * 4 + 14.0).alias("short_mm"), n.alias("n"))
    return ro.conventions(rows)


def factor_rows(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), lambda x: F.col(x).cast("double")
    name = F.concat(F.lit("f"), (k % 500).cast("string"))
    results = table(spark, d, "orders").select(k.alias("nth"), name.alias("filename"), (c("o_totalprice") / 1000).alias("confidence"), F.when(k % 13 != 0, (k % 10) / 10).alias("size"), ((k % 7) / 8).alias("edge"))
    deltas = table(spark, d, "orders").select(F.concat(F.lit("r"), k.cast("string"), F.lit("/"), name).alias("key"), F.concat(F.lit("r"), k.cast("string")).alias("film"), (k % 2 == 0).alias("hit"), (k % 3 == 0).alias("missing"))
    return ro.factor_rows(results, deltas, "nth", ["size", "edge"]).select("key", "film", "hit", "conf", F.col("x")[0].alias("size"), F.col("x")[1].alias("edge"))


def films_with_references(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("/", F.col("o_custkey"), F.col("o_orderkey")).alias("key")
    o = table(spark, d, "orders")
    return ro.films_with_references(o.where("o_orderkey % 5 < 3").select(key), o.where("o_orderkey % 5 >= 3 or o_orderkey % 7 = 0").select(key))


def entry_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    entry = lambda op, on: F.struct(F.lit(op).alias("operation"), on.alias("enabled"))
    entries = F.when(k % 9 != 0, F.array(entry("crop", k % 2 == 0), entry("ashift", k % 3 == 0), entry("exposure", k % 1 == 0)))
    target = F.element_at(F.array(*map(F.lit, ("darktable", "reviews", "xmp"))), (k % 3 + 1).cast("int"))
    rotation = F.when(k % 4 == 0, 0.0).when(k % 4 == 1, 2.5)
    box = ro.reference_box(F.array((k % 3) / 10, F.lit(0.125), (k % 3) / 10 + 0.5, F.lit(0.875)), rotation, F.lit(1500.0), F.lit(1000.0))
    return table(spark, d, "orders").select(
        "o_orderkey", ro.needs_neutralizing(entries, ["crop", "ashift"]).alias("neutralize"), ro.skip_message(F.when(k % 2 == 0, "changed")).alias("message"),
        ro.mode_for(target).alias("mode"), ro.target_for(ro.mode_for(target)).alias("target"), ro.export_name(F.concat(F.lit("ä b?&"), F.col("o_orderpriority")), k).alias("name"), box.alias("box"),
    ).select("*", "box.*").drop("box")


def profile_upsert(spark: SparkSession, d: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    text = F.concat(F.lit("[General]\nColorLabel=0\nName="), p, F.lit("\n\n"), F.when(k % 3 != 0, F.concat(F.lit("[Crop]\nX="), k.cast("string"), F.lit("\nKeep=1\n\n"))).otherwise(""), F.lit("[End]\nX=1"))
    return table(spark, d, "orders").select("o_orderkey", sc.ini_set(text, "Crop", {"Enabled": F.lit("true"), "X": (k % 7).cast("string")}).alias("profile"))


def sidecar_crops(spark: SparkSession, d: str) -> DataFrame:
    # Four floats each: the whole image; 0.25, 0, 1, 1; 1.5 degrees; -0.5 degrees and a shear of 0.25.
    whole, part, turn, shear = "00000000000000000000803f0000803f", "0000803e000000000000803f0000803f", "0000c03f000000000000000000000000", "000000bf00000000000000000000803e"
    k = F.col("o_orderkey")
    step = lambda op, on, p: F.struct(F.lit(op).alias("operation"), on.alias("enabled"), F.lit(p).alias("params"))
    entries = F.array(step("crop", k % 2 == 0, part), step("crop", k % 3 == 0, whole), step("ashift", k % 5 == 0, turn), step("ashift", k % 7 == 0, shear))
    head = F.concat(F.lit("49492A0008000000"), F.lit("0200"), F.lit("000103000100000000000000"), F.lit("1201030001000000"), F.lpad(F.hex(k % 11), 2, "0"), F.lit("000000"))
    return table(spark, d, "orders").select("o_orderkey", sc.history_crop(entries).alias("h"), sc.tiff_orientation(F.unhex(head)).alias("orientation")).select(
        "o_orderkey", F.try_element_at("h.crop", F.lit(1)).alias("left"), F.col("h.rotation").alias("rotation"), F.col("h.complex").alias("complex"), F.col("h.n").alias("n"), "orientation"
    )


def plan_checks(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    plan = table(spark, d, "orders").select(k.alias("id"), F.concat(F.lit("/r/"), text(k % 50), F.lit("/"), text(k)).alias("path"), F.when(k % 4 != 0, k).alias("size"), (k % 3 != 0).alias("changed"))
    library = table(spark, d, "orders").where(k % 5 != 0).select(k.alias("id"), F.concat(F.lit("/r/"), text(F.when(k % 7 == 0, -1).otherwise(k % 50))).alias("folder"), text(k).alias("filename"), F.when(k % 11 != 0, k + (k % 2)).alias("file_size"))
    return ro.plan_checks(plan, library)


def imported_paths(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "orders").select(F.col("o_custkey").alias("film_id"), F.col("o_orderkey").cast("string").alias("filename"))
    rolls = table(spark, d, "customer").select(F.col("c_custkey").alias("film_id"), F.concat(F.lit("/n"), F.col("c_nationkey").cast("string")).alias("folder"))
    return ro.imported(images, rolls, table(spark, d, "nation").where("n_regionkey = 2").select(F.concat(F.lit("/n"), F.col("n_nationkey").cast("string")).alias("folder")))


QUERIES = {
    f.__name__: f
    for f in (
        roll_sizes, film_analysis, undo_operations, gallery_counts, manual_differences, filename_labels, ground_truth, exported_corrections, all_results, review_list, plan_head, newest_session,
        progress_lines, public_state, valid_conventions, factor_rows, films_with_references, entry_texts, profile_upsert, sidecar_crops, plan_checks, imported_paths,
    )
}

_FEEDBACK = """f as (select o_orderkey as k, '/p/' || (o_orderkey % 9000) as path, 'c' || o_custkey as film, 'i' || (o_orderkey % 3) as stem, 'companion:' || o_orderstatus as source, o_orderkey % 1000 + 1001 as w, o_orderkey % 600 + 901 as h,
  o_orderkey % 2 = 0 and o_orderkey % 8 <> 0 as strong, o_orderkey % 90 as x, o_orderkey % 80 as y, o_orderkey % 700 + 9 as width, o_orderkey % 500 + 7 as height, o_orderkey % 5 < 2 and o_totalprice > 100000 as problem from orders)"""


def _centre(side: str, name: str) -> str:
    """Common table expressions that end in name (film, center, n)."""
    return f"""{name}_v as (select l_partkey, {side}(w, h) as v from r), {name}_m as (select l_partkey, median(v) as m, count(*) as n from {name}_v group by 1),
{name}_s as (select l_partkey, v, v / (m * 0.035::double) as x, n from {name}_v join {name}_m using (l_partkey) where n > 2),
{name}_c as (select *, count(*) over (partition by l_partkey order by x range between current row and 1 following) as c from {name}_s),
{name}_f as (select l_partkey, x as lo from {name}_c qualify row_number() over (partition by l_partkey order by c desc, x) = 1),
{name} as (select l_partkey, median(v) as center, any_value(n) as n from {name}_s join {name}_f using (l_partkey) where x between lo and lo + 1 group by l_partkey union all select l_partkey, m, n from {name}_m where n <= 2)"""


ORACLE = {
    "roll_sizes": f"""with r as (select l_partkey, l_extendedprice::double as w, l_quantity::double * 300 as h from lineitem), {_centre("greatest", "a")}, {_centre("least", "b")},
j as (select l_partkey, a.n, a.center as long, b.center as short, p_partkey as k, case when p_partkey % 4 <> 0 then p_partkey % 30 end as agree from a join b using (l_partkey) left join part on p_partkey = l_partkey),
s as (select *, case when k % 5 = 0 then 0.5::double else long / greatest(short, 1) end as aspect from j
  where n >= 3 or coalesce(case when k % 3 = 0 then false when agree > 20 then false when agree < 2 then true else k % 10 >= 5 end, false))
select l_partkey, n, long, short, greatest(aspect, 1 / aspect) as bucket_aspect from s""",
    "film_analysis": """with r as (select l_suppkey, l_orderkey as image, l_linenumber = 1 as refined, case when l_orderkey % 17 <> 0 then l_quantity::double + 60 end as w, l_linenumber * 4.0::double + 50 as h from lineitem),
s as (select *, greatest(w / h, 1 / (w / h)) as a from r where w is not null), g as (select unnest([0.03::double, 0.05::double, 0.10::double, 0.15::double]) as width),
n as (select l_suppkey, width, a, case when a - lag(a) over (partition by l_suppkey, width order by a) <= width then 0 else 1 end as b from s, g),
c as (select *, sum(b) over (partition by l_suppkey, width order by a) as c from n),
m as (select l_suppkey, width, c, count(*) as k, median(a) as mode from c group by l_suppkey, width, c qualify row_number() over (partition by l_suppkey order by k desc, width, c) = 1),
z as (select s.l_suppkey, floor(coalesce(median(w) filter (abs(a - mode) / greatest(mode, 0.1::double) < 0.15::double), median(greatest(w, h))))::bigint as width,
  floor(coalesce(median(h) filter (abs(a - mode) / greatest(mode, 0.1::double) < 0.15::double), median(least(w, h))))::bigint as height from s join m using (l_suppkey) where refined group by 1),
i as (select l_suppkey, count(distinct image) as n_images, count(w) as n_candidates from r group by 1)
select i.l_suppkey, round_even(mode, 4) as aspect_ratio, z.width, height, n_images, n_candidates, coalesce(k, 0) as cluster_size, round_even(coalesce(k, 0) / greatest(n_candidates, 1), 2) as cluster_coverage
from i left join m using (l_suppkey) left join z using (l_suppkey)""",
    "undo_operations": """select o_orderkey as id, o_custkey, o_orderkey % 6 as op, o_orderkey % 6 = max(o_orderkey % 6) over w as by_session,
  coalesce(o_orderkey % 5 = 0 and o_orderkey % 6 = max(case when o_orderkey % 5 = 0 then o_orderkey % 6 end) over w, false) as by_selection from orders window w as (partition by o_custkey)""",
    "gallery_counts": """with o as (select o_orderpriority, o_orderkey as k, case when o_orderkey % 7 = 0 then 's' when o_orderkey % 11 = 0 then 'e' else 'o' end as s from orders)
select o_orderpriority, count(*) filter (k % 3 = 0) as proposals, count(*) filter (k % 3 = 1) as yellow, count(*) filter (k % 3 = 2) as red, count(*) filter (k % 4 = 0) as corrected,
  count(*) filter (k % 4 <> 0 and k % 5 in (1, 2)) as accepted, count(*) filter (s = 'o') as ok, count(*) filter (s = 's') as skipped, count(*) filter (s = 'e') as error, count(distinct k % 13) as films from o group by 1""",
    "manual_differences": """select o_orderkey as key, o_orderkey % 9 - l_linenumber * 2 as dx, o_orderkey % 7 - l_linenumber * 3 as dy, o_orderkey % 50 - l_quantity as dw, o_orderkey % 40 - l_linenumber * 5 as dh,
  case when o_orderkey % 3 <> 0 then 'edge' else '?' end as method, case when o_orderkey % 4 <> 0 then l_tax else 0 end as confidence
from orders join lineitem on l_orderkey = o_orderkey where o_orderkey % 5 <> 0 qualify row_number() over (partition by o_orderkey order by l_linenumber desc, l_quantity desc, l_tax desc) = 1""",
    "filename_labels": """with i as (select 'f' || (c_custkey % 700) as filename, min(c_custkey) as id from customer group by 1),
r as (select 'f' || (o_orderkey % 700) as filename, case when o_orderkey % 6 <> 0 then o_orderkey % 100 else 0 end as c from orders where o_orderkey % 3 <> 0 and o_orderkey % 4 <> 0)
select filename, id, case when c >= 50 then 'green' when c >= 30 then 'yellow' else 'red' end as label from r join i using (filename)""",
    "ground_truth": f"""with {_FEEDBACK}, s as (select '/p/' || (o_orderkey % 9000) as path, o_orderkey as k from orders where o_orderkey % 4 <> 0 qualify row_number() over (partition by o_orderkey % 9000 order by o_orderkey) = 1),
e as (select f.*, round_even(s.k % 4 / 16::double * w, 0) as l, round_even(s.k % 3 / 16::double * h, 0) as t, round_even((0.5::double + s.k % 5 / 16::double) * w, 0) as r, round_even(0.75::double * h, 0) as b, s.k is not null as met,
  2000 / greatest(w, h)::double as q from f left join s using (path)),
u as (select *, case when strong then x else l end as bx, case when strong then y else t end as bt, case when strong then width else r - l end as bw, case when strong then height else b - t end as bh from e
  where strong or (met and k % 3 = 1) qualify row_number() over (partition by film, stem order by k desc) = 1)
select film || '/' || stem || '.jpg' as key, case when strong then 'manual_crop' else 'accepted_crop' end as kind, round_even(bx * q, 0)::int as x, round_even(bt * q, 0)::int as y, round_even(bw * q, 0)::int as width,
  round_even(bh * q, 0)::int as height, round_even(w * q, 0)::int as w, round_even(h * q, 0)::int as h, case when strong then problem end as is_problem, source from u""",
    "exported_corrections": f"with {_FEEDBACK} select film || '/' || stem || '.NEF' as key, x, y, width, height, w, h, path, source from f where strong",
    "all_results": """select o_custkey as film, o_orderkey as filename, case o_orderkey % 3 when 0 then o_totalprice when 1 then o_totalprice * 2 end as width, case when o_orderkey % 3 = 1 then 'edge' end as method,
  case when o_orderkey % 3 = 2 then 'broken' end as error from orders""",
    "review_list": "select l_orderkey, l_linenumber, l_discount as confidence from lineitem where l_discount < 0.03 order by l_discount",
    "plan_head": "select o_custkey, o_orderkey, greatest(0, (select count(*) from orders) - 20) as more from orders order by o_custkey, o_orderkey limit 20",
    "newest_session": """select max(c_custkey) as session from customer where c_custkey % 7 <> 0 and c_custkey % 2 = 0 and c_custkey % 5 <> 0 and c_custkey in (select o_custkey from orders)
  and c_custkey not in (select o_custkey from orders where o_orderkey % 9 = 0)""",
    "progress_lines": """with l as (select l_orderkey, l_linenumber % 5 as k, l_linenumber || case l_linenumber % 5 when 0 then 'BATCHINFO total=' || l_quantity::bigint when 1 then 'PROGRESS ' || l_linenumber || '/' || l_quantity::bigint
  when 3 then 'BATCHDONE green=' || l_quantity::bigint || ' yellow=' || l_suppkey || ' red=0' else '' end as t from lineitem),
g as (select l_orderkey, max(t) filter (k = 1) as p, max(t) filter (k = 0) as i, max(t) filter (k = 3) as d, count(*) filter (k = 2) as warnings from l group by 1)
select l_orderkey, warnings, regexp_extract(p, ' ([0-9]+)/', 1)::bigint as step, regexp_extract(p, '/([0-9]+)', 1)::bigint as "of", regexp_extract(i, 'total=([0-9]+)', 1)::bigint as images,
  regexp_extract(d, 'green=([0-9]+)', 1)::bigint as green, regexp_extract(d, 'yellow=([0-9]+)', 1)::bigint as yellow, regexp_extract(d, 'red=([0-9]+)', 1)::bigint as red from g""",
    "public_state": """select c_custkey as o_custkey, case when c_custkey % 2 = 0 then 'xmp' else 'json' end as target, count(o_orderkey) as images, count(*) filter (o_orderkey % 3 = 0) as green, count(*) filter (o_orderkey % 3 = 1) as yellow,
  count(*) filter (o_orderkey % 3 = 2) as red, coalesce(bool_or(o_orderkey % 4 = 0), false) as can_undo, case when c_custkey % 3 <> 0 then c_custkey % 10 end as applied_revision,
  case when c_custkey % 3 = 1 and c_custkey % 2 <> 0 then 'xmp' end as applied_target from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    "valid_conventions": """select l_orderkey, l_linenumber, l_quantity + 0.5 as long_mm, l_linenumber * 4 + 14.0 as short_mm, case when l_linenumber = 2 then 1 else l_linenumber end::bigint as n from lineitem
where l_quantity + 0.5 between 33 and 40 and l_linenumber * 4 + 14 between 22 and 27""",
    "factor_rows": """with l as (select o_orderkey as k, o_orderkey % 500 as f, o_totalprice::double / 1000 as conf from orders qualify row_number() over (partition by f order by k desc) = 1)
select 'r' || o_orderkey || '/f' || f as key, 'r' || o_orderkey as film, o_orderkey % 2 = 0 as hit, conf, (k % 10) / 10 as size, (k % 7) / 8 as edge from orders join l on f = o_orderkey % 500 where o_orderkey % 3 <> 0 and k % 13 <> 0""",
    "films_with_references": "select distinct o_custkey::varchar as film from orders",
    "entry_texts": r"""with r as (select o_orderkey as k, o_orderpriority as p, (o_orderkey % 3) / 10 as l, case when o_orderkey % 4 = 1 then radians(2.5::double) else 0 end as g from orders),
s as (select *, 1500 * cos(g) + 1000 * sin(g) as sw, 1500 * sin(g) + 1000 * cos(g) as sh from r),
c as (select *, (l + 0.25::double) * sw - sw / 2 as dx, 0 * sh as dy, least(0.5::double * sw, 1500) as bw, least(0.75::double * sh, 1000) as bh from s),
t as (select *, least(greatest(750 + dx * cos(g) - dy * sin(g) - bw / 2, 0), 1500 - bw) as x0, least(greatest(500 + dx * sin(g) + dy * cos(g) - bh / 2, 0), 1000 - bh) as y0 from c),
e as (select *, case when g > 0 then round_even(x0 / 1500, 5) else l end as a1, case when g > 0 then round_even(y0 / 1000, 5) else 0.125::double end as a2,
  case when g > 0 then round_even((x0 + bw) / 1500, 5) else l + 0.5::double end as a3, case when g > 0 then round_even((y0 + bh) / 1000, 5) else 0.875::double end as a4 from t)
select k as o_orderkey, k % 9 <> 0 and (k % 2 = 0 or k % 3 = 0) as neutralize, case when k % 2 = 0 then 'Datei seit der Analyse geaendert' end as message, (['darktable', 'folder', 'standalone'])[k % 3 + 1] as mode,
  (['darktable', 'reviews', 'json'])[k % 3 + 1] as target, 'ä_b_' || regexp_replace(p, '[^\w.\-]+', '_', 'g') || '__' || k || '.jpg' as name,
  round_even(a1 * 1500, 0)::int as x, round_even(a2 * 1000, 0)::int as y, round_even((a3 - a1) * 1500, 0)::int as width, round_even((a4 - a2) * 1000, 0)::int as height from e""",
    "profile_upsert": r"""select o_orderkey, concat('[General]', chr(10), 'ColorLabel=0', chr(10), 'Name=', o_orderpriority, chr(10), chr(10),
  case when o_orderkey % 3 <> 0 then concat('[Crop]', chr(10), 'X=', o_orderkey % 7, chr(10), 'Keep=1', chr(10), 'Enabled=true', chr(10), chr(10)) else '' end, '[End]', chr(10), 'X=1', chr(10),
  case when o_orderkey % 3 = 0 then concat(chr(10), '[Crop]', chr(10), 'Enabled=true', chr(10), 'X=', o_orderkey % 7, chr(10)) else '' end) as profile from orders""",
    "sidecar_crops": """select o_orderkey, case when o_orderkey % 2 = 0 then 0.25::double end as "left", case when o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then
  case when o_orderkey % 5 = 0 then 1.5::double else 0 end + case when o_orderkey % 7 = 0 then -0.5::double else 0 end end as rotation, o_orderkey % 7 = 0 as complex, (o_orderkey % 2 = 0)::int as n,
  case when o_orderkey % 11 between 1 and 8 then (o_orderkey % 11)::int end as orientation from orders""",
    "plan_checks": """with r as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'unchanged' when o_orderkey % 5 = 0 then 'image not found in library' when o_orderkey % 7 = 0 then 'file moved or renamed'
  when o_orderkey % 4 <> 0 and (o_orderkey % 11 = 0 or o_orderkey % 2 = 1) then 'file changed since export' end as m from orders)
select k as id, m as message, case when m in ('unchanged', 'file changed since export') then 'skipped' when m is not null then 'error' end as status from r""",
    "imported_paths": "select '/n' || c_nationkey || '/' || o_orderkey as path from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where n_regionkey = 2",
}
