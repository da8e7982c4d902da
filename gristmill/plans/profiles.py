"""Array profiles and crop geometry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays as ar
from gristmill.functions import geometry as ge
from gristmill.session import table


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as profiles of whole thousandths, so that sums are exact."""
    xs = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", xs.alias("xs"))


def array_highpass(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", F.posexplode(ar.highpass(F.col("xs"), 8)).alias("i", "v")).withColumn("v", F.round("v", 6))


def array_outer_peaks(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", ar.outer_peaks(F.col("xs")).alias("p")).select("vec_id", "p.first", "p.last")


def longest_run(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", ar.longest_run(F.col("xs"), 0.0, 3).alias("r")).where("r is not null").select("vec_id", "r.start", "r.length")


def local_peak(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", ar.local_peak(F.col("xs"), 5).alias("p")).where("p is not null").select("vec_id", "p.place", "p.value")


def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", *(F.round(ar.autocorrelation(F.col("xs"), k), 6).alias(f"lag{k}") for k in (1, 4, 9)))


def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("vec_id", F.round(ar.theil_sen_slope(F.col("xs")), 6).alias("slope"))


def _crops(spark: SparkSession, d: str) -> DataFrame:
    """Crops of images of 3000 x 2000, from line items."""
    x, y = F.col("l_linenumber") * 37.0 - 50, F.col("l_discount") * 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", ge.from_pixels(x, y, F.col("l_quantity") * 57, F.col("l_quantity") * 43, F.lit(3000.0), F.lit(2000.0)).alias("crop"))


def crop_pixels(spark: SparkSession, d: str) -> DataFrame:
    return _crops(spark, d).where("crop is not null").select("l_orderkey", "l_linenumber", ge.to_pixels(F.col("crop"), F.lit(1200), F.lit(800)).alias("p")).select("l_orderkey", "l_linenumber", "p.*")


def crop_orientation(spark: SparkSession, d: str) -> DataFrame:
    rows = _crops(spark, d).where("crop is not null").withColumn("stored", ge.to_stored(F.col("crop"), F.col("l_linenumber") + 1))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.element_at("stored", i + 1), 5).alias(c) for i, c in enumerate(("l", "t", "r", "b"))))


def crop_straightened(spark: SparkSession, d: str) -> DataFrame:
    """There and back; crops that reach the edge are moved inside, so the way back is not always the same."""
    deg = F.col("l_linenumber") * 1.5 - 4
    rows = _crops(spark, d).where("crop is not null").withColumn("straight", ge.to_straight(F.col("crop"), F.lit(3000.0), F.lit(2000.0), deg))
    return rows.select("l_orderkey", "l_linenumber", "crop", "straight", ge.from_straight(F.col("straight"), F.lit(3000.0), F.lit(2000.0), deg).alias("back"))


_P = "p as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1000)) as xs from embeddings), u as (select vec_id, unnest(xs) as v, generate_subscripts(xs, 1) - 1 as i from p)"
_C = """c as (select l_orderkey, l_linenumber, least(1.0::double, greatest(0.0::double, (l_linenumber * 37.0::double - 50) / 3000)) as l,
  least(1.0::double, greatest(0.0::double, (l_discount * 1000) / 2000)) as t,
  least(1.0::double, greatest(0.0::double, (l_linenumber * 37.0::double - 50 + l_quantity * 57) / 3000)) as r,
  least(1.0::double, greatest(0.0::double, (l_discount * 1000 + l_quantity * 43) / 2000)) as b from lineitem),
k as (select l_orderkey, l_linenumber, r - l >= 0.02::double and b - t >= 0.02::double as ok, round_even(l, 5) as l, round_even(t, 5) as t, round_even(r, 5) as r, round_even(b, 5) as b from c)"""

QUERIES = {f.__name__: f for f in (array_highpass, array_outer_peaks, longest_run, local_peak, autocorrelation, theil_sen, crop_pixels, crop_orientation, crop_straightened)}
ORACLE = {
    "array_highpass": f"with {_P} select vec_id, i::int as i, round(v - sum(v) over (partition by vec_id order by i rows between 4 preceding and 4 following) / 9, 6) as v from u",
    "array_outer_peaks": f"""with {_P}, s as (select vec_id, i, abs(lead(v) over (partition by vec_id order by i) - v) as d from u),
m as (select *, max(d) over (partition by vec_id) as top from s) select vec_id, min(i)::int as first, max(i)::int as last from m where d > 0.3::double * top group by 1""",
    "longest_run": f"""with {_P}, g as (select vec_id, i, i - row_number() over (partition by vec_id order by i) as g from u where v > 0),
r as (select vec_id, min(i) as start, count(*) as length from g group by vec_id, g),
x as (select * from r where length >= 3 qualify row_number() over (partition by vec_id order by length desc, start) = 1)
select vec_id, start::int as start, length::int as length from x""",
    "local_peak": f"""with {_P}, n as (select *, lag(v) over w as a, lag(v, 2) over w as b, lead(v) over w as c, lead(v, 2) over w as e from u window w as (partition by vec_id order by i)),
x as (select vec_id, i, v from n where i >= 5 and v > 0 and v > a and v > b and v >= c and v >= e qualify row_number() over (partition by vec_id order by v desc, i) = 1)
select vec_id, i::int as place, v as value from x""",
    "autocorrelation": f"""with {_P}, s as (select vec_id, v, lead(v, 1) over w as a, lead(v, 4) over w as b, lead(v, 9) over w as c from u window w as (partition by vec_id order by i))
select vec_id, round(avg(v * a) / avg(v * v), 6) as lag1, round(avg(v * b) / avg(v * v), 6) as lag4, round(avg(v * c) / avg(v * v), 6) as lag9 from s group by 1""",
    "theil_sen": f"with {_P} select a.vec_id, round(median((b.v - a.v) / (b.i - a.i)), 6) as slope from u a join u b on a.vec_id = b.vec_id and a.i < b.i group by 1",
    "crop_pixels": f"""with {_C}
select l_orderkey, l_linenumber, round_even(l * 1200, 0)::int as x, round_even(t * 800, 0)::int as y,
  round_even(r * 1200, 0)::int - round_even(l * 1200, 0)::int as width, round_even(b * 800, 0)::int - round_even(t * 800, 0)::int as height from k where ok""",
    "crop_orientation": f"""with {_C}, e as (select l_orderkey, l_linenumber, unnest(case l_linenumber + 1
  when 2 then {{'l': 1 - r, 't': t, 'r': 1 - l, 'b': b}} when 3 then {{'l': 1 - r, 't': 1 - b, 'r': 1 - l, 'b': 1 - t}}
  when 4 then {{'l': l, 't': 1 - b, 'r': r, 'b': 1 - t}} when 5 then {{'l': t, 't': l, 'r': b, 'b': r}}
  when 6 then {{'l': t, 't': 1 - r, 'r': b, 'b': 1 - l}} when 7 then {{'l': 1 - b, 't': 1 - r, 'r': 1 - t, 'b': 1 - l}}
  when 8 then {{'l': 1 - b, 't': l, 'r': 1 - t, 'b': r}} else {{'l': l, 't': t, 'r': r, 'b': b}} end) from k where ok)
select l_orderkey, l_linenumber, round(l, 5) as l, round(t, 5) as t, round(r, 5) as r, round(b, 5) as b from e""",
}
