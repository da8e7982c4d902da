"""Steps whose work or memory must not outgrow their input, and the rounding that SQL fixes, against plain versions."""

import gc
import math
import random
import statistics

from pyspark.sql import functions as F

from gristmill.functions import sidecar as sc
from gristmill.functions import xmp
from gristmill.operators import evaluate as ev
from gristmill.operators import robust as ro
from gristmill.operators import state as st


def test_thresholds_are_rounded_as_in_sql(spark, duck):
    """Scores that end in half a ten thousandth: the double decides, 0.31675 gives 0.3167."""
    rows = spark.range(4001).select(F.col("id").alias("g"), (F.col("id") / 4000).alias("s"), F.lit(True).alias("hit"), F.explode(F.sequence(F.lit(1), F.lit(5))))
    got = {r.g: r.t for r in st.least_threshold(rows, ["g"], "s", "hit", 0.9).collect()}
    want = duck.sql("with r as (select i as g, i / 4000::double as s, round_even(i / 4000::double, 4) as t from range(0, 4001) r(i)) select g, t from r where t <= s").df()
    assert got == dict(zip(want.g, want.t, strict=True)) and got[1267] == 0.3167

def test_a_median_orders_only_the_values_near_it(spark, monkeypatch):
    """Bins of values are counted; what is ordered are the values in the bins that hold the middle."""
    rng, ordered = random.Random(5), []
    plain = ro.running

    def seen(rows, *args, **kwargs):
        ordered.append(rows.count())
        return plain(rows, *args, **kwargs)

    monkeypatch.setattr(ro, "running", seen)
    rows = [("a", rng.gauss(0, 9000)) for _ in range(5001)] + [("b", rng.uniform(1e4, 1e5)) for _ in range(5000)] + [("c", None), ("d", 4.0), ("d", 7.0), ("d", None)]
    got = {r.g: (r.n, r["median"]) for r in ro.exact_median(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v").collect()}
    values = {g: [v for k, v in rows if k == g and v is not None] for g in "abd"}
    assert got == {g: (len(vs), statistics.median(vs)) for g, vs in values.items()}
    assert len(ordered) == 1 and ordered[0] < 500


def test_bins_rise_with_values(spark):
    rng = random.Random(6)
    values = sorted([s * 10.0 ** rng.uniform(-320, 308) for s in (1, -1) for _ in range(500)] + [0.0, math.inf, -math.inf, 5e-324, 1.7e308, -1.7e308]) + [math.nan]
    got = [r[0] for r in spark.createDataFrame([*enumerate(values)], "i int, v double").orderBy("i").select(ro.bin_of(F.col("v"))).collect()]
    assert None not in got and got == sorted(got) and len(set(got)) > 900


def test_bias_of_missing_deltas(spark):
    rows = [(1.5, None), (-4.0, None), (None, None), (10.25, None)]
    got = {r.delta: tuple(r)[1:] for r in ev.bias(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()}
    assert got == {"x": (3, 1.5, 2.583333, -4.0, 10.25), "y": (0, None, None, None, None)}


def test_small_groups_are_not_cut_into_ranges(spark):
    """Sketches and cuts are for groups that one task should not order; sums are the same either way."""
    rng = random.Random(7)
    rows = [(g, float(rng.randint(0, 90)), 1) for g in ("a", "b", None) for _ in range(30 if g == "b" else 400)]
    df = spark.createDataFrame(rows, "g string, v double, k long").repartition(3)
    assert ro.ranged(df, ["g"], "v").where("_b is not null").count() == 0
    cut = ro.ranged(df, ["g"], "v", most=100).groupBy("g").agg(F.count_distinct("_b").alias("n")).collect()
    assert {r.g: r.n > 20 for r in cut} == {"a": True, "b": False, None: True}
    for most in (100, 1000):
        for down in (False, True):
            run = ro.running(df, ["g"], "v", ["k"], descending=down, most=most).groupBy("g", "v").agg(F.max("_run_k").alias("r")).collect()
            assert all(r.r == sum(1 for g, v, _ in rows if g == r.g and (v >= r.v if down else v <= r.v)) for r in run)


def test_parameters_are_decoded_once(spark):
    """However often a crop's values and turns are asked for, each word of an entry is decoded in one place."""
    rows = spark.createDataFrame([([("crop", True, "00000000000000000000803f0000803f")],)], "e array<struct<operation:string,enabled:boolean,params:string>>")
    h = F.col("h")
    asked = rows.select(sc.history_crop(F.col("e")).alias("h")).select(h["crop"].alias("a"), h["rotation"].alias("b"), h["complex"].alias("c"), h["n"].alias("d"))
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("conv(") <= 8
    assert tuple(asked.first()) == (None, None, False, 0)


def test_directory_behind_the_largest_place(spark):
    heads = [(b"II\x2a\x00\xff\xff\xff\x7f",), (b"MM\x00\x2a\x7f\xff\xff\xff",)]
    assert [r[0] for r in spark.createDataFrame(heads, "c binary").select(sc.tiff_orientation(F.col("c"))).collect()] == [None, None]


def test_a_parsed_text_is_let_go_at_once():
    """Nothing of it waits for the collector of cycles, which does not see how large parsers are."""
    gc.collect()
    gc.disable()
    try:
        for _ in range(5):
            assert len(xmp.parsed(xmp.EMPTY.encode())) == 3
        assert not [o for o in gc.get_objects() if isinstance(o, xmp.Element)]
    finally:
        gc.enable()


def test_texts_leave_in_portions(spark):
    """More rows than a portion, in one batch: all come back, in order, each with its text or its error."""
    n = 2 * xmp.ROWS + 7
    text = F.when(F.col("id") % 3 == 0, "<broken").when(F.col("id") % 3 == 1, xmp.EMPTY)
    rows = spark.range(0, n, 1, 1).select(F.col("id").cast("string").alias("path"), text.alias("text"), F.lit(None).cast("array<double>").alias("crop"), F.lit(None).cast("double").alias("angle"), F.lit(False).alias("was_applied"), F.lit(None).cast("double").alias("was_angle"), F.lit("red").alias("label"), F.lit(7).alias("revision"))
    got = xmp.edited(rows, "raw").collect()
    want = xmp.with_values(None, xmp.raw_values(None, False, "red", 7))
    assert [r.path for r in got] == [str(i) for i in range(n)]
    assert all(r.text is None and r.error for r in got[::3]) and {r.text for i, r in enumerate(got) if i % 3} == {want}
