"""What a session shows and writes back, over the driver's tables. Every order is an image, with its fields by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.xmp import CRS, DT
from gristmill.operators import models
from gristmill.operators import views as vi
from gristmill.plans.evaluation import PRECISION, scored
from gristmill.session import table

_CORNERS = ("l", "t", "r", "b")
FACTORS = ["size_agree", "edge_score", "film_trust", "exposure_factor", "roll_factor"]


def _images(spark: SparkSession, d: str) -> DataFrame:
    struct = lambda when, **fields: F.expr(f"case when {when} then named_struct({', '.join(f'{n!r}, {v}' for n, v in fields.items())}) end")
    straight = "case when k % 5 = 0 then named_struct('deg', (k % 9 - 4) * 0.5D + k % 2 * 0.2D, 'crop', array(0.1D, 0.1D, 0.9D, 0.8D)) end"
    lines = "map('top', array(array(0.1D, 0.2D), array(0.9D, (20 + k % 5) / 100D)))"
    skew = f"case when k % 3 <> 0 then named_struct('deg', (k % 9 - 4) * 0.5D, 'conf', k % 10 / 10D, 'lines', {lines}, 'straight', {straight}) end"
    box = "array(k % 20 / 100D, k % 15 / 100D, k % 20 / 100D + 0.5D + k % 10 / 50D, k % 15 / 100D + 0.5D + k % 8 / 50D)"
    texts = {"status": "if(k % 17 = 0, 'error', 'done')", "error": "if(k % 17 = 0, 'broken', null)", "decision": "case when k % 8 = 0 then 'skip' when k % 5 = 0 then 'accept' end"}
    texts |= {"group_override": "case when k % 19 = 0 then 'red' when k % 23 = 0 then 'green' end", "target_reason": "if(k % 31 = 0, 'not_raw', null)", "has_export": "k % 2 = 0"}
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("concat('f', o_custkey)").alias("film"))
    return rows.select(
        F.col("k").alias("id"), "film", F.expr("concat('i', k, '.NEF')").alias("filename"), *(F.expr(v).alias(n) for n, v in texts.items()),
        struct("k % 7 <> 0", crop=box, confidence="if(k % 37 = 0, null, k % 100 / 100D)", method="'edge'", reasons="if(k % 4 = 0, array('small'), null)", conf_parts="map('edge', k % 10 / 10D)", skew=skew).alias("detected"),
        struct("k % 11 = 0 or k % 13 = 0", deg="case when k % 11 <> 0 then (k % 7 - 3) * 0.7D end").alias("straighten"),
        struct("k % 6 = 0", crop="array(0.15D, 0.1D, 0.75D, 0.7D)", deg="case when k % 4 = 0 then (k % 5 - 2) * 0.8D end").alias("manual"),
        struct("k % 10 < 2", crop="if(k % 10 = 1, array(0.2D, 0.2D, 0.8D, 0.7D), null)", confidence="k % 50 / 50D", method="'edge'", reasons="array('p')", error="if(k % 10 = 0, 'no result', null)").alias("proposal"),
        struct("k % 29 <> 0", width="cast(3000 + k % 7 * 100 as int)", height="cast(2000 + k % 3 * 50 as int)").alias("export_size"),
    )


def _corners(name: str, crop: str) -> list:
    return [F.element_at(crop, i + 1).alias(f"{name}_{c}") for i, c in enumerate(_CORNERS)]


def public_images(spark: SparkSession, d: str) -> DataFrame:
    """The read model, its nested columns taken apart."""
    last = F.element_at(F.element_at("skew_lines", "top"), 2)
    plain = [c for c in vi.VIEW if c not in ("reasons", "conf_parts", "skew", "detected_crop", "view_size", "skew_lines", "manual_crop", "crop", "proposal", "ref", "export_size")]
    flat = {"reasons": F.array_join("reasons", ","), "part": F.element_at("conf_parts", "edge"), "tilt": F.col("skew.deg"), "view_w": F.element_at("view_size", 1), "view_h": F.element_at("view_size", 2)}
    flat |= {"line_x": F.element_at(last, 1), "line_y": F.element_at(last, 2), "offer_error": F.col("proposal.error"), "offer_conf": F.col("proposal.confidence"), "export_w": F.col("export_size.width")}
    crops = [c for name, crop in (("detected", "detected_crop"), ("manual", "manual_crop"), ("crop", "crop"), ("offer", "proposal.crop")) for c in _corners(name, crop)]
    refs = [F.col(f"ref.{n}").alias(f"ref_{n}") for n in ("dx", "dy", "dw", "dh", "tol", "hit", "strict", "score")]
    return vi.public_images(_images(spark, d)).select(*plain, *(v.alias(n) for n, v in flat.items()), *crops, *refs)


def review_target(spark: SparkSession, d: str) -> DataFrame:
    box = "named_struct('x', 1, 'y', 2, 'width', 3, 'height', 4)"
    old = table(spark, d, "orders").where("o_orderkey % 4 = 1").select(
        F.expr("concat('f', o_custkey, '/i', o_orderkey, '.NEF')").alias("key"), F.expr(box).alias("manual_crop"), F.lit(None).cast("boolean").alias("is_problem"), F.lit(False).alias("confirmed"),
        F.lit(2.5).alias("tilt_deg"), F.expr("named_struct('crop', array(0.1D, 0.2D, 0.8D, 0.9D), 'width', 10, 'height', 20)").alias("manual_crop_straight"),
    )
    new = vi.review_target(_images(spark, d), old)
    flat = [F.col(f"manual_crop.{c}").alias(c) for c in ("x", "y", "width", "height")] + [F.col(f"manual_crop_straight.{c}").alias(f"straight_{c}") for c in ("width", "height")]
    return new.select("key", "is_problem", "confirmed", "tilt_deg", *flat, *_corners("straight", "manual_crop_straight.crop"))


def _report(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: F.expr(f"case when l_orderkey % {i + 3} <> 0 then (l_partkey * {i + 1} % 10) / 10D end")
    sides = {"auto": "element_at(array('green', 'yellow', 'red'), cast(l_orderkey % 3 + 1 as int))", "final": "element_at(array('green', 'yellow', 'red'), cast(l_suppkey % 3 + 1 as int))"}
    flags = {"has_detection": "l_orderkey % 11 <> 0", "corrected": "l_linenumber % 3 = 0", "strict_hit": "case when l_linenumber % 2 = 0 then l_orderkey % 4 = 0 end", "symptom": "case when l_partkey % 2 = 0 then 'size' else 'position' end"}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(n) for n, v in (sides | flags).items()), F.expr("if(l_orderkey % 13 = 0, null, cast(l_quantity as double) / 50)").alias("conf"), *(part(i).alias(f) for i, f in enumerate(FACTORS)))


def feedback_groups(spark: SparkSession, d: str) -> DataFrame:
    return vi.feedback_groups(_report(spark, d))


def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    return vi.feedback_counts(_report(spark, d), FACTORS)


def false_greens(spark: SparkSession, d: str) -> DataFrame:
    return vi.false_greens(_report(spark, d)).select("l_orderkey", "l_linenumber", "final", "symptom")


def sidecar_probes(spark: SparkSession, d: str) -> DataFrame:
    """Pages as sidecars, some with a namespace before or after their text, of images with a full name or a short one."""
    pages = table(spark, d, "pages")
    name = F.expr("concat('/p.d/i', page_id, if(page_id % 3 = 0, '.NEF', ''), '.xmp')")
    text = F.expr(f"concat(if(page_id % 5 = 0, '{DT}', ''), html, if(page_id % 2 = 0, '{CRS}', ''), if(page_id % 5 = 1, '{DT}', ''))")
    images = pages.select("page_id", F.expr("concat('/p.d/i', page_id + if(page_id % 7 = 0, 1000000000, 0), if(page_id % 4 = 0, '', '.NEF'))").alias("path"))
    return vi.sidecar_probes(images, pages.select(name.alias("path"), text.alias("text")))


def protocol_written(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("element_at(array('step', 'total', 'done', 'warn', 'info', 'other'), cast(l_linenumber % 6 + 1 as int))")
    numbers = F.expr("array(cast(l_linenumber as long), cast(l_orderkey as long), if(l_orderkey % 5 = 0, null, cast(l_suppkey as long)))")
    text = F.expr(r"concat(l_returnflag, '\n', l_linestatus)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", vi.protocol_line(kind, numbers, text).alias("line"))


def fixed_scorers(spark: SparkSession, d: str) -> DataFrame:
    """Two formulas over labelled documents, each with its thresholds picked without the group they are tried on."""
    scorers = {"length": models.fixed(F.col("conf")), "blend": models.fixed(F.when(F.col("doc_id") % 6 != 0, 0.25 + F.col("conf") / 2))}
    return models.compared(scored(spark, d), "grp", scorers, PRECISION)


QUERIES = {f.__name__: f for f in (public_images, review_target, feedback_groups, feedback_counts, false_greens, sidecar_probes, protocol_written, fixed_scorers)}


def _turned(name: str, src: str, crop: str, old: tuple[str, str], new: tuple[str, str], deg: str, out: str) -> str:
    """Steps that turn a crop of an old frame's size into one of a new frame's."""
    (w0, h0), (w1, h1) = old, new
    return f"""{name}_0 as (select *, ({crop}[1] + {crop}[3]) / 2 * {w0} - {w0} / 2 as dx, ({crop}[2] + {crop}[4]) / 2 * {h0} - {h0} / 2 as dy, radians({deg}) as a,
  least(({crop}[3] - {crop}[1]) * {w0}, {w1}) as cw, least(({crop}[4] - {crop}[2]) * {h0}, {h1}) as ch from {src}),
{name}_1 as (select *, least(greatest({w1} / 2 + (dx * cos(a) - dy * sin(a)) - cw / 2, 0), {w1} - cw) as x0, least(greatest({h1} / 2 + (dx * sin(a) + dy * cos(a)) - ch / 2, 0), {h1} - ch) as y0 from {name}_0),
{name} as (select * exclude (dx, dy, a, cw, ch, x0, y0), case when {crop} is not null and {deg} is not null and {w1} is not null then
  [round_even(x0 / {w1}, 5), round_even(y0 / {h1}, 5), round_even((x0 + cw) / {w1}, 5), round_even((y0 + ch) / {h1}, 5)] end as {out} from {name}_1)"""


def _pixels(crop: str) -> dict[str, str]:
    l, t, r, b = (f"round_even({crop}[{i + 1}] * {'wh'[i % 2]}, 0)::int" for i in range(4))  # noqa: E741
    return {"x": l, "y": t, "width": f"{r} - {l}", "height": f"{b} - {t}"}


_PLACED = f"""base as (select o_orderkey as k, 'f' || o_custkey as film, (3000 + o_orderkey % 7 * 100)::double as w, (2000 + o_orderkey % 3 * 50)::double as h, (o_orderkey % 9 - 4) * 0.5::double as skew, o_orderkey % 7 <> 0 as found from orders),
size as (select * exclude (w, h), found and k % 3 <> 0 as measured, case when k % 29 <> 0 then w end as w, case when k % 29 <> 0 then h end as h, k % 6 = 0 as by_hand,
  case when found then [k % 20 / 100::double, k % 15 / 100::double, k % 20 / 100::double + 0.5::double + k % 10 / 50::double, k % 15 / 100::double + 0.5::double + k % 8 / 50::double] end as box,
  case when k % 6 = 0 then [0.15::double, 0.1::double, 0.75::double, 0.7::double] end as hand, case when k % 6 = 0 and k % 4 = 0 then (k % 5 - 2) * 0.8::double end as was from base),
deg as (select *, case when k % 11 = 0 then null when k % 13 = 0 then case when k % 7 <> 3 then (k % 7 - 3) * 0.7::double end when measured and abs(skew) >= 0.3::double and k % 10 >= 4 then skew end as deg from size),
turn as (select *, case when w is not null then deg end as turn, w is not null and by_hand and abs(coalesce(deg, 0) - coalesce(was, 0)) > 0.005::double as moves,
  w * abs(cos(radians(deg))) + h * abs(sin(radians(deg))) as tw, w * abs(sin(radians(deg))) + h * abs(cos(radians(deg))) as th,
  w * abs(cos(radians(was))) + h * abs(sin(radians(was))) as ww, w * abs(sin(radians(was))) + h * abs(cos(radians(was))) as wh from deg),
{_turned("seen", "turn", "box", ("w", "h"), ("tw", "th"), "-turn", "box_turned")},
{_turned("flat", "seen", "hand", ("ww", "wh"), ("w", "h"), "was", "hand_flat")},
flatter as (select *, case when moves and was <> 0 then hand_flat else hand end as level from flat),
{_turned("lifted", "flatter", "level", ("w", "h"), ("tw", "th"), "-turn", "level_turned")},
now as (select *, case when turn is null then box when k % 5 = 0 and abs(skew + k % 2 * 0.2::double - turn) < 0.15::double and measured then [0.1::double, 0.1::double, 0.9::double, 0.8::double] else box_turned end as shown from lifted),
crops as (select *, case when by_hand then case when moves and turn is not null then level_turned else level end else shown end as crop,
  case when not found then 'red' when k % 37 = 0 then 'red' when k % 100 >= 50 then 'green' when k % 100 >= 30 then 'yellow' else 'red' end as auto from now),
{_turned("back", "crops", "crop", ("tw", "th"), ("w", "h"), "turn", "crop_flat")},
placed as (select *, case when turn is not null then crop_flat else crop end as orig, case when k % 19 = 0 then 'red' when k % 23 = 0 then 'green' else auto end as grp from back)"""

_LIST = lambda name, crop: ", ".join(f"{crop}[{i + 1}] as {name}_{c}" for i, c in enumerate(_CORNERS))
_FOUND, _WANTED = _pixels("box"), _pixels("orig")
_DELTAS = ", ".join(f"({_FOUND[n]}) - ({_WANTED[n]}) as d{c}" for c, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height")))
_ORIG = _pixels("orig")
_REPORT = f"""r as (select l_orderkey, l_linenumber, (['green', 'yellow', 'red'])[l_orderkey % 3 + 1] as auto, (['green', 'yellow', 'red'])[l_suppkey % 3 + 1] as final, l_orderkey % 11 <> 0 as has_detection, l_linenumber % 3 = 0 as corrected,
  l_linenumber % 3 = 0 and l_linenumber % 2 = 0 and l_orderkey % 4 <> 0 as wrong, case when l_partkey % 2 = 0 then 'size' else 'position' end as symptom, case when l_orderkey % 13 <> 0 then l_quantity::double / 50 end as conf,
  {", ".join(f"case when l_orderkey % {i + 3} <> 0 then l_partkey * {i + 1} % 10 end as p{i}" for i in range(5))} from lineitem)"""

ORACLE = {
    "public_images": f"""with {_PLACED},
{_turned("offers", "(select *, case when k % 10 = 1 then [0.2::double, 0.2::double, 0.8::double, 0.7::double] end as offer from placed)", "offer", ("w", "h"), ("tw", "th"), "-turn", "offer_turned")},
line as (select *, 0.9::double * w - w / 2 as px, (20 + k % 5) / 100::double * h - h / 2 as py, radians(-turn) as pa from offers),
ref as (select *, case when found and by_hand and w is not null then 60 * greatest(w, h) / 2000 end as tol, {_DELTAS} from line),
far as (select *, greatest(abs(dx), abs(dy), abs(dw), abs(dh)) as worst, abs(dw) < tol and abs(dh) < tol as size_hit from ref)
select k % 31 <> 0 as target_ok, case when k % 31 = 0 then 'not_raw' end as target_reason, k as id, 'i' || k || '.NEF' as filename, film, case when k % 17 = 0 then 'error' else 'done' end as status, case when k % 17 = 0 then 'broken' end as error,
  grp as "group", auto as auto_group, case when found and k % 37 <> 0 then k % 100 / 100::double end as confidence, case when found then 'edge' end as method, case when found and k % 4 = 0 then 'small' else '' end as reasons,
  case when found then k % 10 / 10::double end as part, case when measured then skew end as tilt, deg as straighten, case when turn is null then w else round_even(tw, 1) end as view_w, case when turn is null then h else round_even(th, 1) end as view_h,
  case when measured then case when turn is null then 0.9::double else round_even((tw / 2 + (px * cos(pa) - py * sin(pa))) / tw, 5) end end as line_x,
  case when measured then case when turn is null then (20 + k % 5) / 100::double else round_even((th / 2 + (px * sin(pa) + py * cos(pa))) / th, 5) end end as line_y,
  case when k % 10 = 0 then 'no result' end as offer_error, case when k % 10 = 1 then k % 50 / 50::double end as offer_conf, w::int as export_w, k % 2 = 0 as has_export,
  case when k % 8 = 0 then 'skip' when k % 5 = 0 then 'accept' end as decision, k % 8 <> 0 and k % 17 <> 0 and crop is not null and not (grp = 'red' and not by_hand and k % 5 <> 0) and k % 31 <> 0 as apply,
  {_LIST("detected", "shown")}, {_LIST("manual", "hand")}, {_LIST("crop", "crop")}, {_LIST("offer", "(case when turn is null then offer else offer_turned end)")},
  {", ".join(f"case when tol is not null then {v} end as ref_{n}" for n, v in (("dx", "dx"), ("dy", "dy"), ("dw", "dw"), ("dh", "dh"), ("tol", "round_even(tol, 1)"), ("hit", "size_hit"), ("strict", "size_hit and abs(dx) < tol and abs(dy) < tol"), ("score", "round_even(worst / tol, 2)")))} from far""",
    "review_target": f"""with {_PLACED}, kind as (select *, case when by_hand and w is not null then 'manual' when k % 8 <> 0 and k % 5 = 0 and found and w is not null then 'accept' when grp = 'red' and k % 19 = 0 then 'red' end as kind from placed)
select film || '/i' || k || '.NEF' as key, case when kind = 'red' or (kind = 'manual' and grp = 'red') then true end as is_problem, case when kind = 'accept' then true when k % 4 = 1 then false end as confirmed,
  case when kind in ('manual', 'accept') then turn when k % 4 = 1 then 2.5::double end as tilt_deg,
  {", ".join(f"case when kind in ('manual', 'accept') then {_ORIG[n]} when k % 4 = 1 then {i + 1} end as {n}" for i, n in enumerate(("x", "y", "width", "height")))},
  {", ".join(f"case when kind in ('manual', 'accept') then case when turn is not null then round_even({v}, 0)::int end when k % 4 = 1 then {o} end as straight_{n}" for n, v, o in (("width", "tw", 10), ("height", "th", 20)))},
  {", ".join(f"case when kind in ('manual', 'accept') then case when turn is not null then crop[{i + 1}] end when k % 4 = 1 then {o}::double end as straight_{c}" for i, (c, o) in enumerate(zip(_CORNERS, (0.1, 0.2, 0.8, 0.9), strict=True)))}
from kind where kind is not null or k % 4 = 1""",
    "feedback_groups": f"""with {_REPORT} select auto, count(*) filter (has_detection) as n, count(*) filter (has_detection and corrected) as corrected, count(*) filter (has_detection and wrong) as bad,
  median(conf) filter (has_detection) as median_conf from r group by auto""",
    "feedback_counts": f"""with {_REPORT}, w as (select * from r where wrong), v as (select least(p0, p1, p2, p3, p4) as m, * from w),
n as (select 'move' as kind, auto || '->' || final as name from r where auto <> final union all select 'symptom', symptom from w where auto = 'green'
  union all select 'weakest', case {" ".join(f"when p{i} = m then '{f}'" for i, f in enumerate(FACTORS))} end from v where m is not null)
select kind, name, count(*) as n from n group by all""",
    "false_greens": f"with {_REPORT} select l_orderkey, l_linenumber, final, symptom from r where wrong and auto = 'green'",
    "sidecar_probes": f"""with s as (select '/p.d/i' || page_id || case when page_id % 3 = 0 then '.NEF' else '' end || '.xmp' as at, page_id % 2 = 0 or contains(html, '{CRS}') as crs,
  contains(substr(case when page_id % 5 = 0 then '{DT}' else '' end || html || case when page_id % 2 = 0 then '{CRS}' else '' end || case when page_id % 5 = 1 then '{DT}' else '' end, 1, {vi.HEAD}), '{DT}') as dt from pages),
i as (select page_id, '/p.d/i' || (page_id + case when page_id % 7 = 0 then 1000000000 else 0 end) as base, case when page_id % 4 = 0 then '' else '.NEF' end as ext from pages)
select i.page_id, base || ext as path, coalesce(a.at, b.at) as sidecar, coalesce(b.crs, false) as has_adobe, coalesce(a.dt, false) as has_darktable
from i left join s a on a.at = base || ext || '.xmp' left join s b on b.at = base || '.xmp'""",
    "protocol_written": """select l_orderkey, l_linenumber, case l_linenumber % 6 when 0 then 'PROGRESS ' || l_linenumber || '/' || l_orderkey when 1 then 'BATCHINFO total=' || l_linenumber
  when 2 then case when l_orderkey % 5 <> 0 then 'BATCHDONE green=' || l_linenumber || ' yellow=' || l_orderkey || ' red=' || l_suppkey end when 3 then 'WARN ' || l_returnflag || ' ' || l_linestatus
  when 4 then 'BATCHINFO ' || l_returnflag || ' ' || l_linestatus end as line from lineitem""",
    "fixed_scorers": f"""with s as (select d.doc_id, source as grp, least(1.0::double, n_chars / 4000::double) as conf, quality = 1 as hit from documents d join labels l using (doc_id)),
u as (select 'length' as scorer, grp, conf as score, hit from s where conf is not null and hit is not null and grp is not null
  union all select 'blend', grp, 0.25::double + conf / 2, hit from s where doc_id % 6 <> 0 and conf is not null and hit is not null and grp is not null),
g as (select distinct scorer, grp from u), c as (select g.scorer, g.grp as lft, score, count(*) as n, count(*) filter (hit) as h from g join u on u.scorer = g.scorer and u.grp <> g.grp group by all),
m as (select distinct scorer, lft, round_even(score, 4) as t from c), a as (select m.scorer, m.lft, t, sum(n) as n, sum(h) as h from m join c on c.scorer = m.scorer and c.lft = m.lft and c.score >= t group by all),
p as (select scorer, lft, min(t) as t from a where n >= 5 and h >= {PRECISION} * n group by all)
select u.scorer, u.grp, p.t, count(*) as n, count(*) filter (hit) as hits, count(*) filter (score >= p.t) as green, count(*) filter (score >= p.t and hit) as green_hits from u left join p on p.scorer = u.scorer and p.lft = u.grp group by all""",
}
