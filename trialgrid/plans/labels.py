"""Named queries of column functions, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.functions import labels as lb
from trialgrid.plans.queries import query, tidy
from trialgrid.sources import views as v

_SIDE = r"'^(.*)\((L|R)\)$'"
_PAIR = r"'^(.+?)(\d+)-(\d+)$'"


@query("select channel, phase, sample from signal where roi in ('ASIA', 'EUROPE') and phase in ('F')")
def membership_filter(spark, d):
    return v.signal(spark, d).filter(F.col("roi").isin("ASIA", "EUROPE") & F.col("phase").isin("F")).select("channel", "phase", "sample")


@query("select channel, phase, sample from signal where sample >= trunc(12 * -1.3 + 41)::int and sample < trunc(12 * 0.99 + 41)::int")
def crop_by_index(spark, d):
    """Bounds in seconds become sample indices, cut towards 0; the upper one is left out."""
    at = lambda t: F.lit(12 * t + 41).cast("int")
    return v.signal(spark, d).filter((F.col("sample") >= at(-1.3)) & (F.col("sample") < at(0.99))).select("channel", "phase", "sample")


@query("select channel, phase, sample from (select *, min(time) over w as lo, max(time) over w as hi from signal window w as (partition by channel, phase)) where time between lo + 0.5 and hi - 0.5")
def interior_crop(spark, d):
    s = v.signal(spark, d)
    ends = s.groupBy("channel", "phase").agg((F.min("time") + 0.5).alias("lo"), (F.max("time") - 0.5).alias("hi"))
    return s.join(ends, ["channel", "phase"]).filter(F.col("time").between(F.col("lo"), F.col("hi"))).select("channel", "phase", "sample")


@query("select id, channel, label from contacts where label is not null and pair <> ''")
def drop_missing(spark, d):
    return v.contacts(spark, d).withColumn("pair", F.nullif("pair", F.lit(""))).na.drop(subset=["label", "pair"]).select("id", "channel", "label")


@query("select channel as name, phase, 'hg' as band, round(value + 1e-9, 6) as power, sample * 2 as tick from signal")
def shape_columns(spark, d):
    s = v.signal(spark, d).withColumnsRenamed({"channel": "name", "value": "power"}).withColumns({"band": F.lit("hg"), "tick": F.col("sample") * 2})
    return s.drop("mask", "roi", "hemi", "subject", "time", "sample").select("name", "phase", "band", tidy("power", "power"), "tick")


@query("select description, phase, trial, case when description = 'R' then 'Response' when phase = 'O' then 'Go' else 'Stimulus' end as harmonised, count(*) as n from signal_rows group by all")
def phase_harmonised(spark, d):
    """The phase column is written first, the description overrides it."""
    name = lb.last_write([(F.col("phase") == "O", "Go"), (F.col("description") == "R", "Response")], F.lit("Stimulus"))
    return v.signal_rows(spark, d).groupBy("description", "phase", "trial", name.alias("harmonised")).agg(F.count("*").alias("n"))


@query("select id, coalesce((lower(label) like '%asia%' or lower(label) like '%nation_1%') and label not in ('', 'Unknown'), false) as hit from contacts")
def keyword_predicate(spark, d):
    return v.contacts(spark, d).select("id", lb.has_keyword(F.col("label"), ["asia", "NATION_1"]).alias("hit"))


@query("select distinct p_size as id from part where lower(p_name) like '%ring%' or lower(p_name) like '%red%'")
def keyword_ids(spark, d):
    return v.table(spark, d, "part").filter(lb.has_keyword(F.col("p_name"), ["ring", "red"])).select(F.col("p_size").alias("id")).distinct()


@query("select id, case when label like '%africa%' then 'south' when label like '%asia%' then 'east' when label like '%e%' then 'with e' else region end as part from contacts")
def label_refined(spark, d):
    has = lambda w: F.coalesce(F.contains("label", F.lit(w)), F.lit(False))
    return v.contacts(spark, d).select("id", lb.first_rule([(has("africa"), "south"), (has("asia"), "east"), (has("e"), "with e")], F.col("region")).alias("part"))


@query(f"select id, trim(coalesce(nullif(regexp_extract(tag, {_SIDE}, 1), ''), tag)) as roi, nullif(regexp_extract(tag, {_SIDE}, 2), '') as hemi from contacts")
def region_side(spark, d):
    roi, side = lb.region_and_side(F.col("tag"))
    return v.contacts(spark, d).select("id", roi.alias("roi"), side.alias("hemi"))


@query("select id, regexp_replace(code, '^([A-Z])0+', '\\1') as subject, left(code, -1) as stem, right(code, 1) as last from contacts")
def subject_codes(spark, d):
    stem, last = lb.without_last(F.col("code"))
    return v.contacts(spark, d).select("id", lb.subject_id(F.col("code")).alias("subject"), stem.alias("stem"), last.alias("last"))


@query("select id, 'D' || code[2:]::int as by_number, replace(replace(code, 'D00', 'D'), 'D0', 'D') as replaced, 'sub-' || replace(replace(code, 'D00', 'D'), 'D0', 'D') || '_ROG1' as inside from contacts")
def subject_variants(spark, d):
    """The two other ways in which a padded code loses its zeros."""
    code = F.col("code")
    inside = lb.subject_replaced(F.concat(F.lit("sub-"), code, F.lit("_ROG1")))
    return v.contacts(spark, d).select("id", lb.subject_number(code).alias("by_number"), lb.subject_replaced(code).alias("replaced"), inside.alias("inside"))


@query(f"select id, case when regexp_matches(pair, {_PAIR}) then regexp_extract(pair, {_PAIR}, 1) || regexp_extract(pair, {_PAIR}, 2) else pair end as a, case when regexp_matches(pair, {_PAIR}) then regexp_extract(pair, {_PAIR}, 1) || regexp_extract(pair, {_PAIR}, 3) else pair end as b from contacts")
def contact_pairs(spark, d):
    a, b = lb.contact_pair(F.col("pair"))
    return v.contacts(spark, d).select("id", a.alias("a"), b.alias("b"))


@query("select id, replace(case f when '1' then 'one part' when '2' then 'two' else f end, ' ', '') as region from (select id, string_split(label, '_')[-1] as f from contacts)")
def gross_regions(spark, d):
    return v.contacts(spark, d).select("id", lb.gross_region(F.col("label"), {"1": "one part", "2": "two"}).alias("region"))


@query("select id, case when length(s) > 12 then left(s, 10) else s end as short, string_split(label, '_')[-1] as last from (select id, label, replace(regexp_replace(label, '^ctx_', ''), '_', ' ') as s from contacts)")
def short_labels(spark, d):
    return v.contacts(spark, d).select("id", lb.short_label(F.col("label"), "ctx_", 12, 10).alias("short"), F.substring_index("label", "_", -1).alias("last"))


_MM = ", mm as (select id, nation, power, case when m then x * 1000 else x end as x, case when m then y * 1000 else y end as y, case when m then z * 1000 else z end as z from (select *, greatest(abs(x), abs(y), abs(z)) < 10 as m from contacts))"


def _mm(spark, d):
    x, y, z = lb.millimetres([F.col(c) for c in "xyz"])
    return v.contacts(spark, d).withColumns({"x": x, "y": y, "z": z})


@query(f"{_MM} select id, round(x + 1e-9, 6) as x, round(y + 1e-9, 6) as y, round(z + 1e-9, 6) as z from mm")
def unit_detect(spark, d):
    return _mm(spark, d).select("id", *(tidy(c, c) for c in "xyz"))


@query("select id, round(x * f + 1e-9, 6) as x, round(y * f + 1e-9, 6) as y, round(z * f + 1e-9, 6) as z from (select *, case when max(greatest(abs(x), abs(y), abs(z))) over (partition by nation) < 1 then 1000 else 1 end as f from (select id, nation, x * s as x, y * s as y, z * s as z from (select *, case when nation like '%3' then 0.001::double else 1.0::double end as s from contacts)))")
def unit_by_set(spark, d):
    """Metres or millimetres by the largest distance in a nation's contacts, not row by row."""
    scale = F.when(F.col("nation").like("%3"), 0.001).otherwise(1.0)
    rows = v.contacts(spark, d).select("id", "nation", *((F.col(c) * scale).alias(c) for c in "xyz"))
    return lb.millimetres_by_set(rows, ["nation"]).select("id", *(tidy(c, c) for c in "xyz"))


@query(f"{_MM} select id, round_even(128.5 - round(x, 3), 0)::int as i, greatest(0, least(round_even(128.5 - round(x, 3), 0)::int, 199)) as ci, round_even(round(y, 3) + 90.5, 0)::int as j, greatest(0, least(round_even(round(y, 3) + 90.5, 0)::int, 149)) as cj from mm")
def voxel_index(spark, d):
    i, ci = lb.voxel(F.round("x", 3), 128.5, 200, flip=True)
    j, cj = lb.voxel(F.round("y", 3), 90.5, 150)
    return _mm(spark, d).select("id", i.alias("i"), ci.alias("ci"), j.alias("j"), cj.alias("cj"))


@query(f"{_MM} select id, round(n_regionkey + 1 + x * 0.5 + y * n_regionkey + 1e-9, 6) as x, round(case when n_name is not null then z * 2 - 3 end + 1e-9, 6) as y, round(case when n_name is not null then x - y end + 1e-9, 6) as z from mm left join nation on n_name = nation and n_nationkey % 5 <> 0")
def affine_points(spark, d):
    """One matrix a nation; nations without one leave null places."""
    r, none = F.col("n_regionkey").cast("double"), F.lit(0.0)
    rows = (F.lit(0.5), r, none, r + 1, none, none, F.lit(2.0), F.lit(-3.0), F.lit(1.0), F.lit(-1.0), none, none)
    matrices = v.table(spark, d, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("nation"), *(c.alias(f"m{i // 4}{i % 4}") for i, c in enumerate(rows)))
    return lb.transformed(_mm(spark, d).select("id", "nation", "x", "y", "z"), matrices, "nation").select("id", *(tidy(c, c) for c in "xyz"))


@query("select channel, phase, sample, round(case when mask then value end + 1e-9, 6) as value from signal")
def mask_to_missing(spark, d):
    return v.signal(spark, d).select("channel", "phase", "sample", tidy(F.when(F.col("mask"), F.col("value")), "value"))


@query("select source, target, subject, phase, win, case when round(pval, 9) < 0.05 and round(pdc, 9) > 0.5 then round(pdc + 1e-9, 6) end as power from edges")
def two_threshold_mask(spark, d):
    keep = (F.round("pval", 9) < 0.05) & (F.round("pdc", 9) > 0.5)
    return v.edges(spark, d).select("source", "target", "subject", "phase", "win", tidy(F.when(keep, F.col("pdc")), "power"))


@query("select event_id, try_cast(case when event_id % 7 = 0 then 'n/a' else value::varchar end as double) as number, value + 0.08 as later from events")
def safe_cast_shift(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return v.table(spark, d, "events").select("event_id", text.try_cast("double").alias("number"), (F.col("value") + 0.08).alias("later"))


@query("select source, target, sum(case when source = target then 0 else coalesce(w, 0) end) as n from (select sn.n_name as source, cn.n_name as target, case when l_linenumber = 3 then null else 1 end as w from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey) group by all")
def fill_and_diagonal(spark, d):
    """Missing (null or not a number) becomes 0, links of a node with itself too."""
    nation = v.table(spark, d, "nation")
    end = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    rows = v.table(spark, d, "lineitem").join(v.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(v.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(v.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(1.0)
    filled = F.when(F.col("source") == F.col("target"), 0.0).otherwise(F.coalesce(F.nanvl(w, F.lit(None)), F.lit(0.0)))
    return rows.join(end("s_nationkey", "source"), "s_nationkey").join(end("c_nationkey", "target"), "c_nationkey").groupBy("source", "target").agg(F.sum(filled).alias("n"))


_U = "(('0x' || substr(md5(h), {}, 8))::bigint + 1)::double / 4294967297.0"


@query(f"select trial, pos, round(case when (trial * 64 + pos) % 97 = 0 then sqrt(-2 * ln({_U.format(1)})) * cos(2 * pi() * {_U.format(9)}) else value end + 1e-9, 6) as value from (select *, '5|noise|' || trial || '|' || pos as h from (select vec_id as trial, unnest(embedding)::double as value, unnest(range(64)) as pos from embeddings))")
def noise_fill(spark, d):
    """Missing values become standard normal noise that hangs on seed, trial and feature alone."""
    missing = (F.col("trial") * 64 + F.col("pos")) % 97 == 0
    value = F.when(missing, lb.noise(F.lit(5), F.lit("noise"), F.col("trial"), F.col("pos"))).otherwise(F.col("value"))
    return v.trials(spark, d).select("trial", "pos", tidy(value, "value"))


@query("select channel, printf('dist=%.2f of %s', round(power, 1), region) as reason, round_even(round(power / 100, 3), 0)::int as pct from contacts")
def reason_text(spark, d):
    pct = F.rint(F.round(F.col("power") / 100, 3)).cast("int")
    return v.contacts(spark, d).select("channel", F.format_string("dist=%.2f of %s", F.round("power", 1), F.col("region")).alias("reason"), pct.alias("pct"))


@query("select roi, round_even(count(distinct case when mask then channel end) / count(distinct channel)::double * 100, 0)::int as pct from signal group by roi")
def percent_significant(spark, d):
    got = v.signal(spark, d).groupBy("roi").agg(F.countDistinct(F.when(F.col("mask"), F.col("channel"))).alias("a"), F.countDistinct("channel").alias("b"))
    return got.select("roi", lb.percent(F.col("a"), F.col("b")).alias("pct"))


@query("select channel, case when l and r then 'both' when l then 'only F' when r then 'only O' end as category from (select channel, coalesce(bool_or(mask and phase = 'F'), false) as l, coalesce(bool_or(mask and phase = 'O'), false) as r from signal group by channel) where l or r")
def both_or_only(spark, d):
    s = v.signal(spark, d).filter("mask")
    side = lambda p, c: s.filter(F.col("phase") == p).select("channel").distinct().withColumn(c, F.lit(True))
    both = side("F", "l").join(side("O", "r"), "channel", "full")
    return both.select("channel", lb.first_rule([(F.col("l") & F.col("r"), "both"), (F.col("l"), "only F"), (F.col("r"), "only O")]).alias("category"))


@query("select channel, case when a and b then 'sensorimotor' when a then 'auditory' when b then 'motor' else 'none' end as class from (select channel, bool_or(mask and time < 0) as a, bool_or(mask and time >= 0) as b from signal group by channel)")
def functional_class(spark, d):
    flags = v.signal(spark, d).groupBy("channel").agg(F.bool_or(F.col("mask") & (F.col("time") < 0)).alias("a"), F.bool_or(F.col("mask") & (F.col("time") >= 0)).alias("b"))
    return flags.select("channel", lb.first_rule([(F.col("a") & F.col("b"), "sensorimotor"), (F.col("a"), "auditory"), (F.col("b"), "motor")], "none").alias("class"))


@query("select source, target, case when contains(source, '_1') then case when contains(target, '_2') then 'front-temporal' else 'other' end when source like '%2%' or target like '%2%' then 'temporal' else 'rest' end as category, case when round(r, 9) >= 0.5 then 'high' when round(r, 9) >= 0.3 then 'medium' else 'low' end as band from (select source, target, avg((round(pval, 9) < 0.05)::int) as r from edges group by all)")
def edge_category(spark, d):
    """The first branch keeps its edges: those of its kind without the second mark are 'other', not looked at again."""
    has = lambda c, w: F.contains(c, F.lit(w))
    front = F.when(has("target", "_2"), "front-temporal").otherwise("other")
    kind = lb.first_rule([(has("source", "_1"), front), (has("source", "2") | has("target", "2"), "temporal")], "rest")
    ratio = F.round(F.avg((F.round("pval", 9) < 0.05).cast("int")), 9)
    got = v.edges(spark, d).groupBy("source", "target").agg(ratio.alias("r"))
    return got.select("source", "target", kind.alias("category"), lb.first_rule([(F.col("r") >= 0.5, "high"), (F.col("r") >= 0.3, "medium")], "low").alias("band"))


@query("select sector, round(sum(power) + 1e-9, 6) as total, round(sum(power) / max(sum(power)) over () + 1e-9, 6) as share, round(0.2 + 0.2 * sum(power) / max(sum(power)) over () + 1e-9, 6) as shade from (select case when region = 'ASIA' then nation else region end as sector, power from contacts) group by sector")
def sector_weights(spark, d):
    """Fine labels in one region, the coarse region elsewhere; weights against the largest."""
    sums = v.contacts(spark, d).groupBy(F.when(F.col("region") == "ASIA", F.col("nation")).otherwise(F.col("region")).alias("sector")).agg(F.sum("power").alias("w"))
    most = sums.agg(F.max("w").alias("most"))  # one row
    got = sums.join(F.broadcast(most), F.lit(True))
    return got.select("sector", tidy("w", "total"), tidy(F.col("w") / F.col("most"), "share"), tidy(0.2 + 0.2 * F.col("w") / F.col("most"), "shade"))


@query("select channel, phase, sample from signal where case when phase = 'O' then time between -0.5 and 0.5 else time between 0 and 1 end")
def condition_windows(spark, d):
    """Each condition has a window of its own."""
    windows = F.create_map(F.lit("O"), F.array(F.lit(-0.5), F.lit(0.5)))
    w = F.coalesce(windows[F.col("phase")], F.array(F.lit(0.0), F.lit(1.0)))
    return v.signal(spark, d).filter((F.col("time") >= w[0]) & (F.col("time") <= w[1])).select("channel", "phase", "sample")
