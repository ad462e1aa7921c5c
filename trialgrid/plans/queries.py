"""Named queries over the star tables, each with the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.operators import series as op
from trialgrid.operators import summaries as sm
from trialgrid.sources import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"with {v.SQL} {sql}"
        return f

    return add


def r6(c: str) -> Column:
    return tidy(c, c)


def tidy(c: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded a little above the half, so that sums that lie on a tie don't hang on the order of their terms (in SQL: round(x + 1e-9, digits))."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits).alias(name)


@query("select region, channel, phase, round(t + 1e-9, 6) as onset from (select roi as region, channel, phase, min(time) as t from signal where mask group by all)")
def onset_latency(spark, d):
    return op.earliest(v.signal(spark, d).filter("mask").select("channel", "phase", "time", F.col("roi").alias("region")), ["channel", "phase"], "time").select("region", "channel", "phase", tidy("time", "onset"))


@query("select channel, phase, sample, round(value + 1e-9, 6) as value from (select *, row_number() over (partition by channel, phase order by value desc, sample) as k from signal where mask) where k = 1")
def peak_latency(spark, d):
    return op.peak(v.signal(spark, d).filter("mask").select("channel", "phase", "sample", "value"), ["channel", "phase"], "sample").select("channel", "phase", "sample", r6("value"))


@query("select channel, phase, min(sample) as start, max(sample) as stop, count(*) as n from (select *, sample - row_number() over (partition by channel, phase order by sample) as g0, row_number() over (partition by channel, phase order by sample) - row_number() over (partition by channel, phase, mask order by sample) as g from signal) where mask group by channel, phase, g")
def sig_runs(spark, d):
    return op.runs(v.signal(spark, d), ["channel", "phase"], "sample", "mask")


@query("select channel, phase, sample, round((value - avg(value) over w) / (stddev_pop(value) over w + 1e-8) + 1e-9, 6) as z from signal window w as (partition by channel, phase)")
def zscore_series(spark, d):
    return op.zscore(v.signal(spark, d), ["channel", "phase"]).select("channel", "phase", "sample", r6("z"))


@query("select channel, sample, round(avg(value) + 1e-9, 6) as value, count(*) as n from signal_rows group by all")
def evoked_mean(spark, d):
    return v.signal_rows(spark, d).groupBy("channel", "sample").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select("channel", "sample", r6("value"), "n")


@query("select channel, phase, round(max(value) + 1e-9, 6) as peak, round(avg(value) + 1e-9, 6) as mean from signal where time between -1 and 1 group by all")
def peak_in_window(spark, d):
    return v.signal(spark, d).filter(F.col("time").between(-1, 1)).groupBy("channel", "phase").agg(tidy(F.max("value"), "peak"), tidy(F.avg("value"), "mean"))


@query("select channel, phase, sample from signal where time >= -1 and time < 1")
def time_crop_half_open(spark, d):
    return v.signal(spark, d).filter("time >= -1 and time < 1").select("channel", "phase", "sample")


@query("select channel, phase, win, round(avg(value) + 1e-9, 6) as mean, count(*) as n from signal, unnest(range(greatest(0, (floor((sample - 12) / 6.0) + 1)::int), floor(sample / 6.0)::int + 1)) t(win) group by all")
def hopping_mean(spark, d):
    got = op.moving_mean(v.signal(spark, d), ["channel", "phase"], "sample", 12, 6).filter("win >= 0")
    return got.select("channel", "phase", "win", r6("mean"), "n")


@query("select a.subject, a.phase, a.channel as a, b.channel as b, round(corr(a.value, b.value) + 1e-9, 6) as r, count(*) as n from signal a join signal b on a.subject = b.subject and a.phase = b.phase and a.sample = b.sample and a.channel < b.channel group by all having count(*) > 5")
def pearson_pairs(spark, d):
    return op.pearson_pairs(v.evoked(spark, d), ["subject", "phase"], "channel", "sample").filter("n > 5").select("subject", "phase", "a", "b", r6("r"), "n")


@query("select roi, hemi, count(distinct channel) as n, count(distinct subject) as subjects from signal group by all")
def distinct_by_roi_hemi(spark, d):
    return v.signal(spark, d).groupBy("roi", "hemi").agg(F.countDistinct("channel").alias("n"), F.countDistinct("subject").alias("subjects"))


@query("select roi, count(*) filter (hemi = 'L') as L, count(*) filter (hemi = 'R') as R, count(*) as total from (select distinct roi, hemi, channel from signal) group by roi")
def pivot_counts(spark, d):
    got = v.signal(spark, d).select("roi", "hemi", "channel").distinct().groupBy("roi").pivot("hemi", ["L", "R"]).count().na.fill(0)
    return got.withColumn("total", F.col("L") + F.col("R"))


@query("select source, target, round(avg(pdc) + 1e-9, 6) as pdc, round(avg(case when round(pval, 9) < 0.05 then pdc end) + 1e-9, 6) as pdc_sig, round(avg((round(pval, 9) < 0.05)::int) + 1e-9, 6) as sig_ratio from edges group by all")
def sig_trio(spark, d):
    sig = F.round("pval", 9) < 0.05  # a mean at the limit must not depend on the order of its sum
    got = v.edges(spark, d).groupBy("source", "target").agg(F.avg("pdc").alias("pdc"), F.avg(F.when(sig, F.col("pdc"))).alias("pdc_sig"), F.avg(sig.cast("int")).alias("sig_ratio"))
    return got.select("source", "target", *(tidy(c, c) for c in ("pdc", "pdc_sig", "sig_ratio")))


@query("select roi, round(avg(m) + 1e-9, 6) as mean from (select roi, channel, avg(value) as m from signal group by all) group by roi")
def mean_of_means(spark, d):
    return v.signal(spark, d).groupBy("roi", "channel").agg(F.avg("value").alias("m")).groupBy("roi").agg(tidy(F.avg("m"), "mean"))


@query("select subject, count(*) as n, round(avg(value) + 1e-9, 6) as mean, round(stddev_samp(value) + 1e-9, 6) as sd, round(min(value) + 1e-9, 6) as lo, round(max(value) + 1e-9, 6) as hi from signal group by all")
def describe_subject(spark, d):
    r = lambda c, n: tidy(c, n)
    return v.signal(spark, d).groupBy("subject").agg(F.count("*").alias("n"), r(F.avg("value"), "mean"), r(F.stddev_samp("value"), "sd"), r(F.min("value"), "lo"), r(F.max("value"), "hi"))


@query("select roi, round(quantile_cont(value, 0.02) + 1e-9, 6) as lo, round(median(value) + 1e-9, 6) as mid, round(quantile_cont(value, 0.95) + 1e-9, 6) as hi from signal where value > 0 group by all")
def percentile_range(spark, d):
    got = sm.quantiles(v.signal(spark, d).filter("value > 0"), ["roi"], "value", {"lo": 0.02, "mid": 0.5, "hi": 0.95})
    return got.select("roi", r6("lo"), r6("mid"), r6("hi"))


@query("select class, round(avg(x), 4) as x, round(avg(y), 4) as y, round(avg(z), 4) as z, count(*) as n from points group by class")
def centroid(spark, d):
    return v.points(spark, d).groupBy("class").agg(*(F.round(F.avg(c), 4).alias(c) for c in "xyz"), F.count("*").alias("n"))


@query("select source, target, round(sum(pdc) + 1e-9, 6) as total, round(max(pdc) + 1e-9, 6) as top, count(*) as n from edges group by all")
def edge_rollup(spark, d):
    return v.edges(spark, d).groupBy("source", "target").agg(tidy(F.sum("pdc"), "total"), tidy(F.max("pdc"), "top"), F.count("*").alias("n"))


@query("select node, round(sum(pdc) + 1e-9, 6) as strength, count(*) as n from (select source as node, pdc from edges union all select target, pdc from edges) group by node")
def node_strength(spark, d):
    return op.node_strength(v.edges(spark, d), "pdc").select("node", tidy("strength", "strength"), "n")


@query("select a.n_name as source, b.n_name as target, round(coalesce(w, 0) + 1e-9, 6) as weight from nation a cross join nation b left join (select source, target, avg(pdc) as w from edges group by all) e on e.source = a.n_name and e.target = b.n_name")
def adjacency_dense(spark, d):
    nation = v.table(spark, d, "nation")
    # the product of the node list with itself is the dense result
    pairs = nation.select(F.col("n_name").alias("source")).crossJoin(nation.select(F.col("n_name").alias("target")))
    mean = v.edges(spark, d).groupBy("source", "target").agg(F.avg("pdc").alias("w"))
    return pairs.join(mean, ["source", "target"], "left").select("source", "target", tidy(F.coalesce("w", F.lit(0.0)), "weight"))


@query("select click, view, purchase, count(*) as n from (select subject, bool_or(dataset = 'click') as click, bool_or(dataset = 'view') as view, bool_or(dataset = 'purchase') as purchase from membership group by subject) group by all")
def venn_regions(spark, d):
    return op.venn_regions(v.membership(spark, d), "subject", "dataset", ["click", "view", "purchase"])


@query("select subject from membership where dataset = 'click' intersect select subject from membership where dataset = 'view'")
def set_intersect(spark, d):
    m = v.membership(spark, d)
    return m.filter("dataset = 'click'").select("subject").intersect(m.filter("dataset = 'view'").select("subject"))


@query("select subject from membership where dataset = 'click' except select subject from membership where dataset = 'view'")
def set_difference(spark, d):
    m = v.membership(spark, d)
    return m.filter("dataset = 'click'").select("subject").subtract(m.filter("dataset = 'view'").select("subject"))


@query("select subject from membership where dataset = 'click' union select subject from membership where dataset = 'view'")
def set_union(spark, d):
    m = v.membership(spark, d)
    return m.filter("dataset in ('click', 'view')").select("subject").distinct()


@query("select event_type, (props::json->>'k')::int as k, count(*) as n from events group by all")
def json_map_lookup(spark, d):
    k = F.element_at(F.from_json("props", "map<string,string>"), "k").cast("int").alias("k")
    return v.table(spark, d, "events").groupBy("event_type", k).agg(F.count("*").alias("n"))


@query("select id, case when x < 0 then 'L' when x > 0 then 'R' end as hemi, round(greatest(10, least(40, 10 + 30 * (y + 20) / 40)), 4) as size from points")
def hemi_split(spark, d):
    size = F.greatest(F.lit(10.0), F.least(F.lit(40.0), 10 + 30 * (F.col("y") + 20) / 40))
    return v.points(spark, d).select("id", F.when(F.col("x") < 0, "L").when(F.col("x") > 0, "R").alias("hemi"), F.round(size, 4).alias("size"))


@query("select id, vid, round(dist, 4) as dist from (select q.id, c.id as vid, sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2 + (q.z - c.z) ** 2) as dist, row_number() over (partition by q.id order by sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2 + (q.z - c.z) ** 2), c.id) as k from points q join points c on q.id % 50 = 0 and c.id % 50 <> 0) where k = 1")
def nearest_vertex(spark, d):
    p = v.points(spark, d).select("id", "x", "y", "z")
    return op.nearest(p.filter("id % 50 = 0"), p.filter("id % 50 <> 0"), 10.0).select("id", "vid", F.round("dist", 4).alias("dist"))


@query("select channel, sample, round(q + 1e-9, 6) as q from (select *, least(1, min(p * m / k) over (partition by sample order by p desc, channel desc rows unbounded preceding)) as q from (select channel, sample, p, count(*) over (partition by sample) as m, row_number() over (partition by sample order by p, channel) as k from (select channel, sample, 1 / (1 + avg(value)) as p from signal group by all)))")
def bh_fdr(spark, d):
    p = v.signal(spark, d).groupBy("channel", "sample").agg((1 / (1 + F.avg("value"))).alias("p"))
    return op.benjamini_hochberg(p, ["sample"], "p", ["channel"]).select("channel", "sample", r6("q"))


@query("select channel, phase, sample, case when p is not null then round(q + 1e-9, 6) end as q from (select *, least(1, min(p * m / k) over (order by p desc nulls last, channel desc, phase desc, sample desc rows unbounded preceding)) as q from (select channel, phase, sample, case when sample % 7 <> 0 then 1 / (1 + value) end as p, count(case when sample % 7 <> 0 then 1 end) over () as m, row_number() over (order by case when sample % 7 <> 0 then 1 / (1 + value) end nulls last, channel, phase, sample) as k from signal))")
def bh_one_family(spark, d):
    """All samples as one family; those without a p take no rank."""
    p = v.signal(spark, d).select("channel", "phase", "sample", F.when(F.col("sample") % 7 != 0, 1 / (1 + F.col("value"))).alias("p"))
    return op.benjamini_hochberg(p, [], "p", ["channel", "phase", "sample"]).select("channel", "phase", "sample", r6("q"))


@query("select phase, lag, round(corr(x.value, y.value) + 1e-9, 6) as r, count(*) as n from (select phase, sample, avg(value) as value from signal where hemi = 'L' group by all) x join (select phase, sample, avg(value) as value from signal where hemi = 'R' group by all) y using (phase), unnest(range(-6, 7)) t(lag) where y.sample = x.sample + lag group by all")
def xcorr_lags(spark, d):
    s = v.signal(spark, d).groupBy("phase", "sample").agg(F.avg(F.expr("if(hemi = 'L', value, null)")).alias("x"), F.avg(F.expr("if(hemi = 'R', value, null)")).alias("y"))
    # pairs in which one side has no value don't count
    got = op.lagged_correlation(s.filter("x is not null").select("phase", "sample", "x"), s.filter("y is not null").select("phase", "sample", "y"), ["phase"], "sample", "x", "y", range(-6, 7))
    return got.select("phase", F.col("lag").cast("long").alias("lag"), r6("r"), "n")


@query("select channel, phase, dense_rank() over (partition by phase order by o nulls last, channel) as place from (select channel, phase, min(case when mask then sample end) as o from signal group by all)")
def sort_by_onset(spark, d):
    first = v.signal(spark, d).groupBy("phase", "channel").agg(F.min(F.expr("if(mask, sample, null)")).alias("o"))
    return sm.ranked(first, ["phase"], [F.col("o").asc_nulls_last(), F.col("channel")]).select("channel", "phase", F.col("place").cast("long").alias("place"))


@query("select case when roi = 'ASIA' then 'EAST' when roi = 'EUROPE' then 'NORTH' else roi end as roi, description, count(*) as n from signal_rows where description is null or description not in ('N') group by all")
def scan_multi_source_recode(spark, d):
    rows = v.signal_rows(spark, d).filter(op.not_in_keeping_null("description", ["N"]))
    return op.recode(rows, "roi", {"ASIA": "EAST", "EUROPE": "NORTH"}).groupBy("roi", "description").agg(F.count("*").alias("n"))
