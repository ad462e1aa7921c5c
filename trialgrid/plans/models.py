"""Named queries of the models; with SQL where SQL can express them, else tested on planted signals (tests/test_models.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.operators import decoding as dc
from trialgrid.operators import models as md
from trialgrid.operators import series as op
from trialgrid.operators import stats as st
from trialgrid.plans.queries import QUERIES, query, tidy
from trialgrid.sources import views as v
from trialgrid.sources.work import written

_TRIALS = ", trials as (select trial, label, pos, value from (select vec_id as trial, label, unnest(embedding)::double as value, unnest(range(64)) as pos from embeddings))"


def plain(f):
    """A query without SQL."""
    QUERIES[f.__name__] = f
    return f


@query(", b as (select phase, sample, avg(value) filter (hemi = 'L') as x, avg(value) filter (hemi = 'R') as y from signal group by all), c as (select * from b where x is not null and y is not null), z as (select phase, sample, (x - avg(x) over w) / (stddev_pop(x) over w + 1e-8) as x, (y - avg(y) over w) / (stddev_pop(y) over w + 1e-8) as y, count(*) over w as n from c window w as (partition by phase)), g as (select a.phase, a.sample - b.sample as lag, round(sum(a.x * b.y) / max(a.n) + 1e-9, 6) as r from z a join z b on a.phase = b.phase group by all) select phase, max(r) filter (lag = 0) as zero, arg_min(r, (-abs(r), lag)) as peak, arg_min(lag, (-abs(r), lag)) as peak_lag, count(*) as lags from g group by phase")
def correlogram_peak(spark, d):
    s = v.signal(spark, d).groupBy("phase", "sample").agg(F.avg(F.expr("if(hemi = 'L', value, null)")).alias("x"), F.avg(F.expr("if(hemi = 'R', value, null)")).alias("y"))
    got = op.correlogram(s, ["phase"], "sample", "x", "y").select("phase", "lag", tidy("r", "r"))
    first = F.struct(-F.abs("r"), "lag")
    return got.groupBy("phase").agg(F.max(F.expr("if(lag = 0, r, null)")).alias("zero"), F.min_by("r", first).alias("peak"), F.min_by("lag", first).alias("peak_lag"), F.count("*").alias("lags"))


_CLUSTER = ", d as (select roi, channel, sample, max(value) filter (phase = 'F') - max(value) filter (phase = 'O') as d from signal group by all having count(*) = 2), st as (select roi, perm, sample, round(avg(case when perm > 0 and substr(md5('11:' || perm || ':' || channel), 1, 1) < '8' then -d else d end), 9) as stat from d, unnest(range(51)) t(perm) group by all), o as (select roi, perm, sample, round(count(*) over (partition by roi, sample order by stat desc range unbounded preceding) / 51.0::double, 9) < 0.1 as on_ from st), i as (select *, row_number() over (partition by roi, perm order by sample) - row_number() over (partition by roi, perm, on_ order by sample) as g from o), r as (select roi, perm, min(sample) as start, max(sample) as stop, count(*) as n from i where on_ group by roi, perm, g), most as (select k.roi, k.perm, coalesce(max(n), 0) as most from (select distinct roi, perm from o where perm > 0) k left join r on r.roi = k.roi and r.perm = k.perm group by all)"


@query(f"{_CLUSTER} select r.roi, start, stop, n, round((count(*) filter (most >= n) + 1) / (count(*) + 1) + 1e-9, 6) as p from r join most on most.roi = r.roi where r.perm = 0 group by all")
def cluster_mask(spark, d):
    """Runs of samples at which the two phases differ, against the longest run of each of 50 permutations."""
    s = v.signal(spark, d).groupBy("roi", "channel", "sample").agg(F.max(F.expr("if(phase = 'F', value, null)")).alias("f"), F.max(F.expr("if(phase = 'O', value, null)")).alias("o"))
    diff = s.select("roi", "channel", "sample", (F.col("f") - F.col("o")).alias("d")).na.drop()
    return md.permutation_clusters(diff, ["roi"], "channel", "sample", "d", 50, 11).select("roi", "start", "stop", "n", tidy("p", "p"))


_UNPAIRED = """, s as (select roi, channel, sample, avg(value) as v from signal group by all), u as (select distinct roi, channel, hemi = 'L' as g from signal),
m as (select roi, count(*) filter (g) as m from u group by roi),
b as (select roi, channel, 0 as perm, g as on_ from u union all select roi, channel, perm, row_number() over (partition by roi, perm order by md5('13:' || perm || ':' || channel), channel) <= m from u join m using (roi), unnest(range(1, 51)) t(perm)),
st as (select roi, perm, sample, round(avg(v) filter (on_) - avg(v) filter (not on_), 9) as stat from s join b using (roi, channel) group by all having count(*) filter (on_) > 0 and count(*) filter (not on_) > 0),
o as (select *, p < 0.1 as low from (select *, round(count(*) over (partition by roi, sample order by stat desc range unbounded preceding) / 51.0::double, 9) as p from st)),
i as (select *, row_number() over (partition by roi, perm order by sample) - row_number() over (partition by roi, perm, low order by sample) as g from o),
r as (select roi, perm, min(sample) as start, max(sample) as stop, count(*) as n from i where low group by roi, perm, g),
most as (select k.roi, k.perm, coalesce(max(n), 0) as most from (select distinct roi, perm from o where perm > 0) k left join r on r.roi = k.roi and r.perm = k.perm group by all),
c as (select r.roi, start, stop, (count(*) filter (most >= n) + 1) / (count(*) + 1) as cp from r join most on most.roi = r.roi where r.perm = 0 group by r.roi, start, stop, n)"""


@query(f"{_UNPAIRED} select o.roi, sample, round(stat + 1e-10, 6) as stat, round(p + 1e-9, 6) as pval, round(cp + 1e-9, 6) as cluster_p, coalesce(round(cp, 9) < 0.05 and p < 0.05, false) as mask from o left join c on c.roi = o.roi and low and sample between start and stop where perm = 0")
def cluster_mask_unpaired(spark, d):
    """Samples at which the left channels of a region lie above its right ones, of which there are more or fewer: shuffles of sides over channels."""
    s = v.signal(spark, d).groupBy("roi", "channel", "hemi", "sample").agg(F.avg("value").alias("v")).withColumn("left", F.col("hemi") == "L")
    got = md.two_sample_clusters(s, ["roi"], "channel", "left", "sample", "v", 50, 13)
    return got.select("roi", "sample", F.round(F.col("stat") + 1e-10, 6).alias("stat"), tidy("pval", "pval"), tidy("cluster_p", "cluster_p"), "mask")


@query(f"{_TRIALS}, m as (select pos, perm, round(avg(case when perm > 0 and substr(md5('4:' || perm || ':' || trial), 1, 1) < '8' then -value else value end), 9) as a from trials, unnest(range(40)) t(perm) group by all) select o.pos, round(o.a + 1e-9, 6) as observed, round((count(*) filter (abs(s.a) >= abs(o.a)) + 1) / (count(*) + 1) + 1e-9, 6) as p from m s join m o on s.pos = o.pos and s.perm > 0 and o.perm = 0 group by o.pos, o.a")
def two_sided_mean_p(spark, d):
    flips = md.sign_flips(v.trials(spark, d), "trial", 39, 4)
    means = flips.groupBy("pos", "perm").agg(F.round(F.avg(F.col("sign") * F.col("value")), 9).alias("a"))
    return md.two_sided_p(means, ["pos"], "a").select("pos", tidy("observed", "observed"), tidy("p", "p"))


@query("select vec_id as trial, (row_number() over (order by md5('42:' || vec_id), vec_id) - 1) % 10 as fold from embeddings")
def shuffled_folds(spark, d):
    return st.shuffled_folds(v.table(spark, d, "embeddings").select(F.col("vec_id").alias("trial")), 10, 42)


_GAPPY = ", f as (select trial, label, bool_or((trial * 64 + pos) % 97 = 0) as gap from (select vec_id as trial, label, unnest(range(64)) as pos from embeddings) group by all), g as (select trial, label, gap, (row_number() over (partition by label order by gap, md5('9:' || trial), trial) - 1) % 5 as fold from f)"


def _gappy(spark, d):
    t = v.trials(spark, d).withColumn("value", F.when((F.col("trial") * 64 + F.col("pos")) % 97 != 0, F.col("value")))
    return t, st.folds_spreading_gaps(t, 5, 9)


@query(f"{_GAPPY} select trial, label, gap, fold from g")
def folds_spreading_gaps(spark, d):
    """Trials with missing values are dealt evenly to the folds of their label."""
    return _gappy(spark, d)[1]


_MIX = f"{_TRIALS.replace(', trials as', ', t as')}{_GAPPY}, c as (select a.fold, b.trial, b.label, row_number() over (partition by a.fold, b.label order by md5('9:' || a.fold || ':' || b.trial), b.trial) - 1 as k, count(*) over (partition by a.fold, b.label) as m from (select distinct fold from g) a join g b on b.fold <> a.fold and not b.gap), n as (select a.fold, b.trial, b.label, ('0x' || substr(md5('9:mix:' || a.fold || ':' || b.trial), 1, 8))::bigint as h from (select distinct fold from g) a join g b on b.fold <> a.fold and b.gap), p as (select n.fold, n.trial, x.trial as a, y.trial as b, h / 4294967296.0 as share from n join c x on x.fold = n.fold and x.label = n.label and x.k = h % x.m join c y on y.fold = n.fold and y.label = n.label and y.k = (h + 1) % y.m)"


@query(f"{_MIX} select fold, p.trial, ta.pos, round(share * ta.value + (1 - share) * tb.value + 1e-9, 6) as value from p join t ta on ta.trial = p.a join t tb on tb.trial = p.b and tb.pos = ta.pos where (p.trial * 64 + ta.pos) % 97 = 0")
def mixup_imputed(spark, d):
    """Missing values of training trials, as a convex mix of two complete training trials of the same class."""
    t, folds = _gappy(spark, d)
    return st.mixup(t, folds, 9).select(F.col("fold").cast("long").alias("fold"), "trial", "pos", tidy("value", "value"))


@query("select source, target, round(avg(pdc) + 1e-9, 6) as pdc, round(avg(case when round(pval, 9) < 0.05 then pdc end) + 1e-9, 6) as pdc_sig, round(avg((round(pval, 9) < 0.05)::int) + 1e-9, 6) as sig_ratio from edges where phase = 'F' and win between 8 and 16 group by all having round(avg((round(pval, 9) < 0.05)::int), 9) > 0.3")
def connectivity_matrix(spark, d):
    """Cells of one phase and window that are significant often enough."""
    return op.edge_cells(v.edges(spark, d).filter("phase = 'F' and win between 8 and 16"), ["source", "target"], 0.05, 0.3).select("source", "target", tidy("pdc", "pdc"), tidy("pdc_sig", "pdc_sig"), tidy("sig_ratio", "sig_ratio"))


_FACTOR = ", f as (select win // 8 as component, source, target, avg(pdc) as w from edges group by all having round(avg(pdc), 9) > 0.5), l as (select f.*, coalesce(a.n_regionkey::varchar, 'Unknown') as sr, coalesce(b.n_regionkey::varchar, 'Unknown') as tr from f left join (select * from nation where n_nationkey % 6 <> 0) a on a.n_name = source left join (select * from nation where n_nationkey % 6 <> 0) b on b.n_name = target)"


@query(f"{_FACTOR} select component, source, target, sr as source_roi, tr as target_roi, sr = '1' as source_is_ins, tr = '1' as target_is_ins, round(w + 1e-9, 6) as weight from l")
def factor_export(spark, d):
    """Edges of each component over a weight, with regions by lookup and class flags; the source has no self edges."""
    from trialgrid.operators import joins as jn

    f = v.edges(spark, d).groupBy(F.floor(F.col("win") / 8).alias("component"), "source", "target").agg(F.avg("pdc").alias("w")).filter((F.round("w", 9) > 0.5) & (F.col("source") != F.col("target")))
    roi = v.table(spark, d, "nation").filter("n_nationkey % 6 <> 0").select("n_name", F.col("n_regionkey").cast("string").alias("roi"))
    got = jn.double_lookup(f, roi, "n_name", "roi", ("source", "target"), "Unknown")
    return got.select("component", "source", "target", "source_roi", "target_roi", (F.col("source_roi") == "1").alias("source_is_ins"), (F.col("target_roi") == "1").alias("target_is_ins"), tidy("w", "weight"))


@query(", c as (select win // 8 as component, win, source, target, avg(pdc) as w from edges group by all), t as (select component, win, round(avg(w) + 1e-9, 6) as m from c group by all), e as (select component, source, target, round(max(w) + 1e-9, 6) as w from c group by all) select component, string_agg(win, ',' order by k) as peaks, (select string_agg(source || '>' || target, ',' order by k) from (select *, row_number() over (partition by component order by w desc, source, target) as k from e) x where x.component = q.component and k <= 3) as edges, (select max(w) from e where e.component = q.component) as most from (select *, row_number() over (partition by component order by m desc, win) as k from t) q where k <= 3 group by component")
def component_summary(spark, d):
    """Largest weight, three times of the highest mean and three strongest edges of each component."""
    c = v.edges(spark, d).groupBy(F.floor(F.col("win") / 8).alias("component"), "win", "source", "target").agg(F.avg("pdc").alias("w"))
    times = c.groupBy("component", "win").agg(tidy(F.avg("w"), "m"))
    edges = c.groupBy("component", "source", "target").agg(tidy(F.max("w"), "w"))
    peaks = op.top_names(times, "component", ["m"], ["win"], F.col("win").cast("string"), 3, "peaks")
    strong = op.top_names(edges, "component", ["w"], ["source", "target"], F.concat("source", F.lit(">"), "target"), 3, "edges")
    return edges.groupBy("component").agg(F.max("w").alias("most")).join(peaks, "component").join(strong, "component")


_GROUP = ", m as (select source, target, subject, round(avg(pdc) - 0.5, 9) as m from edges where round(pval, 9) < 0.05 group by all), k as (select *, rank() over (partition by source, target order by round(abs(m), 9)) + (count(*) over (partition by source, target, round(abs(m), 9)) - 1) / 2 as r from m), g as (select source, target, count(*) as n, avg(m) as mean, stddev_samp(m) as sd, sum(case when m > 0 then r else 0 end) as w from k group by all)"


def _group(spark, d, rank_zeros=False):
    e = v.edges(spark, d)
    means = e.filter(F.round("pval", 9) < 0.05).groupBy("source", "target", "subject").agg(F.round(F.avg("pdc") - 0.5, 9).alias("m"))
    return st.group_tests(means, ["source", "target"], "m", rank_zeros=rank_zeros)


@query(f"{_GROUP} select source, target, n, round(mean + 1e-9, 6) as mean, round(case when n >= 3 and sd > 0 then mean / (sd / sqrt(n)) end, 5) as t, case when n >= 3 then w end as wilcoxon from g")
def group_tests(spark, d):
    """Per edge over subjects: mean, one-sample t and signed-rank sum, zeros ranked; at least three subjects."""
    return _group(spark, d, True).select("source", "target", "n", tidy("mean", "mean"), F.round("t", 5).alias("t"), "wilcoxon")


@query(f"{_GROUP} select source, target, n, round(mean + 1e-9, 6) as mean, case when n >= 3 then w end as wilcoxon from g join (select source, target from (select source, target, round(avg(pdc) + 1e-9, 6) as s from edges group by all) order by s desc, source, target limit 15) using (source, target)")
def top_edges_validated(spark, d):
    """The group tests of the 15 strongest edges, in one pass over all."""
    top = v.edges(spark, d).groupBy("source", "target").agg(tidy(F.avg("pdc"), "s")).orderBy(F.desc("s"), "source", "target").limit(15)
    return _group(spark, d, True).join(F.broadcast(top.select("source", "target")), ["source", "target"]).select("source", "target", "n", tidy("mean", "mean"), "wilcoxon")


_SIGNED = ", m as (select source, target, subject, round(avg(pdc) - 0.5, 9) as m from edges where round(pval, 9) < 0.05 group by all), n as (select source, target, count(*) as n from m group by all), z as (select *, round(abs(m), 9) as size from m where round(abs(m), 9) > 0), k as (select *, rank() over (partition by source, target order by size) + (count(*) over (partition by source, target, size) - 1) / 2 as r, count(*) over (partition by source, target, size) as t from z), g as (select source, target, count(*) as n_ranked, sum(case when m > 0 then r else 0 end) as w, sum(t * t - 1) as ties from k group by all)"


@query(f"{_SIGNED} select source, target, n, coalesce(n_ranked, 0) as n_ranked, coalesce(ties, 0)::bigint as ties, case when n >= 3 then w end as wilcoxon from n left join g using (source, target)")
def group_signed_ranks(spark, d):
    """Signed-rank sums without zeros, and the ties among the others."""
    return _group(spark, d).select("source", "target", "n", "n_ranked", "ties", "wilcoxon")


@plain
def group_p_values(spark, d):
    """One-sided p of the group tests without zeros: Student's t, and the signed-rank sum, exact where there are no ties."""
    return st.with_p_values(_group(spark, d)).select("source", "target", "n", "t", "wilcoxon", "p_t", "p_wilcoxon")


# --- ridge and its scores ---


def _folded(spark, d, k=5):
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.join(st.stratified_folds(e.select("trial", "label"), k).select("trial", F.col("fold").cast("int").alias("fold")), "trial")


def _numbered(spark, d):
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").cast("double").alias("t"), F.col("embedding").alias("x"))
    return e.join(st.shuffled_folds(e.select("trial"), 10, 42), "trial")


@plain
def ridge_encode(spark, d):
    """Ridge of the label's number on each channel's samples, scaled over all trials, out of ten folds: rank correlation with the truth and its two-sided p over 100 shuffles."""
    return dc.encode(_numbered(spark, d), 8, 8, 100, 1)


@plain
def encoding_channels(spark, d):
    """How many channels there are and how many encode with p under 0.05, before and after adjusting."""
    got = op.benjamini_hochberg(written(dc.encode(_numbered(spark, d), 8, 8, 40, 1), "encoding"), [], "p", ["channel"])
    return got.agg(F.count("*").alias("channels"), F.count_if(F.round("p", 9) < 0.05).alias("significant"), F.count_if(F.round("q", 9) < 0.05).alias("adjusted"))


@plain
def ridge_predict_r2(spark, d):
    """Principal components of 85 % of the variance, then ridge on all features, ten folds: mean R2 of the folds, and its one-sided p over 100 shuffles of the training targets."""
    return st.empirical_p(dc.predict_shuffled(_numbered(spark, d), 64, 100, 2, variance=0.85), [], "r2")


@plain
def ridge_decode(spark, d):
    """One-against-rest ridge classifier on principal components, ten folds: accuracy out of fold and its p over 200 shuffles of the training labels."""
    return st.empirical_p(dc.decode_shuffled(_folded(spark, d, 10), 64, 200, 3, variance=0.85), [], "accuracy")


@plain
def svm_decode(spark, d):
    """Support vector machines on folds dealt without regard to the label, balanced accuracy by fold."""
    trials = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), "label", "embedding").withColumnRenamed("embedding", "x")
    return dc.cross_validate(trials, 64, dc.linear_svm, lambda t: st.shuffled_folds(t, 5, 17), dc.balanced_accuracy)


@plain
def temporal_generalisation(spark, d):
    """Train at one sample, test at another: accuracy of a one-against-rest ridge over channels, out of fold."""
    got = dc.generalisation(_folded(spark, d), 8, 8, 1, 1, 0, 3)
    return got.select(F.col("train").alias("t_train"), F.col("test").alias("t_test"), "accuracy")


@plain
def temporal_generalisation_p(spark, d):
    """Train in one window of four samples, test in another, every two samples: accuracy, its p over 30 shuffles of the training labels, and that p adjusted over the map."""
    scores = written(dc.generalisation(_folded(spark, d), 8, 8, 4, 2, 30, 3, variance=0.85), "generalisation")
    return op.benjamini_hochberg(st.empirical_p(scores, ["train", "test"], "accuracy"), [], "p", ["train", "test"])


@plain
def generalisation_clusters(spark, d):
    """Train at one sample, test at another, even against odd labels: clusters of the map of accuracies against 20 shuffles of the training labels."""
    trials = _folded(spark, d).withColumn("label", F.col("label") % 2)
    scores = dc.generalisation(trials, 8, 8, 1, 1, 20, 6).withColumnsRenamed({"train": "row", "test": "col"})
    return md.grid_clusters(written(scores, "map"), [], "accuracy", 20)[0]


# --- connectivity ---


@plain
def directed_coherence_p(spark, d):
    """Partial directed coherence of windows of trials, each edge's p over 20 circular-shift surrogates."""
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), (F.col("label") % 2).alias("win"), F.col("embedding").cast("array<double>").alias("m"))
    trials = md.shifted_trials(e, "trial", 8, 8, 20, 5)
    pdc = md.directed_coherence(trials, ["win", "perm"], 8, 2)
    return st.empirical_p(pdc, ["win", "source", "target"], "pdc")


def _region_trials(spark, d):
    """(hemi, trial, m): mean values of every region (by name) and month, row by row, 0 where there is none; the numbers of regions and months."""
    rows = v.signal_rows(spark, d).groupBy("hemi", "trial", "roi", "sample").agg(F.avg("value").alias("value"))
    rois = [r.r_name for r in v.table(spark, d, "region").select("r_name").distinct().orderBy("r_name").collect()]  # a small dimension
    months = (rows.agg(F.max("sample")).first()[0] or 0) + 1
    at = (F.array_position(F.array(*(F.lit(x) for x in rois)), F.col("roi")) - 1) * months + F.col("sample")
    return md.dense(rows.filter("sample >= 0").withColumn("at", at.cast("int")), ["hemi", "trial"], "at", "value", len(rois) * months, "m"), len(rois), months


@plain
def windowed_coherence(spark, d):
    """Partial directed coherence between regions in windows of two years every half year, each edge's p over 30 circular shifts within the window."""
    trials, channels, _ = _region_trials(spark, d)
    return md.windowed_coherence(trials, ["hemi"], "trial", channels, 2, 24, 6, 30, 5)


@plain
def edge_factors(spark, d):
    """Factors of the (edge x time) table of mean weights: one row an edge and component. Time runs from the first quarter of the data to the last."""
    cells = v.edges(spark, d).groupBy(F.concat("source", F.lit(">"), "target").alias("key"), "win").agg(F.avg("pdc").alias("p"))
    ends = cells.agg(F.min("win").alias("lo"), F.max("win").alias("hi")).first()
    quarters = ends.hi - ends.lo + 1 if ends.hi is not None else 0
    rows = md.dense(cells.withColumn("at", F.col("win") - F.lit(ends.lo or 0)), ["key"], "at", "p", quarters, "v")
    w, _, _ = md.factorise(rows, 3, iterations=10)
    return w.select("key", F.posexplode("w").alias("component", "weight"))


@plain
def mixed_model(spark, d):
    """Value on side and phase with a random intercept by subject: coefficients and both variances."""
    s = v.signal(spark, d).select("subject", "value", (F.col("hemi") == "L").cast("double").alias("left"), (F.col("phase") == "F").cast("double").alias("f"))
    s = s.withColumn("both", F.col("left") * F.col("f"))
    beta, within, between = md.random_intercept(s, "subject", "value", ["left", "f", "both"])
    rows = [*zip(["intercept", "left", "f", "left:f"], map(float, beta), strict=True), ("within", within), ("between", between)]
    return spark.createDataFrame(rows, "term string, estimate double")


