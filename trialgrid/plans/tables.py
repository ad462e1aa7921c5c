"""Named queries of scans, sinks, aggregates and orderings, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialgrid.functions import labels as lb
from trialgrid.operators import joins as jn
from trialgrid.operators import series as op
from trialgrid.operators import summaries as sm
from trialgrid.plans.queries import query, tidy
from trialgrid.sources import files
from trialgrid.sources import views as v
from trialgrid.sources.work import work_path

# --- scans and sinks ---


@query("select subject, phase, channel, sample, round(value + 1e-9, 6) as value from signal where phase = 'F'")
def tidy_round_trip(spark, d):
    """Tidy CSV files, one folder a (subject, phase), found again by their paths, which give the entities back."""
    path = files.write_tidy(v.signal(spark, d).select("subject", "phase", "channel", "sample", tidy("value", "value")), ["subject", "phase"], "tidy")
    return files.scan_tidy(spark, [path], "channel string, sample int, value double", ["subject", "phase"]).filter("phase = 'F'").select("subject", "phase", "channel", "sample", "value")


@query("select task, event_type, count(*) as n, round(sum(value), 4) as total from (select 'a' as task, * from events where event_id % 2 = 0 union all select 'b', * from events where event_id % 3 = 0) group by all")
def multi_root_scan(spark, d):
    """Several roots, one list of paths, one read."""
    e = v.table(spark, d, "events").select("event_id", "event_type", "value")
    roots = [files.write_tidy(e.filter(f"event_id % {k} = 0").withColumn("task", F.lit(t)), ["task", "event_type"], "root") for t, k in (("a", 2), ("b", 3))]
    rows = files.scan_tidy(spark, roots, "event_id long, value double", ["task", "event_type"])
    return rows.groupBy("task", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select subject, phase as description, 'time' as suffix, count(*) as n, round(sum(value) + 1e-9, 5) as total from (select subject, phase, round(value + 1e-9, 6) as value from signal where phase = 'O') group by all")
def named_round_trip(spark, d):
    """CSV files that carry their entities in their names, found and read by them: those of one description."""
    rows = v.signal(spark, d).select("subject", F.col("phase").alias("description"), "channel", tidy("value", "value"))
    path = files.write_named(rows, ["subject", "description"], "time", "named")
    got = files.scan_named(spark, [path], "channel string, value double", ["subject", "description", "suffix"], {"description": "O", "session": None})
    return got.groupBy("subject", "description", "suffix").agg(F.count("*").alias("n"), tidy(F.sum("value"), "total", 5))


_ODD = "case event_id % 8 when 0 then 'a+b' when 1 then 'c:d' when 2 then 'é%' when 3 then null when 4 then '' when 5 then 'x y/z' when 6 then 'k=v_w-u.t' else event_type end"


@query(f"select {_ODD} as word, count(*) as n, sum(event_id)::bigint as total from events group by all")
def odd_path_values(spark, d):
    """Keys with characters that paths escape, empty and missing ones, written as folders and read back."""
    word = F.expr(_ODD)
    path = files.write_tidy(v.table(spark, d, "events").select("event_id", word.alias("word")), ["word"], "odd")
    return files.scan_tidy(spark, [path], "event_id long", ["word"]).groupBy("word").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("select count(*) filter (event_id % 9 <> 0) as good, count(*) filter (event_id % 9 = 0) as damaged, round(sum(value) filter (event_id % 9 <> 0), 4) as total from events")
def damaged_rows(spark, d):
    """Lines that don't fit the schema are counted and skipped."""
    path = work_path(spark, "damaged")
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("broken;"), "event_id")).otherwise(F.concat_ws(",", "event_id", "value"))
    v.table(spark, d, "events").select(line.alias("line")).write.text(path)
    good, damaged = files.scan_tolerant(spark, path, "event_id long, value double")
    counts = damaged.agg(F.sum("good").alias("good"), F.sum("damaged").alias("damaged"), F.sum("with_event_id").alias("ids")).filter("ids >= good").drop("ids")
    return counts.join(good.agg(F.round(F.sum("value"), 4).alias("total")), F.lit(True))  # one row each


@query("select trial, label, pos - 16 as pos, value from (select vec_id as trial, label, unnest(embedding)::double as value, unnest(range(64)) as pos from embeddings) where label in (2, 5) and pos >= 16 and pos < 32")
def trial_tensor(spark, d):
    """Trials of some labels and a slice of their features, renumbered."""
    t = v.trials(spark, d).filter(F.col("label").isin(2, 5) & (F.col("pos") >= 16) & (F.col("pos") < 32))
    return t.select("trial", "label", (F.col("pos") - 16).alias("pos"), "value")


@query("select word, count(*) as n from (select case event_type when 'click' then 'press' when 'view' then 'look' end as word from events) where word is not null group by word")
def event_words(spark, d):
    """Event codes become words by a map; codes it lacks are left out."""
    names = spark.createDataFrame([("click", "press"), ("view", "look")], "event_type string, word string")
    return v.table(spark, d, "events").join(F.broadcast(names), "event_type").groupBy("word").agg(F.count("*").alias("n"))


@query("select vec_id as id, pos // 8 as source, pos % 8 as target, value from (select vec_id, unnest(embedding)::double as value, unnest(range(64)) as pos from embeddings) where pos // 8 <> pos % 8")
def cube_to_edges(spark, d):
    """A matrix a row becomes edges; those of a node with itself are dropped."""
    e = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "value"))
    return e.select("id", F.floor(F.col("pos") / 8).alias("source"), (F.col("pos") % 8).cast("long").alias("target"), F.col("value").cast("double").alias("value")).filter("source <> target")


@query("select vec_id as id, unnest(embedding[1:5])::double as score, unnest(range(5)) as fold, embedding[6]::double as p, round(list_avg(embedding[7:16]), 5) as perm from embeddings")
def score_rows(spark, d):
    """An array result as rows: a fold each, the scalar p with all, the mean of the permutations."""
    e = v.table(spark, d, "embeddings").withColumn("x", F.col("embedding").cast("array<double>"))
    mean = F.aggregate(F.slice("x", 7, 10), F.lit(0.0), lambda a, x: a + x) / 10
    return e.select(F.col("vec_id").alias("id"), F.posexplode(F.slice("x", 1, 5)).alias("fold", "score"), F.col("x")[5].alias("p"), F.round(mean, 5).alias("perm")).withColumn("fold", F.col("fold").cast("long"))


@query("select event_id, try_cast(json_extract_string(try_cast(t as json), '$.k') as int) as k from (select event_id, case when event_id % 5 = 0 then left(props, 4) when event_id % 7 = 0 then null else props end as t from events)")
def json_tolerant(spark, d):
    """Bad JSON and null give null."""
    text = F.when(F.col("event_id") % 5 == 0, F.left("props", F.lit(4))).when(F.col("event_id") % 7 == 0, None).otherwise(F.col("props"))
    return v.table(spark, d, "events").select("event_id", F.try_element_at(F.from_json(text, "map<string,string>"), F.lit("k")).try_cast("int").alias("k"))


@query("select p_partkey::int as id, replace(p_name, ' ', '_') as name from part where p_partkey % 10 <> 0")
def lookup_lines(spark, d):
    """A table as text: id and name apart by spaces, comments and headings between."""
    path = work_path(spark, "lut")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    line = F.when(F.col("p_partkey") % 20 == 0, F.concat(F.lit("# "), name)).when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("name "), name)).otherwise(F.concat(F.lit("  "), "p_partkey", F.lit("   "), name, F.lit("  0 1 2")))
    v.table(spark, d, "part").select(line.alias("line")).write.text(path)
    return files.lookup_lines(spark, path)


@query("select 'events' as dataset, user_id as subject from events group by all union all select 'contacts', id from contacts group by all")
def subject_catalogue(spark, d):
    own = lambda df, c, name: df.select(F.lit(name).alias("dataset"), F.col(c).alias("subject")).distinct()
    return own(v.table(spark, d, "events"), "user_id", "events").unionByName(own(v.contacts(spark, d), "id", "contacts"))


@query("select 'supplier' as source, count(*) as n, null::varchar as missing from supplier union all select 'part', 0, 's_acctbal' union all select 'part', 0, 's_nationkey'")
def required_columns(spark, d):
    """Sources without a needed column are skipped with the reason."""
    good, missing = files.with_columns({t: v.table(spark, d, t) for t in ("supplier", "part")}, ["s_acctbal", "s_nationkey"])
    out = spark.createDataFrame([(s, 0, c) for s, c in missing], "source string, n long, missing string")
    for name, df in good.items():
        out = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n", F.lit(None).cast("string").alias("missing")).unionByName(out)
    return out


@query("select channel, phase, sample, round(value + 1e-9, 6) as value, 'hg' as band, '0.05' as alpha from signal where mask")
def array_sink(spark, d):
    rows = v.signal(spark, d).filter("mask").select("channel", "phase", "sample", tidy("value", "value"))
    return files.read_with_params(spark, files.write_with_params(rows, {"band": "hg", "alpha": 0.05}, "array"))


@query("select channel, phase, count(*) as n from signal where abs(time) <= 1.5 group by all having count(*) >= 20")
def run_by_params(spark, d):
    """A query whose limits are the parameters that a run was stored with."""
    path = files.write_with_params(v.signal(spark, d).select("channel", "phase", "time"), {"reach": 1.5, "least": 20}, "run")
    p = files.run_params(spark, path, {"reach": "double", "least": "long"})
    rows = spark.read.parquet(f"{path}/data").filter(F.abs("time") <= p["reach"])
    return rows.groupBy("channel", "phase").agg(F.count("*").alias("n")).filter(F.col("n") >= p["least"])


@query("select component, source, target, weight, row_number() over (order by component, weight desc, source, target) as place from (select win // 8 as component, source, target, round(avg(pdc) + 1e-9, 6) as weight from edges group by all)")
def edge_export(spark, d):
    """Edges in order of component and falling weight, written as CSV and read back; the place shows the order of the export."""
    rows = v.edges(spark, d).groupBy(F.floor(F.col("win") / 8).alias("component"), "source", "target").agg(tidy(F.avg("pdc"), "weight"))
    placed = sm.global_place(rows, [F.col("component"), F.desc("weight"), F.col("source"), F.col("target")])
    path = work_path(spark, "export")
    placed.orderBy("place").write.option("header", True).csv(path)
    return spark.read.schema("component long, source string, target string, weight double, place long").option("header", True).csv(path)


@query("select subject, phase, band, radius from (select distinct subject, phase from signal), (values ('hg'), ('beta')) b(band), (values (3), (5), (10)) r(radius)")
def job_grid(spark, d):
    return files.job_grid(v.signal(spark, d), ["subject", "phase"], {"band": ["hg", "beta"], "radius": [3, 5, 10]})


# --- aggregates ---


@query("select channel, round(avg(value) + 1e-9, 6) as mean from signal_rows where sample between 12 and 70 group by channel")
def mean_over_crop(spark, d):
    return v.signal_rows(spark, d).filter(F.col("sample").between(12, 70)).groupBy("channel").agg(tidy(F.avg("value"), "mean"))


@query("select phase, sample, round(avg(case when mask then value end) + 1e-9, 6) as mean, count(*) as n from signal group by all")
def mean_ignoring_nan(spark, d):
    x = F.when(F.col("mask"), F.col("value")).otherwise(float("nan"))
    return v.signal(spark, d).groupBy("phase", "sample").agg(tidy(F.avg(F.nanvl(x, F.lit(None))), "mean"), F.count("*").alias("n"))


@query("select channel, round(max(value) + 1e-9, 6) as peak, round(avg(value) + 1e-9, 6) as mean, arg_min(roi, sample * 10 + (phase = 'O')::int) as roi, arg_min(hemi, sample * 10 + (phase = 'O')::int) as hemi, arg_min(phase, sample * 10 + (phase = 'O')::int) as phase from signal where time between -1 and 1 group by channel")
def peak_with_attributes(spark, d):
    """Peak and mean of a window, with the attributes of the first row in order of sample and phase."""
    first = F.col("sample") * 10 + (F.col("phase") == "O").cast("int")
    rows = v.signal(spark, d).filter(F.col("time").between(-1, 1))
    return rows.groupBy("channel").agg(tidy(F.max("value"), "peak"), tidy(F.avg("value"), "mean"), *(F.min_by(c, first).alias(c) for c in ("roi", "hemi", "phase")))


@query("select roi, count(*) filter (hemi = 'L') as l, count(*) filter (hemi = 'R') as r, count(*) filter (hemi = 'X') as x, count(*) as n, max(subject) as top from (select distinct roi, hemi, subject, channel from signal) group by roi")
def class_counts(spark, d):
    """Counts by class, 0 for one that is absent."""
    rows = v.signal(spark, d).select("roi", "hemi", "subject", "channel").distinct()
    return rows.groupBy("roi").agg(*(F.count_if(F.col("hemi") == h).alias(h.lower()) for h in "LRX"), F.count("*").alias("n"), F.max("subject").alias("top"))


@query("select roi, subject, n from (select *, row_number() over (partition by roi order by n desc, subject) as k from (select roi, subject, count(*) as n from signal group by all)) where k = 1")
def modal_group(spark, d):
    """The largest group of each region, the first name on ties."""
    sizes = v.signal(spark, d).groupBy("roi", "subject").agg(F.count("*").alias("n"))
    return jn.keep_first(sizes, ["roi"], [F.desc("n"), F.col("subject")])


@query("select phase, sample, bool_or(mask) as any_mask, bool_and(mask) as all_mask, round(min(1 / (1 + value)) + 1e-9, 6) as p from signal group by all")
def any_and_least(spark, d):
    p = 1 / (1 + F.col("value"))
    return v.signal(spark, d).groupBy("phase", "sample").agg(F.bool_or("mask").alias("any_mask"), F.bool_and("mask").alias("all_mask"), tidy(F.min(p), "p"))


@query("select roi, round(stddev_pop(m) + 1e-9, 6) as sd, round(avg(m) + 1e-9, 6) as mean, count(*) as n from (select roi, trial, avg(value) as m from signal_rows group by all) group by roi")
def spread_over_folds(spark, d):
    folds = v.signal_rows(spark, d).groupBy("roi", "trial").agg(F.avg("value").alias("m"))
    return folds.groupBy("roi").agg(tidy(F.stddev_pop("m"), "sd"), tidy(F.avg("m"), "mean"), F.count("*").alias("n"))


@query("select source, string_agg(subject || '=' || n, ',' order by subject) as means from (select source, subject, count(*) as n from edges group by all) group by source")
def group_map(spark, d):
    """A map of a value by subject for each key (here as text)."""
    got = v.edges(spark, d).groupBy("source", "subject").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", "n"))))
    text = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return got.groupBy("source").agg(pairs.alias("m")).select("source", text.alias("means"))


@query(", s as (select node, sum(pdc) as strength from (select source as node, pdc from edges union all select target, pdc from edges) group by node) select node, round(strength * case when node = 'NATION_1' then 1.5 * (select avg(strength) from s where node <> 'NATION_1') / strength else 1 end + 1e-9, 4) as strength from s")
def rescaled_group(spark, d):
    """The total of one node is set to 1.5 times the mean of the others."""
    s = op.node_strength(v.edges(spark, d), "pdc").select("node", "strength")
    return sm.rescaled(s, "node", "NATION_1", "strength", 1.5).select("node", tidy("strength", "strength", 4))


@query("select case when contains(source, '1') then 'one' when contains(target, '2') then 'two' else 'rest' end as category, count(*) as n, round(sum(pdc) + 1e-9, 4) as total from edges group by all")
def category_totals(spark, d):
    kind = lb.first_rule([(F.contains("source", F.lit("1")), "one"), (F.contains("target", F.lit("2")), "two")], "rest")
    return v.edges(spark, d).groupBy(kind.alias("category")).agg(F.count("*").alias("n"), tidy(F.sum("pdc"), "total", 4))


_BOOT = ", m as (select roi, subject, avg(value) as x from signal group by all), w as (select roi, subject, x, b, ('0x' || substr(md5('3|boot|' || b || '|' || subject), 1, 8))::bigint / 4294967296.0 as u from m, unnest(range(200)) t(b)), r as (select roi, b, sum(x * k) / nullif(sum(k), 0) as mean from (select *, case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 when u < 0.9963401531726563 then 4 when u < 0.9994058151824183 then 5 else 6 end as k from w) group by all)"


@query(f"{_BOOT} select roi, round(quantile_cont(mean, 0.025) + 1e-9, 6) as lo, round(quantile_cont(mean, 0.975) + 1e-9, 6) as hi, count(mean) as n from r group by roi")
def bootstrap_interval(spark, d):
    """Interval of a mean over subjects from Poisson weights that hang on replicate and subject alone."""
    means = v.signal(spark, d).groupBy("roi", "subject").agg(F.avg("value").alias("x"))
    return sm.bootstrap(means, "roi", "subject", "x", 200, 3).select("roi", tidy("lo", "lo"), tidy("hi", "hi"), "n")


_CURVE = ", m as (select roi, sample, subject, avg(value) as x from signal group by all), w as (select *, ('0x' || substr(md5('4|boot|' || b || '|' || subject), 1, 8))::bigint / 4294967296.0 as u from m, unnest(range(60)) t(b)), r as (select roi, sample, b, sum(x * k) / nullif(sum(k), 0) as mean from (select *, case when u < 0.36787944117144233 then 0 when u < 0.7357588823428847 then 1 when u < 0.9196986029286058 then 2 when u < 0.9810118431238462 then 3 when u < 0.9963401531726563 then 4 when u < 0.9994058151824183 then 5 else 6 end as k from w) group by all)"


@query(f"{_CURVE} select roi, sample, n, mean, lo, hi from (select roi, sample, count(*) as n, round(avg(x) + 1e-9, 6) as mean from m group by all) join (select roi, sample, round(quantile_cont(mean, 0.025) + 1e-9, 6) as lo, round(quantile_cont(mean, 0.975) + 1e-9, 6) as hi from r group by all) using (roi, sample)")
def curve_interval(spark, d):
    """Mean over subjects by region and sample with its bootstrap band; a replicate weighs a subject alike at all times."""
    means = v.signal(spark, d).groupBy("roi", "sample", "subject").agg(F.avg("value").alias("x"))
    return sm.mean_curve(means, ["roi"], "sample", "subject", "x", 60, 4).select("roi", "sample", "n", tidy("mean", "mean"), tidy("lo", "lo"), tidy("hi", "hi"))


@query("select subject, bool_or(dataset = 'click') as click, bool_or(dataset = 'view') as view, bool_or(dataset = 'purchase') as purchase, count(*) filter (dataset in ('click', 'view', 'purchase')) as sets from membership group by subject")
def membership_matrix(spark, d):
    return sm.membership_matrix(v.membership(spark, d), "subject", "dataset", ["click", "view", "purchase"])


_GRID = ", b as (select least(floor((x + 40) / 4), 19)::bigint as i, least(floor((y + 40) / 4), 19)::bigint as j, count(*) as n from points where abs(x) <= 40 and abs(y) <= 40 group by all), s as (select i + k as i, j, sum(n * exp(-k * k / 4.5)) as n from b, unnest(range(-6, 7)) t(k) group by all), t as (select i, j + k as j, sum(n * exp(-k * k / 4.5)) as n from s, unnest(range(-6, 7)) t(k) group by all)"


@query(f"{_GRID} select i, j, round(n / m + 1e-9, 6) as density from (select *, max(n) over () as m from t where i between 0 and 19 and j between 0 and 19) where round(n / m, 9) >= 0.1")
def density_grid(spark, d):
    """Points counted on a grid, smoothed along both axes, against the peak; cells of a tenth and more."""
    return sm.density(v.points(spark, d), "x", "y", (-40.0, 40.0), 20, 1.5, 6, 0.1).select("i", "j", tidy("density", "density"))


_OPEN = ", e as (select min(x) - 5 as lx, (max(x) + 5 - (min(x) - 5)) / 30 as wx, min(y) - 5 as ly, (max(y) + 5 - (min(y) - 5)) / 30 as wy from points), b as (select least(floor((x - lx) / wx), 29)::bigint as i, least(floor((y - ly) / wy), 29)::bigint as j, count(*) as n from points, e group by all), s as (select i + k as i, j, sum(n * exp(-k * k / 4.5)) as n from b, unnest(range(-6, 7)) t(k) group by all), t as (select i, j + k as j, sum(n * exp(-k * k / 4.5)) as n from s, unnest(range(-6, 7)) t(k) group by all)"


@query(f"{_OPEN} select i, j, round(n / m + 1e-9, 6) as density from (select *, max(n) over () as m from t where i between 0 and 29 and j between 0 and 29) where round(n / m, 9) >= 0.05")
def density_from_data(spark, d):
    """The same on bounds five beyond the outermost points, so that every point counts."""
    return sm.density(v.points(spark, d), "x", "y", None, 30, 1.5, 6, 0.05).select("i", "j", tidy("density", "density"))


@query("select 'event_type' as name, event_type as value, count(*) as n from events group by all union all select 'user_id', user_id::varchar, count(*) from events group by all")
def value_profile(spark, d):
    """Distinct values of columns with their counts."""
    e = v.table(spark, d, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"))
    return e.unpivot([], ["event_type", "user_id"], "name", "value").groupBy("name", "value").agg(F.count("*").alias("n"))


# --- order ---


@query("select phase, min(sample) as start, max(sample) as stop, count(*) as n from (select phase, sample, on_, row_number() over (partition by phase order by sample) - row_number() over (partition by phase, on_ order by sample) as g from (select phase, sample, round(avg(mask::int), 9) >= 0.3 as on_ from signal group by all)) where on_ group by phase, g")
def fraction_runs(spark, d):
    """Runs of samples in which at least 0.3 of the channels are significant."""
    share = v.signal(spark, d).groupBy("phase", "sample").agg((F.round(F.avg(F.col("mask").cast("int")), 9) >= 0.3).alias("on"))
    return op.runs(share, ["phase"], "sample", "on")


@query("select roi, hemi, channel, place, row_number() over (partition by roi order by hemi desc, place) as line from (select roi, hemi, channel, row_number() over (partition by roi, hemi order by o nulls last, channel) as place from (select roi, hemi, channel, min(case when mask then sample end) as o from signal group by all))")
def stacked_groups(spark, d):
    """Channels by onset within each side, the right side over the left."""
    first = v.signal(spark, d).groupBy("roi", "hemi", "channel").agg(F.min(F.expr("if(mask, sample, null)")).alias("o"))
    return sm.stacked(first, ["roi"], "hemi", [F.col("o").asc_nulls_last(), F.col("channel")]).select("roi", "hemi", "channel", "place", "line")


_STACK = ", f as (select roi, hemi, channel, min(case when mask then sample end) as o from signal group by all), p as (select *, row_number() over (partition by roi order by hemi desc, o nulls last, channel) as line from f), h as (select roi, max(line) as n, max(max(line)) over () as most from p group by roi)"


@query(f"{_STACK} select roi, hemi, channel, line from p union all select roi, null, null, unnest(range(n + 1, most + 1)) from h")
def stacked_to_height(spark, d):
    """The same, filled at the end with empty lines to the height of the largest region."""
    first = v.signal(spark, d).groupBy("roi", "hemi", "channel").agg(F.min(F.expr("if(mask, sample, null)")).alias("o"))
    got = sm.stacked(first, ["roi"], "hemi", [F.col("o").asc_nulls_last(), F.col("channel")], height=True)
    return got.select("roi", "hemi", "channel", F.col("line").cast("long").alias("line"))


@query("select channel, phase, sample, round(value + 1e-9, 6) as value from (select *, row_number() over (partition by channel order by sample, phase) as k from signal where mask) where k = 1")
def keep_first_row(spark, d):
    return jn.keep_first(v.signal(spark, d).filter("mask").select("channel", "phase", "sample", tidy("value", "value")), ["channel"], ["sample", "phase"])


@query("select * from (select 'top' as side, source, target, round(sum(pdc) + 1e-9, 6) as w from edges group by all order by w desc, source, target limit 10) union all select * from (select 'bottom' as side, source, target, round(sum(pdc) + 1e-9, 6) as w from edges group by all order by w, source, target limit 10)")
def top_and_bottom(spark, d):
    """Ten largest and ten smallest; the feature is the limit."""
    w = v.edges(spark, d).groupBy("source", "target").agg(tidy(F.sum("pdc"), "w"))
    pick = lambda side, by: w.orderBy(by, "source", "target").limit(10).withColumn("side", F.lit(side))
    return pick("top", F.desc("w")).unionByName(pick("bottom", F.asc("w"))).select("side", "source", "target", "w")


@query("select phase, channel, sample, round(value + 1e-9, 6) as value from (select *, row_number() over (partition by phase order by value desc, channel, sample) as k from signal) where k = 1")
def argmax_row(spark, d):
    s = v.signal(spark, d)
    return op.peak(s.withColumn("order", F.struct("channel", "sample")).select("phase", "channel", "sample", "value"), ["phase"], "sample").select("phase", "channel", "sample", tidy("value", "value"))


@query("select subject, roi, channel, row_number() over (order by roi, subject desc, channel) as place from (select distinct subject, roi, channel from signal)")
def multi_key_order(spark, d):
    rows = v.signal(spark, d).select("subject", "roi", "channel").distinct()
    return sm.global_place(rows, [F.col("roi"), F.desc("subject"), F.col("channel")])


@query("select roi, round(m + 1e-9, 6) as score, rank() over (order by m desc) as place from (select roi, avg(m) as m from (select roi, channel, avg(value) as m from signal group by all) group by roi)")
def category_order(spark, d):
    """Categories by falling mean of means; there are as many rows as categories."""
    m = v.signal(spark, d).groupBy("roi", "channel").agg(F.avg("value").alias("m")).groupBy("roi").agg(F.avg("m").alias("m"))
    return m.select("roi", tidy("m", "score"), F.rank().over(Window.orderBy(F.desc("m"))).cast("long").alias("place"))


@query("select channel, phase, stop, count(*) as n, round(avg(value) + 1e-9, 6) as mean from signal, unnest(range(12, 84, 5)) t(stop) where sample >= stop - 12 and sample < stop group by all")
def window_grid(spark, d):
    """Windows of 12 samples that end every 5, on integers; those that would leave the range don't exist."""
    return op.window_grid(v.signal(spark, d), ["channel", "phase"], "sample", 12, 5, 0, 83).select("channel", "phase", F.col("stop").cast("long").alias("stop"), "n", tidy("mean", "mean"))


@query("select channel, phase, dense_rank() over (order by sample) as place, sample, round(time + 1e-9, 6) as time from signal where abs(time - round(time * 2) / 2) < 1e-6")
def axis_places(spark, d):
    """Places on the sorted axis of distinct samples; times within a tolerance of half a second's multiples."""
    s = v.signal(spark, d).filter(F.abs(F.col("time") - F.round(F.col("time") * 2) / 2) < 1e-6)
    axis = sm.global_place(s.select("sample").distinct(), [F.col("sample")])
    return s.join(axis, "sample").select("channel", "phase", "place", "sample", tidy("time", "time"))


@query("select id, round(m, 4) as dist from (select *, quantile_cont(m, 0.1) over () as q from (select a.id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) as m from points a join points b on a.class = 1 and b.class = 2 group by a.id)) where m <= q + 1e-9")
def boundary_points(spark, d):
    """Points of one set whose distance to the other is within the tenth percentile of these distances."""
    p = v.points(spark, d)
    near = op.nearest(p.filter("class = 1").select("id", "x", "y", "z"), p.filter("class = 2").select("id", "x", "y", "z"), 10.0)
    limit = sm.quantiles(near, [], "dist", {"q": 0.1})
    return near.join(F.broadcast(limit), F.lit(True)).filter("dist <= q + 1e-9").select("id", F.round("dist", 4).alias("dist"))


@query("select id, side from (select id, x, case when y > (min(y) over () + max(y) over ()) / 2 then 'upper' else 'lower' end as side, median(x) over (partition by class) as m from points) where round(abs(x - m), 6) <= 3")
def near_median_slice(spark, d):
    """Points within 3 of their group's median place, with their side of the middle."""
    p = v.points(spark, d)
    middle = p.agg(((F.min("y") + F.max("y")) / 2).alias("mid"))  # one row
    medians = sm.quantiles(p, ["class"], "x", {"m": 0.5})
    got = p.join(medians, "class").join(F.broadcast(middle), F.lit(True)).filter(F.round(F.abs(F.col("x") - F.col("m")), 6) <= 3)
    return got.select("id", F.when(F.col("y") > F.col("mid"), "upper").otherwise("lower").alias("side"))
