"""Named queries of joins and set operations, with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialgrid.operators import joins as jn
from trialgrid.operators.pairs import correlations
from trialgrid.plans.queries import query, tidy
from trialgrid.sources import views as v


@query("select s.channel, s.phase, s.sample, coalesce(m.mask, false) as mask from signal s left join (select channel, sample, true as mask from signal where phase = 'F' and mask) m on s.channel = m.channel and s.sample = m.sample where s.phase = 'O'")
def mask_join(spark, d):
    """A mask over (channel, sample) of another table; what it doesn't have is false. The key is the integer sample, not the float time."""
    s = v.signal(spark, d)
    mask = s.filter("phase = 'F' and mask").select("channel", "sample", "mask")
    return jn.with_default(s.filter("phase = 'O'").select("channel", "phase", "sample"), mask, ["channel", "sample"], "mask", False)


@query("select channel, phase, sample, label, round(x + 1e-9, 6) as x from signal left join (select channel, label, x from contacts where id % 3 <> 0) using (channel)")
def dimension_left(spark, d):
    dim = v.contacts(spark, d).filter("id % 3 <> 0").select("channel", "label", tidy("x", "x"))
    return v.signal(spark, d).select("channel", "phase", "sample").join(dim, "channel", "left")


@query("select channel, phase, sample from signal where channel in (select channel from contacts where region = 'ASIA')")
def semi_filter(spark, d):
    return v.signal(spark, d).select("channel", "phase", "sample").join(v.contacts(spark, d).filter("region = 'ASIA'").select("channel"), "channel", "left_semi")


@query("select channel, channel in (select channel from signal where mask and time > 2) as significant from contacts")
def membership_flag(spark, d):
    return jn.with_flag(v.contacts(spark, d).select("channel"), v.signal(spark, d).filter("mask and time > 2"), ["channel"], "significant")


@query("select id, channel, coalesce(significant, false) as significant, coalesce(n, 0) as n from contacts left join (select channel, bool_or(mask) as significant, count(*) as n from signal where roi <> 'AFRICA' group by channel) using (channel)")
def companion_fallback(spark, d):
    """A companion table that some channels lack: not significant, none counted."""
    other = v.signal(spark, d).filter("roi <> 'AFRICA'").groupBy("channel").agg(F.bool_or("mask").alias("significant"), F.count("*").alias("n"))
    got = v.contacts(spark, d).select("id", "channel").join(other, "channel", "left")
    return got.select("id", "channel", F.coalesce("significant", F.lit(False)).alias("significant"), F.coalesce("n", F.lit(0)).alias("n"))


@query("select id, channel, coalesce(a.n, b.n, 0) as n, coalesce(a.top, b.top, -1.0) as top, case when a.channel is not null then 'masked' when b.channel is not null then 'all' end as companion from contacts left join (select channel, count(*) as n, round(max(value) + 1e-9, 6) as top from signal where mask and roi <> 'ASIA' group by channel) a using (channel) left join (select channel, count(*) as n, round(max(value) + 1e-9, 6) as top from signal where subject <> 'NATION_8' group by channel) b using (channel)")
def companion_alternate(spark, d):
    """What a channel's companion table says, that of the alternate where it lacks the channel, the defaults where both do."""
    s = v.signal(spark, d)
    of = lambda rows: rows.groupBy("channel").agg(F.count("*").alias("n"), tidy(F.max("value"), "top"))
    tables = [("masked", of(s.filter("mask and roi <> 'ASIA'"))), ("all", of(s.filter("subject <> 'NATION_8'")))]
    return jn.with_alternates(v.contacts(spark, d).select("id", "channel"), tables, ["channel"], {"n": 0, "top": -1.0})


@query("select e.source, e.target, e.n, coalesce(a.r, 'Unknown') as source_r, coalesce(b.r, 'Unknown') as target_r from (select source, target, count(*) as n from edges group by all) e left join (select n_name, n_regionkey::varchar as r from nation where n_nationkey % 4 <> 0) a on source = a.n_name left join (select n_name, n_regionkey::varchar as r from nation where n_nationkey % 4 <> 0) b on target = b.n_name")
def contact_lookup(spark, d):
    lookup = v.table(spark, d, "nation").filter("n_nationkey % 4 <> 0").select("n_name", F.col("n_regionkey").cast("string").alias("r"))
    return jn.double_lookup(v.edges(spark, d).groupBy("source", "target").agg(F.count("*").alias("n")), lookup, "n_name", "r", ("source", "target"), "Unknown")


@query("select a.subject, a.channel as a, b.channel as b, round(corr(a.value, b.value) + 1e-9, 6) as r from signal a join signal b on a.subject = b.subject and a.phase = b.phase and a.sample = b.sample where a.phase = 'F' and right(a.channel, 1) in ('1', '3', '5', '7', '9') and right(b.channel, 1) in ('0', '2', '4', '6', '8') group by all")
def label_group_pairs(spark, d):
    """Pairs of a channel of one label group with one of the other in the same subject; they meet by sample, so pairs without one in common don't exist."""
    digit = F.right("channel", F.lit(1))
    even = F.when(digit.isin("0", "2", "4", "6", "8"), True).when(digit.isin("1", "3", "5", "7", "9"), False)  # other labels are in neither group
    return correlations(v.evoked(spark, d).filter("phase = 'F'"), ["subject"], "channel", "sample", right=even).select("subject", "a", "b", tidy("r", "r"))


@query("select channel, phase, sample, round(p + 1e-9, 6) as p, round(base + 1e-9, 6) as base from (select channel, phase, sample from signal) join (select sample, 1 / (1 + avg(value)) as p from signal group by sample) using (sample) join (select phase, sample, min(value) as base from signal group by all) using (phase, sample)")
def broadcast_missing_key(spark, d):
    """A value that hangs on the sample alone and one by (phase, sample) join the rows of all channels."""
    s = v.signal(spark, d)
    p = s.groupBy("sample").agg(tidy(1 / (1 + F.avg("value")), "p"))
    base = s.groupBy("phase", "sample").agg(tidy(F.min("value"), "base"))
    return s.select("channel", "phase", "sample").join(p, "sample").join(base, ["phase", "sample"])


@query("select channel, sample, round(max(case when phase = 'F' then value end) + 1e-9, 6) as F, round(max(case when phase = 'O' then value end) + 1e-9, 6) as O from signal group by all having count(*) = 2")
def aligned_complete(spark, d):
    got = jn.complete_pairs(v.signal(spark, d), ["channel", "sample"], "phase", "F", "O", "value")
    return got.select("channel", "sample", tidy("F", "F"), tidy("O", "O"))


_DIST = "sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2 + (q.z - c.z) ** 2)"


@query(f"select id, class, round(case when m < 8 then m end, 4) as dist, coalesce(m < 8, false) as near from (select q.id, q.class, min({_DIST}) as m from points q left join points c on c.class = q.class and c.id % 50 <> 0 where q.id % 50 = 0 group by all)")
def near_own_class(spark, d):
    p = v.points(spark, d)
    return jn.near_class(p.filter("id % 50 = 0"), p.filter("id % 50 <> 0"), 8.0).withColumn("dist", F.round("dist", 4))


@query(f"select id, vid, expected from (select q.id, c.id as vid, q.class = c.class as expected, row_number() over (partition by q.id order by {_DIST}, c.id) as k from points q join points c on q.id % 50 = 0 and c.id % 50 <> 0) where k = 1")
def nearest_expected_class(spark, d):
    p = v.points(spark, d)
    return jn.nearest_of_class(p.filter("id % 50 = 0"), p.filter("id % 50 <> 0"), 10.0).drop("dist")


@query("select count(a) as n_a, count(b) as n_b, count(*) filter (a is distinct from b) as n_differ, min(case when a is distinct from b then coalesce(i, j) end) as first from (select event_id as i, event_type as a from events) full join (select event_id as j, case when event_id % 1000 = 777 then 'x' else event_type end as b from events where event_id < 990) on i = j")
def ordinal_alignment(spark, d):
    e = v.table(spark, d, "events").select("event_id", "event_type")
    other = e.filter("event_id < 990").withColumn("event_type", F.when(F.col("event_id") % 1000 == 777, "x").otherwise(F.col("event_type")))
    return jn.alignment(e, other, "event_id", "event_type")


_WANTED = "(values ('NATION_1'), ('ION_2'), ('_23'), ('nothing'))"


@query(f"select w, n_name from {_WANTED} t(w) join nation on w = n_name or (contains(n_name, w) and w not in (select n_name from nation))")
def exact_else_part(spark, d):
    wanted = spark.createDataFrame([("NATION_1",), ("ION_2",), ("_23",), ("nothing",)], "w string")
    return jn.exact_else_part(wanted, v.table(spark, d, "nation").select("n_name"), "w", "n_name")


@query("select id, coalesce(k, 'Unknown') as k from contacts left join (select user_id, arg_max(event_type, event_id) as k from events group by user_id) on user_id = id * 3")
def last_wins_map(spark, d):
    last = jn.last_wins(v.table(spark, d, "events"), "user_id", "event_type", "event_id").select(F.col("user_id").alias("key"), F.col("event_type").alias("k"))
    return jn.with_default(v.contacts(spark, d).select("id", (F.col("id") * 3).alias("key")), last, ["key"], "k", "Unknown").select("id", "k")


@query("select user_id, max(ts) as ts, case when user_id in (select subject from membership) then 'found' else 'missing' end as status from events group by user_id")
def existence_status(spark, d):
    users = v.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    got = jn.with_flag(users, v.membership(spark, d).select(F.col("subject").alias("user_id")), ["user_id"], "found")
    return got.select("user_id", "ts", F.when(F.col("found"), "found").otherwise("missing").alias("status"))


@query("select subject, arg_min(dataset, case dataset when 'purchase' then 0 when 'view' then 1 else 2 end) as source, count(*) as sources from membership where dataset in ('purchase', 'view', 'click') group by subject")
def first_source_wins(spark, d):
    m = v.membership(spark, d)
    return jn.first_source([(k, m.filter(F.col("dataset") == k)) for k in ("purchase", "view", "click")], ["subject"])


@query("select case when c then 'only click' else 'only view' end as side, subject from (select subject, bool_or(dataset = 'click') as c, bool_or(dataset = 'view') as w from membership group by subject) where c <> w")
def difference_both_ways(spark, d):
    m = v.membership(spark, d)
    a, b = (m.filter(F.col("dataset") == k).select("subject") for k in ("click", "view"))
    return a.subtract(b).withColumn("side", F.lit("only click")).unionByName(b.subtract(a).withColumn("side", F.lit("only view")))


@query("select channel, phase, sample, 1 as part from signal where hemi = 'L' union all select channel, phase, sample, 2 from signal where hemi = 'R'")
def union_hemispheres(spark, d):
    s = v.signal(spark, d)
    part = lambda h, n: s.filter(F.col("hemi") == h).select("channel", "phase", "sample", F.lit(n).alias("part"))
    return part("L", 1).unionByName(part("R", 2))


@query("select count(*) as n from (select distinct user_id from events except select subject from membership where dataset in ('click', 'view'))")
def complement_count(spark, d):
    either = v.membership(spark, d).filter(F.col("dataset").isin("click", "view")).select(F.col("subject").alias("user_id"))
    return v.table(spark, d, "events").select("user_id").distinct().join(either, "user_id", "left_anti").agg(F.count("*").alias("n"))


_CAR = ", car as (select id, coalesce(label, 'Unknown') as label, power from contacts), quality as (select c.id, c.pair, c.channel, coalesce(a.label, 'Unknown') as la, coalesce(b.label, 'Unknown') as lb, m from contacts c left join car a on a.id = c.id left join car b on b.id = c.id + 1 left join (select q.id, min(sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2 + (q.z - t.z) ** 2)) as m from contacts q join contacts t on t.region = 'ASIA' and t.id % 4 <> 0 where q.id % 4 <> 0 group by q.id) d on d.id = c.id)"


@query(f"{_CAR} select id, channel, case when not (contains(la, 'africa') or contains(lb, 'africa')) then 'IGNORE' when m <= 30 then 'EXCLUDE' else 'KEEP' end as status, case when not (contains(la, 'africa') or contains(lb, 'africa')) then 'no contact of the kind' when m <= 30 then printf('dist=%.2f', round(m, 3)) else 'ok' end as reason from quality")
def quality_rules(spark, d):
    """Contacts in pairs: ignored without a label of the kind at either end, excluded near the other kind, else kept; the first rule wins."""
    from trialgrid.functions import labels as lb

    c = v.contacts(spark, d)
    label = c.select(F.col("id").alias("key"), "label")
    pairs = c.select("id", "channel", "x", "y", "z", F.col("id").alias("first"), (F.col("id") + 1).alias("second"))
    both = jn.double_lookup(pairs, label, "key", "label", ("first", "second"), "Unknown")
    in_mm = F.col("id") % 4 != 0
    target = c.filter(F.col("region") == "ASIA").filter(in_mm).withColumn("class", F.lit(1))
    dist = jn.near_class(c.filter(in_mm).withColumn("class", F.lit(1)), target, 30.0, strict=False).select("id", "dist")
    kind = lb.has_keyword(F.col("first_label"), ["africa"]) | lb.has_keyword(F.col("second_label"), ["africa"])
    near = F.col("dist").isNotNull()
    status = lb.first_rule([(~kind, "IGNORE"), (near, "EXCLUDE")], "KEEP")
    reason = lb.first_rule([(~kind, "no contact of the kind"), (near, F.format_string("dist=%.2f", F.round("dist", 3)))], "ok")
    return both.join(dist, "id", "left").select("id", "channel", status.alias("status"), reason.alias("reason"))


@query("select 'KEEP' as status, count(*) filter (power > 2000) as n from contacts union all select 'EXCLUDE', count(*) filter (power <= 2000) from contacts")
def status_counts(spark, d):
    got = v.contacts(spark, d).agg(F.count_if(F.col("power") > 2000).alias("KEEP"), F.count_if(F.col("power") <= 2000).alias("EXCLUDE"))
    return got.unpivot([], ["KEEP", "EXCLUDE"], "status", "n")


@query("select source, target, round(total + 1e-9, 6) as total, round(top + 1e-9, 6) as top, n, kind from (select source, target, sum(pdc) as total, max(pdc) as top, count(*) as n, arg_min(subject, win * 1000000 + ascii(subject) * 1000 + ascii(phase)) as kind from edges group by all) where source <> 'NATION_3' and target <> 'NATION_3'")
def edge_rollup_first(spark, d):
    """Sum, largest, number and the earliest row's subject of each edge, without edges of an excluded node."""
    first = F.col("win") * 1000000 + F.ascii("subject") * 1000 + F.ascii("phase")
    got = v.edges(spark, d).filter("source <> 'NATION_3' and target <> 'NATION_3'").groupBy("source", "target").agg(F.sum("pdc").alias("total"), F.max("pdc").alias("top"), F.count("*").alias("n"), F.min_by("subject", first).alias("kind"))
    return got.select("source", "target", tidy("total", "total"), tidy("top", "top"), "n", "kind")


@query("select source, target, subject, phase, win from edges where source in ('NATION_1', 'NATION_2') or target in ('NATION_1', 'NATION_2')")
def edges_touching(spark, d):
    """Edges with an end of the label class."""
    kind = ["NATION_1", "NATION_2"]
    return v.edges(spark, d).filter(F.col("source").isin(kind) | F.col("target").isin(kind)).select("source", "target", "subject", "phase", "win")


