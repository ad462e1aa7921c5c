"""Time-series views over the star tables, as DataFrames and (for the second engine) as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK_ORIGIN, YEAR_ORIGIN = 41, 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial sample. The dimensions are left to Spark's own size check."""
    sensors = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "lineitem").join(sensors, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_name").alias("channel"), F.col("n_name").alias("subject"), F.col("r_name").alias("roi"),
        F.when(F.col("s_nationkey") % 2 == 0, "L").otherwise("R").alias("hemi"),
        F.col("l_returnflag").alias("description"), F.col("l_linestatus").alias("phase"), F.col("l_linenumber").alias("trial"),
        ((F.year("l_shipdate") - YEAR_ORIGIN) * 12 + F.month("l_shipdate") - 1).cast("int").alias("sample"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10000).alias("value"),
    )


def evoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial averages by channel, phase and sample."""
    return signal_rows(spark, sf_dir).groupBy("channel", "subject", "roi", "hemi", "phase", "sample").agg(F.avg("value").alias("value"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial averages with their time and a significance mask at half a deviation over the channel's mean."""
    cells = evoked(spark, sf_dir)
    level = cells.groupBy("channel", "phase").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    over = F.round(F.col("value") - F.col("mu") - F.col("sd") / 2, 9) > 0
    return cells.join(level, ["channel", "phase"]).select("channel", "subject", "roi", "hemi", "phase", "sample", ((F.col("sample") - TICK_ORIGIN) / F.lit(12.0)).alias("time"), "value", F.coalesce(over, F.lit(False)).alias("mask"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links between nations by market segment, phase and quarter, without self links."""
    nation = table(spark, sf_dir, "nation")
    source, target = nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("source")), nation.select(F.col("n_nationkey").alias("tk"), F.col("n_name").alias("target"))
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(source, F.col("s_nationkey") == F.col("sk"))
        .join(target, F.col("c_nationkey") == F.col("tk"))
        .filter("source <> target")
    )
    win = ((F.year("l_shipdate") - YEAR_ORIGIN) * 4 + F.quarter("l_shipdate") - 1).cast("int").alias("win")
    return rows.groupBy("source", "target", F.col("c_mktsegment").alias("subject"), F.col("l_linestatus").alias("phase"), win).agg((F.avg("l_quantity") / 50).alias("pdc"), F.avg("l_discount").alias("pval"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value > 150").select(F.col("user_id").alias("subject"), F.col("event_type").alias("dataset")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: (F.col("embedding")[i].cast("double") * 100)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.col("label").alias("class"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electrode contacts as labels come in practice: padded subject codes, paired names, sides in brackets, places partly in metres."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    side, scale = F.when(F.col("s_nationkey") % 2 == 0, "L").otherwise("R"), F.when(k % 4 == 0, 0.001).otherwise(1.0)
    place = lambda step, width: ((k * step % width - width // 2).cast("double") * scale)
    return rows.select(
        k.alias("id"), F.col("s_name").alias("channel"), F.concat(F.lit("D"), F.lpad(F.col("s_nationkey").cast("string"), 4, "0")).alias("code"),
        F.when(k % 10 == 0, "REF").otherwise(F.concat(F.upper(F.substring("r_name", 1, 2)), k % 9 + 1, F.lit("-"), k % 9 + 2)).alias("pair"),
        F.when(k % 6 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" ("), side, F.lit(")"))).alias("tag"),
        F.when(k % 11 != 0, F.concat(F.lit("ctx_"), F.lower("r_name"), F.lit("_"), "n_name")).alias("label"),
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), place(37, 200).alias("x"), place(53, 160).alias("y"), place(71, 120).alias("z"), F.col("s_acctbal").alias("power"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trial and feature."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), "label", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("trial", "label", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


SQL = """
signal_rows as (select s_name as channel, n_name as subject, r_name as roi, case when s_nationkey % 2 = 0 then 'L' else 'R' end as hemi,
  l_returnflag as description, l_linestatus as phase, l_linenumber as trial,
  cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as int) as sample, l_extendedprice * (1 - l_discount) / 10000 as value
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
evoked as (select channel, subject, roi, hemi, phase, sample, avg(value) as value from signal_rows group by all),
level as (select channel, phase, avg(value) as mu, stddev_samp(value) as sd from evoked group by all),
signal as (select e.channel, e.subject, e.roi, e.hemi, e.phase, e.sample, (e.sample - 41) / 12.0::double as time, e.value,
  coalesce(round(e.value - mu - sd / 2, 9) > 0, false) as mask from evoked e join level l on e.channel = l.channel and e.phase = l.phase),
edges as (select sn.n_name as source, cn.n_name as target, c_mktsegment as subject, l_linestatus as phase,
  cast((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) - 1 as int) as win, avg(l_quantity) / 50 as pdc, avg(l_discount) as pval
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation sn on s_nationkey = sn.n_nationkey join nation cn on c_nationkey = cn.n_nationkey where sn.n_name <> cn.n_name group by all),
membership as (select distinct user_id as subject, event_type as dataset from events where value > 150),
contacts as (select s_suppkey as id, s_name as channel, 'D' || lpad(s_nationkey::varchar, 4, '0') as code,
  case when s_suppkey % 10 = 0 then 'REF' else upper(substr(r_name, 1, 2)) || (s_suppkey % 9 + 1) || '-' || (s_suppkey % 9 + 2) end as pair,
  case when s_suppkey % 6 = 0 then n_name else n_name || ' (' || (case when s_nationkey % 2 = 0 then 'L' else 'R' end) || ')' end as tag,
  case when s_suppkey % 11 <> 0 then 'ctx_' || lower(r_name) || '_' || n_name end as label, r_name as region, n_name as nation,
  (s_suppkey * 37 % 200 - 100)::double * scale as x, (s_suppkey * 53 % 160 - 80)::double * scale as y, (s_suppkey * 71 % 120 - 60)::double * scale as z, s_acctbal as power
  from (select *, case when s_suppkey % 4 = 0 then 0.001::double else 1.0::double end as scale from supplier) join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
points as (select vec_id as id, embedding[1]::double * 100 as x, embedding[2]::double * 100 as y, embedding[3]::double * 100 as z, label as class from embeddings)
"""
