"""Queries on made tables against their SQL, where the given tables leave a case out."""

from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialgrid.operators.pairs import correlations
from trialgrid.plans import joins, queries, statistics
from trialgrid.plans.queries import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def wanted(name, folder, made):
    """The SQL's rows, over the tables `made` in `folder` and the smallest ones for the rest."""
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder if t in made else SF}/{t}.parquet{'/*.parquet' if t in made else ''}'")
    return c.sql(ORACLES[name]).df()


def same(got, want, keys):
    tidy = lambda df: df[list(want.columns)].sort_values(keys, ignore_index=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, rtol=1e-9, atol=0)


def test_windows_at_their_bounds(spark, tmp_path):
    times = ["2024-01-09 17:59:59.816118", "2024-01-09 17:59:59.500000", "2024-01-09 17:59:59.499999", "2024-01-09 18:00:00", "2024-01-09 23:59:59.999999", "1969-12-31 23:00:00", "1969-12-31 12:00:00", "1970-01-01 00:00:00", None, None]
    rows = [(i, t and datetime.fromisoformat(t), "view" if i % 2 else "click", float(i)) for i, t in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    same(statistics.stream_hopping_windows(spark, str(tmp_path)).toPandas(), wanted("stream_hopping_windows", tmp_path, ["events"]), ["event_type", "start"])


def made_series(spark, seed=5):
    """Two keys, 23 channels each, 40 samples with gaps: doubled rows, missing and odd values, constant and nearly constant channels; and the rows."""
    rng = np.random.RandomState(seed)
    rows = []
    for key in ("p", "q"):
        for c in range(23):
            for s in rng.permutation(40)[: (3, 12, 30, 40)[c % 4]]:
                for _ in range(1 + (rng.rand() < 0.1)):
                    v = 0.1 if c in (5, 6) else 1e6 + float(rng.rand() < 0.1) if c == 7 else float(rng.normal()) + 100 * (c == 8)
                    rows.append((key, f"c{c}", int(s), None if rng.rand() < 0.05 else float("nan") if c == 9 and rng.rand() < 0.1 else v))
    rows += [("p", "c30", 1, None), ("p", "c31", 1, 2.0), ("p", None, 1, 2.0), (None, "c1", 1, 2.0), ("p", "c32", None, 1.0)]
    return spark.createDataFrame(rows, "g string, c string, s int, v double").repartition(3), rows


def joined(rows, on):
    """The same by a plain join on another engine."""
    c = duckdb.connect()
    c.execute("create table t (g varchar, c varchar, s int, v double)")
    c.executemany("insert into t values (?, ?, ?, ?)", rows)
    return {x[:3]: x[3:] for x in c.execute(f"select a.g, a.c, b.c, corr(a.v, b.v), count(*) from t a join t b on a.g = b.g and a.s = b.s and {on} group by all").fetchall()}


def close(got, want):
    assert got.keys() == want.keys()
    for k, (r, n) in want.items():
        assert got[k][1] == n, k
        assert (got[k][0] is None) == (r is None), (k, got[k], r)
        assert r is None or np.isclose(got[k][0], r, rtol=1e-9, atol=1e-9, equal_nan=True), (k, got[k], r)


@pytest.mark.parametrize("block, part", [(1024, 256), (4, 256), (1024, 7), (5, 6)])
def test_blocks_of_groups(spark, block, part):
    df, rows = made_series(spark)
    digit = F.right("c", F.lit(1))
    right = F.when(digit.isin("0", "2", "4", "6", "8"), True).when(digit.isin("1", "3", "5", "7", "9"), False)
    got = correlations(df, ["g"], "c", "s", "v", right, block, part).collect()
    close({(x.g, x.a, x.b): (x.r, x.n) for x in got}, joined(rows, "right(a.c, 1) in ('1', '3', '5', '7', '9') and right(b.c, 1) in ('0', '2', '4', '6', '8')"))


@pytest.mark.parametrize("block, part", [(1024, 256), (4, 256), (1024, 7), (5, 6)])
def test_blocks_of_pairs(spark, block, part):
    df, rows = made_series(spark)
    got = correlations(df, ["g"], "c", "s", "v", None, block, part).collect()
    close({(x.g, x.a, x.b): (x.r, x.n) for x in got}, joined(rows, "a.c < b.c"))


def shuffled_bytes(spark, run):
    """Bytes that the stages of `run` write for shuffles."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        got = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {got.apply(i).stageId(): got.apply(i).shuffleWriteBytes() for i in range(got.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def many_channels(spark, folder):
    """The smallest tables with 300 suppliers of one nation and 60 months, so that pairs by sample are 300 times the rows."""
    spark.range(300).selectExpr("id as s_suppkey", "format_string('Supplier#%09d', id) as s_name", "3 as s_nationkey", "1.0D as s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    line = "id as l_orderkey", "id % 300 as l_suppkey", "1 as l_linenumber", "pmod(hash(id), 1000) * 1.0D as l_extendedprice", "0.0D as l_discount", "'A' as l_returnflag", "'F' as l_linestatus", "cast(add_months(date'1995-01-01', cast(id div 300 as int)) as timestamp_ntz) as l_shipdate"
    spark.range(300 * 60).selectExpr(*line).write.parquet(f"{folder}/lineitem.parquet")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return ["supplier", "lineitem", "nation", "region"]


@pytest.fixture
def spread(spark):
    """As on larger tables, the keys of a shuffle lie in many tasks and no side of a join is small."""
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, x in conf.items():
        spark.conf.set(k, x)
    yield
    for k, x in before.items():
        spark.conf.set(k, x)


def test_group_pairs_shuffle_series_not_pairs(spark, spread, tmp_path):
    made, got = many_channels(spark, tmp_path), []
    written = shuffled_bytes(spark, lambda: got.append(joins.label_group_pairs(spark, str(tmp_path)).toPandas()))
    same(got[0], wanted("label_group_pairs", tmp_path, made), ["subject", "a", "b"])
    assert len(got[0]) == 150 * 150 and written < 3_000_000, written


def test_pearson_pairs_shuffle_series_not_pairs(spark, spread, tmp_path):
    made, got = many_channels(spark, tmp_path), []
    written = shuffled_bytes(spark, lambda: got.append(queries.pearson_pairs(spark, str(tmp_path)).toPandas()))
    same(got[0], wanted("pearson_pairs", tmp_path, made), ["subject", "phase", "a", "b"])
    assert len(got[0]) == 300 * 299 // 2 and written < 3_000_000, written
