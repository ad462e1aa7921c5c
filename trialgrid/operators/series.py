"""Operators on tidy series tables. All take and return DataFrames; keys and columns are parameters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.pairs import correlations
from trialgrid.operators.summaries import least_from_here, ranked
from trialgrid.sources.work import written


def not_in_keeping_null(col: str, values: list) -> Column:
    """Negated membership that keeps missing values."""
    return F.col(col).isNull() | ~F.col(col).isin(values)


def recode(df: DataFrame, col: str, mapping: dict[str, str]) -> DataFrame:
    """Replace values by a map; others stay."""
    pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(col, F.coalesce(pairs[F.col(col)], F.col(col)))


def zscore(df: DataFrame, keys: list[str], value: str = "value", out: str = "z") -> DataFrame:
    """Standardise a series by its population deviation (plus 1e-8)."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8))


def peak(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Row of the largest value of each key, the first in `order` on ties. Null and NaN are no values: a key with nothing else has no row."""
    rest = [c for c in df.columns if c not in keys]
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(value, -F.col(order))).alias("r")).select(*keys, "r.*")


def earliest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Row with the smallest `order` of each key; on ties the one whose other columns come first. Rows without an order come last."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(order).isNull(), order, *(c for c in rest if c != order))).alias("r")).select(*keys, "r.*")


def runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Maximal runs of a true flag along `order`: keys, start, stop, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    marked = df.withColumn("change", changed).withColumn("run", F.sum("change").over(w))
    return marked.filter(flag).groupBy(*keys, "run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count("*").alias("n")).drop("run")


def moving_mean(df: DataFrame, keys: list[str], order: str, size: int, step: int, value: str = "value") -> DataFrame:
    """Means over windows [k * step, k * step + size) of an integer order column, for every k, also below 0, whose window holds a row; each row is posted to the windows that hold it."""
    k = F.explode(F.sequence(F.floor((F.col(order) - size) / step) + 1, F.floor(F.col(order) / step)))
    return df.select(*keys, value, k.alias("win")).groupBy(*keys, "win").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def window_grid(df: DataFrame, keys: list[str], order: str, size: int, step: int, low: int, high: int, value: str = "value") -> DataFrame:
    """keys, stop, n, mean of windows [stop - size, stop) that end at low + size and every `step` after, as long as they lie within [low, high]."""
    last = low + size + (high + 1 - low - size) // step * step
    first = F.greatest(F.lit(low + size), F.ceil((F.col(order) + 1 - low - size) / step) * step + low + size)
    stop = F.explode(F.when(first <= F.least(F.lit(last), F.col(order) + size), F.sequence(first, F.least(F.lit(last), F.col(order) + size).cast("long"), F.lit(step).cast("long")))).alias("stop")
    return df.select(*keys, value, stop).groupBy(*keys, "stop").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def pearson_pairs(df: DataFrame, within: list[str], channel: str, order: str, value: str = "value") -> DataFrame:
    """Correlation of every ordered pair of channels that share the keys `within`, on samples both have."""
    return correlations(df, within, channel, order, value)


def lagged_correlation(left: DataFrame, right: DataFrame, keys: list[str], order: str, x: str, y: str, lags: range) -> DataFrame:
    """Correlation of x with y `lag` samples later and the number of pairs: one row a key and lag."""
    lag = F.explode(F.array(*(F.lit(i) for i in lags))).alias("lag")
    moved = left.select(*keys, order, x, lag).withColumn("at", F.col(order) + F.col("lag"))
    return moved.join(right.select(*keys, F.col(order).alias("at"), y), [*keys, "at"]).groupBy(*keys, "lag").agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def correlogram(df: DataFrame, keys: list[str], order: str, x: str, y: str, at_least: int = 10, block: int = 1 << 14) -> DataFrame:
    """keys, lag, r: sum of x[n + lag] * y[n] / N of both series standardised over the samples that both have, for all lags with some pair; keys with fewer than `at_least` samples are left out.

    A series is cut into blocks of `block` places; Fourier transforms give all lags of a pair of blocks at once, and the lags of all pairs of a
    key are added up. A key of up to `block` places is one pair; for longer ones no task holds more than a pair.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    level = rows.groupBy(*keys).agg(F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"), F.count("*").alias("n"), F.min(order).alias("lo")).filter(F.col("n") >= at_least)
    at = (F.col(order) - F.col("lo")).cast("long")
    z = rows.join(level, keys) if keys else rows.join(F.broadcast(level), F.lit(True))  # one row
    z = z.select(*keys, "n", F.floor(at / block).alias("b"), F.struct((at % block).cast("int").alias("at"), ((F.col(x) - F.col("mx")) / (F.col("sx") + 1e-8)).alias("x"), ((F.col(y) - F.col("my")) / (F.col("sy") + 1e-8)).alias("y")).alias("e"))
    blocks = written(z.groupBy(*keys, "n", "b").agg(F.collect_list("e").alias("e")), "blocks")  # at most `block` entries
    left = blocks.select(*keys, "n", F.col("b").alias("bx"), F.col("e.at").alias("ix"), F.col("e.x").alias("x"))
    right = blocks.select(*keys, F.col("b").alias("by"), F.col("e.at").alias("iy"), F.col("e.y").alias("y"))
    pairs = left.join(right, keys) if keys else left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one").drop("__one")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "lag bigint, s double"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                width = int(max(row["ix"].max(), row["iy"].max())) + 1
                size = 1 << (2 * width - 1).bit_length()

                def spectrum(place, value, size=size):
                    both = np.zeros((2, size))  # the series and where it has values
                    both[0, place], both[1, place] = value, 1
                    return np.fft.rfft(both)

                s, n = np.fft.irfft(spectrum(row["ix"], row["x"]) * np.conj(spectrum(row["iy"], row["y"])), size)
                lag = np.r_[np.arange(width), np.arange(-width + 1, 0)]
                met = n[lag] > 0.5
                yield pd.DataFrame({**{k: row[k] for k in keys}, "lag": lag[met] + (row["bx"] - row["by"]) * block, "s": s[lag][met] / row["n"]})

    return pairs.mapInPandas(partial, schema).groupBy(*keys, "lag").agg(F.sum("s").alias("r"))


def edge_cells(edges: DataFrame, keys: list[str], alpha: float, least_ratio: float) -> DataFrame:
    """keys, pdc, pdc_sig, sig_ratio over edges (pdc, pval), of cells whose significant ratio is over `least_ratio`."""
    sig = F.round("pval", 9) < alpha
    got = edges.groupBy(*keys).agg(F.avg("pdc").alias("pdc"), F.avg(F.when(sig, F.col("pdc"))).alias("pdc_sig"), F.avg(sig.cast("int")).alias("sig_ratio"))
    return got.filter(F.round("sig_ratio", 9) > least_ratio)


def top_names(df: DataFrame, key: str, falling: list[str], rising: list[str], name: Column, n: int, out: str) -> DataFrame:
    """key, out: the names of the first n rows of each key, comma-joined."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in falling), *rising)
    top = df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).select(key, F.struct("__k", name.alias("name")).alias("e"))
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["name"]), ",").alias(out))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: list[str], out: str = "q") -> DataFrame:
    """`df` with the false-discovery-rate adjusted p within keys: the least p * m / rank of its own and all later ranks, at most 1.

    A family may be of any size: ranks are dealt by range of p, and the minimum is carried backward over one row a partition. Nulls and NaN
    are not tests: they take no rank, don't count in m and get null. `tie` makes the order total.
    """
    test = F.col(p).isNotNull() & ~F.isnan(p)
    tests = df.filter(test)
    placed = ranked(tests, keys, [F.col(p), *(F.col(t) for t in tie)], "__rank", parts=True)
    family = tests.groupBy(*keys).agg(F.count("*").alias("__m"))
    if keys:
        family = family.withColumnsRenamed({k: f"__k{k}" for k in keys})
        sized = placed.join(family, [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys]).drop(*(f"__k{k}" for k in keys))
    else:
        sized = placed.join(F.broadcast(family), F.lit(True))  # one row
    got = least_from_here(sized.withColumn("__v", F.col(p) * F.col("__m") / F.col("__rank")), keys, "__rank", "__v", out)
    return got.withColumn(out, F.least(F.lit(1.0), out)).select(*df.columns, out).unionByName(df.filter(~test).withColumn(out, F.lit(None).cast("double")))


def venn_regions(membership: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """Number of keys in each region of the named sets."""
    flags = membership.groupBy(key).agg(*(F.max(F.col(group) == g).alias(g) for g in groups))
    return flags.groupBy(*groups).agg(F.count("*").alias("n"))


def node_strength(edges: DataFrame, weight: str) -> DataFrame:
    """Sum of weights in and out of each node; a self edge counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), weight)
    return ends.groupBy("node").agg(F.sum(weight).alias("strength"), F.count("*").alias("n"))


def nearest(queries: DataFrame, cloud: DataFrame, cell: float) -> DataFrame:
    """For each query (id, x, y, z) the nearest cloud point at any distance, the smallest id on ties: points meet in grid cells, no cross join.

    Points without a hit within the cell size meet again in cells of four times the size, until none is left. Queries and points
    have unique ids and finite places; nulls and other places find and are nothing, and an empty cloud has no nearest point.
    """
    whole = lambda df: df.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')" for c in "xyz"))
    left, cloud, done = whole(queries), whole(cloud), None
    if cloud.isEmpty():
        return _within(left, cloud, cell)
    while True:
        found = written(_within(left, cloud, cell), "nearest")
        done = found if done is None else done.unionByName(found)
        left = written(left.join(found, "id", "left_anti"), "nearest")
        if left.isEmpty():
            return done
        cell *= 4


def _within(queries: DataFrame, cloud: DataFrame, cell: float) -> DataFrame:
    """The nearest cloud point of each query that has one within `cell`: all these lie in the cells next to its own."""
    grid = lambda c: F.floor(F.col(c) / cell)
    home = cloud.select(F.col("id").alias("vid"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), grid("x").alias("gx"), grid("y").alias("gy"), grid("z").alias("gz"))
    around = queries
    for c in "xyz":
        around = around.select("*", F.explode(F.array(*(F.lit(d) + grid(c) for d in (-1, 0, 1)))).alias(f"g{c}"))
    dist = F.sqrt((F.col("x") - F.col("vx")) ** 2 + (F.col("y") - F.col("vy")) ** 2 + (F.col("z") - F.col("vz")) ** 2)
    met = around.join(home, ["gx", "gy", "gz"]).withColumn("dist", dist).filter(F.col("dist") <= cell)
    return met.groupBy("id").agg(F.min(F.struct("dist", "vid")).alias("r")).select("id", "r.vid", "r.dist")
