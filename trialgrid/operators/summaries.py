"""Summaries: places in a total order, exact quantiles, bootstrap intervals, membership matrices, density grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.functions.labels import uniform
from trialgrid.sources.work import written


def by_range(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Stored `df` dealt by range of (keys, order), with `__part`, its partition: a key's parts follow each other in the order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *(F.col(k) for k in keys), *order).withColumn("__part", F.spark_partition_id()), "ranked")


def meet_parts(rows: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` with the columns that `parts` has for their (keys, __part), one row each; null keys meet."""
    names = {k: f"__{k}" for k in [*keys, "__part"]}
    meet = F.col("__part") == F.col("____part")
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(parts.withColumnsRenamed(names), meet).drop(*names.values())


def ranked(df: DataFrame, keys: list[str], order: list[Column | str], out: str = "place", parts: bool = False) -> DataFrame:
    """`df` with its place (from 1) within keys in the total order `order`, and no key in one task; with `parts` also `__part` of `by_range`.

    Rows are dealt by range of (keys, order) and numbered within each partition; the counts of a key in the partitions before it, one row
    a key and partition, are added. `order` has to be total for repeatable places.
    """
    part = by_range(df, keys, order)
    local = part.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    before = Window.partitionBy(*keys).orderBy("__part") if keys else Window.orderBy("__part")
    base = part.groupBy(*keys, "__part").agg(F.count("*").alias("__n")).select(*keys, "__part", (F.sum("__n").over(before) - F.col("__n")).alias("__base"))
    placed = meet_parts(local, base, keys).withColumn(out, F.col("__local") + F.col("__base"))
    return placed.select(*df.columns, out, *(["__part"] if parts else []))


def average_ranked(df: DataFrame, keys: list[str], value: str, tie: list[str], out: str = "rank") -> DataFrame:
    """`df` with its rank within keys by `value`; equal values share the mean of their places. No key and no value has to lie in one task.

    `tie` makes the order total. Places of equal values are read off within each partition; only a partition's first and last value of a
    key can go on in its neighbours, and their outermost places come from one row a key and partition. Nulls rank first, as one value.
    """
    placed = ranked(df, keys, [F.col(value).asc_nulls_first(), *(F.col(t) for t in tie)], "__place", parts=True)
    same = Window.partitionBy("__part", *keys, value)
    whole = Window.partitionBy("__part", *keys)
    marked = placed.withColumns({"__from": F.min("__place").over(same), "__to": F.max("__place").over(same), "__head": F.min("__place").over(whole), "__tail": F.max("__place").over(whole)})
    ends = placed.groupBy(*keys, "__part").agg(F.min_by(F.struct(value), "__place").alias("low"), F.max_by(F.struct(value), "__place").alias("high"), F.min("__place").alias("head"), F.max("__place").alias("tail"))
    inner = marked.select(*keys, "__part", F.struct(value).alias("v"), "__from", "__to").groupBy(*keys, "__part").agg(F.min("__to").alias("low_to"), F.max("__from").alias("high_from"))
    ends = written(ends.join(inner, [*(ends[k].eqNullSafe(inner[k]) for k in keys), ends["__part"] == inner["__part"]]).select(*(ends[k] for k in keys), ends["__part"], "low", "high", "head", "tail", "low_to", "high_from"), "rank-ends")  # a row a key and partition
    # the places of a key's border values over all partitions
    border = ends.select(*keys, F.explode(F.array(F.struct(F.col("low").alias("v"), F.col("head").alias("a"), F.col("low_to").alias("b")), F.struct(F.col("high").alias("v"), F.col("high_from").alias("a"), F.col("tail").alias("b")))).alias("e"))
    border = border.select(*keys, "e.v", "e.a", "e.b").groupBy(*keys, "v").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    of = lambda side, x: border.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("v").alias("__v"), F.col("a").alias(f"__{x}a"), F.col("b").alias(f"__{x}b"))
    for side, x in (("low", "l"), ("high", "h")):
        meet = [*(F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)), F.col(side).eqNullSafe(F.col("__v"))]
        ends = ends.join(of(side, x), meet).drop("__v", *(f"__k{i}" for i in range(len(keys))))
    full = meet_parts(marked, ends.select(*keys, "__part", "__la", "__lb", "__ha", "__hb"), keys)
    first, last = F.col("__from") == F.col("__head"), F.col("__to") == F.col("__tail")
    mean = F.when(first, F.col("__la") + F.col("__lb")).when(last, F.col("__ha") + F.col("__hb")).otherwise(F.col("__from") + F.col("__to")) / 2
    return full.withColumn(out, mean).select(*df.columns, out)


def least_from_here(df: DataFrame, keys: list[str], place: str, value: str, out: str) -> DataFrame:
    """`df` (with `__part` of `ranked`) with the least `value` of its own and all later places of its key: within the partition, then over the partitions after it."""
    here = Window.partitionBy("__part", *keys).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, 0)
    after = (Window.partitionBy(*keys) if keys else Window).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    later = df.groupBy(*keys, "__part").agg(F.min(value).alias("__least")).select(*keys, "__part", F.min("__least").over(after).alias("__later"))
    return meet_parts(df, later, keys).withColumn(out, F.least(F.min(value).over(here), F.col("__later"))).drop("__later")


def global_place(df: DataFrame, order: list[Column | str], out: str = "place") -> DataFrame:
    return ranked(df, [], order, out)


def quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles by linear interpolation between neighbours, nulls and NaN left out; one column a name in `at`. Null keys are a group.

    Values are ranked by range partition and the two neighbours of each quantile are picked, so no group is gathered.
    """
    rows = df.select(*keys, value).filter(F.col(value).isNotNull() & ~F.isnan(value))
    placed = ranked(rows, keys, [F.col(value)])
    total = rows.groupBy(*keys).agg(F.count("*").alias("__m"))
    if keys:
        own = total.withColumnsRenamed({k: f"__k{k}" for k in keys})
        both = placed.join(own, [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys]).drop(*(f"__k{k}" for k in keys))
    else:
        both = placed.join(F.broadcast(total), F.lit(True))  # one row
    out = []
    for name, q in at.items():
        here = (F.col("__m") - 1) * q + 1
        weight = F.when(F.col("place") == F.floor(here), 1 - (here - F.floor(here))).otherwise(F.when(F.col("place") == F.floor(here) + 1, here - F.floor(here)))
        out.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return both.groupBy(*keys).agg(*out)


def rescaled(df: DataFrame, key: str, which, value: str, factor: float) -> DataFrame:
    """`df` with the rows of one key scaled so that their total is `factor` times the mean total of the other keys."""
    totals = df.groupBy(key).agg(F.sum(value).alias("t"))
    scale = totals.agg((factor * F.avg(F.when(F.col(key) != which, F.col("t"))) / F.sum(F.when(F.col(key) == which, F.col("t")))).alias("__scale"))  # one row
    return df.join(F.broadcast(scale), F.lit(True)).withColumn(value, F.when(F.col(key) == which, F.col(value) * F.col("__scale")).otherwise(F.col(value))).drop("__scale")


#: Cumulative probabilities of 0 to 5 under Poisson(1); fixed values.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)


def bootstrap(df: DataFrame, group: str | list[str], unit: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """group columns, lo, hi, n: interval of the mean of `value` over units, from Poisson-weighted replicates; a unit weighs alike in all groups.

    With (group, time) as the group columns this is the band of a curve. The weights are drawn once a unit, not once a row.
    """
    groups = [group] if isinstance(group, str) else group
    u = lambda b: uniform(F.lit(seed), F.lit("boot"), b, F.col(unit))
    count = lambda x: sum(((x >= p).cast("int") for p in _POISSON[1:]), (x >= _POISSON[0]).cast("int"))
    drawn = df.select(unit).distinct().withColumn("__w", F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda b: count(u(b))))
    each = df.select(*groups, unit, value).join(drawn, unit).select(*groups, value, F.posexplode("__w").alias("b", "k"))
    means = each.groupBy(*groups, "b").agg((F.sum(F.col(value) * F.col("k")) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col("k"))), F.lit(0))).alias("mean"))
    at = lambda q: F.percentile("mean", F.lit(q))  # noqa: E731  over as many rows as replicates
    return means.groupBy(*groups).agg(at((1 - level) / 2).alias("lo"), at((1 + level) / 2).alias("hi"), F.count("mean").alias("n"))


def mean_curve(df: DataFrame, groups: list[str], time: str, unit: str, value: str, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """groups, time, n, mean, lo, hi: the mean over units at each time with its bootstrap interval; nulls are left out."""
    by = [*groups, time]
    rows = df.filter(F.col(value).isNotNull())
    mean = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return mean.join(bootstrap(rows, by, unit, value, replicates, seed, level).drop("n"), by)


def membership_matrix(df: DataFrame, key: str, group: str, groups: list[str]) -> DataFrame:
    """key, one flag a group, and in how many of the groups the key is."""
    flags = df.groupBy(key).agg(*(F.bool_or(F.col(group) == g).alias(g) for g in groups))
    return flags.withColumn("sets", sum((F.col(g).cast("long") for g in groups[1:]), F.col(groups[0]).cast("long")))


def density(df: DataFrame, x: str, y: str, bounds: tuple[float, float] | None, cells: int, sigma: float, reach: int, least: float, margin: float = 5.0) -> DataFrame:
    """(i, j, density): counts on a grid, smoothed by a Gaussian of `sigma` cells along each axis in turn, against the peak.

    bounds: of both axes, points outside are left out. None: from the least and largest x and y, with `margin` on each side, so that
    every point has a cell; these four numbers are one row, joined in. Points with a null or NaN place have no cell.
    """
    rows = df.select(x, y).filter(F.col(x).isNotNull() & ~F.isnan(x) & F.col(y).isNotNull() & ~F.isnan(y))
    if bounds is None:
        edge = [f(c).alias(f"__{n}{c}") for c in (x, y) for n, f in (("lo", lambda c: F.min(c) - margin), ("hi", lambda c: F.max(c) + margin))]
        rows = rows.join(F.broadcast(rows.agg(*edge)), F.lit(True))  # one row
    else:
        lo, hi = bounds
        rows = rows.filter(F.col(x).between(lo, hi) & F.col(y).between(lo, hi)).withColumns({f"__{n}{c}": F.lit(float(b)) for c in (x, y) for n, b in (("lo", lo), ("hi", hi))})
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"__lo{c}")) / ((F.col(f"__hi{c}") - F.col(f"__lo{c}")) / cells)), F.lit(cells - 1)).cast("long")
    grid = rows.groupBy(at(x).alias("i"), at(y).alias("j")).agg(F.count("*").cast("double").alias("n"))
    for axis, other in (("i", "j"), ("j", "i")):
        k = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        spread = grid.select("i", "j", "n", k.alias("k")).select((F.col(axis) + F.col("k")).alias(axis), other, (F.col("n") * F.exp(-F.col("k") * F.col("k") / (2 * sigma * sigma))).alias("n"))
        grid = spread.groupBy("i", "j").agg(F.sum("n").alias("n"))
    inside = grid.filter(F.col("i").between(0, cells - 1) & F.col("j").between(0, cells - 1))
    peak = inside.agg(F.max("n").alias("peak"))  # one row
    return inside.join(F.broadcast(peak), F.lit(True)).select("i", "j", (F.col("n") / F.col("peak")).alias("density")).filter(F.round("density", 9) >= least)


def stacked(df: DataFrame, keys: list[str], side: str, order: list[Column | str], height: bool = False) -> DataFrame:
    """`df` with `place` (from 1, in `order` within keys and side) and `line` (from 1 within keys: the last side by name first, then by place).

    With `height` every key is filled at its end up to the lines of the largest key; the rows put in have nulls but for keys and line.
    """
    placed = ranked(df, [*keys, side], order)
    sizes = placed.groupBy(*keys, side).agg(F.count("*").alias("__n"))  # a row a key and side
    above = sizes.select(*keys, side, F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.desc(side)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
    out = placed.join(above, [*keys, side]).withColumn("line", F.col("place") + F.col("__above")).drop("__above")
    if not height:
        return out
    each = sizes.groupBy(*keys).agg(F.sum("__n").alias("n"))
    most = each.agg(F.max("n").alias("most"))  # one row
    short = each.join(F.broadcast(most), F.col("n") < F.col("most")).select(*keys, F.explode(F.sequence(F.col("n") + 1, F.col("most"))).alias("line"))
    return out.unionByName(short, allowMissingColumns=True)
