"""Joins of dimension tables, catalogues and point sets. Keys that are null meet nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.series import nearest


def with_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with a flag: whether `other` has the row's keys. Repeats in `other` don't repeat rows."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_default(df: DataFrame, other: DataFrame, keys: list[str], value: str, default) -> DataFrame:
    """Left join of one value, which is `default` where the companion table has no row or null."""
    return df.join(other.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_alternates(df: DataFrame, others: list[tuple[str, DataFrame]], keys: list[str], values: dict) -> DataFrame:
    """`df` with the columns `values` (name: default) from the first companion table that has the row's keys, and `companion`, its name (null: none, all defaults).

    A companion that has the keys counts with its nulls, which become the defaults; later ones are not asked.
    """
    for i, (name, other) in enumerate(others):
        df = df.join(other.select(*keys, F.struct(F.lit(name).alias("name"), *values).alias(f"__c{i}")).dropDuplicates(keys), keys, "left")
    first = F.coalesce(*(F.col(f"__c{i}") for i in range(len(others))))
    out = df.withColumn("__first", first).drop(*(f"__c{i}" for i in range(len(others))))
    return out.withColumns({c: F.coalesce(F.col("__first")[c], F.lit(default)) for c, default in values.items()} | {"companion": F.col("__first")["name"]}).drop("__first")


def double_lookup(pairs: DataFrame, lookup: DataFrame, key: str, value: str, ends: tuple[str, str], default: str) -> DataFrame:
    """Columns <end>_<value> for both ends of a pair, `default` where the lookup has none."""
    for end in ends:
        own = lookup.select(F.col(key).alias(end), F.col(value).alias(f"{end}_{value}"))
        pairs = pairs.join(own, end, "left").withColumn(f"{end}_{value}", F.coalesce(f"{end}_{value}", F.lit(default)))
    return pairs


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key: the value written last in `order`."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_source(catalogues: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Union of catalogues; of a key in several the first source's row, with the number of sources that have it."""
    tagged = reduce(DataFrame.unionByName, (df.select(*keys).distinct().withColumns({"source": F.lit(name), "priority": F.lit(i)}) for i, (name, df) in enumerate(catalogues)))
    return tagged.groupBy(*keys).agg(F.min_by("source", "priority").alias("source"), F.count("*").alias("sources"))


def exact_else_part(wanted: DataFrame, names: DataFrame, want: str, name: str) -> DataFrame:
    """Pairs of equal names; a wanted name without any meets those that contain it.

    The names' parts are posted (every part of a name that is as long as a wanted name), so the fallback is a join on equality.
    """
    exact = wanted.join(names, F.col(want) == F.col(name))
    rest = wanted.join(names, F.col(want) == F.col(name), "left_anti").filter(F.length(want) > 0)
    sizes = rest.select(F.length(want).alias("size")).distinct()
    posted = names.join(F.broadcast(sizes), F.length(name) >= F.col("size")).select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length(name) - F.col("size") + 1), lambda i: F.substring(name, i, F.col("size")))).alias("part")).drop("size").distinct()
    return exact.unionByName(rest.join(posted, F.col(want) == F.col("part")).drop("part"))


def alignment(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """One row: rows of a, rows of b, places at which the values in `order` differ, the first of them (null: aligned). `order` numbers rows from 0 on both sides."""
    x, y = a.select(F.col(order).alias("at"), F.col(value).alias("x"), F.lit(1).alias("in_a")), b.select(F.col(order).alias("at"), F.col(value).alias("y"), F.lit(1).alias("in_b"))
    both = x.join(y, "at", "full")
    wrong = F.col("in_a").isNull() | F.col("in_b").isNull() | ~F.col("x").eqNullSafe(F.col("y"))
    return both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(wrong).alias("n_differ"), F.min(F.when(wrong, F.col("at"))).alias("first"))


def near_class(queries: DataFrame, cloud: DataFrame, limit: float, strict: bool = True) -> DataFrame:
    """Queries (id, class, x, y, z) with the distance to the nearest cloud point of their own class, and whether it is within the limit.

    Points meet in grid cells of the limit's size; distances beyond it are not needed and are null.
    """
    cell = lambda c: F.floor(F.col(c) / limit)
    home = cloud.select(F.col("class"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"), cell("x").alias("gx"), cell("y").alias("gy"), cell("z").alias("gz"))
    around = queries.select("id", "class", "x", "y", "z")
    for c in "xyz":
        around = around.select("*", F.explode(F.array(*(F.lit(d) + cell(c) for d in (-1, 0, 1)))).alias(f"g{c}"))
    dist = F.sqrt((F.col("x") - F.col("vx")) ** 2 + (F.col("y") - F.col("vy")) ** 2 + (F.col("z") - F.col("vz")) ** 2)
    met = around.join(home, ["class", "gx", "gy", "gz"]).groupBy("id").agg(F.min(dist).alias("dist"))
    ok = F.col("dist") < limit if strict else F.col("dist") <= limit
    return queries.select("id", "class").join(met, "id", "left").select("id", "class", F.when(ok, F.col("dist")).alias("dist"), F.coalesce(ok, F.lit(False)).alias("near"))


def nearest_of_class(queries: DataFrame, cloud: DataFrame, cell: float) -> DataFrame:
    """(id, vid, dist, expected): the nearest cloud point of any class, and whether it is of the query's class."""
    found = nearest(queries.select("id", "x", "y", "z"), cloud.select("id", "x", "y", "z"), cell)
    classes = cloud.select(F.col("id").alias("vid"), F.col("class").alias("vertex_class"))
    return found.join(classes, "vid").join(queries.select("id", "class"), "id").select("id", "vid", "dist", F.col("class").eqNullSafe(F.col("vertex_class")).alias("expected"))


def complete_pairs(df: DataFrame, keys: list[str], group: str, a: str, b: str, value: str) -> DataFrame:
    """keys, a, b: values of two groups side by side, only where both have one."""
    return df.filter(F.col(group).isin(a, b)).groupBy(*keys).pivot(group, [a, b]).agg(F.avg(value)).na.drop(subset=[a, b])


def keep_first(df: DataFrame, subset: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key, the first in `order`; Spark keeps one row a key and task before it deals them out."""
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")
