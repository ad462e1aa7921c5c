"""Correlations of all pairs of channels, by blocks of channels."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.sources.work import written

#: Pairs that keep a smaller share of their squares around the common samples' mean are computed once more by themselves.
CLOSE = 1e-2


def correlations(df: DataFrame, within: list[str], channel: str, order: str, value: str = "value", right: Column | None = None, block: int = 1024, part: int = 256) -> DataFrame:
    """within, a, b, r, n: correlation over the samples that both channels have, and their number, as a join by (within, order) gives them; NaN where one does not vary, null where no sample has both values.

    Without `right`, every pair a < b; with it, every a where it is false with every b where it is true (null: left out). The channels of a key of
    `within` are dealt into blocks of about `block`, and a task goes through pairs of blocks, holding about `part` samples of them at a time.
    So a channel's values are sent once for each block of partners; rows by pair and sample are never made.
    """
    rows = df.filter(F.col(order).isNotNull())
    for c in [*within, *([channel] if right is None else [])]:
        rows = rows.filter(F.col(c).isNotNull())
    rows = rows.select(*within, F.col(channel).alias("__name"), F.col(order).alias("__at"), F.col(value).cast("double").alias("__v"), (F.lit(False) if right is None else right).alias("__right"))
    cells = written(rows.filter(F.col("__right").isNotNull()), "cells")
    of = lambda side: F.approx_count_distinct(F.when(side, F.struct("__name")))
    cut = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("long")
    sizes = written(cells.groupBy(*within).agg(cut(of(~F.col("__right")), block).alias("__l"), cut(of(F.col("__right")), block).alias("__r"), cut(F.approx_count_distinct("__at"), part).alias("__parts")), "sizes")

    own, other = F.when(F.col("__right"), F.col("__r")).otherwise(F.col("__l")), F.when(F.col("__right") | F.lit(right is None), F.col("__l")).otherwise(F.col("__r"))
    keyed = (cells.join(sizes, within) if within else cells.crossJoin(sizes)).select(
        *within, "__right", "__name", F.pmod(F.xxhash64("__at"), F.col("__parts")).alias("__part"), F.pmod(F.xxhash64("__name"), own).alias("__k"), other.alias("__others"), F.struct("__at", "__v").alias("__cell")
    )
    series = keyed.groupBy(*within, "__right", "__name", "__part", "__k", "__others").agg(F.collect_list("__cell").alias("__cells"))
    met = series.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__others") - 1)))
    k, o = F.col("__k"), F.col("__o")
    if right is None:
        met = met.select(*within, F.least(k, o).alias("__i"), F.greatest(k, o).alias("__j"), "__part", (k > o).alias("__right"), "__name", "__cells")
    else:
        met = met.select(*within, F.when(F.col("__right"), o).otherwise(k).alias("__i"), F.when(F.col("__right"), k).otherwise(o).alias("__j"), "__part", "__right", "__name", "__cells")
    dealt = met.repartition(*within, "__i", "__j").sortWithinPartitions(*within, "__i", "__j", "__part")
    kind = df.schema[channel].dataType.simpleString()
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*within).schema), f"a {kind}, b {kind}, r double, n bigint"])
    keys, mirrored = len(within), right is None
    return dealt.mapInArrow(lambda batches: _correlated(batches, keys, mirrored), schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, tuple]]:
    """((within, i, j), part), (right, names, cells) of stretches of rows that are equal in the former."""
    for batch in batches:
        marks = list(zip(*(c.to_pylist() for c in batch.columns[: keys + 3]), strict=True))
        right, lo = batch.column(keys + 3).to_numpy(zero_copy_only=False), 0
        for mark, same in groupby(marks):
            n = len(list(same))
            yield (mark[:-1], mark[-1]), (right[lo : lo + n], batch.column(keys + 4).slice(lo, n), batch.column(keys + 5).slice(lo, n))
            lo += n


def _correlated(batches: Iterator[pa.RecordBatch], keys: int, mirrored: bool) -> Iterator[pa.RecordBatch]:
    for key, runs in groupby(_runs(batches, keys), lambda x: x[0][0]):
        alone = mirrored and key[-2] == key[-1]  # a block with itself
        names: tuple[dict, dict] = {}, {}
        state = kinds = None
        for _, stretch in groupby(runs, lambda x: x[0][1]):
            sides: tuple[list, list] = [], []
            for _, (right, labels, cells) in stretch:
                kinds = labels.type
                at, v = cells.flatten().flatten()
                length = pc.list_value_length(cells).to_numpy(zero_copy_only=False)
                own = [names[side].setdefault(label, len(names[side])) for side, label in zip(right.astype(int), labels.to_pylist(), strict=True)]
                cell = np.repeat(own, length), at.to_numpy(zero_copy_only=False), pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False), v.is_valid().to_numpy(zero_copy_only=False)
                of = np.repeat(right, length)
                for side in (0, 1):
                    if (here := of == side).any():
                        sides[side].append([x[here] for x in cell])
            if sides[0] and (alone or sides[1]):
                left = [np.concatenate(x) for x in zip(*sides[0], strict=True)]
                others = left if alone else [np.concatenate(x) for x in zip(*sides[1], strict=True)]
                places, index = np.unique(np.concatenate([left[1], others[1]]), return_inverse=True)
                a = _table(left, index[: len(left[0])], len(names[0]), len(places))
                b = a if alone else _table(others, index[len(left[0]) :], len(names[1]), len(places))
                state = _joined(state, _moments(a, b))
        if state is not None:
            yield from _pairs(key[:-2], list(names[0]), list(names[0 if alone else 1]), state, kinds, mirrored, alone)


def _table(cells: list[np.ndarray], place: np.ndarray, size: int, width: int) -> dict[str, np.ndarray]:
    """By channel and sample: the rows, those with a value, their mean and their squares around it, those that are no finite number."""
    at, v, there = cells[0] * width + place, cells[2], cells[3]
    table = lambda at, w=None: np.bincount(at, w, size * width).reshape(size, width).astype(float)
    rows, at, v = table(at), at[there], v[there]
    odd = ~np.isfinite(v)
    bad = table(at[odd]) if odd.any() else None
    v, count, first = np.where(odd, 0.0, v), table(at), np.zeros(size * width)
    first[at] = v
    mean = first.reshape(size, width) + table(at, v - first[at]) / np.maximum(count, 1)  # of equal values just that value
    return {"rows": rows, "count": count, "mean": mean, "squares": table(at, (v - mean.ravel()[at]) ** 2), "bad": bad}


def _moments(a: dict, b: dict) -> dict[str, np.ndarray]:
    """Of each channel of a with each of b: rows, values, their means, squares and products around the means of the samples that both have."""

    def sums(t):
        centre = (t["count"] * t["mean"]).sum(1) / np.maximum(t["count"].sum(1), 1)
        d = np.where(t["count"] > 0, t["mean"] - centre[:, None], 0.0)
        return t["count"] * t["mean"], t["count"] * d, t["squares"] + t["count"] * d * d

    (whole_a, sum_a, square_a), (whole_b, sum_b, square_b) = sums(a), sums(b)
    n = a["count"] @ b["count"].T
    few = np.maximum(n, 1)
    sx, sy, qx, qy = sum_a @ b["count"].T, a["count"] @ sum_b.T, square_a @ b["count"].T, a["count"] @ square_b.T
    got = {
        "rows": a["rows"] @ b["rows"].T, "n": n, "mx": whole_a @ b["count"].T / few, "my": a["count"] @ whole_b.T / few,
        "xx": qx - sx * sx / few, "yy": qy - sy * sy / few, "xy": sum_a @ sum_b.T - sx * sy / few, "bad": np.zeros_like(n),
    }
    if a["bad"] is not None:
        got["bad"] += a["bad"] @ b["count"].T
    if b["bad"] is not None:
        got["bad"] += a["count"] @ b["bad"].T
    got["xx"][n == 1] = got["yy"][n == 1] = got["xy"][n == 1] = 0
    again = np.argwhere((n > 1) & ((got["xx"] <= CLOSE * qx) | (got["yy"] <= CLOSE * qy)))
    step = max(1, (1 << 20) // a["mean"].shape[1])
    for lo in range(0, len(again), step):
        i, j = again[lo : lo + step].T
        w, some = a["count"][i] * b["count"][j], n[i, j]

        def around(t, k, partner, w=w, some=some):
            v = t["mean"][k]
            low, high = np.where(w > 0, v, np.inf).min(1), np.where(w > 0, v, -np.inf).max(1)
            mean = np.where(low == high, low, (w * v).sum(1) / some)
            d = np.where(w > 0, v - mean[:, None], 0.0)
            return mean, d, (partner * t["squares"][k]).sum(1) + (w * d * d).sum(1)

        (got["mx"][i, j], dx, got["xx"][i, j]), (got["my"][i, j], dy, got["yy"][i, j]) = around(a, i, b["count"][j]), around(b, j, a["count"][i])
        got["xy"][i, j] = (w * dx * dy).sum(1)
    return got


def _joined(x: dict | None, y: dict) -> dict:
    """Moments of two parts of the samples together; y may know more channels."""
    if x is None:
        return y
    x = {k: np.pad(v, [(0, new - old) for new, old in zip(y["n"].shape, v.shape, strict=True)]) for k, v in x.items()}
    n = x["n"] + y["n"]
    few = np.maximum(n, 1)
    dx, dy, both = y["mx"] - x["mx"], y["my"] - x["my"], x["n"] * y["n"] / few
    more = {"n": n, "mx": x["mx"] + dx * (y["n"] / few), "my": x["my"] + dy * (y["n"] / few), "xx": dx * dx * both, "yy": dy * dy * both, "xy": dx * dy * both}
    return {k: more[k] if k in ("n", "mx", "my") else x[k] + y[k] + more.get(k, 0) for k in y}


def _pairs(key: tuple, left: list, right: list, got: dict, kind: pa.DataType, mirrored: bool, alone: bool) -> Iterator[pa.RecordBatch]:
    keep = got["rows"] > 0
    swap = np.zeros(1, bool)
    if mirrored:
        place = {x: i for i, x in enumerate(sorted({*left, *right}))}
        p, q = np.array([place[x] for x in left]), np.array([place[x] for x in right])
        swap = p[:, None] > q
        if alone:
            keep &= p[:, None] < q
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((got["xx"] > 0) & (got["yy"] > 0) & (got["bad"] == 0), got["xy"] / (np.sqrt(got["xx"]) * np.sqrt(got["yy"])), np.nan)
    labels = pa.array([*left, *right], kind)
    step = max(1, (1 << 16) // len(right))
    for lo in range(0, len(left), step):
        i, j = np.nonzero(keep[lo : lo + step])
        i += lo
        if len(i):
            a, b = i, j + len(left)
            if mirrored and not alone:
                turned = swap[i, j]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
            columns = [*(pa.repeat(k, len(i)) for k in key), labels.take(pa.array(a)), labels.take(pa.array(b)), pa.array(r[i, j], mask=got["n"][i, j] == 0), pa.array(got["rows"][i, j].astype("int64"))]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{x}" for x in range(len(key))), "a", "b", "r", "n"])
