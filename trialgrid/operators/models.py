"""Models over long trial tables: permutation clusters, ridge fits on Gram matrices, autoregression, factorisation, mixed model.

The rows are added up by Spark into fixed-size sums (features squared, independent of the number of trials); only those sums reach
a small numpy finaliser, one group a key. Every permutation is one more column of the right-hand side, so a Gram matrix serves all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialgrid.operators.series import runs
from trialgrid.operators.stats import empirical_p, group_bits, md5_of
from trialgrid.sources.work import written


def sign_flips(df: DataFrame, unit: str, permutations: int, seed: int) -> DataFrame:
    """`df` for each perm from 0 (as observed), with `sign`: the two conditions of a unit are exchanged or not by md5 of seed, perm and unit."""
    each = df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    flip = F.substring(md5_of(F.lit(seed), F.col("perm"), F.col(unit)), 1, 1) < "8"
    return each.withColumn("sign", F.when((F.col("perm") > 0) & flip, -1.0).otherwise(1.0))


def permutation_clusters(df: DataFrame, keys: list[str], unit: str, order: str, diff: str, permutations: int, seed: int, p_threshold: float = 0.1) -> DataFrame:
    """Clusters (keys, start, stop, n, p) of samples at which the mean difference of two conditions is large.

    `df` has one difference a unit and sample. The null exchanges the conditions of whole units. A sample's p is its place among all permutations;
    a cluster is a maximal run of samples with p under the threshold, and its p is the share of permutations with a run as long.
    """
    stat = sign_flips(df, unit, permutations, seed).groupBy(*keys, "perm", order).agg(F.round(F.avg(F.col("sign") * F.col(diff)), 9).alias("stat"))
    return rated_clusters(stat.drop("n"), keys, order, permutations, p_threshold)[1]


def rated_clusters(stat: DataFrame, keys: list[str], order: str, permutations: int, p_threshold: float) -> tuple[DataFrame, DataFrame]:
    """(keys, perm, order, stat, p, on) of rows (keys, perm, order, stat), and the observed clusters (keys, start, stop, n, p) against each permutation's longest."""
    w = Window.partitionBy(*keys, order).orderBy(F.desc("stat"))  # as many rows as permutations
    on = stat.withColumn("p", F.round(F.count("*").over(w) / (permutations + 1), 9)).withColumn("on", F.col("p") < p_threshold)
    found = written(runs(on, [*keys, "perm"], order, "on"), "clusters")
    longest = on.select(*keys, "perm").distinct().join(found.groupBy(*keys, "perm").agg(F.max("n").alias("most")), [*keys, "perm"], "left").filter("perm > 0").select(*keys, F.coalesce("most", F.lit(0)).alias("most"))
    both = found.filter("perm = 0").join(longest, keys or F.lit(True))
    return on, both.groupBy(*keys, "start", "stop", "n").agg(((F.count_if(F.col("most") >= F.col("n")) + 1) / (F.count("*") + 1)).alias("p"))


def shuffled_differences(df: DataFrame, keys: list[str], unit: str, group: str, order: str, value: str, permutations: int, seed: int) -> DataFrame:
    """keys, perm, order, stat: mean of `value` over the units in the group less that over the others, for the units as they are (perm 0) and shuffled.

    df: a row a unit and sample; `group` is a boolean of the unit, the groups may differ in size. A row carries its unit's place in all
    shuffles, and each task adds its rows up by sample for all shuffles at once. Nulls are left out; a sample at which one side has no value has no row.
    """
    bits = group_bits(df, keys, unit, group, permutations, seed)
    rows = df.select(*keys, unit, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)").join(bits, [*keys, unit])
    kinds = rows.select(*keys, "__o").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "s array<double>, n array<bigint>, total double, rows bigint"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            at, first = frame.groupby([*keys, "__o"], dropna=False, sort=False).ngroup().to_numpy(), ~frame.duplicated([*keys, "__o"]).to_numpy()
            order_ = np.argsort(at, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(at[order_]) > 0])
            on, v = np.stack(frame.bits.to_numpy())[order_].astype(float), frame["__v"].to_numpy()[order_]
            out = frame.loc[first, [*keys, "__o"]].reset_index(drop=True)  # groups are numbered as they come
            out["s"], out["n"] = list(np.add.reduceat(on * v[:, None], heads)), list(np.add.reduceat(on, heads).astype(np.int64))
            out["total"], out["rows"] = np.add.reduceat(v, heads), np.diff(np.r_[heads, len(v)])
            yield out

    part = rows.select(*keys, "__o", "__v", "bits").mapInPandas(partial, schema)
    each = part.select(*keys, "__o", "total", "rows", F.posexplode(F.arrays_zip("s", "n")).alias("perm", "e"))
    sums = each.groupBy(*keys, "perm", "__o").agg(F.sum("e.s").alias("s"), F.sum("e.n").alias("n"), F.sum("total").alias("total"), F.sum("rows").alias("rows"))
    stat = F.round(F.col("s") / F.col("n") - (F.col("total") - F.col("s")) / (F.col("rows") - F.col("n")), 9)
    return sums.filter("n > 0 and n < rows").select(*keys, "perm", F.col("__o").alias(order), stat.alias("stat"))


def two_sample_clusters(df: DataFrame, keys: list[str], unit: str, group: str, order: str, value: str, permutations: int, seed: int, p_threshold: float = 0.1, p_mask: float = 0.05) -> DataFrame:
    """(keys, order, stat, pval, cluster_p, mask): where one group of units lies above the other, of samples that both groups have.

    The null shuffles which units are in the group. pval: a sample's place among all shuffles, one-sided. A run of samples with pval under `p_threshold` is
    held against the longest run of each shuffle (cluster_p, null outside runs); mask is on where both the run's p and the sample's own
    are under `p_mask`.
    """
    stat = written(shuffled_differences(df, keys, unit, group, order, value, permutations, seed), "differences")
    on, clusters = rated_clusters(stat, keys, order, permutations, p_threshold)
    found = clusters.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "start", "stop", F.col("p").alias("cluster_p"))
    inside = [*(F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)), F.col("on"), F.col(order).between(F.col("start"), F.col("stop"))]
    # a run a key and sample at most; clusters are fewer than samples
    got = on.filter("perm = 0").join(found, inside, "left")
    return got.select(*keys, order, "stat", F.col("p").alias("pval"), "cluster_p", F.coalesce((F.round("cluster_p", 9) < p_mask) & (F.col("p") < p_mask), F.lit(False)).alias("mask"))


def two_sided_p(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, observed (perm 0), p by absolute value, with one added to count and total."""
    best = scores.filter("perm = 0").select(*keys, F.col(score).alias("observed"))
    both = scores.filter("perm > 0").join(best, keys)
    return both.groupBy(*keys, "observed").agg(((F.count_if(F.abs(score) >= F.abs("observed")) + 1) / (F.count("*") + 1)).alias("p"))


# --- clusters on a map ---


def grid_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col) with `label`, the smallest (row, col) of their component; cells that share a side are joined. Keys are not null.

    In each round a cell takes the smallest label around it and then that label's own, so that long components need few rounds.
    """
    state = written(cells.select(*keys, "row", "col").distinct().withColumn("label", F.struct("row", "col")), "components")
    around = F.array(*(F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(not r and not c).alias("own")) for r, c in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))))
    while True:
        sent = state.select(*keys, "label", F.explode(around).alias("to")).select(*keys, "label", "to.*")
        near = sent.groupBy(*keys, "row", "col").agg(F.min("label").alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("old")).filter("old is not null")
        hop = state.select(*keys, F.struct("row", "col").alias("label"), F.col("label").alias("far"))
        moved = written(near.join(hop, [*keys, "label"]).select(*keys, "row", "col", "old", F.col("far").alias("label")), "components")
        state = moved.drop("old")
        if moved.filter("label <> old").isEmpty():
            return state


def grid_clusters(scores: DataFrame, keys: list[str], score: str, permutations: int, p_threshold: float = 0.05, p_cluster: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The mask of a map of scores against permuted ones, and the place of each permuted score among the others.

    scores: keys, perm (0 as observed), row, col and `score`, no nulls. Mask: keys, row, col, observed, p, size (of the cell's cluster, 0 outside), p_size, mask.
    A cell is on where its p (one added to count and total) is under `p_threshold`, a permuted cell where more than 1 - p_threshold of
    the other permutations score less. The size of a cluster of cells that share sides is held against the largest cluster of each
    permutation, 0 where it has none. An empty table gives no rows.
    """
    at = [*keys, "row", "col"]
    observed = empirical_p(scores, at, score)
    lower = (F.rank().over(Window.partitionBy(*at).orderBy(score)) - 1) / max(permutations - 1, 1)  # as many rows as permutations
    null = written(scores.filter("perm > 0").select(*at, "perm", lower.alias("percentile")), "percentiles")
    on = observed.filter(F.round("p", 9) < p_threshold).select(*keys, F.lit(0).alias("perm"), "row", "col").unionByName(null.filter(F.round("percentile", 9) > 1 - p_threshold).select(*keys, "perm", "row", "col"))
    cells = grid_components(on, [*keys, "perm"])
    sizes = written(cells.groupBy(*keys, "perm", "label").agg(F.count("*").alias("size")), "sizes")
    most = null.select(*keys, "perm").distinct().join(sizes.groupBy(*keys, "perm").agg(F.max("size").alias("most")), [*keys, "perm"], "left").select(*keys, F.coalesce("most", F.lit(0)).alias("most"))
    found = sizes.filter("perm = 0").drop("perm")
    rated = found.join(most, keys or F.lit(True)).groupBy(*keys, "label", "size").agg(((F.count_if(F.col("most") >= F.col("size")) + 1) / (F.count("*") + 1)).alias("p_size"))
    inside = cells.filter("perm = 0").drop("perm").join(rated, [*keys, "label"]).drop("label")
    mask = observed.join(inside, at, "left").withColumns({"size": F.coalesce("size", F.lit(0)), "mask": F.coalesce(F.round("p_size", 9) < p_cluster, F.lit(False))})
    return mask, null


# --- ridge ---


def gram_sums(rows: DataFrame, keys: list[str], features: int, targets=None) -> DataFrame:
    """Sums (keys, i, j, v) of the outer products of [1, x, y] over rows (keys, x array, y array): partial in each task, then added up. Null and NaN features count as 0.

    targets: gives y for a frame of rows instead of a column y.
    """
    carried = [] if targets is None else [c for c in rows.columns if c not in (*keys, "x", "y")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "i int, j int, v double"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False):
                x = np.nan_to_num(np.stack(part.x.to_numpy()).astype(float))
                m = np.hstack([np.ones((len(x), 1)), x, np.stack(part.y.to_numpy()) if targets is None else targets(part)])
                s = m[:, : features + 1].T @ m
                i, j = np.indices(s.shape)
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame({**{k: [v] * s.size for k, v in zip(keys, key, strict=True)}, "i": i.ravel(), "j": j.ravel(), "v": s.ravel()})

    return rows.select(*keys, "x", *(["y"] if targets is None else carried)).mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def solve_ridge(s: np.ndarray, features: int, alpha: float, variance: float | None, scale: bool = True) -> np.ndarray:
    """Weights ([intercept, features] x targets) from the sums of the training rows: features are standardised (but without `scale`), with `variance` cut to the leading principal components."""
    n = s[0, 0]
    mean = s[0] / n
    centred = s[1:] - n * np.outer(mean[1 : features + 1], mean)
    xx, xy = centred[:, 1 : features + 1], centred[:, features + 1 :]
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean[1 : features + 1]), 1), sd, np.inf)  # a constant feature tells nothing
    sd = sd if scale else np.ones(features)
    xx, xy = xx / np.outer(sd, sd), xy / sd[:, None]
    if variance is None:
        w = np.linalg.solve(xx + alpha * np.eye(features), xy)
    else:
        value, vector = np.linalg.eigh(xx)
        value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
        k = int(np.searchsorted(np.cumsum(value), variance * value.sum() * (1 - 1e-12))) + 1
        w = vector[:, :k] @ ((vector[:, :k].T @ xy) / (value[:k] + alpha)[:, None])
    w /= sd[:, None]
    return np.vstack([mean[features + 1 :] - mean[1 : features + 1] @ w, w])


def cross_fit(rows: DataFrame, keys: list[str], features: int, targets: int, alpha: float = 1.0, variance: float | None = None, blocks: int = 1) -> DataFrame:
    """Weights (keys, fold, w: (1 + features) x targets, row by row) of a ridge fit on all folds but the named one.

    rows: keys, fold, x (array), y (array of `targets` numbers; with `blocks` as many for each fold, of which a fold's fit takes its own).
    """
    sums = gram_sums(rows, [*keys, "fold"], features)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "fold int, w array<double>"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        folds = sorted(part.fold.unique())
        s = np.zeros((len(folds), features + 1, features + 1 + blocks * targets))
        s[np.searchsorted(folds, part.fold), part.i, part.j] = part.v
        first = [features + 1 + (f * targets if blocks > 1 else 0) for f in folds]
        own = [np.r_[0 : features + 1, at : at + targets] for at in first]
        out = [solve_ridge((s.sum(0) - s[i])[:, own[i]], features, alpha, variance).ravel().tolist() if len(folds) > 1 else None for i in range(len(folds))]
        return pd.DataFrame({**{k: [v] * len(folds) for k, v in zip(keys, key, strict=True)}, "fold": folds, "w": out})

    return sums.groupBy(*keys).applyInPandas(fit, schema)  # folds x features x targets rows a key


def predict(rows: DataFrame, fitted: DataFrame, keys: list[str], features: int, targets: int) -> DataFrame:
    """`rows` with `pred`, the array of predictions by the weights of their keys."""
    at = lambda t: F.aggregate(F.zip_with("x", F.transform(F.sequence(F.lit(1), F.lit(features)), lambda i: F.get("w", (i * targets + t).cast("int"))), lambda a, b: a * b), F.get("w", t.cast("int")), lambda s, z: s + z)
    return rows.join(fitted.withColumnRenamed("fold", "__fold"), [*keys, F.col("fold") == F.col("__fold")] if not keys else keys).filter("fold = __fold").withColumn("pred", F.transform(F.sequence(F.lit(0), F.lit(targets - 1)), lambda t: at(t))).drop("__fold", "w")


# --- autoregression of several channels ---


def autoregression_sums(trials: DataFrame, keys: list[str], channels: int, order: int) -> DataFrame:
    """Sums (keys, i, j, v) for regressing a sample of all channels on the `order` samples before it; trials: keys, m (channels x samples, row by row)."""
    width = channels * order
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keys).schema), "i int, j int, v double"])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False):
                x = np.stack(part.m.to_numpy()).reshape(len(part), channels, -1)
                past = np.concatenate([x[:, :, order - k - 1 : x.shape[2] - k - 1] for k in range(order)], 1)
                both = np.concatenate([past, x[:, :, order:]], 1).transpose(1, 0, 2).reshape(width + channels, -1)
                s = both @ both.T
                i, j = np.indices(s.shape)
                key = key if isinstance(key, tuple) else (key,)
                yield pd.DataFrame({**{k: [v] * s.size for k, v in zip(keys, key, strict=True)}, "i": i.ravel(), "j": j.ravel(), "v": s.ravel()})

    return trials.select(*keys, "m").mapInPandas(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def coherence(coefficients: np.ndarray, channels: int, order: int, bins: int) -> np.ndarray:
    """Partial directed coherence [target, source] from (channels x channels * order) coefficients, mean over `bins` frequencies up to the half of the sampling rate."""
    f = np.arange(bins) / (2 * bins)
    a = np.eye(channels)[None] - sum(coefficients[None, :, r * channels : (r + 1) * channels] * np.exp(-2j * np.pi * f * (r + 1))[:, None, None] for r in range(order))
    return (np.abs(a) / np.sqrt((np.abs(a) ** 2).sum(1, keepdims=True))).mean(0)


def directed_coherence(trials: DataFrame, keys: list[str], channels: int, order: int, bins: int = 32) -> DataFrame:
    """Edges (keys, source, target, pdc) of an autoregression pooled over trials; self edges are left out."""
    sums = autoregression_sums(trials, keys, channels, order)
    width = channels * order
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keys).schema), "source int, target int, pdc double"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        s = np.zeros((width + channels, width + channels))
        s[part.i, part.j] = part.v
        past = s[:width, :width]
        c = np.linalg.solve(past + 1e-9 * np.trace(past) / width * np.eye(width), s[:width, width:]).T
        pdc = coherence(c, channels, order, bins)
        target, source = np.nonzero(~np.eye(channels, dtype=bool))
        return pd.DataFrame({**{k: [v] * len(target) for k, v in zip(keys, key, strict=True)}, "source": source, "target": target, "pdc": pdc[target, source]})

    return sums.groupBy(*keys).applyInPandas(fit, schema)  # (channels x order) squared rows a key


def _mixed(*parts) -> np.ndarray:
    """64-bit hashes of the broadcast parts, each mixed in on top of those before it."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in parts:
            out = (out ^ np.asarray(x).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def window_starts(samples: int, size: int, step: int) -> np.ndarray:
    """First samples of all whole windows of a trial: window k is [k * step, k * step + size)."""
    return np.arange(0, samples - size + 1, step)


def shifts(unit: np.ndarray, window: int, perm: int, channels: int, size: int, seed: int) -> np.ndarray:
    """By how many samples, from 1 to size - 1, each channel of each unit moves along a window's ring."""
    return (_mixed(seed, window, perm, unit[:, None], np.arange(channels)) % np.uint64(size - 1)).astype(np.int64) + 1


def window_sums(trials: DataFrame, keys: list[str], unit: str, channels: int, order: int, size: int, step: int, permutations: int = 0, seed: int = 0) -> DataFrame:
    """Sums (keys, win, perm, i, j, v) for regressing a sample of all channels on the `order` samples before it, pooled over trials, in sliding windows.

    trials: keys, unit (any type), m (channels x samples, row by row; trials may differ in length). The cuts at which some window begins or
    ends part a trial into segments no longer than a step; the products of a segment's samples are added up once, and a window (perm 0) is the sum
    of its segments. In the other perms every channel of every trial moves along the window's own ring, which crosses no segment, so these
    are added up window by window. A task holds one window's sums at a time and gives them for each batch of its trials.
    """
    width = channels * order
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keys).schema), "win int, perm int, n bigint, i int, j int, v double"])
    i, j = np.triu_indices(width + channels)

    def stacked(x: np.ndarray) -> np.ndarray:
        """[past, present] by sample: (channels * (order + 1)) x trials x (samples - order)."""
        past = [x[:, :, order - k - 1 : x.shape[2] - k - 1] for k in range(order)]
        return np.concatenate([*past, x[:, :, order:]], 1).transpose(1, 0, 2)

    def product(z: np.ndarray) -> np.ndarray:
        flat = z.reshape(len(z), -1)
        return flat @ flat.T

    def of(key: tuple, win: int, perm: int, n: int, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [x] * len(i) for k, x in zip(keys, key, strict=True)}, "win": win, "perm": perm, "n": n, "i": i, "j": j, "v": s[i, j]})

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["__samples"] = [len(m) // channels for m in frame.m]
            frame["__unit"] = pd.util.hash_array(frame[unit].astype(str).to_numpy(dtype=object))
            for key, part in frame.groupby([*keys, "__samples"], dropna=False):
                *key, samples = key
                starts = window_starts(samples, size, step)
                if not len(starts):
                    continue
                x = np.nan_to_num(np.stack(part.m.to_numpy()).astype(float)).reshape(len(part), channels, samples)
                z = stacked(x)  # its place t is the regression of sample t + order
                cuts = np.unique(np.r_[starts, starts + size - order])
                segment = [product(z[:, :, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                each = len(part) * (size - order)
                for win, start in enumerate(starts):
                    a, b = np.searchsorted(cuts, [start, start + size - order])
                    yield of(key, win, 0, each, sum(segment[a:b]))
                    for perm in range(1, permutations + 1):
                        by = shifts(part["__unit"].to_numpy(), win, perm, channels, size, seed)
                        ring = np.take_along_axis(x[:, :, start : start + size], (np.arange(size) - by[:, :, None]) % size, 2)
                        yield of(key, win, perm, each, product(stacked(ring)))

    sums = trials.select(*keys, unit, "m").mapInPandas(partial, schema)
    return sums.groupBy(*keys, "win", "perm", "i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def windowed_autoregression(trials: DataFrame, keys: list[str], unit: str, channels: int, order: int, size: int, step: int, permutations: int = 0, seed: int = 0) -> DataFrame:
    """keys, win, perm, start, stop, n, coef (channels x channels * order) and rescov (channels x channels), row by row, by least squares.

    n: regressions pooled, trials times (size - order). rescov: the mean over them of the products of residuals.
    """
    width = channels * order
    sums = window_sums(trials, keys, unit, channels, order, size, step, permutations, seed)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keys).schema), "win int, perm int, start int, stop int, n bigint, coef array<double>, rescov array<double>"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        *own, win, perm = key
        s = np.zeros((width + channels,) * 2)
        s[part.i, part.j] = part.v
        s = np.triu(s) + np.triu(s, 1).T
        past, cross, now = s[:width, :width], s[:width, width:], s[width:, width:]
        coef = np.linalg.solve(past + 1e-9 * max(np.trace(past) / width, 1e-30) * np.eye(width), cross).T
        n = int(part.n.iloc[0])
        left = (now - coef @ cross - (coef @ cross).T + coef @ past @ coef.T) / n
        return pd.DataFrame({**{k: [x] for k, x in zip(keys, own, strict=True)}, "win": [win], "perm": [perm], "start": [win * step], "stop": [win * step + size], "n": [n], "coef": [coef.ravel()], "rescov": [left.ravel()]})

    return sums.groupBy(*keys, "win", "perm").applyInPandas(fit, schema)  # (channels x order) squared rows a window


def windowed_coherence(trials: DataFrame, keys: list[str], unit: str, channels: int, order: int, size: int, step: int, permutations: int, seed: int, bins: int = 64) -> DataFrame:
    """Edges (keys, win, start, stop, source, target, pdc, p) of each window; p one-sided against circular shifts within the window, with one added to count and total."""
    fitted = written(windowed_autoregression(trials, keys, unit, channels, order, size, step, permutations, seed).drop("rescov", "n"), "autoregressions")
    at = [*keys, "win", "start", "stop"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fitted.select(*at, "perm").schema), "source int, target int, pdc double"])
    target, source = np.nonzero(~np.eye(channels, dtype=bool))

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                pdc = coherence(np.asarray(row.coef).reshape(channels, -1), channels, order, bins)
                own = {c: [getattr(row, c)] * len(target) for c in (*at, "perm")}
                yield pd.DataFrame({**own, "source": source, "target": target, "pdc": pdc[target, source]})

    got = fitted.select(*at, "perm", "coef").mapInPandas(edges, schema).withColumn("pdc", F.round("pdc", 12))
    if not permutations:
        return got.drop("perm").withColumn("p", F.lit(None).cast("double"))
    return empirical_p(got, [*at, "source", "target"], "pdc").withColumnRenamed("observed", "pdc")


def shifted_trials(trials: DataFrame, unit: str, channels: int, samples: int, permutations: int, seed: int) -> DataFrame:
    """`trials` for each perm from 0 (as observed); in the others every channel of every trial moves along its ring by 1 to samples - 1, by md5."""
    each = trials.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    by = lambda c: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("shift"), F.col("perm"), F.col(unit), c)), 1, 8), 16, 10).cast("long") % (samples - 1) + 1

    def moved(c):
        row = F.slice("m", c * samples + 1, samples)
        k = by(c).cast("int")
        return F.concat(F.slice(row, samples - k + 1, k), F.slice(row, F.lit(1), samples - k))

    rolled = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), moved))
    return each.withColumn("m", F.when(F.col("perm") == 0, F.col("m")).otherwise(rolled))


def dense(df: DataFrame, keys: list[str], at: str, value: str, length: int, out: str) -> DataFrame:
    """keys and `out`: an array of `length` numbers with `value` at place `at` (0 to length - 1, one row a place), 0 elsewhere and for nulls."""
    cells = df.groupBy(*keys).agg(F.collect_list(F.struct(F.col(at).cast("int").alias("i"), F.col(value).cast("double").alias("v"))).alias("e"))  # at most `length`

    def filled(place: pd.Series, value: pd.Series) -> pd.Series:
        rows = []
        for i, x in zip(place, value, strict=True):
            row = np.zeros(length)
            row[np.asarray(i)] = np.nan_to_num(np.asarray(x, float))
            rows.append(row)
        return pd.Series(rows)

    return cells.select(*keys, F.pandas_udf(filled, "array<double>")("e.i", "e.v").alias(out))


# --- factorisation ---


def factorise(rows: DataFrame, components: int, iterations: int = 30, inner: int = 40, seed: int = 0) -> tuple[DataFrame, np.ndarray, float]:
    """Non-negative factors of rows (key, v: array over time): W as rows (key, w), H (components x time), and the reconstruction error.

    A row's weights follow from H alone, so a pass over the rows updates H from two small sums; nothing but H (components x time) and
    these sums is on the driver, and no state of a row is kept between passes. Values below 0 count as 0.
    """
    rows = written(rows.select("key", "v"), "factorise")
    time = rows.agg(F.max(F.size("v"))).first()[0]
    if not time:
        return rows.select("key", F.array().cast("array<double>").alias("w")), np.zeros((components, 0)), 0.0
    h = np.random.RandomState(seed).uniform(0.1, 1.0, (components, time))

    def weights(v: np.ndarray, h: np.ndarray) -> np.ndarray:
        w, vh, hh = np.ones((len(v), components)), v @ h.T, h @ h.T
        for _ in range(inner):
            w *= vh / np.maximum(w @ hh, 1e-12)
        return w

    def stacked(frame: pd.DataFrame) -> np.ndarray:
        return np.maximum(np.nan_to_num(np.stack(frame.v.to_numpy()).astype(float)), 0)

    def sums(h: np.ndarray):
        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((components, time + components))
            error = 0.0
            for frame in frames:
                if len(frame):
                    v = stacked(frame)
                    w = weights(v, h)
                    total += np.hstack([w.T @ v, w.T @ w])
                    error += float(((v - w @ h) ** 2).sum())
            flat = np.append(total.ravel(), error)
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        got = rows.select("v").mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(components * (time + components) + 1)
        for r in got:
            flat[r.i] = r.v
        both = flat[:-1].reshape(components, -1)
        return both[:, :time], both[:, time:], flat[-1]

    error = 0.0
    for _ in range(iterations):
        wv, ww, error = sums(h)
        h = h * wv / np.maximum(ww @ h, 1e-12)
        h /= np.maximum(h.max(1, keepdims=True), 1e-12)

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"key": frame.key, "w": weights(stacked(frame), h).tolist()})

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(final, f"key {key}, w array<double>"), h, float(np.sqrt(sums(h)[2]))


# --- mixed model ---


def random_intercept(df: DataFrame, group: str, y: str, x: list[str], ratios: int = 33, rounds: int = 4) -> tuple[np.ndarray, float, float]:
    """(coefficients of [1, x], residual variance, variance of the groups' intercepts) by maximum likelihood.

    Each group counts through its sums (a row a group). For every variance ratio of a grid Spark adds up the groups' parts of the normal equations;
    the driver holds (1 + x) squared numbers a ratio, and narrows the grid around the best.
    """
    names = ["1", *x]
    rows = df.select(F.col(group).alias("g"), F.lit(1.0).alias("c0"), *(F.col(c).cast("double").alias(f"c{i + 1}") for i, c in enumerate(x)), F.col(y).cast("double").alias(f"c{len(names)}")).na.drop()
    p = len(names)
    cells = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    sums = written(rows.groupBy("g").agg(F.count("*").alias("n"), *(F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in cells)), "groups")
    lo, hi, best = -8.0, 8.0, None
    for _ in range(rounds):
        grid = np.exp(np.linspace(lo, hi, ratios))
        each = sums.withColumn("r", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
        shrink = F.col("r") / (1 + F.col("n") * F.col("r"))
        got = each.groupBy("r").agg(F.sum("n").alias("n"), F.sum(F.log(1 + F.col("n") * F.col("r"))).alias("logdet"), *(F.sum(F.col(f"s{i}_{j}") - shrink * F.col(f"s0_{i}") * F.col(f"s0_{j}")).alias(f"s{i}_{j}") for i, j in cells)).collect()
        for row in got:
            m = np.zeros((p + 1, p + 1))
            for i, j in cells:
                m[i, j] = m[j, i] = row[f"s{i}_{j}"]
            beta = np.linalg.lstsq(m[:p, :p], m[:p, p], rcond=None)[0]
            rss = m[p, p] - beta @ m[:p, p]
            value = row.n * np.log(max(rss, 1e-300) / row.n) + row.logdet
            if best is None or value < best[0]:
                best = (value, row.r, beta, rss / row.n)
        step = (hi - lo) / (ratios - 1)
        lo, hi = np.log(best[1]) - step, np.log(best[1]) + step
    return best[2], float(best[3]), float(best[3] * best[1])
