"""Statistics over long trial tables (trial, label, pos, value): ranks, folds, decoding, permutation nulls, surrogates, group tests.

Randomness is the md5 of the row's key, so that a lost task recomputes the same rows and another engine gets the same folds.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.summaries import average_ranked, global_place, ranked


def md5_of(*parts) -> Column:
    return F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, rho, n: correlation of the average ranks of x and y over rows that have both; ranks are dealt by range, not by key."""
    rows = df.select(*keys, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    placed = average_ranked(average_ranked(rows, keys, x, [y], "__rx"), keys, y, [x], "__ry")
    return placed.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("rho"), F.count("*").alias("n"))


def stratified_folds(trials: DataFrame, k: int) -> DataFrame:
    """(trial, label, fold): each label's trials are dealt to k folds in md5 order."""
    one = trials.select("trial", "label").distinct()
    return ranked(one, ["label"], [md5_of(F.col("trial")), F.col("trial")]).select("trial", "label", ((F.col("place") - 1) % k).alias("fold"))


def shuffled_folds(trials: DataFrame, k: int, seed: int) -> DataFrame:
    """(trial, fold): all trials dealt to k folds in md5 order."""
    placed = global_place(trials.select("trial"), [md5_of(F.lit(seed), F.col("trial")), F.col("trial")])
    return placed.select("trial", ((F.col("place") - 1) % k).alias("fold"))


def folds_spreading_gaps(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(trial, label, gap, fold): each label's complete trials are dealt to the folds first, then on those with a missing value."""
    one = rows.groupBy("trial", "label").agg(F.bool_or(F.col("value").isNull()).alias("gap"))
    placed = ranked(one, ["label"], [F.col("gap"), md5_of(F.lit(seed), F.col("trial")), F.col("trial")])
    return placed.select("trial", "label", "gap", ((F.col("place") - 1) % k).alias("fold"))


def mixup(rows: DataFrame, folds: DataFrame, seed: int) -> DataFrame:
    """(fold, trial, pos, value) of the missing values of each fold's training trials: a convex mix of two complete training trials of the same label.

    A label without a complete training trial gives none. With only one, both parts are that one.
    """
    every = folds.select("fold").distinct().withColumnRenamed("fold", "own")
    train = folds.withColumnRenamed("fold", "own").join(F.broadcast(every.withColumnRenamed("own", "fold")), F.col("own") != F.col("fold")).drop("own")  # folds are few
    whole = ranked(train.filter("not gap").select("fold", "label", "trial"), ["fold", "label"], [md5_of(F.lit(seed), F.col("fold"), F.col("trial")), F.col("trial")])
    donor = whole.select("fold", "label", F.col("trial").alias("donor"), (F.col("place") - 1).cast("long").alias("k"))
    count = donor.groupBy("fold", "label").agg(F.count("*").alias("m"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("mix"), "fold", "trial")), 1, 8), 16, 10).cast("long")
    need = train.filter("gap").withColumn("h", h).join(count, ["fold", "label"])
    part = lambda step, name: need.withColumn("k", (F.col("h") + step) % F.col("m")).join(donor, ["fold", "label", "k"]).select("fold", "trial", "h", F.col("donor").alias(name))
    both = part(0, "a").join(part(1, "b").drop("h"), ["fold", "trial"])
    of = lambda name: rows.select(F.col("trial").alias(name), "pos", F.col("value").alias(f"v{name}"))
    missing = rows.filter("value is null").select("trial", "pos")
    mixed = missing.join(both, "trial").join(of("a"), ["a", "pos"]).join(of("b"), ["b", "pos"])
    share = F.col("h") / F.lit(4294967296.0)
    return mixed.select("fold", "trial", "pos", (share * F.col("va") + (1 - share) * F.col("vb")).alias("value"))


def group_bits(units: DataFrame, keys: list[str], unit: str, group: str, permutations: int, seed: int) -> DataFrame:
    """keys, unit, bits: for perm 0 whether the unit is in the group (a boolean), for the others whether a shuffle puts it there, as one array of 0 and 1.

    Every shuffle of a key's units leaves the group at its size. Places of the shuffles are dealt by range of md5.
    """
    one = units.select(*keys, unit, group).distinct()
    size = one.groupBy(*keys).agg(F.count_if(group).alias("__size"))
    each = one.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    placed = ranked(each, [*keys, "perm"], [md5_of(F.lit(seed), F.col("perm"), F.col(unit)), F.col(unit)])
    sized = placed.join(size, keys) if keys else placed.join(F.broadcast(size), F.lit(True))  # one row
    shuffled = sized.groupBy(*keys, unit, group).agg(F.array_sort(F.collect_list(F.struct("perm", (F.col("place") <= F.col("__size")).cast("byte").alias("on")))).alias("s"))
    return shuffled.select(*keys, unit, F.concat(F.array(F.col(group).cast("byte")), F.transform("s", lambda x: x["on"])).alias("bits"))


def shuffled_labels(folds: DataFrame, permutations: int) -> DataFrame:
    """(perm, trial, fold, label): labels shuffled within each fold for every perm from 1; perm 0 is as observed.

    The shuffled labels stand for the truth in training and scoring. Scored by the true labels, a shuffle that the folds share
    would turn two well separated classes as a whole, right or wrong in all folds at once.
    """
    each = folds.select("*", F.explode(F.sequence(F.lit(1), F.lit(permutations))).alias("perm"))
    own = ranked(folds.select("fold", "trial"), ["fold"], [F.col("trial")])  # alike in all shuffles
    left = own.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    right = ranked(each.select("perm", "fold", "trial", "label"), ["perm", "fold"], [md5_of(F.col("perm"), F.col("trial")), F.col("trial")]).select("perm", "fold", "place", "label")
    moved = left.join(right, ["perm", "fold", "place"]).select("perm", "trial", "fold", "label")
    return folds.select(F.lit(0).alias("perm"), "trial", "fold", "label").unionByName(moved)


def shuffled_targets(rows: DataFrame, target: Column, permutations: int, seed: int, purpose: str) -> DataFrame:
    """`rows` (trial, fold, ...) with y: an array of the target and its shuffles within each fold."""
    one = rows.select("trial", "fold", target.alias("t")).distinct()
    if not permutations:
        return rows.withColumn("y", F.array(target))
    each = one.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    left = ranked(one.select("fold", "trial"), ["fold"], [F.col("trial")]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    mixed = md5_of(F.lit(seed), F.lit(purpose), F.col("perm"), F.col("trial"))
    right = ranked(each.select("perm", "fold", "trial", "t"), ["perm", "fold"], [mixed, F.col("trial")]).select("perm", "fold", "place", "t")
    moved = left.join(right, ["perm", "fold", "place"]).groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("perm", "t"))), lambda s: s["t"]).alias("moved"))
    return rows.join(moved, "trial").withColumn("y", F.concat(F.array(target), "moved")).drop("moved")


def training_shuffles(rows: DataFrame, folds: int, target: Column, permutations: int, seed: int, purpose: str) -> DataFrame:
    """`rows` (trial, fold from 0 to folds - 1, ...) with y: for each fold held out, one block after another, the target and its shuffles.

    A fold's block holds shuffles of its own, among the trials of all other folds, so that no two folds share one. In the block of
    a trial's own fold the target stands unshuffled, as a fit for that fold (`cross_fit` with blocks) leaves the trial out.
    """
    one = rows.select("trial", "fold", target.alias("t")).distinct()
    if not permutations:
        return rows.withColumn("y", F.array_repeat(target, folds))
    each = one.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter("held <> fold").withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    left = ranked(each.select("held", "perm", "trial"), ["held", "perm"], [F.col("trial")])
    mixed = md5_of(F.lit(seed), F.lit(purpose), F.col("held"), F.col("perm"), F.col("trial"))
    right = ranked(each.select("held", "perm", "trial", "t"), ["held", "perm"], [mixed, F.col("trial")]).select("held", "perm", "place", "t")
    moved = left.join(right, ["held", "perm", "place"]).groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "perm", "t"))), lambda s: s["t"]).alias("moved"))

    def block(held):
        before = F.when(held > F.col("fold"), held - 1).otherwise(held)
        own = F.array_repeat(target, permutations + 1)
        return F.when(held == F.col("fold"), own).otherwise(F.concat(F.array(target), F.slice("moved", before * permutations + 1, F.lit(permutations))))

    return rows.join(moved, "trial").withColumn("y", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), block))).drop("moved")


def class_targets(rows: DataFrame, label: str, classes, permutations: int, seed: int, folds: int = 0) -> DataFrame:
    """`rows` with y: for the label and each of its shuffles one indicator a class; with `folds` in blocks, as `training_shuffles` gives them."""
    known = F.array(*(F.lit(c) for c in classes))
    with_y = training_shuffles(rows, folds, F.col(label), permutations, seed, "class") if folds else shuffled_targets(rows, F.col(label), permutations, seed, "class")
    return with_y.withColumn("y", F.flatten(F.transform("y", lambda y: F.transform(known, lambda c: (y == c).cast("double")))))


def accuracy(pred: DataFrame, label: str, classes, permutations: int, keys: list[str] = ()) -> DataFrame:
    """keys, perm, accuracy of the class with the largest prediction, the first on ties; scored by the true label."""
    n = len(classes)
    best = F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda p: F.array_position(F.slice("pred", p * n + 1, F.lit(n)), F.array_max(F.slice("pred", p * n + 1, F.lit(n)))))
    each = pred.select(*keys, label, F.posexplode(best).alias("perm", "at"))
    known = F.array(*(F.lit(c) for c in classes))
    return each.groupBy(*keys, "perm").agg(F.round(F.avg((F.get(known, (F.col("at") - 1).cast("int")) == F.col(label)).cast("int")), 9).alias("accuracy"))


def regression_scores(each: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r2 (mean over folds), mse, from rows (keys, fold, truth, pred)."""
    part = each.groupBy(*keys, "fold").agg(F.avg((F.col("truth") - F.col("pred")) ** 2).alias("e"), F.var_pop("truth").alias("v"))
    return part.groupBy(*keys).agg(F.avg(F.when(F.col("v") > 0, 1 - F.col("e") / F.col("v"))).alias("r2"), F.avg("e").alias("mse"))


def fold_standardise(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """(trial, fold, pos, z): values scaled by mean and deviation of the other folds. A feature that is constant there has z 0; a null value stays null.

    Sums are of differences from the feature's overall mean, so that large values lose no digits.
    """
    middle = rows.groupBy("pos").agg(F.avg("value").alias("mid"))
    tagged = rows.join(folds.select("trial", "fold"), "trial").join(middle, "pos").withColumn("value", F.col("value") - F.col("mid"))
    part = tagged.groupBy("fold", "pos").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    whole = part.groupBy("pos").agg(F.sum("n").alias("n0"), F.sum("s").alias("s0"), F.sum("q").alias("q0"))
    n = F.nullif(F.col("n0") - F.col("n"), F.lit(0))
    mean = (F.col("s0") - F.coalesce("s", F.lit(0.0))) / n
    variance = (F.col("q0") - F.coalesce("q", F.lit(0.0))) / n - mean * mean
    fitted = part.join(whole, "pos").select("fold", "pos", mean.alias("mu"), variance.alias("var"), ((F.col("q0") / F.col("n0")) * 1e-12).alias("least"))
    z = F.when(F.col("var") > F.col("least"), (F.col("value") - F.col("mu")) / F.sqrt("var")).when(F.col("value").isNotNull(), 0.0)
    return tagged.join(fitted, ["fold", "pos"]).select("trial", "fold", "pos", z.alias("z"))


def decode(z: DataFrame, labels: DataFrame) -> DataFrame:
    """(perm, trial, fold, label, pred): nearest centroid of the labels of the other folds. Sums only, no rows are gathered."""
    rows = labels.join(z.drop("fold"), "trial")
    part = rows.groupBy("perm", "fold", "label", "pos").agg(F.sum("z").alias("s"), F.count("z").alias("n"))
    whole = part.groupBy("perm", "label", "pos").agg(F.sum("s").alias("s0"), F.sum("n").alias("n0"))
    folds = part.select("perm", "fold").distinct()
    centre = folds.join(whole, "perm").join(part, ["perm", "fold", "label", "pos"], "left")
    n = F.col("n0") - F.coalesce("n", F.lit(0))
    centre = centre.filter(n > 0).select("perm", "fold", F.col("label").alias("class"), "pos", ((F.col("s0") - F.coalesce("s", F.lit(0.0))) / n).alias("c"))
    near = rows.join(centre, ["perm", "fold", "pos"]).groupBy("perm", "trial", "fold", "label", "class").agg(F.sum((F.col("z") - F.col("c")) ** 2).alias("d"))
    return near.groupBy("perm", "trial", "fold", "label").agg(F.min_by("class", F.struct(F.round("d", 6), "class")).alias("pred"))


def empirical_p(scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, observed (perm 0), p: one-sided with one added to count and total."""
    best = scores.filter("perm = 0").select(*keys, F.col(score).alias("observed"))
    both = scores.filter("perm > 0").join(best, keys) if keys else scores.filter("perm > 0").join(F.broadcast(best), F.lit(True))  # best is one row
    return both.groupBy(*keys, "observed").agg(((F.count_if(F.col(score) >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))


def circular_shift(df: DataFrame, keys: list[str], order: str, length: int, seed: int) -> DataFrame:
    """Series moved along a ring of `length` samples by 1 to length - 1, by the md5 of seed and keys."""
    by = F.conv(F.substring(md5_of(F.lit(seed), *(F.col(k) for k in keys)), 1, 8), 16, 10).cast("long") % (length - 1) + 1
    return df.withColumn(order, ((F.col(order) + by) % length).cast("long"))


def one_sample_t(means: DataFrame, keys: list[str], value: str, at_least: int = 3) -> DataFrame:
    """n, mean, sd and t of the group mean against 0; keys with fewer than `at_least` values have no t."""
    got = means.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return got.withColumn("t", F.when((F.col("n") >= at_least) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n"))))


def group_tests(means: DataFrame, keys: list[str], value: str, at_least: int = 3, rank_zeros: bool = False) -> DataFrame:
    """n, mean, sd, t, the signed-rank sum `wilcoxon` of the positive values, and what its tail needs: n_ranked and ties.

    Zeros have no sign: they are left out of the ranks and of n_ranked, and count for n, mean, sd and t. With `rank_zeros` they take the
    lowest ranks before they are left out (Pratt), for which `with_p_values` has no tail. Values of equal size (to 9 places)
    share their ranks; ties is the sum of t^3 - t over their groups of t. Nulls are left out. Keys with fewer than `at_least` values have no
    test, keys with zeros alone have no signed-rank sum.
    """
    rows = means.select(*keys, F.col(value).alias("__v")).filter("__v is not null").withColumn("__size", F.round(F.abs("__v"), 9))
    got = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("__v").alias("mean"), F.stddev_samp("__v").alias("sd"))
    placed = average_ranked(rows if rank_zeros else rows.filter("__size > 0"), keys, "__size", ["__v"], "__rank")
    by_size = placed.groupBy(*keys, "__size").agg(F.count("*").alias("t"), F.sum(F.when(F.col("__v") > 0, F.col("__rank")).otherwise(0.0)).alias("w"))
    signed = by_size.groupBy(*keys).agg(F.sum("t").alias("n_ranked"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("w").alias("w"))
    both = got.join(signed.withColumnsRenamed({k: f"__k{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__k{k}")) for k in keys] or F.lit(True), "left").drop(*(f"__k{k}" for k in keys))
    enough = F.col("n") >= at_least
    t = F.when(enough & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))
    return both.withColumns({"t": t, "wilcoxon": F.when(enough, F.col("w")), "n_ranked": F.coalesce("n_ranked", F.lit(0)), "ties": F.coalesce("ties", F.lit(0))}).drop("w")


def student_tail(t: np.ndarray, df: np.ndarray, steps: int = 400) -> np.ndarray:
    """P(T > t) of Student's distribution, by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    t, df = np.atleast_1d(np.asarray(t, float)), np.atleast_1d(np.asarray(df, float))
    rule = np.where(np.arange(steps + 1) % 2, 4.0, 2.0)
    rule[[0, -1]] = 1.0
    at = np.arange(steps + 1) / steps

    def area(low: np.ndarray) -> np.ndarray:
        angle = low[:, None] + (math.pi / 2 - low)[:, None] * at
        return (np.maximum(np.cos(angle), 0.0) ** (df - 1)[:, None]) @ rule * (math.pi / 2 - low)

    return area(np.arctan(t / np.sqrt(df))) / (2 * area(np.zeros(len(t))))


def signed_rank_table(n: int) -> np.ndarray:
    """P(W >= w) for w = 0, 1, ... of the signed-rank sum of n values without ties, exact."""
    ways = np.ones(1)
    for r in range(1, n + 1):
        longer = np.zeros(len(ways) + r)
        longer[: len(ways)] += ways / 2
        longer[r:] += ways / 2
        ways = longer
    return np.cumsum(ways[::-1])[::-1]


def signed_rank_tail(w: np.ndarray, n: np.ndarray, ties: np.ndarray = 0, exact: int = 50) -> np.ndarray:
    """P(W >= w): exact by one table an n for up to `exact` values without ties, else by the normal law with the variance that ties leave; n = 0 has none."""
    w, n, ties = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, float)) for x in (w, n, ties)))
    sd = np.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    out = np.full(len(w), np.nan)
    able = (n > 0) & ~np.isnan(w)
    z = np.divide(w - n * (n + 1) / 4, sd, out=np.zeros(len(w)), where=able & (sd > 0))
    out[able] = [0.5 * math.erfc(x / math.sqrt(2)) for x in z[able]]
    plain = able & (ties == 0) & (n <= exact)
    for m in np.unique(n[plain]).astype(int):  # at most `exact` tables
        mine = plain & (n == m)
        out[mine] = signed_rank_table(m)[np.ceil(w[mine]).astype(int)]
    return out


def with_p_values(tests: DataFrame) -> DataFrame:
    """The rows of `group_tests` with one-sided p_t and p_wilcoxon, a batch at a time."""

    def p_t(t: pd.Series, n: pd.Series) -> pd.Series:
        there = t.notna().to_numpy()
        out = np.full(len(t), np.nan)
        out[there] = student_tail(t.to_numpy(float)[there], n.to_numpy(float)[there] - 1) if there.any() else 0
        return pd.Series(out).where(there, None).astype("float64")

    def p_w(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(signed_rank_tail(w.to_numpy(float), n.to_numpy(float), ties.to_numpy(float)))

    return tests.withColumn("p_t", F.pandas_udf(p_t, "double")("t", "n")).withColumn("p_wilcoxon", F.pandas_udf(p_w, "double")("wilcoxon", "n_ranked", "ties"))


def autoregression(df: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """Order-1 coefficients of each series: slope, intercept and r2 of a sample on the one before it, met by their places, so that gaps form no pair; a place has one row."""
    before = df.select(*keys, (F.col(order) + 1).alias(order), F.col(value).alias("before"))
    pairs = df.select(*keys, order, value).join(before, [*keys, order])
    return pairs.groupBy(*keys).agg(F.regr_slope(value, "before").alias("slope"), F.regr_intercept(value, "before").alias("intercept"), F.regr_r2(value, "before").alias("r2"), F.count("*").alias("n"))
