"""Cross-validated decoding: shuffled training labels drawn inside the pass over the trials, train-by-test window grids, a choice of classifier, split and score.

A trial is one row (trial, label, fold, x). Nothing is added to it for a shuffle: its label under a permutation follows from its place, as a keyed
bijection of the places of a fold's training trials, and from how many trials of each class each fold has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialgrid.operators.models import _mixed, cross_fit, gram_sums, predict, solve_ridge, two_sided_p
from trialgrid.operators.stats import regression_scores, spearman, stratified_folds, training_shuffles
from trialgrid.operators.summaries import global_place
from trialgrid.sources.work import written

CHUNK, MODEL_BYTES, SORTED, TARGETS = 16, 1 << 27, 1 << 14, 1 << 22


def shuffled_places(place: np.ndarray, size: int, *key: int) -> np.ndarray:
    """Where a permutation of 0 to size - 1, drawn by `key`, takes each place.

    Up to SORTED places are sorted by their hashes; for more, whose order no task holds, a Feistel network over the next power of four is walked
    on until it is inside.
    """
    if size <= SORTED:
        return np.argsort(_mixed(*key, np.arange(size)), kind="stable")[place]
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def turned(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(6):
            left, right = right, left ^ (_mixed(*key, r, right) & mask)
        return left << np.uint64(half) | right

    out = turned(place.astype(np.uint64))
    while (over := out >= size).any():
        out[over] = turned(out[over])
    return out.astype(np.int64)


def placed(trials: DataFrame) -> DataFrame:
    """Stored `trials` (trial, label, fold, ...) with `place`, from 0, in the order of fold, label and trial."""
    order = global_place(trials.select("fold", "label", "trial").distinct(), ["fold", "label", "trial"])
    return written(trials.join(order.select("trial", (F.col("place") - 1).alias("place")), "trial"), "placed")


def class_table(trials: DataFrame) -> tuple[list, list, np.ndarray]:
    """Folds, classes and the number of distinct trials of each (fold, class), from the data."""
    rows = trials.groupBy("fold", "label").agg(F.countDistinct("trial").alias("n")).collect()  # folds x classes
    folds, classes = sorted({r.fold for r in rows}), sorted({r.label for r in rows})
    counts = np.zeros((len(folds), len(classes)), np.int64)
    for r in rows:
        counts[folds.index(r.fold), classes.index(r.label)] = r.n
    return folds, classes, counts


def training_labels(place: np.ndarray, label: np.ndarray, held: int, counts: np.ndarray, perm: int, seed: int) -> np.ndarray:
    """Classes (by number) of training trials of the fold `held`, for perm 0 their own, else shuffled among all training trials."""
    if not perm:
        return label
    size = counts.sum(1)
    before = size[:held].sum()
    own = np.where(place >= before + size[held], place - size[held], place)  # the place among the training trials
    ends = np.cumsum(np.delete(counts, held, 0).ravel())
    return np.searchsorted(ends, shuffled_places(own, int(ends[-1]), seed, held, perm), "right") % counts.shape[1]


def summed_arrays(df: DataFrame, keys: list[str], salts: int = 64) -> DataFrame:
    """keys, s: element by element sums of the arrays `s` of equal length, in two steps so that no group holds the arrays of all tasks."""

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{k: [x] for k, x in zip(part.columns[:-1], key, strict=True)}, "s": [np.sum(np.stack(part.s.to_numpy()), 0)]})

    near = df.withColumn("salt", F.spark_partition_id() % salts).select(*keys, "salt", "s")
    first = near.groupBy(*keys, "salt").applyInPandas(add, near.schema)
    last = first.select(*keys, "s")
    return last.groupBy(*keys).applyInPandas(add, last.schema)


def shuffled_numbers(place: np.ndarray, held: int, counts: np.ndarray, perm: int, seed: int, numbers: np.ndarray) -> np.ndarray:
    """Numbers of training trials of the fold `held`, for perm 0 their own, else shuffled among all training trials; numbers: of all trials by place."""
    if not perm:
        return numbers[place]
    size = counts.sum(1)
    before, own = size[:held].sum(), size[held]
    moved = shuffled_places(np.where(place >= before + own, place - own, place), int(size.sum() - own), seed, held, perm)
    return numbers[np.where(moved >= before, moved + own, moved)]


def fit_shuffled(rows: DataFrame, features: int, table: tuple[list, list, np.ndarray], permutations: int, seed: int, alpha: float = 1.0, variance: float | None = None, numbers: np.ndarray | None = None) -> DataFrame:
    """Stored weights (win, held, first, w) of ridge fits for perm first to first + CHUNK - 1: (1 + features) x perms x targets, row by row.

    rows: win, fold, place, label, x. The targets are one indicator a class, or with `numbers` (of all trials by place) one number. Each task sums the products of
    [1, x] with the targets of all folds and shuffles; a row carries none of them.
    """
    folds, classes, counts = table
    c = len(classes) if numbers is None else 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for win, part in frame.groupby("win"):
                x = np.hstack([np.ones((len(part), 1)), np.nan_to_num(np.stack(part.x.to_numpy()).astype(float))])
                fold, label, place = np.searchsorted(folds, part.fold), np.searchsorted(classes, part.label), part.place.to_numpy(np.int64)
                out = []
                for held in range(len(folds)):
                    train = fold != held
                    if not train.any():
                        continue
                    own = x[train]
                    out.append((held, -1, (own.T @ own).ravel()))
                    for first in range(0, permutations + 1, CHUNK):
                        perms = range(first, min(first + CHUNK, permutations + 1))
                        y = np.zeros((len(own), len(perms), c))
                        for k, perm in enumerate(perms):
                            if numbers is None:
                                y[np.arange(len(own)), k, training_labels(place[train], label[train], held, counts, perm, seed)] = 1
                            else:
                                y[:, k, 0] = shuffled_numbers(place[train], held, counts, perm, seed, numbers)
                        out.append((held, first, (own.T @ y.reshape(len(own), -1)).ravel()))
                yield pd.DataFrame({"win": win, "held": [o[0] for o in out], "first": [o[1] for o in out], "s": [o[2] for o in out]})

    sums = summed_arrays(rows.select("win", "fold", "place", "label", "x").mapInPandas(partial, "win int, held int, first int, s array<double>"), ["win", "held", "first"])

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("first")
        gram, rest = part.s.iloc[0].reshape(features + 1, -1), [s.reshape(features + 1, -1) for s in part.s.iloc[1:]]
        w = solve_ridge(np.hstack([gram, *rest]), features, alpha, variance)
        cuts = np.cumsum([r.shape[1] for r in rest])[:-1]
        return pd.DataFrame({"win": key[0], "held": key[1], "first": part["first"].iloc[1:], "w": [x.ravel() for x in np.split(w, cuts, axis=1)]})

    return written(sums.groupBy("win", "held").applyInPandas(fit, "win int, held int, first int, w array<double>"), "weights")  # features x perms x classes


def score_shuffled(rows: DataFrame, weights: DataFrame, features: int, table: tuple[list, list, np.ndarray], permutations: int, across: bool = False) -> DataFrame:
    """(train, test, fold, perm, n, hits) of held-out trials by the class of the largest prediction, the first on ties, against their true labels.

    Weights of a window score its own trials, with `across` those of every window. As many weights go along with a pass as MODEL_BYTES hold; more permutations take more passes.
    """
    folds, classes, _ = table
    wins, c = weights.select("win").distinct().count(), len(classes)
    step = max(1, MODEL_BYTES // max(1, wins * len(folds) * (features + 1) * CHUNK * c * 8)) * CHUNK
    done = None
    for at in range(0, permutations + 1, step):
        part = weights.filter(F.col("first").between(at, at + step - 1)).collect()  # at most MODEL_BYTES, or one chunk of permutations
        model = {}
        for r in part:
            model.setdefault(folds[r.held], []).append((r.win, r.first, np.asarray(r.w).reshape(features + 1, -1, c)))

        def run(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for (win, fold), own in frame.groupby(["win", "fold"]):
                    x = np.hstack([np.ones((len(own), 1)), np.nan_to_num(np.stack(own.x.to_numpy()).astype(float))])
                    label = np.searchsorted(classes, own.label)
                    for train, first, w in model.get(fold, []):
                        if across or train == win:
                            pred = np.tensordot(x, w, 1).argmax(2)
                            hits = (pred == label[:, None]).sum(0)
                            yield pd.DataFrame({"train": train, "test": win, "fold": fold, "perm": np.arange(first, first + len(hits)), "n": len(own), "hits": hits})

        got = rows.select("win", "fold", "label", "x").mapInPandas(run, f"train int, test int, fold {rows.schema['fold'].dataType.simpleString()}, perm int, n bigint, hits bigint")
        done = got if done is None else done.unionByName(got)
    return done.groupBy("train", "test", "fold", "perm").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def mean_accuracy(scored: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, perm, accuracy: the mean of the folds' accuracies."""
    return scored.groupBy(*keys, "perm").agg(F.round(F.avg(F.col("hits") / F.col("n")), 9).alias("accuracy"))


def decode_shuffled(trials: DataFrame, features: int, permutations: int, seed: int, alpha: float = 1.0, variance: float | None = None) -> DataFrame:
    """(perm, accuracy) of trials (trial, label, fold, x): perm 0 as observed, the others with the labels of each fold's training trials shuffled."""
    rows = placed(trials).withColumn("win", F.lit(0))
    table = class_table(rows)
    return mean_accuracy(score_shuffled(rows, fit_shuffled(rows, features, table, permutations, seed, alpha, variance), features, table, permutations))


def numbers_by_place(rows: DataFrame, number: str, most: int) -> np.ndarray:
    """`number` of all trials in the order of `place`; more than `most` trials are an error."""
    n = rows.select("place").distinct().count()
    if n > most:
        raise ValueError(f"{n} trials, more than {most}: raise it if the tasks have 8 bytes a trial")
    out = np.zeros(n)
    for r in rows.select("place", F.col(number).cast("double").alias("v")).toLocalIterator():
        out[r.place] = r.v
    return out


def predict_shuffled(trials: DataFrame, features: int, permutations: int, seed: int, alpha: float = 1.0, variance: float | None = None, most_targets: int = TARGETS) -> DataFrame:
    """(perm, r2, mse) of a ridge on the number t of trials (trial, fold, t, x): means over folds, perm 0 as observed, the others with the numbers of each fold's training trials shuffled.

    The numbers, 8 bytes a trial, go to every task; of more than `most_targets` trials each row carries its own shuffles (`training_shuffles`), drawn otherwise
    but from the same law. Folds are numbered from 0. A fold whose numbers are all alike has no r2.
    """
    if trials.select("trial").distinct().count() > most_targets:
        folds = trials.agg(F.max("fold")).first()[0] + 1
        wide = training_shuffles(trials, folds, F.col("t").cast("double"), permutations, seed, "predict")
        got = predict(wide, cross_fit(wide, [], features, permutations + 1, alpha, variance, blocks=folds), [], features, permutations + 1)
        return regression_scores(got.select("fold", F.col("t").cast("double").alias("truth"), F.posexplode("pred").alias("perm", "pred")), ["perm"])
    rows = placed(trials.withColumn("label", F.lit(0))).withColumn("win", F.lit(0))
    table, numbers = class_table(rows), numbers_by_place(rows, "t", most_targets)
    weights = fit_shuffled(rows, features, table, permutations, seed, alpha, variance, numbers)
    step = max(1, MODEL_BYTES // max(1, len(table[0]) * (features + 1) * CHUNK * 8)) * CHUNK
    done = None
    for at in range(0, permutations + 1, step):
        model: dict = {}
        for r in weights.filter(F.col("first").between(at, at + step - 1)).collect():  # at most MODEL_BYTES, or one chunk of permutations
            model.setdefault(table[0][r.held], []).append((r.first, np.asarray(r.w).reshape(features + 1, -1)))

        def run(frames: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for fold, own in frame.groupby("fold"):
                    x = np.hstack([np.ones((len(own), 1)), np.nan_to_num(np.stack(own.x.to_numpy()).astype(float))])
                    t = own.t.to_numpy(float)
                    for first, w in model.get(fold, []):
                        error = ((x @ w - t[:, None]) ** 2).sum(0)
                        yield pd.DataFrame({"fold": fold, "perm": np.arange(first, first + len(error)), "n": len(t), "e": error, "s": t.sum(), "q": (t**2).sum()})

        got = rows.select("fold", F.col("t").cast("double").alias("t"), "x").mapInPandas(run, f"fold {rows.schema['fold'].dataType.simpleString()}, perm int, n bigint, e double, s double, q double")
        done = got if done is None else done.unionByName(got)
    part = done.groupBy("perm", "fold").agg(*(F.sum(c).alias(c) for c in ("n", "e", "s", "q")))
    spread = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2
    r2 = F.when(spread > 1e-12 * F.col("q") / F.col("n"), 1 - F.col("e") / F.col("n") / spread)
    return part.groupBy("perm").agg(F.avg(r2).alias("r2"), F.avg(F.col("e") / F.col("n")).alias("mse"))


def window_features(trials: DataFrame, channels: int, samples: int, size: int, step: int) -> DataFrame:
    """`trials` for each window `win` [win * step, win * step + size) of x (channels x samples, row by row), with x cut to it."""
    start = F.col("win") * step
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice("x", c * samples + start + 1, F.lit(size))))
    return trials.withColumn("win", F.explode(F.sequence(F.lit(0), F.lit((samples - size) // step)))).withColumn("x", cut)


def generalisation(trials: DataFrame, channels: int, samples: int, size: int, step: int, permutations: int, seed: int, alpha: float = 1.0, variance: float | None = None) -> DataFrame:
    """(train, test, perm, accuracy): fitted in one window, scored in another, for all pairs of windows; perm 0 as observed."""
    rows = window_features(placed(trials), channels, samples, size, step)
    table = class_table(trials)
    weights = fit_shuffled(rows, channels * size, table, permutations, seed, alpha, variance)
    return mean_accuracy(score_shuffled(rows, weights, channels * size, table, permutations, across=True), ["train", "test"])


# --- nearest centroids ---


def centroid_hits(z: DataFrame, labels: DataFrame, features: int | None = None) -> DataFrame:
    """(perm, n, hits): trials whose nearest centroid, of the labels of the other folds, has the trial's own label in that perm; the smallest label on ties (to 6 places).

    z: trial, fold, pos (0 to features - 1; without that number as many as there are), z, no nulls. labels: perm (from 0, all numbers), trial, label. A trial is one row with its features and its labels of
    all perms; each task adds up class sums for all perms at once, and these, perms x classes x features a fold, go along with the second pass.
    """
    x = z.groupBy("trial", "fold").agg(F.array_sort(F.collect_list(F.struct("pos", "z"))).alias("x"))  # `features` entries
    y = labels.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("perm", "label"))).alias("y"))  # as many as perms
    rows = written(x.join(y, "trial").select("fold", F.transform("x", lambda v: v["z"]).alias("x"), F.transform("y", lambda v: v["label"]).alias("y")), "centroids")
    classes = [r.label for r in labels.filter("perm = 0").select("label").distinct().orderBy("label").collect()]
    perms, found = (n or 0 for n in rows.agg(F.max(F.size("y")), F.max(F.size("x"))).first())
    features = features or found
    c = len(classes)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fold, own in frame.groupby("fold"):
                m = np.hstack([np.stack(own.x.to_numpy()), np.ones((len(own), 1))])
                label = np.searchsorted(classes, np.stack(own.y.to_numpy()))
                for first in range(0, perms, CHUNK):
                    part = label[:, first : first + CHUNK]
                    on = (part[:, :, None] == np.arange(c)).astype(float).reshape(len(own), -1)
                    yield pd.DataFrame({"fold": [fold], "first": [first], "s": [(on.T @ m).ravel()]})

    kind = rows.schema["fold"].dataType.simpleString()
    sums = written(summed_arrays(rows.mapInPandas(partial, f"fold {kind}, first int, s array<double>"), ["fold", "first"]), "class-sums")
    folds = [r.fold for r in sums.select("fold").distinct().orderBy("fold").collect()]
    step = max(1, MODEL_BYTES // max(1, len(folds) * CHUNK * c * (features + 1) * 8)) * CHUNK
    done = None
    for at in range(0, perms, step):
        parts: dict = {}
        for r in sums.filter(F.col("first").between(at, at + step - 1)).collect():  # at most MODEL_BYTES, or one chunk of perms
            parts.setdefault(r["first"], {})[r.fold] = np.asarray(r.s).reshape(-1, c, features + 1)

        def run(frames: Iterator[pd.DataFrame], parts=parts) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for fold, own in frame.groupby("fold"):
                    m = np.stack(own.x.to_numpy())
                    label = np.searchsorted(classes, np.stack(own.y.to_numpy()))
                    for first, by_fold in parts.items():
                        s = sum(v for k, v in by_fold.items() if k != fold)
                        if not isinstance(s, np.ndarray):
                            continue
                        centre = s[:, :, :-1] / np.where(s[:, :, -1:] > 0.5, s[:, :, -1:], np.nan)
                        for low in range(0, len(m), 256):
                            far = np.round(((m[low : low + 256, None, None] - centre) ** 2).sum(3), 6)
                            best = np.where(np.isnan(far), np.inf, far).argmin(2)
                            yield pd.DataFrame({"perm": np.arange(first, first + len(s)), "n": len(best), "hits": (best == label[low : low + 256, first : first + len(s)]).sum(0)})

        got = rows.mapInPandas(run, "perm int, n bigint, hits bigint")
        done = got if done is None else done.unionByName(got)
    return done.groupBy("perm").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


# --- encoding of one channel at a time ---


def scaled_channels(trials: DataFrame, channels: int, samples: int) -> DataFrame:
    """`trials` for each channel from 0, with x (channels x samples, row by row) cut to it: nulls and NaN are 0, then each feature is scaled over all trials; a constant one is 0."""
    cut = F.slice("x", F.col("channel") * samples + 1, F.lit(samples))
    rows = trials.withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    rows = rows.withColumn("x", F.transform(cut, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0))))
    each = rows.select("channel", F.posexplode("x").alias("pos", "v")).groupBy("channel", "pos").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    level = each.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("level"))  # samples entries
    scale = F.zip_with("x", "level", lambda v, l: F.when(l["sd"] > 1e-12 * F.greatest(F.abs(l["mu"]), F.lit(1.0)), (v - l["mu"]) / l["sd"]).otherwise(0.0))
    return rows.join(level, "channel").withColumn("x", scale).drop("level")


def encode(trials: DataFrame, channels: int, samples: int, permutations: int, seed: int, alpha: float = 1.0, most_targets: int = TARGETS) -> DataFrame:
    """(channel, observed, p): ridge of a trial's number t on one channel's samples, out of fold; rank correlation of predictions and t, two-sided p.

    trials: trial, fold, t, x. Features are scaled on all trials, not by fold. A shuffle is of all trials, drawn by seed + channel, and its predictions
    are held against the shuffled numbers. The numbers by place, 8 bytes a trial, go to every task; a table of more than `most_targets` trials is an error.
    """
    order = global_place(trials.select("trial").distinct(), ["trial"])
    one = trials.join(order.select("trial", (F.col("place") - 1).alias("place")), "trial")
    one = written(one, "encode")
    t = numbers_by_place(one, "t", most_targets)
    n = len(t)

    def drawn(frame: pd.DataFrame) -> np.ndarray:
        """Rows x (1 + permutations) of t and its shuffles."""
        out = np.zeros((len(frame), permutations + 1))
        for channel, at in frame.groupby("channel").indices.items():
            place = frame.place.to_numpy(np.int64)[at]
            out[at, 0] = t[place]
            for perm in range(1, permutations + 1):
                out[at, perm] = t[shuffled_places(place, n, seed + int(channel), perm)]
        return out

    rows = written(scaled_channels(one.select("trial", F.col("fold").cast("int").alias("fold"), "place", "x"), channels, samples), "channels")
    width, targets = samples + 1, permutations + 1
    sums = gram_sums(rows.select("channel", "fold", "place", "x"), ["channel", "fold"], samples, drawn)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        folds = sorted(part.fold.unique())
        s = np.zeros((len(folds), width, width + targets))
        s[np.searchsorted(folds, part.fold), part.i, part.j] = part.v
        w = [solve_ridge(s.sum(0) - s[i], samples, alpha, None, scale=False).ravel() if len(folds) > 1 else None for i in range(len(folds))]
        return pd.DataFrame({"channel": key[0], "fold": folds, "w": w})

    fitted = sums.groupBy("channel").applyInPandas(fit, "channel int, fold int, w array<double>")  # folds x samples x permutations a channel

    def predicted_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            truth = drawn(frame)
            for (channel, _), at in frame.groupby(["channel", "fold"]).indices.items():
                own = frame.iloc[at]
                w = np.asarray(own.w.iloc[0]).reshape(width, targets)
                pred = np.hstack([np.ones((len(own), 1)), np.stack(own.x.to_numpy()).astype(float)]) @ w
                yield pd.DataFrame({"channel": channel, "perm": np.tile(np.arange(targets), len(own)), "pred": pred.ravel(), "truth": truth[at].ravel()})

    each = rows.join(fitted.filter("w is not null"), ["channel", "fold"]).select("channel", "fold", "place", "x", "w").mapInPandas(predicted_, "channel int, perm int, pred double, truth double")
    return two_sided_p(spearman(written(each.withColumn("pred", F.round("pred", 12)), "predictions"), ["channel", "perm"], "pred", "truth"), ["channel"], "rho")


# --- choice of classifier, split and score ---


def ridge_classifier(rows: DataFrame, features: int, table: tuple[list, list, np.ndarray], alpha: float = 1.0, variance: float | None = None) -> dict:
    """Weights by held-out fold, (1 + features) x classes."""
    fitted = fit_shuffled(rows.withColumn("win", F.lit(0)).withColumn("place", F.lit(0)), features, table, 0, 0, alpha, variance)
    return {table[0][r.held]: np.asarray(r.w).reshape(features + 1, -1) for r in fitted.collect()}  # folds x features x classes


def linear_svm(rows: DataFrame, features: int, table: tuple[list, list, np.ndarray], cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-6) -> dict:
    """Weights by held-out fold of one-against-rest support vector machines: w.w / 2 + cost * sum of max(0, 1 - y (w.x + b))^2, the offset b among w, x standardised.

    Newton's method: each round is one pass that adds up, for every held-out fold and class, the gradient and the matrix of the rows inside the
    margin. Only these sums, features squared, reach the driver; a step that does not lower the loss is halved.
    """
    folds, classes, _ = table
    f, c, width = len(folds), len(classes), features + 1
    rows = rows.select("fold", "label", "x")

    def passed(run, length: int) -> np.ndarray:
        """Sum over all rows of what `run` gives for a frame, one array of `length` a held-out fold and class."""

        def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    x = np.hstack([np.ones((len(frame), 1)), np.nan_to_num(np.stack(frame.x.to_numpy()).astype(float))])
                    got = run(x, np.searchsorted(folds, frame.fold), np.searchsorted(classes, frame.label))
                    yield pd.DataFrame({"held": [h for h, _, _ in got], "cls": [k for _, k, _ in got], "s": [s for *_, s in got]})

        out = np.zeros((f, c, length))
        for r in summed_arrays(rows.mapInPandas(partial, "held int, cls int, s array<double>"), ["held", "cls"]).collect():
            out[r.held, r.cls] = r.s
        return out

    def moments(x, fold, label):
        return [(h, 0, np.r_[(fold != h).sum(), x[fold != h].sum(0), (x[fold != h] ** 2).sum(0)]) for h in range(f)]

    got = passed(moments, 1 + 2 * width)[:, 0]
    n = np.maximum(got[:, :1], 1)
    mean = got[:, 1 : width + 1] / n
    sd = np.sqrt(np.maximum(got[:, width + 1 :] / n - mean**2, 0))
    mean[:, 0], sd[:, 0] = 0, 1
    scale = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1), sd, np.inf)

    def losses(w):
        def run(x, fold, label):
            out = []
            for h in range(f):
                z = (x[fold != h] - mean[h]) / scale[h]
                for k in range(c):
                    y = np.where(label[fold != h] == k, 1.0, -1.0)
                    left = 1 - y * (z @ w[h, k])
                    on = left > 0
                    zo = z[on]
                    out.append((h, k, np.r_[(left[on] ** 2).sum(), zo.T @ (y[on] * left[on]), (zo.T @ zo).ravel()]))
            return out

        return passed(run, 1 + width + width * width)

    w, best, old = np.zeros((f, c, width)), np.full((f, c), np.inf), np.zeros((f, c, width))
    for _ in range(rounds):
        sums = losses(w)
        loss = (w**2).sum(2) / 2 + cost * sums[:, :, 0]
        worse = loss > best * (1 + 1e-12)
        moved = 0.0
        for h in range(f):
            for k in range(c):
                if worse[h, k]:
                    w[h, k] = (w[h, k] + old[h, k]) / 2
                    moved = np.inf
                    continue
                best[h, k], old[h, k] = loss[h, k], w[h, k].copy()
                gradient = w[h, k] - 2 * cost * sums[h, k, 1 : width + 1]
                matrix = np.eye(width) + 2 * cost * sums[h, k, width + 1 :].reshape(width, width)
                step = np.linalg.solve(matrix, gradient)
                w[h, k] -= step
                moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    plain = old / scale[:, None]
    plain[:, :, 0] -= (plain[:, :, 1:] * mean[:, None, 1:]).sum(2)
    return {folds[h]: plain[h].T for h in range(f)}


def predicted(rows: DataFrame, weights: dict, table: tuple[list, list, np.ndarray]) -> DataFrame:
    """(trial, fold, label, pred) of held-out trials."""
    classes = table[1]
    kind = rows.schema["label"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fold, own in frame.groupby("fold"):
                x = np.hstack([np.ones((len(own), 1)), np.nan_to_num(np.stack(own.x.to_numpy()).astype(float))])
                best = (x @ weights[fold]).argmax(1)
                yield pd.DataFrame({"trial": own.trial, "fold": fold, "label": own.label, "pred": [classes[b] for b in best]})

    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("trial", "fold", "label"))
    return rows.select("trial", "fold", "label", "x").mapInPandas(run, f"{schema}, pred {kind}")


def accuracy(pred: DataFrame) -> DataFrame:
    """fold, score: share of trials with the right class."""
    return pred.groupBy("fold").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("score"))


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    """fold, score: the mean over classes of the share of their trials with the right class."""
    each = pred.groupBy("fold", "label").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("recall"))
    return each.groupBy("fold").agg(F.avg("recall").alias("score"))


def cross_validate(trials: DataFrame, features: int, classifier: Callable = ridge_classifier, split: Callable | None = None, score: Callable = accuracy) -> DataFrame:
    """(fold, score) of trials (trial, label, x), out of fold.

    classifier(rows, features, table): weights by held-out fold, as `ridge_classifier` and `linear_svm` give them. split(trials): (trial, fold), five
    stratified folds by default. score(predictions): a row a fold, as `accuracy` and `balanced_accuracy` give them.
    """
    folds = (split or (lambda t: stratified_folds(t, 5)))(trials).select("trial", F.col("fold").cast("int").alias("fold"))
    rows = written(trials.select("trial", "label", "x").join(folds, "trial"), "folded")
    table = class_table(rows)
    return score(predicted(rows, classifier(rows, features, table), table))
