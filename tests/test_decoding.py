"""Shuffles drawn in the pass, window grids, classifiers, unpaired clusters and windowed connectivity, each against a direct computation."""

from collections import Counter

import numpy as np
import pytest

from trialgrid.operators import decoding as dc
from trialgrid.operators import models as md
from trialgrid.operators import stats as st


def made(spark, rng, n=90, features=6, classes=("a", "b", "c"), shift=1.5):
    label = rng.randint(0, len(classes), n)
    x = rng.normal(size=(n, features)) + shift * np.eye(len(classes), features)[label]
    fold = np.arange(n) % 4
    rows = [(i, classes[k], int(f), [float(v) for v in row]) for i, (k, f, row) in enumerate(zip(label, fold, x, strict=True))]
    return spark.createDataFrame(rows, "trial int, label string, fold int, x array<double>"), label, fold, x


@pytest.mark.parametrize("in_order", [True, False])
def test_places_are_permuted(monkeypatch, in_order):
    if not in_order:
        monkeypatch.setattr(dc, "SORTED", 0)
    for size in (1, 2, 3, 17, 64, 65, 1000, 20_000):
        got = {tuple(dc.shuffled_places(np.arange(size), size, 1, perm)) for perm in range(30)}
        assert all(sorted(g) == list(range(size)) for g in got)
        assert len(got) >= min(30, size) // 2 or size < 3
    # every place goes everywhere alike
    n = 5 if in_order else 300
    hits = np.zeros((n, n))
    for perm in range(5000):
        hits[np.arange(n), dc.shuffled_places(np.arange(n), n, 7, perm)] += 1
    coarse = hits if in_order else hits.reshape(5, 60, 5, 60).sum((1, 3))
    assert abs(coarse / coarse.mean() - 1).max() < 0.15


def test_shuffled_labels_keep_the_training_counts():
    rng = np.random.RandomState(1)
    counts = rng.randint(0, 9, (4, 3))
    place = np.arange(counts.sum())
    fold = np.repeat(np.arange(4), counts.sum(1))
    label = np.concatenate([np.repeat(np.arange(3), c) for c in counts])
    for held in range(4):
        train = fold != held
        seen = set()
        for perm in range(1, 6):
            got = dc.training_labels(place[train], label[train], held, counts, perm, 3)
            assert Counter(got) == Counter(label[train])
            seen.add(tuple(got))
        assert len(seen) == 5
        assert (dc.training_labels(place[train], label[train], held, counts, 0, 3) == label[train]).all()


def direct(x, y, train, alpha, variance, classes):
    s = np.hstack([np.ones((train.sum(), 1)), x[train]])
    return md.solve_ridge(s.T @ np.hstack([s, np.eye(classes)[y]]), x.shape[1], alpha, variance)


def test_shuffled_fits_match_direct_ones(spark):
    rng = np.random.RandomState(2)
    trials, label, fold, x = made(spark, rng)
    rows = dc.placed(trials).withColumn("win", dc.F.lit(0))
    table = dc.class_table(rows)
    assert table[:2] == ([0, 1, 2, 3], ["a", "b", "c"])
    place = {r.trial: r.place for r in rows.collect()}
    place = np.array([place[i] for i in range(len(label))])
    assert sorted(place) == list(range(len(label)))
    weights = {(r.held, r.first): np.array(r.w).reshape(7, -1, 3) for r in dc.fit_shuffled(rows, 6, table, 20, 5, 1.0, 0.9).collect()}
    hits = Counter()
    for held in range(4):
        train = fold != held
        for perm in range(21):
            y = dc.training_labels(place[train], label[train], held, table[2], perm, 5)
            w = direct(x, y, train, 1.0, 0.9, 3)
            assert np.allclose(weights[held, perm // dc.CHUNK * dc.CHUNK][:, perm % dc.CHUNK], w)
            pred = (np.hstack([np.ones(((~train).sum(), 1)), x[~train]]) @ w).argmax(1)
            hits[held, perm] = (pred == label[~train]).mean()
    got = {r.perm: r.accuracy for r in dc.decode_shuffled(trials, 6, 20, 5, 1.0, 0.9).collect()}
    assert got == {perm: pytest.approx(np.mean([hits[h, perm] for h in range(4)]), abs=1e-8) for perm in range(21)}
    assert got[0] > max(v for k, v in got.items() if k)
    assert "y" not in rows.columns and len(rows.columns) == 6  # nothing of the shuffles is in a row


def test_shuffled_numbers_match_direct_fits(spark):
    rng = np.random.RandomState(13)
    n = 70
    x = rng.normal(size=(n, 5))
    t = x[:, 0] * 2 + rng.normal(size=n)
    fold = rng.permutation(n) % 4
    df = spark.createDataFrame([(i, int(fold[i]), float(t[i]), [float(v) for v in x[i]]) for i in range(n)], "trial int, fold int, t double, x array<double>")
    got = {r.perm: r for r in dc.predict_shuffled(df, 5, 20, 3, 1.5, 0.9).collect()}
    place = np.empty(n, int)
    place[np.lexsort((np.arange(n), fold))] = np.arange(n)
    numbers = np.empty(n)
    numbers[place] = t
    counts = np.bincount(fold)[:, None]
    for perm in range(21):
        r2, mse = [], []
        for h in range(4):
            train = fold != h
            y = dc.shuffled_numbers(place[train], h, counts, perm, 3, numbers)
            assert sorted(y) == sorted(t[train]) and (perm or (y == t[train]).all())
            m = np.hstack([np.ones((train.sum(), 1)), x[train], y[:, None]])
            w = md.solve_ridge(m[:, :6].T @ m, 5, 1.5, 0.9)[:, 0]
            e = ((np.hstack([np.ones(((~train).sum(), 1)), x[~train]]) @ w - t[~train]) ** 2).mean()
            r2.append(1 - e / t[~train].var())
            mse.append(e)
        assert got[perm].r2 == pytest.approx(np.mean(r2), abs=1e-6) and got[perm].mse == pytest.approx(np.mean(mse), rel=1e-6)
    assert got[0].r2 > 0.5 > max(r.r2 for p, r in got.items() if p)
    wide = {r.perm: r for r in dc.predict_shuffled(df, 5, 20, 3, 1.5, 0.9, most_targets=10).collect()}
    assert len(wide) == 21 and wide[0].r2 == pytest.approx(got[0].r2, abs=1e-6) and max(r.r2 for p, r in wide.items() if p) < 0.5


def test_weights_in_several_passes(spark, monkeypatch):
    trials, *_ = made(spark, np.random.RandomState(3))
    want = sorted(map(tuple, dc.decode_shuffled(trials, 6, 40, 5).collect()))
    monkeypatch.setattr(dc, "MODEL_BYTES", 1)
    assert sorted(map(tuple, dc.decode_shuffled(trials, 6, 40, 5).collect())) == want


def test_centroids_match_direct_distances(spark):
    """Also a class that one fold alone has, and labels that no centroid of the other folds stands for."""
    rng = np.random.RandomState(14)
    n, f = 40, 3
    x, fold = rng.normal(size=(n, f)), np.arange(n) % 4
    label = np.where(fold == 3, np.where(np.arange(n) < 20, 7, 2), np.where(np.arange(n) % 3 == 0, 2, 5))
    perms = np.array([label, *(rng.permutation(label) for _ in range(18))])
    z = spark.createDataFrame([(i, int(fold[i]), p, float(x[i, p])) for i in range(n) for p in range(f)], "trial int, fold int, pos int, z double")
    labels = spark.createDataFrame([(k, i, int(v)) for k, row in enumerate(perms) for i, v in enumerate(row)], "perm int, trial int, label int")
    want = {}
    for k, y in enumerate(perms):
        hits = 0
        for i in range(n):
            other = fold != fold[i]
            far = {c: round(float(((x[i] - x[other & (y == c)].mean(0)) ** 2).sum()), 6) for c in sorted(set(y[other]))}
            hits += min(far, key=far.get) == y[i]
        want[k] = (n, hits)
    assert {r.perm: (r.n, r.hits) for r in dc.centroid_hits(z, labels, f).collect()} == want


def test_generalisation_over_windows(spark):
    """A class difference that stands on one channel early and on another late: windows generalise within a half, not across."""
    rng = np.random.RandomState(4)
    label = np.arange(120) % 2
    x = rng.normal(size=(120, 3, 12))
    x[:, 0, :6] += 2 * (2 * label - 1)[:, None]
    x[:, 1, 6:] += 2 * (2 * label - 1)[:, None]
    trials = spark.createDataFrame([(i, int(label[i]), i // 2 % 5, [float(v) for v in x[i].ravel()]) for i in range(120)], "trial int, label int, fold int, x array<double>")
    got = {(r.train, r.test, r.perm): r.accuracy for r in dc.generalisation(trials, 3, 12, 3, 3, 19, 1).collect()}
    assert len(got) == 16 * 20
    observed = np.array([[got[a, b, 0] for b in range(4)] for a in range(4)])
    assert observed[:2, :2].min() > 0.9 and observed[2:, 2:].min() > 0.9 and observed[:2, 2:].max() < 0.75 and observed[2:, :2].max() < 0.75
    null = np.array([[[got[a, b, p] for p in range(1, 20)] for b in range(4)] for a in range(4)])
    assert abs(null.mean() - 0.5) < 0.06
    # a window by itself, fitted by hand
    w = x[:, :, 3:6].reshape(120, -1)
    fold, right = np.arange(120) // 2 % 5, []
    for held in range(5):
        c = direct(w, label[fold != held], fold != held, 1.0, None, 2)
        right.append(((np.hstack([np.ones((24, 1)), x[fold == held][:, :, 9:12].reshape(24, -1)]) @ c).argmax(1) == label[fold == held]).mean())
    assert observed[1, 3] == pytest.approx(np.mean(right), abs=1e-8)


def svm_by_descent(x, y, cost, steps=20_000):
    z = np.hstack([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(z.shape[1])
    rate = 1 / (1 + 2 * cost * np.linalg.eigvalsh(z.T @ z)[-1])
    for _ in range(steps):
        left = np.maximum(1 - y * (z @ w), 0)
        w -= rate * (w - 2 * cost * z.T @ (y * left))
    return z @ w


def test_support_vectors_match_descent(spark):
    rng = np.random.RandomState(5)
    trials, label, fold, x = made(spark, rng, n=80, features=4, shift=1.0)
    table = dc.class_table(trials)
    weights = dc.linear_svm(trials, 4, table, cost=0.5)
    train = fold != 1
    for k in range(3):
        got = np.hstack([np.ones((train.sum(), 1)), x[train]]) @ weights[1][:, k]
        assert np.allclose(got, svm_by_descent(x[train], np.where(label[train] == k, 1.0, -1.0), 0.5), atol=1e-5)


@pytest.mark.parametrize("classifier", [dc.ridge_classifier, dc.linear_svm])
def test_choice_of_classifier_split_and_score(spark, classifier):
    trials, label, *_ = made(spark, np.random.RandomState(6), n=150, shift=3.0)
    trials = trials.drop("fold")
    for split in (None, lambda t: st.shuffled_folds(t, 3, 1)):
        for score in (dc.accuracy, dc.balanced_accuracy):
            got = dc.cross_validate(trials, 6, classifier, split, score).collect()
            assert len(got) == (3 if split else 5) and all(r.score > 0.85 for r in got)


def test_scores_differ_where_classes_do(spark):
    pred = spark.createDataFrame([(i, 0, "a" if i < 9 else "b", "a") for i in range(10)], "trial int, fold int, label string, pred string")
    assert dc.accuracy(pred).first().score == 0.9 and dc.balanced_accuracy(pred).first().score == 0.5


# --- unpaired clusters ---


def test_unpaired_shuffles_keep_the_size(spark):
    units = spark.createDataFrame([(k, u, u < (4 if k == "x" else 7)) for k in "xy" for u in range(12)], "k string, u int, g boolean")
    rows = st.group_bits(units, ["k"], "u", "g", 9, 3).collect()
    for k, size in (("x", 4), ("y", 7)):
        bits = np.array([r.bits for r in sorted((r for r in rows if r.k == k), key=lambda r: r.u)])
        assert (bits.sum(0) == size).all() and bits.shape == (12, 10) and list(bits[:, 0]) == [1] * size + [0] * (12 - size)
        assert len({tuple(c) for c in bits.T}) > 5


def test_unpaired_differences_match_direct_means(spark):
    rng = np.random.RandomState(7)
    rows = [("r", u, u < 5, s, float(rng.normal())) for u in range(14) for s in range(20) if rng.uniform() < 0.8] + [("r", 2, True, 3, None)]
    df = spark.createDataFrame(rows, "k string, u int, g boolean, s int, v double")
    bits = {r.u: r.bits for r in st.group_bits(df, ["k"], "u", "g", 6, 1).collect()}
    got = {(r.perm, r.s): r.stat for r in md.shuffled_differences(df, ["k"], "u", "g", "s", "v", 6, 1).collect()}
    for perm in range(7):
        for s in range(20):
            mine = [(bits[u][perm], v) for _, u, _, at, v in rows if at == s and v is not None]
            on, off = [v for b, v in mine if b], [v for b, v in mine if not b]
            if on and off:
                assert got[perm, s] == pytest.approx(np.mean(on) - np.mean(off), abs=1e-8)
            else:
                assert (perm, s) not in got


def test_unpaired_clusters_find_the_planted_run(spark):
    rng = np.random.RandomState(8)
    rows = [(k, u, u < 9, s, float(rng.normal() + 2.5 * (k == "yes" and u < 9 and 10 <= s < 19))) for k in ("yes", "no") for u in range(30) for s in range(40)]
    df = spark.createDataFrame(rows, "k string, u int, g boolean, s int, v double")
    got = md.two_sample_clusters(df, ["k"], "u", "g", "s", "v", 199, 2).collect()
    assert {r.s for r in got if r.k == "yes" and r.mask} >= set(range(10, 19)) and len([r for r in got if r.k == "yes" and r.mask]) <= 11
    assert len([r for r in got if r.k == "no" and r.mask]) <= 2 and len(got) == 80
    for r in got:
        assert not r.mask or (r.pval < 0.05 and r.cluster_p < 0.05)


# --- windows of connectivity ---


def series_of(rng, trials, samples):
    """Three channels; the first drives the second one sample later in the first half, the third drives the second in the second half."""
    x = rng.normal(size=(trials, 3, samples))
    for t in range(1, samples):
        x[:, 1, t] += 0.8 * x[:, 0 if t < samples // 2 else 2, t - 1]
    return x


def frame(spark, x):
    return spark.createDataFrame([("k", f"u{i}", [float(v) for v in m.ravel()]) for i, m in enumerate(x)], "key string, u string, m array<double>").repartition(3)


@pytest.mark.parametrize("order, size, step", [(1, 10, 5), (2, 12, 5), (3, 11, 1), (2, 40, 7)])
def test_windows_match_direct_fits(spark, order, size, step):
    x = series_of(np.random.RandomState(9), 15, 40)
    got = md.windowed_autoregression(frame(spark, x), ["key"], "u", 3, order, size, step).collect()
    starts = list(range(0, 40 - size + 1, step))
    assert sorted((r.win, r.start, r.stop, r.n) for r in got) == [(i, s, s + size, 15 * (size - order)) for i, s in enumerate(starts)]
    for r in got:
        part = x[:, :, r.start : r.stop]
        past = np.concatenate([part[:, :, order - k - 1 : size - k - 1] for k in range(order)], 1).transpose(1, 0, 2).reshape(3 * order, -1)
        now = part[:, :, order:].transpose(1, 0, 2).reshape(3, -1)
        coef = np.linalg.lstsq(past.T, now.T, rcond=None)[0].T
        left = now - coef @ past
        assert np.allclose(np.array(r.coef).reshape(3, -1), coef, atol=1e-6)
        assert np.allclose(np.array(r.rescov).reshape(3, 3), left @ left.T / left.shape[1], atol=1e-6)


def test_shifts_stay_within_the_window(spark):
    x = series_of(np.random.RandomState(10), 4, 20)
    got = {(r.win, r.perm): np.array(r.coef).reshape(3, -1) for r in md.windowed_autoregression(frame(spark, x), ["key"], "u", 3, 1, 10, 5, 2, 6).collect()}
    unit = md.pd.util.hash_array(np.array([f"u{i}" for i in range(4)], dtype=object))
    for win in range(3):
        for perm in (1, 2):
            by = md.shifts(unit, win, perm, 3, 10, 6)
            assert by.min() >= 1 and by.max() <= 9
            ring = np.stack([[np.roll(x[i, c, 5 * win : 5 * win + 10], by[i, c]) for c in range(3)] for i in range(4)])
            past, now = ring[:, :, :-1].transpose(1, 0, 2).reshape(3, -1), ring[:, :, 1:].transpose(1, 0, 2).reshape(3, -1)
            assert np.allclose(got[win, perm], np.linalg.lstsq(past.T, now.T, rcond=None)[0].T, atol=1e-6)


def test_a_lag_that_moves_over_time(spark):
    x = series_of(np.random.RandomState(11), 40, 60)
    got = {(r.win, r.source, r.target): r for r in md.windowed_coherence(frame(spark, x), ["key"], "u", 3, 2, 20, 20, 39, 4, 32).collect()}
    assert len(got) == 3 * 6
    first, last = got[0, 0, 1], got[2, 2, 1]
    assert first.p == last.p == 1 / 40 and first.pdc > 0.4 and last.pdc > 0.4
    assert got[0, 2, 1].pdc < 0.2 and got[2, 0, 1].pdc < 0.2 and got[0, 2, 1].p > 1 / 40 and got[2, 0, 1].p > 1 / 40
    assert (first.start, first.stop) == (0, 20) and (last.start, last.stop) == (40, 60)


def test_trials_of_unlike_length_and_no_trials(spark):
    x = series_of(np.random.RandomState(12), 6, 30)
    short = frame(spark, x[:, :, :14]).unionByName(frame(spark, x))
    got = {r.win: r.n for r in md.windowed_autoregression(short, ["key"], "u", 3, 1, 10, 10).collect()}
    assert got == {0: 12 * 9, 1: 6 * 9, 2: 6 * 9}
    assert md.windowed_autoregression(short.limit(0), ["key"], "u", 3, 1, 10, 10).count() == 0
