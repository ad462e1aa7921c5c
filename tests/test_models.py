"""Models on planted signals, and statistics on awkward values."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialgrid.operators import models as md
from trialgrid.operators import stats as st
from trialgrid.operators import summaries as sm


def test_ridge_matches_direct_fit(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(60, 4)) * [1, 5, 0.1, 1] + [0, 100, 0, 0]
    y = np.stack([x @ [1, 0.2, 3, 0], rng.normal(size=60)], 1)
    rows = spark.createDataFrame([(1, i % 3, i, x[i].tolist(), y[i].tolist()) for i in range(60)], "k int, fold int, trial int, x array<double>, y array<double>")
    got = {r.fold: np.array(r.w).reshape(5, 2) for r in md.cross_fit(rows, ["k"], 4, 2, 2.0).collect()}
    for f in range(3):
        a = np.arange(60) % 3 != f
        mean, sd = x[a].mean(0), x[a].std(0)
        z = (x[a] - mean) / sd
        w = np.linalg.solve(z.T @ z + 2 * np.eye(4), z.T @ (y[a] - y[a].mean(0))) / sd[:, None]
        assert np.allclose(got[f][1:], w, atol=1e-8) and np.allclose(got[f][0], y[a].mean(0) - mean @ w, atol=1e-6)
    pred = md.predict(rows, md.cross_fit(rows, ["k"], 4, 2, 2.0), ["k"], 4, 2).select("trial", "fold", "pred").collect()
    for r in pred:
        assert np.allclose(r.pred, got[r.fold][0] + x[r.trial] @ got[r.fold][1:], atol=1e-8)


def test_components_and_classes(spark):
    rng = np.random.RandomState(2)
    label = np.arange(90) % 3
    x = rng.normal(size=(90, 6)) + 4 * np.eye(6)[label]
    rows = spark.createDataFrame([(i, int(label[i]), i // 3 % 5, x[i].tolist()) for i in range(90)], "trial int, label int, fold int, x array<double>")
    rows = st.class_targets(rows, "label", range(3), 20, 0)
    pred = md.predict(rows, md.cross_fit(rows, [], 6, 63, variance=0.85), [], 6, 63)
    got = st.empirical_p(st.accuracy(pred, "label", range(3), 21), [], "accuracy").first()
    assert got.observed > 0.9 and got.p == pytest.approx(1 / 21)


def test_shuffles_of_training_trials(spark):
    n, folds, perms = 100, 5, 20
    rng = np.random.RandomState(8)
    label = np.arange(n) % 2
    x = rng.normal(size=(n, 3)) + 6 * label[:, None]  # two classes far apart
    rows = spark.createDataFrame([(i, int(label[i]), i // 2 % folds, x[i].tolist()) for i in range(n)], "trial int, label int, fold int, x array<double>")
    mixed = st.training_shuffles(rows, folds, F.col("label").cast("double"), perms, 7, "t")
    y = {r.trial: np.array(r.y).reshape(folds, perms + 1) for r in mixed.collect()}
    fold = np.arange(n) // 2 % folds
    whole = np.stack([y[i] for i in range(n)])
    assert (whole[:, :, 0] == label[:, None]).all()
    for f in range(folds):
        others = whole[fold != f, f]
        assert (np.sort(others, 0) == np.sort(label[fold != f])[:, None]).all()  # all trials of the training part, each once
        assert (others[:, 1:] != others[:, :1]).any(0).all() and len(np.unique(others, axis=1).T) == perms + 1
    both = (fold != 0) & (fold != 1)
    assert (whole[both, 0, 1:] != whole[both, 1, 1:]).any(0).all()  # two folds share no shuffle
    rows = st.class_targets(rows, "label", range(2), perms, 7, folds=folds)
    pred = md.predict(rows, md.cross_fit(rows, [], 3, 2 * (perms + 1), blocks=folds), [], 3, 2 * (perms + 1))
    scores = st.accuracy(pred, "label", range(2), perms + 1).toPandas().set_index("perm").accuracy
    assert scores[0] > 0.95 and abs(scores[1:].mean() - 0.5) < 0.15 and scores[1:].max() < scores[0]


def flooded(cells):
    """Components of cells that share sides, one set each."""
    left, out = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for near in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        out.append(part)
    return out


def test_clusters_of_a_map(spark):
    rng = np.random.RandomState(9)
    snake = [(r, c) for r in range(0, 12, 2) for c in range(12)] + [(r, 11 if r % 4 == 1 else 0) for r in range(1, 11, 2)]
    spots = [(int(r), int(c)) for r, c in rng.randint(0, 12, (60, 2))]
    rows = [("s", r, c) for r, c in snake] + [("d", r, c) for r, c in spots + spots[:5]]
    got = md.grid_components(spark.createDataFrame(rows, "k string, row int, col int"), ["k"]).collect()
    for k, cells in (("s", snake), ("d", spots)):
        want = {cell: min(part) for part in flooded(cells) for cell in part}
        assert {(r.row, r.col): tuple(r.label) for r in got if r.k == k} == want
    assert len(set(tuple(r.label) for r in got if r.k == "s")) == 1

    perms, size = 40, 9
    scores = rng.normal(size=(perms + 1, size, size)).round(1)  # ties
    scores[0, 2:6, 3:7] += 5
    scores[0, 8, 0] += 5
    frame = spark.createDataFrame([(p, r, c, float(scores[p, r, c])) for p in range(perms + 1) for r in range(size) for c in range(size)], "perm int, row int, col int, score double")
    mask, null = md.grid_clusters(frame, [], "score", perms)
    on = (scores[1:] >= scores[0]).sum(0) + 1 < 0.05 * (perms + 1)
    share = (scores[None, 1:] < scores[1:, None]).sum(1) / (perms - 1)
    most = np.array([max(map(len, flooded(zip(*np.nonzero(m > 0.95)))), default=0) for m in share])
    part = {cell: len(p) for p in flooded(zip(*np.nonzero(on))) for cell in p}
    got = {(r.row, r.col): r for r in mask.collect()}
    assert len(got) == size * size and {k for k, r in got.items() if r["size"]} == set(part)
    for cell, n in part.items():
        assert got[cell]["size"] == n and got[cell].p_size == pytest.approx(((most >= n).sum() + 1) / (perms + 1))
    assert all(got[r, c].mask for r in range(2, 6) for c in range(3, 7)) and not got[8, 0].mask
    assert {(r.perm, r.row, r.col): r.percentile for r in null.collect()} == pytest.approx({(p + 1, r, c): share[p, r, c] for p in range(perms) for r in range(size) for c in range(size)})
    assert md.grid_clusters(frame.limit(0), [], "score", perms)[0].count() == 0


def test_coherence_finds_the_planted_lag(spark):
    rng = np.random.RandomState(3)
    trials = []
    for t in range(40):
        x = rng.normal(size=(3, 60))
        for n in range(1, 60):
            x[1, n] += 0.8 * x[0, n - 1]  # channel 0 leads channel 1
        trials.append((t, x.ravel().tolist()))
    frame = spark.createDataFrame(trials, "trial int, m array<double>")
    null = md.directed_coherence(md.shifted_trials(frame, "trial", 3, 60, 20, 1), ["perm"], 3, 2)
    got = {(r.source, r.target): (r.observed, r.p) for r in st.empirical_p(null, ["source", "target"], "pdc").collect()}
    assert got[0, 1][0] == max(o for o, _ in got.values()) > 0.5 and got[0, 1][1] == pytest.approx(1 / 21)
    moved = md.shifted_trials(frame.limit(1), "trial", 3, 60, 1, 1).filter("perm = 1").first()
    for c in range(3):
        was, now = trials[moved.trial][1][60 * c : 60 * c + 60], moved.m[60 * c : 60 * c + 60]
        assert was != now and any(np.roll(was, k).tolist() == now for k in range(1, 60))


def test_factors_of_a_product(spark):
    rng = np.random.RandomState(4)
    w, h = rng.uniform(size=(30, 2)) * (rng.uniform(size=(30, 2)) > 0.4), rng.uniform(size=(2, 12))
    v = w @ h
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "key int, v array<double>")
    got, time, error = md.factorise(rows, 2, 40)
    back = {r.key: np.array(r.w) @ time for r in got.collect()}
    assert error < 0.05 * np.linalg.norm(v) and max(np.abs(back[i] - v[i]).max() for i in range(30)) < 0.15
    assert md.factorise(rows.limit(0), 2)[0].count() == 0


def test_mixed_model(spark):
    rng = np.random.RandomState(5)
    rows = []
    for g in range(60):
        b = rng.normal() * 2
        rows += [(g, float(x), float(1 + 3 * x + b + rng.normal())) for x in rng.normal(size=20)]
    beta, within, between = md.random_intercept(spark.createDataFrame(rows, "g int, x double, y double"), "g", "y", ["x"])
    assert abs(beta[1] - 3) < 0.1 and abs(within - 1) < 0.15 and 2 < between < 7


def test_clusters_of_a_planted_effect(spark):
    rng = np.random.RandomState(6)
    rows = [(u, s, float(rng.normal() + 3 * (10 <= s < 18))) for u in range(12) for s in range(40)]
    got = md.permutation_clusters(spark.createDataFrame(rows, "u int, s int, d double"), [], "u", "s", "d", 99, 1).orderBy("p").first()
    assert got.start <= 10 and got.stop >= 17 and got.n < 14 and got.p <= 0.05


def test_tails():
    assert st.student_tail(0, 7) == pytest.approx(0.5) and st.student_tail(2.353363, 3) == pytest.approx(0.05, abs=1e-5) and st.student_tail(-1, 1) == pytest.approx(0.75, abs=1e-6)
    for n in (3, 6):
        sums = [sum(r + 1 for r in range(n) if k >> r & 1) for k in range(2**n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert st.signed_rank_tail(w, n) == sum(s >= w for s in sums) / 2**n


def test_standardise_constant_and_large(spark):
    values = {0: lambda t: 5.0, 1: lambda t: 1e9 + t, 2: lambda t: None if t == 3 else float(t % 4)}
    rows = spark.createDataFrame([(t, t % 2, p, f(t)) for t in range(20) for p, f in values.items()], "trial long, label int, pos long, value double")
    folds = st.stratified_folds(rows, 5)
    fold = {r.trial: r.fold for r in folds.collect()}
    for r in st.fold_standardise(rows, folds).collect():
        other = np.array([values[r.pos](t) for t in range(20) if fold[t] != r.fold and values[r.pos](t) is not None])
        x = values[r.pos](r.trial)
        want = None if x is None else 0.0 if r.pos == 0 else (x - other.mean()) / other.std()
        assert (r.z is None) == (want is None) and (want is None or abs(r.z - want) < 1e-6)


def test_places_and_quantiles(spark):
    rng = np.random.RandomState(7)
    rows = [(None if k == 3 else k, float(x)) for k in range(4) for x in rng.randint(0, 20, 50)] + [(0, None)]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, x double, id int")
    got = sm.ranked(frame, ["k"], [F.col("x"), F.col("id")]).collect()
    for k in (0, 1, 2, None):
        own = sorted((r for r in got if r.k == k), key=lambda r: (r.x is not None, r.x or 0, r.id))
        assert [r.place for r in own] == list(range(1, len(own) + 1))
    q = {r.k: (r.a, r.b) for r in sm.quantiles(frame.filter("k is not null"), ["k"], "x", {"a": 0.1, "b": 0.5}).collect()}
    for k in range(3):
        assert q[k] == pytest.approx(tuple(np.percentile([x for i, x in rows if i == k and x is not None], [10, 50])))


def test_mixup_takes_complete_trials_of_the_class(spark):
    rows = [(t, t % 2, p, None if t in (4, 5) and p == 1 else float(10 * t + p)) for t in range(12) for p in range(3)]
    frame = spark.createDataFrame(rows, "trial long, label int, pos long, value double")
    folds = st.folds_spreading_gaps(frame, 3, 1)
    fold = {r.trial: r.fold for r in folds.collect()}
    got = st.mixup(frame, folds, 1).collect()
    assert {(r.fold, r.trial) for r in got} == {(f, t) for f, t in itertools.product(range(3), (4, 5)) if f != fold[t]}
    for r in got:
        donors = [10 * t + 1 for t in range(12) if t % 2 == r.trial % 2 and t not in (4, 5) and fold[t] != r.fold]
        assert r.pos == 1 and min(donors) <= r.value <= max(donors)
