"""Files named by their entities, path values, label variants, fallbacks and encoding, each against a direct computation."""

import numpy as np
import pytest

from trialgrid.functions import labels as lb
from trialgrid.operators import decoding as dc
from trialgrid.operators import joins as jn
from trialgrid.operators import models as md
from trialgrid.operators import series, stats as st, summaries as sm
from trialgrid.plans import models as plans
from trialgrid.sources import files

ODD = ["a+b", "c:d", "é%", "100%", "%25", "x y", "k=v", "a/b", "", None, "__EMPTY__", "___EMPTY__", "__HIVE_DEFAULT_PARTITION__", "ünï😀", "a-b_c.d", "'q\"", "back\\slash", "plain"]


def test_odd_values_in_folders(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(ODD)], "word string, i long")
    got = files.scan_tidy(spark, [files.write_tidy(df, ["word"], "odd")], "i long", ["word", "other"]).collect()
    assert {(r.word, r.i) for r in got} == {(k, i) for i, k in enumerate(ODD)} and all(r.other is None for r in got)


def test_odd_values_in_names(spark):
    words = [w for w in ODD if w]
    df = spark.createDataFrame([(k, "D0096", i) for i, k in enumerate(words)] + [(None, "D0097", 99)], "description string, subject string, i long")
    path = files.write_named(df, ["subject", "description"], "highgamma", "named")
    got = files.scan_named(spark, [path], "i long", ["subject", "description", "suffix", "extension", "task"]).collect()
    assert {(r.description, r.i) for r in got} == {*((k, i) for i, k in enumerate(words)), (None, 99)}
    assert {(r.subject, r.suffix, r.extension, r.task) for r in got} == {("D0096", "highgamma", ".csv", None), ("D0097", "highgamma", ".csv", None)}


def test_names_as_others_write_them(spark, tmp_path):
    names = {
        "sub-D0022/epoch(band)(sig)/sub-D0022_task-Phoneme_desc-production_highgamma.csv": 1,
        "sub-D0022/bipolar/sub-D0022_proc-3mm_aparc2009s.csv": 2,
        "sub-D0100/epoch(band)(sig)/sub-D0100_task-Phoneme_desc-50%_beta.csv": 3,
        "sub-D0100/epoch(band)(sig)/sub-D0100_task-Phoneme_desc-perception_highgamma.events.csv": 4,
    }
    for name, i in names.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(f"i\n{i}\n")
    scan = lambda match: files.scan_named(spark, [str(tmp_path)], "i long", ["subject", "description", "processing", "suffix", "datatype", "extension"], match)
    rows = {r.i: tuple(r)[1:] for r in scan(None).collect()}
    assert rows == {
        1: ("D0022", "production", None, "highgamma", "epoch(band)(sig)", ".csv"),
        2: ("D0022", None, "3mm", "aparc2009s", "bipolar", ".csv"),
        3: ("D0100", "50%", None, "beta", "epoch(band)(sig)", ".csv"),
        4: ("D0100", "perception", None, "highgamma", "epoch(band)(sig)", ".events.csv"),
    }
    assert [r.i for r in scan({"suffix": "highgamma", "subject": "D0022"}).collect()] == [1]
    assert sorted(r.i for r in scan({"datatype": "epoch(band)(sig)", "processing": None}).collect()) == [1, 3, 4]


def test_run_parameters(spark):
    path = files.write_with_params(spark.range(3).toDF("i"), {"alpha": 0.05, "band": "hg", "n": 20}, "run")
    assert files.run_params(spark, path, {"alpha": "double", "n": "int"}) == {"alpha": 0.05, "band": "hg", "n": 20}


def test_subject_variants(spark):
    F = lb.F
    got = spark.createDataFrame([("D0096",), ("D0100",), ("D0007",), ("D96",), ("X",), (None,)], "c string").select(lb.subject_id(F.col("c")), lb.subject_number(F.col("c")), lb.subject_replaced(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("D96", "D96", "D96"), ("D100", "D100", "D100"), ("D7", "D7", "D7"), ("D96", "D96", "D96"), ("X", None, "X"), (None, None, None)]


def test_units_of_sets(spark):
    rows = [("m", 0.05, 0.02, -0.9), ("m", 0.001, 0.0, 0.0), ("mm", 0.5, 0.2, 12.0), ("mm", 0.1, 0.1, 0.1), (None, 0.5, 0.5, 0.5), ("none", None, None, None)]
    got = lb.millimetres_by_set(spark.createDataFrame(rows, "s string, x double, y double, z double"), ["s"]).collect()
    want = [("m", 50.0, 20.0, -900.0), ("m", 1.0, 0.0, 0.0), ("mm", 0.5, 0.2, 12.0), ("mm", 0.1, 0.1, 0.1), (None, 500.0, 500.0, 500.0), ("none", None, None, None)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_alternates(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    a = spark.createDataFrame([(1, 10), (2, None), (2, None)], "k int, n int")
    b = spark.createDataFrame([(2, 20), (3, 30)], "k int, n int")
    got = jn.with_alternates(df, [("first", a), ("second", b)], ["k"], {"n": 0}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, 10, "first"), (2, 0, "first"), (3, 30, "second"), (4, 0, None)]


def test_peaks_and_quantiles_of_odd_values(spark):
    rows = [("a", 1, 1.0), ("a", 2, float("nan")), ("a", 3, 4.0), ("b", 1, None), ("b", 2, float("nan")), (None, 1, 2.0), (None, 2, 6.0)]
    df = spark.createDataFrame(rows, "k string, s int, value double")
    assert {(r.k, r.s, r.value) for r in series.peak(df, ["k"], "s").collect()} == {("a", 3, 4.0), (None, 2, 6.0)}
    assert {(r.k, r.m) for r in sm.quantiles(df, ["k"], "value", {"m": 0.5}).collect()} == {("a", 2.5), (None, 4.0)}


def test_stacked_to_height(spark):
    rows = [("x", "L", 3), ("x", "R", 1), ("x", "R", 2), ("y", "L", 5)]
    got = sm.stacked(spark.createDataFrame(rows, "k string, side string, o int"), ["k"], "side", ["o"], height=True).collect()
    assert sorted((r.k, r.line, r.side or "", r.o or 0) for r in got) == [("x", 1, "R", 1), ("x", 2, "R", 2), ("x", 3, "L", 3), ("y", 1, "L", 5), ("y", 2, "", 0), ("y", 3, "", 0)]


def test_null_features_count_as_zero(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(30, 2))
    y = x @ [1.0, -1.0]
    x[3, 0] = x[7, 1] = np.nan
    rows = [(i, i % 3, [None if np.isnan(v) else float(v) for v in x[i]], [float(y[i])]) for i in range(30)]
    got = {r.fold: r.w for r in md.cross_fit(spark.createDataFrame(rows, "trial int, fold int, x array<double>, y array<double>"), [], 2, 1).collect()}
    x, fold = np.nan_to_num(x), np.arange(30) % 3
    for f in range(3):
        m = np.hstack([np.ones((20, 1)), x[fold != f], y[fold != f, None]])
        assert np.allclose(got[f], md.solve_ridge(m[:, :3].T @ m, 2, 1.0, None).ravel())


def rank(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(len(v))
    for x in np.unique(v):
        out[v == x] = out[v == x].mean()
    return out


def test_encoding_scales_on_all_trials(spark):
    """Against a direct computation: fill, scale on all trials, plain ridge by fold, ranks against the shuffled numbers."""
    rng = np.random.RandomState(2)
    n, channels, samples = 60, 3, 4
    x = rng.normal(size=(n, channels, samples)) * 3 + 1
    t = np.round(x[:, 1, 2] + rng.normal(size=n), 1)
    x[5, 0, 1] = x[9, 1, 2] = np.nan
    x[:, 2, 3] = 7.0  # constant
    fold = rng.permutation(n) % 5
    rows = [(i, int(fold[i]), float(t[i]), [None if np.isnan(v) else float(v) for v in x[i].ravel()]) for i in range(n)]
    df = spark.createDataFrame(rows, "trial int, fold int, t double, x array<double>")
    got = {r.channel: r for r in dc.encode(df, channels, samples, 20, 5, alpha=2.0).collect()}
    for c in range(channels):
        z = np.nan_to_num(x[:, c])
        z = (z - z.mean(0)) / np.where(z.std(0) > 1e-12, z.std(0), 1)
        rhos = []
        for perm in range(21):
            y = t[dc.shuffled_places(np.arange(n), n, 5 + c, perm)] if perm else t
            pred = np.empty(n)
            for f in range(5):
                train = fold != f
                mx, my = z[train].mean(0), y[train].mean()
                w = np.linalg.solve((z[train] - mx).T @ (z[train] - mx) + 2 * np.eye(samples), (z[train] - mx).T @ (y[train] - my))
                pred[~train] = my + (z[~train] - mx) @ w
            rhos.append(np.corrcoef(rank(np.round(pred, 12)), rank(y))[0, 1])
        assert got[c].observed == pytest.approx(rhos[0], abs=1e-6)
        assert got[c].p == pytest.approx((sum(abs(r) >= abs(rhos[0]) - 1e-12 for r in rhos[1:]) + 1) / 21)
    assert got[1].p == 1 / 21 and got[1].observed > 0.5
    with pytest.raises(ValueError):
        dc.encode(df, channels, samples, 1, 5, most_targets=10)


def test_registered_decoding_finds_separated_classes(spark, tmp_path):
    """The registered queries with their own parameters on planted tables; eleven classes, one of them named 10."""
    rng = np.random.RandomState(3)
    rows = []
    for i in range(330):
        label = i % 11
        x = rng.normal(size=64)
        x[label] += 6
        rows.append((i, int(label), [float(v) for v in x]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = plans.ridge_decode(spark, str(tmp_path)).first()
    assert got.observed > 0.9 and got.p == 1 / 201
    assert all(r.score > 0.8 for r in plans.svm_decode(spark, str(tmp_path)).collect())
    grid = {(r.train, r.test): r for r in plans.temporal_generalisation_p(spark, str(tmp_path)).collect()}
    assert len(grid) == 9 and all(grid[k, k].observed > 3 / 11 and grid[k, k].p == 1 / 31 and grid[k, k].p <= grid[k, k].q < 0.2 for k in range(3))  # a third of the map at the least p


def test_series_pairs_skip_gaps(spark):
    rows = [("a", s, float(v)) for s, v in ((0, 1), (1, 2), (3, 9), (4, 19), (5, 39))]
    got = st.autoregression(spark.createDataFrame(rows, "k string, s int, value double"), ["k"], "s").first()
    slope, intercept = np.polyfit([1, 9, 19], [2, 19, 39], 1)
    assert got.n == 3 and got.slope == pytest.approx(slope) and got.intercept == pytest.approx(intercept)
