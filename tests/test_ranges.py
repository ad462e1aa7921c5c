"""Ranks, adjusted p, windows, tests and curves on small made tables, each against a direct computation."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialgrid.operators import series, stats as st, summaries as sm


def bh(p):
    m = len(p)
    order = np.argsort(p, kind="stable")
    q, least = np.empty(m), 1.0
    for k in range(m - 1, -1, -1):
        least = min(least, p[order[k]] * m / (k + 1))
        q[order[k]] = least
    return q


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_adjusted_p(spark, keys):
    rng = np.random.RandomState(1)
    p = [float(x) for x in np.round(rng.uniform(size=900) ** 2, 2)] + [None, float("nan"), None, 0.01, 0.02]
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b", x) for i, x in enumerate(p)]
    got = {r.i: r.q for r in series.benjamini_hochberg(spark.createDataFrame(rows, "i int, g string, p double"), keys, "p", ["i"]).collect()}
    assert len(got) == len(rows)
    for g in {r[1] if keys else 0 for r in rows}:
        mine = [(i, x) for i, k, x in rows if (k if keys else 0) == g]
        there = [(i, x) for i, x in mine if x is not None and x == x]
        for (i, _), q in zip(there, bh(np.array([x for _, x in there])), strict=True):
            assert got[i] == pytest.approx(q, abs=1e-12)
        assert all(got[i] is None for i, x in mine if x is None or x != x)


def test_adjusted_p_leaves_nulls_out(spark):
    rows = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, float("nan"))], "i int, p double")
    assert {r.i: r.q for r in series.benjamini_hochberg(rows, [], "p", ["i"]).collect()} == {1: 0.02, 2: 0.02, 3: None, 4: None}
    assert series.benjamini_hochberg(rows.limit(0), [], "p", ["i"]).count() == 0


def average(values):
    at = defaultdict(list)
    for k, x in enumerate(sorted(values), 1):
        at[x].append(k)
    return [sum(at[x]) / len(at[x]) for x in values]


@pytest.mark.parametrize("kinds", [1, 3, 40, 100_000])
def test_average_ranks_over_partitions(spark, kinds):
    """Also one value that fills several partitions, and keys that end in the middle of one."""
    rng = np.random.RandomState(kinds)
    rows = [(i, None if i % 5 == 0 else i % 3, int(x)) for i, x in enumerate(rng.randint(0, kinds, 700))]
    got = {r.i: r.rank for r in sm.average_ranked(spark.createDataFrame(rows, "i int, g int, x int").repartition(5), ["g"], "x", ["i"]).collect()}
    for g in (None, 0, 1, 2):
        mine = [(i, x) for i, k, x in rows if k == g]
        assert [got[i] for i, _ in mine] == average([x for _, x in mine])
    alone = {r.i: r.rank for r in sm.average_ranked(spark.createDataFrame(rows, "i int, g int, x int"), [], "x", ["i"]).collect()}
    assert [alone[i] for i, *_ in rows] == average([x for *_, x in rows])


def test_moving_mean_before_zero(spark):
    rows = [(s, float(s * s)) for s in range(-6, 3)]
    got = {r.win: (r.n, r.mean) for r in series.moving_mean(spark.createDataFrame(rows, "s int, value double").selectExpr("1 as k", "s", "value"), ["k"], "s", 4, 2).collect()}
    want = {}
    for k in range(-20, 20):
        part = [v for s, v in rows if 2 * k <= s < 2 * k + 4]
        if part:
            want[k] = (len(part), pytest.approx(sum(part) / len(part)))
    assert got == want and got[0][0] == 3 and got[-1][0] == 4


def test_signed_ranks_with_zeros_and_ties(spark):
    cases = {"zeros": [0, 0, 0, 1, 2, 3], "ties": [1, -1, 2, 2, -2, 3, 5, 0], "plain": [1.5, -0.5, 2.5, 4, -3, 6], "none": [0, 0, 0], "few": [1, 2], "gaps": [None, 1, 2, 3]}
    rows = [(k, None if x is None else float(x)) for k, xs in cases.items() for x in xs]
    got = {r.k: r for r in st.with_p_values(st.group_tests(spark.createDataFrame(rows, "k string, m double"), ["k"], "m")).collect()}
    assert (got["zeros"].wilcoxon, got["zeros"].n_ranked, got["zeros"].p_wilcoxon, got["zeros"].n) == (6, 3, 0.125, 6)
    assert got["none"].wilcoxon is None and got["none"].p_wilcoxon != got["none"].p_wilcoxon or got["none"].p_wilcoxon is None
    assert got["few"].wilcoxon is None and got["few"].t is None and got["gaps"].n == 3
    for k in ("ties", "plain"):
        x = [v for v in cases[k] if v]
        ranks = average([abs(v) for v in x])
        w = sum(r for r, v in zip(ranks, x, strict=True) if v > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(x))]
        assert got[k].wilcoxon == w
        if k == "plain":
            assert got[k].p_wilcoxon == sum(s >= w for s in sums) / len(sums)
        else:  # the normal law with the variance of the sum over all signs
            assert got[k].p_wilcoxon == pytest.approx(0.5 * math.erfc((w - np.mean(sums)) / np.std(sums) / math.sqrt(2)))
    mean, sd = np.mean(cases["plain"]), np.std(cases["plain"], ddof=1)
    assert got["plain"].t == pytest.approx(mean / (sd / math.sqrt(6)))


def test_tails_of_many(spark):
    t = np.array([2.353363, -1.0, 0.0, 12.7062])
    assert st.student_tail(t, np.array([3, 1, 7, 1])) == pytest.approx([0.05, 0.75, 0.5, 0.025], abs=1e-5)
    n = 12
    sums = Counter(sum(r + 1 for r in range(n) if k >> r & 1) for k in range(2**n))
    assert st.signed_rank_table(n) == pytest.approx([sum(c for s, c in sums.items() if s >= w) / 2**n for w in range(n * (n + 1) // 2 + 1)])


def direct_correlogram(x, y):
    z = lambda v: (v - np.nanmean(v)) / (np.nanstd(v) + 1e-8)
    x, y = z(x), z(y)
    n = np.sum(~np.isnan(x))
    out = {}
    for lag in range(-len(x) + 1, len(x)):
        pairs = [x[i + lag] * y[i] for i in range(len(x)) if 0 <= i + lag < len(x) and not np.isnan(x[i + lag] * y[i])]
        if pairs:
            out[lag] = sum(pairs) / n
    return out


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_correlogram_blocks(spark, block):
    rng = np.random.RandomState(4)
    series_ = {}
    rows = []
    for k, n in ((1, 40), (2, 63), (None, 5)):
        x, y = rng.normal(size=(2, n))
        for v in (x, y):
            v[rng.uniform(size=n) < 0.2] = np.nan
        gone = np.isnan(x) | np.isnan(y)
        x[gone] = y[gone] = np.nan
        series_[k] = x, y
        rows += [(k, i - 10, None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = series.correlogram(spark.createDataFrame(rows, "k int, s int, x double, y double"), ["k"], "s", "x", "y", block=block).collect()
    for k in (1, 2):
        want = direct_correlogram(*series_[k])
        assert {r.lag: r.r for r in got if r.k == k} == {lag: pytest.approx(v, abs=1e-9) for lag, v in want.items()}
    assert {r.k for r in got} == {1, 2}  # too short a series has no rows


def test_curve(spark):
    rng = np.random.RandomState(5)
    rows = [(g, t, u, float(t + rng.normal())) for g in "ab" for t in (-2, -1, 0, 1) for u in range(40)] + [("a", 0, 99, None)]
    got = {(r.g, r.t): r for r in sm.mean_curve(spark.createDataFrame(rows, "g string, t int, u int, x double"), ["g"], "t", "u", "x", 300, 2).collect()}
    assert len(got) == 8
    for (_, t), r in got.items():
        assert r.n == 40 and r.lo < r.mean < r.hi and abs(r.mean - t) < 0.6 and 0.3 < r.hi - r.lo < 0.9


def test_density_bounds_from_the_data(spark):
    rng = np.random.RandomState(6)
    rows = [tuple(map(float, p)) for p in rng.normal(size=(300, 2)) * 30] + [(400.0, -7.0), (None, 1.0), (1.0, float("nan"))]
    points = spark.createDataFrame(rows, "x double, y double")
    alone = sm.density(points, "x", "y", None, 50, 0.01, 0, 0.0).agg({"density": "sum", "i": "max", "j": "max"}).first()
    full = sm.density(points, "x", "y", None, 50, 0.01, 0, 0.0).agg({"density": "max"}).first()[0]
    assert full == 1.0 and alone["max(i)"] <= 49
    # without smoothing the densities are counts over the largest count: all 301 points are there
    counts = np.array([r.density for r in sm.density(points, "x", "y", None, 50, 0.01, 0, 0.0).collect()])
    assert sum(counts) / min(counts) == pytest.approx(301)
