"""Collation, stores, matching of data, motion checks, numbering and fits of iterations: small planted cases."""

import math

import numpy as np
import pytest

from perievent.functions import numerics as N
from perievent.operators import runs as R


def test_collation(spark):
    t = [("a", f, float(f + 1)) for f in range(30)] + [("b", f, -1.0) for f in range(30) if f != 12]
    onsets = [("a", 0, 1, 5), ("a", 1, 2, 2), ("a", 2, 1, 26), ("b", 0, 1, 5), ("b", 1, 1, 20)]
    got = R.collate(spark.createDataFrame(t, "cell string, frame long, value double"), spark.createDataFrame(onsets, "cell string, trial long, config long, onset long"), ("cell",), 3, 4, 10.0)
    rows = {(r["cell"], r["trial"], r["frame_ix"]): r for r in got.collect()}
    assert {k[:2] for k in rows} == {("a", 0), ("a", 2), ("b", 0), ("b", 1)} and len(rows) == 28  # ("a", 1) begins before the recording
    r = rows["a", 0, 3]
    assert (r["tsec"], r["raw"], r["f0"]) == (0.0, 6.0, 4.0) and r["dff"] == pytest.approx(0.5) and rows["b", 0, 0]["dff"] is None
    assert sorted(map(tuple, R.labels(got, ("cell",)).collect())) == [("a", 1, 2, 14), ("b", 1, 2, 14)]


def test_interpolation(spark):
    s = spark.createDataFrame([(1, 0.0, 10.0), (1, 4.0, 30.0), (1, 4.0, 50.0), (2, 1.0, 5.0)], "k int, t double, v double")
    a = spark.createDataFrame([(1, 7, 1.0), (1, 8, 4.0), (1, 9, 5.0), (2, 1, 1.0), (3, 1, 1.0)], "k int, id long, t double")
    got = {(r["k"], r["id"]): r["v"] for r in R.interpolated(s, a, ("k",), ("v",)).collect()}
    assert got == {(1, 7): 17.5, (1, 8): 40.0, (1, 9): None, (2, 1): 5.0, (3, 1): None}


def test_bad_files_are_told(spark):
    rng = np.random.default_rng(0)
    image = rng.random((8, 8))
    rows = [(f, y, x, float(image[y, x] + rng.random() * 0.05 if f != 4 else rng.random())) for f in range(9) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "file int, y int, x int, value double")
    got = {r["file"]: r["bad"] for r in R.image_quality(df, (), "file", 2.0).collect()}
    assert [f for f in got if got[f]] == [4]
    one = R.image_quality(df.filter("file = 0"), (), "file", 1.0).collect()
    assert [r["bad"] for r in one] == [False]


def test_discovery_and_growth(spark):
    rows = spark.createDataFrame([("A1", 1, 5), ("A2", 1, 6), ("B1", 2, 7)], "d string, run int, n int")
    assert sorted(map(tuple, R.discovered(rows.select("n", "d", "run"), "d", "run", "A*").collect())) == [("A1", 1), ("A2", 1)]
    got = R.grown_store([rows.select("d", "n"), spark.createDataFrame([("A1", "x")], "d string, mark string")], "d").filter("d = 'A1'").collect()
    assert sorted((r["n"] or 0, r["mark"] or "") for r in got) == [(0, "x"), (5, "")]


def test_runs_of_all_datasets_are_found(spark, sf, duck):
    want = duck.sql("select distinct l_returnflag || l_linestatus, l_linenumber from lineitem join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey").fetchall()
    assert sorted(map(tuple, R.a03(spark, sf).collect())) == sorted(want)
    assert sorted(duck.sql(R.SQL["a03_runs"]).fetchall()) == sorted(want) and len({d[:1] for d, _ in want}) > 1


def test_numbers_do_not_depend_on_slices(spark):
    df = spark.createDataFrame([(k, i) for k in range(3) for i in range(50 * k + 1)], "k int, i int").repartition(5)
    got = {(r["k"], r["i"]): r["n"] for r in R.numbered_within(df, ("k",), ("i",), "n").collect()}
    assert got == {(k, i): i + 1 for k in range(3) for i in range(50 * k + 1)}


def test_batched_fits_are_as_good_as_single_ones():
    rng = np.random.default_rng(1)
    x = np.arange(0, 360, 12.0)
    true = np.column_stack([rng.uniform(60, 300, 40), rng.uniform(15, 60, 40), rng.uniform(1, 5, 40), rng.uniform(0, 2, 40), rng.uniform(0, 1, 40)])
    y = R.double_gaussians(x, true) + rng.standard_normal((40, 30)) * 0.1
    top, high = x[y.argmax(axis=1)], y.max(axis=1)
    start = np.column_stack([top, np.full(40, 30.0), high, high / 2, np.zeros(40)])
    low, most = np.column_stack([top - 90, np.full(40, 10.0), *np.zeros((3, 40))]), np.column_stack([top + 90, np.full(40, 120.0), 3 * high, 3 * high, high])
    p, r2 = N.fit_curves(R.double_gaussians, x, y, start, low, most)
    single = [N.fit_curve(N.double_gaussian, x, y[i], start[i], low[i], most[i])[1] for i in range(40)]
    assert (r2 > np.array(single) - 1e-3).all() and np.median(np.abs(p[:, 0] - true[:, 0])) < 2


def test_summary_of_planted_tuning(spark):
    rng = np.random.default_rng(2)
    theta = np.arange(10) * 36.0
    rows = [(c, it, k, float(v)) for c, pref in ((0, 72.0), (1, 350.0)) for it in range(30) for k, v in enumerate(N.double_gaussian(theta, pref, 35, 4, 1, 2) + rng.standard_normal(10) * 0.1)]
    means = spark.createDataFrame(rows, "cell int, it int, config long, response double")
    fits = R.tuning_fits(means, ("cell", "it"), 36.0)
    assert fits.count() == 60 and fits.filter("good").count() == 60
    measured = spark.createDataFrame([(c, k, float(v)) for c, pref in ((0, 72.0), (1, 350.0)) for k, v in enumerate(N.double_gaussian(theta, pref, 35, 4, 1, 2))], "cell int, config long, response double")
    got = {r["cell"]: r for r in R.tuning_summary(fits, measured, ("cell",)).collect()}
    for c, pref in ((0, 72.0), (1, 350.0)):
        assert abs((got[c]["pref"] - pref + 180) % 360 - 180) < 6 and got[c]["spread"] < 0.01 and got[c]["combined_r2"] > 0.9 and got[c]["n_good"] == 30


def test_curves_of_split_levels(spark):
    rng = np.random.default_rng(3)
    rows = [("a", lev, float(q), float(rng.standard_normal() + (lev if q > 0.5 else 0.3 * lev)), f"{lev}/{i}") for lev in range(6) for i, q in enumerate(rng.random(120))]
    got = {(r["arousal"], r["labels"]): r for r in R.split_curves(spark.createDataFrame(rows, "area string, lev long, q double, v double, unit string"), ("area",), "lev", 0, "q", "v", 2, 5).collect()}
    assert set(got) == {(a, b) for a in ("low", "high") for b in ("own", "dealt")}
    assert got["high", "own"]["threshold_50"] < got["low", "own"]["threshold_50"] and got["high", "own"]["n"] > 100


def test_selections(spark):
    t = spark.createDataFrame([("a", 1, 0.01, 4), ("a", 2, 0.3, 0), ("b", 1, 0.4, 2)], "cell string, config int, p double, n_frames int")
    assert [r["cell"] for r in R.responsive(t, ("cell",), p="p").collect()] == ["a"] and sorted(r["cell"] for r in R.responsive(t, ("cell",), frames="n_frames", least=1).collect()) == ["a", "b"]
    n = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1)], "d string, t int")
    assert [tuple(r) for r in R.valid_datasets(n, spark.createDataFrame([("x", 2), ("x", 3), ("x", 9), ("y", 5)], "d string, t int"), "d", "t", 1).collect()] == [("x", 3, 3, 2)]
    rng = np.random.default_rng(4)
    x = rng.standard_normal(60)
    df = spark.createDataFrame([("told", i, float(v), float(v + rng.standard_normal() * 0.1)) for i, v in enumerate(x)] + [("not", i, float(v), float(rng.standard_normal())) for i, v in enumerate(x)], "k string, u int, x double, y double")
    p = {r["k"]: r["p"] for r in R.correlation_null(df, ("k",), "x", "y", ("u",), 20, 1).collect()}
    assert p["told"] == 0 and p["not"] > 0 and not math.isnan(p["not"])


def test_shuffles_by_ranges_are_those_of_one_order(spark, monkeypatch):
    import hashlib

    from perievent.functions.digests import md5_words

    hi, lo = md5_words("2|7|", np.array([0, 9, 10, 123456789012]), "|x")
    assert [f"{int(a):016x}{int(b):016x}" for a, b in zip(hi, lo)] == [hashlib.md5(f"2|7|{k}|x".encode()).hexdigest() for k in (0, 9, 10, 123456789012)]
    for v in ([1.0, -3.0, 50.0], [0.25, 12.01, 1e6 + 0.07], [math.pi, float("nan")], [-70000.0]):
        assert np.array_equal(R.thick(R.thin(np.array(v))), np.array(v), equal_nan=True)
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.integers(50)), None if i == 5 else float(rng.standard_normal())) for k, n in (("a", 60), ("b", 3)) for i in range(n)]
    monkeypatch.setattr(R, "SHARE", 7)  # ranges of seven places
    got = {r["k"]: r["p"] for r in R.correlation_null(spark.createDataFrame(rows, "k string, u int, x double, y double").repartition(3), ("k",), "x", "y", ("u",), 9, 2).collect()}
    for key in ("a", "b"):
        x, y = (np.array([np.nan if r[c] is None else r[c] for r in rows if r[0] == key]) for c in (2, 3))
        r = lambda v: np.corrcoef(x[~np.isnan(v)], v[~np.isnan(v)])[0, 1]  # noqa: B023, E731
        dealt = [y[sorted(range(len(y)), key=lambda i: hashlib.md5(f"2|{it}|{i + 1}".encode()).hexdigest())] for it in range(9)]  # noqa: B023
        assert got[key] == pytest.approx(np.mean([r(v) >= r(y) - 1e-12 for v in dealt])), key
