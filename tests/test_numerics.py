import itertools
import math

import numpy as np
import pytest

from perievent.functions import numerics as N
from perievent.functions import tails


def test_tails_match_tables():
    assert tails.p_value("chi2", 3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.p_value("chi2", 18.30703805, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.p_value("t", 2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.p_value("f", 4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.p_value("z", 1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert math.isnan(tails.p_value("t", float("nan"), 3))


def test_double_gaussian_is_recovered():
    x = np.arange(0, 360, 12.0)
    y = N.double_gaussian(x, 70, 25, 3, 1, 0.5)
    p, r2 = N.fit_curve(N.double_gaussian, x, y, np.array([80, 40, 2, 2, 0.0]), np.array([0, 5, 0, 0, 0]), np.array([360, 120, 10, 10, 10]))
    assert r2 > 0.999999 and p == pytest.approx([70, 25, 3, 1, 0.5], abs=1e-3)


def test_field_is_recovered():
    yx = np.array([(a, b) for a in range(13) for b in range(13)], dtype=float)
    v = N.gaussian_2d(yx, 5, 6.5, 4.5, 1.5, 2.5, 0.3, 1)
    p, r2 = N.fit_curve(N.gaussian_2d, yx, v, np.array([4, 7, 5, 2, 2, 0.1, 0.0]), np.array([0, 0, 0, 0.5, 0.5, -3, -9]), np.array([99, 12, 12, 9, 9, 3, 9]))
    assert r2 > 0.999999 and p[1:3] == pytest.approx([6.5, 4.5], abs=1e-3)


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 4)])
def test_assignment_is_least(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        c = rng.integers(0, 30, shape).astype(float)
        t = c if shape[0] <= shape[1] else c.T
        best = min(sum(t[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0]))
        got = N.assignment(c)
        assert sum(c[i, j] for i, j in got) == best and len(got) == min(shape)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = np.where(x[:, 0] - x[:, 2] > 0, 1, -1)
    assert N.svm_score(x[:150], y[:150], x[150:], y[150:]) > 0.9
    assert math.isnan(N.svm_score(x[:5], np.ones(5), x[5:], y[5:]))


def test_ridge_and_lowess():
    x = np.random.default_rng(1).normal(size=(50, 3))
    w = N.ridge(x, x @ np.array([1.0, -2, 0.5]) + 4, 1e-9)
    assert w == pytest.approx([1, -2, 0.5, 4], abs=1e-6)
    line = np.arange(30) * 2.0 + 1
    assert N.lowess(line, 0.3) == pytest.approx(line)


def test_components_of_a_map(spark):
    from perievent.operators.maps import components

    on = [(0, 0), (1, 1), (2, 2), (2, 4), (0, 4), (1, 4)]
    df = spark.createDataFrame([(y, x, int((y, x) in on)) for y in range(3) for x in range(6)], "y long, x long, s int")
    got = {(r["y"], r["x"]): (r["label"], r["area"]) for r in components(df, "s").collect()}
    assert got == {(0, 0): (0, 3), (1, 1): (0, 3), (2, 2): (0, 3), (0, 4): (4, 3), (1, 4): (4, 3), (2, 4): (4, 3)}


def test_components_of_a_chain(spark):
    from perievent.plans.graph import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decoder_finds_a_planted_difference(spark):
    from perievent.operators.models import decode

    rng = np.random.default_rng(3)
    rows = [(t, t % 2, (rng.normal(size=4) + (t % 2) * 2).tolist()) for t in range(80)]
    got = decode(spark.createDataFrame(rows, "trial long, config long, x array<double>"), 4, 1).toPandas()
    assert got[got.condition == "data"].score.mean() > 0.85 > got[got.condition == "shuffled"].score.mean()
    again = decode(spark.createDataFrame(rows, "trial long, config long, x array<double>"), 4, 1).toPandas()
    assert got.sort_values(["it", "condition"]).score.tolist() == again.sort_values(["it", "condition"]).score.tolist()


def test_equal_counts_repeat(spark):
    from perievent.operators.joins import equal_counts

    df = spark.createDataFrame([("d", c, t) for c, n in ((1, 6), (2, 4), (3, 5)) for t in range(n)], "datakey string, config int, trial int")
    a = sorted(map(tuple, equal_counts(df, ("datakey", "config"), "trial", 5).collect()))
    assert a == sorted(map(tuple, equal_counts(df, ("datakey", "config"), "trial", 5).collect()))
    assert [sum(r[1] == c for r in a) for c in (1, 2, 3)] == [4, 4, 4]
