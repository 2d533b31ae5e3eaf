"""Factorial designs, comparisons after rank tests, corrections and adjusted information, against plain versions."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from perievent.operators import designs


def dummies(df, factors):
    one = np.ones((len(df), 1))
    return np.hstack([one, *[pd.get_dummies(df[f]).to_numpy(dtype=float) for f in factors]]) if factors else one


def products(df, effect):
    key = df[list(effect)].astype(str).agg("|".join, axis=1)
    return pd.get_dummies(key).to_numpy(dtype=float)


def squares(df, effects, y):
    x = np.hstack([np.ones((len(df), 1)), *[products(df, e) for e in effects]])
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - fit) ** 2).sum()), np.linalg.matrix_rank(x)


def plain_anova(df, factors, value):
    """Nested models on all rows: kind II."""
    effects = [c for k in range(1, len(factors) + 1) for c in itertools.combinations(factors, k)]
    y = df[value].to_numpy(dtype=float)
    error, rank = squares(df, effects, y)
    out = {}
    for e in effects:
        rest = [r for r in effects if not set(e) <= set(r)]
        a, ra = squares(df, rest, y)
        b, rb = squares(df, [*rest, e], y)
        out[":".join(e)] = (a - b, rb - ra, (a - b) / (rb - ra) / (error / (len(df) - rank)) if rb > ra else None)
    return out


def test_unbalanced_factorial_equals_nested_models(spark):
    rng = np.random.default_rng(0)
    df = pd.DataFrame({"cell": rng.integers(0, 2, 500), "a": rng.choice(list("xyz"), 500, p=[0.6, 0.3, 0.1]), "b": rng.integers(0, 2, 500), "c": rng.integers(0, 3, 500)})
    df["y"] = 1e4 + 4 * df.a.map({"x": 0, "y": 1, "z": 2}) * df.b + rng.standard_normal(500)
    got = designs.factorial_anova(spark.createDataFrame(df), ("cell",), ("a", "b", "c"), "y").toPandas()
    for cell, part in df.groupby("cell"):
        want = plain_anova(part, ("a", "b", "c"), "y")
        for _, r in got[got.cell == cell].iterrows():
            ss, dof, f = want[r.effect]
            assert r.df == dof and r.ss == pytest.approx(ss, rel=1e-6, abs=1e-6) and r.f == pytest.approx(f, rel=1e-6)
    p = got.set_index(["cell", "effect"]).p
    assert p[0, "a:b"] < 1e-6 and p[1, "a:b"] < 1e-6
    three = designs.factorial_anova(spark.createDataFrame(df), ("cell",), ("a", "b", "c"), "y", "III").toPandas()
    top = lambda d: d[d.effect == "a:b:c"].sort_values("cell").ss.tolist()
    assert top(three) == pytest.approx(top(got), rel=1e-6)


def test_factorial_of_odd_rows(spark):
    rows = [("q", "x", "u", 1.0), ("q", "x", "u", 3.0), ("q", "y", "u", 2.0), ("q", "y", None, 5.0), ("q", None, "u", None), ("one", "x", "u", 1.0), (None, "x", "u", 1.0), (None, "x", "v", 4.0)]
    df = spark.createDataFrame(rows, "cell string, a string, b string, y double")
    got = designs.factorial_anova(df, ("cell",), ("a", "b"), "y").toPandas()
    assert len(got) == 9 and got[got.cell == "one"].f.isna().all() and (got[got.cell == "one"].df == 0).all()
    assert designs.factorial_anova(df.limit(0), ("cell",), ("a", "b"), "y").count() == 0
    chosen = designs.selective(spark.createDataFrame([("a", "x", 0.01), ("a", "y", 0.2), ("b", "x", None), ("a", "x:y", 0.04)], "cell string, effect string, p double"), ("cell",))
    assert [tuple(r) for r in chosen.collect()] == [("a", ["x", "x:y"])]


def plain_ranks(v):
    v = np.asarray(v)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_rank_comparisons_equal_a_plain_version(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"k": rng.integers(0, 2, 300), "g": rng.integers(0, 4, 300), "v": rng.integers(0, 12, 300).astype(float)})
    df.loc[df.g == 3, "v"] += 3
    got = designs.rank_comparisons(spark.createDataFrame(df), ("k",), "g", "v").toPandas()
    assert len(got) == 12
    for k, part in df.groupby("k"):
        r, n = plain_ranks(part.v), len(part)
        ties = sum(c**3 - c for c in part.v.value_counts())
        groups = {g: r[(part.g == g).to_numpy()] for g in range(4)}
        h = (12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for x in groups.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
        s2 = ((r**2).sum() - n * (n + 1) ** 2 / 4) / (n - 1)
        own = got[got.k == k]
        for _, x in own.iterrows():
            a, b = groups[x.a], groups[x.b]
            z = (a.mean() - b.mean()) / math.sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / len(a) + 1 / len(b)))
            t = (a.mean() - b.mean()) / math.sqrt(s2 * (n - 1 - h) / (n - 4) * (1 / len(a) + 1 / len(b)))
            assert (x.z, x.t, x.h) == pytest.approx((z, t, h)) and x.p_dunn == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        p = np.sort(own.p_dunn.to_numpy())
        assert np.sort(own.p_dunn_holm.to_numpy()) == pytest.approx(np.minimum(1, np.maximum.accumulate(p * np.arange(len(p), 0, -1))))
    flat = designs.rank_comparisons(spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0)], "k string, g int, v double"), ("k",), "g", "v").collect()
    assert [r["z"] for r in flat] == [None]


def plain_hommel(p):
    """Every subset that holds a hypothesis, by Simes."""
    out = []
    for i in range(len(p)):
        worst = 0.0
        for k in range(len(p)):
            for rest in itertools.combinations([j for j in range(len(p)) if j != i], k):
                s = sorted([p[i], *(p[j] for j in rest)])
                worst = max(worst, min(len(s) * x / (r + 1) for r, x in enumerate(s)))
        out.append(min(1.0, worst))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_hommel_is_the_closed_test(seed):
    rng = np.random.default_rng(seed)
    p = rng.random(rng.integers(1, 9)) ** rng.integers(1, 5)
    if seed % 3 == 0:
        p = np.round(p, 1)
    assert designs.hommel_adjusted(p) == pytest.approx(plain_hommel(p.tolist()))


def test_hommel_by_family(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 0.2), ("a", None), ("b", 0.5)], "f string, p double")
    got = {(r["f"], r["p"]): r["hommel"] for r in designs.hommel(df, ("f",), "p").collect()}
    assert got[("a", 0.01)] == pytest.approx(plain_hommel([0.01, 0.02, 0.2])[0]) and got[("b", 0.5)] == 0.5 and got[("a", None)] in (None,) or math.isnan(got[("a", None)])
    more = designs.more_corrections(df, ("f",), "p").toPandas()
    assert more[more.p.isna()].holm_sidak.isna().all() and more[(more.f == "a") & (more.p == 0.01)].simes_hochberg.iloc[0] == pytest.approx(0.03)


def test_dealt_labels_have_no_adjusted_information(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 4, (40, 60)), rng.integers(0, 5, (40, 60))
    rows = [(k, int(a), int(b)) for k in range(40) for a, b in zip(x[k], y[k])] + [(99, 1, 1), (98, None, 1)] + [(97, i, i) for i in range(3)]
    got = designs.mutual_information(spark.createDataFrame(rows, "k int, x int, y int"), ("k",), "x", "y").toPandas().set_index("k").sort_index()
    assert abs(got.loc[:39].ami.mean()) < 0.02 and got.loc[:39].mi.mean() > 0.05
    assert got.ami[99] == 1 and 98 not in got.index and got.ami[97] == pytest.approx(1.0) or got.nmi[97] == pytest.approx(1.0)
    # every dealing of a small table
    a, b = [0, 0, 1, 1, 1], [0, 1, 1, 0, 0]

    def mi(a, b):
        n = len(a)
        return sum((c := sum(p == (i, j) for p in zip(a, b))) and c / n * math.log(c * n / (a.count(i) * b.count(j))) for i in set(a) for j in set(b))

    mean = np.mean([mi(a, list(p)) for p in itertools.permutations(b)])
    one = designs.mutual_information(spark.createDataFrame([(0, i, j) for i, j in zip(a, b)], "k int, x int, y int"), ("k",), "x", "y").first()
    assert one["expected_mi"] == pytest.approx(mean) and one["mi"] == pytest.approx(mi(a, b))
