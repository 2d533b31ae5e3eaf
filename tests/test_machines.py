"""Machines over distributed trials, against the solvers for one group and planted data."""

import numpy as np
import pytest

from perievent.functions import numerics as N
from perievent.operators import machines as M


def trials_of(spark, x, y, part=None):
    rows = [(i, int(c), [float(v) for v in r], int(part[i]) if part is not None else 0) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "trial long, config long, x array<double>, part int").repartition(3)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    y = np.repeat([0, 1, 2, 3], [30, 25, 40, 28])
    return rng.standard_normal((len(y), 6)) * [1, 5, 1, 100, 1, 1] + 1000 + np.outer(y == 1, [2, 0, 0, 0, 0, 0]) + np.outer(y == 2, [0, 9, 0, 0, 0, 0]) + np.outer(y == 3, [0, 0, 0, 150, 2, 0]), y


def local(d):
    rows = d.rows.collect()
    return np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["ranks"] for r in rows]), np.array([r["twins"] for r in rows]), np.array([r["part"] for r in rows])


def test_dealt_orders(spark, blobs):
    d = M.dealt(trials_of(spark, *blobs), 3, 5)
    _, y, ranks, twins, _ = local(d)
    assert d.least == {0: 25, 1: 25, 2: 25} and d.classes == [0, 1, 2, 3] and d.features == 6
    for it in range(3):
        for c in range(4):
            assert sorted(ranks[y == c, it][ranks[y == c, it] >= 0]) == list(range(25))
        kept = ranks[:, it] >= 0
        assert np.bincount(twins[kept, it]).tolist() == [25] * 4 and (twins[~kept, it] == -1).all()
        assert (twins[kept, it] != y[kept]).any()
    assert (ranks[:, 0] != ranks[:, 1]).any()


@pytest.mark.parametrize("c", [0.001, 0.1, 10.0])
def test_machines_equal_the_solver_for_one_group(spark, blobs, c):
    d = M.dealt(trials_of(spark, *blobs), 2, 1)
    x, y, ranks, twins, part = local(d)
    machines = [M.Machine(0, 1, 5, 25, c), M.Machine(1, 3, 0, 25, c, fold=2), M.Machine(1, 2, 0, 20, c, twin=True), M.Machine(0, 0, 0, 25, c, features=(0, 3, 4))]
    w, both = M.fitted(d, machines)
    assert both.all()
    for m, got in zip(machines, w):
        ok = m.trains(ranks[:, m.it], part)
        label = np.where((twins[:, m.it] if m.twin else y)[ok] == m.positive, 1, -1)
        f = list(m.features or range(6))
        a, b = N.standardized(x[ok][:, f], x[:, f])
        v = N.linear_svm(a, label, c, rounds=3000)
        assert x @ got[:-1] + got[-1] == pytest.approx(b @ v[:-1] + v[-1], abs=2e-3)
        if m.features:
            assert (got[:-1][[1, 2, 5]] == 0).all()


def test_blocks_of_machines_agree(spark, blobs, monkeypatch):
    d = M.dealt(trials_of(spark, *blobs), 1, 1)
    machines = [M.Machine(0, k, 0, 25, 0.1) for k in range(4)]
    one, _ = M.fitted(d, machines)
    monkeypatch.setattr(M, "SUMS", 40)
    two, _ = M.fitted(d, machines)
    assert np.abs(one - two).max() < 1e-9


def test_decoding_of_planted_classes(spark, blobs):
    found = M.decode(trials_of(spark, *blobs), 4, 3)
    data, twin = found[found.condition == "data"], found[found.condition == "shuffled"]
    assert data.score.mean() > 0.65 and data.mi.mean() > 0.9 and twin.score.mean() < 0.5 and set(found.n_test) == {20}
    assert set(found.c) <= set(M.PATH)
    two = M.decode(trials_of(spark, *blobs).filter("config < 2"), 2, 3, feature_sets={"told": (0,), "noise": (2, 5)})
    score = two[two.condition == "data"].groupby("features").score.mean()
    assert score["told"] > 0.7 and score["told"] > score["noise"]


def test_chosen_c_is_the_best_of_a_plain_search(spark, blobs):
    d = M.dealt(trials_of(spark, *blobs).filter("config < 2"), 2, 9)
    x, y, ranks, _, part = local(d)
    got = M.chosen(d, {0: (5, 25), 1: (5, 25)}, (0.0001, 0.01, 1.0), 4)
    for it in (0, 1):
        right = {}
        for c in (0.0001, 0.01, 1.0):
            right[c] = 0
            for f in range(4):
                own = (ranks[:, it] >= 5) & (ranks[:, it] < 25)
                test = own & (ranks[:, it] % 4 == f)
                train = own & ~test
                a, b = N.standardized(x[train], x[test])
                v = N.linear_svm(a, np.where(y[train] == 1, 1, -1), c, rounds=3000)
                right[c] += int(((b @ v[:-1] + v[-1] > 0) == (y[test] == 1)).sum())
        assert got[it] == min(c for c in right if right[c] == max(right.values()))


def test_permutations_of_told_and_untold_classes(spark, blobs):
    x, y = blobs
    told = M.permutation_test(trials_of(spark, x, y).filter("config < 2"), 60, 4, folds=4)
    assert told["p"] == pytest.approx(1 / 61) and told["score"] > 0.7 and told["n"] == 60
    rng = np.random.default_rng(1)
    assert M.permutation_test(trials_of(spark, rng.standard_normal((40, 3)), np.arange(40) % 2), 60, 4, folds=4)["p"] > 0.05


def test_confusion_of_four_planted_classes(spark, blobs):
    x, y = blobs
    got = M.confusion(trials_of(spark, x, y), (3, 18, 99), 5, 2, n_test=6)
    assert set(got.n_train) == {3, 18} and len(got) == 32 and (got.n == 5).all()
    sums = got.groupby(["n_train", "true"])["mean"].sum()
    assert np.allclose(sums, 1)
    own = got[got.true == got.said].groupby("n_train")["mean"].mean()
    assert own[18] > own[3] and own[18] > 0.7 and (got.sd >= 0).all()
    null = M.grouped_classes(trials_of(spark, x, y), "config", {0: 0, 1: 1}, 9)
    assert sorted(r["config"] for r in null.select("config").distinct().collect()) == [0, 1, 9]
    assert M.grouped_classes(trials_of(spark, x, y), "config", {0: 0, 1: 1}).count() == int((y < 2).sum())


def test_generalization_and_elimination(spark, blobs):
    x, y = blobs
    part = np.arange(len(y)) % 2
    x = x.copy()
    x[(part == 1) & (y == 1), 0] -= 4  # in part 1, class 1 goes the other way
    got = M.generalize(trials_of(spark, x, y, part).filter("config < 2"), 1).set_index(["train", "test"])
    assert got.score[0, 0] > 0.7 and got.score[1, 1] > 0.7 and got.score[0, 1] < 0.65 and got.novel[0, 1] and not got.novel[1, 1]
    left = M.eliminate(trials_of(spark, *blobs).filter("config < 2"), 3, 2)
    assert left.groupby("fold").n_features.apply(list).tolist() == [[6, 4, 3, 2, 1]] * 3
    assert left[left.n_features == 1].score.mean() > 0.65


def test_ridge_equals_the_solver_for_one_group(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    x = rng.standard_normal((80, 4)) + 50
    y = (x @ [1, 0, -2, 0.5] * 3 + rng.standard_normal(80)).astype(int)
    t = trials_of(spark, x, y)
    got = M.ridge_folds(t, 4, 2.0).set_index("fold")
    fold = {r["trial"]: r["f"] for r in t.select("trial", F.pmod(F.xxhash64("trial"), F.lit(4)).alias("f")).collect()}
    f = np.array([fold[i] for i in range(80)])
    for k in range(4):
        w = N.ridge(x[f != k], y[f != k].astype(float), 2.0)
        p, own = x[f == k] @ w[:-1] + w[-1], y[f == k]
        assert got.r[k] == pytest.approx(np.corrcoef(p, own)[0, 1]) and got.r2[k] == pytest.approx(1 - ((own - p) ** 2).sum() / ((own - own.mean()) ** 2).sum())


def test_machines_of_odd_trials(spark):
    rows = [(1, 0, [1.0, 2.0], 0), (2, None, [1.0, 2.0], 0), (3, 1, None, 0)]
    df = spark.createDataFrame(rows, "trial long, config long, x array<double>, part int")
    got = M.decode(df, 2, 1)  # one class only
    assert got.score.isna().all()
    assert len(M.decode(df.limit(0), 2, 1)) == 0
