"""Areas, resampled fields and edge cases of core operators against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perievent.functions import numerics as N
from perievent.operators import coverage, drivers, maps, metrics, series, stats
from perievent.plans import order


def test_clipped_areas_match_sampling():
    rng = np.random.default_rng(5)
    n = 12
    x0, y0, a, b, theta = rng.uniform(-5, 5, n), rng.uniform(-5, 5, n), rng.uniform(1, 6, n), rng.uniform(1, 6, n), rng.uniform(0, 3, n)
    half = rng.uniform(1, 8, n)
    x, y = N.ellipses(x0, y0, a, b, theta, 256)
    assert N.polygon_area(x, y) == pytest.approx(math.pi * a * b, rel=1e-3)
    got = N.area_in_box(x, y, -half, half, -half, half)
    px, py = np.meshgrid(np.linspace(-14, 14, 1401), np.linspace(-14, 14, 1401))
    for i in range(n):
        dx, dy = px - x0[i], py - y0[i]
        u, v = dx * np.cos(theta[i]) + dy * np.sin(theta[i]), -dx * np.sin(theta[i]) + dy * np.cos(theta[i])
        inside = (u / a[i]) ** 2 + (v / b[i]) ** 2 <= 1
        assert got[i] == pytest.approx((inside & (abs(px) <= half[i]) & (abs(py) <= half[i])).sum() * 0.02**2, abs=0.15)


def test_overlap_shares(spark):
    fields = spark.createDataFrame([("d", 1, 0.0, 0.0, 1.0, 1.0, 0.0), ("d", 2, 50.0, 0.0, 1.0, 2.0, 0.0), ("d", 3, 5.0, 0.0, 2.0, 2.0, 0.3), ("e", 4, 0.0, 0.0, 1.0, 1.0, 0.0)], "datakey string, cell long, x0 double, y0 double, a double, b double, theta double")
    boxes = spark.createDataFrame([("d", 10, 0.0, 0.0)], "datakey string, size long, x double, y double")
    got = {r["cell"]: r for r in coverage.overlaps(fields, boxes, "datakey").collect()}
    assert set(got) == {1, 2, 3} and got[1]["of_field"] == pytest.approx(1) and got[2]["iou"] == 0 and got[3]["of_field"] == pytest.approx(0.5, abs=0.01)
    assert {r["cell"] for r in coverage.overlapping(coverage.overlaps(fields, boxes, "datakey"), "datakey", 0.9).collect()} == {1}


def test_planted_field_is_found_in_every_draw(spark):
    rng = np.random.default_rng(2)
    yx = np.array([(y, x) for y in range(9) for x in range(9)], dtype=float)
    v = N.gaussian_2d(yx, 5, 4.5, 3.5, 1.5, 1.5, 0.0, 1)
    rows = [(f, int(y), int(x), float(z + rng.normal(0, 0.05))) for f in range(12) for (y, x), z in zip(yx, v)]
    frames = spark.createDataFrame(rows, "frame long, y long, x long, value double")
    where = spark.createDataFrame([(7, y, x) for y in range(9) for x in range(9)], "cell long, y long, x long")
    got = coverage.boot_fields(frames, where, 6, 1).collect()
    assert len({r["it"] for r in got}) == 6 and all(r["cell"] == 7 and abs(r["x0"] - 4.5) < 0.2 and abs(r["y0"] - 3.5) < 0.2 and r["r2"] > 0.95 for r in got)


def test_order_over_many_slices(spark):
    """Row numbers, running counts and quantiles with nulls, ties, repeated rows, one row and none."""
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, *range(12)]), i) for i in range(400)] + [("c", 5, 400)]
    df = spark.createDataFrame(rows, "k string, v long, i long")
    got = {r["i"]: r["n"] for r in order.numbered(df, [F.asc_nulls_first("v"), F.col("i")], "n").collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert got == {r[2]: n for n, r in enumerate(want, 1)}
    got = {r["k"]: (r["lo"], r["mid"]) for r in order.quantiles(df, ("k",), "v", {"lo": 0.1, "mid": 0.5}).collect()}
    for k in "abc":
        v = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert got[k] == pytest.approx((np.quantile(v, 0.1), np.quantile(v, 0.5)))
    none = df.limit(0)
    assert order.numbered(none, [F.col("i")], "n").count() == order.quantiles(none, ("k",), "v", {"m": 0.5}).count() == 0


def test_auc_edges(spark):
    """Ties, one value, an empty side, nulls: against the plain sum over fifty criteria."""
    cases = {"ties": ([1, 1, 2, 2], [1, 2, 2, 3]), "one": ([5, 5], [4, 6]), "plain": ([1.0, 4, 9, 16, 25], [0, 2, 3, 30, None])}
    rows = [(k, side, v) for k, (s, b) in cases.items() for side, vs in ((True, s), (False, b)) for v in vs] + [("empty", True, 1.0)]
    df = spark.createDataFrame([(k, s, None if v is None else float(v)) for k, s, v in rows], "k string, side boolean, v double")
    got = {r["k"]: r["auc"] for r in stats.auc(df, ("k",), ()).collect()}
    assert got.pop("empty") is None
    for k, (s, b) in cases.items():
        b = [x for x in b if x is not None]
        lo, step = min(s), (max(s) - min(s)) / 49
        h, f = ([sum(x > lo + i * step for x in v) / len(v) for i in range(50)] for v in (s, b))
        assert got[k] == pytest.approx(sum((f[i - 1] - f[i]) * (h[i] + h[i - 1]) / 2 for i in range(1, 50)))
    assert stats.auc(df.limit(0), ("k",), ()).count() == 0


def test_wide_holes_are_filled(spark):
    rng = random.Random(4)
    img = {(y, x): (rng.random() if rng.random() < 0.04 else None) for y in range(14) for x in range(14)}
    got = {(r["y"], r["x"]): r["v"] for r in maps.filled(spark.createDataFrame([(y, x, v) for (y, x), v in img.items()], "y long, x long, v double")).collect()}
    for (y, x), v in img.items():
        near = min((((a - y) ** 2 + (b - x) ** 2, a, b) for (a, b), w in img.items() if w is not None), default=None)
        assert got[y, x] == (v if v is not None else img[near[1], near[2]])


def test_store_makes_only_what_it_lacks(spark, tmp_path):
    store, made = drivers.KeyedStore(str(tmp_path / "s"), "k"), []
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("c", 7)], "k string, v long")

    def make(rows):
        return rows.groupBy("k").agg(F.sum("v").alias("s"))

    assert {tuple(r) for r in store.get(df.filter("k < 'b'"), make).select("k", "s").collect()} == {("a", 3)}
    doubled = df.withColumn("v", F.col("v") * 2)
    assert {tuple(r) for r in store.get(doubled, make).select("k", "s").collect()} == {("a", 3), ("b", 10), ("c", 14)}
    assert {tuple(r) for r in store.get(doubled, make, create_new=True).select("k", "s").collect()} == {("a", 6), ("b", 10), ("c", 14)}


def test_core_operators_take_empty_and_null_tables(spark):
    traces = spark.createDataFrame([(1, 0, 0, i, None if i % 3 else 1.0) for i in range(20)] + [(2, 0, 1, i, 2.0) for i in range(20)], "cell long, trial long, config long, frame_ix long, value double")
    for df in (traces, traces.limit(0)):
        m = metrics.trial_metrics(df, 8, 6, 0).collect()
        assert len(m) == (2 if df is traces else 0)
        assert len(metrics.psth(df).collect()) == (40 if df is traces else 0)
    r = spark.createDataFrame([("d", 1, 1, 1, 2.0), ("d", 1, 1, 1, 2.0), ("d", 1, 2, 2, None)], "datakey string, cell long, config long, trial long, response double")
    assert {(x["config"], x["response"]) for x in metrics.by_config(r).collect()} == {(1, 2.0), (2, None)}
    assert stats.kruskal_wallis(r.limit(0), ("cell",), "config", "response").count() == 0
    assert series.runs(traces.limit(0), ("cell",), ("frame_ix",), "value").count() == 0


def test_cells_of_one_mask_share_one_fit(spark):
    """Cells of the same pixels, in any order, are one shape; others keep their own, and every cell has its fits."""
    from perievent.operators import maps, models

    rows = [(c, y, x) for c, (cy, cx) in {7: (0, 0), 3: (0, 0), 5: (1, 0)}.items() for y in range(cy, cy + 5) for x in range(cx, cx + 5)]
    where = spark.createDataFrame(rows[::-1], "cell long, y long, x long").repartition(3)
    of, shapes = maps.same_masks(where)
    assert sorted(map(tuple, of.collect())) == [(3, 3), (5, 5), (7, 3)] and shapes.count() == 50
    img = spark.createDataFrame([(it, y, x, math.exp(-((y - 2) ** 2) / 3 - (x - it - 1) ** 2 / 2)) for it in (0, 1) for y in range(7) for x in range(7)], "it int, y long, x long, v double")
    got = {(r["cell"], r["it"]): (r["x0"], r["y0"], r["r2"]) for r in models.fit_masks(where, img, ("it",)).collect()}
    plain = {(r["cell"], r["it"]): (r["x0"], r["y0"], r["r2"]) for r in models.fit_fields(where.join(img, ["y", "x"]), ("cell", "it")).collect()}
    assert len(got) == 6 and all(got[k] == pytest.approx(plain[k], abs=1e-4) for k in plain) and got[3, 1] == got[7, 1]


def test_traces_of_shapes_are_dealt_to_cells(spark):
    """What is found by shape comes to each cell of the shape once, also where a shape has more cells than parcels."""
    from perievent.operators import maps

    of = spark.createDataFrame([(c, 3 if c % 2 else 4) for c in range(200)], "cell long, shape long")
    found = spark.createDataFrame([(s, f, s + f / 10) for s in (3, 4) for f in range(3)], "shape long, frame long, v double")
    got = sorted(map(tuple, maps.of_shapes(of, found).collect()))
    assert got == sorted((c, f, (3 if c % 2 else 4) + f / 10) for c in range(200) for f in range(3))


def test_correlations_by_distance_are_those_of_all_pairs(spark):
    """Missing samples, constant units, units of one sample and shared places, against every pair."""
    rng = random.Random(3)
    rows = [(k, c, s, 2.0 if c == 4 else rng.random()) for k in ("a", "b") for c in range(14) for s in range(5) if rng.random() < 0.7 or c < 3] + [("a", 20, 1, 0.5), ("a", 21, 1, None)]
    df = spark.createDataFrame(rows, "k string, cell long, s long, v double")
    p = spark.createDataFrame([(c, c * 7 % 20, c % 3) for c in range(22)], "cell long, x long, y long")
    found: dict = {}
    for k in ("a", "b"):
        of = {c: {r[2]: r[3] for r in rows if r[:2] == (k, c) and r[3] is not None} for c in range(22)}
        for a in range(22):
            for b in range(a + 1, 22):
                both = [(of[a][s], of[b][s]) for s in of[a].keys() & of[b].keys()]
                x, y = zip(*both) if both else ((), ())
                if len(set(x)) > 1 and len(set(y)) > 1:
                    d = math.hypot(a * 7 % 20 - b * 7 % 20, a % 3 - b % 3)
                    found.setdefault(math.floor(d / 4), []).append(np.corrcoef(x, y)[0, 1])
    got = maps.corr_by_distance(df, p, ("k",), "cell", "s", "v", 4)
    rows = {r["bin"]: (r["r"], r["n"]) for r in got.collect()}
    assert len(rows) > 3 and rows.keys() == found.keys() and all(rows[k] == pytest.approx((np.mean(v), len(v))) for k, v in found.items())


def test_queries_over_masks_fit_and_meet_shapes_only(spark, sf, monkeypatch):
    """Twice as many cells of the same masks: as many shapes are summed and met, and every cell has its rows."""
    from perievent.operators import retina

    twice = lambda spark, sf: (m := real(spark, sf)).unionByName(m.withColumn("cell", F.col("cell") + 1000))
    real, seen = maps.masks, []
    of_pairs = {(r["a"], r["b"]): r["distance"] for r in maps.h22(spark, sf).collect()}
    of_masks = {r["cell"]: tuple(r)[1:] for r in retina.n20_masks(spark, sf).collect()}
    shapes = maps.same_masks
    for m in (maps, retina):
        monkeypatch.setattr(m, "masks", twice)
        monkeypatch.setattr(m, "same_masks", lambda w: (seen.append((f := shapes(w))[1].select("shape").distinct().count()), f)[1])
    pairs, again = maps.h22(spark, sf).collect(), {r["cell"]: tuple(r)[1:] for r in retina.n20_masks(spark, sf).collect()}
    cells = real(spark, sf).select("cell").distinct().count()
    assert seen == [cells, cells] and len(pairs) == 4 * len(of_pairs) + cells
    assert all(r["distance"] == (of_pairs[min(a, b), max(a, b)] if (a := r["a"] % 1000) != (b := r["b"] % 1000) else 0.0) for r in pairs)
    assert len(again) == 2 * len(of_masks) and all(again[c] == pytest.approx(again[c + 1000], nan_ok=True) for c in of_masks)


def test_means_and_ranks_do_not_hang_on_the_order_of_rows(spark, sf):
    """Equal values in other orders have one mean; a value that each use makes a little different still gets its rank; a
    frame that is dealt to one place in all trials is a tie, as frequencies drawn in another order are."""
    from perievent.plans import views as V

    v = [0.1, 0.2, 0.3, 1e6 + 0.7, 0.4, -0.7]
    df = spark.createDataFrame([(c, x) for c, o in ((1, v), (2, v[::-1]), (3, v[2:] + v[:2])) for x in o] + [(4, float("nan")), (4, 1.0), (5, None)], "c int, v double").coalesce(1)
    m = {r["c"]: r["m"] for r in df.groupBy("c").agg(V.mean("v").alias("m")).collect()}
    assert m[1] == m[2] == m[3] == pytest.approx(sum(v) / 6) and math.isnan(m[4]) and m[5] is None
    noisy = spark.range(40).select((F.col("id") % 2).alias("k"), (F.col("id") + F.rand() * 1e-3).alias("v"))
    assert order.ranks(noisy.withColumn("v", F.udf(lambda x: x + random.random() * 1e-3, "double").asNondeterministic()("v")), ("k",), "v", "rank").count() == 40
    hi = [3.1, 7.3, 0.7, 9.9]
    frames = spark.createDataFrame([("a", t, f, x if f else x / 9) for t, x in enumerate(hi) for f in (0, 1)], "cell string, trial long, frame_ix long, value double")
    p = {r["frame_ix"]: r["p"] for r in drivers.frame_null(frames, ("cell",), 400, 4).collect()}
    assert p[1] == pytest.approx(1 / 8, abs=0.06) and p[0] == 1  # all four trials to one of two places: ties, and nothing else, reach the larger mean
    rng = random.Random(1)
    mags = spark.createDataFrame([(c, k, rng.random()) for c in range(40) for k in (1, 2, 3)], "cell long, k long, mag double")
    h = lambda c, it, j: __import__("hashlib").md5(f"9|{c}|{it}|{j}".encode()).hexdigest()[:8]
    of = {(r["cell"], r["k"]): r["mag"] for r in mags.collect()}
    for r in drivers.spectral_null(mags, ("cell",), 2, 30, 9).collect():
        c, drawn = r["cell"], [[int(h(r["cell"], it, j), 16) % 3 + 1 for j in (1, 2, 3)] for it in range(30)]
        share = lambda ks: of[c, ks[1]] / math.fsum(of[c, k] for k in ks)  # noqa: B023, E731
        assert r["p"] == pytest.approx(np.mean([share(ks) >= share([1, 2, 3]) - 1e-12 for ks in drawn]))
