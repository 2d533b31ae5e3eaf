"""Periodic responses, smoothed maps, fields of a moving bar: planted values and plain versions."""

import math

import numpy as np
import pytest

from perievent.operators import retina as R


def test_periodic_response_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for p in range(6):
        t = np.sort(rng.choice(200, 150, replace=False)).astype(float)
        v = 500 + 0.3 * t + (p + 1) * np.cos(2 * np.pi / 12.5 * t - p) + rng.standard_normal(150)
        line = np.polynomial.polynomial.polyfit(t, v, 1)
        free = v - np.polynomial.polynomial.polyval(t, line)
        x = np.stack([np.ones_like(t), t, np.cos(2 * np.pi / 12.5 * t), np.sin(2 * np.pi / 12.5 * t)], axis=1)
        fit = x @ np.linalg.lstsq(x, v, rcond=None)[0]
        term = (free * np.exp(-2j * np.pi / 12.5 * t)).sum()
        want[p] = (150, v.mean(), line[1], np.angle(term), abs(term), 2 * abs(term) / 150, 2 * abs(term) ** 2 / 150 / (free**2).sum(), 1 - ((v - fit) ** 2).sum() / (free**2).sum())
        rows += [(p, int(a), float(b)) for a, b in zip(t, v)]
    rows += [(9, i, 7.0) for i in range(20)] + [(10, 0, 1.0), (11, 3, None)]
    got = {r["p"]: tuple(r)[1:] for r in R.periodic_response(spark.createDataFrame(rows, "p int, frame long, value double"), ("p",), 12.5).collect()}
    for p in want:
        assert got[p] == pytest.approx(want[p], rel=1e-6)
    assert abs(want[3][3] + 3) < 0.2  # the planted phase: a later maximum
    assert got[9][3] is None and got[9][6] is None and got[10][1:] == (None,) * 7 and 11 not in got


@pytest.mark.parametrize("circular", [True, False])
def test_smoothed_map_equals_a_plain_convolution(spark, circular, monkeypatch):
    monkeypatch.setattr(R, "TILE", 8)
    rng = np.random.default_rng(1)
    h, w, sigma, uy, ux = 19, 27, 12.0, 10.0, 15.0
    full = np.angle(np.exp(1j * (np.add.outer(np.arange(h) * 0.4, np.arange(w) * 0.2) + 2.5)))
    hole = rng.random((h, w)) < 0.3
    hole[3:14, 5:18] = True
    rows = [("m", y, x, float(full[y, x])) for y in range(h) for x in range(w) if not hole[y, x]] + [("m", 3, 3, None), ("m", 99, 0, 1.0)]
    got = {(r["y"], r["x"]): (r["value"], r["strength"]) for r in R.smoothed_map(spark.createDataFrame(rows, "k string, y long, x long, value double"), ("k",), sigma, uy, ux, h, w, circular, 0.3).collect()}
    ry, rx, seen = math.ceil(3 * sigma / uy), math.ceil(3 * sigma / ux), 0
    whole = sum(math.exp(-((dy * uy) ** 2 + (dx * ux) ** 2) / 2 / sigma**2) for dy in range(-ry, ry + 1) for dx in range(-rx, rx + 1))
    for y in range(h):
        for x in range(w):
            z = t = 0
            for dy in range(-ry, ry + 1):
                for dx in range(-rx, rx + 1):
                    a, b = y + dy, x + dx
                    if 0 <= a < h and 0 <= b < w and not hole[a, b]:
                        k = math.exp(-((dy * uy) ** 2 + (dx * ux) ** 2) / 2 / sigma**2)
                        t += k
                        z += k * (np.exp(1j * full[a, b]) if circular else full[a, b])
            if t >= 0.3 * whole:
                seen += 1
                want = (np.angle(z), abs(z) / t) if circular else (z / t, t / whole)
                assert abs(np.exp(1j * got[y, x][0]) - np.exp(1j * want[0])) < 1e-9 and got[y, x][1] == pytest.approx(want[1])
            else:
                assert (y, x) not in got
    assert seen == len(got) and any(hole[k] for k in got) and (8, 11) not in got
    if circular:  # the seam at pi: smoothing by plain means would give values near zero there
        seam = [(y, x) for y in range(h) for x in range(w) if abs(abs(full[y, x]) - math.pi) < 0.1 and (y, x) in got and got[y, x][1] > 0.9]
        assert seam and all(abs(got[k][0]) > 2 for k in seam)


def test_gaussians_are_recovered_all_at_once():
    rng = np.random.default_rng(2)
    x = np.arange(40) * 1.5
    p = np.column_stack([rng.uniform(2, 9, 200), rng.uniform(8, 50, 200), rng.uniform(2, 9, 200), rng.uniform(-3, 3, 200)])
    got, r2 = R.fit_gaussians(x, R.gaussians(x, p))
    assert (r2 > 0.999999).mean() > 0.97 and np.abs(got - p)[r2 > 0.999999].max() < 0.05
    assert np.isnan(R.fit_gaussians(x, np.ones((1, 40)))[1][0])


def test_widths_of_planted_fields(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell, sd in ((0, 3.0), (1, 6.0), (2, None)):
        for f in range(400):
            at = f % 40 * 1.5
            v = rng.standard_normal() * 0.1 + (8 * math.exp(-((at - 30) ** 2) / 2 / sd**2) if sd else 0)
            rows.append((cell, f, v))
    rows = [r for r in rows if r[:2] != (0, 17)]  # the first cycle of cell 0 misses a frame
    fits = R.cycle_fits(spark.createDataFrame(rows, "cell int, frame long, value double"), ("cell",), 40, 60.0)
    got = {r["cell"]: r for r in R.field_sizes(fits, ("cell",), 0.8, 1, 60).collect()}
    assert [got[c]["n_cycles"] for c in range(3)] == [9, 10, 10] and [got[c]["n_good"] for c in range(3)] == [9, 10, 0]
    for c, sd in ((0, 3.0), (1, 6.0)):
        assert got[c]["width"] == pytest.approx(2.3548 * sd, rel=0.02) and got[c]["centre"] == pytest.approx(30, abs=0.3)
    assert got[2]["width"] is None


def test_bounds_of_a_planted_density(spark):
    w = [5, 1, 0, 2, 8, 20, 9, 3, 3, 4]
    rows = [("a", i + 0.5, float(v)) for i, v in enumerate(w)] + [("a", -1.0, 99.0), ("b", 0.2, 1.0), ("c", 50.0, 1.0)]
    got = {r["k"]: tuple(r)[1:] for r in R.screen_bounds(spark.createDataFrame(rows, "k string, value double, weight double"), ("k",), 0.0, 10.0, 10).collect()}
    assert got == {"a": (5.5, 2.5, 8.5), "b": (0.5, 0.5, 9.5)}
