"""Small numpy solvers for one group's data: curve fits, linear classifiers, assignments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def fit_curve(f: Callable, x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Damped least squares of y = f(x, *p) within bounds. Returns the parameters and R squared (nan for constant y).
    A step that doesn't lower the squares raises the damping; fifteen such steps in a row end the fit."""
    p, damp, stuck = np.clip(np.asarray(start, dtype=float), low, high), 1e-2, 0
    residual = y - f(x, *p)
    best = float(residual @ residual)
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        jac = np.stack([(f(x, *(p + h * (np.arange(len(p)) == k))) - f(x, *p)) / h[k] for k in range(len(p))], axis=1)
        a, g = jac.T @ jac, jac.T @ residual
        moved = False
        while stuck < 15:
            step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
            q = np.clip(p + step, low, high)
            r = y - f(x, *q)
            if (s := float(r @ r)) < best:
                moved, done = True, best - s < 1e-12 * (best + 1e-300)
                p, residual, best, damp, stuck = q, r, s, damp / 3, 0
                break
            damp, stuck = damp * 4, stuck + 1
        if not moved or done:
            break
    total = float(((y - y.mean()) ** 2).sum())
    return p, 1 - best / total if total > 0 else float("nan")


def fit_curves(f: Callable, x: np.ndarray, y: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """fit_curve for each row of y at once: f(x, p) has a curve for each row of p. start, low and high have a row a curve."""
    p, damp = np.clip(start, low, high), np.full(len(y), 1e-2)
    v = f(x, p)
    best = ((y - v) ** 2).sum(axis=1)
    eye = np.eye(p.shape[1])
    for _ in range(rounds):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        j = np.stack([(f(x, p + h * eye[k]) - v) / h[:, k : k + 1] for k in range(p.shape[1])], axis=2)
        a, g = np.einsum("nti,ntj->nij", j, j), np.einsum("nti,nt->ni", j, y - v)
        d = np.einsum("nii->ni", a)
        q = np.clip(p + np.linalg.solve(a + (damp[:, None] * d + 1e-9 * (1 + d.max(axis=1, keepdims=True)))[:, :, None] * eye, g[:, :, None])[:, :, 0], low, high)
        w = f(x, q)
        s = ((y - w) ** 2).sum(axis=1)
        ok = s < best
        if not ok.any() and (damp > 1e7).all():
            break
        p, v, best = np.where(ok[:, None], q, p), np.where(ok[:, None], w, v), np.where(ok, s, best)
        damp = np.where(ok, damp / 3, np.minimum(damp * 4, 1e9))
    total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return p, np.where(total > 0, 1 - best / np.where(total > 0, total, 1), np.nan)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 60, seed: int = 0) -> np.ndarray:
    """Weights (the last one the shift) of a linear support vector machine, labels -1 and 1, by dual coordinate descent
    on the squared hinge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, a, diag = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] / (2 * c)
            new = max(0.0, a[i] - g / diag[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                most = max(most, abs(new - a[i]))
                a[i] = new
        if most < 1e-5:
            break
    return w


def standardized(train: np.ndarray, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, s = train.mean(axis=0), train.std(axis=0)
    s = np.where(s > 0, s, 1.0)
    return (train - m) / s, (test - m) / s


def svm_score(train: np.ndarray, train_y: np.ndarray, test: np.ndarray, test_y: np.ndarray, c: float = 1.0) -> float:
    """The share of test rows that a machine trained on the others gets right; nan where a class is missing."""
    if len(test) == 0 or len(set(train_y.tolist())) < 2:
        return float("nan")
    a, b = standardized(train, test)
    w = linear_svm(a, train_y, c)
    return float((np.where(b @ w[:-1] + w[-1] > 0, 1, -1) == test_y).mean())


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Weights and shift (last) of a ridge regression; the shift isn't penalized."""
    m, t = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - t))
    return np.append(w, t - m @ w)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one matching of rows to columns with the least total cost: rows enter one by one along shortest
    augmenting paths over reduced costs."""
    flip = cost.shape[0] > cost.shape[1]
    c = np.asarray(cost.T if flip else cost, dtype=float)
    n, m = c.shape
    row_of, price_r, price_c = np.full(m, -1), np.zeros(n), np.zeros(m)
    for start in range(n):
        dist, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        row, reach, last = start, 0.0, -1
        while True:
            slack = reach + c[row] - price_r[row] - price_c
            better = ~done & (slack < dist)
            dist[better], came[better] = slack[better], last
            at = int(np.argmin(np.where(done, np.inf, dist)))
            reach, done[at], last = dist[at], True, at
            if row_of[at] < 0:
                break
            row = row_of[at]
        for j in np.flatnonzero(done):
            if j != last:
                price_r[row_of[j]] += reach - dist[j]
                price_c[j] -= reach - dist[j]
        price_r[start] += reach
        while last >= 0:
            before = came[last]
            row_of[last] = start if before < 0 else row_of[before]
            last = before
    return sorted((int(j), int(r)) if flip else (int(r), int(j)) for j, r in enumerate(row_of) if r >= 0)


def double_gaussian(theta: np.ndarray, pref: float, sigma: float, r1: float, r2: float, offset: float) -> np.ndarray:
    """Two bumps a half turn apart over directions in degrees."""
    apart = lambda d: np.abs((d + 180) % 360 - 180)
    return offset + r1 * np.exp(-(apart(theta - pref) ** 2) / (2 * sigma**2)) + r2 * np.exp(-(apart(theta + 180 - pref) ** 2) / (2 * sigma**2))


def gaussian_2d(yx: np.ndarray, amp: float, x0: float, y0: float, sx: float, sy: float, theta: float, offset: float) -> np.ndarray:
    """A rotated Gaussian over points (y, x)."""
    dy, dx = yx[:, 0] - y0, yx[:, 1] - x0
    u, v = dx * np.cos(theta) + dy * np.sin(theta), -dx * np.sin(theta) + dy * np.cos(theta)
    return offset + amp * np.exp(-(u**2) / (2 * sx**2) - v**2 / (2 * sy**2))


def weibull(x: np.ndarray, scale: float, shape: float, guess: float, lapse: float) -> np.ndarray:
    return guess + (1 - guess - lapse) * (1 - np.exp(-((np.maximum(x, 0) / scale) ** shape)))


def lowess(y: np.ndarray, frac: float) -> np.ndarray:
    """Local linear regression at each of evenly spaced points over its nearest share of points, tricube weights."""
    n = len(y)
    k = min(n, max(2, int(round(frac * n))))
    x, out = np.arange(n, dtype=float), np.empty(n)
    for i in range(n):
        lo = min(max(0, i - k // 2), n - k)
        while lo > 0 and i - (lo - 1) < (lo + k - 1) - i:
            lo -= 1
        while lo + k < n and (lo + k) - i < i - lo:
            lo += 1
        d = np.abs(x[lo : lo + k] - i)
        w = (1 - np.minimum(1, d / (d.max() * 1.0001 + 1e-12)) ** 3) ** 3
        sw, sx, sy = w.sum(), (w * x[lo : lo + k]).sum(), (w * y[lo : lo + k]).sum()
        mx, my = sx / sw, sy / sw
        sxx = (w * (x[lo : lo + k] - mx) ** 2).sum()
        slope = (w * (x[lo : lo + k] - mx) * (y[lo : lo + k] - my)).sum() / sxx if sxx > 1e-12 else 0.0
        out[i] = my + slope * (i - mx)
    return out


def ellipses(x0: np.ndarray, y0: np.ndarray, a: np.ndarray, b: np.ndarray, theta: np.ndarray, n: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Polygons of n corners, one a row, of ellipses with half axes a and b, the first at theta (radians)."""
    t = np.arange(n) * (2 * np.pi / n)
    u, v = a[:, None] * np.cos(t), b[:, None] * np.sin(t)
    c, s = np.cos(theta)[:, None], np.sin(theta)[:, None]
    return x0[:, None] + u * c - v * s, y0[:, None] + u * s + v * c


def polygon_area(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)) / 2


def clipped(x: np.ndarray, y: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons cut to where `beyond` (a linear measure at each corner) isn't positive. Corners that are cut off
    turn into copies of the corner before, so that all rows stay equally long; a polygon that is cut off whole is one
    point."""
    inside = beyond <= 0
    after = np.roll(beyond, -1, axis=1)
    crosses = inside != (after <= 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(crosses, beyond / (beyond - after), 0.0)
    both = lambda p, q: np.stack([p, q], axis=2).reshape(len(p), -1)
    cx, cy = x + t * (np.roll(x, -1, axis=1) - x), y + t * (np.roll(y, -1, axis=1) - y)
    valid = both(inside, crosses)
    at = np.maximum.accumulate(np.where(valid, np.arange(valid.shape[1]), -1), axis=1)
    at = np.where(at < 0, np.maximum(at[:, -1:], 0), at)
    return np.take_along_axis(both(x, cx), at, axis=1), np.take_along_axis(both(y, cy), at, axis=1)


def area_in_box(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Area of each convex polygon within its box."""
    for edge, axis, sign in ((left, 0, -1), (right, 0, 1), (low, 1, -1), (high, 1, 1)):
        x, y = clipped(x, y, sign * ((x, y)[axis] - edge[:, None]))
    return polygon_area(x, y)
