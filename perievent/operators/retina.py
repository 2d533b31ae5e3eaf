"""Maps of the retina's image: each pixel's response to a periodic stimulus, smoothed maps, widths of a moving bar's field."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.operators.maps import masks, of_shapes, same_masks
from perievent.operators.metrics import _rounded as _r
from perievent.plans import views as V

#: Pixels of a tile's side.
TILE = 64


def blocks(frames: DataFrame, size: int) -> DataFrame:
    """frames (y, x, frame, value, ...) with the means of size x size pixels in the place of pixels."""
    rest = [c for c in frames.columns if c not in ("y", "x", "value")]
    at = lambda c: F.floor(F.col(c) / size).cast("long").alias(c)
    return frames.groupBy(at("y"), at("x"), *rest).agg(F.avg("value").alias("value"))


def mask_traces(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """cell, frame, value: the weighted means of frames (y, x, frame, value) under masks (cell, y, x, weight)."""
    met = frames.join(weights, ["y", "x"])
    return met.groupBy("cell", "frame").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def periodic_response(frames: DataFrame, keys: tuple[str, ...], period: float, least: int = 8) -> DataFrame:
    """keys, n, mean, slope, phase, magnitude, amplitude, share, r2: the response of each pixel (or mask: keys) of frames
    (keys, frame, value) at one frequency, a cycle being `period` frames.

    A pixel is ten running sums, which Spark merges from any parts of its frames; its trace is never put together. Of
    these follow the trend (a line, which is taken off), the Fourier term of what is left (phase in radians from -pi to
    pi, of cosine 0; magnitude; amplitude in the value's unit), its share of the power that is left, and R squared of a
    regression on cosine and sine. Missing frames are missing, a null value too; pixels of fewer than `least` frames have
    nulls, and so have constant ones for shares."""
    t, v = F.col("frame").cast("double"), F.col("value")
    c, s = F.cos(2 * math.pi / period * t), F.sin(2 * math.pi / period * t)
    parts = {"t": t, "v": v, "c": c, "s": s}
    pairs = ["tt", "tv", "tc", "ts", "vv", "vc", "vs", "cc", "cs", "ss"]
    sums = frames.filter(v.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"_{k}") for k, x in parts.items()], *[F.sum(parts[a] * parts[b]).alias(f"_{a}{b}") for a, b in pairs])

    def centred(a: str, b: str) -> Column:
        return F.col(f"_{a}{b}") - F.col(f"_{a}") * F.col(f"_{b}") / F.col("n")

    flat = sums.select(*keys, "n", (F.col("_v") / F.col("n")).alias("mean"), *[centred(a, b).alias(f"c{a}{b}") for a, b in pairs])
    some = lambda c: F.nullif(F.col(c), F.lit(0.0))
    free = lambda a, b: F.col(f"c{a}{b}") - F.col(f"ct{a}") * F.col(f"ct{b}") / some("ctt")  # noqa: E731  without the trend
    left = flat.select(*keys, "n", "mean", (F.col("ctv") / some("ctt")).alias("slope"), *[free(a, b).alias(f"f{a}{b}") for a, b in ("vv", "vc", "vs", "cc", "cs", "ss")], "cvv")
    det = F.col("fcc") * F.col("fss") - F.col("fcs") * F.col("fcs")
    fit = (F.col("fvc") * (F.col("fss") * F.col("fvc") - F.col("fcs") * F.col("fvs")) + F.col("fvs") * (F.col("fcc") * F.col("fvs") - F.col("fcs") * F.col("fvc"))) / F.nullif(det, F.lit(0.0))
    moves = F.col("fvv") > 1e-12 * (F.col("cvv") + F.col("n") * F.col("mean") * F.col("mean"))
    power = F.col("fvc") * F.col("fvc") + F.col("fvs") * F.col("fvs")
    enough = F.col("n") >= least
    when = lambda x, ok=F.lit(True): F.when(enough & ok, x)
    return left.select(*keys, "n", when(F.col("mean")).alias("mean"), when(F.col("slope")).alias("slope"), when(F.atan2(-F.col("fvs"), F.col("fvc")), moves).alias("phase"), when(F.sqrt(power)).alias("magnitude"), when(2 * F.sqrt(power) / F.col("n")).alias("amplitude"), when(2 * power / F.col("n") / some("fvv"), moves).alias("share"), when(fit / some("fvv"), moves & (det > 1e-9)).alias("r2"))


def smoothed_map(pixels: DataFrame, keys: tuple[str, ...], sigma: float, um_y: float, um_x: float, height: int, width: int, circular: bool = True, least: float = 0.2) -> DataFrame:
    """keys, y, x, value, strength of pixels (keys, y, x, value): a map smoothed by a gaussian of `sigma` micrometres, cut at
    three deviations on each axis, a pixel being um_y by um_x micrometres.

    Missing pixels have no weight and are filled from their neighbours: every place of the height x width image whose
    known neighbours have a share of `least` or more of the whole kernel has a row. Circular values (radians) are smoothed
    as sines and cosines, so the seam at pi is none; strength is their mean's length (of others the share of the
    kernel). Tiles with a margin of the kernel's reach go to tasks; a pixel goes to the tiles whose margin it is in.
    Several values of a pixel count as their mean direction, or mean."""
    ry, rx = math.ceil(3 * sigma / um_y), math.ceil(3 * sigma / um_x)
    if max(ry, rx) > TILE:
        raise ValueError(f"a kernel that reaches over {TILE} pixels")
    kernel = [np.exp(-((np.arange(-r, r + 1) * um) ** 2) / (2 * sigma**2)) for r, um in ((ry, um_y), (rx, um_x))]
    known = pixels.filter(F.col("value").isNotNull() & F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    parts = {"a": F.avg(F.cos("value")), "b": F.avg(F.sin("value"))} if circular else {"a": F.avg("value"), "b": F.lit(0.0)}
    one = known.groupBy(*keys, "y", "x").agg(*[c.alias(f"_{k}") for k, c in parts.items()])
    tiles = lambda c, r: F.explode(F.sequence(F.floor((F.col(c) - r) / TILE), F.floor((F.col(c) + r) / TILE)))
    spread = one.withColumn("_ty", tiles("y", ry)).withColumn("_tx", tiles("x", rx)).filter(f"_ty between 0 and {(height - 1) // TILE} and _tx between 0 and {(width - 1) // TILE}")
    shape = T.StructType([*spread.select(*keys).schema.fields, *(T.StructField(c, T.LongType()) for c in ("y", "x")), *(T.StructField(c, T.DoubleType()) for c in ("value", "strength"))])

    def along(m: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
        return np.tensordot(np.lib.stride_tricks.sliding_window_view(m, len(k), axis=axis), k, axes=([2], [0]))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(g["_ty"].iloc[0]) * TILE, int(g["_tx"].iloc[0]) * TILE
        h, w = min(TILE, height - y0), min(TILE, width - x0)
        layers = np.zeros((3, h + 2 * ry, w + 2 * rx))
        at = (g["y"].to_numpy(dtype=int) - y0 + ry, g["x"].to_numpy(dtype=int) - x0 + rx)
        ok = (at[0] < h + 2 * ry) & (at[1] < w + 2 * rx)
        for k, v in enumerate((np.ones(len(g)), g["_a"].to_numpy(), g["_b"].to_numpy())):
            layers[k][at[0][ok], at[1][ok]] = v[ok]
        weight, a, b = (along(along(x, kernel[0], 0), kernel[1], 1) for x in layers)
        y, x = np.nonzero(weight >= least * kernel[0].sum() * kernel[1].sum() - 1e-12)
        weight, a, b = weight[y, x], a[y, x], b[y, x]
        out = pd.DataFrame({"y": y + y0, "x": x + x0, "value": np.arctan2(b, a) if circular else a / weight, "strength": np.hypot(a, b) / weight if circular else weight / kernel[0].sum() / kernel[1].sum()})
        for c in keys:
            out[c] = g[c].iloc[0]
        return out[shape.names]

    return spread.groupBy(*keys, "_ty", "_tx").applyInPandas(run, shape)


def gaussians(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """offset + amp exp(-(x - mu)^2 / 2 sigma^2) for each row of p (amp, mu, sigma, offset)."""
    return p[:, 3:] + p[:, :1] * np.exp(-(((x - p[:, 1:2]) / p[:, 2:3]) ** 2) / 2)


def moments_start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where a fit of a gaussian begins: height over the lower quartile, mean and deviation of what is over it."""
    base = np.quantile(y, 0.25, axis=1, keepdims=True)
    over = np.maximum(y - base, 0)
    total = np.maximum(over.sum(axis=1, keepdims=True), 1e-300)
    mu = (over * x).sum(axis=1, keepdims=True) / total
    sd = np.sqrt(np.maximum((over * (x - mu) ** 2).sum(axis=1, keepdims=True) / total, 1e-6))
    return np.hstack([y.max(axis=1, keepdims=True) - base, mu, np.maximum(sd, (x[-1] - x[0]) / 100), base])


def fit_gaussians(x: np.ndarray, y: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """Damped least squares of one gaussian for each row of y, all rows at once, from two starts (moments, and the peak);
    parameters (amp, mu, sigma, offset) and R squared (nan for constant rows). mu stays within x, sigma between half a step
    and the range."""
    step, span = x[1] - x[0], x[-1] - x[0]
    low = np.array([-np.inf, x[0], step / 2, -np.inf])
    high = np.array([np.inf, x[-1], span, np.inf])
    first = moments_start(x, y)
    second = first.copy()
    second[:, 1], second[:, 2] = x[y.argmax(axis=1)], span / 8
    best, least = None, None
    for start in (first, second):
        p = np.clip(start, low, high)
        damp = np.full(len(y), 1e-2)
        r = y - gaussians(x, p)
        sse = (r * r).sum(axis=1)
        for _ in range(rounds):
            z = (x - p[:, 1:2]) / p[:, 2:3]
            e = np.exp(-z * z / 2)
            j = np.stack([e, p[:, :1] * e * z / p[:, 2:3], p[:, :1] * e * z * z / p[:, 2:3], np.ones_like(e)], axis=2)
            a, g = np.einsum("nti,ntj->nij", j, j), np.einsum("nti,nt->ni", j, r)
            d = np.einsum("nii->ni", a)
            q = np.clip(p + np.linalg.solve(a + damp[:, None, None] * (d[:, :, None] + 1e-9) * np.eye(4), g[:, :, None])[:, :, 0], low, high)
            s = ((t := y - gaussians(x, q)) ** 2).sum(axis=1)
            ok = s < sse
            if not ok.any() and (damp > 1e6).all():
                break
            p, r, sse = np.where(ok[:, None], q, p), np.where(ok[:, None], t, r), np.where(ok, s, sse)
            damp = np.where(ok, damp / 3, np.minimum(damp * 4, 1e8))
        if best is None:
            best, least = p, sse
        else:
            best, least = np.where((sse < least)[:, None], p, best), np.minimum(sse, least)
    total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    return best, np.where(total > 1e-300, 1 - least / np.where(total > 1e-300, total, 1), np.nan)


def cycle_fits(traces: DataFrame, keys: tuple[str, ...], period: int, degrees: float) -> DataFrame:
    """keys, cycle, amp, centre, width (full width at half height), offset, r2 of traces (keys, frame, value): a moving bar
    crosses `degrees` in `period` frames, and each cycle's response is fitted by a gaussian over the bar's place, all cycles
    of an Arrow batch at once. Cycles that miss a frame, or repeat one, have no row; constant ones have a null r2."""
    cut = traces.filter("value is not null").select(*keys, F.floor(F.col("frame") / period).cast("long").alias("cycle"), (F.col("frame") % period).alias("at"), "value")
    rows = cut.groupBy(*keys, "cycle").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v"), F.count_distinct("at").alias("d")).filter((F.size("v") == period) & (F.col("d") == period))
    rows = rows.select(*keys, "cycle", F.transform("v", lambda s: s.value.cast("double")).alias("v"))
    names = ["amp", "centre", "sigma", "offset", "r2"]
    x = np.arange(period) * degrees / period

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p, r2 = fit_gaussians(x, b.column("v").flatten().to_numpy().reshape(b.num_rows, period))
                columns = [*b.columns[:-1], *(pa.array(p[:, i]) for i in range(4)), pa.array(r2, mask=np.isnan(r2))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "cycle", *names])

    shape = T.StructType([*rows.select(*keys, "cycle").schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
    return rows.mapInArrow(run, shape).select(*keys, "cycle", "amp", "centre", (F.col("sigma") * 2 * math.sqrt(2 * math.log(2))).alias("width"), "offset", "r2")


def field_sizes(fits: DataFrame, keys: tuple[str, ...], least_r2: float, low: float, high: float) -> DataFrame:
    """keys, n_cycles, n_good, width, sd, centre: mean width of the cycles that pass (r2, a positive response, a width from
    low to high degrees), their deviation and mean place."""
    good = (F.col("r2") >= least_r2) & (F.col("amp") > 0) & F.col("width").between(low, high)
    of = lambda f, c: f(F.when(good, F.col(c)))
    return fits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cycles"), F.sum(F.coalesce(good, F.lit(False)).cast("long")).alias("n_good"), of(F.avg, "width").alias("width"), of(F.stddev_samp, "width").alias("sd"), of(F.avg, "centre").alias("centre"))


def screen_bounds(points: DataFrame, keys: tuple[str, ...], low: float, high: float, bins: int) -> DataFrame:
    """keys, peak, from, to of points (keys, value, weight): the fullest of `bins` equal bins of the screen from low to
    high (the first on ties), and the nearest bins on both sides whose weight is least before it rises again, clipped to
    the screen. Centres of bins; points off the screen don't count; a key without any has no row. A key is its bins."""
    step = (high - low) / bins
    on = points.filter(F.col("value").between(low, high) & (F.col("weight") > 0))
    counts = on.groupBy(*keys, F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / step)).cast("int").alias("bin")).agg(F.sum("weight").alias("w"))
    all_of = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "w"))).alias("m"))
    w = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    d = all_of.select(*keys, w.alias("w")).withColumn("top", (F.array_position("w", F.array_max("w")) - 1).cast("int"))
    walk = lambda far, next_: F.aggregate(far, F.struct(F.col("top").alias("at"), F.lit(True).alias("falls")), lambda s, i: F.when(s.falls & (F.get("w", i) <= F.get("w", s["at"])), F.struct(i.alias("at"), F.lit(True).alias("falls"))).otherwise(F.struct(s["at"].alias("at"), F.lit(False).alias("falls"))))["at"]
    none = F.array().cast("array<int>")
    left = F.when(F.col("top") > 0, F.sequence(F.col("top") - 1, F.lit(0), F.lit(-1))).otherwise(none)
    right = F.when(F.col("top") < bins - 1, F.sequence(F.col("top") + 1, F.lit(bins - 1))).otherwise(none)
    centre = lambda i: F.lit(low) + (i + 0.5) * step
    return d.select(*keys, centre(F.col("top")).alias("peak"), centre(walk(left, -1)).alias("from"), centre(walk(right, 1)).alias("to"))


def _frames(spark, sf) -> DataFrame:
    return V.grid(spark, sf, 8)


def n20_pixels(spark, sf):
    return _r(periodic_response(_frames(spark, sf), ("y", "x"), 6.0))


def n20_blocks(spark, sf):
    return _r(periodic_response(blocks(_frames(spark, sf), 2), ("y", "x"), 6.0).filter("n >= 8"))


def n20_masks(spark, sf):
    """The same of masks' traces, on the larger image; cells of the same mask share them."""
    of, shapes = same_masks(masks(spark, sf).select("cell", "y", "x", "weight"))
    found = periodic_response(mask_traces(V.grid(spark, sf), shapes.withColumnRenamed("shape", "cell")), ("cell",), 5.0, 5)
    return _r(of_shapes(of, found.withColumnRenamed("cell", "shape")))


def _phases(spark, sf) -> DataFrame:
    """A phase map of 32 x 32 pixels for each frame, with holes."""
    return V.grid(spark, sf, 32).filter(F.floor("value").cast("long") % 5 != 0).select("frame", "y", "x", (F.floor("value") % 628 / 100 - 3.14).alias("value"))


def n21_circular(spark, sf):
    return _r(smoothed_map(_phases(spark, sf), ("frame",), 30.0, 25.0, 40.0, 32, 32))


def n21_gaussian(spark, sf):
    return _r(smoothed_map(_phases(spark, sf), ("frame",), 20.0, 25.0, 40.0, 32, 32, circular=False, least=0.5))


def i10_cycles(spark, sf):
    """Widths of the fields that each cell's cycles of ten frames give, those that pass."""
    fits = cycle_fits(V.traces(spark, sf).select("cell", "frame", "value"), ("cell",), 10, 60.0)
    return _r(field_sizes(fits, ("cell",), 0.5, 2.0, 60.0))


def i10_passing(spark, sf):
    """Every cycle's fit."""
    return _r(cycle_fits(V.traces(spark, sf).select("cell", "frame", "value"), ("cell",), 10, 60.0))


def n22_bounds(spark, sf):
    """Where the quantity-weighted density of prices peaks, and the minima beside, by area."""
    p = V.recordings(spark, sf).select("area", F.col("response").alias("value"), F.col("quantity").alias("weight"))
    return _r(screen_bounds(p, ("area",), 0.0, 100000.0, 25))


_SUMS = "count(*) AS n, sum(t) AS t, sum(v) AS v, sum(c) AS c, sum(s) AS s, sum(t * t) AS tt, sum(t * v) AS tv, sum(t * c) AS tc, sum(t * s) AS ts, sum(v * v) AS vv, sum(v * c) AS vc, sum(v * s) AS vs, sum(c * c) AS cc, sum(c * s) AS cs, sum(s * s) AS ss"


def _periodic_sql(frames: str, keys: str, period: float, least: int) -> str:
    """frames: SQL of a table fr of keys, frame, value."""
    centre = ", ".join(f"{a}{b} - {a} * {b} / n AS c{a}{b}" for a, b in ("tt", "tv", "tc", "ts", "vv", "vc", "vs", "cc", "cs", "ss"))
    free = ", ".join(f"c{a}{b} - ct{a} * ct{b} / ctt AS f{a}{b}" for a, b in ("vv", "vc", "vs", "cc", "cs", "ss"))
    w = f"n >= {least}"
    m = f"{w} AND fvv > 1e-12 * (cvv + n * mean * mean)"
    return f"""WITH {frames}, p AS (SELECT {keys}, CAST(frame AS DOUBLE) AS t, value AS v, cos(2 * pi() / {period} * frame) AS c, sin(2 * pi() / {period} * frame) AS s FROM fr), a AS (SELECT {keys}, {_SUMS} FROM p GROUP BY {keys}),
b AS (SELECT {keys}, n, v / n AS mean, {centre} FROM a), d AS (SELECT {keys}, n, mean, ctv / nullif(ctt, 0) AS slope, cvv, {free.replace("/ ctt", "/ nullif(ctt, 0)")} FROM b)
SELECT {keys}, n, round(CASE WHEN {w} THEN mean END, 6) AS mean, round(CASE WHEN {w} THEN slope END, 6) AS slope, round(CASE WHEN {m} THEN atan2(-fvs, fvc) END, 6) AS phase, round(CASE WHEN {w} THEN sqrt(fvc * fvc + fvs * fvs) END, 6) AS magnitude, round(CASE WHEN {w} THEN 2 * sqrt(fvc * fvc + fvs * fvs) / n END, 6) AS amplitude,
round(CASE WHEN {m} THEN 2 * (fvc * fvc + fvs * fvs) / n / fvv END, 6) AS share, round(CASE WHEN {m} AND fcc * fss - fcs * fcs > 1e-9 THEN (fvc * (fss * fvc - fcs * fvs) + fvs * (fcc * fvs - fcs * fvc)) / (fcc * fss - fcs * fcs) / fvv END, 6) AS r2 FROM d"""


_FR8 = "fr AS (SELECT (o_orderkey // 8) % 8 AS y, o_orderkey % 8 AS x, o_orderkey // 64 AS frame, o_totalprice AS value FROM orders)"
_PH = "ph AS (SELECT o_orderkey // 1024 AS frame, (o_orderkey // 32) % 32 AS y, o_orderkey % 32 AS x, floor(o_totalprice) % 628 / 100 - 3.14 AS value FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 5 <> 0)"


def _smooth_sql(sigma: float, circular: bool, least: float) -> str:
    ry, rx = math.ceil(3 * sigma / 25), math.ceil(3 * sigma / 40)
    value, strength = ("atan2(b, a)", "sqrt(a * a + b * b) / w") if circular else ("a / w", "w / full_w")
    a, b = ("avg(cos(value))", "avg(sin(value))") if circular else ("avg(value)", "0.0")
    return f"""WITH {_PH}, one AS (SELECT frame, y, x, {a} AS a, {b} AS b FROM ph GROUP BY ALL), k AS (SELECT dy, dx, exp(-((dy * 25.0) ** 2 + (dx * 40.0) ** 2) / (2 * {sigma} ** 2)) AS k FROM range(-{ry}, {ry + 1}) p(dy), range(-{rx}, {rx + 1}) q(dx)),
s AS (SELECT frame, y + dy AS y, x + dx AS x, sum(k) AS w, sum(a * k) AS a, sum(b * k) AS b FROM one, k WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31 GROUP BY ALL), f AS (SELECT sum(k) AS full_w FROM k)
SELECT frame, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round({value}, 6) AS value, round({strength}, 6) AS strength FROM s, f WHERE w >= {least} * full_w - 1e-12"""


QUERIES = {"n20_pixels": n20_pixels, "n20_blocks": n20_blocks, "n20_masks": n20_masks, "n21_circular_map": n21_circular, "n21_gaussian_map": n21_gaussian, "i10_cycle_widths": i10_cycles, "i10_cycle_fits": i10_passing, "n22_screen_bounds": n22_bounds}
SQL = {
    "n20_pixels": _periodic_sql(_FR8, "y, x", 6.0, 8),
    "n20_blocks": f"SELECT * FROM ({_periodic_sql(_FR8.replace('fr AS', 'f0 AS') + ', fr AS (SELECT y // 2 AS y, x // 2 AS x, frame, avg(value) AS value FROM f0 GROUP BY ALL)', 'y, x', 6.0, 8)}) WHERE n >= 8",
    "n20_masks": _periodic_sql(f"{V.GRID}, m AS (SELECT s_suppkey AS cell, s_suppkey * 3 % 50 + dy AS y, s_suppkey * 2 % 50 + dx AS x, (dy + dx + 1) / 9 AS weight FROM supplier, range(5) a(dy), range(5) b(dx)), fr AS (SELECT cell, frame, sum(value * weight) / sum(weight) AS value FROM grid JOIN m USING (y, x) GROUP BY ALL)", "cell", 5.0, 5),
    "n21_circular_map": _smooth_sql(30.0, True, 0.2),
    "n21_gaussian_map": _smooth_sql(20.0, False, 0.5),
    "n22_screen_bounds": f"""WITH {V.REC}, c AS (SELECT area, CAST(least(24, floor(response / 4000)) AS INT) AS bin, sum(quantity) AS w FROM rec WHERE response BETWEEN 0 AND 100000 AND quantity > 0 GROUP BY ALL),
f AS (SELECT a.area, CAST(i AS INT) AS bin, coalesce((SELECT w FROM c WHERE c.area = a.area AND c.bin = i), 0) AS w FROM (SELECT DISTINCT area FROM c) a, range(25) t(i)),
t AS (SELECT area, min(bin) AS top FROM f WHERE w = (SELECT max(w) FROM f g WHERE g.area = f.area) GROUP BY area),
r AS (SELECT f.area, top, bin, w > lag(w) OVER (PARTITION BY f.area ORDER BY bin) AS up, w > lead(w) OVER (PARTITION BY f.area ORDER BY bin) AS down FROM f JOIN t USING (area))
SELECT area, CAST((top + 0.5) * 4000 AS DOUBLE) AS peak, CAST((coalesce(max(bin) FILTER (bin < top AND down) + 1, 0) + 0.5) * 4000 AS DOUBLE) AS "from", CAST((coalesce(min(bin) FILTER (bin > top AND up) - 1, 24) + 0.5) * 4000 AS DOUBLE) AS "to" FROM r GROUP BY area, top""",
}
