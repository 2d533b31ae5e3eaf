"""Fits and decoders: data are sampled and averaged by Spark; one group's solver runs in an Arrow grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.functions import numerics as N
from perievent.operators.joins import seeded_order
from perievent.operators.maps import image, masks, of_shapes, pair_corr, same_masks
from perievent.operators.metrics import _rounded as _r
from perievent.plans import views as V


def bootstrap_means(responses: DataFrame, draws: int, iterations: int, seed: int) -> DataFrame:
    """Mean responses of each cell, config and iteration over `draws` trials drawn with replacement by a seeded hash.
    Draws are made once a config, so that all cells of a config share its trials, as in a simultaneous recording."""
    trials = responses.select("config", "trial").distinct()
    trials = trials.withColumns({"k": F.row_number().over(W.partitionBy("config").orderBy("trial")) - 1, "n": F.count(F.lit(1)).over(W.partitionBy("config"))})
    picks = trials.select("config", "n").distinct().withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "config", "it", "draw")), 1, 8), 16, 10).cast("long")
    picks = picks.withColumn("k", h % F.col("n")).groupBy("config", "it", "k").agg(F.count(F.lit(1)).alias("times")).join(trials, ["config", "k"]).select("config", "it", "trial", "times")
    return responses.join(picks, ["config", "trial"]).groupBy("cell", "it", "config").agg((F.sum(F.col("response") * F.col("times")) / F.sum("times")).alias("response"))


def fit_orientation(means: DataFrame, degrees: float) -> DataFrame:
    """A double Gaussian fit of each cell and iteration's curve (its least taken off, as many points between): pref,
    sigma, r2, asi and dsi of the fitted curve. A fit with R squared below zero isn't counted as one (good is false)."""

    def fit(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("config")
        theta, y = g["config"].to_numpy() * degrees, g["response"].to_numpy() - g["response"].min()
        fine = np.arange(0, 360, degrees / 3)
        v = np.interp(fine, np.append(theta, theta[0] + 360), np.append(y, y[0]))
        top = fine[v.argmax()]
        p, r2 = N.fit_curve(N.double_gaussian, fine, v, np.array([top, 30.0, v.max(), v.max() / 2, 0.0]), np.array([top - 90, 10, 0, 0, 0]), np.array([top + 90, 120, 3 * v.max() + 1e-9, 3 * v.max() + 1e-9, v.max() + 1e-9]))
        c = N.double_gaussian(fine, *p)
        c = c - c.min()
        t = np.radians(fine)
        vector = lambda k: float(abs((c * np.exp(1j * k * t)).sum()) / c.sum()) if c.sum() > 0 else float("nan")
        return pd.DataFrame({"cell": [keys[0]], "it": [keys[1]], "pref": [p[0] % 360], "sigma": [p[1]], "r2": [r2], "asi": [vector(2)], "dsi": [vector(1)], "good": [bool(r2 >= 0)]})

    return means.groupBy("cell", "it").applyInPandas(fit, "cell long, it int, pref double, sigma double, r2 double, asi double, dsi double, good boolean")


def fit_fields(pixels: DataFrame, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """A rotated Gaussian fit of each key's map (keys, y, x, v), starting at its largest pixel."""
    kinds = dict(pixels.dtypes)

    def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        yx, v = g[["y", "x"]].to_numpy(float), g["v"].to_numpy(float)
        at = yx[v.argmax()]
        p, r2 = N.fit_curve(N.gaussian_2d, yx, v, np.array([np.ptp(v), at[1], at[0], 2.0, 2.0, 0.1, v.min()]), np.array([0, yx[:, 1].min(), yx[:, 0].min(), 0.5, 0.5, -np.pi, -1e9]), np.array([1e9, yx[:, 1].max(), yx[:, 0].max(), 20, 20, np.pi, 1e9]))
        return pd.DataFrame([[*key, *p.tolist(), r2]], columns=[*keys, "amp", "x0", "y0", "sigma_x", "sigma_y", "theta", "offset", "r2"])

    return pixels.groupBy(*keys).applyInPandas(fit, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", amp double, x0 double, y0 double, sigma_x double, sigma_y double, theta double, offset double, r2 double")


def fit_masks(where: DataFrame, maps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """fit_fields of each cell's pixels (cell, y, x) of each key's map (keys, y, x, v). Cells of the same pixels have the same
    fit, which is made once."""
    of, shapes = same_masks(where)
    fits = fit_fields(shapes.join(maps, ["y", "x"]), ("shape", *keys))
    return of.join(fits, "shape").drop("shape")


def vectors(responses: DataFrame) -> DataFrame:
    """One row a trial: config and the responses of all cells in the cells' order."""
    v = F.sort_array(F.collect_list(F.struct("cell", "response")))
    return responses.groupBy("trial", "config").agg(v.alias("v")).select("trial", "config", F.transform("v", lambda s: s.response).alias("x"))


def decode(trials: DataFrame, iterations: int, seed: int, held_out: float = 0.2, by: tuple[str, ...] = (), c: float = 0.1) -> DataFrame:
    """Scores of linear machines that tell trials' two configs apart: trials (by, trial, config, x). Each iteration and
    condition (data; shuffled labels) is a group of its own: configs in equal numbers, split by seeded order."""
    t = trials.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    w = W.partitionBy(*by, "it", "config").orderBy(seeded_order(seed, "it", "trial"), "trial")
    t = t.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy(*by, "it", "config"))})
    t = t.withColumn("least", F.min("n").over(W.partitionBy(*by, "it"))).filter("k <= least")
    t = t.withColumn("test", F.col("k") <= F.ceil(F.col("least") * held_out)).withColumn("condition", F.explode(F.array(F.lit("data"), F.lit("shuffled"))))
    t = t.withColumn("place", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("label"), "it", "trial")), 1, 8), 16, 10).cast("long"))

    def score(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("trial")
        y = np.where(g["config"] == g["config"].min(), -1, 1)
        if keys[-1] == "shuffled":
            y = y[np.argsort(g["place"].to_numpy(), kind="stable")]
        x, test = np.stack(g["x"].to_numpy()).astype(float), g["test"].to_numpy(bool)
        return pd.DataFrame([[*keys, N.svm_score(x[~test], y[~test], x[test], y[test], c), int(test.sum())]], columns=[*by, "it", "condition", "score", "n_test"])

    kinds = dict(trials.dtypes)
    shape = ", ".join([*(f"{b} {kinds[b]}" for b in by), "it int, condition string, score double, n_test long"])
    return t.groupBy(*by, "it", "condition").applyInPandas(score, shape)


def match_distribution(values: DataFrame, mean: float, sd: float, n: int) -> DataFrame:
    """For each area the cells nearest to n quantiles of a normal distribution, none twice: values (area, cell, v)."""
    from statistics import NormalDist

    asked = [NormalDist(mean, sd).inv_cdf((k + 0.5) / n) for k in range(n)]

    def match(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["v", "cell"])
        v, cells, used, out = g["v"].to_numpy(), g["cell"].to_numpy(), np.zeros(len(g), dtype=bool), []
        for a in asked[: len(g)]:
            k = int(np.argmin(np.where(used, np.inf, np.abs(v - a))))
            used[k] = True
            out.append((keys[0], int(cells[k]), float(v[k]), a))
        return pd.DataFrame(out, columns=["area", "cell", "v", "asked"])

    return values.groupBy("area").applyInPandas(match, "area long, cell long, v double, asked double")


def match_codes(runs: DataFrame, expected: list[str]) -> DataFrame:
    """Ordered matching of repeated codes: runs (cell, run, code, start, length >= the asked repeats) against the
    expected cycle; a code out of order is flagged and the search goes on from where it was."""

    def match(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at, out = 0, []
        for r in g.sort_values("run").itertuples():
            ok = r.code == expected[at % len(expected)]
            out.append((keys[0], int(r.start), r.code, at if ok else -1))
            at += ok
        return pd.DataFrame(out, columns=["cell", "start", "code", "place"])

    return runs.groupBy("cell").applyInPandas(match, "cell long, start long, code string, place long")


def _two(spark, sf, a=0, b=5):
    return V.responses(spark, sf).filter(F.col("config").isin(a, b))


def e06(spark, sf):
    def smooth(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        return g.assign(smooth=N.lowess(g["value"].to_numpy(), 0.2))

    return _r(V.traces(spark, sf, False).select("cell", "frame", "value").groupBy("cell").applyInPandas(smooth, "cell long, frame long, value double, smooth double"))


def e14(spark, sf):
    from perievent.operators.series import runs

    r = runs(V.traces(spark, sf, False).select("cell", "frame", "event_type"), ("cell",), ("frame",), "event_type").filter("length >= 2")
    return match_codes(r.select("cell", "run", F.col("event_type").alias("code"), "start"), ["click", "error", "purchase", "signup", "view"])


def h34(spark, sf):
    """Radial mean of each row's power spectrum of the image."""
    def power(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("x")["v"].to_numpy()
        p = np.abs(np.fft.rfft(v - v.mean())) ** 2
        return pd.DataFrame({"y": keys[0], "k": np.arange(len(p)), "power": p})

    return _r(image(spark, sf).groupBy("y").applyInPandas(power, "y long, k long, power double"))


def i01_means(spark, sf):
    return _r(bootstrap_means(V.responses(spark, sf), 20, 5, 1).select("cell", V.long("it").alias("it"), "config", "response"))


def i05(spark, sf):
    c = masks(spark, sf).groupBy("cell").agg(F.floor(F.avg("y")).alias("cy"), F.floor(F.avg("x")).alias("cx"))
    px = c.select("cell", F.explode(F.sequence(F.col("cy") - 6, F.col("cy") + 6)).alias("y"), "cx").select("cell", "y", F.explode(F.sequence(F.col("cx") - 6, F.col("cx") + 6)).alias("x"))
    return _r(fit_masks(px, image(spark, sf)))


def i09(spark, sf):
    """Two regressors at once by the normal equations' closed form, sums by Spark."""
    g = V.recordings(spark, sf).groupBy("area").agg(*[F.covar_pop(a, b).alias(n) for n, a, b in (("s11", "quantity", "quantity"), ("s22", "config", "config"), ("s12", "quantity", "config"), ("s1y", "quantity", "response"), ("s2y", "config", "response"), ("syy", "response", "response"))])
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1, b2 = (F.col("s22") * F.col("s1y") - F.col("s12") * F.col("s2y")) / det, (F.col("s11") * F.col("s2y") - F.col("s12") * F.col("s1y")) / det
    return _r(g.select("area", b1.alias("b_quantity"), b2.alias("b_config"), ((b1 * F.col("s1y") + b2 * F.col("s2y")) / F.col("syy")).alias("r2")))


def i15(spark, sf):
    return _r(decode(_two(spark, sf).select("cell", "trial", "config", F.array("response").alias("x")), 3, 4, by=("cell",)))


def i19(spark, sf):
    m = V.recordings(spark, sf).groupBy("area", "cell").agg(F.avg("response").alias("v"))
    return _r(match_distribution(m, 38000.0, 1500.0, 10))


def i25(spark, sf):
    """Trials on the axis between two configs' means."""
    axis = V.responses(spark, sf).groupBy("cell").agg((F.avg(F.when(F.col("config") == 0, F.col("response"))) - F.avg(F.when(F.col("config") == 5, F.col("response")))).alias("w"))
    return _r(V.responses(spark, sf).join(axis, "cell").groupBy("trial", "config").agg(F.sum(F.col("response") * F.col("w")).alias("projection")))


def i26(spark, sf):
    """Cells grouped by correlations above a threshold (connected ones are one group)."""
    from perievent.plans.graph import components

    r = pair_corr(V.responses(spark, sf).groupBy("datakey", "cell", "config").agg(F.avg("response").alias("response")), ("datakey",), "cell", "config", "response")
    return components(r.filter("r > 0.8").select("a", "b")).select(F.col("node").alias("cell"), F.col("root").alias("group"))


def i28(spark, sf):
    """A low-rank product of two sparse matrices, by joins and sums. Cells of the same mask have the same trace: a shape's
    counts in the movie as often as it has cells."""
    of, m = same_masks(masks(spark, sf).select("cell", "y", "x", "weight"))
    n = of.groupBy("shape").agg(F.count(F.lit(1)).alias("n"))
    trace = V.grid(spark, sf).join(m, ["y", "x"]).groupBy("shape", "frame").agg(F.sum(F.col("value") / 1000 * F.col("weight")).alias("c"))
    movie = m.join(trace.join(n, "shape"), "shape").groupBy("y", "x", "frame").agg(F.sum(F.col("weight") * F.col("c") * F.col("n")).alias("v"))
    return of_shapes(of, _r(m.join(movie, ["y", "x"]).groupBy("shape", "frame").agg(F.sum(F.col("weight") * F.col("v")).alias("trace"))))


_H = "CAST('0x' || substr(md5('1|' || config || '|' || it || '|' || draw), 1, 8) AS BIGINT)"
QUERIES = {
    "e06_lowess": e06, "e14_code_matching": e14, "h34_power": h34, "i01_bootstrap_means": i01_means, "i05_field_fits": i05, "i09_two_regressors": i09, "i15_decode_single": i15, "i19_matched": i19,
    "i25_axis_projection": i25, "i26_correlated_groups": i26, "i28_matrix_product": i28,
}
_MASK = "m AS (SELECT s_suppkey AS cell, s_suppkey * 3 % 50 + dy AS y, s_suppkey * 2 % 50 + dx AS x, (dy + dx + 1) / 9 AS weight FROM supplier, range(5) a(dy), range(5) b(dx))"
SQL = {
    "i01_bootstrap_means": f"WITH {V.RESP}, t AS (SELECT config, trial, row_number() OVER (PARTITION BY config ORDER BY trial) - 1 AS k, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, trial FROM resp)), p AS (SELECT config, it, {_H} % n AS k FROM (SELECT DISTINCT config, n FROM t), range(5) a(it), range(20) b(draw)), q AS (SELECT p.config, p.it, t.trial FROM p JOIN t USING (config, k)) SELECT cell, it, config, round(avg(response), 6) AS response FROM resp JOIN q USING (config, trial) GROUP BY cell, it, config",
    "i09_two_regressors": f"WITH {V.REC}, g AS (SELECT area, covar_pop(quantity, quantity) AS s11, covar_pop(config, config) AS s22, covar_pop(quantity, config) AS s12, covar_pop(quantity, response) AS s1y, covar_pop(config, response) AS s2y, covar_pop(response, response) AS syy FROM rec GROUP BY area), b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM g) SELECT area, round(b1, 6) AS b_quantity, round(b2, 6) AS b_config, round((b1 * s1y + b2 * s2y) / syy, 6) AS r2 FROM b",
    "i25_axis_projection": f"WITH {V.RESP}, a AS (SELECT cell, avg(response) FILTER (config = 0) - avg(response) FILTER (config = 5) AS w FROM resp GROUP BY cell) SELECT trial, config, round(sum(response * w), 6) AS projection FROM resp JOIN a USING (cell) GROUP BY trial, config",
    "i28_matrix_product": f"WITH {V.GRID}, {_MASK}, t AS (SELECT cell, frame, sum(value / 1000 * weight) AS c FROM grid JOIN m USING (y, x) GROUP BY ALL), v AS (SELECT y, x, frame, sum(weight * c) AS v FROM m JOIN t USING (cell) GROUP BY ALL) SELECT cell, frame, round(sum(weight * v), 6) AS trace FROM m JOIN v USING (y, x) GROUP BY ALL",
}
