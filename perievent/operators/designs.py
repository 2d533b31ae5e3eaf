"""Designs of several factors, comparisons after a rank test, the rest of the corrections, and adjusted information."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.functions import tails
from perievent.operators.metrics import _rounded as _r
from perievent.plans import order
from perievent.plans import views as V

#: Columns of a factorial design's normal equations, at most: the products of the factors' levels less one, summed.
MAX_COLUMNS = 1000


def effects_of(factors: tuple[str, ...]) -> list[tuple[str, ...]]:
    """Main effects and interactions, small ones first."""
    return [c for k in range(1, len(factors) + 1) for c in itertools.combinations(factors, k)]


def design_columns(levels: pd.DataFrame, factors: tuple[str, ...]) -> dict[tuple[str, ...], np.ndarray]:
    """Effect -> its columns for each row of levels, in sum-to-zero coding; () is the mean."""
    coded = {}
    for f in factors:
        codes, names = pd.factorize(levels[f], sort=True, use_na_sentinel=False)
        eye = np.vstack([np.eye(len(names) - 1), -np.ones(len(names) - 1)]) if len(names) > 1 else np.zeros((1, 0))
        coded[f] = eye[codes]
    out = {(): np.ones((len(levels), 1))}
    for e in effects_of(factors):
        out[e] = reduce(lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(len(levels), -1), [coded[f] for f in e])
    return out


def explained_squares(n: np.ndarray, s: np.ndarray, columns: list[np.ndarray]) -> tuple[float, int]:
    """Sum of squares that the columns explain, and their rank; n and s are the number and sum of values of each cell of
    the design, so the normal equations are sums over cells. A redundant column is swept out."""
    x = np.hstack(columns)
    a = x.T @ (n[:, None] * x)
    b = x.T @ s
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    e, v = np.linalg.eigh(a / np.outer(scale, scale))
    sure = e > 1e-10 * max(e[-1], 1e-300)
    z = (v[:, sure].T @ (b / scale)) / np.sqrt(e[sure])
    return float(z @ z), int(sure.sum())


def factorial_anova(df: DataFrame, keys: tuple[str, ...], factors: tuple[str, ...], value: str, kind: str = "II") -> DataFrame:
    """keys, effect (factors joined by ':'), ss, df, ms, f, p, eta2 (share of all squares), partial_eta2, df_error, mse: a
    between-subject analysis of variance with all interactions, balanced or not.

    Squares are those of nested models. Kind II: what an effect adds to all effects that don't contain it; kind III: what
    it adds to all others. Both agree in a balanced design. Spark sums number, sum and squares of each combination of
    levels, centred at the key's mean; the normal equations are sums over these combinations, at most MAX_COLUMNS wide. An
    effect that empty combinations leave without a degree of freedom, or a key without error, has null f. Null values are
    left out, a null level is a level of its own.
    """
    own = df.filter(F.col(value).isNotNull())
    mean = own.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))
    centred = own.alias("a").join(mean.alias("b"), on).select(*[F.col(f"a.{k}").alias(k) for k in keys], *[F.col(f"a.{c}").alias(c) for c in factors], (F.col(f"a.{value}") - F.col("b._mean")).alias("_y"))
    cells = centred.groupBy(*keys, *factors).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))
    names = effects_of(factors)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, s, q = g["_n"].to_numpy(), g["_s"].to_numpy(), float(g["_q"].sum())
        columns = design_columns(g, factors)
        if sum(c.shape[1] for c in columns.values()) > MAX_COLUMNS:
            raise ValueError(f"a design of over {MAX_COLUMNS} columns")
        total = q - s.sum() ** 2 / n.sum()
        # The fullest model takes each combination's mean.
        error, df_error = q - float((s * s / n).sum()), int(n.sum()) - len(g)
        out = []
        for e in names:
            if kind == "II":
                rest = [c for k, c in columns.items() if not set(e) <= set(k)]
            else:
                rest = [c for k, c in columns.items() if k != e]
            less, r0 = explained_squares(n, s, rest)
            more, r1 = explained_squares(n, s, [*rest, columns[e]])
            ss, dof = max(more - less, 0.0), r1 - r0
            mse = error / df_error if df_error else math.nan
            f = ss / dof / mse if dof and df_error and mse > 1e-12 * max(total, 1e-300) else math.nan
            out.append((":".join(e), ss if dof else math.nan, dof, ss / dof if dof else math.nan, f, tails.p_value("f", f, dof, df_error) if dof and df_error else math.nan, ss / total if total > 0 else math.nan, ss / (ss + error) if ss + error > 0 else math.nan, df_error, mse))
        found = pd.DataFrame(out, columns=["effect", "ss", "df", "ms", "f", "p", "eta2", "partial_eta2", "df_error", "mse"])
        for k in keys:
            found[k] = g[k].iloc[0]
        return found

    head = T.StructType(list(cells.select(*keys).schema.fields))
    shape = head.add("effect", "string").add("ss", "double").add("df", "long").add("ms", "double").add("f", "double").add("p", "double").add("eta2", "double").add("partial_eta2", "double").add("df_error", "long").add("mse", "double")
    found = cells.groupBy(*keys).applyInPandas(lambda g: run(g)[shape.names], shape)
    return found.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in found.dtypes])


def selective(anova: DataFrame, keys: tuple[str, ...], alpha: float = 0.05) -> DataFrame:
    """keys, effects: the effects under alpha of each key that has one, in order."""
    return anova.filter(F.col("p") < alpha).groupBy(*keys).agg(F.array_sort(F.collect_list("effect")).alias("effects"))


def ranked(df: DataFrame, keys: tuple[str, ...], group: str, value: str) -> DataFrame:
    """keys, group, rank, n, t: how many of a group's values have a rank among their key's, and how many of all do. Ranks
    of ties are their mean; they follow from running counts, so no key has to fit a task."""
    counts = order.running_counts(df, keys, value).select(*keys, value, F.col("n").alias("t"), (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"), "total")
    own = df.filter(F.col(value).isNotNull()).groupBy(*keys, group, value).agg(F.count(F.lit(1)).alias("n"))
    return own.join(counts, [*keys, value])


def rank_comparisons(df: DataFrame, keys: tuple[str, ...], group: str, value: str) -> DataFrame:
    """keys, a, b, z, p (Dunn, with ties), t, p_conover and both with Holm's and Sidak's corrections over a key's pairs, h
    (the key's Kruskal-Wallis): each pair of groups after a rank test. Keys must not be null. Null where all values tie."""
    r = order.stash(ranked(df, keys, group, value))
    ties = r.select(*keys, value, "t", "total").distinct().groupBy(*keys).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.first("total").cast("double").alias("total"))
    g = r.groupBy(*keys, F.col(group).alias("g")).agg(F.sum(F.col("rank") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("rank") * F.col("n")).alias("q"))
    all_of = g.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("_k")).join(ties, list(keys))
    n = F.col("total")
    h = (12 / (n * (n + 1)) * F.col("between") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    some = F.col("ties") < n * n * n - n
    stats = all_of.select(*keys, F.when(some, h).alias("h"), "total", "ties", "_k", ((F.col("q") - n * (n + 1) * (n + 1) / 4) / (n - 1)).alias("s2"))
    x = g.select(*keys, F.col("g").alias("a"), (F.col("s") / F.col("n")).alias("ma"), F.col("n").alias("na"))
    y = g.select(*keys, F.col("g").alias("b"), (F.col("s") / F.col("n")).alias("mb"), F.col("n").alias("nb"))
    pairs = x.join(y, list(keys)).filter("a < b").join(stats, list(keys))
    apart, width = F.col("ma") - F.col("mb"), 1 / F.col("na") + 1 / F.col("nb")
    z = apart / F.sqrt((n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * width)
    t = apart / F.sqrt(F.col("s2") * (n - 1 - F.col("h")) / (n - F.col("_k")) * width)
    pairs = pairs.withColumns({"z": F.when(F.col("h").isNotNull(), z), "t": F.when(F.col("h").isNotNull() & (n > F.col("_k")), t), "dof": (n - F.col("_k")).cast("long")})
    pairs = tails.with_p(pairs, "z", "z").withColumnRenamed("p", "p_dunn")
    pairs = tails.with_p(pairs, "t", "t", "dof").withColumnRenamed("p", "p_conover")
    out = pairs.select(*keys, "a", "b", "z", "p_dunn", "t", "dof", "p_conover", "h")
    for p in ("p_dunn", "p_conover"):
        out = more_corrections(out.withColumn(p, F.when(~F.isnan(p), F.col(p))), keys, p, ("holm", "holm_sidak"), f"{p}_")
    return out


def more_corrections(df: DataFrame, keys: tuple[str, ...], p: str, wanted: tuple[str, ...] = ("holm_sidak", "simes_hochberg", "two_stage_bh", "two_stage_bky"), prefix: str = "", alpha: float = 0.05) -> DataFrame:
    """df with corrections of p over each key's rows: holm, holm_sidak, simes_hochberg, and two_stage_bh and _bky, in which
    the rejections of a first pass at alpha (bky: at alpha / (1 + alpha)) tell how many hypotheses are null. Null p stays."""
    known = F.col(p).isNotNull()
    w = W.partitionBy(*keys, known)
    up, down = w.orderBy(p).rowsBetween(W.unboundedPreceding, 0), w.orderBy(F.desc(p), F.lit(0)).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumns({"_m": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(p))})
    one, x, m, k = lambda c: F.least(F.lit(1.0), c), F.col(p), F.col("_m"), F.col("_k")
    d = d.withColumn("_bh", F.min(x * m / k).over(down))
    stages = {"two_stage_bh": (1.0, alpha), "two_stage_bky": (1 + alpha, alpha / (1 + alpha))}
    for name in wanted:
        if name in stages:
            factor, level = stages[name]
            d = d.withColumn("_r", F.sum((F.col("_bh") <= level).cast("long")).over(w))
            nulls = F.when((F.col("_r") == 0) | (F.col("_r") == m), m).otherwise(m - F.col("_r"))
            c = one(one(F.col("_bh")) * nulls / m * factor)
        else:
            c = {"holm": one(F.max(x * (m - k + 1)).over(up)), "holm_sidak": F.max(1 - F.pow(1 - x, m - k + 1)).over(up), "simes_hochberg": one(F.min(x * (m - k + 1)).over(down))}[name]
        d = d.withColumn(f"{prefix}{name}", F.when(known, c))
    return d.drop("_m", "_k", "_bh", "_r")


def lower_tangents(p: np.ndarray) -> np.ndarray:
    """min over i > t of p[i - 1] / (i - t) for t = 0 ... m - 1, of sorted p: the flattest line from (t, 0) to a point
    (i, p[i - 1]) to its right. It ends in a corner of those points' lower hull, which grows from the right."""
    m = len(p)
    hull: list[int] = []  # corners from right to left, indices i
    out = np.empty(m)
    for t in range(m - 1, -1, -1):
        i = t + 1
        while len(hull) > 1 and (p[hull[-1] - 1] - p[i - 1]) * (hull[-2] - i) >= (p[hull[-2] - 1] - p[i - 1]) * (hull[-1] - i):
            hull.pop()
        hull.append(i)
        low, high = 0, len(hull) - 1  # slopes from (t, 0) fall, then rise along the hull
        while low < high:
            mid = (low + high) // 2
            if p[hull[mid] - 1] * (hull[mid + 1] - t) <= p[hull[mid + 1] - 1] * (hull[mid] - t):
                high = mid
            else:
                low = mid + 1
        out[t] = p[hull[low] - 1] / (hull[low] - t)
    return out


def hommel_adjusted(p: np.ndarray) -> np.ndarray:
    """Hommel's closed test of a family: the largest, over the sizes j of sets, of Simes' p of the j largest, or, for one
    not among them, of the set that it makes with the j - 1 largest."""
    o = np.argsort(p, kind="stable")
    s, m = p[o], len(p)
    c = np.maximum.accumulate(np.arange(m, 0, -1) * lower_tangents(s))  # at t: the largest Simes p of the m - t largest and more
    # At place i, sets of over m - i - 1 hold it; of smaller ones (t > i) the lesser of c and (m - t) s_i counts. The first
    # rises with t and the second falls, so the best t is where they cross.
    low, high = np.arange(m) + 1, np.full(m, m)
    while (low < high).any():
        mid = (low + high) // 2
        past = (c[np.minimum(mid, m - 1)] >= (m - mid) * s) | (mid >= m)
        low, high = np.where(~past & (low < high), mid + 1, low), np.where(past & (low < high), mid, high)
    at = np.arange(m)
    out = c.copy()
    for t in (low, low - 1):
        ok = (t > at) & (t < m)
        out = np.maximum(out, np.where(ok, np.minimum(c[np.minimum(t, m - 1)], (m - t) * s), 0))
    final = np.empty(m)
    final[o] = np.minimum(1.0, np.maximum(out, s))
    return final


def hommel(df: DataFrame, keys: tuple[str, ...], p: str) -> DataFrame:
    """df with hommel: p adjusted by Hommel's closed test within each key's family. A family is one task's; its null p
    stay null and don't count."""
    shape = T.StructType([*df.schema.fields, T.StructField("hommel", T.DoubleType())])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g[p].to_numpy(dtype=float)
        out, known = np.full(len(x), np.nan), ~np.isnan(x)
        if known.any():
            out[known] = hommel_adjusted(x[known])
        return g.assign(hommel=out)

    return df.groupBy(*keys).applyInPandas(run, shape)


def expected_information(n: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What each pair of margins a and b of a table of n adds to the expected mutual information (nats) when the margins
    stay and labels are dealt: a sum over the hypergeometric counts. Counts further than 40 deviations (and 60) from their
    mean have no weight that a double shows."""
    mean = a * b / n
    sd = np.sqrt(np.maximum(mean * (1 - a / n) * (n - b) / max(n - 1, 1), 0))
    out = np.zeros(len(a))
    lg = np.vectorize(math.lgamma, otypes=[float])
    low = np.maximum(np.maximum(1, a + b - n), np.floor(mean - 40 * sd - 60))
    high = np.minimum(np.minimum(a, b), np.ceil(mean + 40 * sd + 60))
    for i in range(len(a)):
        k = np.arange(low[i], high[i] + 1)
        if len(k):
            w = lg(a[i] + 1) + lg(b[i] + 1) + lg(n - a[i] + 1) + lg(n - b[i] + 1) - lg(n + 1) - lg(k + 1) - lg(a[i] - k + 1) - lg(b[i] - k + 1) - lg(n - a[i] - b[i] + k + 1)
            out[i] = float((k / n * np.log(n * k / (a[i] * b[i])) * np.exp(w)).sum())
    return out


def mutual_information(df: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """keys, n, mi (nats), mi_bits, h_x, h_y (nats), expected_mi, ami, nmi: mutual information of two columns of labels,
    what dealt labels of the same margins would have, and the share of the rest (over the mean entropy). Rows with a null
    label are left out; a key of one label on both sides has ami and nmi 1. Margins of equal counts are worked out once."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = rows.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("c"))
    side = lambda c, o: cells.groupBy(*keys, c).agg(F.sum("c").alias(o))
    a, b = side("_x", "a"), side("_y", "b")
    total = a.groupBy(*keys).agg(F.sum("a").alias("n"))
    entropy = lambda m, o: m.join(total, list(keys)).groupBy(*keys).agg((-F.sum(F.col(m.columns[-1]) / F.col("n") * F.log(F.col(m.columns[-1]) / F.col("n")))).alias(o))
    met = cells.join(a, [*keys, "_x"]).join(b, [*keys, "_y"]).join(total, list(keys))
    mi = met.groupBy(*keys).agg(F.first("n").alias("n"), F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("a").cast("double") * F.col("b")))).alias("mi"))
    many = lambda m, c, o: m.groupBy(*keys, c).agg(F.count(F.lit(1)).alias(o))
    pairs = many(a, "a", "times_a").join(many(b, "b", "times_b"), list(keys)).join(total, list(keys))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = np.zeros(len(f))
            for n, part in f.groupby("n").indices.items():
                out[part] = expected_information(float(n), f["a"].to_numpy(dtype=float)[part], f["b"].to_numpy(dtype=float)[part])
            yield f.assign(e=out * f["times_a"] * f["times_b"])[[*keys, "e"]]

    expected = pairs.mapInPandas(run, T.StructType([*pairs.select(*keys).schema.fields, T.StructField("e", T.DoubleType())])).groupBy(*keys).agg(F.sum("e").alias("expected_mi"))
    d = mi.join(entropy(a, "h_x"), list(keys)).join(entropy(b, "h_y"), list(keys)).join(expected, list(keys))
    h = (F.col("h_x") + F.col("h_y")) / 2
    flat = (F.col("h_x") == 0) & (F.col("h_y") == 0)
    return d.select(*keys, "n", "mi", (F.col("mi") / math.log(2)).alias("mi_bits"), "h_x", "h_y", "expected_mi", F.when(flat, 1.0).otherwise((F.col("mi") - F.col("expected_mi")) / (h - F.col("expected_mi"))).alias("ami"), F.when(flat, 1.0).otherwise(F.col("mi") / h).alias("nmi"))


def _lines(spark, sf) -> DataFrame:
    """Responses by area under three factors."""
    area = V.table(spark, sf, "supplier").join(V.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").cast("long").alias("area"))
    return V.table(spark, sf, "lineitem").join(area, "l_suppkey").select("area", F.col("l_linenumber").cast("long").alias("line"), F.quarter("l_shipdate").cast("long").alias("quarter"), F.col("l_returnflag").alias("flag"), (F.col("l_quantity") % 3).cast("long").alias("third"), F.col("l_extendedprice").alias("response"))


def g08_balanced(spark, sf):
    """Mean responses of thirds of the trials, by line and quarter: a balanced design of areas that have all combinations."""
    y = _lines(spark, sf).groupBy("area", "line", "quarter", "third").agg(F.avg("response").alias("y"))
    full = y.groupBy("area").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("line").alias("m"), F.count_distinct("quarter").alias("i"), F.count_distinct("third").alias("q")).filter("k = m * i * q").select("area")
    return _r(factorial_anova(y.join(full, "area"), ("area",), ("line", "quarter"), "y").drop("p"))


def g08_factorial(spark, sf):
    """Three factors and their interactions, unbalanced, with p."""
    return _r(factorial_anova(_lines(spark, sf), ("area",), ("line", "quarter", "flag"), "response"))


def g08_selective(spark, sf):
    """The effects that cells are selective for: config and parity of the trial, by cell."""
    r = V.responses(spark, sf).withColumn("half", F.col("trial") % 2)
    return selective(factorial_anova(r, ("cell",), ("config", "half"), "response"), ("cell",), 0.05)


def g05_ties(spark, sf):
    """Quantities (fifty values, so ties throughout) by line number, within areas."""
    r = V.recordings(spark, sf).select("area", "config", "quantity")
    found = rank_comparisons(r, ("area",), "config", "quantity")
    return _r(found.select("area", "a", "b", "z", "t", "dof", "h"))


def g05_posthoc(spark, sf):
    r = V.recordings(spark, sf).select("area", "config", "quantity")
    return _r(rank_comparisons(r, ("area",), "config", "quantity"))


def _families(spark, sf) -> DataFrame:
    return V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), (F.pow((F.col("c_acctbal") + 1000) / 11000, F.lit(4)) * 0.5 + F.col("c_custkey") * 1e-9).alias("p"))


def g12_more(spark, sf):
    return _r(more_corrections(_families(spark, sf), ("nation",), "p"))


def g12_hommel(spark, sf):
    return _r(hommel(_families(spark, sf), ("nation",), "p"))


def d33_adjusted(spark, sf):
    """What a line's number and its tax tell of each other, by flags."""
    t = V.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("datakey"), "l_tax", "l_linenumber")
    return _r(mutual_information(t, ("datakey",), "l_tax", "l_linenumber"))


_LINES = "ln AS (SELECT CAST(n_regionkey AS BIGINT) AS area, CAST(l_linenumber AS BIGINT) AS line, CAST(quarter(l_shipdate) AS BIGINT) AS quarter, CAST(l_quantity % 3 AS BIGINT) AS third, l_extendedprice AS response FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey)"
_FAMILIES = "f AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, pow((c_acctbal + 1000) / 11000, 4) * 0.5 + c_custkey * 1e-9 AS p FROM customer), k AS (SELECT *, CAST(count(*) OVER (PARTITION BY nation) AS DOUBLE) AS m, row_number() OVER (PARTITION BY nation ORDER BY p) AS k FROM f)"
_UP, _DOWN = "(PARTITION BY nation ORDER BY p ROWS UNBOUNDED PRECEDING)", "(PARTITION BY nation ORDER BY p DESC ROWS UNBOUNDED PRECEDING)"
QUERIES = {
    "g08_balanced": g08_balanced, "g08_factorial": g08_factorial, "g08_selective": g08_selective, "g05_ties": g05_ties, "g05_posthoc": g05_posthoc, "g12_more_corrections": g12_more, "g12_hommel": g12_hommel, "d33_adjusted_information": d33_adjusted,
}
SQL = {
    "g08_balanced": f"""WITH {_LINES}, y0 AS (SELECT area, line, quarter, third, avg(response) AS y FROM ln GROUP BY ALL),
y AS (SELECT * FROM y0 WHERE area IN (SELECT area FROM y0 GROUP BY area HAVING count(*) = count(DISTINCT line) * count(DISTINCT quarter) * count(DISTINCT third))),
g AS (SELECT area, avg(y) AS g, count(*) AS n, count(DISTINCT line) AS a, count(DISTINCT quarter) AS b, sum((y - m) ** 2) AS total FROM (SELECT *, avg(y) OVER (PARTITION BY area) AS m FROM y) GROUP BY area),
sa AS (SELECT area, sum((m - g) ** 2 * k) AS ss FROM (SELECT area, line, avg(y) AS m, count(*) AS k FROM y GROUP BY ALL) JOIN g USING (area) GROUP BY area),
sb AS (SELECT area, sum((m - g) ** 2 * k) AS ss FROM (SELECT area, quarter, avg(y) AS m, count(*) AS k FROM y GROUP BY ALL) JOIN g USING (area) GROUP BY area),
sc AS (SELECT area, sum((m - g) ** 2 * k) AS ss FROM (SELECT area, line, quarter, avg(y) AS m, count(*) AS k FROM y GROUP BY ALL) JOIN g USING (area) GROUP BY area),
e AS (SELECT area, 'line' AS effect, sa.ss, a - 1 AS df FROM sa JOIN g USING (area) UNION ALL SELECT area, 'quarter', sb.ss, b - 1 FROM sb JOIN g USING (area) UNION ALL SELECT area, 'line:quarter', sc.ss - sa.ss - sb.ss, (a - 1) * (b - 1) FROM sc JOIN sa USING (area) JOIN sb USING (area) JOIN g USING (area)),
r AS (SELECT area, g.total, g.n - a * b AS df_error, (g.total - sc.ss) AS error FROM g JOIN sc USING (area))
SELECT area, effect, round(ss, 6) AS ss, df, round(ss / df, 6) AS ms, round(ss / df / (error / df_error), 6) AS f, round(ss / total, 6) AS eta2, round(ss / (ss + error), 6) AS partial_eta2, df_error, round(error / df_error, 6) AS mse FROM e JOIN r USING (area)""",
    "g05_ties": f"""WITH {V.REC}, k AS (SELECT area, config, quantity, rank() OVER (PARTITION BY area ORDER BY quantity) + (count(*) OVER (PARTITION BY area, quantity) - 1) / 2.0 AS r FROM rec),
t AS (SELECT area, sum(CAST(c AS DOUBLE) * c * c - c) AS ties, CAST(sum(c) AS DOUBLE) AS n FROM (SELECT area, quantity, count(*) AS c FROM k GROUP BY ALL) GROUP BY area),
g AS (SELECT area, config, avg(r) AS m, count(*) AS c, CAST(sum(r) AS DOUBLE) AS s, CAST(sum(r * r) AS DOUBLE) AS q FROM k GROUP BY ALL),
h AS (SELECT area, n, ties, count(*) AS kk, (12 / (n * (n + 1)) * sum(s * s / c) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, (sum(q) - n * (n + 1) * (n + 1) / 4) / (n - 1) AS s2 FROM g JOIN t USING (area) GROUP BY area, n, ties)
SELECT area, x.config AS a, y.config AS b, round((x.m - y.m) / sqrt((n * (n + 1) / 12 - ties / (12 * (n - 1))) * (1 / x.c + 1 / y.c)), 6) AS z, round((x.m - y.m) / sqrt(s2 * (n - 1 - h) / (n - kk) * (1 / x.c + 1 / y.c)), 6) AS t, CAST(n - kk AS BIGINT) AS dof, round(h, 6) AS h
FROM g x JOIN g y USING (area) JOIN h USING (area) WHERE x.config < y.config""",
    "g12_more_corrections": f"""WITH {_FAMILIES}, b AS (SELECT *, min(p * m / k) OVER {_DOWN} AS bh FROM k), r AS (SELECT *, count(*) FILTER (bh <= 0.05) OVER (PARTITION BY nation) AS r1, count(*) FILTER (bh <= 0.05 / 1.05) OVER (PARTITION BY nation) AS r2 FROM b)
SELECT c_custkey, nation, round(p, 6) AS p, round(max(1 - (1 - p) ** (m - k + 1)) OVER {_UP}, 6) AS holm_sidak, round(least(1, min(p * (m - k + 1)) OVER {_DOWN}), 6) AS simes_hochberg,
round(least(1, least(1, bh) * CASE WHEN r1 = 0 OR r1 = m THEN m ELSE m - r1 END / m), 6) AS two_stage_bh, round(least(1, least(1, bh) * CASE WHEN r2 = 0 OR r2 = m THEN m ELSE m - r2 END / m * 1.05), 6) AS two_stage_bky FROM r""",
    "d33_adjusted_information": """WITH c AS (SELECT l_returnflag || l_linestatus AS datakey, l_tax AS x, l_linenumber AS y, count(*) AS c FROM lineitem GROUP BY ALL),
a AS (SELECT datakey, x, CAST(sum(c) AS DOUBLE) AS a FROM c GROUP BY ALL), b AS (SELECT datakey, y, CAST(sum(c) AS DOUBLE) AS b FROM c GROUP BY ALL), n AS (SELECT datakey, sum(a) AS n FROM a GROUP BY ALL),
mi AS (SELECT datakey, n, sum(c / n * ln(c * n / (a * b))) AS mi FROM c JOIN a USING (datakey, x) JOIN b USING (datakey, y) JOIN n USING (datakey) GROUP BY ALL),
hx AS (SELECT datakey, -sum(a / n * ln(a / n)) AS h_x FROM a JOIN n USING (datakey) GROUP BY ALL), hy AS (SELECT datakey, -sum(b / n * ln(b / n)) AS h_y FROM b JOIN n USING (datakey) GROUP BY ALL),
e AS (SELECT datakey, sum(i / n * ln(n * i / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(a - i + 1) - lgamma(b - i + 1) - lgamma(n - a - b + i + 1))) AS expected_mi
  FROM (SELECT datakey, n, a, b, CAST(unnest(range(CAST(greatest(1, a + b - n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS i FROM a JOIN b USING (datakey) JOIN n USING (datakey)) GROUP BY datakey)
SELECT datakey, CAST(n AS BIGINT) AS n, round(mi, 6) AS mi, round(mi / ln(2), 6) AS mi_bits, round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(expected_mi, 6) AS expected_mi, round((mi - expected_mi) / ((h_x + h_y) / 2 - expected_mi), 6) AS ami, round(mi / ((h_x + h_y) / 2), 6) AS nmi
FROM mi JOIN hx USING (datakey) JOIN hy USING (datakey) JOIN e USING (datakey)""",
}
