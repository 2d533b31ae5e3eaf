"""Tests of responses, per cell or per pair: statistics as SQL aggregates, tails in perievent.functions.tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.functions import tails
from perievent.operators.joins import seeded_order
from perievent.operators.metrics import _rounded as _r
from perievent.operators.metrics import psth
from perievent.plans import order
from perievent.plans import views as V
from perievent.plans.stash import stash


def auc(points: DataFrame, keys: tuple[str, ...], within: tuple[str, ...], whole: bool = False, n: int = 50) -> DataFrame:
    """keys, within, auc, n, n_base of points (keys, within, side: whether a value is a stimulus's or a baseline's, v): the
    area under the ROC curve at n criteria evenly spaced over the range of a key's stimulus values (whole: of all). Hits
    and false alarms are the shares above a criterion, the area is taken by trapezoids over the criteria. Values are
    counted by how many criteria they exceed, so a group is n + 1 counts however many its values. Null where a side is
    empty."""
    points = points.filter("v is not null")
    bounds = points.filter(F.col("side") | F.lit(whole)).groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (n - 1)
    p = points.join(bounds, list(keys)).withColumn("step", step)
    beyond = lambda k: (F.col("v") > F.col("lo") + k * F.col("step")).cast("int")
    guess = F.when(F.col("step") > 0, F.least(F.lit(n), F.greatest(F.lit(0), F.ceil((F.col("v") - F.col("lo")) / F.col("step"))))).otherwise(F.lit(n) * beyond(0)).cast("int")
    # The guess may be off by one in either direction, as criteria are rounded.
    p = p.withColumn("c", guess).withColumn("c", F.col("c") + F.when(F.col("c") < n, beyond(F.col("c"))).otherwise(0) - F.when(F.col("c") > 0, 1 - beyond(F.col("c") - 1)).otherwise(0))
    bins = p.groupBy(*keys, *within, "c").agg(F.sum(F.col("side").cast("long")).alias("s"), F.sum((~F.col("side")).cast("long")).alias("b"))
    g = bins.groupBy(*keys, *within).agg(F.collect_list(F.struct("c", "s", "b")).alias("x"), F.sum("s").alias("n"), F.sum("b").alias("n_base"))
    above = lambda x, c: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + F.when(y.c > c, y.s).otherwise(0))
    area = F.aggregate("x", F.lit(0.0), lambda a, y: a + F.when((y.c >= 1) & (y.c < n), y.b * (above(F.col("x"), y.c) + above(F.col("x"), y.c - 1)) / 2.0).otherwise(0.0))
    return g.select(*keys, *within, F.when((F.col("n") > 0) & (F.col("n_base") > 0), area / F.col("n") / F.col("n_base")).alias("auc"), "n", "n_base")


def sides(df: DataFrame, keep: tuple[str, ...], stim: str, base: str) -> DataFrame:
    """df's stimulus and baseline values as rows (keep, side, v)."""
    both = F.explode(F.array(F.struct(F.lit(True).alias("side"), F.col(stim).alias("v")), F.struct(F.lit(False).alias("side"), F.col(base).alias("v"))))
    return df.select(*keep, both.alias("p")).select(*keep, "p.side", "p.v")


def roc(df: DataFrame, keys: tuple[str, ...], stim: str, base: str, whole: bool = False) -> DataFrame:
    """Each cell's largest AUC over configs. df has one row a trial."""
    return auc(sides(df, (*keys, "config"), stim, base), keys, ("config",), whole).groupBy(*keys).agg(F.max("auc").alias("auc"))


def roc_null(df: DataFrame, keys: tuple[str, ...], stim: str, base: str, iterations: int, seed: int) -> DataFrame:
    """roc's AUC with the share of shuffles that reach it: stimulus and baseline values are pooled within a config and
    split anew in seeded order."""
    pool = df.select(*keys, "config", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(stim).alias("v")), F.struct(F.lit(1).alias("side"), F.col(base).alias("v")))).alias("p"), "trial").select(*keys, "config", "trial", "p.side", "p.v")
    many = pool.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    w = W.partitionBy(*keys, "config", "it")
    k = F.row_number().over(w.orderBy(seeded_order(seed, "it", "trial", "side"), "trial", "side", "v"))
    many = many.withColumns({"k": k, "n": F.count(F.lit(1)).over(w)}).withColumn("first", F.col("k") * 2 <= F.col("n"))
    dealt = many.select(*keys, "it", "config", F.col("first").alias("side"), "v")
    null = auc(dealt, (*keys, "it"), ("config",)).groupBy(*keys, "it").agg(F.max("auc").alias("shuffled"))
    return null.join(roc(df, keys, stim, base), list(keys)).groupBy(*keys, "auc").agg(F.avg((F.col("shuffled") >= F.col("auc")).cast("double")).alias("p"))


def kruskal_wallis(df: DataFrame, keys: tuple[str, ...], group: str, value: str) -> DataFrame:
    """H with tie correction and degrees of freedom of each key's groups; nulls have no rank. Ranks follow from running
    counts, so no key has to fit a task."""
    ranked = stash(order.ranks(df.select(*keys, group, value), keys, value, "rank"))
    ties = ranked.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = ranked.groupBy(*keys, group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    s = g.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("n").alias("n"), (F.count(F.lit(1)) - 1).alias("dof")).join(ties, list(keys))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return s.select(*keys, h.alias("h"), "dof")


def dunn(df: DataFrame, keys: tuple[str, ...], group: str, value: str) -> DataFrame:
    """z of the mean-rank difference of each pair of groups (without tie correction)."""
    ranked = stash(order.ranks(df.select(*keys, group, value), keys, value, "rank"))
    total = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    g = ranked.join(total, list(keys)).groupBy(*keys, "total", F.col(group).alias("g")).agg(F.avg("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    a, b = g.select(*keys, "total", F.col("g").alias("a"), F.col("m").alias("ma"), F.col("n").alias("na")), g.select(*keys, F.col("g").alias("b"), F.col("m").alias("mb"), F.col("n").alias("nb"))
    se = F.sqrt(F.col("total") * (F.col("total") + 1) / 12 * (1 / F.col("na") + 1 / F.col("nb")))
    return a.join(b, list(keys)).filter("a < b").select(*keys, "a", "b", ((F.col("ma") - F.col("mb")) / se).alias("z"))


def anova(df: DataFrame, keys: tuple[str, ...], group: str, value: str) -> DataFrame:
    """One-way between groups: F, degrees of freedom, eta and omega squared."""
    g = df.groupBy(*keys, group).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count(F.lit(1)).alias("k"))
    mean = F.col("s") * F.col("s") / F.col("n")
    ssb, sst = F.col("between") - mean, F.col("q") - mean
    t = t.select(*keys, ssb.alias("ssb"), sst.alias("sst"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))
    ms = (F.col("sst") - F.col("ssb")) / F.col("df2")
    return t.select(*keys, (F.col("ssb") / F.col("df1") / ms).alias("f"), "df1", "df2", (F.col("ssb") / F.col("sst")).alias("eta2"), ((F.col("ssb") - F.col("df1") * ms) / (F.col("sst") + ms)).alias("omega2"))


def repeated_anova(df: DataFrame, keys: tuple[str, ...], subject: str, levels: tuple[str, ...]) -> DataFrame:
    """One-way repeated measures: a row a subject, a column a level."""
    k = len(levels)
    m = sum(F.col(c) for c in levels) / k
    d = df.select(*keys, subject, *levels, m.alias("m"))
    grand = d.withColumn("g", F.avg("m").over(W.partitionBy(*keys)))
    within = sum((F.col(c) - F.col("m")) * (F.col(c) - F.col("m")) for c in levels)
    t = grand.groupBy(*keys).agg(F.sum(within).alias("within"), F.count(F.lit(1)).alias("n"), F.first("g").alias("g"), *[F.avg(c).alias(f"_{c}") for c in levels])
    effect = F.col("n") * sum((F.col(f"_{c}") - F.col("g")) * (F.col(f"_{c}") - F.col("g")) for c in levels)
    error = F.col("within") - effect
    return t.filter("n > 1").select(*keys, (effect / (k - 1) / (error / ((k - 1) * (F.col("n") - 1)))).alias("f"), F.lit(k - 1).cast("long").alias("df1"), ((k - 1) * (F.col("n") - 1)).alias("df2"))


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of each pair of groups (the first's), its z with tie-free deviation. A row meets the pairs of its group only."""
    groups = df.select(group).distinct()
    a, b = groups.select(F.col(group).alias("a")), groups.select(F.col(group).alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("g", F.explode(F.array("a", "b")))
    both = df.select(F.col(group).alias("g"), F.col(value).alias("v")).join(pairs, "g")
    ranked = order.ranks(both, ("a", "b"), "v", "rank")
    s = ranked.groupBy("a", "b").agg(F.sum(F.when(F.col("g") == F.col("a"), F.col("rank"))).alias("r"), F.sum((F.col("g") == F.col("a")).cast("long")).alias("n1"), F.sum((F.col("g") == F.col("b")).cast("long")).alias("n2"))
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    mean, sd = F.col("n1") * F.col("n2") / 2, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12)
    return s.select("a", "b", u.alias("u"), ((u - mean) / sd).alias("z"))


def paired(df: DataFrame, keys: tuple[str, ...], a: str, b: str) -> DataFrame:
    """Paired t and Wilcoxon's smaller rank sum (zero differences left out of the latter)."""
    d = df.select(*keys, (F.col(a) - F.col(b)).alias("d"))
    t = d.groupBy(*keys).agg((F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d")))).alias("t"), (F.count("d") - 1).alias("dof"))
    nz = order.ranks(d.filter("d != 0").withColumn("_size", F.abs("d")), keys, "_size", "rank")
    s = nz.groupBy(*keys).agg(F.least(F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))).alias("w"))
    return t.join(s, list(keys))


def corrected(df: DataFrame, keys: tuple[str, ...], p: str) -> DataFrame:
    """df with p's corrections: bonferroni, sidak, holm, fdr_bh, fdr_by."""
    w, up = W.partitionBy(*keys), W.partitionBy(*keys).orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    m, k = F.count(F.lit(1)).over(w), F.row_number().over(W.partitionBy(*keys).orderBy(p))
    d = df.withColumns({"_m": m, "_k": k}).withColumn("_c", F.sum(1 / F.col("_k")).over(w))
    one = lambda c: F.least(F.lit(1.0), c)
    x = F.col(p)
    return d.withColumns({"bonferroni": one(x * F.col("_m")), "sidak": 1 - F.pow(1 - x, F.col("_m")), "holm": one(F.max(x * (F.col("_m") - F.col("_k") + 1)).over(up)), "fdr_bh": one(F.min(x * F.col("_m") / F.col("_k")).over(down)), "fdr_by": one(F.min(x * F.col("_m") / F.col("_k") * F.col("_c")).over(down))}).drop("_m", "_k", "_c")


def _cells(spark, sf):
    return V.recordings(spark, sf).withColumn("base", F.col("quantity") * 1000)


def g01(spark, sf):
    return _r(roc(_cells(spark, sf), ("cell",), "response", "base"))


def g02(spark, sf):
    return _r(roc_null(_cells(spark, sf), ("cell",), "response", "base", 8, 11))


def g03(spark, sf):
    """Frames of the mean trace beyond the baseline's mean by 1.5 deviations, either way."""
    p = psth(V.traces(spark, sf))
    w = W.partitionBy("cell", "config")
    p = p.withColumns({"m": F.avg(F.when(F.col("frame_ix") < V.STIM_ON, F.col("mean"))).over(w), "s": F.stddev_pop(F.when(F.col("frame_ix") < V.STIM_ON, F.col("mean"))).over(w)})
    out = (F.col("frame_ix") >= V.STIM_ON) & (F.col("frame_ix") < V.STIM_ON + V.N_ON) & ((F.abs("mean") > F.abs("m") + 1.5 * F.col("s")) | (F.abs("mean") < F.abs("m") - 1.5 * F.col("s")))
    return p.groupBy("cell", "config").agg(F.sum(out.cast("long")).alias("n_frames"))


def g04(spark, sf):
    return _r(kruskal_wallis(V.responses(spark, sf), ("datakey", "cell"), "config", "response"))


def g04p(spark, sf):
    """Cells by Kruskal-Wallis with their p."""
    return _r(tails.with_p(kruskal_wallis(V.responses(spark, sf), ("datakey", "cell"), "config", "response"), "chi2", "h", "dof"))


def g05(spark, sf):
    return _r(dunn(V.responses(spark, sf), ("cell",), "config", "response"))


def g07(spark, sf):
    t = V.traces(spark, sf).groupBy("cell", "trial").agg(*[F.avg(F.when((F.col("frame_ix") >= a) & (F.col("frame_ix") < b), F.col("value"))).alias(n) for n, a, b in (("pre", 0, 8), ("on", 8, 14), ("post", 14, 20))])
    return _r(repeated_anova(t, ("cell",), "trial", ("pre", "on", "post")))


def g08(spark, sf):
    return _r(anova(V.responses(spark, sf), ("cell",), "config", "response"))


def g10(spark, sf):
    best = V.recordings(spark, sf).groupBy("area", "cell").agg(V.mean("response").alias("m"))
    return _r(mann_whitney(best, "area", "m"))


def g11(spark, sf):
    m = V.recordings(spark, sf).groupBy("area", "cell").agg(V.mean(F.when(F.col("datakey") == "AF", F.col("response"))).alias("a"), V.mean(F.when(F.col("datakey") == "RF", F.col("response"))).alias("b"))
    return _r(paired(m.filter("a is not null and b is not null"), ("area",), "a", "b"))


def g12(spark, sf):
    p = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("nation"), ((F.col("c_acctbal") + 1000) / 220000 + F.col("c_custkey") * 1e-9).alias("p"))
    return _r(corrected(p, ("nation",), "p"))


def g13(spark, sf):
    r = V.recordings(spark, sf).groupBy("cell").agg(F.corr("quantity", "response").alias("r"), F.count(F.lit(1)).alias("n"))
    return _r(r.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))))


def g18(spark, sf):
    """How many cells each of two tests passes, and both."""
    c = V.recordings(spark, sf).groupBy("area", "datakey", "cell").agg((F.max("response") > 95000).alias("one"), (F.avg("response") > 38000).alias("two"))
    return c.groupBy("area", "datakey").agg(*[F.sum(x.cast("long")).alias(n) for n, x in (("n_one", F.col("one")), ("n_two", F.col("two")), ("n_both", F.col("one") & F.col("two")))])


def g20(spark, sf):
    """d' of the first config against the last at each level of quantity."""
    r = V.recordings(spark, sf).withColumn("level", V.long(F.floor(F.col("quantity") / 10)))
    part = lambda f, k: f(F.when(F.col("config") == k, F.col("response")))
    g = r.groupBy("datakey", "level").agg(part(F.avg, 1).alias("m1"), part(F.avg, 2).alias("m2"), part(F.stddev_pop, 1).alias("s1"), part(F.stddev_pop, 2).alias("s2"))
    return _r(g.select("datakey", "level", ((F.col("m1") - F.col("m2")) / F.when(F.col("s1") + F.col("s2") != 0, (F.col("s1") + F.col("s2")) / 2)).alias("dprime")))


_CELLS = f"{V.REC}, c AS (SELECT *, quantity * 1000 AS base FROM rec)"
_AUC = "{x}, r AS (SELECT {k}, min(min(s)) OVER (PARTITION BY {c}) AS lo, (max(max(s)) OVER (PARTITION BY {c}) - min(min(s)) OVER (PARTITION BY {c})) / 49 AS step, list(s) FILTER (s IS NOT NULL) AS ss, list(b) FILTER (b IS NOT NULL) AS bb FROM {src} GROUP BY {k}), q AS (SELECT {k}, i, len(list_filter(ss, lambda z: z > lo + i * step)) / len(ss) AS h, len(list_filter(bb, lambda z: z > lo + i * step)) / len(bb) AS f FROM r, range(50) t(i)), a AS (SELECT *, lag(h) OVER w AS h0, lag(f) OVER w AS f0 FROM q WINDOW w AS (PARTITION BY {k} ORDER BY i)), u AS (SELECT {k}, sum((f0 - f) * (h + h0) / 2) AS auc FROM a GROUP BY {k})"
_RANK = "rank() OVER ({w}) + (count(*) OVER ({t}) - 1) / 2.0"
_RK = _RANK.format(w="PARTITION BY cell ORDER BY response", t="PARTITION BY cell, response")
QUERIES = {
    "g01_roc": g01, "g02_roc_null": g02, "g03_frames_beyond": g03, "g04_kruskal_wallis": g04, "g04_kruskal_wallis_p": g04p, "g05_dunn": g05, "g07_repeated_anova": g07, "g08_anova_effects": g08, "g10_mann_whitney": g10, "g11_paired": g11, "g12_corrections": g12, "g13_pearson": g13, "g18_compare_tests": g18, "g20_dprime": g20,
}
SQL = {
    "g01_roc": f"WITH {_AUC.format(x=_CELLS, k='cell, config', c='cell', src='(SELECT cell, config, response AS s, base AS b FROM c)')} SELECT cell, round(max(auc), 6) AS auc FROM u GROUP BY cell",
    "g02_roc_null": f"WITH {_AUC.format(x=_CELLS, k='cell, config', c='cell', src='(SELECT cell, config, response AS s, base AS b FROM c)')}, tr0 AS (SELECT cell, max(auc) AS auc FROM u GROUP BY cell), pool AS (SELECT cell, config, trial, 0 AS side, response AS v FROM c UNION ALL SELECT cell, config, trial, 1, base FROM c), sh AS (SELECT cell, config, it, v, row_number() OVER (PARTITION BY cell, config, it ORDER BY md5('11|' || it || '|' || trial || '|' || side), trial, side, v) * 2 <= count(*) OVER (PARTITION BY cell, config, it) AS s FROM pool, range(8) t(it)), "
    + _AUC.format(x="s2 AS (SELECT cell, config, it, CASE WHEN s THEN v END AS s, CASE WHEN NOT s THEN v END AS b FROM sh)", k="cell, config, it", c="cell, it", src="s2").replace(", r AS", ", r2 AS").replace("FROM r,", "FROM r2,").replace(", q AS", ", q2 AS").replace("FROM q WINDOW", "FROM q2 WINDOW").replace(", a AS", ", a2 AS").replace("FROM a GROUP", "FROM a2 GROUP").replace(", u AS", ", u2 AS")
    + ", n AS (SELECT cell, it, max(auc) AS shuffled FROM u2 GROUP BY ALL) SELECT cell, round(auc, 6) AS auc, round(avg(CAST(shuffled >= auc AS INT)), 6) AS p FROM n JOIN tr0 USING (cell) GROUP BY cell, auc",
    "g03_frames_beyond": f"WITH {V.TRACE}, p AS (SELECT cell, config, frame_ix, avg(value) AS mean FROM tr GROUP BY ALL), b AS (SELECT *, avg(mean) FILTER (frame_ix < 8) OVER (PARTITION BY cell, config) AS m, stddev_pop(mean) FILTER (frame_ix < 8) OVER (PARTITION BY cell, config) AS s FROM p) SELECT cell, config, count(*) FILTER (frame_ix >= 8 AND frame_ix < 14 AND (abs(mean) > abs(m) + 1.5 * s OR abs(mean) < abs(m) - 1.5 * s)) AS n_frames FROM b GROUP BY cell, config",
    "g04_kruskal_wallis": f"WITH {V.RESP}, k AS (SELECT datakey, cell, config, response, {_RK} AS rank FROM resp), t AS (SELECT cell, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT cell, response, count(*) AS t FROM k GROUP BY ALL) GROUP BY cell), g AS (SELECT datakey, cell, config, sum(rank) AS r, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT datakey, cell, sum(r * r / n) AS s, CAST(sum(n) AS DOUBLE) AS n, count(*) - 1 AS dof FROM g GROUP BY ALL) SELECT datakey, cell, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, dof FROM s JOIN t USING (cell)",
    "g05_dunn": f"WITH {V.RESP}, k AS (SELECT cell, config, {_RK} AS rank, count(*) OVER (PARTITION BY cell) AS total FROM resp), g AS (SELECT cell, total, config, avg(rank) AS m, count(*) AS n FROM k GROUP BY ALL) SELECT x.cell, x.config AS a, y.config AS b, round((x.m - y.m) / sqrt(x.total * (x.total + 1) / 12 * (1 / x.n + 1 / y.n)), 6) AS z FROM g x JOIN g y ON x.cell = y.cell AND x.config < y.config",
    "g07_repeated_anova": f"WITH {V.TRACE}, t AS (SELECT cell, trial, avg(value) FILTER (frame_ix < 8) AS a, avg(value) FILTER (frame_ix >= 8 AND frame_ix < 14) AS b, avg(value) FILTER (frame_ix >= 14) AS c FROM tr GROUP BY cell, trial), d AS (SELECT *, (a + b + c) / 3 AS m, avg((a + b + c) / 3) OVER (PARTITION BY cell) AS g FROM t), s AS (SELECT cell, sum((a - m) ** 2 + (b - m) ** 2 + (c - m) ** 2) AS w, count(*) AS n, any_value(g) AS g, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d GROUP BY cell), e AS (SELECT cell, n, w, n * ((a - g) ** 2 + (b - g) ** 2 + (c - g) ** 2) AS e FROM s WHERE n > 1) SELECT cell, round(e / 2 / ((w - e) / (2 * (n - 1))), 6) AS f, CAST(2 AS BIGINT) AS df1, 2 * (n - 1) AS df2 FROM e",
    "g08_anova_effects": f"WITH {V.RESP}, g AS (SELECT cell, config, sum(response) AS s, sum(response * response) AS q, count(*) AS n FROM resp GROUP BY ALL), t AS (SELECT cell, sum(s * s / n) - sum(s) ** 2 / sum(n) AS b, sum(q) - sum(s) ** 2 / sum(n) AS t, count(*) - 1 AS df1, CAST(sum(n) AS BIGINT) - count(*) AS df2 FROM g GROUP BY cell) SELECT cell, round(b / df1 / ((t - b) / df2), 6) AS f, df1, df2, round(b / t, 6) AS eta2, round((b - df1 * ((t - b) / df2)) / (t + (t - b) / df2), 6) AS omega2 FROM t",
    "g10_mann_whitney": f"WITH {V.REC}, m AS (SELECT area, cell, avg(response) AS m FROM rec GROUP BY ALL), p AS (SELECT x.area AS a, y.area AS b FROM (SELECT DISTINCT area FROM m) x JOIN (SELECT DISTINCT area FROM m) y ON x.area < y.area), k AS (SELECT a, b, area, rank() OVER (PARTITION BY a, b ORDER BY m) + (count(*) OVER (PARTITION BY a, b, m) - 1) / 2.0 AS rank FROM m JOIN p ON area = a OR area = b), s AS (SELECT a, b, sum(rank) FILTER (area = a) AS r, count(*) FILTER (area = a) AS n1, count(*) FILTER (area = b) AS n2 FROM k GROUP BY a, b) SELECT a, b, round(CAST(r - n1 * (n1 + 1) / 2 AS DOUBLE), 6) AS u, round((r - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) AS z FROM s",
    "g11_paired": f"WITH {V.REC}, m AS (SELECT area, cell, avg(response) FILTER (datakey = 'AF') - avg(response) FILTER (datakey = 'RF') AS d FROM rec GROUP BY ALL), t AS (SELECT area, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, count(d) - 1 AS dof FROM m WHERE d IS NOT NULL GROUP BY area), k AS (SELECT area, d, rank() OVER (PARTITION BY area ORDER BY abs(d)) + (count(*) OVER (PARTITION BY area, abs(d)) - 1) / 2.0 AS rank FROM m WHERE d <> 0), w AS (SELECT area, CAST(least(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), sum(CASE WHEN d < 0 THEN rank ELSE 0 END)) AS DOUBLE) AS w FROM k GROUP BY area) SELECT * FROM t JOIN w USING (area)",
    "g12_corrections": "WITH p AS (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, (c_acctbal + 1000) / 220000 + c_custkey * 1e-9 AS p FROM customer), k AS (SELECT *, count(*) OVER (PARTITION BY nation) AS m, row_number() OVER (PARTITION BY nation ORDER BY p) AS k FROM p), c AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda i: 1.0::DOUBLE / i)) AS c FROM k) SELECT c_custkey, nation, round(p, 6) AS p, round(least(1, p * m), 6) AS bonferroni, round(1 - (1 - p) ** m, 6) AS sidak, round(least(1, max(p * (m - k + 1)) OVER (PARTITION BY nation ORDER BY p ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1, min(p * m / k) OVER (PARTITION BY nation ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr_bh, round(least(1, min(p * m / k * c) OVER (PARTITION BY nation ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS fdr_by FROM c",
    "g13_pearson": f"WITH {V.REC}, g AS (SELECT cell, corr(quantity, response) AS r, count(*) AS n FROM rec GROUP BY cell) SELECT cell, round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM g",
    "g18_compare_tests": f"WITH {V.REC}, c AS (SELECT area, datakey, cell, max(response) > 95000 AS one, avg(response) > 38000 AS two FROM rec GROUP BY ALL) SELECT area, datakey, count(*) FILTER (one) AS n_one, count(*) FILTER (two) AS n_two, count(*) FILTER (one AND two) AS n_both FROM c GROUP BY ALL",
    "g20_dprime": f"WITH {V.REC}, g AS (SELECT datakey, CAST(floor(quantity / 10) AS BIGINT) AS level, avg(response) FILTER (config = 1) AS m1, avg(response) FILTER (config = 2) AS m2, stddev_pop(response) FILTER (config = 1) AS s1, stddev_pop(response) FILTER (config = 2) AS s2 FROM rec GROUP BY ALL) SELECT datakey, level, round((m1 - m2) / nullif((s1 + s2) / 2, 0), 6) AS dprime FROM g",
}
