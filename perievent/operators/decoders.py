"""Further decoders and bootstraps on top of models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.operators.metrics import _rounded as _r
from perievent.operators.models import bootstrap_means, fit_orientation
from perievent.plans import views as V


def split_plot(trials: DataFrame, keys: tuple[str, ...], between: str, subject: str, levels: tuple[str, ...]) -> DataFrame:
    """Split-plot F of the levels (within subjects), of the groups (between), and of both: a row a subject."""
    k = len(levels)
    d = trials.withColumn("m", sum(F.col(c) for c in levels) / k)
    w, g = W.partitionBy(*keys), W.partitionBy(*keys, between)
    d = d.withColumns({"grand": F.avg("m").over(w), "gm": F.avg("m").over(g), **{f"l_{c}": F.avg(c).over(w) for c in levels}, **{f"c_{c}": F.avg(c).over(g) for c in levels}})
    sq = lambda c: c * c
    s = d.groupBy(*keys).agg(
        F.countDistinct(between).alias("a"), F.count(F.lit(1)).alias("n"), (k * F.sum(sq(F.col("gm") - F.col("grand")))).alias("ss_a"), (k * F.sum(sq(F.col("m") - F.col("gm")))).alias("ss_sa"), sum(F.sum(sq(F.col(f"l_{c}") - F.col("grand"))) for c in levels).alias("ss_b"),
        sum(F.sum(sq(F.col(f"c_{c}") - F.col("gm") - F.col(f"l_{c}") + F.col("grand"))) for c in levels).alias("ss_ab"), sum(F.sum(sq(F.col(c) - F.col("m") - F.col(f"c_{c}") + F.col("gm"))) for c in levels).alias("ss_e"),
    )
    a1, na = F.col("a") - 1, F.col("n") - F.col("a")
    e = F.col("ss_e") / (na * (k - 1))
    s = s.filter((F.col("a") > 1) & (F.col("n") > F.col("a")))
    return s.select(*keys, (F.col("ss_a") / a1 / (F.col("ss_sa") / na)).alias("f_between"), (F.col("ss_b") / (k - 1) / e).alias("f_within"), (F.col("ss_ab") / (a1 * (k - 1)) / e).alias("f_both"))


def g06(spark, sf):
    f = F.col("frame_ix")
    t = V.traces(spark, sf).groupBy("config", F.floor(F.col("cell") / 30).alias("block"), "cell", "trial").agg(F.avg(F.when(f < 8, F.col("value"))).alias("pre"), F.avg(F.when((f >= 8) & (f < 14), F.col("value"))).alias("on"), F.avg(F.when(f >= 14, F.col("value"))).alias("post"))
    return _r(split_plot(t, ("block",), "config", "trial", ("pre", "on", "post")))


def i03(spark, sf):
    """Fits averaged over iterations: modal preference, mean indices, how many were good."""
    fits = fit_orientation(bootstrap_means(V.responses(spark, sf), 20, 4, 8), 36.0)
    b = F.floor(F.col("pref") / (360 / 49)).cast("long")
    n = fits.groupBy("cell", b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg((F.max_by("bin", F.struct("n", -F.col("bin"))) * (360 / 49)).alias("mode"))
    return _r(fits.groupBy("cell").agg(F.avg("asi").alias("asi"), F.avg("dsi").alias("dsi"), F.avg("r2").alias("r2"), F.sum(F.col("good").cast("long")).alias("n_good")).join(n, "cell"))


_SP = ("pre", "on", "post")
QUERIES = {"g06_split_plot": g06, "i03_fit_summary": i03}
SQL = {
    "g06_split_plot": f"WITH {V.TRACE}, t AS (SELECT config, cell // 30 AS block, avg(value) FILTER (frame_ix < 8) AS p, avg(value) FILTER (frame_ix >= 8 AND frame_ix < 14) AS o, avg(value) FILTER (frame_ix >= 14) AS q FROM tr GROUP BY config, cell, trial), d AS (SELECT *, (p + o + q) / 3 AS m, avg((p + o + q) / 3) OVER b AS g, avg((p + o + q) / 3) OVER c AS gm, avg(p) OVER b AS lp, avg(o) OVER b AS lo, avg(q) OVER b AS lq, avg(p) OVER c AS cp, avg(o) OVER c AS co, avg(q) OVER c AS cq FROM t WINDOW b AS (PARTITION BY block), c AS (PARTITION BY block, config)), s AS (SELECT block, count(DISTINCT config) AS a, count(*) AS n, 3 * sum((gm - g) ** 2) AS sa, 3 * sum((m - gm) ** 2) AS ssa, sum((lp - g) ** 2 + (lo - g) ** 2 + (lq - g) ** 2) AS sb, sum((cp - gm - lp + g) ** 2 + (co - gm - lo + g) ** 2 + (cq - gm - lq + g) ** 2) AS sab, sum((p - m - cp + gm) ** 2 + (o - m - co + gm) ** 2 + (q - m - cq + gm) ** 2) AS se FROM d GROUP BY block) SELECT block, round(sa / (a - 1) / (ssa / (n - a)), 6) AS f_between, round(sb / 2 / (se / ((n - a) * 2)), 6) AS f_within, round(sab / ((a - 1) * 2) / (se / ((n - a) * 2)), 6) AS f_both FROM s WHERE a > 1 AND n > a",
}
