"""Smaller operators: selections, joins and summaries that compose the others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.functions import circular
from perievent.operators.joins import keep, seeded_order, top
from perievent.operators.metrics import _rounded as _r
from perievent.operators.metrics import by_config
from perievent.plans import views as V
from perievent.plans.order import numbered


def reliability(responses: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """Split-half reliability: for each n, 2n trials of each config are taken by seeded order and dealt in two halves by
    turns; the halves' mean responses are correlated over cells, then averaged over configs."""
    t = responses.select("config", "trial").distinct()
    t = t.withColumn("k", F.row_number().over(W.partitionBy("config").orderBy(seeded_order(seed, "trial"), "trial")))
    t = t.withColumn("n", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes]))).filter("k <= 2 * n").withColumn("half", F.col("k") % 2)
    m = responses.join(t, ["config", "trial"]).groupBy("n", "config", "cell").agg(F.avg(F.when(F.col("half") == 0, F.col("response"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("response"))).alias("b"))
    r = m.groupBy("n", "config").agg(F.corr("a", "b").alias("r"))
    return r.groupBy("n").agg(F.avg("r").alias("mean"), (F.stddev_samp("r") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def density(points: DataFrame, value: str, weight: str, low: float, high: float, n: int) -> DataFrame:
    """A weighted Gaussian density on n grid points, width by Scott's rule with the effective number of points. Equal
    values are summed first; a grid point meets each distinct value once."""
    p = points.groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(weight)).alias("w2"))
    s = p.agg(F.sum("w").alias("sw"), F.sum("w2").alias("sw2"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("v") * F.col("v")) / F.sum("w")).alias("q"))
    s = s.select("sw", (F.sqrt((F.col("q") - F.col("m") * F.col("m")) / (1 - F.col("sw2") / (F.col("sw") * F.col("sw")))) * F.pow(F.col("sw") * F.col("sw") / F.col("sw2"), F.lit(-0.2))).alias("h"))
    g = p.crossJoin(F.broadcast(s)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))
    x = F.lit(low) + F.col("k") * (high - low) / (n - 1)
    return g.groupBy("k").agg((F.sum(F.col("w") / F.col("sw") * F.exp(-F.pow((x - F.col("v")) / F.col("h"), 2) / 2) / (F.col("h") * math.sqrt(2 * math.pi)))).alias("density"))


def a10(spark, sf):
    o = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("experiment")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.countDistinct("o_custkey").alias("n"))
    return o.select("experiment", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"), "n")


def a17(spark, sf):
    """Records as JSON text."""
    n = V.table(spark, sf, "nation").join(V.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("r_name").alias("region"))).alias("record"))


def b01(spark, sf):
    return _r(V.recordings(spark, sf).filter(F.col("cell").isin(1, 5, 9, 14) & (F.col("area") == 2)).groupBy("cell", "datakey").agg(F.avg("response").alias("mean"), F.count(F.lit(1)).alias("n")))


def b11(spark, sf):
    m = V.recordings(spark, sf).groupBy("datakey", "cell", "config").agg(F.avg("response").alias("m")).groupBy("datakey", "cell").agg(F.avg("m").alias("m"))
    return _r(m.filter("m between 37000 and 39000"))


def b12(spark, sf):
    return V.recordings(spark, sf).filter("quantity >= 48").select("datakey", "cell").distinct()


def b14(spark, sf):
    g = V.recordings(spark, sf).groupBy("cell", "config").agg(F.corr("quantity", "response").alias("fit"))
    return _r(g.filter("fit >= 0.7").groupBy("cell").agg(F.avg("fit").alias("fit"), F.count(F.lit(1)).alias("n")).filter("fit >= 0.8"))


def b16(spark, sf):
    g = V.recordings(spark, sf).groupBy("datakey").agg(F.regr_r2(F.when(F.col("config") == 1, F.col("response")), "quantity").alias("az"), F.regr_r2(F.when(F.col("config") == 2, F.col("response")), "quantity").alias("el"))
    return _r(g.select("datakey", "az", "el", ((F.col("az") > 0.5) & (F.col("el") > 0.5)).alias("both"), ((F.col("az") > 0.5) | (F.col("el") > 0.5)).alias("either")))


def b20(spark, sf):
    return V.traces(spark, sf, False).select("cell", "frame", F.when(F.col("value") >= 20, F.col("value")).otherwise(0.0).alias("value"))


def c06(spark, sf):
    a = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"))
    return keep(a, V.recordings(spark, sf).filter("datakey = 'NO' and response > 100000"), ["cell"])


def c07(spark, sf):
    """Fits of repeated runs averaged: means of parameters, the angle's direction."""
    r = V.recordings(spark, sf).withColumn("theta", F.col("quantity") / 8)
    g = r.groupBy("area", "cell").agg(F.avg("response").alias("size"), circular.circular_mean(F.col("theta")).alias("theta"))
    return _r(g.select("area", "cell", "size", F.cos("theta").alias("cos_theta")))


def c11(spark, sf):
    """Configs renamed after the master list of (type, size)."""
    s = V.stimuli(spark, sf)
    master = s.groupBy("type", "size").agg(F.min("config").alias("master"))
    return s.join(master, ["type", "size"]).select("config", "master")


def c12(spark, sf):
    """Trials that both tables have."""
    a = V.table(spark, sf, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("trial"))
    b = V.table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("trial")).distinct()
    return a.join(b, "trial")


def c17(spark, sf):
    """Events within each user's first and last signup."""
    e = V.table(spark, sf, "events")
    b = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return e.join(b, "user_id").filter("ts between a and z").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def c19(spark, sf):
    """Each dataset's cells against a short list of sizes: share of responses that reach each."""
    m = V.recordings(spark, sf).groupBy("datakey", "cell").agg(F.max("response").alias("m"))
    sizes = spark.createDataFrame([(95000.0,), (99000.0,), (101000.0,)], "size double")
    return _r(m.crossJoin(F.broadcast(sizes)).groupBy("datakey", "size").agg(F.avg((F.col("m") >= F.col("size")).cast("double")).alias("share")))


def d08(spark, sf):
    return _r(V.traces(spark, sf).groupBy("frame_ix").agg(F.avg("value").alias("grand"), F.stddev_pop("value").alias("sd")))


def d17(spark, sf):
    r = V.recordings(spark, sf).groupBy("datakey", "config").agg(F.avg("response").alias("mean"), (F.stddev_samp("response") / F.sqrt(F.count(F.lit(1)))).alias("sem"), (F.count(F.lit(1)) - 1).alias("dof"))
    return _r(r)


def d20(spark, sf):
    c = V.table(spark, sf, "customer")
    return _r(c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd"), F.count(F.lit(1)).alias("n")))


def d26(spark, sf):
    r = V.recordings(spark, sf).withColumn("t", F.col("quantity") * 6)
    s, c = F.avg(F.sin(F.radians("t"))), F.avg(F.cos(F.radians("t")))
    return _r(r.groupBy("datakey").agg(F.avg("response").alias("amp"), F.sqrt(s * s + c * c).alias("concentration")))


def d28(spark, sf):
    return _r(density(V.stimuli(spark, sf).withColumn("w", F.col("speed") / 1000), "size", "w", 0.0, 50.0, 26))


def d29(spark, sf):
    """Local maxima and minima of the density, and its centre."""
    w = W.orderBy("k")
    d = density(V.stimuli(spark, sf).withColumn("w", 1 + F.pow(F.sin(F.col("size") / 4.0), 2)), "size", "w", 0.0, 50.0, 51)
    d = d.withColumns({"p": F.lag("density").over(w), "q": F.lead("density").over(w)})
    kind = F.when((F.col("density") > F.col("p")) & (F.col("density") > F.col("q")), "max").when((F.col("density") < F.col("p")) & (F.col("density") < F.col("q")), "min")
    return d.withColumn("kind", kind).filter("kind is not null").select("k", "kind")


def d32(spark, sf):
    """Share of one choice and of right ones by level."""
    l = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 2000).cast("long").alias("level")), "doc_id")
    return _r(l.groupBy("level").agg(F.avg(F.col("toxic").cast("double")).alias("p_choose"), F.avg((F.col("quality") != F.col("toxic")).cast("double")).alias("p_right"), F.count(F.lit(1)).alias("n")))


def d38(spark, sf):
    return _r(reliability(V.responses(spark, sf), [2, 5, 10], 4))


def d39(spark, sf):
    """Per trial: mean, least and largest in baseline and stimulus windows, first difference, flagged frames."""
    f, v = F.col("frame_ix"), F.col("value")
    base, stim = f < V.STIM_ON, (f >= V.STIM_ON) & (f < V.STIM_ON + V.N_ON)
    g = V.traces(spark, sf).withColumn("step", v - F.lag("value").over(W.partitionBy("cell", "trial").orderBy("frame_ix"))).groupBy("cell", "trial")
    return _r(g.agg(F.avg(F.when(base, v)).alias("base_mean"), F.min(F.when(stim, v)).alias("stim_min"), F.max(F.when(stim, v)).alias("stim_max"), F.avg(F.abs("step")).alias("motion"), F.sum((stim & (F.col("event_type") == "error")).cast("long")).alias("n_flags")))


def e09(spark, sf):
    """Trials brought to one length, short ones filled with their last value."""
    t = V.traces(spark, sf).filter("frame_ix < 12 + cell % 6")
    grid = t.select("cell", "trial").distinct().withColumn("frame_ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    w = W.partitionBy("cell", "trial").orderBy("frame_ix")
    return grid.join(t.select("cell", "trial", "frame_ix", "value"), ["cell", "trial", "frame_ix"], "left").select("cell", "trial", "frame_ix", F.last("value", True).over(w).alias("value"))


def e29(spark, sf):
    f = F.col("frame_ix")
    return _r(V.traces(spark, sf).groupBy("cell", "trial").agg(F.avg(F.when(f < V.STIM_ON, F.col("value"))).alias("pre"), F.avg(F.when((f >= V.STIM_ON) & (f < V.STIM_ON + V.N_ON), F.col("value"))).alias("stimulus"), F.avg("value").alias("all")))


def e34(spark, sf):
    """Cyclic trials laid over each other: the mean frame of each condition's cycle of five."""
    return _r(V.traces(spark, sf).groupBy("cell", "config", (F.col("frame_ix") % 5).alias("phase")).agg(F.avg("value").alias("value")))


def e35(spark, sf):
    """A moving mean of five with reflected edges, in each trial."""
    n = V.TRIAL_FRAMES
    t = V.traces(spark, sf).select("cell", "trial", "frame_ix", "value")
    left = t.filter("frame_ix in (0, 1)").select("cell", "trial", (-F.col("frame_ix") - 1).alias("frame_ix"), "value")
    right = t.filter(F.col("frame_ix") >= n - 2).select("cell", "trial", (2 * n - 1 - F.col("frame_ix")).alias("frame_ix"), "value")
    w = W.partitionBy("cell", "trial").orderBy("frame_ix").rowsBetween(-2, 2)
    s = t.unionByName(left).unionByName(right).withColumn("smooth", F.avg("value").over(w))
    return _r(s.filter((F.col("frame_ix") >= 0) & (F.col("frame_ix") < n)).select("cell", "trial", "frame_ix", "smooth"))


def f06(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 17 - 8.0).alias("y"), (F.col("c_nationkey") - 12.0).alias("z"))
    a, e, r = circular.spherical(F.col("x"), F.col("y"), F.col("z"))
    return _r(c.select("c_custkey", a.alias("azimuth"), e.alias("elevation"), r.alias("radius")))


def f10(spark, sf):
    from perievent.operators.maps import masks

    m = masks(spark, sf).groupBy("cell").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    m = numbered(m, [F.col(c) for c in ("cx", "cy", "cell")], "place")
    return _r(m.select("cell", (500 - F.col("cx") * 2.3).alias("ml"), (300 - F.col("cy") * 1.9).alias("ap"), "place"))


def f16(spark, sf):
    """Polygon areas by the shoelace formula over ordered vertices."""
    o = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").alias("x"), F.floor(F.col("l_tax") * 100 + 0.5).alias("y"))
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    n = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    o = o.withColumns({"x2": n("x"), "y2": n("y")})
    return _r(o.groupBy("l_orderkey").agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y"))) / 2).alias("area")))


def f31(spark, sf):
    """Positions to grid cells."""
    return V.stimuli(spark, sf).select("config", V.long(F.width_bucket(F.col("size").cast("double"), F.lit(0.0), F.lit(51.0), F.lit(6))).alias("row"), V.long(F.width_bucket("speed", F.lit(900.0), F.lit(2000.0), F.lit(8))).alias("col"))


def g15(spark, sf):
    """Differences of two baseline trials drawn for each cell by seeded order, and the share above zero."""
    t = V.traces(spark, sf).filter(F.col("frame_ix") < V.STIM_ON).groupBy("cell", "trial").agg(F.avg("value").alias("b"))
    d = t.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(4))))
    k = d.withColumn("k", F.row_number().over(W.partitionBy("cell", "it").orderBy(seeded_order(6, "it", "trial"), "trial"))).filter("k <= 2")
    g = k.groupBy("cell", "it").agg(F.sum(F.when(F.col("k") == 1, F.col("b")).otherwise(-F.col("b"))).alias("d"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    return _r(g.groupBy("cell").agg(F.avg("d").alias("mean"), F.avg((F.col("d") > 0).cast("double")).alias("above")))


def h05(spark, sf):
    """Mean correlation of a cell's trials with each other."""
    t = V.traces(spark, sf)
    a, b = t.select("cell", "frame_ix", F.col("trial").alias("a"), F.col("value").alias("va")), t.select("cell", "frame_ix", F.col("trial").alias("b"), F.col("value").alias("vb"))
    r = a.join(b, ["cell", "frame_ix"]).filter("a < b").groupBy("cell", "a", "b").agg(F.corr("va", "vb").alias("r"))
    return _r(r.groupBy("cell").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n")))


def h26(spark, sf):
    """Distance of each value from its regression's prediction, long form."""
    r = V.recordings(spark, sf).groupBy("area", "cell").agg(F.avg("quantity").alias("x"), F.avg("response").alias("y"))
    fit = r.groupBy("area").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    s = r.join(fit, "area").select("area", "cell", F.abs(F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("scatter"), (F.col("a") + F.col("b") * F.col("x")).alias("predicted"))
    return _r(s.unpivot(["area", "cell"], ["scatter", "predicted"], "metric", "value"))


def h32(spark, sf):
    """Correlation of two tuning curves of a cell over configs."""
    m = V.recordings(spark, sf).groupBy("cell", "config").agg(F.avg("response").alias("r"), F.avg("quantity").alias("q"))
    return _r(m.groupBy("cell").agg(F.corr("r", "q").alias("r")))


def i07(spark, sf):
    """Cells outside their area's regression band."""
    r = V.recordings(spark, sf).groupBy("area", "cell").agg(F.avg("quantity").alias("x"), F.avg("response").alias("y"))
    fit = r.groupBy("area").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    s = r.join(fit, "area").withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    s = s.withColumn("sd", F.stddev_samp("e").over(W.partitionBy("area")))
    return s.select("area", "cell", (F.round(F.abs("e"), 6) > F.round(1.5 * F.col("sd"), 6)).alias("deviant"))


def j04(spark, sf):
    m = by_config(V.responses(spark, sf)).groupBy("cell").agg(F.max("response").alias("m"))
    return numbered(m, [F.desc("m"), F.col("cell")], "place").select("cell", "place")


def n01(spark, sf):
    """Seconds to frames, and whether a trial's windows fit."""
    s = V.stimuli(spark, sf).select("config", (F.col("size") / 10).alias("stim"), (F.col("speed") / 500).alias("iti"))
    fr = lambda c: F.floor(c * 44.65 + 0.5)
    return s.select("config", fr(F.col("stim")).alias("n_on"), fr(F.col("iti") / 2).alias("n_post"), (F.col("stim") + 1 + F.col("iti") / 2 <= F.col("stim") + F.col("iti")).alias("fits"))


def n07(spark, sf):
    """How many cells respond in each set of experiments."""
    r = V.recordings(spark, sf).filter("response > 98000").groupBy("cell").agg(F.array_join(F.array_sort(F.collect_set("datakey")), "+").alias("experiments"))
    return r.groupBy("experiments").agg(F.count(F.lit(1)).alias("n_cells"))


def n10(spark, sf):
    """Trials by configs, wide, of each cell."""
    t = V.responses(spark, sf)
    t = t.withColumn("rep", V.long(F.row_number().over(W.partitionBy("cell", "config").orderBy("trial"))))
    return _r(t.groupBy("cell", "rep").pivot("config", list(range(10))).agg(F.first("response")).select("cell", "rep", *[F.col(str(k)).alias(f"config{k}") for k in range(10)]))


def i04(spark, sf):
    m = V.recordings(spark, sf).groupBy("cell", "datakey", "config").agg(F.avg("response").alias("r"))
    return _r(top(m, ("cell",), [F.desc("r"), F.col("datakey"), F.col("config")]))


_KDE = "p AS (SELECT CAST(size AS DOUBLE) AS v, sum(w) AS w, sum(w * w) AS w2 FROM d GROUP BY 1), s0 AS (SELECT sum(w) AS sw, sum(w2) AS sw2, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) AS q FROM p), s AS (SELECT sw, sqrt((q - m * m) / (1 - sw2 / (sw * sw))) * (sw * sw / sw2) ** -0.2 AS h FROM s0), k AS (SELECT k, sum(w / sw * exp(-(((k * 50.0 / {n} - v) / h) ** 2) / 2) / (h * sqrt(2 * pi()))) AS density FROM p, s, range({m}) t(k) GROUP BY k)"
_MASK = "m AS (SELECT s_suppkey AS cell, s_suppkey * 3 % 50 + dy AS y, s_suppkey * 2 % 50 + dx AS x FROM supplier, range(5) a(dy), range(5) b(dx))"
QUERIES = {
    "a10_stimulation_info": a10, "a17_json_records": a17, "b01_cell_list": b01, "b11_mean_band": b11, "b12_overlap": b12, "b14_good_fits": b14, "b16_gradient_fits": b16, "b20_event_floor": b20, "c06_cells_in": c06, "c07_averaged_fits": c07, "c11_master_configs": c11, "c12_matched_trials": c12, "c17_bounded_events": c17, "c19_size_shares": c19,
    "d08_grand_mean": d08, "d17_mean_sem": d17, "d20_group_means": d20, "d26_circular_average": d26, "d28_density": d28, "d29_density_extrema": d29, "d32_choices": d32, "d38_split_half": d38, "d39_trial_windows": d39, "e09_equal_lengths": e09, "e29_epoch_average": e29, "e34_cycle_average": e34, "e35_reflected_mean": e35, "f06_spherical": f06, "f10_centroids": f10, "f16_polygon_area": f16, "f31_grid_cells": f31,
    "g15_baseline_null": g15, "h05_trial_correlation": h05, "h26_scatter": h26, "h32_curve_correlation": h32, "i04_best_set": i04, "i07_deviants": i07, "j04_sorted_cells": j04, "n01_frame_counts": n01, "n07_response_sets": n07, "n10_wide_trials": n10,
}
SQL = {
    "a10_stimulation_info": "SELECT o_orderpriority AS experiment, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    "a17_json_records": "SELECT n_nationkey, '{\"name\":\"' || n_name || '\",\"region\":\"' || r_name || '\"}' AS record FROM nation JOIN region ON n_regionkey = r_regionkey",
    "b01_cell_list": f"WITH {V.REC} SELECT cell, datakey, round(avg(response), 6) AS mean, count(*) AS n FROM rec WHERE cell IN (1, 5, 9, 14) AND area = 2 GROUP BY ALL",
    "b11_mean_band": f"WITH {V.REC}, m AS (SELECT datakey, cell, config, avg(response) AS m FROM rec GROUP BY ALL) SELECT datakey, cell, round(avg(m), 6) AS m FROM m GROUP BY ALL HAVING avg(m.m) BETWEEN 37000 AND 39000",
    "b12_overlap": f"WITH {V.REC} SELECT DISTINCT datakey, cell FROM rec WHERE quantity >= 48",
    "b14_good_fits": f"WITH {V.REC}, g AS (SELECT cell, config, corr(quantity, response) AS fit FROM rec GROUP BY ALL) SELECT cell, round(avg(fit), 6) AS fit, count(*) AS n FROM g WHERE fit >= 0.7 GROUP BY cell HAVING avg(g.fit) >= 0.8",
    "b16_gradient_fits": f"WITH {V.REC}, g AS (SELECT datakey, regr_r2(CASE WHEN config = 1 THEN response END, quantity) AS az, regr_r2(CASE WHEN config = 2 THEN response END, quantity) AS el FROM rec GROUP BY datakey) SELECT datakey, round(az, 6) AS az, round(el, 6) AS el, az > 0.5 AND el > 0.5 AS \"both\", az > 0.5 OR el > 0.5 AS either FROM g",
    "b20_event_floor": f"WITH {V.TRACE} SELECT cell, frame, CASE WHEN value >= 20 THEN value ELSE 0 END AS value FROM trall",
    "c06_cells_in": f"WITH {V.REC} SELECT s_suppkey AS cell FROM supplier WHERE s_suppkey IN (SELECT cell FROM rec WHERE datakey = 'NO' AND response > 100000)",
    "c07_averaged_fits": f"WITH {V.REC} SELECT area, cell, round(avg(response), 6) AS size, round(cos(atan2(avg(sin(quantity / 8)), avg(cos(quantity / 8)))), 6) AS cos_theta FROM rec GROUP BY area, cell",
    "c11_master_configs": f"WITH {V.STIM} SELECT config, min(config) OVER (PARTITION BY type, size) AS master FROM stim",
    "c12_matched_trials": "SELECT o_orderkey AS trial FROM orders WHERE o_totalprice > 250000 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)",
    "c17_bounded_events": "WITH b AS (SELECT user_id, min(ts) AS a, max(ts) AS z FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT user_id, count(*) AS n FROM events JOIN b USING (user_id) WHERE ts BETWEEN a AND z GROUP BY user_id",
    "c19_size_shares": f"WITH {V.REC}, m AS (SELECT datakey, cell, max(response) AS m FROM rec GROUP BY ALL) SELECT datakey, CAST(size AS DOUBLE) AS size, round(avg(CAST(m >= size AS INT)), 6) AS share FROM m, (VALUES (95000.0), (99000.0), (101000.0)) v(size) GROUP BY datakey, size",
    "d08_grand_mean": f"WITH {V.TRACE} SELECT frame_ix, round(avg(value), 6) AS grand, round(stddev_pop(value), 6) AS sd FROM tr GROUP BY frame_ix",
    "d17_mean_sem": f"WITH {V.REC} SELECT datakey, config, round(avg(response), 6) AS mean, round(stddev_samp(response) / sqrt(count(*)), 6) AS sem, count(*) - 1 AS dof FROM rec GROUP BY datakey, config",
    "d20_group_means": "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, count(*) AS n FROM customer GROUP BY 1",
    "d26_circular_average": f"WITH {V.REC}, t AS (SELECT datakey, response, radians(quantity * 6) AS t FROM rec) SELECT datakey, round(avg(response), 6) AS amp, round(sqrt(avg(sin(t)) ** 2 + avg(cos(t)) ** 2), 6) AS concentration FROM t GROUP BY datakey",
    "d28_density": f"WITH {V.STIM}, d AS (SELECT size, speed / 1000 AS w FROM stim), {_KDE.format(n=25, m=26)} SELECT k, round(density, 6) AS density FROM k",
    "d29_density_extrema": f"WITH {V.STIM}, d AS (SELECT size, 1 + sin(size / 4) ** 2 AS w FROM stim), {_KDE.format(n=50, m=51)}, e AS (SELECT k, density, lag(density) OVER (ORDER BY k) AS p, lead(density) OVER (ORDER BY k) AS q FROM k) SELECT k, CASE WHEN density > p THEN 'max' ELSE 'min' END AS kind FROM e WHERE density > p AND density > q OR density < p AND density < q",
    "d32_choices": "WITH l AS (SELECT CAST(floor(n_chars / 2000) AS BIGINT) AS level, quality, toxic FROM labels JOIN documents USING (doc_id)) SELECT level, round(avg(toxic), 6) AS p_choose, round(avg(CAST(quality <> toxic AS INT)), 6) AS p_right, count(*) AS n FROM l GROUP BY level",
    "d38_split_half": f"WITH {V.RESP}, t AS (SELECT config, trial, row_number() OVER (PARTITION BY config ORDER BY md5('4|' || trial), trial) AS k FROM (SELECT DISTINCT config, trial FROM resp)), h AS (SELECT config, trial, n, k % 2 AS half FROM t, (VALUES (2), (5), (10)) v(n) WHERE k <= 2 * n), m AS (SELECT n, config, cell, avg(response) FILTER (half = 0) AS a, avg(response) FILTER (half = 1) AS b FROM resp JOIN h USING (config, trial) GROUP BY n, config, cell), r AS (SELECT n, config, corr(a, b) AS r FROM m GROUP BY ALL) SELECT CAST(n AS BIGINT) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r) / sqrt(count(*)), 6) AS sem FROM r GROUP BY n",
    "d39_trial_windows": f"WITH {V.TRACE}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY cell, trial ORDER BY frame_ix) AS step, frame_ix >= 8 AND frame_ix < 14 AS st FROM tr) SELECT cell, trial, round(avg(value) FILTER (frame_ix < 8), 6) AS base_mean, round(min(value) FILTER (st), 6) AS stim_min, round(max(value) FILTER (st), 6) AS stim_max, round(avg(abs(step)), 6) AS motion, count(*) FILTER (st AND event_type = 'error') AS n_flags FROM s GROUP BY cell, trial",
    "e09_equal_lengths": f"WITH {V.TRACE}, t AS (SELECT * FROM tr WHERE frame_ix < 12 + cell % 6), g AS (SELECT DISTINCT cell, trial, i FROM t, range(16) r(i)) SELECT g.cell, g.trial, g.i AS frame_ix, last_value(t.value IGNORE NULLS) OVER (PARTITION BY g.cell, g.trial ORDER BY g.i) AS value FROM g LEFT JOIN t ON t.cell = g.cell AND t.trial = g.trial AND t.frame_ix = g.i",
    "e29_epoch_average": f"WITH {V.TRACE} SELECT cell, trial, round(avg(value) FILTER (frame_ix < 8), 6) AS pre, round(avg(value) FILTER (frame_ix >= 8 AND frame_ix < 14), 6) AS stimulus, round(avg(value), 6) AS \"all\" FROM tr GROUP BY cell, trial",
    "e34_cycle_average": f"WITH {V.TRACE} SELECT cell, config, frame_ix % 5 AS phase, round(avg(value), 6) AS value FROM tr GROUP BY ALL",
    "e35_reflected_mean": f"WITH {V.TRACE}, u AS (SELECT cell, trial, frame_ix, value FROM tr UNION ALL SELECT cell, trial, -frame_ix - 1, value FROM tr WHERE frame_ix < 2 UNION ALL SELECT cell, trial, 39 - frame_ix, value FROM tr WHERE frame_ix >= 18), s AS (SELECT cell, trial, frame_ix, avg(value) OVER (PARTITION BY cell, trial ORDER BY frame_ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM u) SELECT cell, trial, frame_ix, round(s, 6) AS smooth FROM s WHERE frame_ix >= 0 AND frame_ix < 20",
    "f06_spherical": "WITH c AS (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 17 - 8 AS y, c_nationkey - 12 AS z FROM customer) SELECT c_custkey, round(atan2(y, x), 6) AS azimuth, round(atan2(z, sqrt(x * x + y * y)), 6) AS elevation, round(sqrt(x * x + y * y + z * z), 6) AS radius FROM c",
    "f10_centroids": f"WITH {_MASK}, c AS (SELECT cell, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY cell) SELECT cell, round(500 - cx * 2.3, 6) AS ml, round(300 - cy * 1.9, 6) AS ap, row_number() OVER (ORDER BY cx, cy, cell) AS place FROM c",
    "f16_polygon_area": "WITH o AS (SELECT l_orderkey, l_quantity AS x, floor(l_tax * 100 + 0.5) AS y, coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER w) AS x2, coalesce(lead(floor(l_tax * 100 + 0.5)) OVER w, first_value(floor(l_tax * 100 + 0.5)) OVER w) AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)) SELECT l_orderkey, round(abs(sum(x * y2 - x2 * y)) / 2, 6) AS area FROM o GROUP BY l_orderkey",
    "f31_grid_cells": f"WITH {V.STIM} SELECT config, CAST(CASE WHEN size < 0 THEN 0 WHEN size >= 51 THEN 7 ELSE floor(size / (51.0 / 6)) + 1 END AS BIGINT) AS row, CAST(CASE WHEN speed < 900 THEN 0 WHEN speed >= 2000 THEN 9 ELSE floor((speed - 900) / (1100.0 / 8)) + 1 END AS BIGINT) AS col FROM stim",
    "g15_baseline_null": f"WITH {V.TRACE}, b AS (SELECT cell, trial, avg(value) AS b FROM tr WHERE frame_ix < 8 GROUP BY ALL), k AS (SELECT cell, it, b, row_number() OVER (PARTITION BY cell, it ORDER BY md5('6|' || it || '|' || trial), trial) AS k FROM b, range(5) t(it)), g AS (SELECT cell, it, sum(CASE WHEN k = 1 THEN b ELSE -b END) AS d FROM k WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2) SELECT cell, round(avg(d), 6) AS mean, round(avg(CAST(d > 0 AS INT)), 6) AS above FROM g GROUP BY cell",
    "h05_trial_correlation": f"WITH {V.TRACE}, r AS (SELECT x.cell, x.trial AS a, y.trial AS b, corr(x.value, y.value) AS r FROM tr x JOIN tr y ON x.cell = y.cell AND x.frame_ix = y.frame_ix AND x.trial < y.trial GROUP BY ALL) SELECT cell, round(avg(r), 6) AS r, count(*) AS n FROM r GROUP BY cell",
    "h26_scatter": f"WITH {V.REC}, r AS (SELECT area, cell, avg(quantity) AS x, avg(response) AS y FROM rec GROUP BY ALL), f AS (SELECT area, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r GROUP BY area) SELECT area, cell, 'scatter' AS metric, round(abs(y - a - b * x), 6) AS value FROM r JOIN f USING (area) UNION ALL SELECT area, cell, 'predicted', round(a + b * x, 6) FROM r JOIN f USING (area)",
    "h32_curve_correlation": f"WITH {V.REC}, m AS (SELECT cell, config, avg(response) AS r, avg(quantity) AS q FROM rec GROUP BY ALL) SELECT cell, round(corr(r, q), 6) AS r FROM m GROUP BY cell",
    "i04_best_set": f"WITH {V.REC}, m AS (SELECT cell, datakey, config, avg(response) AS r FROM rec GROUP BY ALL) SELECT cell, datakey, config, round(r, 6) AS r FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY m.r DESC, datakey, config) = 1",
    "i07_deviants": f"WITH {V.REC}, r AS (SELECT area, cell, avg(quantity) AS x, avg(response) AS y FROM rec GROUP BY ALL), f AS (SELECT area, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r GROUP BY area), e AS (SELECT area, cell, y - a - b * x AS e FROM r JOIN f USING (area)) SELECT area, cell, round(abs(e), 6) > round(1.5 * stddev_samp(e) OVER (PARTITION BY area), 6) AS deviant FROM e",
    "j04_sorted_cells": f"WITH {V.RESP}, m AS (SELECT cell, config, avg(response) AS r FROM resp GROUP BY ALL), b AS (SELECT cell, max(r) AS m FROM m GROUP BY cell) SELECT cell, row_number() OVER (ORDER BY m DESC, cell) AS place FROM b",
    "n01_frame_counts": f"WITH {V.STIM} SELECT config, CAST(floor(size / 10 * 44.65 + 0.5) AS BIGINT) AS n_on, CAST(floor(speed / 500 / 2 * 44.65 + 0.5) AS BIGINT) AS n_post, size / 10 + 1 + speed / 500 / 2 <= size / 10 + speed / 500 AS fits FROM stim",
    "n07_response_sets": f"WITH {V.REC}, s AS (SELECT cell, string_agg(datakey, '+' ORDER BY datakey) AS experiments FROM (SELECT DISTINCT cell, datakey FROM rec WHERE response > 98000) GROUP BY cell) SELECT experiments, count(*) AS n_cells FROM s GROUP BY experiments",
    "n10_wide_trials": f"WITH {V.RESP}, t AS (SELECT cell, config, response, row_number() OVER (PARTITION BY cell, config ORDER BY trial) AS rep FROM resp) SELECT cell, rep, " + ", ".join(f"round(max(response) FILTER (config = {k}), 6) AS config{k}" for k in range(10)) + " FROM t GROUP BY cell, rep",
}
