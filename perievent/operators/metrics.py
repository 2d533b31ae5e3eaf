"""Trial metrics and the aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.plans import views as V
from perievent.plans.order import quantiles, running_counts

r6 = V.r6


#: Cells of the population in V.responses.
CELLS = 64


def epochs(on: int, n_on: int, post: int = 0) -> tuple[Column, Column]:
    """Whether a frame is in the baseline, in the stimulus window."""
    f = F.col("frame_ix")
    return f < on, (f >= on) & (f < on + n_on + post)


def trial_metrics(traces: DataFrame, on: int, n_on: int, post: int = 0, keys: tuple[str, ...] = ("cell", "trial", "config")) -> DataFrame:
    """One row a trial and cell: base_mean, base_std (of the population), stim_mean, zscore, dff, df, snr. Metrics with
    a zero or empty baseline are null."""
    base, stim = epochs(on, n_on, post)
    v = F.col("value")
    b, s, d = F.avg(F.when(base, v)), F.avg(F.when(stim, v)), F.stddev_pop(F.when(base, v))
    got = traces.groupBy(*keys).agg(b.alias("base_mean"), d.alias("base_std"), s.alias("stim_mean"))
    zero = lambda c: F.when(F.col(c) != 0, F.col(c))
    delta = F.col("stim_mean") - F.col("base_mean")
    return got.withColumns({"zscore": delta / zero("base_std"), "dff": delta / zero("base_mean"), "df": delta, "snr": F.col("stim_mean") / zero("base_mean")})


def trial_metrics_raw(traces: DataFrame, on: int, n_on: int) -> DataFrame:
    """The first form: the sample deviation, zscore = stimulus mean over it, without subtraction."""
    base, stim = epochs(on, n_on)
    v = F.col("value")
    got = traces.groupBy("cell", "trial", "config").agg(F.avg(F.when(base, v)).alias("base_mean"), F.stddev_samp(F.when(base, v)).alias("base_std"), F.avg(F.when(stim, v)).alias("stim_mean"))
    return got.withColumns({"zscore": F.col("stim_mean") / F.when(F.col("base_std") != 0, F.col("base_std")), "snr": F.col("stim_mean") / F.when(F.col("base_mean") != 0, F.col("base_mean"))})


def trial_metrics_pooled(traces: DataFrame, on: int, n_on: int) -> DataFrame:
    """The third form: a cell's baseline is the mean over its trials' baselines; the window is twice the stimulus."""
    base, stim = epochs(on, 2 * n_on)
    v, w = F.col("value"), W.partitionBy("cell")
    got = traces.groupBy("cell", "trial", "config").agg(F.avg(F.when(base, v)).alias("b"), F.avg(F.when(stim, v)).alias("stim_mean"))
    got = got.withColumns({"base_mean": F.avg("b").over(w), "base_std": F.stddev_pop("b").over(w)})
    return got.withColumn("zscore", (F.col("stim_mean") - F.col("base_mean")) / F.when(F.col("base_std") != 0, F.col("base_std"))).drop("b")


def epoch_means(traces: DataFrame, on: int, n_on: int) -> DataFrame:
    """stimulus, firsthalf, plushalf and baseline means of each trial."""
    f, v, half = F.col("frame_ix"), F.col("value"), n_on // 2
    part = lambda lo, hi: F.avg(F.when((f >= lo) & (f < hi), v))
    return traces.groupBy("cell", "trial", "config").agg(part(on, on + n_on).alias("stimulus"), part(on, on + half).alias("firsthalf"), part(on, on + n_on + half).alias("plushalf"), part(0, on).alias("baseline"))


def by_config(responses: DataFrame) -> DataFrame:
    """A cell's mean response to each config."""
    return responses.groupBy("datakey", "cell", "config").agg(F.avg("response").alias("response"), F.count(F.lit(1)).alias("n"))


def psth(traces: DataFrame) -> DataFrame:
    """Mean, SEM and repetitions of each frame of a cell's trials of a config."""
    n = F.countDistinct("trial")
    return traces.groupBy("cell", "config", "frame_ix").agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("sem"), n.alias("n_reps"))


def best_response(responses: DataFrame) -> DataFrame:
    """Each cell's largest mean over configs, and that config (the lowest on ties)."""
    w = W.partitionBy("datakey", "cell").orderBy(F.desc("response"), "config")
    return by_config(responses).withColumn("k", F.row_number().over(w)).filter("k = 1").select("datakey", "cell", "config", "response")


def summarize_iterations(iters: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """iters (keys, condition data or shuffled, score) -> mean score on data, the share of shuffled scores above it."""
    data = F.col("condition") == "data"
    w = W.partitionBy(*keys)
    m = iters.withColumn("mean_score", F.avg(F.when(data, F.col("score"))).over(w))
    return m.groupBy(*keys).agg(F.first("mean_score").alias("mean_score"), F.avg(F.when(~data, (F.col("score") > F.col("mean_score")).cast("double"))).alias("percentile"), F.sum(data.cast("long")).alias("n_iterations"))


def empirical_ci(df: DataFrame, keys: tuple[str, ...], value: str, ci: float = 0.95) -> DataFrame:
    return quantiles(df, keys, value, {"low": (1 - ci) / 2, "median": 0.5, "high": 1 - (1 - ci) / 2})


def selectivity(means: DataFrame, degrees: float) -> DataFrame:
    """Vector sums over configs at multiples of `degrees`: asi, dsi, preferred direction, circular variance, sparseness
    (zero if no response is positive). Responses are taken from the cell's least on."""
    r, t = F.col("response"), F.radians(F.col("config") * degrees)
    low = means.withColumn("response", r - F.min("response").over(W.partitionBy("datakey", "cell")))
    s = low.groupBy("datakey", "cell").agg(F.sum(r * F.cos(t)).alias("c1"), F.sum(r * F.sin(t)).alias("s1"), F.sum(r * F.cos(2 * t)).alias("c2"), F.sum(r * F.sin(2 * t)).alias("s2"), F.sum(r).alias("total"), F.sum(r * r).alias("squares"), F.count(F.lit(1)).alias("n"))
    size = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)) / F.when(F.col("total") != 0, F.col("total"))
    out = s.withColumns({"dsi": size("c1", "s1"), "asi": size("c2", "s2"), "theta": F.pmod(F.degrees(F.atan2("s1", "c1")), F.lit(360.0))})
    sparse = (1 - F.pow(F.col("total") / F.col("n"), 2) / (F.col("squares") / F.col("n"))) / (1 - 1 / F.col("n"))
    return out.withColumns({"circ_var": 1 - F.col("dsi"), "sparseness": F.when((F.col("squares") > 0) & (F.col("n") > 1), sparse).otherwise(0.0)}).select("datakey", "cell", "asi", "dsi", "theta", "circ_var", "sparseness")


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """Counts of (true, predicted) and each one's share of its true class."""
    got = df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("true")))


def mutual_information(df: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bits shared by two label columns, in each group of keys."""
    n = df.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))
    w = lambda *c: F.sum("n").over(W.partitionBy(*keys, *c) if keys or c else W.partitionBy(F.lit(0)))
    p = n.withColumns({"p": F.col("n") / w(), "px": w(x) / w(), "py": w(y) / w()})
    return p.groupBy(*keys).agg(F.sum(F.col("p") * F.log2(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def _traced(f):
    return lambda spark, sf: f(V.traces(spark, sf))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def d01(spark, sf):
    return _rounded(trial_metrics_raw(V.traces(spark, sf), V.STIM_ON, V.N_ON))


def d02(spark, sf):
    return _rounded(trial_metrics(V.traces(spark, sf), V.STIM_ON, V.N_ON, 2))


def d03(spark, sf):
    return _rounded(trial_metrics_pooled(V.traces(spark, sf), V.STIM_ON, V.N_ON))


def d05(spark, sf):
    return _rounded(epoch_means(V.traces(spark, sf), V.STIM_ON, V.N_ON))


def d06(spark, sf):
    return _rounded(by_config(V.responses(spark, sf)))


def d07(spark, sf):
    return _rounded(psth(V.traces(spark, sf)))


def d09(spark, sf):
    df = V.responses(spark, sf).groupBy("config", "cell").agg(F.avg("response").alias("r"))
    return _rounded(df.groupBy("config").pivot("cell", list(range(CELLS))).agg(F.first("r")).select("config", *[F.col(str(k)).alias(f"cell{k}") for k in range(CELLS)]))


def d10(spark, sf):
    return V.recordings(spark, sf).groupBy("area", "datakey").agg(F.countDistinct("cell").alias("n_cells"))


def d11(spark, sf):
    return _rounded(best_response(V.recordings(spark, sf)))


def d12(spark, sf):
    area = V.recordings(spark, sf).select("cell", "area").distinct()
    return _rounded(best_response(V.recordings(spark, sf)).join(area, "cell").groupBy("area").agg(F.avg("response").alias("mean"), F.stddev_samp("response").alias("sd")))


def d13(spark, sf):
    m = trial_metrics(V.traces(spark, sf), V.STIM_ON, V.N_ON).withColumn("s", F.col("stim_mean") / F.when(F.col("base_std") != 0, F.col("base_std")))
    return _rounded(m.groupBy("cell", "config").agg(F.avg("s").alias("snr")))


def _iters(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).alias("cell"), F.when(F.col("o_orderkey") % 2 == 0, "data").otherwise("shuffled").alias("condition"), (F.col("o_totalprice") / 1e6).alias("score"))


def d14(spark, sf):
    return _rounded(summarize_iterations(_iters(spark, sf), ("cell",)))


def d15(spark, sf):
    return _rounded(empirical_ci(V.recordings(spark, sf), ("datakey", "config"), "response"))


def d16(spark, sf):
    ci = empirical_ci(_iters(spark, sf).filter("condition = 'data'"), ("cell",), "score")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))).alias(c)
    return _rounded(ci.select("cell", clip("low"), clip("median"), clip("high")))


def d18(spark, sf):
    n = V.responses(spark, sf).groupBy("datakey", "config").agg(F.countDistinct("trial").alias("n_trials"))
    return n.withColumn("equal", F.min("n_trials").over(W.partitionBy("datakey")) == F.max("n_trials").over(W.partitionBy("datakey")))


def d19(spark, sf):
    """Cells and responsive cells of each dataset, area and in all."""
    c = V.recordings(spark, sf).groupBy("area", "datakey", "cell").agg(F.max("response").alias("m"))
    return _rounded(c.rollup("area", "datakey").agg(F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("m") > 90000).cast("long")).alias("n_responsive"), F.avg((F.col("m") > 90000).cast("double")).alias("fraction")))


def d23(spark, sf):
    return _rounded(V.grid(spark, sf).groupBy("frame", F.floor(F.col("y") / 4).alias("by"), F.floor(F.col("x") / 4).alias("bx")).agg(F.avg("value").alias("value")))


def d22(spark, sf):
    return _rounded(V.grid(spark, sf).groupBy("y", "x").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


def d24(spark, sf):
    return _rounded(V.grid(spark, sf).groupBy(F.floor(F.col("frame") / 2).alias("frame"), "y", "x").agg(F.avg("value").alias("value")))


def d25(spark, sf):
    r = F.sqrt(F.pow(F.col("x") - 32, 2) + F.pow(F.col("y") - 32, 2))
    g = V.grid(spark, sf).withColumn("ring", long_floor(r / 4))
    median = quantiles(g, ("ring",), "value", {"median": 0.5})
    return _rounded(g.groupBy("ring").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n"), F.max("value").alias("max"), F.min("value").alias("min")).join(median, "ring"))


def long_floor(c: Column) -> Column:
    return F.floor(c).cast("long")


def d27(spark, sf):
    """Mean of dataset means in each bin of quantity, with the SEM over datasets."""
    b = V.recordings(spark, sf).groupBy(F.floor(F.col("quantity") / 5).cast("long").alias("bin"), "datakey").agg(F.avg("response").alias("m"))
    return _rounded(b.groupBy("bin").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.count(F.lit(1)).alias("n")))


def d30(spark, sf):
    return _rounded(confusion(V.table(spark, sf, "labels"), "quality", "toxic").select(V.long("true").alias("true"), V.long("pred").alias("pred"), "n", "share"))


def d31(spark, sf):
    l = V.table(spark, sf, "labels").join(V.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    return _rounded(l.groupBy("lang", "source").agg(F.avg((F.col("quality") != F.col("toxic")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n")))


def d33(spark, sf):
    return _rounded(mutual_information(V.recordings(spark, sf).withColumn("q", F.floor(F.col("quantity") / 10)), "config", "q", ("datakey",)))


def d35(spark, sf):
    s = V.stimuli(spark, sf)
    return _rounded(s.cube("ori", "size").agg(F.avg("speed").alias("mean"), F.count(F.lit(1)).alias("n")))


def d36(spark, sf):
    r = running_counts(V.recordings(spark, sf), ("datakey",), "response")
    return _rounded(r.groupBy("datakey").agg((F.sum(F.when(F.col("upto") / F.col("total") >= 0.975, F.col("n")).otherwise(0)) / F.sum("n")).alias("above")))


def d37(spark, sf):
    """The modal of 49 direction bins of each cell's trials (the first of the fullest)."""
    b = F.floor(F.col("quantity") * 29 % 360 / (360 / 49)).cast("long")
    n = V.recordings(spark, sf).groupBy("cell", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("cell").orderBy(F.desc("n"), "bin")
    return _rounded(n.withColumn("k", F.row_number().over(w)).filter("k = 1").select("cell", (F.col("bin") * (360 / 49)).alias("mode")))


def d40(spark, sf):
    """Largest metric of each cell in two runs, side by side."""
    r = V.recordings(spark, sf)
    a = r.filter("datakey = 'AF'").groupBy("cell").agg(F.max("response").alias("run1"))
    b = r.filter("datakey = 'RF'").groupBy("cell").agg(F.max("response").alias("run2"))
    return a.join(b, "cell", "full").select("cell", "run1", "run2")


def d41(spark, sf):
    m = V.recordings(spark, sf).withColumn("high", F.col("quantity") > 25)
    return _rounded(m.groupBy("datakey", "config").agg(F.avg(F.when(F.col("high"), F.col("response"))).alias("high"), F.avg(F.when(~F.col("high"), F.col("response"))).alias("low")))


def h28(spark, sf):
    return _rounded(selectivity(by_config(V.responses(spark, sf)), 36.0))


def flagship(spark, sf):
    """Trial metrics, their means by config, and selectivity of the population."""
    return h28(spark, sf)


_B, _S = "frame_ix < 8", "frame_ix >= 8 AND frame_ix < {}"
_BEST = f"{V.REC}, m AS (SELECT datakey, cell, config, avg(response) AS response FROM rec GROUP BY ALL), best AS (SELECT datakey, cell, config, response FROM m QUALIFY row_number() OVER (PARTITION BY datakey, cell ORDER BY response DESC, config) = 1)"
_ITER = "it AS (SELECT o_custkey % 50 AS cell, CASE WHEN o_orderkey % 2 = 0 THEN 'data' ELSE 'shuffled' END AS condition, o_totalprice / 1e6 AS score FROM orders)"
QUERIES = {
    "d01_trial_metrics_raw": d01, "d02_trial_metrics": d02, "d03_trial_metrics_pooled": d03, "d05_epoch_means": d05, "d06_mean_by_config": d06, "d07_psth": d07, "d09_pivot_cells": d09, "d10_count_cells": d10, "d11_best_response": d11, "d12_area_distribution": d12, "d13_snr": d13,
    "d14_iteration_summary": d14, "d15_empirical_ci": d15, "d16_clipped_ci": d16, "d18_trials_per_config": d18, "d19_dataset_rollup": d19, "d22_projection": d22, "d23_block_mean": d23, "d24_downsample": d24, "d25_radial_stats": d25, "d27_binned_means": d27, "d30_confusion": d30, "d31_accuracy_grid": d31,
    "d33_mutual_information": d33, "d35_grouped_heatmap": d35, "d36_share_above": d36, "d37_circular_mode": d37, "d40_two_runs": d40, "d41_high_low": d41, "h28_selectivity": h28,
}
SQL = {
    "d01_trial_metrics_raw": f"WITH {V.TRACE}, g AS (SELECT cell, trial, config, avg(value) FILTER ({_B}) AS b, stddev_samp(value) FILTER ({_B}) AS d, avg(value) FILTER ({_S.format(14)}) AS s FROM tr GROUP BY ALL) SELECT cell, trial, config, round(b, 6) AS base_mean, round(d, 6) AS base_std, round(s, 6) AS stim_mean, round(s / nullif(d, 0), 6) AS zscore, round(s / nullif(b, 0), 6) AS snr FROM g",
    "d02_trial_metrics": f"WITH {V.TRACE}, g AS (SELECT cell, trial, config, avg(value) FILTER ({_B}) AS b, stddev_pop(value) FILTER ({_B}) AS d, avg(value) FILTER ({_S.format(16)}) AS s FROM tr GROUP BY ALL) SELECT cell, trial, config, round(b, 6) AS base_mean, round(d, 6) AS base_std, round(s, 6) AS stim_mean, round((s - b) / nullif(d, 0), 6) AS zscore, round((s - b) / nullif(b, 0), 6) AS dff, round(s - b, 6) AS df, round(s / nullif(b, 0), 6) AS snr FROM g",
    "d03_trial_metrics_pooled": f"WITH {V.TRACE}, g AS (SELECT cell, trial, config, avg(value) FILTER ({_B}) AS b, avg(value) FILTER ({_S.format(20)}) AS s FROM tr GROUP BY ALL), h AS (SELECT *, avg(b) OVER (PARTITION BY cell) AS m, stddev_pop(b) OVER (PARTITION BY cell) AS d FROM g) SELECT cell, trial, config, round(s, 6) AS stim_mean, round(m, 6) AS base_mean, round(d, 6) AS base_std, round((s - m) / nullif(d, 0), 6) AS zscore FROM h",
    "d05_epoch_means": f"WITH {V.TRACE} SELECT cell, trial, config, round(avg(value) FILTER ({_S.format(14)}), 6) AS stimulus, round(avg(value) FILTER ({_S.format(11)}), 6) AS firsthalf, round(avg(value) FILTER ({_S.format(17)}), 6) AS plushalf, round(avg(value) FILTER ({_B}), 6) AS baseline FROM tr GROUP BY cell, trial, config",
    "d06_mean_by_config": f"WITH {V.RESP} SELECT datakey, cell, config, round(avg(response), 6) AS response, count(*) AS n FROM resp GROUP BY ALL",
    "d07_psth": f"WITH {V.TRACE} SELECT cell, config, frame_ix, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem, count(DISTINCT trial) AS n_reps FROM tr GROUP BY cell, config, frame_ix",
    "d09_pivot_cells": f"WITH {V.RESP} SELECT config, " + ", ".join(f"round(avg(response) FILTER (cell = {k}), 6) AS cell{k}" for k in range(CELLS)) + " FROM resp GROUP BY config",
    "d10_count_cells": f"WITH {V.REC} SELECT area, datakey, count(DISTINCT cell) AS n_cells FROM rec GROUP BY ALL",
    "d11_best_response": f"WITH {_BEST} SELECT datakey, cell, config, round(response, 6) AS response FROM best",
    "d12_area_distribution": f"WITH {_BEST} SELECT area, round(avg(response), 6) AS mean, round(stddev_samp(response), 6) AS sd FROM best JOIN (SELECT DISTINCT cell, area FROM rec) USING (cell) GROUP BY area",
    "d13_snr": f"WITH {V.TRACE}, g AS (SELECT cell, trial, config, stddev_pop(value) FILTER ({_B}) AS d, avg(value) FILTER ({_S.format(14)}) AS s FROM tr GROUP BY ALL) SELECT cell, config, round(avg(s / nullif(d, 0)), 6) AS snr FROM g GROUP BY cell, config",
    "d14_iteration_summary": f"WITH {_ITER}, m AS (SELECT cell, avg(score) FILTER (condition = 'data') AS mean_score, count(*) FILTER (condition = 'data') AS n FROM it GROUP BY cell) SELECT cell, round(any_value(mean_score), 6) AS mean_score, round(avg(CAST(score > mean_score AS INT)) FILTER (condition <> 'data'), 6) AS percentile, CAST(any_value(n) AS BIGINT) AS n_iterations FROM it JOIN m USING (cell) GROUP BY cell",
    "d15_empirical_ci": f"WITH {V.REC} SELECT datakey, config, round(quantile_cont(response, 0.025), 6) AS low, round(quantile_cont(response, 0.5), 6) AS median, round(quantile_cont(response, 0.975), 6) AS high FROM rec GROUP BY ALL",
    "d16_clipped_ci": f"WITH {_ITER} SELECT cell, round(greatest(0, least(1, quantile_cont(score, 0.025))), 6) AS low, round(greatest(0, least(1, quantile_cont(score, 0.5))), 6) AS median, round(greatest(0, least(1, quantile_cont(score, 0.975))), 6) AS high FROM it WHERE condition = 'data' GROUP BY cell",
    "d18_trials_per_config": f"WITH {V.RESP}, n AS (SELECT datakey, config, count(DISTINCT trial) AS n_trials FROM resp GROUP BY ALL) SELECT *, min(n_trials) OVER (PARTITION BY datakey) = max(n_trials) OVER (PARTITION BY datakey) AS equal FROM n",
    "d19_dataset_rollup": f"WITH {V.REC}, c AS (SELECT area, datakey, cell, max(response) AS m FROM rec GROUP BY ALL) SELECT area, datakey, count(*) AS n_cells, CAST(count(*) FILTER (m > 90000) AS BIGINT) AS n_responsive, round(avg(CAST(m > 90000 AS INT)), 6) AS fraction FROM c GROUP BY ROLLUP (area, datakey)",
    "d22_projection": f"WITH {V.GRID} SELECT y, x, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM grid GROUP BY y, x",
    "d23_block_mean": f"WITH {V.GRID} SELECT frame, y // 4 AS by, x // 4 AS bx, round(avg(value), 6) AS value FROM grid GROUP BY ALL",
    "d24_downsample": f"WITH {V.GRID} SELECT frame // 2 AS frame, y, x, round(avg(value), 6) AS value FROM grid GROUP BY ALL",
    "d25_radial_stats": f"WITH {V.GRID}, g AS (SELECT CAST(floor(sqrt((x - 32) * (x - 32) + (y - 32) * (y - 32)) / 4) AS BIGINT) AS ring, value FROM grid) SELECT ring, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n, round(max(value), 6) AS max, round(min(value), 6) AS min FROM g GROUP BY ring",
    "d27_binned_means": f"WITH {V.REC}, b AS (SELECT CAST(floor(quantity / 5) AS BIGINT) AS bin, datakey, avg(response) AS m FROM rec GROUP BY ALL) SELECT bin, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, count(*) AS n FROM b GROUP BY bin",
    "d30_confusion": "WITH g AS (SELECT CAST(quality AS BIGINT) AS \"true\", CAST(toxic AS BIGINT) AS pred, count(*) AS n FROM labels GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY \"true\"), 6) AS share FROM g",
    "d31_accuracy_grid": "SELECT lang, source, round(avg(CAST(quality <> toxic AS INT)), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, source",
    "d33_mutual_information": f"WITH {V.REC}, n AS (SELECT datakey, config, floor(quantity / 10) AS q, count(*) AS n FROM rec GROUP BY ALL), p AS (SELECT datakey, n / sum(n) OVER (PARTITION BY datakey) AS p, sum(n) OVER (PARTITION BY datakey, config) / sum(n) OVER (PARTITION BY datakey) AS px, sum(n) OVER (PARTITION BY datakey, q) / sum(n) OVER (PARTITION BY datakey) AS py FROM n) SELECT datakey, round(sum(p * log2(p / (px * py))), 6) AS mi FROM p GROUP BY datakey",
    "d35_grouped_heatmap": f"WITH {V.STIM} SELECT round(ori, 6) AS ori, size, round(avg(speed), 6) AS mean, count(*) AS n FROM stim GROUP BY CUBE (ori, size)",
    "d36_share_above": f"WITH {V.REC}, r AS (SELECT datakey, cume_dist() OVER (PARTITION BY datakey ORDER BY response) AS r FROM rec) SELECT datakey, round(avg(CAST(r >= 0.975 AS INT)), 6) AS above FROM r GROUP BY datakey",
    "d37_circular_mode": f"WITH {V.REC}, n AS (SELECT cell, CAST(floor(quantity * 29 % 360 / (360.0 / 49)) AS BIGINT) AS bin, count(*) AS n FROM rec GROUP BY ALL) SELECT cell, round(bin * (360.0::DOUBLE / 49), 6) AS mode FROM n QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, bin) = 1",
    "d40_two_runs": f"WITH {V.REC} SELECT cell, a.m AS run1, b.m AS run2 FROM (SELECT cell, max(response) AS m FROM rec WHERE datakey = 'AF' GROUP BY cell) a FULL JOIN (SELECT cell, max(response) AS m FROM rec WHERE datakey = 'RF' GROUP BY cell) b USING (cell)",
    "d41_high_low": f"WITH {V.REC} SELECT datakey, config, round(avg(response) FILTER (quantity > 25), 6) AS high, round(avg(response) FILTER (quantity <= 25), 6) AS low FROM rec GROUP BY ALL",
    "h28_selectivity": f"WITH {V.RESP}, m AS (SELECT datakey, cell, config, avg(response) AS r0 FROM resp GROUP BY ALL), z AS (SELECT *, r0 - min(r0) OVER (PARTITION BY datakey, cell) AS r, radians(config * 36.0) AS t FROM m), s AS (SELECT datakey, cell, sum(r * cos(t)) AS c1, sum(r * sin(t)) AS s1, sum(r * cos(2 * t)) AS c2, sum(r * sin(2 * t)) AS s2, sum(r) AS total, sum(r * r) AS sq, count(*) AS n FROM z GROUP BY ALL) SELECT datakey, cell, round(sqrt(c2 * c2 + s2 * s2) / nullif(total, 0), 6) AS asi, round(sqrt(c1 * c1 + s1 * s1) / nullif(total, 0), 6) AS dsi, round(CASE WHEN degrees(atan2(s1, c1)) < 0 THEN degrees(atan2(s1, c1)) + 360 ELSE degrees(atan2(s1, c1)) END, 6) AS theta, round(1 - sqrt(c1 * c1 + s1 * s1) / nullif(total, 0), 6) AS circ_var, round(CASE WHEN sq > 0 AND n > 1 THEN (1 - (total / n) ** 2 / (sq / n)) / (1 - 1.0 / n) ELSE 0 END, 6) AS sparseness FROM s",
}
