"""Further selections and derived measures, each a short composition."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.functions import circular
from perievent.operators.joins import keep, top
from perievent.operators.maps import corr_by_distance, masks
from perievent.operators.metrics import _rounded as _r
from perievent.plans import views as V
from perievent.plans.order import numbered
from perievent.sources.text import place


def by_partition(df: DataFrame, key: str) -> DataFrame:
    """df written to the shared folder with one directory for each value of key, and read back: a filter on key reads
    only its directories."""
    path = place(df.sparkSession, "parts")
    df.write.partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def a01(spark, sf):
    """Traces with their labels' and stimulus's columns, one trace type chosen."""
    s = V.stimuli(spark, sf).select(F.col("config").alias("cell"), "ori", "size")
    return _r(V.traces(spark, sf).join(s, "cell").groupBy("ori", "frame_ix").agg(F.avg("value").alias("value"), F.max("size").alias("size")))


def a07(spark, sf):
    """Trial metrics of all datasets in one table with a directory a dataset; one dataset read back."""
    m = V.recordings(spark, sf).groupBy("datakey", "cell", "config").agg(F.avg("response").alias("response"))
    return _r(by_partition(m, "datakey").filter("datakey = 'AF'").groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.avg("response").alias("response")))


def b03(spark, sf):
    return V.stimuli(spark, sf).filter(F.col("ori").isin(0.0, 180.0) & (F.col("size") == 10)).select("config", "ori")


def b07(spark, sf):
    m = V.traces(spark, sf).groupBy("cell", "trial").agg(F.avg(F.when(F.col("frame_ix").between(8, 13), F.col("value"))).alias("m"))
    return _r(m.filter("m < 20"))


def b18(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 100 * 80.0).alias("b"))
    return c.select("c_custkey", F.when(F.abs(F.col("a") - F.col("b")) <= 2500, F.col("a")).alias("kept"))


def b22(spark, sf):
    """Trials whose baseline is under a floor give no dF/F."""
    g = V.traces(spark, sf).groupBy("cell", "trial").agg(F.avg(F.when(F.col("frame_ix") < 8, F.col("value"))).alias("b"), F.avg(F.when(F.col("frame_ix") >= 8, F.col("value"))).alias("s"))
    return _r(g.select("cell", "trial", F.when(F.col("b") >= 25, (F.col("s") - F.col("b")) / F.col("b")).alias("dff")))


def b23(spark, sf):
    bad = V.recordings(spark, sf).groupBy("trial").agg(F.min("quantity").alias("q")).filter("q <= 1")
    return V.recordings(spark, sf).join(bad, "trial", "left_anti").groupBy("datakey").agg(F.count(F.lit(1)).alias("n"))


def b25(spark, sf):
    """Cells with a good fit that also lies inside its interval."""
    g = V.recordings(spark, sf).groupBy("datakey", "cell").agg(F.corr("quantity", "response").alias("fit"), F.percentile("response", F.lit(0.25)).alias("lo"), F.percentile("response", F.lit(0.75)).alias("hi"), F.avg("response").alias("m"))
    return g.filter("fit > 0.6 and m between lo and hi").select("datakey", "cell")


def c08(spark, sf):
    p = masks(spark, sf).groupBy("cell").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    f = V.recordings(spark, sf).groupBy("cell").agg(F.avg("response").alias("size"))
    return _r(f.join(p, "cell"))


def d04(spark, sf):
    """Metrics of trials from df traces: mean response, baseline deviation, their ratio."""
    w = W.partitionBy("cell", "trial")
    t = V.traces(spark, sf).withColumn("df", F.col("value") - F.avg(F.when(F.col("frame_ix") < 8, F.col("value"))).over(w))
    g = t.groupBy("cell", "trial").agg(F.avg(F.when(F.col("frame_ix").between(8, 13), F.col("df"))).alias("mean_stim"), F.stddev_pop(F.when(F.col("frame_ix") < 8, F.col("df"))).alias("std_base"))
    return _r(g.withColumn("zscore", F.col("mean_stim") / F.when(F.col("std_base") != 0, F.col("std_base"))))


def f08(spark, sf):
    """Cells' positions turned and scaled from pixels to micrometres."""
    m = masks(spark, sf).groupBy("cell").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return _r(m.select("cell", (1177.0 - F.col("x") * 2.312).alias("ml"), (972.0 - F.col("y") * 1.904).alias("ap"), circular.distance(F.col("x"), F.col("y"), F.lit(25.0), F.lit(25.0)).alias("from_centre")))


def f21(spark, sf):
    s = V.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"))
    return s.select("c_custkey", F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("number"), F.element_at(F.split("name", "#"), 1).alias("kind"), F.expr("try_cast(name as double) is not null").alias("is_number"))


def f26(spark, sf):
    """Model curves over directions: a double Gaussian and a von Mises."""
    s = V.stimuli(spark, sf).select("config", "size", F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))).alias("theta")).withColumn("theta", F.col("theta").cast("double"))
    g = circular.double_gaussian(F.col("theta"), F.col("size") * 7 % 360, F.lit(25.0), F.lit(3.0), F.lit(1.0), F.lit(0.2))
    return _r(s.select("config", "theta", g.alias("gauss"), circular.von_mises(F.col("theta"), F.col("size") * 7 % 360, F.lit(2.0), F.lit(1.5)).alias("mises")))


def f28(spark, sf):
    """Trials on a fixed plane's normal, whose parts are 1, 2 and -2 by turns over the cells."""
    w = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(-2.0)), (F.col("cell") % 3 + 1).cast("int"))
    return _r(V.responses(spark, sf).groupBy("trial").agg((F.sum(F.col("response") * w) / F.sqrt(F.sum(w * w))).alias("along")))


def f29(spark, sf):
    """Width at half height of each cell's mean response curve: configs above half of the peak around it."""
    m = V.recordings(spark, sf).groupBy("cell", "config").agg(F.avg("response").alias("r"))
    w = W.partitionBy("cell")
    m = m.withColumns({"half": (F.max("r").over(w) + F.min("r").over(w)) / 2, "peak": F.max_by("config", F.struct("r", -F.col("config"))).over(w)})
    low = F.coalesce(F.max(F.when((F.col("config") < F.col("peak")) & (F.col("r") < F.col("half")), F.col("config"))), F.lit(0))
    high = F.coalesce(F.min(F.when((F.col("config") > F.col("peak")) & (F.col("r") < F.col("half")), F.col("config"))), F.lit(8))
    return m.groupBy("cell").agg(F.first("peak").alias("peak"), (high - low).alias("width"))


def h29(spark, sf):
    m = V.responses(spark, sf).groupBy("cell", "config").agg(F.avg("response").alias("r"))
    t = F.radians(F.col("config") * 36.0)
    g = m.groupBy("cell").agg(F.sum(F.col("r") * F.cos(t)).alias("c"), F.sum(F.col("r") * F.sin(t)).alias("s"))
    return _r(g.select("cell", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("magnitude"), F.cos(F.atan2("s", "c")).alias("cos_theta")))


def h30(spark, sf):
    m = V.recordings(spark, sf).groupBy("cell", "config").agg(F.avg("response").alias("r"))
    n = F.count(F.lit(1))
    return _r(m.groupBy("cell").agg(((1 - F.pow(F.sum("r") / n, 2) / (F.sum(F.col("r") * F.col("r")) / n)) / (1 - 1 / n)).alias("sparseness"), n.alias("n")).filter("n > 1").drop("n"))


def h37(spark, sf):
    """Signal correlation of cell pairs, averaged over bins of their distance."""
    p = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") * 7 % 50).alias("x"), (F.col("s_suppkey") * 3 % 50).alias("y"))
    m = V.recordings(spark, sf).groupBy("datakey", "cell", "config").agg(F.avg("response").alias("response"))
    return _r(corr_by_distance(m, p, ("datakey",), "cell", "config", "response", 10))


def h38(spark, sf):
    return masks(spark, sf).groupBy("y", "x").agg(F.max("cell").alias("label"))


def j02(spark, sf):
    """Each cell's first dataset, and the one with most trials."""
    n = V.recordings(spark, sf).groupBy("cell", "datakey").agg(F.count(F.lit(1)).alias("n"))
    first = n.groupBy("cell").agg(F.min("datakey").alias("first"))
    return top(n, ("cell",), [F.desc("n"), F.col("datakey")]).select("cell", F.col("datakey").alias("most"), "n").join(first, "cell")


def k06(spark, sf):
    """Two runs put together, their configs and trials numbered through."""
    r = V.recordings(spark, sf)
    runs = r.filter("datakey = 'AF'").select("config", "trial").distinct().withColumn("run", F.lit(1).cast("long")).unionByName(r.filter("datakey = 'RF'").select("config", "trial").distinct().withColumn("run", F.lit(2).cast("long")))
    configs = numbered(runs.select("config").distinct(), [F.col("config")], "rank")
    runs = numbered(runs, [F.col(c) for c in ("run", "trial", "config")], "number").join(configs, "config")
    return runs.select("run", "trial", F.col("rank").alias("config"), "number")


def n16(spark, sf):
    l = V.table(spark, sf, "labels").filter("quality = 1")
    return keep(V.table(spark, sf, "documents").select("doc_id", "lang"), l, ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_MASK = "m AS (SELECT s_suppkey AS cell, s_suppkey * 3 % 50 + dy AS y, s_suppkey * 2 % 50 + dx AS x FROM supplier, range(5) a(dy), range(5) b(dx))"
_APART = "least(abs({d}), abs({d} - 360), abs({d} + 360))"
_DG1, _DG2 = _APART.format(d="((theta - p) % 360 + 360) % 360"), _APART.format(d="((theta + 180 - p) % 360 + 360) % 360")
QUERIES = {
    "a01_load_traces": a01, "a07_partitioned_metrics": a07, "b03_training_configs": b03, "b07_low_trials": b07, "b18_delay_filter": b18, "b22_baseline_floor": b22, "b23_trial_pass": b23, "b25_reliable_fits": b25, "c08_fits_positions": c08, "d04_df_metrics": d04, "f08_positions": f08, "f21_id_parts": f21,
    "f26_model_curves": f26, "f28_plane": f28, "f29_half_width": f29, "h29_vector_response": h29, "h30_sparseness": h30, "h37_correlation_distance": h37, "h38_label_image": h38, "j02_dataset_choice": j02, "k06_combined_runs": k06, "n16_training_rows": n16,
}
SQL = {
    "a01_load_traces": f"WITH {V.TRACE}, {V.STIM} SELECT round(ori, 6) AS ori, frame_ix, round(avg(value), 6) AS value, max(size) AS size FROM tr JOIN stim ON stim.config = tr.cell GROUP BY ori, frame_ix",
    "a07_partitioned_metrics": f"WITH {V.REC}, m AS (SELECT cell, config, avg(response) AS r FROM rec WHERE datakey = 'AF' GROUP BY ALL) SELECT config, count(*) AS n, round(avg(r), 6) AS response FROM m GROUP BY config",
    "b03_training_configs": f"WITH {V.STIM} SELECT config, ori FROM stim WHERE ori IN (0, 180) AND size = 10",
    "b07_low_trials": f"WITH {V.TRACE} SELECT cell, trial, round(avg(value) FILTER (frame_ix BETWEEN 8 AND 13), 6) AS m FROM tr GROUP BY cell, trial HAVING avg(value) FILTER (frame_ix BETWEEN 8 AND 13) < 20",
    "b18_delay_filter": "SELECT c_custkey, CASE WHEN abs(c_acctbal - c_custkey % 100 * 80) <= 2500 THEN c_acctbal END AS kept FROM customer",
    "b22_baseline_floor": f"WITH {V.TRACE}, g AS (SELECT cell, trial, avg(value) FILTER (frame_ix < 8) AS b, avg(value) FILTER (frame_ix >= 8) AS s FROM tr GROUP BY cell, trial) SELECT cell, trial, round(CASE WHEN b >= 25 THEN (s - b) / b END, 6) AS dff FROM g",
    "b23_trial_pass": f"WITH {V.REC} SELECT datakey, count(*) AS n FROM rec WHERE trial NOT IN (SELECT trial FROM rec GROUP BY trial HAVING min(quantity) <= 1) GROUP BY datakey",
    "b25_reliable_fits": f"WITH {V.REC} SELECT datakey, cell FROM rec GROUP BY datakey, cell HAVING corr(quantity, response) > 0.6 AND avg(response) BETWEEN quantile_cont(response, 0.25) AND quantile_cont(response, 0.75)",
    "c08_fits_positions": f"WITH {V.REC}, {_MASK}, p AS (SELECT cell, avg(x) AS x, avg(y) AS y FROM m GROUP BY cell) SELECT cell, round(avg(response), 6) AS size, round(any_value(x), 6) AS x, round(any_value(y), 6) AS y FROM rec JOIN p USING (cell) GROUP BY cell",
    "d04_df_metrics": f"WITH {V.TRACE}, t AS (SELECT *, value - avg(value) FILTER (frame_ix < 8) OVER (PARTITION BY cell, trial) AS df FROM tr), g AS (SELECT cell, trial, avg(df) FILTER (frame_ix BETWEEN 8 AND 13) AS m, stddev_pop(df) FILTER (frame_ix < 8) AS s FROM t GROUP BY cell, trial) SELECT cell, trial, round(m, 6) AS mean_stim, round(s, 6) AS std_base, round(m / nullif(s, 0), 6) AS zscore FROM g",
    "f08_positions": f"WITH {_MASK}, c AS (SELECT cell, avg(x) AS x, avg(y) AS y FROM m GROUP BY cell) SELECT cell, round(1177 - x * 2.312, 6) AS ml, round(972 - y * 1.904, 6) AS ap, round(sqrt((x - 25) ** 2 + (y - 25) ** 2), 6) AS from_centre FROM c",
    "f21_id_parts": "SELECT c_custkey, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS number, string_split(c_name, '#')[1] AS kind, try_cast(c_name AS DOUBLE) IS NOT NULL AS is_number FROM customer",
    "f26_model_curves": f"WITH {V.STIM}, s AS (SELECT config, CAST(size * 7 % 360 AS DOUBLE) AS p, CAST(theta AS DOUBLE) AS theta FROM stim, range(0, 360, 15) t(theta)) SELECT config, theta, round(0.2 + 3 * exp(-(({_DG1}) ** 2) / 1250) + exp(-(({_DG2}) ** 2) / 1250), 6) AS gauss, round(1.5 * exp(2 * (cos(radians(theta - p)) - 1)), 6) AS mises FROM s",
    "f28_plane": f"WITH {V.RESP} SELECT trial, round(sum(response * [1, 2, -2][cell % 3 + 1]) / sqrt(sum(CAST([1, 2, -2][cell % 3 + 1] AS DOUBLE) ** 2)), 6) AS along FROM resp GROUP BY trial",
    "f29_half_width": f"WITH {V.REC}, m AS (SELECT cell, config, avg(response) AS r FROM rec GROUP BY ALL), h AS (SELECT *, (max(r) OVER (PARTITION BY cell) + min(r) OVER (PARTITION BY cell)) / 2 AS half, first_value(config) OVER (PARTITION BY cell ORDER BY r DESC, config) AS peak FROM m) SELECT cell, any_value(peak) AS peak, coalesce(min(config) FILTER (config > peak AND r < half), 8) - coalesce(max(config) FILTER (config < peak AND r < half), 0) AS width FROM h GROUP BY cell",
    "h29_vector_response": f"WITH {V.RESP}, m AS (SELECT cell, config, avg(response) AS r FROM resp GROUP BY ALL), g AS (SELECT cell, sum(r * cos(radians(config * 36.0))) AS c, sum(r * sin(radians(config * 36.0))) AS s FROM m GROUP BY cell) SELECT cell, round(sqrt(c * c + s * s), 6) AS magnitude, round(cos(atan2(s, c)), 6) AS cos_theta FROM g",
    "h30_sparseness": f"WITH {V.REC}, m AS (SELECT cell, config, avg(response) AS r FROM rec GROUP BY ALL) SELECT cell, round((1 - (sum(r) / count(*)) ** 2 / (sum(r * r) / count(*))) / (1 - 1 / count(*)), 6) AS sparseness FROM m GROUP BY cell HAVING count(*) > 1",
    "h37_correlation_distance": f"WITH {V.REC}, m AS (SELECT datakey, cell, config, avg(response) AS v FROM rec GROUP BY ALL), r AS (SELECT a.datakey, a.cell AS a, b.cell AS b, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.datakey = b.datakey AND a.config = b.config AND a.cell < b.cell GROUP BY ALL), d AS (SELECT CAST(floor(sqrt((a * 7 % 50 - b * 7 % 50) ** 2 + (a * 3 % 50 - b * 3 % 50) ** 2) / 10) AS BIGINT) AS bin, r FROM r WHERE r IS NOT NULL AND NOT isnan(r)) SELECT bin, round(avg(r), 6) AS r, count(*) AS n FROM d GROUP BY bin",
    "h38_label_image": f"WITH {_MASK} SELECT y, x, max(cell) AS label FROM m GROUP BY y, x",
    "j02_dataset_choice": f"WITH {V.REC}, n AS (SELECT cell, datakey, count(*) AS n FROM rec GROUP BY ALL), f AS (SELECT cell, min(datakey) AS first FROM n GROUP BY cell) SELECT cell, datakey AS most, n, first FROM n JOIN f USING (cell) QUALIFY row_number() OVER (PARTITION BY cell ORDER BY n DESC, datakey) = 1",
    "k06_combined_runs": f"WITH {V.REC}, u AS (SELECT DISTINCT 1 AS run, config, trial FROM rec WHERE datakey = 'AF' UNION ALL SELECT DISTINCT 2, config, trial FROM rec WHERE datakey = 'RF') SELECT CAST(run AS BIGINT) AS run, trial, dense_rank() OVER (ORDER BY config) AS config, row_number() OVER (ORDER BY run, trial, config) AS number FROM u",
    "n16_training_rows": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang",
}
