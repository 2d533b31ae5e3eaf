"""Filters, joins, top-k and set operations over trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.operators.metrics import _rounded as _r
from perievent.operators.series import nearest_in_time
from perievent.plans import views as V
from perievent.plans.order import numbered, quantiles


def in_trials(frames: DataFrame, trials: DataFrame, by: str, pre: int, post: int) -> DataFrame:
    """Frames of each trial's window [onset - pre, onset + post), by an equi-join on the window's frames: trials (by,
    trial, onset), frames (by, frame, ...). Overlapping windows repeat a frame; frames that don't exist are left out."""
    grid = trials.select(by, "trial", "onset", F.explode(F.sequence(F.col("onset") - pre, F.col("onset") + post - 1)).alias("frame"))
    return frames.join(grid, [by, "frame"]).withColumn("k", F.col("frame") - F.col("onset"))


def keep(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_semi")


def common_cells(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys that both have."""
    return keep(a, b, on), keep(b, a, on)


def renumbered(configs: DataFrame, params: list[str]) -> DataFrame:
    """configs with new_config: equal parameters get one number, in the parameters' order (nulls first). Parameters are
    ranked over their distinct combinations."""
    distinct = configs.select(*[F.col(p).alias(f"_{p}") for p in params]).distinct()
    distinct = numbered(distinct, [F.col(f"_{p}") for p in params], "new_config")
    on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in params]
    return configs.join(distinct, on).select(*configs.columns, "new_config")


def top(df: DataFrame, by: tuple[str, ...], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def seeded_order(seed: int, *keys: str) -> Column:
    """A reproducible order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def equal_counts(df: DataFrame, by: tuple[str, ...], unit: str, seed: int = 0) -> DataFrame:
    """The same number of units (trials) in each group of the last key: the least, picked by seeded order."""
    units = df.select(*by, unit).distinct()
    k = F.row_number().over(W.partitionBy(*by).orderBy(seeded_order(seed, unit), unit))
    n = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).groupBy(*by[:-1]).agg(F.min("n").alias("least"))
    ranked = units.withColumn("k", k)
    picked = (ranked.join(n, list(by[:-1])) if len(by) > 1 else ranked.crossJoin(F.broadcast(n))).filter("k <= least")
    return keep(df, picked, [*by, unit])


def c01(spark, sf):
    labels = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("label"))
    frames = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_extendedprice").alias("value"))
    return _r(frames.join(labels, "key").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def _onsets(spark, sf):
    t = V.traces(spark, sf, False)
    return t.filter("event_type = 'signup'").select("cell", F.col("frame").alias("trial"), F.col("frame").alias("onset"))


def c02(spark, sf):
    return in_trials(V.traces(spark, sf, False).select("cell", "frame", "value"), _onsets(spark, sf), "cell", 2, 3).select("cell", "trial", "k", "value")


def c03(spark, sf):
    """Responses with their stimulus's size: the dimension joined in."""
    s = V.stimuli(spark, sf).select("config", "size", "ori")
    r = V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("config"), F.col("l_extendedprice").alias("response"))
    return _r(r.join(s, "config").groupBy("ori", "size").agg(F.avg("response").alias("response"), F.count(F.lit(1)).alias("n")))


def c04(spark, sf):
    cells = V.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("cell"))
    return _r(keep(V.recordings(spark, sf), cells, ["cell"]).groupBy("area", "datakey").agg(F.countDistinct("cell").alias("n_cells"), F.avg("response").alias("mean")))


def c05(spark, sf):
    r = V.recordings(spark, sf)
    a, b = common_cells(r.filter("datakey = 'AF' and response > 80000"), r.filter("datakey = 'RF' and response > 80000"), ["cell"])
    return a.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("a")).unionByName(b.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("b")))


def c09(spark, sf):
    r = V.recordings(spark, sf)
    some = r.filter("response > 90000").groupBy("area").agg(F.countDistinct("cell").alias("n_responsive"))
    return _r(some.join(r.groupBy("area").agg(F.countDistinct("cell").alias("n_cells")), "area").withColumn("fraction", F.col("n_responsive") / F.col("n_cells")))


def c10(spark, sf):
    return renumbered(V.stimuli(spark, sf).select("config", "ori", "size", "brand"), ["ori", "size", "brand"]).select("config", "new_config")


def c14(spark, sf):
    """Trials that have no frame of their window, and those that have."""
    trials = _onsets(spark, sf)
    seen = in_trials(V.traces(spark, sf, False).filter("value > 100").select("cell", "frame"), trials, "cell", 1, 2).select("cell", "trial").distinct()
    return trials.select("cell", "trial").join(seen, ["cell", "trial"], "left_anti")


def c15(spark, sf):
    """The nearest later-or-earlier error of the same user for each purchase."""
    e = V.table(spark, sf, "events").select("user_id", "event_id", "event_type", V.micros("ts").alias("t"))
    left = e.filter("event_type = 'purchase'").select("user_id", "t", "event_id")
    right = e.filter("event_type = 'error'").groupBy("user_id", "t").agg(F.min("event_id").alias("v"))
    n = nearest_in_time(left, right, "user_id", "t", "v")
    a, b = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    return n.select("event_id", F.when(F.col("next").isNull() | (a <= b), F.col("prev.v")).otherwise(F.col("next.v")).alias("nearest"))


def c16(spark, sf):
    """The nearest of a list of sizes to each quantity, the smaller on ties."""
    sizes = [1, 7, 16, 30, 44]
    near = F.array_min(F.transform(F.array(*[F.lit(float(s)) for s in sizes]), lambda y: F.struct(F.abs(y - F.col("quantity")).alias("d"), y.alias("s")))).s
    return V.recordings(spark, sf).groupBy(near.alias("size")).agg(F.count(F.lit(1)).alias("n"))


def c18(spark, sf):
    """Pairs of cells of a dataset whose best trials share a level."""
    r = top(V.recordings(spark, sf), ("datakey", "cell"), [F.desc("response"), F.col("trial")]).select("datakey", "cell", F.floor(F.col("response") / 500).alias("level"))
    a, b = r.select("datakey", "level", F.col("cell").alias("a")), r.select("datakey", "level", F.col("cell").alias("b"))
    return a.join(b, ["datakey", "level"]).filter("a < b").select("datakey", "level", "a", "b")


def c20(spark, sf):
    """The dataset that shares most cells with each other one (by name on ties)."""
    r = V.recordings(spark, sf).filter("response > 95000").select("datakey", "cell").distinct()
    n = r.select(F.col("datakey").alias("one"), "cell").join(r.select(F.col("datakey").alias("other"), "cell"), "cell").filter("one != other").groupBy("one", "other").agg(F.count(F.lit(1)).alias("shared"))
    return top(n, ("one",), [F.desc("shared"), F.col("other")])


def c21(spark, sf):
    """A movie's traces: sums of pixel times weight over each cell's mask."""
    mask = V.table(spark, sf, "part").select((F.col("p_partkey") % 20).alias("cell"), (F.col("p_partkey") % 64).alias("x"), (F.floor(F.col("p_partkey") / 8) % 64).alias("y"), (F.col("p_size") / 50).alias("weight")).groupBy("cell", "x", "y").agg(F.max("weight").alias("weight"))
    return _r(V.grid(spark, sf).join(mask, ["x", "y"]).groupBy("cell", "frame").agg(F.sum(F.col("value") * F.col("weight")).alias("trace"), F.avg("value").alias("mean")))


def c24(spark, sf):
    """Fields of runs combined: the first where all agree, whether they do, and the sum."""
    o = V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n"), F.min("o_orderpriority").alias("p"), F.sum("o_totalprice").alias("total"))
    return _r(o.select("o_custkey", F.when(F.col("n") == 1, F.col("p")).alias("priority"), (F.col("n") == 1).alias("agree"), "total"))


def c25(spark, sf):
    m = V.recordings(spark, sf).groupBy("cell", "datakey").agg(F.avg("response").alias("strength"))
    return _r(top(m, ("cell",), [F.desc("strength"), F.col("datakey")]))


def b02(spark, sf):
    s = V.stimuli(spark, sf)
    kind = F.when(F.col("size") > 40, "fullscreen").otherwise("image")
    return s.select("config", kind.alias("kind"), F.col("type").isin("ECONOMY", "STANDARD").alias("training"))


def b04(spark, sf):
    """Trials with a pass flag by their frames' range and count of flagged frames; metrics of failed trials are null."""
    t = V.traces(spark, sf).groupBy("cell", "trial").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum((F.col("event_type") == "error").cast("long")).alias("n_errors"), F.avg("value").alias("mean"))
    ok = (F.col("low") >= 0.5) & (F.col("high") < 250) & (F.col("n_errors") <= 5)
    return _r(t.select("cell", "trial", ok.alias("pass"), F.when(ok, F.col("mean")).alias("mean")))


def b06(spark, sf):
    """Trials whose times round to the asked span."""
    t = V.traces(spark, sf, False).withColumn("tsec", (F.col("frame_ix") - V.STIM_ON) / 4)
    good = t.groupBy("cell", "trial").agg(F.min("tsec").alias("a"), F.max("tsec").alias("b")).filter("floor(a + 0.5) = -2 and floor(b + 0.5) = 3")
    return keep(t, good, ["cell", "trial"]).groupBy("cell").agg(F.countDistinct("trial").alias("n_trials"))


def b08(spark, sf):
    excluded = V.table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("cell"))
    return V.recordings(spark, sf).join(excluded, "cell", "left_anti").groupBy("datakey").agg(F.countDistinct("cell").alias("n_cells"))


def b09(spark, sf):
    m = V.recordings(spark, sf).groupBy("cell", "config").agg(F.avg("response").alias("m")).groupBy("cell").agg(F.max("m").alias("hi"), F.avg("m").alias("mid"), F.min("m").alias("lo"))
    return m.select("cell", (F.col("hi") >= 42000).alias("by_max"), (F.col("mid") >= 38000).alias("by_mean"), (F.col("lo") >= 34000).alias("by_all"))


def b10(spark, sf):
    """Cells with any config in a band of the mean, and all their configs."""
    m = V.recordings(spark, sf).groupBy("datakey", "cell", "config").agg(F.avg("response").alias("m"))
    ok = m.filter("m between 60000 and 80000").select("datakey", "cell").distinct()
    return _r(keep(m, ok, ["datakey", "cell"]))


def b15(spark, sf):
    """Measured values inside their bootstrap intervals, by criterion."""
    r = V.recordings(spark, sf)
    ci = r.groupBy("cell").agg(F.percentile("response", F.lit(0.2)).alias("lo"), F.percentile("response", F.lit(0.8)).alias("hi"))
    fit = r.filter("datakey = 'AF'").groupBy("cell").agg(*[F.avg(F.when(F.col("config") == k, F.col("response"))).alias(f"p{k}") for k in (1, 2, 3)])
    inside = F.array(*[F.coalesce(F.col(f"p{k}").between(F.col("lo"), F.col("hi")), F.lit(False)) for k in (1, 2, 3)])
    return fit.join(ci, "cell").select("cell", F.forall(inside, lambda x: x).alias("all"), F.exists(inside, lambda x: x).alias("any"), (F.size(F.filter(inside, lambda x: x)) >= 2).alias("most"))


def b17(spark, sf):
    r = V.recordings(spark, sf).filter("response > 70000").select("area", "datakey", "cell").distinct()
    return r.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("area", "datakey"))).filter("n >= 15").select("area", "datakey", "cell")


def b19(spark, sf):
    """Frames of a trial with any value below the threshold give null."""
    w = W.partitionBy("cell", F.floor(F.col("frame") / 3))
    return V.traces(spark, sf, False).select("cell", "frame", F.when(F.min("value").over(w) >= 5, F.col("value")).alias("value"))


def b24(spark, sf):
    r = V.recordings(spark, sf).select("datakey", "cell", "config").distinct()
    return r.filter("config = 7").join(r.filter("config = 6").select("datakey", "cell"), ["datakey", "cell"], "left_semi").select("datakey", "cell")


def a04(spark, sf):
    """Serial samples written as tab-separated text, read with a schema, and cut to the lit ones."""
    from perievent.sources import text

    e = V.table(spark, sf, "events").select("event_id", "user_id", F.floor("value").cast("int").alias("pixel_clock"), (F.col("event_type") == "view").cast("int").alias("backlight_sensor"))
    back = text.round_trip(e, "\t")
    return back.filter("backlight_sensor = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pixel_clock").alias("clock"))


def a05(spark, sf):
    e = V.table(spark, sf, "events").select("event_type", F.from_json("props", "map<string,bigint>").alias("p"))
    return e.select("event_type", F.explode("p").alias("name", "x")).groupBy("event_type", "name").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


def a09(spark, sf):
    """Datasets whose alignment has one value, with it."""
    o = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n"), F.first("l_returnflag").alias("flag"))
    return o.filter("n = 1").select("l_orderkey", "flag")


def a12(spark, sf):
    return V.recordings(spark, sf).groupBy("area", "datakey").agg(F.countDistinct("cell").alias("n_cells"), F.countDistinct("trial").alias("n_trials"))


def a13(spark, sf):
    """The identity of a parameter set: six digits of the hash of its contents."""
    s = V.stimuli(spark, sf)
    text = F.concat_ws("|", F.col("brand"), F.col("size").cast("string"), F.col("type"))
    return s.select("config", F.substring(F.sha1(text), 1, 6).alias("hash"))


def a14(spark, sf):
    """Parameter sets asked for that don't exist get the next numbers."""
    s = V.stimuli(spark, sf)
    h = F.md5(F.concat_ws("|", "brand", F.col("size").cast("string")))
    known = s.filter("config % 3 = 0").select(h.alias("h")).distinct()
    asked = s.filter("config % 3 != 0").select(h.alias("h")).distinct()
    n = known.agg(F.count(F.lit(1)).alias("n"))
    fresh = asked.join(known, "h", "left_anti")
    return numbered(fresh, [F.col("h")], "k").crossJoin(F.broadcast(n)).select("h", (F.col("n") + F.col("k")).alias("id"))


def a15(spark, sf):
    """A sparse matrix as (row, col, value)."""
    return V.responses(spark, sf).filter("abs(response) > 0.3").select(F.col("trial").alias("row"), F.col("cell").alias("col"), V.r6("response").alias("value"))


def j01(spark, sf):
    n = V.recordings(spark, sf).groupBy("area", "datakey").agg(F.countDistinct("cell").alias("n"))
    return top(n, ("area",), [F.desc("n"), F.col("datakey")])


def j03(spark, sf):
    m = V.recordings(spark, sf).groupBy("area", "cell").agg(F.avg("response").alias("m"))
    return _r(top(m, ("area",), [F.desc("m"), F.col("cell")], 5))


def j05(spark, sf):
    n = F.regexp_extract("s_name", "([0-9]+)$", 1).cast("long")
    return numbered(V.table(spark, sf, "supplier").select("s_name", n.alias("number")), [F.col("number"), F.col("s_name")], "place")


def j06(spark, sf):
    """Distinct configurations in the order in which they were first seen."""
    r = V.recordings(spark, sf).groupBy("datakey", "config").agg(F.min("trial").alias("first"))
    return r.select("datakey", "config", V.long(F.row_number().over(W.partitionBy("datakey").orderBy("first", "config"))).alias("place"))


def k01(spark, sf):
    a = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("run"), F.col("c_mktsegment").alias("segment"))
    b = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("run"))
    return a.unionByName(b, allowMissingColumns=True)


def _keys(spark, sf):
    r = V.recordings(spark, sf)
    return r.filter("datakey = 'AF' and response > 85000").select("cell", "config"), r.filter("datakey = 'RF' and response > 85000").select("cell", "config")


def k02(spark, sf):
    a, b = _keys(spark, sf)
    return a.intersect(b)


def k03(spark, sf):
    a, b = _keys(spark, sf)
    return a.union(b).distinct()


def k04(spark, sf):
    a, b = _keys(spark, sf)
    return a.subtract(b)


def k05(spark, sf):
    return V.recordings(spark, sf).select("datakey", "area", "config").dropDuplicates()


def i18(spark, sf):
    """Equal trials of each config of the population, picked by a seeded order."""
    return equal_counts(V.responses(spark, sf), ("datakey", "config"), "trial", 7).select("config", "trial").distinct()


def i17(spark, sf):
    """Trials of low and high quantity within each dataset's config (outer thirds), in equal numbers."""
    r = V.recordings(spark, sf).select("datakey", "config", "trial", "cell", "quantity")
    by = ["datakey", "config"]
    s = r.join(quantiles(r, tuple(by), "quantity", {"lo": 0.33, "hi": 0.67}), by).withColumn("side", F.when(F.col("quantity") <= F.col("lo"), "low").when(F.col("quantity") >= F.col("hi"), "high")).filter("side is not null")
    k = s.withColumn("k", F.row_number().over(W.partitionBy(*by, "side").orderBy(seeded_order(3, "trial", "cell"), "trial", "cell", "quantity")))
    n = s.groupBy(*by, "side").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.min("n").alias("least"))
    return k.join(n, by).filter("k <= least").select(*by, "side", "trial", "cell")


def i20(spark, sf):
    """Stratified folds: trials dealt in turn within their config, in seeded order."""
    t = V.responses(spark, sf).select("config", "trial").distinct()
    k = F.row_number().over(W.partitionBy("config").orderBy(seeded_order(5, "trial"), "trial"))
    return t.select("trial", "config", V.long((k - 1) % 5).alias("fold"))


_ON = "onset AS (SELECT cell, frame AS trial FROM trall WHERE event_type = 'signup')"
QUERIES = {
    "a04_serial_text": a04, "a05_json_map": a05, "a09_single_valued": a09, "a12_catalogue": a12, "a13_content_hash": a13, "a14_parameter_ids": a14, "a15_sparse": a15, "b02_stimulus_kinds": b02, "b04_pass_flags": b04, "b06_bad_trials": b06, "b08_excluded": b08, "b09_thresholds": b09, "b10_band_cells": b10,
    "b15_inside_ci": b15, "b17_min_cells": b17, "b19_likelihood": b19, "b24_also_ran": b24, "c01_frames_labels": c01, "c02_range_join": c02, "c03_dimension": c03, "c04_semi": c04, "c05_common_cells": c05, "c09_fractions": c09, "c10_renumbered": c10, "c14_missing_trials": c14, "c15_nearest_time": c15, "c16_nearest_value": c16,
    "c18_pairs": c18, "c20_most_overlap": c20, "c21_mask_traces": c21, "c24_combined": c24, "c25_strongest": c25, "i17_split_tertiles": i17, "i18_equal_counts": i18, "i20_folds": i20, "j01_best_dataset": j01, "j03_top_cells": j03, "j05_natural_order": j05, "j06_first_seen": j06, "k01_union_all": k01, "k02_intersect": k02, "k03_union": k03, "k04_except": k04, "k05_distinct": k05,
}
_A, _Z = "SELECT cell, config FROM rec WHERE datakey = 'AF' AND response > 85000", "SELECT cell, config FROM rec WHERE datakey = 'RF' AND response > 85000"
SQL = {
    "a04_serial_text": "SELECT user_id, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS clock FROM events WHERE event_type = 'view' GROUP BY user_id",
    "a05_json_map": "SELECT event_type, k AS name, CAST(sum(CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM (SELECT event_type, props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL",
    "a09_single_valued": "SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1",
    "a12_catalogue": f"WITH {V.REC} SELECT area, datakey, count(DISTINCT cell) AS n_cells, count(DISTINCT trial) AS n_trials FROM rec GROUP BY ALL",
    "a13_content_hash": f"WITH {V.STIM} SELECT config, substr(sha1(brand || '|' || size || '|' || type), 1, 6) AS hash FROM stim",
    "a14_parameter_ids": f"WITH {V.STIM}, h AS (SELECT config, md5(brand || '|' || size) AS h FROM stim), k AS (SELECT DISTINCT h FROM h WHERE config % 3 = 0) SELECT h, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY h) AS id FROM (SELECT DISTINCT h FROM h WHERE config % 3 <> 0 AND h NOT IN (SELECT h FROM k))",
    "a15_sparse": f"WITH {V.RESP} SELECT trial AS row, cell AS col, round(response, 6) AS value FROM resp WHERE abs(response) > 0.3",
    "b02_stimulus_kinds": f"WITH {V.STIM} SELECT config, CASE WHEN size > 40 THEN 'fullscreen' ELSE 'image' END AS kind, type IN ('ECONOMY', 'STANDARD') AS training FROM stim",
    "b04_pass_flags": f"WITH {V.TRACE}, g AS (SELECT cell, trial, min(value) >= 0.5 AND max(value) < 250 AND count(*) FILTER (event_type = 'error') <= 5 AS pass, avg(value) AS m FROM tr GROUP BY cell, trial) SELECT cell, trial, pass, round(CASE WHEN pass THEN m END, 6) AS mean FROM g",
    "b06_bad_trials": f"WITH {V.TRACE}, g AS (SELECT cell, trial FROM tr0 GROUP BY cell, trial HAVING floor(min((frame_ix - 8) / 4) + 0.5) = -2 AND floor(max((frame_ix - 8) / 4) + 0.5) = 3) SELECT cell, count(*) AS n_trials FROM g GROUP BY cell",
    "b08_excluded": f"WITH {V.REC} SELECT datakey, count(DISTINCT cell) AS n_cells FROM rec WHERE cell NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY datakey",
    "b09_thresholds": f"WITH {V.REC}, m AS (SELECT cell, config, avg(response) AS m FROM rec GROUP BY ALL) SELECT cell, max(m) >= 42000 AS by_max, avg(m) >= 38000 AS by_mean, min(m) >= 34000 AS by_all FROM m GROUP BY cell",
    "b10_band_cells": f"WITH {V.REC}, m AS (SELECT datakey, cell, config, avg(response) AS m FROM rec GROUP BY ALL) SELECT datakey, cell, config, round(m, 6) AS m FROM m WHERE (datakey, cell) IN (SELECT (datakey, cell) FROM m WHERE m BETWEEN 60000 AND 80000)",
    "b15_inside_ci": f"WITH {V.REC}, ci AS (SELECT cell, quantile_cont(response, 0.2) AS lo, quantile_cont(response, 0.8) AS hi FROM rec GROUP BY cell), f AS (SELECT cell, avg(response) FILTER (config = 1) AS p1, avg(response) FILTER (config = 2) AS p2, avg(response) FILTER (config = 3) AS p3 FROM rec WHERE datakey = 'AF' GROUP BY cell), i AS (SELECT cell, coalesce(p1 BETWEEN lo AND hi, false) AS a, coalesce(p2 BETWEEN lo AND hi, false) AS b, coalesce(p3 BETWEEN lo AND hi, false) AS c FROM f JOIN ci USING (cell)) SELECT cell, a AND b AND c AS \"all\", a OR b OR c AS \"any\", CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) >= 2 AS most FROM i",
    "b17_min_cells": f"WITH {V.REC}, r AS (SELECT DISTINCT area, datakey, cell FROM rec WHERE response > 70000) SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY area, datakey) >= 15",
    "b19_likelihood": f"WITH {V.TRACE} SELECT cell, frame, CASE WHEN min(value) OVER (PARTITION BY cell, frame // 3) >= 5 THEN value END AS value FROM trall",
    "b24_also_ran": f"WITH {V.REC} SELECT DISTINCT datakey, cell FROM rec WHERE config = 7 AND (datakey, cell) IN (SELECT (datakey, cell) FROM rec WHERE config = 6)",
    "c01_frames_labels": "SELECT o_orderpriority AS label, count(*) AS n, round(sum(l_extendedprice), 6) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "c02_range_join": f"WITH {V.TRACE}, {_ON} SELECT o.cell, o.trial, t.frame - o.trial AS k, t.value FROM onset o JOIN trall t ON t.cell = o.cell AND t.frame >= o.trial - 2 AND t.frame < o.trial + 3",
    "c03_dimension": f"WITH {V.STIM} SELECT round(ori, 6) AS ori, size, round(avg(l_extendedprice), 6) AS response, count(*) AS n FROM lineitem JOIN stim ON l_partkey = config GROUP BY ori, size",
    "c04_semi": f"WITH {V.REC} SELECT area, datakey, count(DISTINCT cell) AS n_cells, round(avg(response), 6) AS mean FROM rec WHERE cell IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY area, datakey",
    "c05_common_cells": f"WITH {V.REC}, a AS (SELECT cell FROM rec WHERE datakey = 'AF' AND response > 80000), b AS (SELECT cell FROM rec WHERE datakey = 'RF' AND response > 80000) SELECT cell, count(*) AS n, 'a' AS side FROM a WHERE cell IN (SELECT cell FROM b) GROUP BY cell UNION ALL SELECT cell, count(*), 'b' FROM b WHERE cell IN (SELECT cell FROM a) GROUP BY cell",
    "c09_fractions": f"WITH {V.REC}, g AS (SELECT area, count(DISTINCT cell) FILTER (response > 90000) AS n_responsive, count(DISTINCT cell) AS n_cells FROM rec GROUP BY area) SELECT *, round(n_responsive / n_cells, 6) AS fraction FROM g WHERE n_responsive > 0",
    "c10_renumbered": f"WITH {V.STIM} SELECT config, dense_rank() OVER (ORDER BY ori, size, brand) AS new_config FROM stim",
    "c14_missing_trials": f"WITH {V.TRACE}, {_ON} SELECT cell, trial FROM onset o WHERE NOT EXISTS (SELECT 1 FROM trall t WHERE t.cell = o.cell AND t.value > 100 AND t.frame >= o.trial - 1 AND t.frame < o.trial + 2)",
    "c15_nearest_time": "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS t FROM events), r AS (SELECT user_id, t, min(event_id) AS v FROM e WHERE event_type = 'error' GROUP BY ALL) SELECT l.event_id, arg_min(r.v, abs(r.t - l.t) * 2 + CAST(r.t > l.t AS BIGINT)) AS nearest FROM e l LEFT JOIN r USING (user_id) WHERE l.event_type = 'purchase' GROUP BY l.event_id",
    "c16_nearest_value": f"WITH {V.REC}, s AS (SELECT quantity, (SELECT s FROM (VALUES (1.0), (7.0), (16.0), (30.0), (44.0)) v(s) ORDER BY abs(s - quantity), s LIMIT 1) AS s FROM (SELECT DISTINCT quantity FROM rec)) SELECT CAST(s AS DOUBLE) AS size, count(*) AS n FROM rec JOIN s USING (quantity) GROUP BY 1",
    "c18_pairs": f"WITH {V.REC}, r AS (SELECT datakey, cell, CAST(floor(response / 500) AS BIGINT) AS level FROM rec QUALIFY row_number() OVER (PARTITION BY datakey, cell ORDER BY response DESC, trial) = 1) SELECT x.datakey, x.level, x.cell AS a, y.cell AS b FROM r x JOIN r y ON x.datakey = y.datakey AND x.level = y.level AND x.cell < y.cell",
    "c20_most_overlap": f"WITH {V.REC}, r AS (SELECT DISTINCT datakey, cell FROM rec WHERE response > 95000), n AS (SELECT x.datakey AS one, y.datakey AS other, count(*) AS shared FROM r x JOIN r y ON x.cell = y.cell AND x.datakey <> y.datakey GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY one ORDER BY shared DESC, other) = 1",
    "c21_mask_traces": f"WITH {V.GRID}, m AS (SELECT p_partkey % 20 AS cell, p_partkey % 64 AS x, (p_partkey // 8) % 64 AS y, max(p_size / 50) AS weight FROM part GROUP BY 1, 2, 3) SELECT cell, frame, round(sum(value * weight), 6) AS trace, round(avg(value), 6) AS mean FROM grid JOIN m USING (x, y) GROUP BY ALL",
    "c24_combined": "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS priority, count(DISTINCT o_orderpriority) = 1 AS agree, round(sum(o_totalprice), 6) AS total FROM orders GROUP BY o_custkey",
    "c25_strongest": f"WITH {V.REC}, m AS (SELECT cell, datakey, avg(response) AS s FROM rec GROUP BY ALL) SELECT cell, datakey, round(s, 6) AS strength FROM m QUALIFY row_number() OVER (PARTITION BY cell ORDER BY s DESC, datakey) = 1",
    "i17_split_tertiles": f"WITH {V.REC}, r AS (SELECT datakey, config, trial, cell, quantity FROM rec), q AS (SELECT datakey, config, quantile_cont(quantity, 0.33) AS lo, quantile_cont(quantity, 0.67) AS hi FROM r GROUP BY ALL), s AS (SELECT r.*, CASE WHEN quantity <= lo THEN 'low' WHEN quantity >= hi THEN 'high' END AS side FROM r JOIN q USING (datakey, config)), k AS (SELECT *, row_number() OVER (PARTITION BY datakey, config, side ORDER BY md5('3|' || trial || '|' || cell), trial, cell, quantity) AS k FROM s WHERE side IS NOT NULL), n AS (SELECT datakey, config, min(n) AS least FROM (SELECT datakey, config, side, count(*) AS n FROM k GROUP BY ALL) GROUP BY ALL) SELECT datakey, config, side, trial, cell FROM k JOIN n USING (datakey, config) WHERE k <= least",
    "i18_equal_counts": f"WITH {V.RESP}, k AS (SELECT config, trial, row_number() OVER (PARTITION BY config ORDER BY md5('7|' || trial), trial) AS k FROM (SELECT DISTINCT config, trial FROM resp)) SELECT config, trial FROM k WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY config))",
    "i20_folds": f"WITH {V.RESP} SELECT trial, config, (row_number() OVER (PARTITION BY config ORDER BY md5('5|' || trial), trial) - 1) % 5 AS fold FROM (SELECT DISTINCT config, trial FROM resp)",
    "j01_best_dataset": f"WITH {V.REC}, n AS (SELECT area, datakey, count(DISTINCT cell) AS n FROM rec GROUP BY ALL) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY area ORDER BY n DESC, datakey) = 1",
    "j03_top_cells": f"WITH {V.REC}, m AS (SELECT area, cell, avg(response) AS m FROM rec GROUP BY ALL) SELECT area, cell, round(m, 6) AS m FROM m QUALIFY row_number() OVER (PARTITION BY area ORDER BY m DESC, cell) <= 5",
    "j05_natural_order": "WITH n AS (SELECT s_name, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM supplier) SELECT *, row_number() OVER (ORDER BY number, s_name) AS place FROM n",
    "j06_first_seen": f"WITH {V.REC}, m AS (SELECT datakey, config, min(trial) AS f FROM rec GROUP BY ALL) SELECT datakey, config, row_number() OVER (PARTITION BY datakey ORDER BY f, config) AS place FROM m",
    "k01_union_all": "SELECT c_custkey AS id, 'customer' AS run, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, 'supplier', NULL FROM supplier",
    "k02_intersect": f"WITH {V.REC} {_A} INTERSECT {_Z}",
    "k03_union": f"WITH {V.REC} {_A} UNION {_Z}",
    "k04_except": f"WITH {V.REC} {_A} EXCEPT {_Z}",
    "k05_distinct": f"WITH {V.REC} SELECT DISTINCT datakey, area, config FROM rec",
}
