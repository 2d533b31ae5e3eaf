"""Window functions and time-series transforms over frames of traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.plans import views as V


def baseline_normalized(traces: DataFrame, on: int) -> DataFrame:
    """Each frame as dff and as zscore of its trial's baseline frames (null where the baseline is zero)."""
    w = W.partitionBy("cell", "trial")
    b, d = F.avg(F.when(F.col("frame_ix") < on, F.col("value"))).over(w), F.stddev_pop(F.when(F.col("frame_ix") < on, F.col("value"))).over(w)
    delta = F.col("value") - b
    return traces.withColumns({"dff": delta / F.when(b != 0, b), "zscore": delta / F.when(d != 0, d)})


def rolling_quantile(traces: DataFrame, wing: int, q: float, mirrored: bool = True) -> DataFrame:
    """traces (cell, frame, value) with baseline, the quantile (linear interpolation) of the 2 * wing + 1 frames around
    each frame, edges mirrored, and detrended = value - baseline. One sort a cell; frames must be consecutive."""
    n = F.count(F.lit(1)).over(W.partitionBy("cell"))
    t = traces.select("cell", "frame", "value").withColumn("n", n)
    if mirrored:
        left = t.filter((F.col("frame") >= 1) & (F.col("frame") <= wing)).select("cell", (-F.col("frame")).alias("frame"), "value", "n")
        right = t.filter((F.col("frame") >= F.col("n") - 1 - wing) & (F.col("frame") < F.col("n") - 1)).select("cell", (2 * (F.col("n") - 1) - F.col("frame")).alias("frame"), "value", "n")
        t = t.unionByName(left).unionByName(right)
    w = W.partitionBy("cell").orderBy("frame").rowsBetween(-wing, wing)
    t = t.withColumn("baseline", F.percentile("value", F.lit(q)).over(w)).filter((F.col("frame") >= 0) & (F.col("frame") < F.col("n")))
    return t.select("cell", "frame", "value", "baseline", (F.col("value") - F.col("baseline")).alias("detrended"))


def rolling_mean(traces: DataFrame, width: int) -> DataFrame:
    """The moving average of an odd or even window as numpy's `same` convolution takes it, edges padded with the first
    and last value; detrended = value - mean."""
    lo, hi = width - 1 - (width - 1) // 2, (width - 1) // 2
    whole = W.partitionBy("cell").orderBy("frame").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n, first, last = F.count(F.lit(1)).over(whole), F.first("value").over(whole), F.last("value").over(whole)
    w = W.partitionBy("cell").orderBy("frame").rowsBetween(-lo, hi)
    t = traces.select("cell", "frame", "value", n.alias("n"), first.alias("first"), last.alias("last"), F.sum("value").over(w).alias("s"))
    before, after = F.greatest(F.lit(0), lo - F.col("frame")), F.greatest(F.lit(0), hi - (F.col("n") - 1 - F.col("frame")))
    mean = (F.col("s") + before * F.col("first") + after * F.col("last")) / width
    return t.select("cell", "frame", "value", mean.alias("mean"), (F.col("value") - mean).alias("detrended"))


def runs(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str) -> DataFrame:
    """Run-length islands: consecutive equal values of each key: run number, value, first and last of order, length."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long")
    r = df.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w))
    return r.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"), F.count(F.lit(1)).alias("length"))


def sessions(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], gap: Column) -> DataFrame:
    """df with `session`, counted up wherever gap holds between a row and the one before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("session", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(w))


def resample(trials: DataFrame, n_out: int) -> DataFrame:
    """Each trial of (cell, trial, frame_ix, value) at n_out points evenly spaced from its first to its last frame, by
    linear interpolation. n_out > 1."""
    g = trials.groupBy("cell", "trial").agg(F.sort_array(F.collect_list(F.struct("frame_ix", "value"))).alias("v"))
    g = g.select("cell", "trial", F.transform("v", lambda s: s.value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("i"))
    at = F.col("i") * (F.size("v") - 1) / F.lit(n_out - 1)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return g.select("cell", "trial", V.long("i").alias("frame_ix"), (F.get("v", lo) + (at - lo) * (F.get("v", hi) - F.get("v", lo))).alias("value"))


def nearest_in_time(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of lookup: for each row of left the value of right nearest in `at` among rows of equal `by` (earlier on ties),
    in one sort of the union, never a product of the two."""
    row = left.select(F.struct(*left.columns).alias("row"))
    mark = right.select(F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("mark"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.struct(*left.columns).alias("row"), none(mark, "mark"))
    both = both.unionByName(right.select(F.col(by).alias("_by"), F.col(at).alias("_at"), none(row, "row"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("mark")))
    w, back = W.partitionBy("_by").orderBy("_at", F.col("row").isNotNull()), W.partitionBy("_by").orderBy("_at", F.col("row").isNull())
    both = both.withColumns({"prev": F.last("mark", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "next": F.first("mark", True).over(back.rowsBetween(0, W.unboundedFollowing))})
    return both.filter("row is not null").select("row.*", "prev", "next")


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[V.r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def e01(spark, sf):
    return _r(baseline_normalized(V.traces(spark, sf), V.STIM_ON).select("cell", "frame", "dff", "zscore"))


def e02(spark, sf):
    return _r(rolling_quantile(V.traces(spark, sf, False), 5, 0.08))


def e03(spark, sf):
    """Corrected traces: the detrended value with the cell's mean and the mean of all baselines put back."""
    d = rolling_quantile(V.traces(spark, sf, False), 5, 0.08)
    whole = d.agg(F.avg("baseline").alias("all"))
    return _r(d.withColumn("m", F.avg("value").over(W.partitionBy("cell"))).crossJoin(F.broadcast(whole)).select("cell", "frame", (F.col("detrended") + F.col("m") + F.col("all")).alias("corrected")))


def e04(spark, sf):
    return _r(rolling_mean(V.traces(spark, sf, False), 6).select("cell", "frame", "mean", "detrended"))


def e05(spark, sf):
    return _r(rolling_mean(V.traces(spark, sf, False), 5).select("cell", "frame", "mean"))


def e07(spark, sf):
    return _r(resample(V.traces(spark, sf), 13))


def e08(spark, sf):
    w = W.partitionBy("cell")
    return _r(V.traces(spark, sf).select("cell", "frame", (F.col("value") / F.stddev_pop("value").over(w)).alias("scaled"), ((F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w)).alias("zscore")))


def e10(spark, sf):
    """Gaps of more than one and a half periods, filled with evenly spaced interpolated frames."""
    w = W.partitionBy("cell").orderBy("frame")
    t = V.traces(spark, sf, False).withColumn("t", V.micros("ts"))
    t = t.withColumns({"t2": F.lead("t").over(w), "v2": F.lead("value").over(w)})
    period = t.groupBy("cell").agg(F.percentile(F.col("t2") - F.col("t"), F.lit(0.5)).alias("period"))
    t = t.join(period, "cell").withColumn("n", F.when(F.col("t2") - F.col("t") > 1.5 * F.col("period"), F.floor((F.col("t2") - F.col("t")) / F.col("period") + 0.5) - 1).otherwise(0))
    t = t.filter("n > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return _r(t.select("cell", "frame", "i", (F.col("value") + (F.col("v2") - F.col("value")) * F.col("i") / (F.col("n") + 1)).alias("value")))


def e11(spark, sf):
    """Frames of one kind are flagged and interpolated from the nearest others, then a running median of 11."""
    t = V.traces(spark, sf, False).withColumn("bad", F.col("event_type") == "click")
    before, after = W.partitionBy("cell").orderBy("frame").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("cell").orderBy("frame").rowsBetween(0, W.unboundedFollowing)
    good = F.when(~F.col("bad"), F.struct("frame", "value"))
    t = t.withColumns({"p": F.last(good, True).over(before), "q": F.first(good, True).over(after)})
    fixed = F.when(~F.col("bad"), F.col("value")).when(F.col("p").isNull(), F.col("q.value")).when(F.col("q").isNull(), F.col("p.value")).otherwise(F.col("p.value") + (F.col("q.value") - F.col("p.value")) * (F.col("frame") - F.col("p.frame")) / (F.col("q.frame") - F.col("p.frame")))
    t = t.select("cell", "frame", fixed.alias("fixed"))
    return _r(t.withColumn("smooth", F.percentile("fixed", F.lit(0.5)).over(W.partitionBy("cell").orderBy("frame").rowsBetween(-5, 5))))


def e12(spark, sf):
    """Rising edges of a trigger, the first frame counted as one."""
    t = V.traces(spark, sf, False).withColumn("on", (F.col("value") > 50).cast("int"))
    p = F.lag("on").over(W.partitionBy("cell").orderBy("frame"))
    return t.withColumn("d", F.col("on") - p).filter(F.col("d").isNull() | (F.col("d") == 1)).select("cell", "frame")


def e13(spark, sf):
    """Files: a gap of over twice the median one starts a new one."""
    t = V.table(spark, sf, "events").select(F.col("user_id").alias("cell"), V.micros("ts").alias("t"), "event_id")
    w = W.partitionBy("cell").orderBy("t", "event_id")
    t = t.withColumn("gap", F.col("t") - F.lag("t").over(w))
    m = t.groupBy("cell").agg(F.percentile("gap", F.lit(0.5)).alias("m"))
    s = sessions(t.join(m, "cell"), ("cell",), ("t", "event_id"), F.col("gap") > 2 * F.col("m"))
    return s.groupBy("cell", "session").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count(F.lit(1)).alias("n"))


def e15(spark, sf):
    return runs(V.traces(spark, sf, False).select("cell", "frame", "event_type"), ("cell",), ("frame",), "event_type").filter("length > 1").select("cell", "run", "event_type", V.long("start").alias("start"), V.long("stop").alias("stop"), "length")


def e16(spark, sf):
    """Each onset of a state paired with the next change."""
    r = runs(V.traces(spark, sf, False).withColumn("on", (F.col("value") > 50).cast("long")), ("cell",), ("frame",), "on")
    r = r.withColumn("end", F.lead("start").over(W.partitionBy("cell").orderBy("run")))
    return r.filter("on = 1").select("cell", "start", "end")


def e17(spark, sf):
    """Each view paired with the user's next purchase, and how long it took."""
    t = V.table(spark, sf, "events").select("user_id", "event_id", "event_type", V.micros("ts").alias("t"))
    w = W.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(1, W.unboundedFollowing)
    t = t.withColumn("next", F.first(F.when(F.col("event_type") == "purchase", F.col("t")), True).over(w))
    return t.filter("event_type = 'view'").select("event_id", "next", (F.col("next") - F.col("t")).alias("took"))


def e20(spark, sf):
    """Trials aligned to onset on one grid, missing frames null."""
    t = V.traces(spark, sf).filter("frame_ix % 7 != 3").withColumn("k", F.col("frame_ix") - V.STIM_ON)
    full = t.select("cell", "trial").distinct().withColumn("k", F.explode(F.sequence(F.lit(-V.STIM_ON).cast("long"), F.lit(V.TRIAL_FRAMES - V.STIM_ON - 1).cast("long"))))
    return full.join(t.select("cell", "trial", "k", "value"), ["cell", "trial", "k"], "left")


def e21(spark, sf):
    return V.traces(spark, sf, False).select("cell", "frame", F.floor(F.col("frame") / 4).alias("volume"), (F.col("frame") % 4).alias("slice"))


def e22(spark, sf):
    return _r(V.traces(spark, sf).groupBy("cell", "trial", F.floor(F.col("frame_ix") / 5).alias("bin")).agg(F.avg("value").alias("value")))


def e24(spark, sf):
    return _r(V.responses(spark, sf).select("trial", "cell", (F.col("response") - F.min("response").over(W.partitionBy("cell"))).alias("response")))


def e25(spark, sf):
    return _r(V.responses(spark, sf).select("trial", "cell", (F.col("response") - F.avg("response").over(W.partitionBy("cell", "config"))).alias("residual")))


def e26(spark, sf):
    r = V.responses(spark, sf)
    stats = lambda by, m, s: r.groupBy(by).agg(F.avg("response").alias(m), F.stddev_pop("response").alias(s))
    j = r.join(stats("cell", "mc", "sc"), "cell").join(stats("datakey", "md", "sd"), "datakey")
    z = lambda m, s: (F.col("response") - F.col(m)) / F.col(s)
    return _r(j.select("trial", "cell", z("mc", "sc").alias("by_cell"), z("md", "sd").alias("overall")))


def e30(spark, sf):
    """Constant baselines, least and eighth percentile, and dF/F on the latter."""
    w = W.partitionBy("cell")
    b = F.percentile("value", F.lit(0.08)).over(w)
    return _r(V.traces(spark, sf).select("cell", "frame", F.min("value").over(w).alias("f_min"), b.alias("f0"), ((F.col("value") - b) / F.when(b != 0, b)).alias("dff")))


def e31(spark, sf):
    m = F.avg("value").over(W.partitionBy("cell"))
    return _r(V.traces(spark, sf).select("cell", "frame", ((F.col("value") - m) / m).alias("df")))


def e32(spark, sf):
    """Traces at other times, linear between the frames around."""
    left = V.traces(spark, sf, False).select("cell", (F.col("frame") + 0.25).alias("at"))
    right = V.traces(spark, sf, False).select("cell", F.col("frame").cast("double").alias("at"), "value")
    n = nearest_in_time(left, right, "cell", "at", "value")
    v = F.when(F.col("next").isNull(), F.col("prev.v")).otherwise(F.col("prev.v") + (F.col("next.v") - F.col("prev.v")) * (F.col("at") - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t")))
    return _r(n.select("cell", "at", v.alias("value")))


def e36(spark, sf):
    t = V.traces(spark, sf).withColumn("tsec", (F.col("frame_ix") - V.STIM_ON) / 10)
    return _r(t.groupBy("cell", "trial", F.floor(F.col("frame_ix") / 4).alias("chunk")).agg(F.sum("value").alias("value"), F.avg("tsec").alias("tsec"), F.min_by("frame_ix", F.struct(F.abs("tsec"), "frame_ix")).alias("nearest")))


def e37(spark, sf):
    t = V.traces(spark, sf, False).withColumn("blink", ((F.col("value") > 60) & (F.col("event_type") != "view")).cast("long"))
    return runs(t, ("cell",), ("frame",), "blink").filter("blink = 1").groupBy("cell").agg(F.count(F.lit(1)).alias("n_blinks"), F.max("length").alias("longest"))


def _mirror(wing: int) -> str:
    return f"mi AS (SELECT cell, frame, value, n_frames AS n FROM trall UNION ALL SELECT cell, -frame, value, n_frames FROM trall WHERE frame >= 1 AND frame <= {wing} UNION ALL SELECT cell, 2 * (n_frames - 1) - frame, value, n_frames FROM trall WHERE frame >= n_frames - 1 - {wing} AND frame < n_frames - 1), rq AS (SELECT cell, frame, value, n, quantile_cont(value, 0.08) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN {wing} PRECEDING AND {wing} FOLLOWING) AS b FROM mi), q AS (SELECT * FROM rq WHERE frame >= 0 AND frame < n)"


def _rolling(width: int) -> str:
    lo, hi = width - 1 - (width - 1) // 2, (width - 1) // 2
    return f"ro AS (SELECT cell, frame, value, (sum(value) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) + greatest(0, {lo} - frame) * first_value(value) OVER (PARTITION BY cell ORDER BY frame) + greatest(0, {hi} - (n_frames - 1 - frame)) * last_value(value) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {width} AS m FROM trall)"


_RUNS = "{src}, c AS (SELECT cell, frame, {v} AS v, CASE WHEN {v} IS DISTINCT FROM lag({v}) OVER (PARTITION BY cell ORDER BY frame) THEN 1 ELSE 0 END AS c FROM trall), rr AS (SELECT cell, frame, v, sum(c) OVER (PARTITION BY cell ORDER BY frame) AS run FROM c), runs AS (SELECT cell, CAST(run AS BIGINT) AS run, any_value(v) AS v, min(frame) AS start, max(frame) AS stop, count(*) AS length FROM rr GROUP BY cell, run)"


def _sql_runs(v: str) -> str:
    return _RUNS.format(src=V.TRACE, v=v)


QUERIES = {
    "e01_baseline_normalized": e01, "e02_rolling_quantile": e02, "e03_offset_restored": e03, "e04_rolling_mean": e04, "e05_smoothed": e05, "e07_resampled": e07, "e08_scaled": e08, "e10_gap_repair": e10, "e11_flag_repair": e11, "e12_rising_edges": e12, "e13_files_by_gap": e13, "e15_state_runs": e15,
    "e16_on_off_pairs": e16, "e17_next_event": e17, "e20_aligned_grid": e20, "e21_volumes": e21, "e22_epoch_bins": e22, "e24_min_offset": e24, "e25_residuals": e25, "e26_standardized": e26, "e30_constant_baselines": e30, "e31_mean_df": e31, "e32_interpolated": e32, "e36_chunks": e36, "e37_blinks": e37,
}
SQL = {
    "e01_baseline_normalized": f"WITH {V.TRACE}, b AS (SELECT *, avg(value) FILTER (frame_ix < 8) OVER (PARTITION BY cell, trial) AS b, stddev_pop(value) FILTER (frame_ix < 8) OVER (PARTITION BY cell, trial) AS d FROM tr) SELECT cell, frame, round((value - b) / nullif(b, 0), 6) AS dff, round((value - b) / nullif(d, 0), 6) AS zscore FROM b",
    "e02_rolling_quantile": f"WITH {V.TRACE}, {_mirror(5)} SELECT cell, frame, round(value, 6) AS value, round(b, 6) AS baseline, round(value - b, 6) AS detrended FROM q",
    "e03_offset_restored": f"WITH {V.TRACE}, {_mirror(5)} SELECT cell, frame, round(value - b + avg(value) OVER (PARTITION BY cell) + (SELECT avg(b) FROM q), 6) AS corrected FROM q",
    "e04_rolling_mean": f"WITH {V.TRACE}, {_rolling(6)} SELECT cell, frame, round(m, 6) AS mean, round(value - m, 6) AS detrended FROM ro",
    "e05_smoothed": f"WITH {V.TRACE}, {_rolling(5)} SELECT cell, frame, round(m, 6) AS mean FROM ro",
    "e07_resampled": f"WITH {V.TRACE}, p AS (SELECT DISTINCT cell, trial, i, i * 19 / 12.0 AS at FROM tr, range(13) r(i)) SELECT p.cell, p.trial, p.i AS frame_ix, round(a.value + (p.at - floor(p.at)) * (b.value - a.value), 6) AS value FROM p JOIN tr a ON a.cell = p.cell AND a.trial = p.trial AND a.frame_ix = floor(p.at) JOIN tr b ON b.cell = p.cell AND b.trial = p.trial AND b.frame_ix = ceil(p.at)",
    "e08_scaled": f"WITH {V.TRACE} SELECT cell, frame, round(value / stddev_pop(value) OVER w, 6) AS scaled, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS zscore FROM tr WINDOW w AS (PARTITION BY cell)",
    "e10_gap_repair": f"WITH {V.TRACE}, a AS (SELECT cell, frame, value, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS t2, lead(value) OVER w AS v2 FROM trall WINDOW w AS (PARTITION BY cell ORDER BY frame)), p AS (SELECT cell, quantile_cont(t2 - t, 0.5) AS period FROM a GROUP BY cell), g AS (SELECT a.*, CASE WHEN t2 - t > 1.5 * period THEN CAST(floor((t2 - t) / period + 0.5) AS BIGINT) - 1 ELSE 0 END AS n FROM a JOIN p USING (cell)), x AS (SELECT *, unnest(range(1, n + 1)) AS i FROM g WHERE n > 0) SELECT cell, frame, i, round(value + (v2 - value) * i / (n + 1), 6) AS value FROM x",
    "e11_flag_repair": f"WITH {V.TRACE}, g AS (SELECT cell, frame, value, event_type = 'click' AS bad FROM trall), a AS (SELECT *, max(CASE WHEN NOT bad THEN frame END) OVER (PARTITION BY cell ORDER BY frame) AS pf, min(CASE WHEN NOT bad THEN frame END) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qf FROM g), f AS (SELECT a.cell, a.frame, CASE WHEN NOT a.bad THEN a.value WHEN pf IS NULL THEN q.value WHEN qf IS NULL THEN p.value ELSE p.value + (q.value - p.value) * (a.frame - pf) / (qf - pf) END AS fixed FROM a LEFT JOIN g p ON p.cell = a.cell AND p.frame = pf LEFT JOIN g q ON q.cell = a.cell AND q.frame = qf) SELECT cell, frame, round(fixed, 6) AS fixed, round(quantile_cont(fixed, 0.5) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM f",
    "e12_rising_edges": f"WITH {V.TRACE}, a AS (SELECT cell, frame, CAST(value > 50 AS INT) - lag(CAST(value > 50 AS INT)) OVER (PARTITION BY cell ORDER BY frame) AS d FROM trall) SELECT cell, frame FROM a WHERE d IS NULL OR d = 1",
    "e13_files_by_gap": "WITH a AS (SELECT user_id AS cell, epoch_us(ts) AS t, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), m AS (SELECT cell, quantile_cont(gap, 0.5) AS m FROM a GROUP BY cell), s AS (SELECT cell, t, sum(CASE WHEN gap > 2 * m THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY t, event_id) AS session FROM a JOIN m USING (cell)) SELECT cell, CAST(session AS BIGINT) AS session, min(t) AS start, max(t) AS stop, count(*) AS n FROM s GROUP BY cell, session",
    "e15_state_runs": f"WITH {_sql_runs('event_type')} SELECT cell, run, v AS event_type, start, stop, length FROM runs WHERE length > 1",
    "e16_on_off_pairs": f"WITH {_sql_runs('CAST(value > 50 AS BIGINT)')}, e AS (SELECT *, lead(start) OVER (PARTITION BY cell ORDER BY run) AS \"end\" FROM runs) SELECT cell, start, \"end\" FROM e WHERE v = 1",
    "e17_next_event": "WITH a AS (SELECT event_id, event_type, epoch_us(ts) AS t, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM events) SELECT event_id, next, next - t AS took FROM a WHERE event_type = 'view'",
    "e20_aligned_grid": f"WITH {V.TRACE}, g AS (SELECT DISTINCT cell, trial, k FROM tr, range(-8, 12) r(k)) SELECT g.cell, g.trial, g.k, t.value FROM g LEFT JOIN (SELECT * FROM tr WHERE frame_ix % 7 <> 3) t ON t.cell = g.cell AND t.trial = g.trial AND t.frame_ix - 8 = g.k",
    "e21_volumes": f"WITH {V.TRACE} SELECT cell, frame, frame // 4 AS volume, frame % 4 AS slice FROM trall",
    "e22_epoch_bins": f"WITH {V.TRACE} SELECT cell, trial, frame_ix // 5 AS bin, round(avg(value), 6) AS value FROM tr GROUP BY ALL",
    "e24_min_offset": f"WITH {V.RESP} SELECT trial, cell, round(response - min(response) OVER (PARTITION BY cell), 6) AS response FROM resp",
    "e25_residuals": f"WITH {V.RESP} SELECT trial, cell, round(response - avg(response) OVER (PARTITION BY cell, config), 6) AS residual FROM resp",
    "e26_standardized": f"WITH {V.RESP} SELECT trial, cell, round((response - avg(response) OVER c) / stddev_pop(response) OVER c, 6) AS by_cell, round((response - avg(response) OVER d) / stddev_pop(response) OVER d, 6) AS overall FROM resp WINDOW c AS (PARTITION BY cell), d AS (PARTITION BY datakey)",
    "e30_constant_baselines": f"WITH {V.TRACE}, a AS (SELECT cell, frame, value, min(value) OVER (PARTITION BY cell) AS m, quantile_cont(value, 0.08) OVER (PARTITION BY cell) AS b FROM tr) SELECT cell, frame, round(m, 6) AS f_min, round(b, 6) AS f0, round((value - b) / nullif(b, 0), 6) AS dff FROM a",
    "e31_mean_df": f"WITH {V.TRACE} SELECT cell, frame, round((value - avg(value) OVER (PARTITION BY cell)) / avg(value) OVER (PARTITION BY cell), 6) AS df FROM tr",
    "e32_interpolated": f"WITH {V.TRACE} SELECT cell, frame + 0.25::DOUBLE AS at, round(value + coalesce(lead(value) OVER (PARTITION BY cell ORDER BY frame) - value, 0) * 0.25, 6) AS value FROM trall",
    "e36_chunks": f"WITH {V.TRACE} SELECT cell, trial, frame_ix // 4 AS chunk, round(sum(value), 6) AS value, round(avg((frame_ix - 8) / 10), 6) AS tsec, arg_min(frame_ix, abs(frame_ix - 8) * 100 + frame_ix) AS nearest FROM tr GROUP BY ALL",
    "e37_blinks": f"WITH {_sql_runs('CAST(value > 60 AND event_type <> {q}view{q} AS BIGINT)'.format(q=chr(39)))} SELECT cell, count(*) AS n_blinks, max(length) AS longest FROM runs WHERE v = 1 GROUP BY cell",
}
