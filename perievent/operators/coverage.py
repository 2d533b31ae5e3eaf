"""Fields against stimuli, resampled fields and their reliability, and a classifier's score frame by frame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perievent.functions import numerics as N
from perievent.functions import tails
from perievent.operators.drivers import hashed, inside_intervals
from perievent.operators.maps import masks
from perievent.operators.metrics import _rounded as _r
from perievent.operators.models import fit_masks
from perievent.operators.stats import g10, g11, g13
from perievent.plans import views as V


def overlaps(fields: DataFrame, boxes: DataFrame, by: str) -> DataFrame:
    """Each field (by, cell, x0, y0, a, b: half axes, theta) with each box (by, size, x, y: its middle) of its key: the
    common area as a share of the field, of the smaller one and of both together. Fields and boxes meet by key only."""

    def areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                p = b.iloc[lo : lo + 500]
                x, y = N.ellipses(*(p[c].to_numpy(float) for c in ("x0", "y0", "a", "b", "theta")))
                half, cx, cy = p["size"].to_numpy(float) / 2, p["x"].to_numpy(float), p["y"].to_numpy(float)
                field, box, common = N.polygon_area(x, y), 4 * half**2, N.area_in_box(x, y, cx - half, cx + half, cy - half, cy + half)
                yield p[[by, "cell", "size"]].assign(of_field=common / field, of_smaller=common / pd.DataFrame({"f": field, "b": box}).min(axis=1).to_numpy(), iou=common / (field + box - common))

    pairs = fields.select(by, "cell", "x0", "y0", "a", "b", "theta").join(boxes.select(by, F.col("size").cast("double").alias("size"), "x", "y"), by)
    return pairs.mapInPandas(areas, f"{by} {dict(fields.dtypes)[by]}, cell long, size double, of_field double, of_smaller double, iou double")


def overlapping(found: DataFrame, by: str, least: float) -> DataFrame:
    """The cells whose field overlaps any stimulus by so much of itself."""
    return found.groupBy(by, "cell").agg(F.max("of_field").alias("most")).filter(F.col("most") >= least)


def boot_fields(frames: DataFrame, where: DataFrame, iterations: int, seed: int) -> DataFrame:
    """Field fits of maps averaged over frames drawn with replacement: frames (frame, y, x, value), where (cell, y, x, as
    masks are). As many frames are drawn as there are; a pixel without a drawn frame is left out of its fit."""
    n = frames.agg(F.max("frame").alias("last"))  # one row
    picks = n.select("last", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("it")).select("last", "it", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("draw"))
    picks = picks.withColumn("frame", hashed(seed, "it", "draw") % (F.col("last") + 1)).groupBy("it", "frame").agg(F.count(F.lit(1)).alias("times"))
    maps = frames.join(picks, "frame").groupBy("it", "y", "x").agg((F.sum(F.col("value") * F.col("times")) / F.sum("times")).alias("v"))
    return fit_masks(where.select("cell", "y", "x"), maps, ("it",)).select("cell", "it", "amp", "x0", "y0", "sigma_x", "sigma_y", "theta", "offset", "r2")


def axis_weights(trials: DataFrame, first: Column) -> DataFrame:
    """(cell, w, middle): weights of a linear classifier of two classes of trials (cell, response), each cell on its own
    scale: the difference of the classes' means over the pooled variance."""
    part = lambda f, c: f(F.when(c, F.col("response")))
    g = trials.groupBy("cell").agg(part(F.avg, first).alias("m1"), part(F.avg, ~first).alias("m0"), part(F.var_pop, first).alias("v1"), part(F.var_pop, ~first).alias("v0"))
    pooled = (F.col("v1") + F.col("v0")) / 2
    return g.filter((pooled > 0) & F.col("m1").isNotNull() & F.col("m0").isNotNull()).select("cell", ((F.col("m1") - F.col("m0")) / pooled).alias("w"), ((F.col("m1") + F.col("m0")) / 2).alias("middle"))


def decode_trace(frames: DataFrame, weights: DataFrame) -> DataFrame:
    """(config, frame_ix, score, share): frames (cell, trial, config, frame_ix, value) scored by a classifier's weights
    (cell, w, middle): the mean over trials of the population's projection, and the share of trials that go to the first
    class."""
    s = frames.join(weights, "cell").groupBy("trial", "config", "frame_ix").agg(F.sum(F.col("w") * (F.col("value") - F.col("middle"))).alias("score"))
    return s.groupBy("config", "frame_ix").agg(F.avg("score").alias("score"), F.avg((F.round("score", 9) > 0).cast("double")).alias("share"))


def _fields(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select(F.col("p_brand").alias("datakey"), k.alias("cell"), ((k % 21 - 10) * 2.5).alias("x0"), ((k % 11 - 5) * 2.5).alias("y0"), (F.col("p_size") % 7 + 1.0).alias("a"), (F.col("p_size") % 5 + 1.0).alias("b"), (k % 180 * (math.pi / 180)).alias("theta"))


def f18(spark, sf):
    """Fields against the square stimuli of their dataset (all centred, sizes in steps of five)."""
    sizes = V.table(spark, sf, "part").select(F.col("p_brand").alias("datakey"), (F.ceil(F.col("p_size") / 5) * 5).alias("size")).distinct()
    return _r(overlaps(_fields(spark, sf), sizes.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}), "datakey"))


def b12(spark, sf):
    return _r(overlapping(f18(spark, sf), "datakey", 0.8))


def _frames(spark, sf):
    return V.grid(spark, sf).select("frame", "y", "x", (F.col("value") / 1000).alias("value"))


def i06(spark, sf):
    return _r(boot_fields(_frames(spark, sf), masks(spark, sf), 5, 12))


def b15(spark, sf):
    """Fields whose fit to the whole map lies inside the bootstrap's intervals, parameter by parameter."""
    whole = _frames(spark, sf).groupBy("y", "x").agg(F.avg("value").alias("v"))
    fits = fit_masks(masks(spark, sf).select("cell", "y", "x"), whole)
    params = ("x0", "y0", "sigma_x", "sigma_y")
    return _r(inside_intervals(fits.select("cell", *params), i06(spark, sf).select("cell", *params), ("cell",), params))


def e27(spark, sf):
    """A classifier of the two configs, trained on trials' stimulus means, read frame by frame."""
    t = V.traces(spark, sf)
    means = t.filter(F.col("frame_ix").between(V.STIM_ON, V.STIM_ON + V.N_ON - 1)).groupBy("cell", "trial", "config").agg(F.avg("value").alias("response"))
    return _r(decode_trace(t.select("cell", "trial", "config", "frame_ix", "value"), axis_weights(means, F.col("config") == 1)))


QUERIES = {
    "f18_overlaps": f18, "b12_overlapping_cells": b12, "i06_boot_fields": i06, "b15_reliable_fields": b15, "e27_decode_trace": e27,
    "g10_mann_whitney_p": lambda spark, sf: _r(tails.with_p(g10(spark, sf), "z", "z")), "g11_paired_p": lambda spark, sf: _r(tails.with_p(g11(spark, sf), "t", "t", "dof")), "g13_pearson_p": lambda spark, sf: _r(tails.with_p(g13(spark, sf).withColumn("dof", F.col("n") - 2), "t", "t", "dof")),
}
SQL = {
    "e27_decode_trace": f"WITH {V.TRACE}, m AS (SELECT cell, trial, config, avg(value) AS r FROM tr WHERE frame_ix BETWEEN 8 AND 13 GROUP BY ALL), g AS (SELECT cell, avg(r) FILTER (config = 1) AS m1, avg(r) FILTER (config = 0) AS m0, (var_pop(r) FILTER (config = 1) + var_pop(r) FILTER (config = 0)) / 2 AS v FROM m GROUP BY cell), w AS (SELECT cell, (m1 - m0) / v AS w, (m1 + m0) / 2 AS mid FROM g WHERE v > 0 AND m1 IS NOT NULL AND m0 IS NOT NULL), s AS (SELECT trial, config, frame_ix, sum(w * (value - mid)) AS s FROM tr JOIN w USING (cell) GROUP BY ALL) SELECT config, frame_ix, round(avg(s), 6) AS score, round(avg(CAST(round(s, 9) > 0 AS INT)), 6) AS share FROM s GROUP BY ALL",
}
