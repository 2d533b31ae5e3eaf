"""Stages that put operators together: stores by dataset, selections by stored tests, screens, resampled spectra and
curves, sets of several experiments. Each is a function of DataFrames; the queries run them on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.functions import circular
from perievent.operators.joins import keep, seeded_order
from perievent.operators.maps import image, masks
from perievent.operators.metrics import _rounded as _r
from perievent.operators.metrics import by_config, empirical_ci, psth, selectivity
from perievent.operators.models import bootstrap_means
from perievent.operators.series import runs
from perievent.operators.stats import auc, kruskal_wallis, paired
from perievent.plans import views as V
from perievent.plans.stash import stash
from perievent.plans.order import numbered, quantiles, running_counts
from perievent.sources.text import place


def hashed(seed: int, *keys: str) -> Column:
    """A reproducible number below 2^32 of the keys."""
    return F.conv(F.substring(seeded_order(seed, *keys), 1, 8), 16, 10).cast("long")


class KeyedStore:
    """Results by key in a folder, a directory a key: asked keys that are there are read, others are made and added."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def stored(self, like: DataFrame) -> DataFrame | None:
        spark = like.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return spark.read.schema(like.schema).parquet(self.path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None

    def get(self, source: DataFrame, make, create_new: bool = False) -> DataFrame:
        """make(source) for all keys of source. create_new makes all anew; otherwise only keys that the store lacks."""
        like, had = make(source), None if create_new else self.stored(make(source))
        missing = source if had is None else source.join(had.select(self.key).distinct(), self.key, "left_anti")
        made = make(missing)
        made.write.mode("overwrite" if create_new else "append").partitionBy(self.key).parquet(self.path)
        return self.stored(like)


def selected(stats: DataFrame, mode: str, visual: Column, selective: Column) -> DataFrame:
    """Cells of a stored test's table: visual (by one condition), selective (by both), or all."""
    return stats.filter({"visual": visual, "selective": visual & selective, "all": F.lit(True)}[mode])


def with_metadata(df: DataFrame, meta: dict) -> DataFrame:
    """df with constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in meta.items()})


def screen_degrees(x: Column, y: Column, width: float, height: float, distance: float) -> tuple[Column, Column, Column, Column]:
    """Of a place on a flat screen (pixels from its middle are x - width / 2, y - height / 2): linear degrees of both
    axes (atan of each alone), then azimuth and altitude on a sphere around the eye."""
    cx, cy = x - width / 2, y - height / 2
    lin = lambda c: F.degrees(F.atan2(c, F.lit(distance)))
    return lin(cx), lin(cy), lin(cx), F.degrees(F.atan2(cy, F.sqrt(cx * cx + distance * distance)))


def remapped(img: DataFrame, side: int, distance: float) -> DataFrame:
    """The image on an even grid of spherical degrees of the same extent: each target takes the four pixels around its
    place on the flat screen, weighted linearly; targets beyond the pixels are left out."""
    half = (side - 1) / 2
    top = math.degrees(math.atan2(half, distance))
    target = img.select("y", "x")
    az, al = (F.radians((F.col(c) - half) / half * top) for c in ("x", "y"))
    fx = distance * F.tan(az) + half
    fy = F.tan(al) * distance / F.cos(az) + half
    t = target.select("y", "x", fx.alias("fx"), fy.alias("fy")).withColumns({"x0": F.floor("fx"), "y0": F.floor("fy")})
    corners = F.explode(F.array(*[F.struct((F.col("y0") + dy).alias("sy"), (F.col("x0") + dx).alias("sx"), ((F.col("fy") - F.col("y0") if dy else 1 - F.col("fy") + F.col("y0")) * (F.col("fx") - F.col("x0") if dx else 1 - F.col("fx") + F.col("x0"))).alias("w")) for dy in (0, 1) for dx in (0, 1)])).alias("c")
    met = t.select("y", "x", corners).select("y", "x", "c.*").join(img.select(F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["sy", "sx"])
    return met.groupBy("y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 4").drop("n")


def spatial_places(cells: DataFrame, bin_size: float) -> DataFrame:
    """cells (cell, x, y) with their places by x, by y, and row by row of bins of y."""
    out = numbered(cells, [F.col("x"), F.col("y"), F.col("cell")], "place_x")
    out = numbered(out, [F.col("y"), F.col("x"), F.col("cell")], "place_y")
    return numbered(out.withColumn("row", F.floor(F.col("y") / bin_size)), [F.col("row"), F.col("x"), F.col("cell")], "place_both").drop("row")


def scaled_sigmas(fits: DataFrame, distance: float) -> DataFrame:
    """fits (cell, x0, y0, sigma_x, theta) with the ends of the major axis and its length after the spherical map."""
    dx, dy = F.col("sigma_x") * F.cos("theta"), F.col("sigma_x") * F.sin("theta")
    az = lambda x: F.degrees(F.atan2(x, F.lit(distance)))
    al = lambda x, y: F.degrees(F.atan2(y, F.sqrt(x * x + distance * distance)))
    ends = {f"{n}{k}": f for k, s in ((1, -1), (2, 1)) for n, f in (("az", az(F.col("x0") + s * dx)), ("al", al(F.col("x0") + s * dx, F.col("y0") + s * dy)))}
    return fits.withColumns(ends).withColumn("sigma_scaled", circular.distance(F.col("az1"), F.col("al1"), F.col("az2"), F.col("al2")) / 2)


def spectral_null(mags: DataFrame, keys: tuple[str, ...], target: int, iterations: int, seed: int) -> DataFrame:
    """Of magnitudes by frequency (keys, k from 1, mag): the target's share and how often frequencies drawn with
    replacement in its and all others' stead give as large a share. Magnitudes are made once and summed as decimals, so that
    draws of the same frequencies in another order are ties."""
    mags = stash(mags)
    share = lambda c: F.sum(F.when(F.col(c) == target, V.exact(F.col("mag")))).cast("double") / F.nullif(F.sum(V.exact(F.col("mag"))).cast("double"), F.lit(0.0))
    n = mags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    draws = n.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    draws = draws.withColumn("k", hashed(seed, *keys, "it", "j") % F.col("n") + 1)
    null = draws.join(mags, [*keys, "k"]).groupBy(*keys, "it").agg(share("j").alias("r0"))
    true = mags.groupBy(*keys).agg(share("k").alias("ratio"))
    return null.join(true, list(keys)).groupBy(*keys, "ratio").agg(F.avg((F.col("r0") >= F.col("ratio")).cast("double")).alias("p"))


def frame_null(frames: DataFrame, keys: tuple[str, ...], iterations: int, seed: int) -> DataFrame:
    """frames (keys, trial, frame_ix, value) -> each frame's mean, and the share of shuffles (frames dealt anew within
    their trial) whose largest mean reaches it. Means don't depend on the order of trials: a frame that is dealt to one place
    in all trials is a tie."""
    mean = frames.groupBy(*keys, "frame_ix").agg(V.mean("value").alias("mean"))
    s = frames.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    s = s.withColumn("new_ix", F.row_number().over(W.partitionBy(*keys, "trial", "it").orderBy(seeded_order(seed, "it", "trial", "frame_ix"), "frame_ix")) - 1)
    null = s.groupBy(*keys, "it", "new_ix").agg(V.mean("value").alias("m")).groupBy(*keys, "it").agg(F.max("m").alias("most"))
    return mean.join(null, list(keys)).groupBy(*keys, "frame_ix", "mean").agg(F.avg((F.col("most") >= F.col("mean")).cast("double")).alias("p"))


def row_correlations(a: DataFrame, b: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pearson r of each row of a with each row of b over their common columns."""
    left, right = a.select(column, F.col(row).alias("a"), F.col(value).alias("va")), b.select(column, F.col(row).alias("b"), F.col(value).alias("vb"))
    return left.join(right, column).groupBy("a", "b").agg(F.corr("va", "vb").alias("r"))


def split_auc(rows: DataFrame, keys: tuple[str, ...], side: Column, split: str, response: str, shuffled: int = 0, seed: int = 0) -> DataFrame:
    """AUC of two classes (side: true is the second) apart for low and high `split` values of each key (outer thirds), and
    with labels dealt anew `shuffled` times (it 0 is the true one). rows need a `unit` that orders ties."""
    r = rows.withColumn("side", side).join(quantiles(rows, keys, split, {"lo": 1 / 3, "hi": 2 / 3}), list(keys))
    r = r.withColumn("arousal", F.when(F.col(split) <= F.col("lo"), "low").when(F.col(split) >= F.col("hi"), "high")).filter("arousal is not null")
    by = (*keys, "arousal")
    points = r.select(*by, F.lit(0).alias("it"), "side", F.col(response).alias("v"))
    if shuffled:
        s = r.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(shuffled))))
        w = W.partitionBy(*by, "it")
        s = s.withColumns({"k": F.row_number().over(w.orderBy(seeded_order(seed, "it", "unit"), "unit")), "n": F.sum(F.col("side").cast("int")).over(w)})
        points = points.unionByName(s.select(*by, "it", (F.col("k") <= F.col("n")).alias("side"), F.col(response).alias("v")))
    return auc(points, (*by, "it"), ()).filter("n > 0 and n_base > 0").select(*by, "it", "auc", "n", "n_base")


def inside_intervals(measured: DataFrame, boots: DataFrame, keys: tuple[str, ...], params: tuple[str, ...], ci: float = 0.95) -> DataFrame:
    """measured (keys, params) with a flag for each parameter (<param>_in: within the bootstrap's empirical interval) and
    `reliable`: all of them."""
    long = boots.unpivot(list(keys), list(params), "param", "value")
    bounds = empirical_ci(long, (*keys, "param"), "value", ci).groupBy(*keys).pivot("param", list(params)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    met = measured.join(bounds, list(keys))
    flags = {f"{p}_in": F.round(F.col(p), 9).between(F.round(F.col(f"{p}_low"), 9), F.round(F.col(f"{p}_high"), 9)) for p in params}
    met = met.withColumns(flags)
    return met.withColumn("reliable", F.forall(F.array(*[F.col(f) for f in flags]), lambda x: x)).select(*keys, *params, *flags, "reliable")


def dilated(centers: DataFrame, radius: int) -> DataFrame:
    """(cell, y, x) of all pixels within the radius of a cell's centre (cy, cx)."""
    steps = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    o = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps])).alias("o")
    return centers.select("cell", "cy", "cx", o).select("cell", (F.col("cy") + F.col("o.dy")).alias("y"), (F.col("cx") + F.col("o.dx")).alias("x"))


def a02(spark, sf):
    """The configs that each dataset ran, with their parameters."""
    ran = V.recordings(spark, sf).select("datakey", "config").distinct()
    return _r(ran.join(V.stimuli(spark, sf).select("config", "ori", "size", "speed"), "config").select("datakey", "config", "ori", "size", "speed"))


def a06(spark, sf):
    """Frames of all runs with their run's start, length and rate."""
    t = V.traces(spark, sf, False).withColumn("t", V.micros("ts"))
    run = t.groupBy("cell").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n"))
    j = t.join(run, "cell")
    return _r(j.select("cell", "frame", ((F.col("t") - F.col("t0")) / 1e6).alias("tsec"), (F.col("n") / F.when(F.col("t1") > F.col("t0"), (F.col("t1") - F.col("t0")) / 1e6)).alias("rate")))


def a08(spark, sf):
    """Metrics of all datasets from a store that held some of them."""
    r, store = V.recordings(spark, sf), KeyedStore(place(spark, "store"), "datakey")
    make = lambda df: df.groupBy("datakey", "cell").agg(F.avg("response").alias("mean"), F.count(F.lit(1)).alias("n"))
    store.get(r.filter("datakey < 'B'"), make)
    return _r(store.get(r, make))


def b21(spark, sf):
    """Cells that a stored test's table selects, in each mode."""
    r = V.responses(spark, sf)
    stats = kruskal_wallis(r, ("datakey", "cell"), "config", "response").join(r.groupBy("datakey", "cell").agg(F.avg(F.abs("response")).alias("m")), ["datakey", "cell"])
    visual, selective = F.round("m", 6) > 0.09, F.round("h", 6) > 9
    frames = [selected(stats, mode, visual, selective).select("cell", F.lit(mode).alias("mode")) for mode in ("visual", "selective", "all")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def e18(spark, sf):
    """Bar events: stretches of one state with the times and values of their ends."""
    t = V.traces(spark, sf, False).withColumn("t", V.micros("ts"))
    s = runs(t.select("cell", "frame", "event_type"), ("cell",), ("frame",), "event_type").filter("length > 2")
    at = lambda end: t.select("cell", F.col("frame").alias(end), F.col("t").alias(f"t_{end}"), F.col("value").alias(f"v_{end}"))
    return _r(s.join(at("start"), ["cell", "start"]).join(at("stop"), ["cell", "stop"]).select("cell", "run", "event_type", ((F.col("t_stop") - F.col("t_start")) / 1e6).alias("seconds"), F.col("v_start").alias("from"), F.col("v_stop").alias("to")))


def e28(spark, sf):
    """Mean time course of each cell with the frames of the stimulus marked."""
    p = psth(V.traces(spark, sf)).groupBy("cell", "frame_ix").agg(F.avg("mean").alias("mean"))
    return _r(p.select("cell", "frame_ix", "mean", F.col("frame_ix").between(V.STIM_ON, V.STIM_ON + V.N_ON - 1).alias("stimulus")))


def f07(spark, sf):
    """Pixels in linear and spherical degrees, and the image on an even spherical grid."""
    img = image(spark, sf)
    lx, ly, az, al = screen_degrees(F.col("x"), F.col("y"), 63.0, 63.0, 40.0)
    return _r(img.select("y", "x", lx.alias("lin_x"), ly.alias("lin_y"), az.alias("azimuth"), al.alias("altitude")).join(remapped(img, 64, 40.0), ["y", "x"], "left"))


def f11(spark, sf):
    c = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_suppkey") * 37 % 101).alias("x"), (F.col("s_suppkey") * 53 % 97).alias("y"))
    return spatial_places(c, 10.0)


def f14(spark, sf):
    """Field fits in grid units as screen degrees (linear, steps of 2.5), then their scaled widths on the sphere."""
    k = F.col("p_partkey")
    f = V.table(spark, sf, "part").select(k.alias("cell"), ((k % 21 - 10) * 2.5).alias("x0"), ((k % 11 - 5) * 2.5).alias("y0"), ((F.col("p_size") % 7 + 1) * 2.5).alias("sigma_x"), (k % 180 * (math.pi / 180)).alias("theta"))
    return _r(scaled_sigmas(f, 30.0).select("cell", "x0", "y0", "sigma_x", "az1", "al1", "az2", "al2", "sigma_scaled"))


def f17(spark, sf):
    """Area of an ellipse from four marked points: top, bottom, left, right."""
    p = V.table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"p{i}") for i in range(8)])
    major = circular.distance(F.col("p0"), F.col("p1"), F.col("p2"), F.col("p3"))
    minor = circular.distance(F.col("p4"), F.col("p5"), F.col("p6"), F.col("p7"))
    return _r(p.select("vec_id", major.alias("major"), minor.alias("minor"), (major * minor * (math.pi / 4)).alias("area")))


def f24(spark, sf):
    return with_metadata(V.table(spark, sf, "region").select("r_regionkey", "r_name"), {"experiment": "gratings", "fov": 2, "rate": 44.69})


def f30(spark, sf):
    """Phases of two directions as degrees: absolute (half their difference), or the first alone where a dataset's delays
    spread too far."""
    r = V.recordings(spark, sf)
    part = lambda k: F.avg(F.when(F.col("config") == k, F.col("quantity")))
    m = r.groupBy("datakey", "cell").agg((part(1) / 25 - 1).alias("l"), (part(2) / 25 - 1).alias("r")).filter("l is not null and r is not null")
    m = m.withColumns({"absolute": (F.col("l") - F.col("r")) / 2, "delay": (F.col("l") + F.col("r")) / 2})
    sd = m.groupBy("datakey").agg(F.stddev_pop("delay").alias("sd"))
    phase = F.when(F.round("sd", 6) > 0.13, F.col("l")).otherwise(F.col("absolute"))
    return _r(m.join(sd, "datakey").select("datakey", "cell", circular.rescaled(phase, (-1.0, 1.0), (-57.3, 57.3)).alias("degrees")))


def _mags(spark, sf):
    p = psth(V.traces(spark, sf)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumn("k", V.long("k"))
    w = 2 * math.pi * F.col("k") * F.col("frame_ix") / 20
    g = p.groupBy("cell", "config", "k").agg(F.sum(F.col("mean") * F.cos(w)).alias("re"), F.sum(F.col("mean") * F.sin(w)).alias("im"))
    return g.select("cell", "config", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("mag"))


def g16(spark, sf):
    return _r(spectral_null(_mags(spark, sf), ("cell", "config"), 2, 8, 9))


def g19(spark, sf):
    return _r(frame_null(V.traces(spark, sf).select("cell", "trial", "frame_ix", "value"), ("cell",), 5, 4))


def i27(spark, sf):
    """AUC of config 2 over config 1 in each area by low and high quantity, with labels dealt anew three times."""
    r = V.recordings(spark, sf).filter("config <= 2").withColumn("unit", F.concat_ws("|", "trial", "cell"))
    return _r(split_auc(r, ("area",), F.col("config") == 2, "quantity", "response", 3, 17))


def m07(spark, sf):
    """Parameters that must not differ within a stimulus: how many values each config has, and whether it is one."""
    r = V.recordings(spark, sf).groupBy("config").agg(F.countDistinct("area").alias("areas"), F.countDistinct("datakey").alias("datasets"))
    return r.withColumn("single", F.col("datasets") == 1)


def n03(spark, sf):
    """Per-frame samples of the stimulus window, for classifiers, beside the trial's mean."""
    t = V.traces(spark, sf).filter(F.col("frame_ix").between(V.STIM_ON, V.STIM_ON + V.N_ON - 1))
    return _r(t.select("cell", "trial", "config", "frame_ix", "value", F.avg("value").over(W.partitionBy("cell", "trial")).alias("meanstim")))


def n06(spark, sf):
    """Cells whose test statistic passes, ranked within their dataset."""
    h = kruskal_wallis(V.responses(spark, sf), ("datakey", "cell"), "config", "response").filter(F.round("h", 6) > 9)
    return _r(h.select("datakey", "cell", "h", V.long(F.row_number().over(W.partitionBy("datakey").orderBy(F.desc("h"), "cell"))).alias("rank")))


def n08(spark, sf):
    """Means at two resolutions by cell: difference and its place in the empirical distribution."""
    m = V.recordings(spark, sf).groupBy("area", "cell").agg(*[V.mean(F.when(F.col("config") == k, F.col("response"))).alias(f"m{k}") for k in (1, 2)]).filter("m1 is not null and m2 is not null")
    m = stash(m)
    d = m.withColumn("d", F.round(F.col("m1") - F.col("m2"), 6))
    c = running_counts(d, ("area",), "d").select("area", "d", (F.col("upto") / F.col("total")).alias("ecdf"))
    t = paired(m, ("area",), "m1", "m2").select("area", "t")
    return _r(d.join(c, ["area", "d"]).join(t, "area").select("area", "cell", "d", "ecdf", "t"))


def n09(spark, sf):
    """Tuning of even trials against that of odd ones, all pairs of cells."""
    r = V.responses(spark, sf)
    half = lambda k: by_config(r.filter(f"trial % 2 = {k}"))
    return _r(row_correlations(half(0), half(1), "cell", "config", "response"))


def n11(spark, sf):
    """Selectivity of each cell at each level of a second parameter."""
    r = V.recordings(spark, sf).withColumn("level", V.long(F.floor(F.col("quantity") / 25)))
    m = r.groupBy(F.concat_ws("|", "datakey", "level").alias("datakey"), "cell", "config").agg(F.avg("response").alias("response"))
    return _r(selectivity(m, 45.0).select("datakey", "cell", "asi", "dsi", "circ_var", "sparseness"))


def n14(spark, sf):
    """Responsive cells of three experiments in one table, with how many found each."""
    r = V.recordings(spark, sf)
    frames = [r.filter(f"datakey = '{k}'").groupBy("cell").agg(F.max("response").alias("m")).filter("m > 60000").select("cell", F.lit(k).alias("experiment")) for k in ("AF", "NO", "RF")]
    u = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return u.join(u.groupBy("cell").agg(F.count(F.lit(1)).alias("found")), "cell")


def n15(spark, sf):
    """Responses for decoding: cells that pass, configs that all datasets have, and equally many trials listed."""
    r = V.recordings(spark, sf)
    cells = r.groupBy("datakey", "cell").agg(F.max("response").alias("m")).filter("m > 70000").select("datakey", "cell")
    configs = r.groupBy("config").agg(F.countDistinct("datakey").alias("n"))
    most = r.agg(F.countDistinct("datakey").alias("n"))  # one row
    configs = configs.join(F.broadcast(most), "n").select("config")
    final = keep(keep(r, cells, ["datakey", "cell"]), configs, ["config"])
    return _r(final.groupBy("datakey", "config").agg(F.countDistinct("cell").alias("n_cells"), F.countDistinct("trial").alias("n_trials"), F.avg("response").alias("mean")))


def n17(spark, sf):
    """Whether each cell's measured mean responses lie inside their bootstrap's intervals."""
    r = V.responses(spark, sf)
    params = ("c0", "c1", "c2")
    wide = lambda df, keys: df.filter("config < 3").groupBy(*keys).pivot("config", [0, 1, 2]).agg(F.first("response")).select(*keys, *[F.col(str(k)).alias(f"c{k}") for k in range(3)])
    boots = wide(bootstrap_means(r, 20, 10, 8), ("cell", "it"))
    return _r(inside_intervals(wide(by_config(r), ("cell",)), boots.drop("it"), ("cell",), params, 0.8))


def n18(spark, sf):
    """Deviant cells by area: beyond a deviation and a half of their area's regression of response on quantity."""
    m = V.recordings(spark, sf).groupBy("area", "cell").agg(F.avg("quantity").alias("x"), F.avg("response").alias("y"))
    fit = m.groupBy("area").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    e = m.join(fit, "area").withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    sd = e.groupBy("area").agg(F.stddev_pop("e").alias("sd"))
    d = F.coalesce(F.round(F.abs("e"), 6) > F.round(1.5 * F.col("sd"), 6), F.lit(False))
    return _r(e.join(sd, "area").groupBy("area").agg(F.sum(d.cast("long")).alias("n_deviant"), F.count(F.lit(1)).alias("n"), F.avg(F.when(d, F.abs("e"))).alias("mean_apart")))


def n23(spark, sf):
    """Pixels within three of a mask's centre, and how many masks cover each."""
    c = masks(spark, sf).groupBy("cell").agg(F.min("y").alias("y0"), F.min("x").alias("x0")).select("cell", (F.col("y0") + 2).alias("cy"), (F.col("x0") + 2).alias("cx"))
    return dilated(c, 3).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))


_KW = "k AS (SELECT cell, config, response, rank() OVER (PARTITION BY cell ORDER BY response) + (count(*) OVER (PARTITION BY cell, response) - 1) / 2.0 AS rank FROM resp), tie AS (SELECT cell, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT cell, response, count(*) AS t FROM k GROUP BY ALL) GROUP BY cell), kg AS (SELECT cell, config, sum(rank) AS r, count(*) AS n FROM k GROUP BY ALL), ks AS (SELECT cell, sum(r * r / n) AS s, CAST(sum(n) AS DOUBLE) AS n FROM kg GROUP BY cell), kw AS (SELECT cell, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h FROM ks JOIN tie USING (cell))"
_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
_DEG = "degrees(atan2({}, {}))"


def _sql_f07() -> str:
    top = math.degrees(math.atan2(31.5, 40.0))
    half = "WITH " + V.GRID + ", img AS (SELECT y, x, avg(value) / 1000 AS v FROM grid GROUP BY y, x), t AS (SELECT y, x, 40 * tan(radians((x - 31.5) / 31.5 * {0})) + 31.5 AS fx, tan(radians((y - 31.5) / 31.5 * {0})) * 40 / cos(radians((x - 31.5) / 31.5 * {0})) + 31.5 AS fy FROM img)".format(top)
    corner = ", c AS (SELECT t.y, t.x, CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END * CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * i.v AS wv FROM t, range(2) a(dy), range(2) b(dx) JOIN img i ON i.y = floor(fy) + dy AND i.x = floor(fx) + dx), m AS (SELECT y, x, sum(wv) AS v FROM c GROUP BY y, x HAVING count(*) = 4)"
    return half + corner + " SELECT i.y, i.x, round(degrees(atan2(i.x - 31.5, 40)), 6) AS lin_x, round(degrees(atan2(i.y - 31.5, 40)), 6) AS lin_y, round(degrees(atan2(i.x - 31.5, 40)), 6) AS azimuth, round(degrees(atan2(i.y - 31.5, sqrt((i.x - 31.5) ** 2 + 1600))), 6) AS altitude, round(m.v, 6) AS v FROM img i LEFT JOIN m USING (y, x)"


def _sql_f14() -> str:
    az, al = "degrees(atan2(x0 {s} sigma_x * cos(theta), 30))", "degrees(atan2(y0 {s} sigma_x * sin(theta), sqrt((x0 {s} sigma_x * cos(theta)) ** 2 + 900)))"
    ends = ", ".join(f"{f.format(s=s)} AS {n}{k}" for k, s in ((1, "-"), (2, "+")) for n, f in (("az", az), ("al", al)))
    return f"WITH f AS (SELECT p_partkey AS cell, (p_partkey % 21 - 10) * 2.5::DOUBLE AS x0, (p_partkey % 11 - 5) * 2.5::DOUBLE AS y0, (p_size % 7 + 1) * 2.5::DOUBLE AS sigma_x, p_partkey % 180 * (pi() / 180) AS theta FROM part), e AS (SELECT *, {ends} FROM f) SELECT cell, x0, y0, sigma_x, round(az1, 6) AS az1, round(al1, 6) AS al1, round(az2, 6) AS az2, round(al2, 6) AS al2, round(sqrt((az1 - az2) ** 2 + (al1 - al2) ** 2) / 2, 6) AS sigma_scaled FROM e"


_AUC_OF = "r AS (SELECT {k}, min(v) FILTER (side) AS lo, (max(v) FILTER (side) - min(v) FILTER (side)) / 49 AS step, list(v) FILTER (side) AS ss, list(v) FILTER (NOT side) AS bb FROM {src} GROUP BY ALL), q AS (SELECT {k}, i, len(ss) AS n, len(bb) AS n_base, len(list_filter(ss, lambda z: z > lo + i * step)) / len(ss) AS h, len(list_filter(bb, lambda z: z > lo + i * step)) / len(bb) AS f FROM r, range(50) t(i) WHERE len(ss) > 0 AND len(bb) > 0), a AS (SELECT *, lag(h) OVER w AS h0, lag(f) OVER w AS f0 FROM q WINDOW w AS (PARTITION BY {k} ORDER BY i))"
_N18 = "m AS (SELECT area, cell, avg(quantity) AS x, avg(response) AS y FROM rec GROUP BY ALL), f AS (SELECT area, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m GROUP BY area), e AS (SELECT area, y - a - b * x AS e FROM m JOIN f USING (area)), s AS (SELECT area, e, stddev_pop(e) OVER (PARTITION BY area) AS sd FROM e)"
QUERIES = {
    "a02_run_info": a02, "a06_pose_frames": a06, "a08_keyed_store": a08, "b21_selection_modes": b21, "e18_bar_events": e18, "e28_time_course": e28, "f07_spherical_map": f07, "f11_spatial_places": f11, "f14_scaled_sigmas": f14, "f17_ellipse_area": f17, "f24_metadata": f24, "f30_phase_degrees": f30,
    "g16_spectral_null": g16, "g19_frame_null": g19, "i27_split_auc": i27, "m07_single_valued": m07, "n03_frame_samples": n03, "n06_ranked_cells": n06, "n08_paired_sizes": n08, "n09_row_correlations": n09, "n11_selectivity_sets": n11, "n14_pooled_cells": n14, "n15_final_data": n15, "n17_inside_intervals": n17, "n18_deviants": n18, "n23_dilated_centers": n23,
}
SQL = {
    "a02_run_info": f"WITH {V.REC}, {V.STIM} SELECT DISTINCT datakey, config, ori, size, round(speed, 6) AS speed FROM rec JOIN stim USING (config)",
    "a06_pose_frames": f"WITH {V.TRACE}, t AS (SELECT cell, frame, epoch_us(ts) AS t FROM trall), r AS (SELECT cell, min(t) AS t0, max(t) AS t1, count(*) AS n FROM t GROUP BY cell) SELECT cell, frame, round((t - t0) / 1e6, 6) AS tsec, round(n / CASE WHEN t1 > t0 THEN (t1 - t0) / 1e6 END, 6) AS rate FROM t JOIN r USING (cell)",
    "a08_keyed_store": f"WITH {V.REC} SELECT datakey, cell, round(avg(response), 6) AS mean, count(*) AS n FROM rec GROUP BY ALL",
    "b21_selection_modes": f"WITH {V.RESP}, {_KW}, s AS (SELECT cell, h, round(m, 6) > 0.09 AS visual FROM kw JOIN (SELECT cell, avg(abs(response)) AS m FROM resp GROUP BY cell) USING (cell)) SELECT cell, 'visual' AS mode FROM s WHERE visual UNION ALL SELECT cell, 'selective' FROM s WHERE visual AND h > 9 UNION ALL SELECT cell, 'all' FROM s",
    "e18_bar_events": f"WITH {V.TRACE}, c AS (SELECT *, epoch_us(ts) AS t, CAST(event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY cell ORDER BY frame) AS INT) AS c FROM trall), g AS (SELECT *, sum(c) OVER (PARTITION BY cell ORDER BY frame) AS run FROM c) SELECT cell, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, round((max(t) - min(t)) / 1e6, 6) AS seconds, round(arg_min(value, frame), 6) AS \"from\", round(arg_max(value, frame), 6) AS \"to\" FROM (SELECT * FROM g) GROUP BY cell, run HAVING count(*) > 2",
    "e28_time_course": f"WITH {V.TRACE}, p AS (SELECT cell, config, frame_ix, avg(value) AS m FROM tr GROUP BY ALL) SELECT cell, frame_ix, round(avg(m), 6) AS mean, frame_ix BETWEEN 8 AND 13 AS stimulus FROM p GROUP BY cell, frame_ix",
    "f07_spherical_map": _sql_f07(),
    "f11_spatial_places": "WITH c AS (SELECT s_suppkey AS cell, s_suppkey * 37 % 101 AS x, s_suppkey * 53 % 97 AS y FROM supplier) SELECT *, row_number() OVER (ORDER BY x, y, cell) AS place_x, row_number() OVER (ORDER BY y, x, cell) AS place_y, row_number() OVER (ORDER BY floor(y / 10), x, cell) AS place_both FROM c",
    "f14_scaled_sigmas": _sql_f14(),
    "f17_ellipse_area": "WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), a AS (SELECT vec_id, sqrt((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2) AS major, sqrt((e[5] - e[7]) ** 2 + (e[6] - e[8]) ** 2) AS minor FROM p) SELECT vec_id, round(major, 6) AS major, round(minor, 6) AS minor, round(major * minor * (pi() / 4), 6) AS area FROM a",
    "f24_metadata": "SELECT r_regionkey, r_name, 'gratings' AS experiment, CAST(2 AS INT) AS fov, CAST(44.69 AS DOUBLE) AS rate FROM region",
    "f30_phase_degrees": f"WITH {V.REC}, m AS (SELECT datakey, cell, avg(quantity) FILTER (config = 1) / 25 - 1 AS l, avg(quantity) FILTER (config = 2) / 25 - 1 AS r FROM rec GROUP BY ALL), d AS (SELECT *, stddev_pop((l + r) / 2) OVER (PARTITION BY datakey) AS sd FROM m WHERE l IS NOT NULL AND r IS NOT NULL) SELECT datakey, cell, round(CASE WHEN round(sd, 6) > 0.13 THEN l ELSE (l - r) / 2 END * 57.3, 6) AS degrees FROM d",
    "g16_spectral_null": f"WITH {V.TRACE}, p AS (SELECT cell, config, frame_ix, avg(value) AS m FROM tr GROUP BY ALL), g AS (SELECT cell, config, k, sqrt(sum(m * cos(2 * pi() * k * frame_ix / 20)) ** 2 + sum(m * sin(2 * pi() * k * frame_ix / 20)) ** 2) AS mag FROM p, range(1, 11) t(k) GROUP BY ALL), d AS (SELECT cell, config, it, j, {_HASH.format(chr(39) + '9|' + chr(39) + ' || cell || ' + chr(39) + '|' + chr(39) + ' || config || ' + chr(39) + '|' + chr(39) + ' || it || ' + chr(39) + '|' + chr(39) + ' || j')} % 10 + 1 AS k FROM (SELECT DISTINCT cell, config FROM g), range(8) a(it), range(1, 11) b(j)), n AS (SELECT cell, config, it, sum(mag) FILTER (j = 2) / sum(mag) AS r0 FROM d JOIN g USING (cell, config, k) GROUP BY ALL), t AS (SELECT cell, config, sum(mag) FILTER (k = 2) / sum(mag) AS ratio FROM g GROUP BY ALL) SELECT cell, config, round(ratio, 6) AS ratio, round(avg(CAST(r0 >= ratio AS INT)), 6) AS p FROM n JOIN t USING (cell, config) GROUP BY cell, config, ratio",
    "g19_frame_null": f"WITH {V.TRACE}, m AS (SELECT cell, frame_ix, avg(value) AS mean FROM tr GROUP BY ALL), s AS (SELECT cell, trial, it, value, row_number() OVER (PARTITION BY cell, trial, it ORDER BY md5('4|' || it || '|' || trial || '|' || frame_ix), frame_ix) AS k FROM tr, range(5) t(it)), n AS (SELECT cell, it, max(m) AS most FROM (SELECT cell, it, k, avg(value) AS m FROM s GROUP BY ALL) GROUP BY ALL) SELECT cell, frame_ix, round(mean, 6) AS mean, round(avg(CAST(most >= mean AS INT)), 6) AS p FROM m JOIN n USING (cell) GROUP BY cell, frame_ix, mean",
    "i27_split_auc": f"WITH {V.REC}, x AS (SELECT area, config = 2 AS side, quantity, response, trial || '|' || cell AS unit FROM rec WHERE config <= 2), b AS (SELECT area, quantile_cont(quantity, 1 / 3::DOUBLE) AS lo, quantile_cont(quantity, 2 / 3::DOUBLE) AS hi FROM x GROUP BY area), s AS (SELECT x.*, CASE WHEN quantity <= lo THEN 'low' WHEN quantity >= hi THEN 'high' END AS arousal FROM x JOIN b USING (area)), k AS (SELECT area, arousal, it, response, row_number() OVER (PARTITION BY area, arousal, it ORDER BY md5('17|' || it || '|' || unit), unit) <= sum(CAST(side AS INT)) OVER (PARTITION BY area, arousal, it) AS side FROM s, range(1, 4) t(it) WHERE arousal IS NOT NULL), u AS (SELECT area, arousal, 0 AS it, side, response AS v FROM s WHERE arousal IS NOT NULL UNION ALL SELECT area, arousal, it, side, response FROM k), {_AUC_OF.format(k='area, arousal, it', src='u')} SELECT area, arousal, CAST(it AS INT) AS it, round(sum((f0 - f) * (h + h0) / 2), 6) AS auc, any_value(n) AS n, any_value(n_base) AS n_base FROM a GROUP BY area, arousal, it",
    "m07_single_valued": f"WITH {V.REC} SELECT config, count(DISTINCT area) AS areas, count(DISTINCT datakey) AS datasets, count(DISTINCT datakey) = 1 AS single FROM rec GROUP BY config",
    "n03_frame_samples": f"WITH {V.TRACE} SELECT cell, trial, config, frame_ix, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY cell, trial), 6) AS meanstim FROM tr WHERE frame_ix BETWEEN 8 AND 13",
    "n06_ranked_cells": f"WITH {V.RESP}, {_KW} SELECT 'pop' AS datakey, cell, h, row_number() OVER (ORDER BY h DESC, cell) AS rank FROM kw WHERE h > 9",
    "n08_paired_sizes": f"WITH {V.REC}, m AS (SELECT area, cell, avg(response) FILTER (config = 1) - avg(response) FILTER (config = 2) AS d FROM rec GROUP BY ALL) SELECT area, cell, round(d, 6) AS d, round(cume_dist() OVER (PARTITION BY area ORDER BY round(d, 6)), 6) AS ecdf, round(avg(d) OVER w / (stddev_samp(d) OVER w / sqrt(count(*) OVER w)), 6) AS t FROM m WHERE d IS NOT NULL WINDOW w AS (PARTITION BY area)",
    "n09_row_correlations": f"WITH {V.RESP}, m AS (SELECT trial % 2 AS half, cell, config, avg(response) AS v FROM resp GROUP BY ALL) SELECT x.cell AS a, y.cell AS b, round(corr(x.v, y.v), 6) AS r FROM m x JOIN m y ON x.config = y.config AND x.half = 0 AND y.half = 1 GROUP BY ALL",
    "n11_selectivity_sets": f"WITH {V.REC}, m AS (SELECT datakey || '|' || CAST(floor(quantity / 25) AS BIGINT) AS datakey, cell, config, avg(response) AS r FROM rec GROUP BY ALL), l AS (SELECT datakey, cell, config, r - min(r) OVER (PARTITION BY datakey, cell) AS r FROM m), s AS (SELECT datakey, cell, sum(r * cos(radians(config * 45))) AS c1, sum(r * sin(radians(config * 45))) AS s1, sum(r * cos(2 * radians(config * 45))) AS c2, sum(r * sin(2 * radians(config * 45))) AS s2, sum(r) AS t, sum(r * r) AS q, count(*) AS n FROM l GROUP BY ALL) SELECT datakey, cell, round(sqrt(c2 * c2 + s2 * s2) / nullif(t, 0), 6) AS asi, round(sqrt(c1 * c1 + s1 * s1) / nullif(t, 0), 6) AS dsi, round(1 - sqrt(c1 * c1 + s1 * s1) / nullif(t, 0), 6) AS circ_var, round(CASE WHEN q > 0 AND n > 1 THEN (1 - (t / n) ** 2 / (q / n)) / (1 - 1 / n) ELSE 0 END, 6) AS sparseness FROM s",
    "n14_pooled_cells": f"WITH {V.REC}, u AS (SELECT cell, datakey AS experiment FROM rec WHERE datakey IN ('AF', 'NO', 'RF') GROUP BY ALL HAVING max(response) > 60000) SELECT cell, experiment, count(*) OVER (PARTITION BY cell) AS found FROM u",
    "n15_final_data": f"WITH {V.REC}, c AS (SELECT datakey, cell FROM rec GROUP BY ALL HAVING max(response) > 70000), f AS (SELECT config FROM rec GROUP BY config HAVING count(DISTINCT datakey) = (SELECT count(DISTINCT datakey) FROM rec)) SELECT datakey, config, count(DISTINCT cell) AS n_cells, count(DISTINCT trial) AS n_trials, round(avg(response), 6) AS mean FROM rec JOIN c USING (datakey, cell) WHERE config IN (SELECT config FROM f) GROUP BY ALL",
    "n17_inside_intervals": f"WITH {V.RESP}, t AS (SELECT config, trial, row_number() OVER (PARTITION BY config ORDER BY trial) - 1 AS k, count(*) OVER (PARTITION BY config) AS n FROM (SELECT DISTINCT config, trial FROM resp)), p AS (SELECT config, it, {_HASH.format(chr(39) + '8|' + chr(39) + ' || config || ' + chr(39) + '|' + chr(39) + ' || it || ' + chr(39) + '|' + chr(39) + ' || draw')} % n AS k FROM (SELECT DISTINCT config, n FROM t), range(10) a(it), range(20) b(draw)), q AS (SELECT p.config, p.it, t.trial FROM p JOIN t USING (config, k)), b AS (SELECT cell, it, config, avg(response) AS r FROM resp JOIN q USING (config, trial) WHERE config < 3 GROUP BY ALL), ci AS (SELECT cell, config, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM b GROUP BY ALL), m AS (SELECT cell, config, avg(response) AS r FROM resp WHERE config < 3 GROUP BY ALL), j AS (SELECT cell, config, r, round(r, 9) BETWEEN round(lo, 9) AND round(hi, 9) AS ok FROM m JOIN ci USING (cell, config)) SELECT cell, round(max(r) FILTER (config = 0), 6) AS c0, round(max(r) FILTER (config = 1), 6) AS c1, round(max(r) FILTER (config = 2), 6) AS c2, bool_and(ok) FILTER (config = 0) AS c0_in, bool_and(ok) FILTER (config = 1) AS c1_in, bool_and(ok) FILTER (config = 2) AS c2_in, bool_and(ok) AS reliable FROM j GROUP BY cell",
    "n18_deviants": f"WITH {V.REC}, {_N18} SELECT area, count(*) FILTER (round(abs(e), 6) > round(1.5 * sd, 6)) AS n_deviant, count(*) AS n, round(avg(abs(e)) FILTER (round(abs(e), 6) > round(1.5 * sd, 6)), 6) AS mean_apart FROM s GROUP BY area",
    "n23_dilated_centers": "WITH m AS (SELECT s_suppkey * 3 % 50 + 2 AS cy, s_suppkey * 2 % 50 + 2 AS cx FROM supplier) SELECT cy + dy AS y, cx + dx AS x, count(*) AS n FROM m, range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx <= 9 GROUP BY ALL",
}
