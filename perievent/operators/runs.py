"""Runs put together: collation around trial onsets, stores that grow by dataset, matched neural and pupil data, motion
checks, numbering without a task for all rows, fits of all bootstrap iterations at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.functions import numerics as N
from perievent.functions.digests import md5_words, ordered
from perievent.operators import stats
from perievent.operators.curves import psychometric
from perievent.operators.drivers import split_auc
from perievent.operators.joins import seeded_order
from perievent.operators.metrics import _rounded as _r
from perievent.operators.models import bootstrap_means
from perievent.plans import order
from perievent.plans import views as V
from perievent.plans.stash import stash
from perievent.sources.text import place


def collate(traces: DataFrame, onsets: DataFrame, keys: tuple[str, ...], before: int, after: int, rate: float) -> DataFrame:
    """keys, trial, config, frame_ix, tsec, raw, f0, dff: the frames of traces (keys, frame, value) from `before` before each
    onset (keys, trial, config, onset) to `after` after it (onset is frame_ix `before`, tsec 0), and their change over the
    mean f0 of the frames before. Trials that a recording doesn't hold whole are left out, a trial's frames may belong to
    two trials. dff is null where f0 isn't positive."""
    offsets = F.sequence(F.lit(-before).cast("long"), F.lit(after - 1).cast("long"))
    asked = onsets.select(*keys, "trial", "config", "onset", F.explode(offsets).alias("_k")).withColumn("frame", F.col("onset") + F.col("_k"))
    met = asked.join(traces.select(*keys, "frame", "value"), [*keys, "frame"])
    w = W.partitionBy(*keys, "trial")  # a trial's frames
    rows = met.withColumns({"_n": F.count("value").over(w), "f0": F.avg(F.when(F.col("_k") < 0, F.col("value"))).over(w)}).filter(F.col("_n") == before + after)
    return rows.select(*keys, "trial", "config", (F.col("_k") + before).alias("frame_ix"), (F.col("_k") / rate).alias("tsec"), F.col("value").alias("raw"), "f0", F.when(F.col("f0") > 0, (F.col("value") - F.col("f0")) / F.col("f0")).alias("dff"))


def labels(collated: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, config, n_trials, n_frames of a collated run."""
    t = collated.groupBy(*keys, "config", "trial").agg(F.count(F.lit(1)).alias("n"))
    return t.groupBy(*keys, "config").agg(F.count(F.lit(1)).alias("n_trials"), F.sum("n").alias("n_frames"))


def grown_store(parts: list[DataFrame], key: str) -> DataFrame:
    """A store in the shared folder with one directory for each value of key, to which each part is appended; columns that a
    part lacks are null."""
    spark, path = parts[0].sparkSession, place(parts[0].sparkSession, "store")
    whole = parts[0].limit(0)
    for p in parts[1:]:
        whole = whole.unionByName(p.limit(0), allowMissingColumns=True)
    for p in parts:
        whole.unionByName(p, allowMissingColumns=True).write.partitionBy(key).mode("append").parquet(path)
    return spark.read.schema(whole.schema).parquet(path)


def discovered(rows: DataFrame, dataset: str, run: str, glob: str) -> DataFrame:
    """dataset, run: what is found by a glob over the folders of a store of rows by dataset and run; no row of other
    datasets is read, and none of a folder's own."""
    spark, path = rows.sparkSession, place(rows.sparkSession, "tree")
    rows.write.partitionBy(dataset, run).parquet(path)
    found = spark.read.schema(rows.schema).option("basePath", path).parquet(f"{path}/{dataset}={glob}")
    return found.select(dataset, run).distinct()


def responsive(tests: DataFrame, keys: tuple[str, ...], p: str | None = None, most: float = 0.05, frames: str | None = None, least: int = 0) -> DataFrame:
    """keys of the cells that a test's result says respond: p under `most`, or over `least` frames beyond the threshold in
    any config."""
    if p:
        return tests.filter(F.col(p) < most).select(*keys).distinct()
    return tests.groupBy(*keys).agg(F.max(frames).alias("n")).filter(F.col("n") > least)


def valid_datasets(neural: DataFrame, pupil: DataFrame, dataset: str, trial: str, least: int) -> DataFrame:
    """dataset, n_neural, n_pupil, n_both: datasets with at least `least` trials that have neural and pupil data."""
    a, b = neural.select(dataset, trial).distinct().withColumn("_a", F.lit(1)), pupil.select(dataset, trial).distinct().withColumn("_b", F.lit(1))
    met = a.join(b, [dataset, trial], "full")
    n = met.groupBy(dataset).agg(F.count("_a").alias("n_neural"), F.count("_b").alias("n_pupil"), F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("n_both"))
    return n.filter(F.col("n_both") >= least)


def interpolated(samples: DataFrame, asked: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """asked (keys, id, t) with the values of samples (keys, t, values) at t, on the line between the samples before and
    after; null outside them. Samples of one time count as their mean. One sort of both sides together."""
    s = samples.groupBy(*keys, "t").agg(*[F.avg(v).alias(v) for v in values])
    none = F.lit(None)
    both = s.select(*keys, "t", F.lit(0).alias("_asked"), none.cast(dict(asked.dtypes)["id"]).alias("id"), F.struct("t", *values).alias("_s")).unionByName(asked.select(*keys, "t", F.lit(1).alias("_asked"), "id", none.cast(s.select(F.struct("t", *values)).dtypes[0][1]).alias("_s")))
    ahead = W.partitionBy(*keys).orderBy("t", "_asked").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*keys).orderBy(F.desc("t"), "_asked").rowsBetween(W.unboundedPreceding, 0)
    d = both.withColumns({"_a": F.last("_s", ignorenulls=True).over(ahead), "_b": F.last("_s", ignorenulls=True).over(back)}).filter("_asked = 1")
    share = F.when(F.col("_b.t") > F.col("_a.t"), (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))).otherwise(F.when(F.col("_b.t") == F.col("_a.t"), F.lit(0.0)))
    return d.select(*keys, "id", "t", *[(F.col(f"_a.{v}") + share * (F.col(f"_b.{v}") - F.col(f"_a.{v}"))).alias(v) for v in values])


def image_quality(pixels: DataFrame, within: tuple[str, ...], unit: str, deviations: float, reference: Column | None = None) -> DataFrame:
    """within, unit, r, n, bad of pixels (within, unit, y, x, value): how each unit's (a file's, a frame's) mean image
    correlates with the reference image, the mean of those units that `reference` says or of all; bad if r is `deviations`
    standard deviations or more from the mean r."""
    own = pixels.groupBy(*within, unit, "y", "x").agg(F.avg("value").alias("v"))
    chosen = pixels.filter(reference) if reference is not None else pixels
    ref = chosen.groupBy(*within, "y", "x").agg(F.avg("value").alias("ref"))
    r = stash(own.join(ref, [*within, "y", "x"]).groupBy(*within, unit).agg(F.corr("v", "ref").alias("r"), F.count(F.lit(1)).alias("n")))
    m = r.groupBy(*within).agg(F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"))
    met = r.join(m, list(within)) if within else r.crossJoin(F.broadcast(m))  # one row
    return met.select(*within, unit, "r", "n", F.coalesce((F.col("_s") > 0) & (F.round(F.abs(F.col("r") - F.col("_m")), 9) >= F.round(deviations * F.col("_s"), 9)), F.lit(False)).alias("bad"))


def numbered_within(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], name: str) -> DataFrame:
    """df with a number from 1 within its keys in the order `by`, whatever a key's size: places in one order of all rows
    less the key's first. Keys must not be null."""
    placed = stash(order.numbered(df, [F.col(c) for c in (*keys, *by)], "_at"))
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    return placed.join(first, list(keys)).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


#: Places of a shuffle that one task pairs at once, about, and rows that a task packs at once.
SHARE, PACK = 1 << 20, 1 << 19


def thin(v: np.ndarray) -> bytes:
    """Doubles in few bytes, without loss: whole numbers or hundredths where they are, by byte planes."""
    for scale in (1, 100):
        t = np.rint(v * scale)
        if len(v) and np.abs(t).max() < 2**31 and (t / scale == v).all():
            kind = next(k for k in ("i1", "<i2", "<i4") if np.abs(t).max() <= np.iinfo(k).max)
            t = t.astype(kind)
            return bytes([scale, t.itemsize]) + t.view(np.uint8).reshape(-1, t.itemsize).T.tobytes()
    return bytes([0, 8]) + np.ascontiguousarray(v, dtype="<f8").view(np.uint8).reshape(-1, 8).T.tobytes()


def thick(b: bytes) -> np.ndarray:
    """What thin packed."""
    planes = np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8, offset=2).reshape(b[1], -1).T)
    return planes.view("<f8")[:, 0] if b[0] == 0 else planes.view(f"<i{b[1]}")[:, 0].astype(float) / b[0]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Key, places, x's and y's (nan for null) of batches of (_g, _k, _x, _y), some rows at once, each key's in the order of places."""

    def out(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        g, k, x, y = (t.column(i).to_numpy() for i in range(4))
        o = np.lexsort((k, g))
        g, k, x, y = g[o], k[o], x[o].astype(float), y[o].astype(float)
        ends = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for i, j in zip(ends, ends[1:]):
            yield int(g[i]), k[i:j], x[i:j], y[i:j]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= PACK:
            yield from out(held)
            held = []
    if held:
        yield from out(held)


def correlation_null(df: DataFrame, keys: tuple[str, ...], x: str, y: str, unit: tuple[str, ...], iterations: int, seed: int) -> DataFrame:
    """keys, r, p: Pearson's r with the share of shuffles that reach it. In each the y's are dealt to the x's anew: both
    meet by their places, x's in the order of their units, y's in seeded order. Ranges of the seeded order are counted first,
    so that places of x's are known by range; then each range's x's and y's meet once, packed, whatever a key's size."""
    a = stash(order.placed(df.select(*dict.fromkeys((*keys, *unit, x, y))), keys, unit, tuple(dict.fromkeys((x, y))), "_k"))
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.corr(x, y).alias("_r"))
    sizes = stash(order.numbered(sizes, [F.col(c) for c in keys], "_g"))
    rows = a.join(sizes.select(*keys, "_g"), list(keys)).select("_g", "_k", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    large = {r["_g"]: -(-r["_n"] // SHARE) for r in sizes.filter(F.col("_n") > SHARE).select("_g", "_n").collect()}  # a row for so many rows of the table at most

    def hashed(it: int, k: np.ndarray, parts: int) -> np.ndarray:
        return ((md5_words(f"{seed}|{it}|", k)[0] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[int, int], np.ndarray] = {}
        for g, k, _, _ in _packed(batches):
            for it in range(iterations if g in large else 0):
                n[g, it] = n.get((g, it), 0) + np.bincount(hashed(it, k, large[g]), minlength=large[g])
        found = [(g, it, part, int(c)) for (g, it), counts in n.items() for part, c in enumerate(counts)]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=["g", "it", "part", "n"])

    ends: dict[tuple[int, int], np.ndarray] = {}
    if large:
        of_large = rows.filter(F.col("_g").isin(list(large)))
        for r in of_large.mapInArrow(count, "g long, it long, part long, n long").groupBy("g", "it", "part").agg(F.sum("n").alias("n")).collect():
            ends.setdefault((r["g"], r["it"]), np.zeros(large[r["g"]] + 1, dtype=np.int64))[r["part"] + 1] = r["n"]
        ends = {k: np.cumsum(v) for k, v in ends.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range (g, it, part): the x's of its places (from `at` on), the y's that are dealt there and their places."""
        for g, k, vx, vy in _packed(batches):
            out: list[tuple] = []
            steps = np.diff(k, prepend=k[:1])
            runs = [0, *np.flatnonzero(steps > 1).tolist(), len(k)]  # stretches of places without a gap
            for it in range(iterations):
                part = hashed(it, k, large[g]) if g in large else np.zeros(len(k), dtype=np.int64)
                o = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[o], np.arange(large.get(g, 1) + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    of = o[cuts[p] : cuts[p + 1]]
                    d = np.diff(k[of], prepend=k[of[:1]])
                    kind = next(t for t in ("u1", "<u2", "<u4", "<u8") if d.max() <= np.iinfo(t).max)
                    out.append((g, it, int(p), int(k[of[0]]), bytes([int(kind[-1])]) + d.astype(kind).tobytes(), thin(vy[of])))
                for i, j in zip(runs, runs[1:]):
                    bounds = ends[g, it] if g in large else np.array([0, 1 << 62])
                    for p in range(int(np.searchsorted(bounds, k[i] - 1, "right")) - 1, len(bounds) - 1):
                        lo, hi = max(i, i + int(bounds[p] + 1 - k[i])), min(j, i + int(bounds[p + 1] + 1 - k[i]))
                        if lo >= j:
                            break
                        if lo < hi:
                            out.append((g, it, p, int(k[lo] - bounds[p] - 1), None, thin(vx[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["g", "it", "part", "at", "k", "v"])

    def pair(key: tuple, t: pa.Table) -> pa.Table:
        g, it, part = (v.as_py() for v in key)
        ks, ys, xs = [], [], []
        for r in t.select(["at", "k", "v"]).to_pylist():
            if r["k"] is None:
                xs.append((r["at"], thick(r["v"])))
            else:
                ks.append(r["at"] + np.cumsum(np.frombuffer(r["k"], dtype=f"<u{r['k'][0]}", offset=1).astype(np.int64)))
                ys.append(thick(r["v"]))
        k, vy = np.concatenate(ks), np.concatenate(ys)
        vx = np.empty(len(k))
        for at, v in xs:
            vx[at : at + len(v)] = v
        vy = vy[ordered(*md5_words(f"{seed}|{it}|", k), k)]
        both = ~(np.isnan(vx) | np.isnan(vy))
        vx, vy = vx[both], vy[both]
        n = len(vx)
        mx, my = (vx.mean(), vy.mean()) if n else (0.0, 0.0)
        return pa.table({"g": [g], "it": [it], "n": [float(n)], "mx": [mx], "my": [my], "xy": [float((vx - mx) @ (vy - my))], "xx": [float((vx - mx) @ (vx - mx))], "yy": [float((vy - my) @ (vy - my))]})

    dealt = rows.mapInArrow(deal, "g long, it long, part long, at long, k binary, v binary")
    sums = stash(dealt.groupBy("g", "it", "part").applyInArrow(pair, "g long, it long, n double, mx double, my double, xy double, xx double, yy double"))
    whole = sums.groupBy("g", "it").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mx")) / F.nullif(F.sum("n"), F.lit(0.0))).alias("wx"), (F.sum(F.col("n") * F.col("my")) / F.nullif(F.sum("n"), F.lit(0.0))).alias("wy"))
    d = sums.select("g", "it", "mx", "my", "xy", "xx", "yy", F.col("n").alias("m")).join(whole, ["g", "it"])
    off = lambda a, b: F.sum(F.col(a + b) + F.col("m") * (F.col("m" + a) - F.col("w" + a)) * (F.col("m" + b) - F.col("w" + b)))
    d = d.groupBy("g", "it", "n").agg(off("x", "y").alias("xy"), off("x", "x").alias("xx"), off("y", "y").alias("yy"))
    spread = F.sqrt("xx") * F.sqrt("yy")
    r0 = F.when(F.col("n") > 1, F.when(spread > 0, F.col("xy") / F.when(spread > 0, spread)).otherwise(float("nan")))
    null = d.select(F.col("g").alias("_g"), r0.alias("_r0"))
    return null.join(sizes.select(*keys, "_g", F.col("_r").alias("r")), "_g").groupBy(*keys, "r").agg(F.avg((F.col("_r0") >= F.col("r")).cast("double")).alias("p"))


def double_gaussians(theta: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Two bumps a half turn apart for each row of p (pref, sigma, r1, r2, offset), theta in degrees."""
    apart = lambda d: np.abs((d + 180) % 360 - 180)
    pref, sigma, r1, r2, offset = (p[:, i : i + 1] for i in range(5))
    return offset + r1 * np.exp(-(apart(theta - pref) ** 2) / (2 * sigma**2)) + r2 * np.exp(-(apart(theta + 180 - pref) ** 2) / (2 * sigma**2))


def tuning_fits(means: DataFrame, keys: tuple[str, ...], degrees: float) -> DataFrame:
    """keys, pref, sigma, r2, asi, dsi, good, curve of means (keys, config, response): a double Gaussian of each key's curve
    over directions (config times `degrees`), its least taken off and three points put in for each. All keys of an Arrow
    batch are fitted at once. curve has the fit at the configs, in their order; good is false under R squared 0. Keys that
    lack a config of others have no row."""
    n = means.select("config").distinct().count()
    rows = means.filter("response is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("config", "response"))).alias("v")).filter(F.size("v") == n)
    rows = rows.select(*keys, F.transform("v", lambda s: s.config.cast("double")).alias("c"), F.transform("v", lambda s: s.response.cast("double")).alias("v"))
    names = ["pref", "sigma", "r2", "asi", "dsi", "good", "curve"]
    shape = T.StructType([*rows.select(*keys).schema.fields, *(T.StructField(c, T.DoubleType()) for c in names[:5]), T.StructField("good", T.BooleanType()), T.StructField("curve", T.ArrayType(T.DoubleType()))])
    fine = np.arange(0, 360, degrees / 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            theta = b.column("c").flatten().to_numpy().reshape(b.num_rows, n) * degrees
            y = b.column("v").flatten().to_numpy().reshape(b.num_rows, n)
            y = y - y.min(axis=1, keepdims=True)
            v = np.array([np.interp(fine, np.append(t, t[0] + 360), np.append(r, r[0])) for t, r in zip(theta, y)])
            top, high = fine[v.argmax(axis=1)], v.max(axis=1)
            start = np.column_stack([top, np.full(len(v), 30.0), high, high / 2, np.zeros(len(v))])
            low = np.column_stack([top - 90, np.full(len(v), 10.0), *np.zeros((3, len(v)))])
            most = np.column_stack([top + 90, np.full(len(v), 120.0), 3 * high + 1e-9, 3 * high + 1e-9, high + 1e-9])
            p, r2 = N.fit_curves(double_gaussians, fine, v, start, low, most)
            c = double_gaussians(fine, p)
            c = c - c.min(axis=1, keepdims=True)
            t, total = np.radians(fine), c.sum(axis=1)
            vector = lambda k: np.where(total > 0, np.abs((c * np.exp(1j * k * t)).sum(axis=1)) / np.where(total > 0, total, 1), np.nan)  # noqa: E731, B023
            at = double_gaussians(theta, p)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * n, at.ravel())
            columns = [p[:, 0] % 360, p[:, 1], r2, vector(2), vector(1)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *(pa.array(x, mask=np.isnan(x)) for x in columns), pa.array(r2 >= 0), lists], names=[*keys, *names])

    return rows.mapInArrow(run, shape)


def tuning_summary(fits: DataFrame, measured: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, n_good, pref (circular mean), spread (1 less the length of the mean direction), sigma, asi, dsi, r2 (mean),
    combined_r2 of all iterations' good fits (keys, it, ...): combined_r2 is that of the mean fitted curve against the
    measured (keys, config, response), its least taken off."""
    good = fits.filter("good")
    rad = F.radians("pref")
    c, s = F.avg(F.cos(rad)), F.avg(F.sin(rad))
    one = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_good"), F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)).alias("pref"), (1 - F.sqrt(c * c + s * s)).alias("spread"), *[F.avg(x).alias(x) for x in ("sigma", "asi", "dsi", "r2")])
    mean = good.select(*keys, F.posexplode("curve").alias("place", "fit")).groupBy(*keys, "place").agg(F.avg("fit").alias("fit"))
    w = W.partitionBy(*keys)  # a key's configs
    m = measured.select(*keys, "config", "response").withColumns({"place": F.row_number().over(w.orderBy("config")) - 1, "y": F.col("response") - F.min("response").over(w)})
    m = m.withColumn("_mean", F.avg("y").over(w))
    both = m.join(mean, [*keys, "place"]).groupBy(*keys).agg(F.sum((F.col("y") - F.col("fit")) * (F.col("y") - F.col("fit"))).alias("_e"), F.sum((F.col("y") - F.col("_mean")) * (F.col("y") - F.col("_mean"))).alias("_t"))
    return one.join(both, list(keys)).withColumn("combined_r2", F.when(F.col("_t") > 0, 1 - F.col("_e") / F.col("_t"))).drop("_e", "_t")


def split_curves(rows: DataFrame, keys: tuple[str, ...], level: str, anchor, split: str, response: str, shuffled: int, seed: int) -> DataFrame:
    """keys, arousal, labels (own, dealt) and the psychometric curve of the AUC's that tell each level from the anchor level,
    for low and high `split` values; dealt ones are means of `shuffled` iterations. An AUC counts as the share of its
    level's trials that are said to be of the level."""
    levels = rows.select(level).distinct().filter(F.col(level) != F.lit(anchor)).select(F.col(level).alias("_level"))
    own = rows.join(levels, F.col(level) == F.col("_level"))
    base = rows.filter(F.col(level) == F.lit(anchor)).withColumn("_all", F.array_sort(F.array(*[F.lit(r[0]) for r in levels.collect()]))).select("*", F.explode("_all").alias("_level")).drop("_all")  # a row a level
    r = own.unionByName(base)
    a = split_auc(r, (*keys, "_level"), F.col(level) != F.lit(anchor), split, response, shuffled, seed)
    mean = a.groupBy(*keys, "arousal", F.when(F.col("it") == 0, "own").otherwise("dealt").alias("labels"), F.col("_level").alias("level")).agg(F.avg("auc").alias("auc"), F.first("n").alias("n"))
    return psychometric(mean.withColumn("k", F.col("auc") * F.col("n")), (*keys, "arousal", "labels"))


def fits_by_area(fits: dict[str, DataFrame], areas: DataFrame, cell: str, area: str) -> DataFrame:
    """area, fit, param, n_cells, mean, sd, least, most: the parameters of several experiments' fits (name -> cell and
    parameters, each its own) by the area of their cells. Cells without an area go, null parameters don't count."""
    long = [f.unpivot([cell], [c for c in f.columns if c != cell], "param", "value").withColumn("fit", F.lit(name)) for name, f in fits.items()]
    rows = long[0]
    for f in long[1:]:
        rows = rows.unionByName(f)
    met = rows.filter("value is not null").join(areas.select(cell, area).distinct(), cell)
    return met.groupBy(area, "fit", "param").agg(F.count_distinct(cell).alias("n_cells"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


def _run(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Whole traces, and onsets every 25 frames, later for some cells."""
    t = V.traces(spark, sf, False).select("cell", "frame", "value")
    n = t.groupBy("cell").agg(F.max("frame").alias("last"))
    o = n.select("cell", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / 25))).alias("trial"))
    return t, o.select("cell", "trial", (F.col("trial") % 2).alias("config"), (F.col("trial") * 25 + 8 + F.col("cell") % 5).alias("onset"))


def n02_collated(spark, sf):
    return _r(collate(*_run(spark, sf), ("cell",), 6, 10, 20.0))


def n02_labels(spark, sf):
    return labels(collate(*_run(spark, sf), ("cell",), 6, 10, 20.0), ("cell",))


def a16(spark, sf):
    """Two kinds of frames, one without a value, in one store by dataset; what each dataset has."""
    e = V.table(spark, sf, "events").select((F.col("user_id") % 7).alias("dataset"), "event_id", "event_type", "value")
    parts = [e.filter("event_type = 'view'").drop("event_type"), e.filter("event_type = 'purchase'").select("dataset", "event_id", F.lit("purchase").alias("mark"))]
    return _r(grown_store(parts, "dataset").groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.count("mark").alias("n_marks"), F.avg("value").alias("value")))


def a03(spark, sf):
    """The runs of all datasets."""
    rows = V.recordings(spark, sf).groupBy("datakey", F.col("config").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return discovered(rows.select("n", "datakey", "run"), "datakey", "run", "*")


def b13(spark, sf):
    """Cells with over one frame beyond the threshold in any config."""
    return responsive(stats.g03(spark, sf), ("cell",), frames="n_frames", least=1)


def b13_p(spark, sf):
    """Cells whose ROC passes its shuffles."""
    return responsive(stats.g02(spark, sf), ("cell",), p="p", most=0.3)


def c13(spark, sf):
    """Customers as datasets: orders as neural trials, lines of 25 or more as pupil trials."""
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset"), F.col("o_orderkey").alias("trial"), "o_totalprice")
    p = V.table(spark, sf, "lineitem").filter("l_quantity >= 25").select(F.col("l_orderkey").alias("trial")).distinct().join(o, "trial")
    return valid_datasets(o.filter("o_totalprice > 100000"), p, "dataset", "trial", 3)


def e33(spark, sf):
    """A bar's position (a value of views) at purchases, by user."""
    e = V.table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), "event_type", (V.micros("ts") / 1e6).alias("t"), F.col("value").alias("position"))
    return _r(interpolated(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ("user_id",), ("position",)).select("user_id", "id", "position"))


def h10(spark, sf):
    """Files of three frames and slices of half the image, against the mean of all."""
    g = V.grid(spark, sf, 16).select(F.floor(F.col("y") / 8).alias("slice"), F.floor(F.col("frame") / 3).alias("file"), "y", "x", "value")
    return _r(image_quality(g, ("slice",), "file", 1.5))


def h11(spark, sf):
    """Frames against the first one; bad beyond four deviations."""
    return _r(image_quality(V.grid(spark, sf, 16).select("frame", "y", "x", "value"), (), "frame", 4.0, F.col("frame") == 0))


def e19(spark, sf):
    """Trials of runs numbered through."""
    t = V.recordings(spark, sf).select("datakey", "config", "trial").distinct()
    return numbered_within(t, ("datakey",), ("config", "trial"), "number")


def e23(spark, sf):
    c = V.recordings(spark, sf).select("area", "datakey", "cell").distinct()
    return numbered_within(c, ("area",), ("datakey", "cell"), "_n").select("area", "datakey", "cell", V.long(F.col("_n") - 1).alias("global_ix"))


def g14(spark, sf):
    """Pearson r of each dataset with the share of shuffles (values dealt anew in seeded order) that reach it."""
    return _r(correlation_null(V.recordings(spark, sf), ("datakey",), "quantity", "response", ("trial", "cell", "quantity", "response"), 10, 2))


def i01(spark, sf):
    """A hundred bootstrap iterations of each cell's direction tuning."""
    return _r(tuning_fits(bootstrap_means(V.responses(spark, sf), 20, 100, 8), ("cell", "it"), 36.0).drop("curve"))


def n12(spark, sf):
    """The iterations of each cell in one: mean parameters, mean curve's R squared."""
    r = V.responses(spark, sf)
    fits = tuning_fits(bootstrap_means(r, 20, 100, 8), ("cell", "it"), 36.0)
    return _r(tuning_summary(stash(fits), r.groupBy("cell", "config").agg(F.avg("response").alias("response")), ("cell",)))


def n13(spark, sf):
    """Slopes over quantity, selectivity over configs and correlations of each cell, in one table by area."""
    r = V.recordings(spark, sf)
    means = r.groupBy("cell", "config").agg(F.avg("response").alias("m")).groupBy("cell").agg(F.max("m").alias("hi"), F.min("m").alias("lo"))
    fits = {
        "objects": r.groupBy("cell").agg(F.regr_slope("response", "quantity").alias("slope"), F.regr_intercept("response", "quantity").alias("shift")),
        "gratings": means.select("cell", ((F.col("hi") - F.col("lo")) / (F.col("hi") + F.col("lo"))).alias("selectivity")),
        "fields": r.groupBy("cell").agg(F.corr("quantity", "response").alias("r")),
    }
    return _r(fits_by_area(fits, r.select("cell", "area"), "cell", "area"))


def n19(spark, sf):
    """Curves of the AUC of each config over config 1, for low and high quantities, own and dealt labels."""
    r = V.recordings(spark, sf).select("area", "config", "quantity", "response", F.concat_ws("|", "trial", "cell").alias("unit"))
    return _r(split_curves(r, ("area",), "config", 1, "quantity", "response", 3, 17))


_RUN = f"{V.TRACE}, f AS (SELECT cell, frame, value FROM trall), o AS (SELECT cell, trial, trial % 2 AS config, trial * 25 + 8 + cell % 5 AS onset FROM (SELECT cell, unnest(range(0, max(frame) // 25 + 1)) AS trial FROM f GROUP BY cell)), m AS (SELECT f.cell, trial, config, frame - onset AS k, value FROM o JOIN f ON f.cell = o.cell AND frame BETWEEN onset - 6 AND onset + 9), c AS (SELECT *, count(value) OVER w AS n, avg(value) FILTER (k < 0) OVER w AS f0 FROM m WINDOW w AS (PARTITION BY cell, trial))"
_QUALITY = "p AS (SELECT {w}{u}, y, x, avg(value) AS v FROM g GROUP BY ALL), q AS (SELECT {w}y, x, avg(value) AS ref FROM g {f} GROUP BY ALL), r AS (SELECT {w}{u}, corr(v, ref) AS r, count(*) AS n FROM p JOIN q USING ({w}y, x) GROUP BY ALL) SELECT {w}{u}, round(r, 6) AS r, n, coalesce(stddev_pop(r) OVER w > 0 AND round(abs(r - avg(r) OVER w), 9) >= round({d} * stddev_pop(r) OVER w, 9), false) AS bad FROM r WINDOW w AS ({p})"
_G16 = "g AS (SELECT (o_orderkey // 16) % 16 AS y, o_orderkey % 16 AS x, o_orderkey // 256 AS frame, o_totalprice AS value FROM orders)"
QUERIES = {
    "n02_collated": n02_collated, "n02_labels": n02_labels, "a16_grown_store": a16, "a03_runs": a03, "b13_responsive": b13, "b13_responsive_p": b13_p, "c13_valid_datasets": c13, "e33_bar_position": e33, "h10_file_quality": h10, "h11_frame_quality": h11,
    "e19_trial_numbers": e19, "e23_global_index": e23, "g14_correlation_null": g14, "i01_orientation_fits": i01, "n12_tuning_summary": n12, "n13_fits_by_area": n13, "n19_split_curves": n19,
}
SQL = {
    "n02_collated": f"WITH {_RUN} SELECT cell, trial, config, k + 6 AS frame_ix, round(k / 20, 6) AS tsec, round(value, 6) AS raw, round(f0, 6) AS f0, round(CASE WHEN f0 > 0 THEN (value - f0) / f0 END, 6) AS dff FROM c WHERE n = 16",
    "n02_labels": f"WITH {_RUN} SELECT cell, config, count(DISTINCT trial) AS n_trials, count(*) AS n_frames FROM c WHERE n = 16 GROUP BY cell, config",
    "a16_grown_store": "SELECT user_id % 7 AS dataset, count(*) AS n, count(value) FILTER (event_type = 'view') AS n_values, count(*) FILTER (event_type = 'purchase') AS n_marks, round(avg(value) FILTER (event_type = 'view'), 6) AS value FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1",
    "a03_runs": f"WITH {V.REC} SELECT DISTINCT datakey, config AS run FROM rec",
    "b13_responsive": f"SELECT cell, max(n_frames) AS n FROM ({stats.SQL['g03_frames_beyond']}) GROUP BY cell HAVING max(n_frames) > 1",
    "b13_responsive_p": f"SELECT DISTINCT cell FROM ({stats.SQL['g02_roc_null']}) WHERE p < 0.3",
    "c13_valid_datasets": "WITH a AS (SELECT o_custkey AS dataset, o_orderkey AS trial FROM orders WHERE o_totalprice > 100000), b AS (SELECT DISTINCT o_custkey AS dataset, o_orderkey AS trial FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 25) SELECT dataset, count(a.trial) AS n_neural, count(b.trial) AS n_pupil, count(*) FILTER (a.trial IS NOT NULL AND b.trial IS NOT NULL) AS n_both FROM a FULL JOIN b USING (dataset, trial) GROUP BY dataset HAVING n_both >= 3",
    "e33_bar_position": "WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL), a AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'purchase'), l AS (SELECT a.*, s.t AS ta, s.v AS va FROM a ASOF LEFT JOIN s ON a.user_id = s.user_id AND a.t >= s.t), r AS (SELECT l.*, s.t AS tb, s.v AS vb FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t <= s.t) SELECT user_id, event_id AS id, round(va + CASE WHEN tb > ta THEN (t - ta) / (tb - ta) WHEN tb = ta THEN 0 END * (vb - va), 6) AS position FROM r",
    "h10_file_quality": f"WITH {_G16.replace('g AS', 'g0 AS')}, g AS (SELECT y // 8 AS slice, frame // 3 AS file, y, x, value FROM g0), {_QUALITY.format(w='slice, ', u='file', f='', d=1.5, p='PARTITION BY slice')}",
    "h11_frame_quality": f"WITH {_G16}, {_QUALITY.format(w='', u='frame', f='WHERE frame = 0', d=4.0, p='')}",
    "g14_correlation_null": f"WITH {V.REC}, a AS (SELECT datakey, quantity, response, row_number() OVER (PARTITION BY datakey ORDER BY trial, cell, quantity, response) AS k FROM rec), s AS (SELECT datakey, it, response, row_number() OVER (PARTITION BY datakey, it ORDER BY md5('2|' || it || '|' || k), k) AS k FROM a, range(10) t(it)), n AS (SELECT s.datakey, it, corr(a.quantity, s.response) AS r0 FROM s JOIN a ON a.datakey = s.datakey AND a.k = s.k GROUP BY ALL), t AS (SELECT datakey, corr(quantity, response) AS r FROM a GROUP BY datakey) SELECT datakey, round(r, 6) AS r, round(avg(CAST(r0 >= r AS INT)), 6) AS p FROM n JOIN t USING (datakey) GROUP BY datakey, r",
    "e19_trial_numbers": f"WITH {V.REC}, t AS (SELECT DISTINCT datakey, config, trial FROM rec) SELECT datakey, config, trial, row_number() OVER (PARTITION BY datakey ORDER BY config, trial) AS number FROM t",
    "e23_global_index": f"WITH {V.REC}, c AS (SELECT DISTINCT area, datakey, cell FROM rec) SELECT *, row_number() OVER (PARTITION BY area ORDER BY datakey, cell) - 1 AS global_ix FROM c",
    "n13_fits_by_area": f"WITH {V.REC}, o AS (SELECT cell, regr_slope(response, quantity) AS slope, regr_intercept(response, quantity) AS shift, corr(quantity, response) AS r FROM rec GROUP BY cell), g AS (SELECT cell, (max(m) - min(m)) / (max(m) + min(m)) AS s FROM (SELECT cell, config, avg(response) AS m FROM rec GROUP BY ALL) GROUP BY cell), f AS (SELECT cell, 'objects' AS fit, 'slope' AS param, slope AS v FROM o UNION ALL SELECT cell, 'objects', 'shift', shift FROM o UNION ALL SELECT cell, 'gratings', 'selectivity', s FROM g UNION ALL SELECT cell, 'fields', 'r', r FROM o) SELECT area, fit, param, count(DISTINCT cell) AS n_cells, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most FROM f JOIN (SELECT DISTINCT cell, area FROM rec) a USING (cell) WHERE v IS NOT NULL GROUP BY ALL",
}
