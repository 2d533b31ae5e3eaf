"""Linear machines over trials that stay distributed: many machines are fitted together, by passes over the trials.

A machine is a linear support vector machine on the squared hinge: it minimizes |w|^2 / 2 + C sum max(0, 1 - y w.z)^2 over
its own training trials, z standardized by them, the shift one of w. With the trials that are within the margin known, w
solves normal equations, so a pass lets Spark sum these (number, sums, products of features) for all machines at once,
and each machine is solved where its sums meet. Passes end when no machine moves; a machine that a step makes worse goes
half as far. No group holds trials, and the driver holds weights only. Features: MAX_FEATURES at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perievent.operators.joins import seeded_order
from perievent.operators.metrics import _rounded as _r
from perievent.operators.models import _two, vectors
from perievent.plans import order
from perievent.plans import views as V
from perievent.plans.stash import stash

MAX_FEATURES = 4096
#: Numbers in one pass's sums, of all its machines, at most.
SUMS = 1 << 24
#: C's that cross-validation chooses from.
PATH = (0.001, 0.01, 0.1, 1.0)


@dataclass(frozen=True)
class Machine:
    """Which class is told from the others, and what it is trained on: ranks low to high (end exclusive) of an iteration's
    balanced order, without those of a fold (rank % folds), of one group or all, dealt labels or the own ones."""

    it: int
    positive: int
    low: int
    high: int
    c: float
    fold: int = -1
    folds: int = 5
    group: int = -1
    twin: bool = False
    features: tuple[int, ...] = ()  # all, if none are named

    def trains(self, rank: np.ndarray, group: np.ndarray) -> np.ndarray:
        ok = (rank >= self.low) & (rank < self.high)
        if self.fold >= 0:
            ok &= rank % self.folds != self.fold
        return ok & (group == self.group) if self.group >= 0 else ok


@dataclass(frozen=True)
class Dealt:
    """Trials (x, y: class code, part: group, ranks and twins: of each iteration) with their classes and how many trials
    of each class an iteration takes."""

    rows: DataFrame
    classes: list
    least: dict[int, int]
    features: int


def dealt(trials: DataFrame, iterations: int, seed: int, classes: list | None = None) -> Dealt:
    """Trials (trial, config, x, and part if they have one) in balanced seeded orders: in each iteration a trial has a rank
    within its config, -1 beyond what the rarest config has, and a dealt label, which comes as often as its own does.
    Ranks come from a global order in range slices, so no task holds a config's trials. Trials without a config or x go."""
    trials = stash(trials.filter("config is not null and x is not null").select("trial", "config", "x", *(["part"] if "part" in trials.columns else [F.lit(0).alias("part")])))
    classes = classes or sorted(r["config"] for r in trials.select("config").distinct().collect())  # a row a class
    code = F.coalesce(*[F.when(F.col("config") == F.lit(c), F.lit(i)) for i, c in enumerate(classes)]) if classes else F.lit(None).cast("int")
    own = trials.select("trial", code.alias("y")).filter("y is not null")
    many = own.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    many = many.withColumns({"_k": seeded_order(seed, "it", "trial"), "_j": seeded_order(seed + 1, "it", "trial")})
    placed = order.numbered(many, [F.col(c) for c in ("it", "y", "_k", "trial")], "_at")
    first = stash(placed.groupBy("it", "y").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("n")))
    least = first.groupBy("it").agg(F.min("n").alias("least"))
    kept = placed.join(first.join(least, "it"), ["it", "y"]).withColumn("rank", (F.col("_at") - F.col("_first")).cast("int")).filter("rank < least").select("it", "trial", "_j", "rank", "least")
    again = order.numbered(kept, [F.col(c) for c in ("it", "_j", "trial")], "_at")
    # An iteration has least trials of each class, so its orders end at known places.
    sizes = {r["it"]: int(r["least"]) for r in least.orderBy("it").collect()}  # a row an iteration
    starts = np.concatenate([[0], np.cumsum([sizes.get(i, 0) * len(classes) for i in range(iterations)])[:-1]]).astype(int).tolist() if sizes else [0] * iterations
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("it") + 1)
    twin = F.floor((F.col("_at") - 1 - start) / F.col("least")).cast("int")
    roles = again.select("trial", "it", "rank", twin.alias("twin")).groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("it", F.struct("rank", "twin").alias("s")))).alias("m"))
    each = F.sequence(F.lit(0), F.lit(iterations - 1))
    of = lambda c: F.transform(each, lambda i: F.coalesce(F.try_element_at("m", i)[c], F.lit(-1)))
    rows = stash(trials.join(own, "trial").join(roles, "trial").select("x", "y", F.col("part").cast("int").alias("part"), of("rank").alias("ranks"), of("twin").alias("twins")))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if width > MAX_FEATURES:
        raise ValueError(f"{width} features; {MAX_FEATURES} at most")
    return Dealt(rows, list(classes), sizes, width)


def _matrix(column, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _arrays(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    n = len(b.column(3)[0]) if b.num_rows else 0
    return _matrix(b.column(0), width, float), b.column(1).to_numpy().astype(int), b.column(2).to_numpy().astype(int), _matrix(b.column(3), n, int), _matrix(b.column(4), n, int)


class _State:
    """What the passes know of each machine: weights in the features as they are (the shift last), the step before, its
    loss, means and deviations of the training trials."""

    def __init__(self, machines: list[Machine], width: int):
        m = len(machines)
        self.machines, self.width = machines, width
        self.w, self.was, self.loss = np.zeros((m, width + 1)), np.zeros((m, width + 1)), np.full(m, np.inf)
        self.mean, self.sd, self.open, self.both = np.zeros((m, width)), np.ones((m, width)), np.ones(m, dtype=bool), np.ones(m, dtype=bool)
        self.used = np.array([np.isin(np.arange(width), x.features) if x.features else np.ones(width, dtype=bool) for x in machines]).reshape(m, width)


def _moments(x: np.ndarray, y: np.ndarray, loss: float) -> np.ndarray:
    """n, sum y, loss, sums of x and xy, upper half of x'x."""
    return np.concatenate([[len(y), y.sum(), loss], x.sum(axis=0), x.T @ y, (x.T @ x)[np.triu_indices(x.shape[1])]])


def _pass(rows: DataFrame, s: _State, which: np.ndarray, first: bool, centre: np.ndarray, scale: np.ndarray) -> None:
    """One pass over the trials for the machines `which`."""
    machines, w, width = s.machines, s.w, s.width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, part, ranks, twins = _arrays(b, width)
            margin = x @ w[which, :-1].T + w[which, -1]
            z = (x - centre) / scale
            for k, m in enumerate(which):
                mac = machines[m]
                label = np.where((twins[:, mac.it] if mac.twin else y) == mac.positive, 1.0, -1.0)
                gap = 1 - label * margin[:, k]
                ok = mac.trains(ranks[:, mac.it], part) & (gap > 0)
                if ok.any():
                    found = _moments(z[ok], label[ok], float((gap[ok] ** 2).sum()))
                    total[m] = total[m] + found if m in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["m", "sums"])

    mean0, sd0, was, loss0, used = s.mean, s.sd, s.was, s.loss, s.used

    def solved(m: int, v: np.ndarray) -> list[np.ndarray]:
        """New weights, loss, mean and deviation, whether both classes are there: of machine m's sums."""
        mac, d = machines[m], width
        n, sy, gaps = v[:3]
        s1, sxy = v[3 : 3 + d], v[3 + d : 3 + 2 * d]
        s2 = np.zeros((d, d))
        s2[np.triu_indices(d)] = v[3 + 2 * d :]
        s2 = s2 + np.triu(s2, 1).T
        mean, sd = mean0[m], sd0[m]
        if first:
            mean = s1 / n
            sd = np.sqrt(np.maximum(np.diag(s2) / n - mean * mean, 0))
            sd = np.where(sd > 1e-9 * (1 + np.abs(mean)), sd, 1.0)
        own = np.where(used[m], 1 / sd, 0.0)  # features that aren't used stay at zero
        a = (s2 - np.outer(mean, s1) - np.outer(s1, mean) + n * np.outer(mean, mean)) * np.outer(own, own)
        edge, top = (s1 - n * mean) * own, (sxy - sy * mean) * own
        lhs = np.block([[a, edge[:, None]], [edge[None, :], np.array([[n]])]]) * 2 * mac.c + np.eye(d + 1)
        z = np.linalg.solve(lhs, 2 * mac.c * np.append(top, sy))
        # back to features as they are
        raw = z[:-1] * own / scale
        new = np.append(raw, z[-1] - (z[:-1] * own) @ mean - raw @ centre)
        held = w[m, :-1] * scale / own.clip(1e-300) * used[m]
        shift = w[m, -1] + w[m, :-1] @ centre + (w[m, :-1] * scale) @ mean
        loss = 0.5 * (held @ held + shift * shift) + mac.c * gaps
        return [new, np.array([loss]), mean, sd, np.array([float(abs(sy) < n)])]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        out = lambda m, v: pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([np.concatenate(solved(m, v)).tobytes()], pa.binary())], names=["m", "sums"])
        for b in batches:
            for m, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.frombuffer(v)
                if m == now:
                    total = total + v
                else:
                    if now is not None:
                        yield out(now, total)
                    now, total = m, v
        if now is not None:
            yield out(now, total)

    # Partial sums of one task in a row a machine; with many tasks they meet in two steps.
    shape = "m int, sums binary"
    part = rows.select("x", "y", "part", "ranks", "twins").mapInArrow(sums, shape)
    found = part.repartition("m").sortWithinPartitions("m").mapInArrow(reduce, shape)
    told = np.zeros(len(machines), dtype=bool)
    for r in found.toLocalIterator():
        m, v, d = r["m"], np.frombuffer(r["sums"]), width
        told[m] = True
        new, loss, mean, sd, both = v[: d + 1], v[d + 1], v[d + 2 : 2 * d + 2], v[2 * d + 2 : 3 * d + 2], v[-1]
        if first:
            s.mean[m], s.sd[m], s.both[m] = mean, sd, bool(both)
            if not both:
                s.open[m] = False
                continue
        if loss > s.loss[m] * (1 + 1e-12):  # the step went too far
            s.w[m] = (s.w[m] + s.was[m]) / 2
            if np.abs(s.w[m] - s.was[m]).max() <= 1e-10 * (1e-12 + np.abs(s.was[m]).max()):
                s.open[m] = False
            continue
        s.was[m], s.loss[m] = s.w[m], loss
        s.open[m] = np.abs(new - s.w[m]).max() > 1e-9 * max(1e-12, np.abs(new).max())
        s.w[m] = new
    for m in which:
        if not told[m]:  # no trial is within the margin: only the weights' own size is left, or there is no trial
            s.open[m] = False
            if first:
                s.both[m] = False


def fitted(d: Dealt, machines: list[Machine], rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the shift last) of each machine in the features as they are, and whether it had both classes to learn."""
    s = _State(machines, d.features)
    if not machines or not d.features or not d.least:
        return s.w, np.zeros(len(machines), dtype=bool)
    width = d.features
    at = F.posexplode("x").alias("i", "v")
    stats = {r["i"]: r for r in d.rows.select(at).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}  # a row a feature
    centre = np.array([stats[i]["m"] for i in range(width)])
    scale = np.array([stats[i]["s"] or 1.0 for i in range(width)])
    block = max(1, SUMS // (3 + 2 * width + width * (width + 1) // 2))
    for low in range(0, len(machines), block):
        which = np.arange(low, min(low + block, len(machines)))
        for turn in range(rounds):
            _pass(d.rows, s, which, turn == 0, centre, scale)
            which = which[s.open[which]]
            if not len(which):
                break
    return s.w, s.both


def told(d: Dealt, machines: list[list[Machine]], weights: list[np.ndarray], tests: list[tuple[int, int, int]]) -> pd.DataFrame:
    """machine, part, true, said, n: trials of each machine's tests (low, high, fold: ranks of its iteration, of one fold
    or all) by their class and the one that is said. A machine is a list with one member a class, or one that tells class
    1 from class 0."""
    flat = np.concatenate(weights) if weights else np.zeros((0, d.features + 1))
    ends = np.cumsum([len(x) for x in machines])
    width, classes = d.features, len(d.classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, int, int], int] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, part, ranks, twins = _arrays(b, width)
            margin = x @ flat[:, :-1].T + flat[:, -1]
            for k, (group, (low, high, fold)) in enumerate(zip(machines, tests)):
                rank = ranks[:, group[0].it]
                ok = (rank >= low) & (rank < high)
                if fold >= 0:
                    ok &= rank % group[0].folds == fold
                if not ok.any():
                    continue
                own = margin[ok, ends[k] - len(group) : ends[k]]
                said = (own[:, 0] > 0).astype(int) if len(group) == 1 else np.array([m.positive for m in group])[own.argmax(axis=1)]
                true = (twins[:, group[0].it] if group[0].twin else y)[ok]
                code, n = np.unique((part[ok] * classes + true) * classes + said, return_counts=True)
                for c, times in zip(code.tolist(), n.tolist()):
                    key = (k, c // classes // classes, c // classes % classes, c % classes)
                    counts[key] = counts.get(key, 0) + times
        columns = [pa.array([k[i] for k in counts], pa.int32()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["machine", "part", "true", "said", "n"])

    found = d.rows.select("x", "y", "part", "ranks", "twins").mapInArrow(run, "machine int, part int, true int, said int, n long")
    return found.groupBy("machine", "part", "true", "said").agg(F.sum("n").alias("n")).toPandas()  # at most classes squared a machine and part


def score_of(c: pd.DataFrame) -> float:
    return float(c.n[c.true == c.said].sum() / c.n.sum()) if len(c) else float("nan")


def information_of(c: pd.DataFrame) -> float:
    """Bits that what is said tells about the class."""
    p = c.groupby(["true", "said"]).n.sum() / c.n.sum()
    a, b = p.groupby("true").sum(), p.groupby("said").sum()
    return float(sum(v * np.log2(v / (a[t] * b[s])) for (t, s), v in p.items()))


def machine_of(it: int, classes: int, **rest) -> list[Machine]:
    return [Machine(it=it, positive=k, **rest) for k in ([1] if classes == 2 else range(classes))]


def fit_all(d: Dealt, groups: list[list[Machine]]) -> tuple[list[np.ndarray], list[bool]]:
    w, both = fitted(d, [m for g in groups for m in g])
    ends = np.cumsum([len(g) for g in groups]) if groups else []
    return [w[e - len(g) : e] for e, g in zip(ends, groups)], [bool(both[e - len(g) : e].all()) for e, g in zip(ends, groups)]


def chosen(d: Dealt, spans: dict[int, tuple[int, int]], path: tuple[float, ...], folds: int, twin: bool = False, features: tuple[int, ...] = ()) -> dict[int, float]:
    """The C of each iteration that cross-validation over the folds of its training ranks scores best, the smallest on
    ties. All iterations, folds and C's are fitted together."""
    if len(path) == 1:
        return dict.fromkeys(spans, path[0])
    keys = [(it, c, f) for it in spans for c in path for f in range(folds)]
    groups = [machine_of(it, len(d.classes), low=spans[it][0], high=spans[it][1], c=c, fold=f, folds=folds, twin=twin, features=features) for it, c, f in keys]
    w, _ = fit_all(d, groups)
    counts = told(d, groups, w, [(*spans[it], f) for it, _, f in keys])
    score = counts[counts.true == counts.said].groupby("machine").n.sum()
    out = {}
    for it in spans:
        rate = {c: sum(score.get(k, 0) for k, key in enumerate(keys) if key[:2] == (it, c)) for c in path}
        out[it] = min(c for c in path if rate[c] == max(rate.values()))
    return out


def decode(trials: DataFrame, iterations: int, seed: int, held_out: float = 0.2, path: tuple[float, ...] = PATH, folds: int = 5, feature_sets: dict | None = None) -> pd.DataFrame:
    """it, condition (data; shuffled: dealt labels at the same C), c, score, mi (bits between class and what is said),
    n_test, and `features`, a set's name: trials (trial, config, x) of two or more configs, in equal numbers, held_out of
    them tested. feature_sets: name -> the features used (default: all)."""
    d = dealt(trials, iterations, seed)
    cut = {it: int(np.ceil(n * held_out)) for it, n in d.least.items()}
    sets = feature_sets or {None: ()}
    keys, groups = [], []
    for name, features in sets.items():
        best = chosen(d, {it: (cut[it], n) for it, n in d.least.items()}, path, folds, features=features)
        for it, n in d.least.items():
            for twin in (False, True):
                keys.append((name, it, "shuffled" if twin else "data", best[it]))
                groups.append(machine_of(it, len(d.classes), low=cut[it], high=n, c=best[it], twin=twin, features=features))
    w, both = fit_all(d, groups)
    counts = told(d, groups, w, [(0, cut[key[1]], -1) for key in keys])
    out = []
    for k, (name, it, condition, c) in enumerate(keys):
        own = counts[counts.machine == k]
        ok = both[k] and len(own)
        out.append((name, it, condition, c, score_of(own) if ok else None, information_of(own) if ok else None, int(own.n.sum())))
    return pd.DataFrame(out, columns=["features", "it", "condition", "c", "score", "mi", "n_test"])


def permutation_test(trials: DataFrame, permutations: int = 500, seed: int = 0, c: float = 0.1, folds: int = 5) -> dict:
    """score (cross-validated), p (the share of permutations, the data among them, that reach it), n: all permutations'
    folds are fitted in the same passes."""
    d = dealt(trials, permutations + 1, seed)
    keys = [(it, f) for it in d.least for f in range(folds)]
    # Iteration 0 has the own labels; the others dealt ones.
    groups = [machine_of(it, len(d.classes), low=0, high=d.least[it], c=c, fold=f, folds=folds, twin=it > 0) for it, f in keys]
    w, _ = fit_all(d, groups)
    counts = told(d, groups, w, [(0, d.least[it], f) for it, f in keys])
    counts["it"] = counts.machine // folds
    right = counts[counts.true == counts.said].groupby("it").n.sum()
    score = (right.reindex(range(len(d.least)), fill_value=0) / counts.groupby("it").n.sum()).to_numpy()
    return {"score": float(score[0]), "p": float((1 + (score[1:] >= score[0]).sum()) / len(score)), "n": permutations}


def grouped_classes(df: DataFrame, config: str, classes: dict, null: object = None) -> DataFrame:
    """df with config replaced by its class (config -> class); configs of no class take `null`, or go if that is None."""
    pairs = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    found = F.try_element_at(pairs, F.col(config))
    return df.withColumn(config, F.coalesce(found, F.lit(null)) if null is not None else found).filter(F.col(config).isNotNull())


def confusion(trials: DataFrame, sizes: tuple[int, ...], iterations: int, seed: int, c: float = 0.1, n_test: int = 4) -> pd.DataFrame:
    """n_train, true, said, mean, sd, n: confusion matrices with rows of sum one, averaged over iterations, of machines
    that are trained on n_train trials of each class and tested on n_test others. SD is over iterations (n - 1). A size
    that the rarest class hasn't enough trials for is left out."""
    d = dealt(trials, iterations, seed)
    keys = [(s, it) for s in sizes for it, n in d.least.items() if s + n_test <= n]
    groups = [machine_of(it, len(d.classes), low=n_test, high=n_test + s, c=c) for s, it in keys]
    w, _ = fit_all(d, groups)
    counts = told(d, groups, w, [(0, n_test, -1)] * len(keys))
    out = []
    for s in sizes:
        of = [k for k, key in enumerate(keys) if key[0] == s]
        if not of:
            continue
        m = np.zeros((len(of), len(d.classes), len(d.classes)))
        for r in counts[counts.machine.isin(of)].itertuples():
            m[of.index(r.machine), r.true, r.said] += r.n
        m /= np.maximum(m.sum(axis=2, keepdims=True), 1)
        mean, sd = m.mean(axis=0), m.std(axis=0, ddof=1) if len(of) > 1 else np.full(m.shape[1:], np.nan)
        out += [(s, d.classes[i], d.classes[j], mean[i, j], sd[i, j], len(of)) for i in range(len(d.classes)) for j in range(len(d.classes))]
    return pd.DataFrame(out, columns=["n_train", "true", "said", "mean", "sd", "n"])


def generalize(trials: DataFrame, seed: int, path: tuple[float, ...] = (0.1,)) -> pd.DataFrame:
    """train, test (values of part), novel, score, n: machines trained on the trials of one part, each tested on all, its
    own training trials among them."""
    d = dealt(trials, 1, seed)
    parts = sorted(r["part"] for r in d.rows.select("part").distinct().collect())  # a row a part
    high = d.least.get(0, 0)
    groups = [machine_of(0, len(d.classes), low=0, high=high, c=path[0], group=p) for p in parts]
    w, both = fit_all(d, groups)
    counts = told(d, groups, w, [(0, high, -1)] * len(groups))
    out = [(p, q, p != q, score_of(own) if both[k] else None, int(own.n.sum())) for k, p in enumerate(parts) for q in parts if len(own := counts[(counts.machine == k) & (counts.part == q)])]
    return pd.DataFrame(out, columns=["train", "test", "novel", "score", "n"])


def eliminate(trials: DataFrame, folds: int, seed: int, c: float = 0.1) -> pd.DataFrame:
    """fold, n_features, score: in each fold the quarter of features with the smallest weights (standardized) leaves, until
    one is left. A size's machines of all folds are fitted together."""
    d = dealt(trials, 1, seed)
    high, left, out = d.least.get(0, 0), [tuple(range(d.features))] * folds, []
    sd = {r["i"]: r["s"] for r in d.rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).collect()}
    while left and len(left[0]):
        groups = [machine_of(0, len(d.classes), low=0, high=high, c=c, fold=f, folds=folds, features=x) for f, x in enumerate(left)]
        w, both = fit_all(d, groups)
        counts = told(d, groups, w, [(0, high, f) for f in range(folds)])
        out += [(f, len(x), score_of(counts[counts.machine == f]) if both[f] else None) for f, x in enumerate(left)]
        size = [np.abs(v[:, list(x)] * np.array([sd[i] for i in x])).max(axis=0) for v, x in zip(w, left)]
        left = [tuple(sorted(np.array(x)[np.argsort(-v, kind="stable")[: len(x) * 3 // 4]].tolist())) for v, x in zip(size, left)]
    return pd.DataFrame(out, columns=["fold", "n_features", "score"])


def ridge_folds(trials: DataFrame, folds: int, alpha: float) -> pd.DataFrame:
    """fold, r, r2: the number `config` from x by ridge regression, tested on the fold left out. Spark sums each fold's
    normal equations; a fold's machine comes from all sums less its own, its predictions' moments from its own sums."""
    t = trials.filter("config is not null and x is not null").select("x", F.col("config").cast("double").alias("y"), F.pmod(F.xxhash64("trial"), F.lit(folds)).cast("int").alias("fold"))
    width = t.agg(F.max(F.size("x"))).first()[0] or 0
    mean = t.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.avg("y").alias("y")).collect()  # a row a feature
    centre = np.zeros(width + 1)
    for r in mean:
        centre[r["i"]], centre[-1] = r["m"], r["y"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            z = np.column_stack([_matrix(b.column(0), width, float), b.column(1).to_numpy()]) - centre
            z = np.column_stack([z, np.ones(len(z))])
            for f in np.unique(fold := b.column(2).to_numpy()):
                total[int(f)] = total.get(int(f), 0) + z[fold == f].T @ z[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fold", "sums"])

    moments: dict[int, np.ndarray] = {}
    for r in t.mapInArrow(sums, "fold int, sums binary").toLocalIterator():  # a row a task and fold
        moments[r["fold"]] = moments.get(r["fold"], 0) + np.frombuffer(r["sums"]).reshape(width + 2, width + 2)
    out, everything = [], sum(moments.values())
    for f, own in sorted(moments.items()):
        m = everything - own
        n = m[-1, -1]
        if n < 1:
            continue
        mu = m[:-1, -1] / n
        cov = m[:-1, :-1] - n * np.outer(mu, mu)
        w = np.linalg.solve(cov[:-1, :-1] + alpha * np.eye(width), cov[:-1, -1])
        k, nu = own[-1, -1], own[:-1, -1] / own[-1, -1]
        test = own[:-1, :-1] - k * np.outer(nu, nu)
        spread, along, total = w @ test[:-1, :-1] @ w, w @ test[:-1, -1], test[-1, -1]
        shift = (nu[-1] - mu[-1]) - w @ (nu[:-1] - mu[:-1])  # mean residual
        error = total - 2 * along + spread + k * shift * shift
        out.append((f, along / np.sqrt(spread * total) if spread > 0 and total > 0 else None, 1 - error / total if total > 0 else None))
    return pd.DataFrame(out, columns=["fold", "r", "r2"])


def _frame(spark, rows: pd.DataFrame, shape: str) -> DataFrame:
    return _r(spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in rows.itertuples(index=False)], shape))


def i13(spark, sf):
    """Two configs told apart: balanced, a fifth tested, C by cross-validation, bits, and the twin with dealt labels."""
    return _frame(spark, decode(vectors(_two(spark, sf)), 20, 2).drop(columns="features"), "it int, condition string, c double, score double, mi double, n_test long")


def i14(spark, sf):
    """Decoding with 4, 16 and 48 cells, picked in seeded order anew in each of three draws."""
    v = vectors(_two(spark, sf))
    cells = [r["cell"] for r in _two(spark, sf).select("cell").distinct().orderBy("cell").collect()]  # the vectors' features
    sets = {}
    for n in (4, 16, 48):
        for draw in range(3):
            sets[f"{n}/{draw}"] = tuple(np.random.default_rng([n, draw]).permutation(len(cells))[:n].tolist())
    found = decode(v, 4, 3, path=(0.1,), feature_sets=sets)
    found.insert(0, "n_cells", [int(x.split("/")[0]) for x in found.features])
    found["features"] = [int(x.split("/")[1]) for x in found.features]
    return _frame(spark, found.rename(columns={"features": "draw"}), "n_cells int, draw int, it int, condition string, c double, score double, mi double, n_test long")


def i16(spark, sf):
    """Train on one third of trials (a transform), test on each: scores by pair of transforms."""
    v = vectors(_two(spark, sf)).withColumn("part", (F.col("trial") % 3).cast("int"))
    return _frame(spark, generalize(v, 5), "train int, test int, novel boolean, score double, n long")


def i21(spark, sf):
    return _frame(spark, eliminate(vectors(_two(spark, sf)), 4, 6), "fold int, n_features int, score double")


def i22(spark, sf):
    """Configs told apart from the trial's frames, bin by bin of five frames: a bin is a set of features."""
    t = V.traces(spark, sf).withColumn("trial", F.col("cell") * 100000 + F.col("trial"))
    v = t.groupBy("trial", "config").agg(F.sort_array(F.collect_list(F.struct("frame_ix", "value"))).alias("v")).select("trial", "config", F.transform("v", lambda s: s.value).alias("x"))
    bins = {b: tuple(range(5 * b, 5 * b + 5)) for b in range(V.TRIAL_FRAMES // 5)}
    return _frame(spark, decode(v, 3, 7, path=(0.1,), feature_sets=bins).rename(columns={"features": "bin"}), "bin int, it int, condition string, c double, score double, mi double, n_test long")


def i23(spark, sf):
    """The config's number from vectors, by ridge regression: held-out r and R squared of each fold."""
    return _frame(spark, ridge_folds(vectors(V.responses(spark, sf)), 5, 10.0), "fold int, r double, r2 double")


def g17(spark, sf):
    """The cross-validated score of two configs against 500 permutations of their labels."""
    found = permutation_test(vectors(_two(spark, sf)), 500, 21)
    return _frame(spark, pd.DataFrame([found]), "score double, p double, n long")


def n05(spark, sf):
    """Four groups of configs and a rest, told apart after more and more training trials: mean confusion and deviation."""
    r = grouped_classes(V.responses(spark, sf), "config", {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}, 9)
    return _frame(spark, confusion(vectors(r), (4, 6, 8, 10), 10, 8), "n_train int, true long, said long, mean double, sd double, n long")


QUERIES = {"i13_decode": i13, "i14_decode_by_cells": i14, "i16_generalization": i16, "i21_elimination": i21, "i22_epoch_decoding": i22, "i23_ridge": i23, "g17_permutation": g17, "n05_confusion": n05}
SQL: dict[str, str] = {}
