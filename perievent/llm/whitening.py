"""Whitening of embeddings by the spectral divide and conquer of QDWH.

Spark sums what the covariance needs, exactly, in integers: entries become integers x, are centred at the integer next
to their mean, and the products of the centred entries are summed task by task. The covariance is small (dimensions
squared) and goes to the driver. There, the polar factor of the covariance less a shift (QDWH iterations, no eigenvalue
routine) gives the projector on the components above the shift; its range and complement split the matrix in two, and so
on until a part is one component or a multiple of the identity. Parts that can't hold a wanted component aren't split.
The components and the means are broadcast to whiten all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base

COMPONENTS, SCALE, OFFSET = 8, 1024, 100000
#: The covariance's dimensions squared go to the driver (128 MiB at most).
MAX_DIMENSIONS = 4096
EPS = np.finfo(float).eps


def polar(a: np.ndarray, rounds: int = 12) -> np.ndarray:
    """The orthogonal polar factor of a symmetric, non-singular matrix: dynamically weighted Halley iterations."""
    x = a / np.linalg.norm(a)
    low = EPS  # under the least singular value of x, or what rounding leaves of it
    one = np.eye(len(a))
    for _ in range(rounds):
        q = low * low
        d = np.cbrt(4 * (1 - q) / (q * q))
        s = np.sqrt(1 + d)
        wa = s + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - q) / (q * s)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # by QR, which keeps small singular values
            both, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))
            top, bottom = both[: len(a)], both[len(a) :]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * top @ bottom.T
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(one + wc * x @ x.T, x)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * q) / (1 + wc * q))
        if 1 - low < 10 * EPS and moved < (5 * EPS) ** (1 / 3):
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthogonal matrix whose first columns (so many) span the invariant subspace of a's eigenvalues over a shift. The
    shift is near the eigenvalues' mean, so that neither part is empty; where it hits an eigenvalue it moves."""
    n = len(a)
    mean, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    rng = np.random.default_rng(n)
    best = None
    for step in (0.0, 0.0137, -0.0171, 0.0291, -0.0379, 0.0533, -0.0617, 0.0811):
        u = polar(a - (mean + step * spread) * np.eye(n))
        p = (u + np.eye(n)) / 2
        k = round(np.trace(p))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(np.hstack([p @ rng.standard_normal((n, k)), (np.eye(n) - p) @ rng.standard_normal((n, n - k))]))
        q, _ = np.linalg.qr(np.hstack([p @ q[:, :k], q[:, k:] - p @ q[:, k:]]))
        left = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or left < best[0]:
            best = (left, q, k)
        if left <= 8 * n * EPS * np.linalg.norm(a):
            break
    if best is None:  # no shift parts them: equal but for rounding
        return np.eye(n), n
    return best[1], best[2]


def spectrum(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns. Equal
    eigenvalues get some orthonormal basis of their subspace."""
    scale = np.linalg.norm(a)
    values, vectors = [], []
    todo = [(a, np.eye(len(a)))]
    while todo and len(values) < wanted:
        part, basis = todo.pop()
        n = len(part)
        if n == 1 or np.linalg.norm(part - np.diag(np.diag(part))) <= n * EPS * scale:
            order = np.argsort(-np.diag(part), kind="stable")
            values += [part[i, i] for i in order]
            vectors += [basis[:, i] for i in order]
            continue
        q, k = halves(part)
        if k == n:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for columns in (q[:, k:], q[:, :k]):  # the larger eigenvalues come off the stack first
            inner = columns.T @ part @ columns
            todo.append(((inner + inner.T) / 2, basis @ columns))
    v, _ = np.linalg.qr(np.array(vectors[:wanted]).T.reshape(len(a), -1))
    e = np.einsum("ij,ik,kj->j", v, a, v)
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def integers(vector: Column) -> Column:
    """array<long>: floor(1024 c) + 100000 of each entry; null where an entry is null or not finite, or too large to be
    an integer of double precision, or where there is none."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float(1 << 43)), F.lit(False))  # noqa: E731  false for NaN too, which Spark puts over all
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET))
    return F.when((F.size(vector) > 0) & F.forall(vector, fits), whole)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def decimals(values) -> pa.Array:
    return pa.array([int(v) for v in values], pa.decimal128(38, 0))


def products(z: np.ndarray) -> np.ndarray:
    """z'z of integers, exactly: by floats where every sum stays under 2^53, else by Python's integers."""
    top = int(np.abs(z).max()) if z.size else 0
    if top * top * len(z) < 1 << 53:
        f = z.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    big = z.astype(object)
    return big.T @ big


def exact_moments(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the matrix n * sum(xx') - SS' of rows.x, all exact."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                part = x.sum(axis=0, dtype=object) if int(np.abs(x).max()) * len(x) >= 1 << 62 else x.sum(axis=0).astype(object)
                n, total = n + len(x), part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), decimals(total), decimals([n] * len(total))], names=["i", "s", "n"])

    found = rows.select("x").mapInArrow(sums, "i int, s decimal(38,0), n decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # a row a dimension
    if not found:
        return 0, [], np.zeros((0, 0), dtype=object)
    n, s = int(found[0]["n"]), [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], dtype=np.int64)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = products(matrix(b.column(0)) - centre)
                total = part if total is None else total + part
        if total is not None:
            for i in range(len(total)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), i, dtype=np.int32)), pa.array(range(len(total)), pa.int32()), decimals(total[i])], names=["i", "j", "g"])

    at = np.zeros((len(s), len(s)), dtype=object)
    for r in rows.select("x").mapInArrow(moments, "i int, j int, g decimal(38,0)").groupBy("i", "j").agg(F.sum("g").alias("g")).toLocalIterator():  # dimensions squared
        at[r["i"], r["j"]] = int(r["g"])
    z = np.array([v - n * int(c) for v, c in zip(s, centre)], dtype=object)
    return n, s, n * at - np.outer(z, z)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """row (a struct of rows' other columns), component, n, deviation, whitened, explained, identity_error: one row for
    each vector and component.

    Vectors that are null, empty, of another length than most (the longer one on a tie), or that hold a null, a
    non-finite entry or one of 2^43 or more are left out. Repeated rows count as often as they stand. Components without
    variance beyond rounding are left out, so that vectors which are all equal, one vector or an empty table give no rows;
    fewer dimensions than `components` give fewer. A deviation that no long holds is null.
    """
    spark = rows.sparkSession
    base.small_batches(spark)
    rest = [c for c in rows.columns if c != vector]
    lanes = rows.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row") if rest else F.lit(None).cast("struct<none:int>").alias("row"), integers(F.col(f"`{vector}`")).alias("x")).filter("x is not null")
    lengths = lanes.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; {MAX_DIMENSIONS} at most")
    lanes = lanes.filter(F.size("x") == d)
    n, s, moments = exact_moments(lanes)
    v = np.array([[int(c) / (n * n) for c in r] for r in moments], dtype=float).reshape(d, d)  # each quotient is rounded once
    trace = sum(int(moments[i, i]) for i in range(d))
    e, axes = spectrum(v, min(components, d)) if d and trace else (np.zeros(0), np.zeros((d, 0)))
    sure = e > d * EPS * (e[0] if len(e) else 0)
    e, axes = e[sure], axes[:, sure]
    explained = e / (trace / (n * n)) if len(e) else e
    centre = np.array([(2 * c + n) // (2 * n) for c in s], dtype=np.int64)
    left = [c - n * int(m) for c, m in zip(s, centre)]
    shift = np.array([c / n for c in left])
    shared = spark.sparkContext.broadcast((axes / np.sqrt(e) if len(e) else axes, centre, shift, left))
    k = len(e)

    def projected(x: np.ndarray) -> np.ndarray:
        scaled, centre, shift, _ = shared.value
        return ((x - centre) - shift) @ scaled

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = projected(matrix(b.column(0)))
                total += w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "w"])

    def deviations(x: np.ndarray) -> list[int | None]:
        _, centre, _, left = shared.value
        z = x - centre
        top = n * int(np.abs(z).max()) + max(abs(c) for c in left)
        if top * top * d < 1 << 63:
            y = n * z - np.array(left, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * z.astype(object) - np.array(left, dtype=object)
        return [q if q < 1 << 63 else None for q in (y * y).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                at = pa.array(np.repeat(np.arange(len(x)), k))
                out = [b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(deviations(x), pa.int64()).take(at), pa.array(projected(x).ravel()), pa.array(np.tile(explained, len(x)))]
                yield pa.RecordBatch.from_arrays(out, names=["row", "component", "deviation", "whitened", "explained"])

    shape = T.StructType([lanes.schema["row"], T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    if not k:
        return spark.createDataFrame([], shape).select("row", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(None).cast("double").alias("identity_error"))
    sums = lanes.select("x").mapInArrow(squares, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")).collect()  # components squared
    error = max(abs(r["w"] / n - (r["i"] == r["j"])) for r in sums)
    return lanes.select("row", "x").mapInArrow(run, shape).select("row", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(float(error)).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector."""
    found = whiten(base.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


QUERIES, SQL = {"op13_whitening": op13_whitening}, {}
