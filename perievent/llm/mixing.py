"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source. A source's word budget is first spread over its lengths in
proportion, then over the longest lengths that still fit, and the rest, below DP_BUDGET words, is filled by a bounded
knapsack over the lengths' remaining counts. The plan holds counts only; which documents fill a count is decided by a
seeded hash, so that reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.llm import base

WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2.0
#: Words left to the exact knapsack; its table has one cell per word.
DP_BUDGET = 1 << 17
#: About so many rows are ranked together.
RANKED = 64
#: Sources whose sizes are listed on the driver.
MOST_SOURCES = 1 << 17


def source_targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> dict[str | None, float]:
    """Words to take of each source. Sources in code-point order, null last, get the weights in turn; no target
    exceeds epochs times its source, and what a capped source can't take goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, targets = share * sum(sizes.values()), list(order), {}
    while open_:
        unit = (total - math.fsum(targets.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > epochs * sizes[s]]
        if not over:
            return targets | {s: unit * weight[s] for s in open_}
        targets |= {s: epochs * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in targets]
    return targets


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near the budget as can be."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.zeros_like(counts) if total == 0 else np.array([int(c) * budget // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= DP_BUDGET:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - taken[i]), max(0, rest - DP_BUDGET // 2) // int(lengths[i]))
            taken[i] += more
            rest -= more * int(lengths[i])
    return taken + knapsack(lengths, counts - taken, rest)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The bounded knapsack: counts whose words sum to the reachable number nearest the budget (the lower on ties).
    Each count is split into powers of two; for each sum, the first item that reached it is kept, so going back uses an
    item once."""
    chosen = np.zeros_like(counts)
    if budget <= 0 or not len(lengths):
        return chosen
    limit = budget + int(lengths.max())
    reached, first = np.zeros(limit + 1, dtype=bool), np.full(limit + 1, -1, dtype=np.int32)
    reached[0], items = True, []
    for i in np.argsort(-lengths, kind="stable"):
        size, left, part = int(lengths[i]), int(counts[i]), 1
        while left > 0 and 0 < size * min(part, left) <= limit and not reached[budget]:
            n = min(part, left)
            new = reached[: limit + 1 - size * n] & ~reached[size * n :]
            first[size * n :][new] = len(items)
            reached[size * n :] |= new
            items.append((int(i), n))
            left, part = left - n, part * 2
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - budget).argmin()])
    while at:
        i, n = items[first[at]]
        chosen[i] += n
        at -= int(lengths[i]) * n
    return chosen


def mix(rows: DataFrame, size: Column, source: Column, key: Column, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Plans the mix of rows: (row struct of all their columns, size, source_size, target, copies 0..2).

    size is a row's length in words (null counts as 0), key what the seeded order hashes. Rows alike in key and size
    are interchangeable. A null source is a source of its own, last in order; empty tables give no rows. Sources are
    listed on the driver (one row each; over MOST_SOURCES raise an error); lengths and documents are not listed there.
    """
    spark = rows.sparkSession
    put = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), source.alias("src"), F.xxhash64(F.lit(seed), key).alias("h"))
    totals = put.groupBy("src").agg(F.sum("size").alias("source_size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: their targets are worked out on the driver")
    sizes = {r["src"]: int(r["source_size"]) for r in totals}
    goal = source_targets(sizes, weights, share, epochs)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        src = group["src"].iloc[0]
        src = None if pd.isna(src) else src
        full = int(goal[src] // sizes[src]) if sizes[src] else 0
        extra = fit_counts(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), round(goal[src] - full * sizes[src]))
        return group.assign(source_size=sizes[src], target=goal[src], full=full, extra=extra)

    by_length = put.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")).groupBy("src").applyInPandas(plan, "src string, size long, n long, source_size long, target double, full long, extra long")
    by_length = base.stash(by_length)
    # Rows of one length are ranked by hash in slices of the hash's range, so that no length gathers in one task.
    planned = put.join(by_length.withColumnRenamed("src", "src2").withColumnRenamed("size", "size2"), F.col("src").eqNullSafe(F.col("src2")) & (F.col("size") == F.col("size2"))).drop("src2", "size2")
    place = (F.shiftrightunsigned("h", 32) * F.ceil(F.col("n") / RANKED) / F.lit(1 << 32)).cast("long")
    planned = planned.withColumn("slice", F.when((F.col("extra") > 0) & (F.col("extra") < F.col("n")), place).otherwise(F.pmod("h", F.ceil(F.col("n") / RANKED))))
    before = planned.groupBy("src", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    before = before.select("src", "size", "slice", (F.sum("m").over(W.partitionBy("src", "size").orderBy("slice")) - F.col("m")).alias("before"))
    ranked = planned.withColumn("rank", F.row_number().over(W.partitionBy("src", "size", "slice").orderBy("h", *[F.col(f"row.`{c}`") for c, t in rows.dtypes if t in ("bigint", "int", "string") and c in ("doc_id",)])))
    before = before.select(F.col("src").alias("src2"), F.col("size").alias("size2"), F.col("slice").alias("slice2"), "before")
    out = ranked.join(before, F.col("src").eqNullSafe(F.col("src2")) & (F.col("size") == F.col("size2")) & (F.col("slice") == F.col("slice2")))
    return out.select("row", "size", "source_size", "target", (F.col("full") + (F.col("before") + F.col("rank") <= F.col("extra")).cast("long")).alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each document of docs (doc_id, text, source, ...) as often as its source's target asks."""
    planned = mix(docs, base.n_words(F.col("text")), F.col("source"), F.struct("doc_id", "text"), seed)
    return planned.select(F.explode(F.expr("array_repeat(row, cast(copies as int))")).alias("row")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of each document of the table that the mix takes."""
    docs = base.table(spark, sf_dir, "documents")
    rows = base.stash(docs.select("doc_id", "source", base.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("like")))
    planned = mix(rows, F.col("size"), F.col("source"), F.struct("doc_id", "like"))
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES, SQL = {"op1_mixing": op1_mixing}, {}
