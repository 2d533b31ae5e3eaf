"""Global order without one task for all rows: rows are dealt to slices by range, slices are counted, and a row's place
is its place in the slice plus what the slices before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.plans.stash import stash


def _sliced(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in slices of a range of `order`, written, so that every use sees the same slices."""
    return stash(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the row number from 1 in `order` (which should leave no ties; tied rows stay in one slice)."""
    s = _sliced(df, order)
    before = s.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_slice", F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a slice
    k = F.row_number().over(W.partitionBy("_slice").orderBy(*order))
    return s.withColumn("_k", k).join(before, "_slice").withColumn(name, F.col("_before") + F.col("_k")).drop("_slice", "_k", "_before")


def placed(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], keep: tuple[str, ...], name: str) -> DataFrame:
    """keys, keep and the number from 1 of each row within its keys in the order `by`, whatever a key's size. Rows move and
    are written once: a slice of the order is a part of the table, and a row's number is its place there, less the place of
    the first row of its keys, plus what slices before hold of these."""
    order = [F.col(c) for c in (*keys, *by)]
    s = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, *keep, F.monotonically_increasing_id().alias("_id")))
    slice_of = F.shiftright("_id", 33).alias("_slice")
    parts = s.groupBy(*keys, slice_of).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    parts = parts.select(*keys, "_slice", "_first", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return s.select("*", slice_of).join(stash(parts), [*keys, "_slice"]).select(*keys, *keep, (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias(name))


def running_counts(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """keys, value, n, upto, total: for each distinct non-null value of a key its rows, those up to it and all."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    s = _sliced(counts, [F.col(c) for c in (*keys, value)])
    sums = s.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    before = sums.select(*keys, "_slice", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(*keys)).alias("total"))
    run = F.sum("n").over(W.partitionBy("_slice", *keys).orderBy(value))
    return s.withColumn("_run", run).join(before, [*keys, "_slice"]).select(*keys, value, "n", (F.col("_before") + F.col("_run")).alias("upto"), "total")


def ranks(df: DataFrame, keys: tuple[str, ...], value: str, name: str) -> DataFrame:
    """df's rows of a value with its rank among its key's, ties sharing their mean; whatever a key's size. Keys must not be
    null. df is written first: a value that is made again, as a mean of rows in another order, may not meet its own count."""
    df = stash(df)
    counts = running_counts(df, keys, value).select(*keys, value, (F.col("upto") - (F.col("n") - 1) / 2).alias(name))
    return df.join(counts, [*keys, value])


def quantiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, by name, the exact quantiles of value, interpolated linearly. Keys must not be null."""
    c = running_counts(df, keys, value)
    aggs, outs = [], []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("total") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("upto") - F.col("n") <= place) & (place < F.col("upto")), F.col(value))).alias(f"_{name}_{end}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (F.lit(q) * (F.col("_total") - 1) - F.floor(F.lit(q) * (F.col("_total") - 1))) * (hi - lo)).alias(name))
    return c.groupBy(*keys).agg(F.max("total").alias("_total"), *aggs).select(*keys, *outs)
