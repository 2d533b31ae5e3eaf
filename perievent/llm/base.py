"""What the text operators share: word syntax, row payloads, shared-folder tables, components."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.sources.text import drop, place

#: Words are maximal runs of anything but these six ASCII characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z only; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """array<string>: the words of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def stash(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and returns it read back: lineage ends there, and no executor's
    loss undoes it. The table goes when the driver's process ends."""
    spark = df.sparkSession
    path = place(spark, "stash")
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stashed_at = path
    return found


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Within it, stashed tables are temporary: at its end they are deleted, but for those handed to keep(), which pass to
    the scope around it. Shuffle files of what ran within it are let go too: Spark deletes them once the driver has
    collected its garbage, which a long job of small rounds does too seldom."""
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stashed_at)
        return df

    own: list[str] = []
    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(p for p in own if p in kept)
        for p in own:
            if p not in kept:
                drop(spark, p)
        gc.collect()
        spark._jvm.System.gc()


MAX_BITS, BLOCK = 1 << 28, 1 << 16


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Two bits set for each value of hashes.h, in a table of 32 bits a row, 32 MiB at most: what has a bit unset isn't
    there. It comes to the driver in rows of one block each."""
    bits = min(MAX_BITS, 1 << max(16, (32 * hashes.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(places(np.asarray(b.column(0)).view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array((at // BLOCK).astype(np.int32)), pa.array((at % BLOCK).astype(np.int32))], names=["block", "bit"])

    packed = np.zeros(bits // 8, dtype=np.uint8)
    for r in hashes.select("h").mapInArrow(run, "block int, bit int").groupBy("block").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        table = np.zeros(BLOCK, dtype=np.bool_)
        table[r["bits"]] = True
        packed[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.packbits(table, bitorder="little")
    return packed


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(bits - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in a bit table (1 or 0)."""
    p, q = places(h, 8 * len(table))
    return table[p >> 3] >> (p & 7).astype(np.uint8) & table[q >> 3] >> (q & 7).astype(np.uint8) & 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that long texts fit; a setting other than Spark's default stays."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches.

    Alternates large-star and small-star steps, each one shuffle by node; a round's edges go to the shared folder.
    Null ends and loops are ignored; no edges give no rows.
    """
    edges = stash(edges.filter("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stash(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003), F.countDistinct("a")).first()
        if now == state and now[0] == now[2]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


#: A key with more rows than this may be hot; so many keys at most are dealt to so many parts.
HOT_ROWS, HOT_KEYS, PARTS = 1 << 12, 1 << 10, 32


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of over HOT_ROWS rows, the HOT_KEYS most frequent ones if there are more: small enough to broadcast, and any
    other key holds at most one row in HOT_KEYS."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n"), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("_hot"))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """left joined (inner, left) with right on keys, where few rows of right share a key but very many of left may: the
    rows of a hot key are dealt to PARTS parts by `spread`, and right's rows of that key go to each. left is read twice, so
    it should be a written table or cheap. Null keys meet nothing."""
    hot = hot_keys(left.filter(" and ".join(f"`{k}` is not null" for k in keys)), keys)
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.lit("part"), spread), F.lit(PARTS)).cast("int")).otherwise(F.lit(0))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
