"""Sharding by Karmarkar-Karp differencing, with groups of equal texts kept whole.

Law `bytes`. A group's bytes are summed before any shuffle of rows. Groups of at least LARGE of all bytes are items of
their own; there can be at most 1/LARGE of them. All others fall into ATOMS hash classes, each a partial partition with
one filled part. So the differencing works on at most ATOMS + 1/LARGE items, whatever the table's size, and the driver
only holds those; groups and documents stay distributed.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.llm import base

SHARDS = 16
ATOMS, LARGE = 1 << 15, 2.0**-14


def differencing(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """item -> shard. The two partial partitions with the largest spread are combined again and again, the fullest
    parts of one with the emptiest of the other, until one is left. Ties go by the order of the items."""
    if not items:
        return {}
    heap = [(-size, n, (size,) + (0,) * (shards - 1), (item,) + (None,) * (shards - 1)) for n, (size, item) in enumerate(items)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, sums, parts = heapq.heappop(heap)
        _, _, others, rest = heapq.heappop(heap)
        both = sorted(((a + b, i) for i, (a, b) in enumerate(zip(sums, reversed(others)))), reverse=True)
        low = both[-1][0]
        joined = tuple(_pair(parts[i], rest[shards - 1 - i]) for _, i in both)
        heapq.heappush(heap, (low - both[0][0], n, tuple(s - low for s, _ in both), joined))
        n += 1
    found: dict[object, int] = {}
    for shard, part in enumerate(heap[0][3]):
        todo = [part]
        while todo:
            p = todo.pop()
            if isinstance(p, _Pair):
                todo += (p.a, p.b)
            elif p is not None:
                found[p] = shard
    return found


class _Pair:
    __slots__ = ("a", "b")

    def __init__(self, a, b):
        self.a, self.b = a, b


def _pair(a, b):
    return b if a is None else a if b is None else _Pair(a, b)


def shard(rows: DataFrame, text: str = "text", shards: int = SHARDS, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows (row struct of all columns, size, shard, slot): size is a text's UTF-8 bytes plus 1 (null: 1).

    Rows of equal texts share a shard (null texts are equal to each other); slots count from 0 without a gap in each
    shard; ties and repeated rows take neighbouring slots. An empty table gives no rows.
    """
    body = F.col(f"`{text}`")
    put = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.md5(F.coalesce(body, F.lit("\0null"))).alias("like"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)])
    return _placed(put, shards, [f"o{i}" for i in range(len(order))])


def _placed(put: DataFrame, shards: int, order: list[str]) -> DataFrame:
    spark = put.sparkSession
    groups = base.stash(put.groupBy("like").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = F.col("bytes") >= F.lit(max(1.0, total * LARGE))
    atom = F.when(large, F.col("like")).otherwise(F.pmod(F.xxhash64("like"), F.lit(ATOMS)).cast("string"))
    atoms = groups.groupBy(atom.alias("atom")).agg(F.sum("bytes").alias("bytes")).collect()  # at most ATOMS + 1/LARGE rows
    placed = differencing(sorted((int(r["bytes"]), r["atom"]) for r in atoms), shards)
    where = spark.createDataFrame(list(placed.items()), "atom string, shard int")
    # Two look-ups in that table, of a large group itself or else of its hash class: rows of equal texts never meet.
    own, of_class = where.select(F.col("atom").alias("like"), F.col("shard").alias("own")), where.select(F.col("atom").alias("class"), F.col("shard").alias("of_class"))
    sent = put.withColumn("class", F.pmod(F.xxhash64("like"), F.lit(ATOMS)).cast("string")).join(F.broadcast(own), "like", "left").join(F.broadcast(of_class), "class", "left")
    sent = sent.withColumn("shard", F.coalesce("own", "of_class")).drop("class", "own", "of_class")
    # Slots: rows are ranked in hash classes of each shard, the classes' counts give each class its first slot.
    count = max(1, sum(1 for _ in atoms) // 64)
    sent = sent.withColumn("lane", F.pmod(F.xxhash64("like", *order), F.lit(count * 4)))
    lanes = sent.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("m"))
    lanes = lanes.select("shard", "lane", (F.sum("m").over(W.partitionBy("shard").orderBy("lane")) - F.col("m")).alias("first"))
    ranked = sent.withColumn("rank", F.row_number().over(W.partitionBy("shard", "lane").orderBy(*order, "like")) - 1)
    return ranked.join(lanes, ["shard", "lane"]).select("row", "size", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text, ...) with their size, shard and slot added; a column of docs of such a name gives way."""
    placed = shard(docs, "text", shards)
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("size", "shard", "slot")], "size", "shard", "slot")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null, law bytes) of every document."""
    text = F.col("text")
    docs = base.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(F.coalesce(text, F.lit("\0null"))).alias("like"))
    put = docs.select(F.struct("doc_id", "text_crc32").alias("row"), "size", "like", F.col("doc_id").alias("o0"))
    return _placed(base.stash(put), SHARDS, ["o0"]).select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES, SQL = {"op7_sharding": op7_sharding}, {}
