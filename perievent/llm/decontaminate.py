"""Benchmark decontamination by spaced-seed hashing.

A leak is a window of WINDOW aligned tokens of which NEEDED agree; an item of fewer tokens leaks whole, with the same
share of its tokens agreeing. A mask heeds some token positions and ignores others, so a seed hash survives
substitutions at the others. The masks are chosen so that, however the substitutions that a leak allows lie, one mask at
one place heeds none of them: every leak shares a seed with its item. Seed hashes of the test items and of the training
texts are joined, and around each hit the aligned tokens are compared. Items that look alike around a seed are one row of
that join, so that a passage shared by many items doesn't multiply the hits; which items they are is joined back after
the comparison. A bit table of the items' seeds, of at most 32 MiB, spares the join what can't hit; it never decides one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base

#: For windows of 13 tokens with two substitutions, and items of 11 or 12 with one.
MASKS = ("11011000111", "11100011011", "11111011")
#: For items of 7 to 10 tokens with one substitution, and of 5 or 6 without any.
SHORT_MASKS = ("11111", "1100011")
LONG = 11
#: Fewest tokens of an item that can leak, a parameter of `leaks`: one that stands word for word in a text is a leak.
SHORTEST = 1
WINDOW, NEEDED = 13, 11
SPAN = max(map(len, MASKS))
AROUND = WINDOW - 1
FRAME = SPAN + 2 * AROUND

#: Tokens: runs of ASCII letters and digits and of other letters' bytes, in lower case.
_TOKEN_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 3, 1 << 64) | 1 for k in range(SPAN)], dtype=np.uint64)


def token_codes(text: bytes | None) -> np.ndarray:
    found = (text or b"").translate(_TOKEN_BYTES).split()
    return np.fromiter(map(zlib.crc32, found), dtype=np.uint32, count=len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def patterns(size: int) -> tuple[str, ...]:
    """The masks for an item of so many tokens."""
    return MASKS if size >= LONG else SHORT_MASKS if size >= 7 else SHORT_MASKS[:1] if size >= 5 else ("1" * size,)


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position of the tokens at which it fits."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, zlib.crc32(mask.encode()), dtype=np.uint64)
    wide = mixed(codes.astype(np.uint64) + np.uint64(1))
    for k, c in enumerate(mask):
        if c == "1":
            h += wide[k : k + n] * _FACTORS[k]
    return mixed(h)


def frames(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The tokens from AROUND before each position to AROUND beyond SPAN, -1 outside the text."""
    padded = np.full(len(codes) + 2 * FRAME, -1, dtype=np.int64)
    padded[AROUND : AROUND + len(codes)] = codes
    return padded[at[:, None] + np.arange(FRAME)]


def _frame_bytes(f: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in f.astype("<i8")]


def item_classes(items: DataFrame) -> DataFrame:
    """(item_id, class_id, n_tokens, n_items) of items (item_id, text): class_id is the least id of the items with the
    same tokens, n_items their number."""
    tokens = _tokens(items.select("item_id", "text")).select("item_id", "tokens", "n_tokens")
    least = tokens.groupBy("tokens").agg(F.min("item_id").alias("class_id"), F.count(F.lit(1)).alias("n_items"))
    return tokens.join(least, "tokens").select("item_id", "class_id", "n_tokens", "n_items")


def _tokens(items: DataFrame) -> DataFrame:
    """items with tokens (a digest of the token codes) and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [token_codes(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([hashlib.md5(c.tobytes()).digest() for c in codes], pa.binary()), pa.array([len(c) for c in codes], pa.int32())], names=[*b.schema.names, "tokens", "n_tokens"])

    base.small_batches(items.sparkSession)
    return items.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.IntegerType())]))


def item_seeds(items: DataFrame) -> DataFrame:
    """(h, frame, size, item_id): the seeds of items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                codes = token_codes(text)
                for mask in patterns(len(codes)) if len(codes) else ():
                    h = seed_hashes(codes, mask)
                    around = _frame_bytes(frames(codes, np.arange(len(h))))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(around, pa.binary()), pa.array(np.full(len(h), min(len(codes), WINDOW), dtype=np.int32)), b.column("item_id").take(pa.array(np.full(len(h), i)))], names=["h", "frame", "size", "item_id"])

    base.small_batches(items.sparkSession)
    return items.select("item_id", "text").mapInArrow(run, T.StructType([T.StructField("h", T.LongType()), T.StructField("frame", T.BinaryType()), T.StructField("size", T.IntegerType()), items.schema["item_id"]]))


def leaks(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(row, item_id, n_items, start, end, matched): for each of the texts' windows that agrees with an item, docs' row
    without its text (a struct), the item, how many items have its tokens, the window's tokens (end exclusive, within the
    text) and how many of them agree.

    docs and items need a column text, items an item_id of any type. Items of equal tokens are one, under their least id
    (item_classes has who they are). An item of fewer than `shortest` tokens is no leak anywhere. Null and empty texts
    and items have no tokens and no leak; repeated rows repeat their leaks; either side empty gives no rows.
    """
    spark = docs.sparkSession
    told = _tokens(items.select("item_id", "text")).filter(F.col("n_tokens") >= max(shortest, 1))
    classes = base.stash(told.groupBy("tokens").agg(F.min(F.struct("item_id", "text")).alias("i"), F.count(F.lit(1)).alias("n_items"), F.first("n_tokens").alias("n_tokens")).select("i.item_id", "i.text", "n_items", "n_tokens"))
    masks = sorted({m for r in classes.select(F.least("n_tokens", F.lit(LONG)).alias("n")).distinct().collect() for m in patterns(r["n"])})  # LONG values at most
    members = base.stash(item_seeds(classes))
    seeds = base.stash(members.groupBy("h", "frame", "size").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("alike")))
    shared = spark.sparkContext.broadcast(base.bit_table(seeds))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            rows, hs, starts, around = [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                codes = token_codes(text)
                for mask in masks:
                    h = seed_hashes(codes, mask)
                    at = np.flatnonzero(base.may_hold(bits, h))
                    if len(at):
                        rows.append(np.full(len(at), i))
                        hs.append(h[at])
                        starts.append(at)
                        around += _frame_bytes(frames(codes, at))
            pick = pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pick), pa.array(np.concatenate(hs).view(np.int64) if hs else [], pa.int64()), pa.array(np.concatenate(starts) if starts else [], pa.int64()), pa.array(around, pa.binary())], names=["row", "h", "at", "seen"])

    own = docs.select(F.struct(*([F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(1).alias("none")])).alias("row"), "text")
    field, row = T.StructField, own.schema["row"]
    hit = own.mapInArrow(hits, T.StructType([row, field("h", T.LongType()), field("at", T.LongType()), field("seen", T.BinaryType())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            seen = np.frombuffer(b"".join(b.column("seen").to_pylist()), dtype="<i8").reshape(n, FRAME)
            item = np.frombuffer(b"".join(b.column("frame").to_pylist()), dtype="<i8").reshape(n, FRAME)
            size = b.column("size").to_numpy().astype(np.int64)
            best, start, end = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for w in np.unique(size):  # the tokens that must be aligned: a window's, or a short item's all
                some = np.flatnonzero(size == w)
                there = np.cumsum(np.pad(item[some] >= 0, ((0, 0), (1, 0))), axis=1)
                alike = np.cumsum(np.pad((item[some] >= 0) & (item[some] == seen[some]), ((0, 0), (1, 0))), axis=1)
                equal = np.where(there[:, w:] - there[:, :-w] == w, alike[:, w:] - alike[:, :-w], 0)
                best[some], first = equal.max(axis=1), equal.argmax(axis=1)
                # A window may reach beyond the text by the tokens that needn't agree.
                text = seen[some] >= 0
                before, within = np.argmax(text, axis=1), text.sum(axis=1)
                start[some], end[some] = np.maximum(first, before), np.minimum(first + w, before + within)
            at = b.column("at").to_numpy() - AROUND
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(at + start), pa.array(at + end), pa.array(best)], names=[*kept, "start", "end", "matched"])
            yield out.filter(pa.array(best * WINDOW >= NEEDED * size))

    kept = ["row", "h", "frame", "item_id", "alike"]
    met = hit.join(seeds, "h").select(*kept, "size", "at", "seen")
    found = met.mapInArrow(verify, T.StructType([row, field("h", T.LongType()), field("frame", T.BinaryType()), items.schema["item_id"], field("alike", T.LongType()), *(field(c, T.LongType()) for c in ("start", "end", "matched"))]))
    found = base.stash(found.withColumn("frame", F.when(F.col("alike") > 1, F.col("frame"))))
    one = found.filter("alike = 1").select("row", "item_id", "start", "end", "matched")
    many = found.filter("alike > 1").drop("item_id").join(members.select("h", "frame", "item_id"), ["h", "frame"]).select("row", "item_id", "start", "end", "matched")
    return one.unionByName(many).join(classes.select("item_id", "n_items"), "item_id").select("row", "item_id", "n_items", "start", "end", "matched")


def clean(docs: DataFrame, items: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """docs without the rows whose text holds a leak (rows of equal texts go together); their columns stay as they
    are, whatever their names."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", F.md5("text").alias("like"))
    bad = leaks(marked.select("like", "text"), items, shortest).select("row.like").distinct()
    return marked.join(bad, "like", "left_anti").select("doc.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_items, start, end, matched, windows: the leaks of benchmark items in documents. start and end
    are the first and last of the leak's tokens (end exclusive), matched the tokens that agree in its best window, windows
    the hits that were verified. Items of equal tokens are one row under their least item_id, n_items their number. A
    document without a leak has no row."""
    found = leaks(base.table(spark, sf_dir, "documents").select("doc_id", "text"), base.table(spark, sf_dir, "benchmark"))
    return found.groupBy("row.doc_id", "item_id").agg(F.first("n_items").alias("n_items"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("matched").alias("matched"), F.count(F.lit(1)).alias("windows"))


QUERIES, SQL = {"op8_decontaminate": op8_decontaminate}, {}
