"""SimHash fingerprints and near-duplicates, with pigeonring filtering.

A 64-bit fingerprint is a ring of segments. Two fingerprints with at most d differing bits have a segment from which
every chain of k consecutive segments differs in at most k*d/segments bits. So the longest chain whose budget is below
one bit must be equal: fingerprints meet by such a chain's bits (one key for each start). Within a key, longer chains
prune what the full comparison sees. A key with many fingerprints is dealt again by three of its five other segments:
two fingerprints at most two bits apart agree on one such choice, and then no more than 2^16 of them can share a key.
Links leave a task as trees, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base

SEED, DISTANCE, SEGMENTS = 42, 2, 8
#: Fingerprints that are compared directly under one key; more are dealt again.
TOGETHER = 2048
#: Byte -> eight byte-wide counters, one for each bit.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def shingle_hashes(text: bytes | None, n: int) -> list[int]:
    """XXH64 of the space-joined n-word shingles of a lower-cased text, repeats included."""
    found = (text or b"").lower().split()
    if not found:
        return []
    h = xxhash.xxh64_intdigest
    if len(found) <= n:
        return [h(b" ".join(found), SEED)]
    line, starts, ends, at = b" ".join(found), [], [], 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [h(line[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprints of runs of hashes (sizes: hashes in each run): bits set in over half of a run."""
    out = np.zeros(len(sizes), dtype="<u8")
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    first = np.cumsum(n) - n
    parts = -(-n // 255)  # a byte-wide counter holds 255 at most
    cut = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    bits = np.add.reduceat(np.add.reduceat(spread, cut, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    """rows without the text, with fp (long, the fingerprint's bits). No word or a null text: zero."""
    base.small_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c != text]
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [shingle_hashes(t, shingle) for t in b.column(at).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            fps, lo = np.zeros(len(lists), dtype="<u8"), 0
            for hi in np.flatnonzero(np.diff(np.cumsum(sizes) >> 18, append=-1) != 0) + 1:  # about 2^18 hashes at a time
                part = lists[lo:hi]
                fps[lo:hi] = majority(np.fromiter((x for y in part for x in y), dtype="<u8", count=int(sizes[lo:hi].sum())), sizes[lo:hi])
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    return rows.mapInArrow(run, T.StructType([*rows.select(*rest).schema.fields, T.StructField("fp", T.LongType())]))


def rotl(x: Column, bits: int) -> Column:
    return x if not bits % 64 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def chain_passes(x: np.ndarray, start: np.ndarray | int, distance: int, segments: int) -> np.ndarray:
    """Whether every chain from segment `start` on keeps its budget. x: differing bits of pairs."""
    width, ok = 64 // segments, np.ones(len(x), dtype=bool)
    turned = (x >> np.uint64(width * start)) | (x << np.uint64((64 - width * start) % 64)) if start else x
    for k in range(1, segments + 1):
        low = turned if k == segments else turned & np.uint64((1 << width * k) - 1)
        ok &= np.bitwise_count(low) <= k * distance // segments
    return ok


def trees(fps: np.ndarray, start: int, distance: int, segments: int) -> list[tuple[int, int]]:
    """Edges that join what chains from `start` link, as trees."""
    left, edges = np.unique(fps.astype(np.int64)).view(np.uint64), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = chain_passes(left ^ at, start, distance, segments)
            if near.any():
                edges += [(at, b) for b in left[near]]
                todo += list(left[near])
                left = left[~near]
    return edges


def dense_trees(fps: np.ndarray, free: list[int], distance: int) -> list[tuple[int, int]]:
    """The same within fingerprints that differ in the `free` bits (16 at most) only, by looking up each of the few
    differences that the distance allows."""
    fps = np.unique(fps.astype(np.int64)).view(np.uint64)
    code = np.zeros(len(fps), dtype=np.int64)
    for n, bit in enumerate(free):
        code |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << n
    place = np.full(1 << len(free), -1, dtype=np.int64)
    place[code] = np.arange(len(fps))
    root = np.arange(len(fps))
    masks = [sum(1 << b for b in bits) for k in range(1, distance + 1) for bits in combinations(range(len(free)), k)]
    while True:
        was = root.copy()
        for m in masks:
            other = place[code ^ m]
            root = np.where(other >= 0, np.minimum(root, root[other]), root)
        root = root[root]
        if (root == was).all():
            return [(fps[r], fps[i]) for i, r in enumerate(root) if r != i]


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """Edges (t, a, b) between the distinct values of fps.fp (long) under one t (int) that join whatever is linked by
    `distance` or fewer differing bits. Null fingerprints have no link; an empty table gives no rows."""
    if distance * 4 > segments or segments != 8:
        raise ValueError("eight segments, and a distance of at most two bits")
    width = 64 // segments
    equal = max(k for k in range(1, segments) if k * distance // segments == 0)
    bits = width * equal
    # One long holds the table, the chain's start and its bits: t, 8 bits, 24 bits.
    chains = F.explode(F.array(*[F.shiftleft(F.col("t").cast("long"), 32) + F.lit(s << bits) + rotl(F.col("fp"), 64 - width * s).bitwiseAND(F.lit((1 << bits) - 1)) for s in range(segments)])).alias("chain")
    ring = base.stash(fps.filter("fp is not null").select("t", "fp").distinct()).select("fp", chains)
    met = ring.join(ring.groupBy("chain").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "chain")
    start = F.shiftright("chain", bits).bitwiseAND(F.lit(255)).cast("int").alias("start")
    t = F.shiftright("chain", 32).cast("int").alias("t")
    few = met.filter(F.col("n") <= TOGETHER).groupBy("chain").agg(F.collect_list("fp").alias("fps")).select(t, start, "fps")
    kept = segments - equal - distance
    choices = list(combinations(range(equal, segments), kept))

    def mask(start: int, choice: tuple[int, ...]) -> int:
        m = sum(((1 << width) - 1) << (width * ((start + s) % segments)) for s in (*range(equal), *choice))
        return m - (1 << 64) if m >= 1 << 63 else m

    # The hot keys, dealt again: (equal + kept) segments agree, `distance` segments are free.
    masks = F.array(*[F.array(*[F.lit(mask(s, c)) for c in choices]) for s in range(segments)])
    hot = met.filter(F.col("n") > TOGETHER).select(t, "fp", start).select("t", "fp", "start", F.posexplode(F.element_at(masks, F.col("start") + 1)).alias("choice", "mask"))
    many = hot.groupBy("t", "start", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("same")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                yield _edges(t, trees(np.asarray(x.values), s, distance, segments))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, s, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                free = [width * ((s + k) % segments) + i for k in range(equal, segments) if k not in choices[c] for i in range(width)]
                yield _edges(t, dense_trees(np.asarray(x.values), free, distance))

    shape = "t int, a long, b long"
    return few.mapInArrow(near, shape).unionByName(many.select("t", "start", "choice", "fps").mapInArrow(dense, shape)).distinct()


def _edges(t: int, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), t, dtype=np.int32)), pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], names=["t", "a", "b"])


#: Near-duplicate texts: fingerprints of each text, words of a shingle and similarity of the exact check.
TABLES, SHINGLE, SIMILAR = 6, 5, 0.8

def remixed(h: np.ndarray, t: int) -> np.ndarray:
    """Another hash for each table."""
    x = (h ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parity(h: np.ndarray) -> bytes:
    """A set's parity bits: each member turns one bit of a power of two, four to eight times as many as members. Two sets
    differ in at least as many members as their bits differ; a larger table folds into a smaller one."""
    width = 1 << max(6, (4 * len(h)).bit_length())
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Members by which two sets differ, at least."""
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def word_fingerprints(rows: DataFrame) -> DataFrame:
    """node, doc_id, fps, n, bits of rows (node, doc_id, text): TABLES fingerprints of a text's distinct words; how many
    distinct five-word shingles it has, and their parity bits."""
    base.small_batches(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            lists = [[h(w) for w in set((t or b"").lower().split())] for t in texts]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            hashes = np.fromiter((x for y in lists for x in y), dtype="<u8", count=int(sizes.sum()))
            fps = np.stack([majority(remixed(hashes, t), sizes) for t in range(TABLES)], axis=1).view(np.int64)
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * TABLES)
            sets = [np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(fps.ravel())), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity(x) for x in sets], pa.binary())], names=["node", "doc_id", "fps", "n", "bits"])

    return rows.select("node", "doc_id", "text").mapInArrow(run, f"node long, doc_id {kind}, fps array<long>, n int, bits binary")


def shingle_sets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """node, shingles (array<long>: hashes of the distinct five-word shingles) of the rows (node, text) that are asked for
    (node), and of a few more. A bit table of the asked ones spares the shuffle most others."""
    base.small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(base.bit_table(asked.select(F.col("node").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            b = b.filter(pa.array(base.may_hold(table, b.column("node").to_numpy().view(np.uint64)).astype(bool)))
            for lo in range(0, b.num_rows, 200):
                found = list(_distinct_shingles(iter([b.slice(lo, 200)])))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([h.view(np.int64) for _, h in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


#: The exact pass: texts under a key that are paired at once, one text of so many whose shingles are counted, how many of
#: the most common shingles go last in the order, and the count at which one is often.
AT_ONCE, COUNTED, COMMON, OFTEN = 16, 8, 1 << 17, 16
#: Pairs of a text that are checked before the others; texts of the two sides of a block; words of parity bits in a block.
SOME, FEW, MANY, WIDEST = 4, 1 << 10, 1 << 12, 1 << 9


def _distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """node and sorted hashes of each text's distinct shingles; most of a task's equal texts once."""
    seen: set[int] = set()
    for b in batches:
        for node, t in zip(b.column("node").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
            if node not in seen:
                if len(seen) >= 1 << 16:
                    seen.clear()
                seen.add(node)
                yield node, np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles of rows (node, text), and their counts in one text of COUNTED. They only
    put shingles in an order, which decides what the exact pass costs, never what it finds."""
    base.small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        held, size = [], 0
        for _, h in _distinct_shingles(batches):
            held.append(h)
            size += len(h)
            if size >= 1 << 21:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    counts = rows.filter(F.pmod("node", F.lit(COUNTED)) == 0).select("node", "text").mapInArrow(run, "h long, n long")
    found = counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 3").orderBy(F.desc("n"), "h").limit(COMMON).toPandas()
    h, n = found["h"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def shingle_prefixes(rows: DataFrame) -> DataFrame:
    """key, node, n, pos, often of rows (node, text): the first shingles (key, at place pos of n) of each text in one order
    of all shingles, common ones last. Of two texts with SIMILAR of their shingles in common, at least one is in both
    prefixes. often: whether a shingle is known to be in many texts."""
    common, often = common_shingles(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            sizes = np.array([len(k) for _, _, k, _ in held])
            columns = [np.concatenate([k for _, _, k, _ in held]).view(np.int64), np.repeat(np.array([x for x, *_ in held], dtype=np.int64), sizes), np.repeat(np.array([n for _, n, *_ in held], dtype=np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]), np.concatenate([o for *_, o in held])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "pos", "often"])

        held = []
        for node, h in _distinct_shingles(batches):
            n, times = len(h), np.zeros(len(h), dtype=np.int64)
            if len(common) and n:
                place = np.minimum(np.searchsorted(common, h), len(common) - 1)
                times = np.where(common[place] == h, often[place], 0)
                order = np.lexsort((h, times))
                h, times = h[order], times[order]
            size = n - math.ceil(SIMILAR * n - 1e-9) + 1
            held.append((node, n, h[:size], times[:size] >= OFTEN) if n else (node, n, np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=bool)))
            if len(held) == 1000:
                yield packed()
                held = []
        if held:
            yield packed()

    return rows.select("node", "text").mapInArrow(run, "key long, node long, n int, pos int, often boolean")


def prefix_pairs(prefixes: DataFrame) -> DataFrame:
    """Rows of two kinds: pairs (a, b; no key) that meet under a key of few texts, and (key, a, n, pos) of other keys. Keys
    come sorted, so no task holds more of one than it takes to see that it has many texts."""
    names, shape = ["key", "a", "b", "n", "pos"], "key long, a long, b long, n int, pos int"

    def many(key: int, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        _, one = np.unique(node, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), key)), pa.array(node[one]), pa.nulls(len(one), pa.int64()), pa.array(n[one]), pa.array(pos[one])], names=names)

    def runs(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        sizes = np.diff(np.append(starts, len(key)))
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= AT_ONCE)]):
            first = starts[sizes == size]
            for i, j in combinations(range(size), 2):
                x, y = first + i, first + j
                ok = (node[x] != node[y]) & may_meet(n[x], pos[x], n[y], pos[y])
                x, y = x[ok], y[ok]
                pairs.append(np.stack([np.maximum(node[x], node[y]), np.minimum(node[x], node[y])], axis=1))
        ends = np.unique(np.concatenate(pairs), axis=0)
        none = pa.nulls(len(ends), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), pa.int64()), pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1])), none, none], names=names)
        for k in np.flatnonzero(sizes > AT_ONCE):
            own = slice(starts[k], starts[k] + sizes[k])
            yield many(key[starts[k]], node[own], n[own], pos[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, dtype=t) for t in ("i8", "i8", "i4", "i4")]
        left, told = none, None  # the last key's rows so far; a key that is known to have many
        for b in batches:
            rows = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n", "pos")]
            if told is not None:
                own = np.searchsorted(rows[0], told, side="right")
                if own:
                    yield many(told, *(x[:own] for x in rows[1:]))
                if own == len(rows[0]):
                    continue
                rows, told = [x[own:] for x in rows], None
            rows = [np.concatenate(x) for x in zip(left, rows)]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
            if last:
                yield from runs(*(x[:last] for x in rows))
            left = [x[last:] for x in rows]
            if len(left[0]) > AT_ONCE:
                told = left[0][0]
                yield many(told, *left[1:])
                left = none
        if len(left[0]):
            yield from runs(*left)

    known = prefixes.filter("often").select("key", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "n", "pos")
    few = prefixes.filter("not often").select("key", "node", "n", "pos").repartition("key").sortWithinPartitions("key")
    return few.mapInArrow(run, shape).unionByName(known)


def may_meet(n, pos, m, at):
    """Whether two texts of n and m shingles can be similar if the first shingle they share has places pos and at. Similar
    texts pass under that shingle, whatever comes out under others. Of arrays or columns."""
    least = F.least if isinstance(n, Column) else np.minimum
    return (least(n - pos, m - at) * (1 + SIMILAR) >= SIMILAR * (n + m) - 1e-6) & (least(n, m) >= SIMILAR * (n + m - least(n, m)) - 1e-6)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (with a text) and node: one number for each distinct text, its 64-bit hash. Should two texts share
    a hash, which is looked for, both get another one."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    for turn in range(1, 9):
        shared = docs.select(node.alias("node"), digest.alias("digest")).groupBy("node").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high")
        again = [r["node"] for r in shared.select("node").take(1 << 16)]  # 64-bit hashes: a few among 10^10 texts
        if not again:
            return docs.withColumn("node", node)
        node = F.when(node.isin(again), F.xxhash64(F.lit(turn), digest, F.coalesce("text", F.lit("")))).otherwise(node)
    raise RuntimeError("texts still share hashes")


def one_row_each(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """The row of keyed (node, doc_id, ...) for each (node, doc_id, times) of chosen; any one where it is repeated."""
    chosen = chosen.select(F.col("node").alias("_node"), F.col("doc_id").alias("_doc_id"), "times")
    met = keyed.join(chosen, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    return met.filter("times = 1").drop("_node", "_doc_id", "times").unionByName(met.filter("times > 1").drop("_node", "_doc_id", "times").dropDuplicates(["node"]))


def near_duplicates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, groups) of keyed (numbered's): nodes (node, doc_id: the least, times: the rows that have both) are distinct
    texts; groups (node, root) hold those that share SIMILAR of their five-word shingles or more with another, directly or
    by others. First, candidates are met by fingerprints of words, in which an edit of one word counts once, not five
    times. Then all pairs that may be similar meet by the prefixes of their shingles, so that none is missed. Pairs whose
    parity bits rule them out go; every link has passed the exact check. The steps are always the same three: pairs of keys of
    few texts; of keys of many texts, some pairs of each text; and then all others that lead from group to group."""
    spark = keyed.sparkSession
    with base.scratch(spark) as keep:
        counted = word_fingerprints(keyed).groupBy("node", "doc_id").agg(F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("times"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "times")).alias("k")
        nodes = base.stash(counted.groupBy("node").agg(least, F.first("fps").alias("fps"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("node", "k.doc_id", "k.times", "fps", "n", "bits"))
        found = base.stash(prefix_pairs(shingle_prefixes(keyed)))
        pairs = base.stash(not_ruled_out(nodes, fingerprint_pairs(nodes).unionByName(found.filter("key is null").select("a", "b")).distinct()))
        groups = base.stash(nodes.select("node", F.col("node").alias("root")).limit(0))
        groups = linked(keyed, groups, pairs)
        many = found.filter("key is not null").select("key", F.col("a").alias("node"), "n", "pos")
        for most in (SOME, None):
            groups = linked(keyed, groups, many_pairs(many, nodes, groups, most))
        return keep(nodes), keep(groups)


def rooted(rows: DataFrame, groups: DataFrame, node: str, root: str) -> DataFrame:
    """rows with the root of their node: itself, if no group has it."""
    return rows.join(groups.select(F.col("node").alias(node), F.col("root").alias(root)), node, "left").withColumn(root, F.coalesce(root, node))


def many_pairs(many: DataFrame, nodes: DataFrame, groups: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) of different groups that meet under a key of many texts (key, node, n, pos), may be similar by their
    sizes and places and aren't ruled out by their parity bits; `most` of each text and block, or all. A key's texts
    outside its largest group are compared with all its texts, in blocks that go to tasks of their own."""
    own = base.stash(rooted(many, groups, "node", "root"))
    sizes = own.groupBy("key", "root").agg(F.count(F.lit(1)).alias("texts"))
    keys = sizes.groupBy("key").agg(F.max_by("root", F.struct("texts", "root")).alias("largest"), F.sum("texts").alias("all"), F.max("texts").alias("of_largest"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    keys = keys.select("key", "largest", blocks(F.col("all") - F.col("of_largest"), FEW).alias("n_few"), blocks(F.col("all"), MANY).alias("n_all"))
    bits = nodes.select("node", F.col("bits"))
    rest = base.stash(base.join_hot(own, keys, ["key"], F.col("node")).join(bits, "node"))
    spread = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "node"), n).cast("int")
    few = rest.filter("root != largest").select("key", at(F.col("n_few"), 1).alias("f"), F.explode(spread(F.col("n_all"))).alias("m"), F.lit(0).alias("side"), "node", "n", "pos", "root", "bits")
    everyone = rest.select("key", F.explode(spread(F.col("n_few"))).alias("f"), at(F.col("n_all"), 2).alias("m"), F.lit(1).alias("side"), "node", "n", "pos", "root", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            ids = list(zip(*(b.column(c).to_numpy().tolist() for c in ("key", "f", "m"))))
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if ids[lo] != now and held:
                    yield compared(held, most)
                    held = []
                now = ids[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield compared(held, most)

    dealt = few.unionByName(everyone).repartition("key", "f", "m").sortWithinPartitions("key", "f", "m")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def compared(rows: list[pa.RecordBatch], most: int | None) -> pa.RecordBatch:
    """The pairs of a block: those of side 0 with those of side 1."""
    t = pa.Table.from_batches(rows)
    side, node, n, pos, root = (t.column(c).to_numpy() for c in ("side", "node", "n", "pos", "root"))
    tables: dict[int, list] = {}  # parity bits by their width in words: places, rows of words
    for i, x in enumerate(t.column("bits").to_pylist()):
        w = np.frombuffer(x, dtype="<u8")
        while len(w) > WIDEST:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        tables.setdefault(len(w), []).append((i, w))
    packed = {k: (np.array([i for i, _ in v]), np.stack([w for _, w in v])) for k, v in tables.items()}
    a, b = [], []
    for width, (places, words) in packed.items():
        for other, (places1, words1) in packed.items():
            right = side[places1] == 1
            those, x = places1[right], words1[right]
            narrow = min(width, other)
            x = _folded(x, narrow)
            for i, w in zip(places[side[places] == 0], _folded(words[side[places] == 0], narrow)):
                ok = (root[those] != root[i]) & may_meet(n[i], pos[i], n[those], pos[those])
                if ok.any():
                    some = those[ok]
                    near = np.bitwise_count(x[ok] ^ w).sum(axis=1) <= (n[some] + n[i]) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-6
                    some = some[near][:most]
                    a.append(np.maximum(node[some], node[i]))
                    b.append(np.minimum(node[some], node[i]))
    ends = [np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in ends], names=["a", "b"])


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fps) that the fingerprints of some table link and all tables together keep near."""
    each = nodes.select("node", F.posexplode("fps").alias("t", "fp"))
    first = base.stash(each.groupBy("t", "fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    same = each.join(first.filter("n > 1"), ["t", "fp"]).filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    ends = first.select("t", "fp", "first")
    met = links(first.select("t", "fp")).join(ends.select("t", F.col("fp").alias("a"), F.col("first").alias("x")), ["t", "a"]).join(ends.select("t", F.col("fp").alias("b"), F.col("first").alias("y")), ["t", "b"])
    return same.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))).distinct()


def not_ruled_out(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parity bits allow SIMILAR: sets of n and m members differ by (n + m) / 9 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
            bits = zip(b.column("ba").to_pylist(), b.column("bb").to_pylist())
            most = (n + m) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-6
            yield b.select(["a", "b"]).filter(pa.array([apart(x, y) <= k for (x, y), k in zip(bits, most.tolist())], pa.bool_()))

    a, b = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long")


def linked(keyed: DataFrame, groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """groups (node, root), written, with those of pairs (a, b) linked that share SIMILAR of their shingles."""
    with base.scratch(keyed.sparkSession) as keep:
        pairs = base.stash(pairs)
        asked = base.stash(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if asked.isEmpty():
            return keep(base.stash(groups))
        sets = base.stash(shingle_sets(keyed, asked))
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        sure = base.stash(both.withColumn("common", common).filter(F.col("common") >= SIMILAR * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"))
        if sure.isEmpty():
            return keep(base.stash(groups))
        return keep(base.stash(base.components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(sure))))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with one row of each group of near-duplicate or equal texts: that of the least doc_id
    (one without an id only if none has one). All texts without a word are one group, null ones among them. Repeated rows
    are one group; other columns stay as they are, whatever their names; no rows give no rows."""
    keyed = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"))
    with base.scratch(docs.sparkSession) as keep:
        nodes, groups = near_duplicates(keyed.select("node", "doc_id", "text"))
        rooted = nodes.join(groups, "node", "left").select("node", "doc_id", "times", F.coalesce("root", "node").alias("root"))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "times")).alias("k")
        kept = keep(base.stash(rooted.groupBy("root").agg(least).select("k.node", "k.doc_id", "k.times")))
    return one_row_each(keyed, kept).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    docs = base.stash(fingerprints(base.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 3))
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    groups = base.components(links(docs.select(F.lit(0).alias("t"), "fp")))
    member = base.stash(classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(member.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES, SQL = {"op2_simhash": op2_simhash}, {}
