"""Repeated passages by a depth-limited radix sort of suffixes.

Tokens are bytes. Suffixes are ordered by their first `threshold` bytes only; those that stay equal throughout are the
repeated windows, and all but the earliest of them are removed. The first digit is chosen by content: of the 32-byte
grams in a window the one of the least hash (the last one on a tie) is its anchor, so equal windows have equal anchors at
equal offsets, and the suffixes that share an anchor travel as one row, about one for 33 bytes. Spark deals these rows by
the anchor's hash. Rows that agree in all their bytes need no more sorting. Only anchors that stand in several contexts
fetch their bytes, and their suffixes go through most-significant-digit passes of eight bytes, in which a suffix that is
alone leaves. Anchors with very many contexts are sorted by Spark itself, a row a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base
from perievent.plans import order

THRESHOLD, GRAM = 100, 32
#: Bytes that are hashed at once; longer texts go in pieces that overlap by a window.
PIECE = 1 << 19
#: Contexts of one anchor that a task sorts; more are sorted by Spark.
TOGETHER = 1 << 15
#: Suffixes that go through the passes at once, about.
SUFFIXES = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b * _B
    return x


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` (a power of two) bytes from each place on."""
    h, k = _BYTE[data], 1
    while k < length:
        h, k = _mixed(h[:-k], h[k:]), 2 * k
    return h


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` neighbours."""
    k = 1
    while 2 * k <= width:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if width > k else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """h, c, first, last, at of the texts data[starts:ends]: runs of windows (by their first bytes' places) that share the
    anchor at `at`; h is its hash, c one of all bytes of the run's windows and the anchor's place among them."""
    if len(data) < threshold:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = gram_hashes(data, GRAM)
    low = np.uint64((1 << len(data).bit_length()) - 1)
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    at = (low - (least(keys, threshold - GRAM + 1) & low)).astype(np.int64)
    change = np.zeros(len(at) + 1, dtype=np.int64)
    long = ends - starts >= threshold
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - threshold + 1, -1)
    windows = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    if not len(windows):
        return grams[:0], grams[:0], windows, windows, windows
    at = at[windows]
    first = np.zeros(len(data), dtype=bool)
    first[starts[long]] = True
    cut = np.flatnonzero((np.diff(at, prepend=-1) != 0) | first[windows])
    lo, hi, at = windows[cut], np.append(windows[cut[1:] - 1], windows[-1]), at[cut]
    length = hi + threshold - lo
    wide = _mixed(grams[:-GRAM], grams[GRAM:])  # of 64 bytes
    pieces = -(-(2 * threshold - GRAM) // 64)
    c = ((at - lo) * (1 << 32) + length).astype(np.uint64)
    for k in range(pieces):
        c = _mixed(c, wide[lo + (length - 64) * k // (pieces - 1)])
        c ^= c >> np.uint64(32)
    return grams[at], c, lo, hi, at


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same windows in fewer rows: those that touch are joined."""
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    new = (np.diff(doc, prepend=doc[:1] - 1) != 0) | (lo != np.append(-2, hi[:-1]) + 1)
    cut = np.flatnonzero(new)
    return doc[cut], lo[cut], np.append(hi[cut[1:] - 1], hi[-1:])


_ROW = "kind int, h long, c long, doc long, lo long, hi long, at int"


def _rows(kind: int, h, c, doc, lo, hi, at) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, dtype=np.int32), h, c, doc, lo, hi, at]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["kind", "h", "c", "doc", "lo", "hi", "at"])


def _marks(doc, lo, hi) -> pa.RecordBatch:
    doc, lo, hi = _runs(doc, lo, hi)
    none = np.zeros(len(doc), dtype=np.int64)
    return _rows(1, (doc * -7046029254386353131).astype(np.int64), none, doc, lo, hi, none.astype(np.int32))


def anchor_rows(docs: DataFrame, threshold: int) -> DataFrame:
    """Rows of two kinds, of docs (doc, text): 0, an anchor (h, c) of document doc with its windows lo to hi and its place
    after lo; 1, windows lo to hi of doc that agree with earlier ones of the same Arrow batch, as anchor and context do."""
    base.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo, size, found = [], 0, []

            def flush():
                if todo:
                    lengths = np.array([len(x) for _, _, x in todo])
                    ends = np.cumsum(lengths)
                    h, c, lo, hi, at = anchors(np.frombuffer(b"".join(x for *_, x in todo), dtype=np.uint8), ends - lengths, ends, threshold)
                    own = np.searchsorted(ends, lo, side="right")
                    back = np.array([p for _, p, _ in todo]) - (ends - lengths)
                    found.append((h.view(np.int64), c.view(np.int64), np.array([d for d, *_ in todo], dtype=np.int64)[own], lo + back[own], hi + back[own], (at - lo).astype(np.int32)))
                    todo.clear()

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                text = text or b""
                for p in range(0, max(0, len(text) - threshold + 1), PIECE):
                    piece = text[p : p + PIECE + threshold - 1]
                    todo.append((doc, p, piece))
                    size += len(piece)
                    if size >= PIECE:
                        flush()
                        size = 0
            flush()
            if found:
                h, c, doc, lo, hi, at = (np.concatenate(x) for x in zip(*found))
                o = np.lexsort((lo, doc, c, h))
                h, c, doc, lo, hi, at = (x[o] for x in (h, c, doc, lo, hi, at))
                new = (np.diff(h, prepend=~h[:1]) != 0) | (np.diff(c, prepend=~c[:1]) != 0)
                yield _rows(0, *(x[new] for x in (h, c, doc, lo, hi, at)))
                yield _marks(doc[~new], lo[~new], hi[~new])

    return docs.select("doc", "text").mapInArrow(run, _ROW)


def settled(rows: DataFrame) -> DataFrame:
    """Rows of anchor_rows as they come out once all contexts have met: 1, windows that an earlier row of the same anchor
    and context has; 0, the earliest row of each context of an anchor that stands in several. An anchor's rows come sorted
    and none are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h0 = c0 = None  # of the last row
        first, several = None, False  # the last anchor's only context so far; whether it has several
        for b in batches:
            kind = b.column(0).to_numpy()
            if kind[-1] == 1 and kind[0] == 1:
                yield b
                continue
            rows = [x.to_numpy() for x in b.columns[1:]]
            own = kind == 0
            if not own.all():
                yield b.filter(pa.array(~own))
                rows = [x[own] for x in rows]
            h, c, doc, lo, hi, _ = rows
            new_h = np.append(h0 is None or h[0] != h0, h[1:] != h[:-1])
            new = new_h | np.append(c0 is None or c[0] != c0, c[1:] != c[:-1])
            yield _marks(doc[~new], lo[~new], hi[~new])
            group = np.cumsum(new_h) - new_h[0]  # 0: goes on from the last batch, or begins here
            contexts = np.bincount(group, weights=new).astype(np.int64)
            goes_on = not new_h[0]
            if goes_on:
                contexts[0] += 2 if several else 1
            if first is not None and (not goes_on or contexts[0] > 1):
                if goes_on:
                    yield _rows(0, *first)
                first = None
            told = new & (contexts[group] > 1)
            yield _rows(0, *(x[told] for x in rows))
            several = bool(contexts[-1] > 1)
            if not several and (len(contexts) > 1 or not goes_on):
                k = np.flatnonzero(new)[-1:]
                first = [x[k] for x in rows]
            elif several:
                first = None
            h0, c0 = h[-1], c[-1]

    return rows.repartition("h").sortWithinPartitions("kind", "h", "c", "doc", "lo").mapInArrow(run, _ROW)


def asked_texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of docs whose doc may be among those of asked: a bit table spares the shuffle most others."""
    shared = docs.sparkSession.sparkContext.broadcast(base.bit_table(asked.select(F.xxhash64("doc").alias("h")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(b.num_columns - 1, "may", pa.array(base.may_hold(shared.value, b.column(b.num_columns - 1).to_numpy().view(np.uint64)).astype(bool)))

    shape = T.StructType([*docs.schema.fields, T.StructField("may", T.BooleanType())])
    return docs.withColumn("may", F.xxhash64("doc")).mapInArrow(run, shape)


def contexts(docs: DataFrame, mixed: DataFrame, threshold: int) -> DataFrame:
    """h, doc, lo, hi, at, hot, bytes of mixed (h, doc, lo, hi, at, hot): the bytes of the windows."""
    lists = mixed.groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "hi", "at", "hot")).alias("rows"))
    met = asked_texts(docs, mixed).filter("may").drop("may").join(lists, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, texts, lists = b.column("doc").to_numpy(), b.column("text").cast(pa.binary()), b.column("rows")
            for i in range(b.num_rows):
                rows, text = lists[i].values, texts[i].as_py()
                lo, hi = rows.field("lo").to_numpy(), rows.field("hi").to_numpy()
                cut = [text[x : y + threshold] for x, y in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([rows.field("h"), pa.array(np.full(len(lo), docs[i])), rows.field("lo"), rows.field("hi"), rows.field("at"), rows.field("hot"), pa.array(cut, pa.binary())], names=["h", "doc", "lo", "hi", "at", "hot", "bytes"])

    return met.select("doc", "text", "rows").mapInArrow(run, "h long, doc long, lo long, hi long, at int, hot boolean, bytes binary")


def repeated(group: np.ndarray, start: np.ndarray, data: np.ndarray, threshold: int) -> np.ndarray:
    """The suffixes (by number) of data from `start` on that agree through `threshold` bytes with one of the same group that
    has a lower number: passes over digits of eight bytes, from the most significant on, in which what is alone leaves."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    at = np.argsort(group, kind="stable")
    group = group[at]
    for depth in (*range(0, threshold - 8, 8), threshold - 8):
        digit = np.ascontiguousarray(words[start[at] + depth]).view(">u8").ravel().astype(np.uint64)
        o = np.lexsort((digit, group))
        at, group, digit = at[o], group[o], digit[o]
        new = np.append(True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])) if len(at) else np.zeros(0, dtype=bool)
        alone = new & np.append(new[1:], True)
        group = np.cumsum(new)[~alone]
        at = at[~alone]
        if not len(at):
            return at
    return at[np.append(False, group[1:] == group[:-1])]


def sorted_marks(rows: DataFrame, threshold: int) -> DataFrame:
    """doc, lo, hi of rows (h, doc, lo, hi, at, bytes): windows that agree with those of an earlier row of the same h."""
    def passes(rows: list[np.ndarray], texts: list[bytes]) -> pa.RecordBatch:
        h, doc, lo, hi, at = rows
        sizes = np.array([len(x) for x in texts])
        begin = np.cumsum(sizes) - sizes
        n = hi - lo + 1
        row = np.repeat(np.arange(len(h)), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.cumsum(np.diff(h, prepend=~h[:1]) != 0)[row] * 1024 + at[row] - j
        found = np.sort(repeated(group, begin[row] + j, np.frombuffer(b"".join(texts), dtype=np.uint8), threshold))
        row, j = row[found], j[found]
        d, a, z = _runs(doc[row], lo[row] + j, lo[row] + j) if len(row) else (doc[:0], lo[:0], lo[:0])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (d, a, z)], names=["doc", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0
        for b in batches:
            rows = [b.column(k).to_numpy() for k in range(5)]
            held.append(rows)
            texts += b.column(5).to_pylist()
            size += int((rows[3] - rows[2] + 1).sum())
            if size >= SUFFIXES:  # what belongs to whole anchors can go; the last one waits
                rows = [np.concatenate(x) for x in zip(*held)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))
                if whole:
                    yield passes([x[:whole] for x in rows], texts[:whole])
                held, texts = [[x[whole:] for x in rows]], texts[whole:]
                size = int((held[0][3] - held[0][2] + 1).sum())
        if texts:
            yield passes([np.concatenate(x) for x in zip(*held)], texts)

    return rows.select("h", "doc", "lo", "hi", "at", "bytes").repartition("h").sortWithinPartitions("h", "doc", "lo").mapInArrow(run, "doc long, lo long, hi long")


def windows(rows: DataFrame, threshold: int) -> DataFrame:
    """w1, w2, doc, s: a row for each window of rows (doc, lo, hi, bytes), with 128 bits of hash of its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("bytes").to_pylist()
            lo, hi, doc = (b.column(c).to_numpy() for c in ("lo", "hi", "doc"))
            for k in range(0, len(texts), 1 << 12):
                part = texts[k : k + (1 << 12)]
                sizes, n = np.array([len(x) for x in part]), (hi - lo + 1)[k : k + (1 << 12)]
                row = np.repeat(np.arange(len(part)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = (np.cumsum(sizes) - sizes)[row] + j
                wide = gram_hashes(np.frombuffer(b"".join(part), dtype=np.uint8), 64)
                x, y = wide[at], wide[at + threshold - 64]
                columns = [_mixed(x, y).view(np.int64), _mixed(y ^ _B, x).view(np.int64), doc[k:][row], lo[k:][row] + j]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["w1", "w2", "doc", "s"])

    return rows.select("doc", "lo", "hi", "bytes").mapInArrow(run, "w1 long, w2 long, doc long, s long")


def repeated_windows(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc, lo, hi of docs (doc long, unique and in the documents' order; text): windows of `threshold` (64 to 112) bytes
    that begin at byte lo, lo + 1, ... hi and also begin earlier, in a lower doc or in this one. Windows may be told more
    than once. Null texts have none."""
    if not 64 <= threshold <= 112:
        raise ValueError("a threshold of 64 to 112 bytes")
    found = base.stash(settled(anchor_rows(docs, threshold)))
    mixed = found.filter("kind = 0").select("h", "doc", "lo", "hi", "at")
    crowded = mixed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TOGETHER).select("h", F.lit(True).alias("hot"))
    mixed = base.stash(mixed.join(crowded, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False))))
    bytes_of = base.stash(contexts(docs, mixed, threshold))
    few = sorted_marks(bytes_of.filter("not hot"), threshold)
    each = base.stash(windows(bytes_of.filter("hot"), threshold))
    firsts = each.groupBy("w1", "w2").agg(F.min(F.struct("doc", "s")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2", "first")
    many = base.join_hot(each, firsts, ["w1", "w2"], F.col("doc")).filter((F.col("doc") != F.col("first.doc")) | (F.col("s") != F.col("first.s"))).select("doc", F.col("s").alias("lo"), F.col("s").alias("hi"))
    return found.filter("kind = 1").select("doc", "lo", "hi").unionByName(few).unionByName(many)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) with `doc`, unique and in order: the doc_id where these are unique and not null; else the
    place in the order of doc_id (null last) and the text's digest, equal texts of one doc_id in any order."""
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint") and twice.isEmpty():
        return docs.withColumn("doc", F.col("doc_id").cast("long"))
    placed = order.numbered(docs.withColumn("_like", F.md5(F.coalesce("text", F.lit("")))), [F.col("doc_id").asc_nulls_last(), F.col("_like")], "doc")
    return base.stash(placed.drop("_like").withColumn("doc", F.col("doc").cast("long")))


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """row (a struct of docs' columns), n_bytes, spans (array of start and end of the removed runs, in bytes of the UTF-8
    text, in order) and kept (binary: what is left) of each row of docs (doc_id, text, ...).

    A byte goes if it lies in a string of `threshold` bytes that also starts earlier: in a smaller doc_id, or in the same
    document before. Strings are judged on the whole input, never across documents. Null texts are empty. Rows of one
    doc_id (or without one, which come last) are documents of their own, in the order of their texts' digests. An empty
    table gives no rows; columns may have any name.
    """
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"))
    marks = base.stash(repeated_windows(rows.select("doc", "text"), threshold))
    lists = marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    parts = asked_texts(rows.select("row", "doc", data.alias("data")), marks)
    spans = "array<struct<start:bigint,end:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lists, out, kept = b.column("data"), b.column("marks"), [], []
            for i in range(b.num_rows):
                text = texts[i].as_py()
                if not lists[i].is_valid:
                    out.append([])
                    kept.append(text)
                    continue
                lo, end = lists[i].values.field("lo").to_numpy(), lists[i].values.field("hi").to_numpy() + threshold
                o = np.argsort(lo, kind="stable")
                lo, end = lo[o], np.maximum.accumulate(end[o])
                cut = np.flatnonzero(np.append(True, lo[1:] > end[:-1]))
                lo, end = lo[cut].tolist(), np.append(end[cut[1:] - 1], end[-1]).tolist()
                out.append([{"start": x, "end": y} for x, y in zip(lo, end)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *end], [*lo, len(text)])))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([len(x.as_py()) for x in texts], pa.int64()), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["row", "n_bytes", "spans", "kept"])

    met = parts.filter("may").drop("may").join(lists, "doc", "left")
    shape = f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, spans {spans}, kept binary"
    changed = met.select("row", "data", "marks").mapInArrow(run, shape)
    same = parts.filter("not may").select("row", F.octet_length("data").cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"), F.col("data").alias("kept"))
    return changed.unionByName(same)


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    found = without_repeats(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n_bytes FROM d),
w AS (SELECT doc_id, s, substr(x, 2 * s + 1, 200) AS win FROM (SELECT doc_id, x, unnest(range(0, greatest(n_bytes - 99, 0))) AS s FROM n)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM r),
i AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
spans AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM i GROUP BY doc_id, run),
holes AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
cut AS (SELECT h.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept, max(hi) AS after, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM holes h JOIN n USING (doc_id) GROUP BY h.doc_id)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * after + 1), x))) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)
"""

QUERIES, SQL = {"op11_suffixes": op11_suffixes}, {"op11_suffixes": _SQL}
