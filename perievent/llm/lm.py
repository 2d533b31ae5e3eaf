"""Language-model scoring by context-tree weighting over bytes.

A text is its bytes and then its end, which is coded as a byte that UTF-8 never uses, so that the probabilities of all
texts sum to one. A byte is eight binary decisions, each with its own tree of contexts: no byte, the last byte, and so on
to the last `depth`. A node holds Krichevsky-Trofimov counts of its decision; its weighted probability is half its own estimate and
half the product of its children's. A text's code length mixes the estimates of all depths with the weights that
training gave them; where training hasn't seen a context, the deepest one that it has seen takes all the weight that is
left. The tree is a table of Spark's, one row a node, worked out bottom-up by one aggregate a depth and top-down by one
join a depth; it grows with the corpus and nothing is pruned.

Runs of depth + 1 bytes that make up at least 2^-22 of all (there can't be more than 2^22 of those) are looked up in the
task that reads the text, all others by a join; the score is the same. So are words, under 2^-18, of the word score: that
of a unigram model with add-one smoothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.llm import base

FOLDS, HELD = 7, 2
#: Bytes of context, a parameter of `score`: six at most, as a run and a decision share 64 bits. Six spend fewer digits
#: than four, but the tree has about nine times the nodes.
DEPTH, DEEPEST = 4, 6
#: The byte that stands for a text's end.
END = b"\xff"
#: Words and runs of bytes of which one makes up so many parts of all, or more, are looked up in tasks.
FREQUENT, COMMON = 1 << 18, 1 << 22
#: Runs of bytes that a task holds before it hands its counts on.
HELD_RUNS = 1 << 20
#: Distinct words that a task counts before it hands its counts on.
COUNTED = 400_000


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, held: int = HELD):
    """Whether crc32(doc_id as text) leaves the remainder held (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == held


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after seven steps up."""
    steps = np.ones_like(x)
    for k in range(7):
        steps = steps * (x + k)
    z = x + 7
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(steps)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - np.log(np.pi) - lgamma(zeros + ones + 1.0)


def contexts(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every byte of the texts, their ends included, the `depth` bytes before it in one number (the last in the lowest
    bits), and the bytes of each text; before a text there are zero bytes."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join([t + END for t in texts]), dtype=np.uint8).astype(np.int64)
    context = np.zeros_like(data)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    for k in range(1, depth + 1):
        before = np.zeros_like(data)
        before[k:] = data[:-k]
        for i in range(k):  # the first bytes of a text see none of the text before
            before[(starts + i)[starts + i < ends]] = 0
        context |= before << 8 * (k - 1)
    return data, context, sizes


def pieces(texts: list[bytes | None], size: int = 1 << 21) -> Iterator[list[bytes]]:
    """The texts in lists of about so many bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t or b"")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def count(docs: DataFrame, depth: int) -> DataFrame:
    """(word, gram, n): of docs.text, how often each word and each run of depth + 1 bytes occur; the row of neither counts
    docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs_seen = Counter(), 0
        runs, times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.nulls(len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["word", "gram", "n"])
            counts.clear()
            return out

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.nulls(len(runs), pa.binary()), pa.array(runs), pa.array(times)], names=["word", "gram", "n"])

        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            docs_seen += len(texts)
            for part in pieces(texts):
                for t in part:
                    counts.update(t.lower().split())
                    if len(counts) > COUNTED:
                        yield handed()
                data, context, _ = contexts(part, depth)
                found, n = np.unique((context << 8) | data, return_counts=True)
                both, row = np.unique(np.concatenate([runs, found]), return_inverse=True)
                times = np.bincount(row, weights=np.concatenate([times, n]), minlength=len(both)).astype(np.int64)
                runs = both
                if len(runs) > HELD_RUNS:
                    yield counted()
                    runs, times = runs[:0], times[:0]
        if counts:
            yield handed()
        yield counted()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([docs_seen], pa.int64())], names=["word", "gram", "n"])

    base.small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def with_decisions(grams: DataFrame) -> DataFrame:
    """grams (gram, ...) with a row for each of the last byte's eight decisions: node (the context, then the decision: 1,
    then the bits before) and bit."""
    byte = F.col("gram").bitwiseAND(F.lit(255))
    levels = F.array(*[F.struct((F.shiftright(byte, 8 - k) + F.lit(1 << k)).alias("p"), F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1)).alias("bit")) for k in range(8)])
    rows = grams.withColumn("level", F.explode(levels))
    return rows.withColumns({"node": F.col("gram") - byte + F.col("level.p"), "bit": F.col("level.bit")}).drop("level")


def at_depth(node, depth: int):
    """The node with only the last `depth` bytes of context."""
    return node.bitwiseAND(F.lit((1 << 8 * (depth + 1)) - 1))


def weighed(nodes: DataFrame) -> DataFrame:
    """node, zeros, ones, both, own, one of nodes (node, zeros, ones, below): the log weighted probability, the weight of
    the node's own estimate and that estimate of a one. below is null at the deepest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zeros, ones, below = (b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("zeros", "ones", "below"))
            kt = kt_block(zeros, ones)
            inner = ~np.isnan(below)
            both, own = kt.copy(), np.ones_like(kt)
            both[inner] = np.logaddexp(kt[inner], below[inner]) - np.log(2)
            own[inner] = np.exp(kt[inner] - np.log(2) - both[inner])
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("zeros"), b.column("ones"), pa.array(both), pa.array(own), pa.array((ones + 0.5) / (zeros + ones + 1.0))], names=["node", "zeros", "ones", "both", "own", "one"])

    return nodes.select("node", "zeros", "ones", F.col("below").cast("double").alias("below")).mapInArrow(run, "node long, zeros long, ones long, both double, own double, one double")


def tree(grams: DataFrame, deepest: int) -> list[DataFrame]:
    """By depth, (node, guess) of counted runs of deepest + 1 bytes (gram, n): the probability of a one where this is the
    deepest node that training has seen."""
    zero = F.col("bit") == 0
    counted = with_decisions(grams).groupBy("node").agg(F.sum(F.when(zero, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(zero, 0).otherwise(F.col("n"))).alias("ones"))
    levels = [base.stash(weighed(counted.withColumn("below", F.lit(None).cast("double"))))]
    for depth in range(deepest - 1, -1, -1):
        up = levels[0].groupBy(at_depth(F.col("node"), depth).alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("both").alias("below"))
        levels.insert(0, base.stash(weighed(up)))
    # before: what shorter contexts have said; left: the weight that they leave to this one and deeper ones.
    out, above = [], None
    for depth, level in enumerate(levels):
        if above is None:
            met = level.withColumns({"before": F.lit(0.0), "left": F.lit(1.0)})
        else:
            met = level.withColumn("up", at_depth(F.col("node"), depth - 1)).join(above, "up")
        said = met.select("node", (F.col("before") + F.col("left") * F.col("one")).alias("guess"), (F.col("before") + F.col("left") * F.col("own") * F.col("one")).alias("before"), (F.col("left") * (1 - F.col("own"))).alias("left"))
        said = base.stash(said)
        out.append(said.select("node", "guess"))
        above = said.select(F.col("node").alias("up"), "before", "left")
    return out


def chance(guess, bit):
    return F.log10(F.when(bit == 1, guess).otherwise(1 - guess))


def seen_values(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(gram, value): log10 probability of the last byte of runs that training has seen."""
    return with_decisions(grams.select("gram")).join(nodes[-1], "node").groupBy("gram").agg(F.sum(chance(F.col("guess"), F.col("bit"))).alias("value"))


def unseen_values(grams: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """(gram, value) of any distinct runs: each decision is guessed by the deepest of its nodes that training has seen, by
    one half if it has seen none."""
    rows = with_decisions(grams.select("gram"))
    found = base.union_all([rows.select("gram", "bit", F.col("node").alias("whole"), at_depth(F.col("node"), d).alias("node"), F.lit(d).alias("depth")).join(nodes[d], "node") for d in range(len(nodes))])
    # Decisions differ in the node's last byte, so the whole node tells them apart.
    best = found.groupBy("gram", "whole", "bit").agg(F.max_by("guess", "depth").alias("guess"))
    told = best.groupBy("gram").agg(F.sum(chance(F.col("guess"), F.col("bit"))).alias("value"), F.count(F.lit(1)).alias("n"))
    return grams.select("gram").join(told, "gram", "left").select("gram", (F.coalesce("value", F.lit(0.0)) + (8 - F.coalesce("n", F.lit(0))) * F.lit(math.log10(0.5))).alias("value"))


class CommonRuns:
    """Scores what it knows of texts, and lists the runs that it doesn't."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, depth: int):
        self.grams, self.values, self.depth = grams, values, depth

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums by text; then text, run and number of the runs that aren't known."""
        data, context, sizes = contexts(texts, self.depth)
        found, where = np.unique((context << 8) | data, return_inverse=True)
        value, known = np.zeros(len(found)), np.zeros(len(found), dtype=bool)
        if len(self.grams):
            at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
            known = self.grams[at] == found
            value[known] = self.values[at[known]]
        out = np.add.reduceat(value[where], np.cumsum(sizes) - sizes) if len(texts) else np.zeros(0)
        rare = np.flatnonzero(~known[where])
        text = np.searchsorted(np.cumsum(sizes), rare, side="right")
        pair, n = np.unique(np.stack([text, where[rare]], axis=1), axis=0, return_counts=True) if len(rare) else (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64))
        return out, pair[:, 0], found[pair[:, 1]], n


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, text), from contexts of up to
    `depth` bytes (0 to DEEPEST).

    A null text is an empty one: one token (the end), and the score is that of its end. Repeated rows are scored each and,
    unless held out, counted each. With nothing to learn from, every word is unknown, N = V = 0, and the probability of
    a byte, or of the end, is 1/256.
    Other columns are left out. No rows give no rows.
    """
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"depth is 0 to {DEEPEST}, not {depth}")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    counts = base.stash(count(docs.filter(~F.col("held_out")), depth))
    known = counts.filter("word is not null")
    n_docs = counts.filter("word is null and gram is null").agg(F.sum("n")).first()[0] or 0
    tokens, distinct = known.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, vocabulary = (tokens or 0) + n_docs, distinct + (n_docs > 0)
    frequent = {bytes(r["word"]): r["n"] for r in known.filter(F.col("n") >= max(1.0, total / FREQUENT)).toLocalIterator()}
    grams = counts.filter("gram is not null").select("gram", "n")
    nodes = tree(grams, depth)
    values = base.stash(seen_values(grams, nodes).join(grams, "gram"))
    n_bytes = grams.agg(F.sum("n")).first()[0] or 0
    common = values.filter(F.col("n") >= max(1.0, n_bytes / COMMON)).select("gram", "value").toArrow()  # COMMON rows at most
    places = np.argsort(common.column("gram").to_numpy())
    floor = float(np.log10(total + vocabulary + 1))
    shared = spark.sparkContext.broadcast(({w: (n, float(np.log10(n + 1)) - floor) for w, n in frequent.items()}, common.column("gram").to_numpy()[places], common.column("value").to_numpy()[places]))
    end = float(np.log10(n_docs + 1)) - floor
    lists = pa.list_(pa.struct([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, known_grams, known_values = shared.value
        runs, at = CommonRuns(known_grams, known_values, depth), TaskContext.get().partitionId() << 40
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            n_tokens, n_known, base_score, rare = [], [], [], []
            for t in texts:
                found = t.lower().split()
                sure, logs, others = int(n_docs > 0), end, []
                for w, n in Counter(found).items():
                    hit = lookup.get(w)
                    if hit is None:
                        others.append({"word": w, "n": n})
                    else:
                        sure += n
                        logs += n * hit[1]
                n_tokens.append(len(found) + 1)
                n_known.append(sure)
                base_score.append(logs)
                rare.append(others)
            scores, done = [], 0
            for part in pieces(texts):
                sums, text, gram, n = runs.scores(part)
                scores.append(sums)
                for i, g, k in zip((text + done).tolist(), gram.tolist(), n.tolist()):
                    rare[i].append({"gram": g, "n": k})
                done += len(part)
            key = pa.array(range(at, at + len(texts)), pa.int64())
            at += len(texts)
            yield pa.RecordBatch.from_arrays([key, b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base_score, pa.float64()), pa.array(np.concatenate(scores) if scores else np.zeros(0)), pa.array(rare, lists)], names=["key", "doc_id", "held_out", "n_tokens", "known", "logs", "sums", "rare"])

    base.small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    read = base.stash(docs.mapInArrow(run, f"key long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, sums double, rare array<struct<word:binary,gram:long,n:long>>"))
    rest = read.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.gram", F.col("r.n").alias("times"))
    looked = rest.filter("word is not null").join(known.select("word", "n"), "word", "left")
    words = looked.select("key", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("more"), (F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1.0) - floor)).alias("more_logs"), F.lit(0.0).alias("more_sums"))
    asked = rest.filter("gram is not null")
    unseen = base.stash(unseen_values(base.stash(asked.select("gram").distinct().join(values, "gram", "left_anti")), nodes))
    told = asked.join(values.select("gram", "value").unionByName(unseen), "gram")
    runs = told.select("key", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("more_logs"), (F.col("times") * F.col("value")).alias("more_sums"))
    more = words.unionByName(runs).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("more", "more_logs", "more_sums")])
    whole = read.drop("rare").join(more, "key", "left")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("base_score"), (F.col("sums") + F.coalesce("more_sums", F.lit(0.0))).alias("score"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores, learned from those whose id isn't held out."""
    return score(base.table(spark, sf_dir, "documents"))


QUERIES, SQL = {"op10_lm": op10_lm}, {}
