"""Language identification by a convolutional network over bytes, trained in numpy.

A text is cut into fixed-length windows. Filters of several widths slide over a window's bytes; each filter's largest
response (max pooling, cut at zero) feeds a softmax over the languages. A text's probabilities are the mean of its
windows', weighted by their bytes. A filter is a sum of per-byte terms, so two neighbouring terms are looked up
together in a table over byte pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.llm import base
from perievent.llm.lm import held_out

FOLDS, HELD = 4, 2
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Labelled documents of each language to learn from, about (a hash decides), and windows of each.
SAMPLE, WINDOWS_OF = 600, 4
UNKNOWN = "und"


def windows(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end -> (windows padded with zero bytes, each one's text, each one's bytes)."""
    parts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * WINDOW
    n = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < n[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8), owner, n


class ByteCNN:
    """terms[w]: (w, 256, FILTERS) per-byte terms of the filters of width w; bias, weights, shift: the rest."""

    def __init__(self, labels: list[str], rng: np.random.Generator):
        self.labels = labels
        self.terms = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
        self.weights = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), dtype=np.float32)

    def responses(self, x: np.ndarray, w: int) -> np.ndarray:
        n = x.shape[1] - w + 1
        return sum(self.terms[w][j][x[:, j : j + n]] for j in range(w))

    def softmax(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights + self.shift
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 12, batch: int = 64, rate: float = 0.01) -> ByteCNN:
        """Cross entropy by Adam; a window counts by the inverse of its language's share."""
        slots = [*self.terms.values(), *self.bias.values(), self.weights, self.shift]
        first, second, step = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots], 0
        share = len(y) / (len(self.labels) * np.maximum(1, np.bincount(y, minlength=len(self.labels))))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                bx, by, rows = x[some], y[some], np.arange(len(some))
                best, features = {}, []
                for w in WIDTHS:
                    r = self.responses(bx, w)
                    best[w] = r.argmax(axis=1)
                    features.append(np.take_along_axis(r, best[w][:, None], axis=1)[:, 0] + self.bias[w])
                features = np.concatenate(features, axis=1)
                pooled = np.maximum(features, 0)
                g = self.softmax(pooled)
                g[rows, by] -= 1
                g *= (share[by] / len(some))[:, None].astype(np.float32)
                back = (g @ self.weights.T) * (features > 0)
                grads, bias_grads = [], []
                for k, w in enumerate(WIDTHS):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    t = np.zeros_like(self.terms[w])
                    for j in range(w):
                        np.add.at(t[j], (np.take_along_axis(bx, best[w] + j, axis=1), np.arange(FILTERS)), part)
                    grads.append(t)
                    bias_grads.append(part.sum(axis=0))
                step += 1
                for s, m, v, d in zip(slots, first, second, [*grads, *bias_grads, pooled.T @ g, g.sum(axis=0)]):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    s -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width, lookups (offset, table): over byte pairs, and over a byte for an odd width's last term."""
        out = []
        for w in WIDTHS:
            looks = [(j, (self.terms[w][j][:, None] + self.terms[w][j + 1][None]).reshape(1 << 16, FILTERS)) for j in range(0, w - 1, 2)]
            out.append((w, looks + [(w - 1, self.terms[w][w - 1])] * (w % 2)))
        return out

    def probabilities(self, x: np.ndarray, tables: list, batch: int = 512) -> np.ndarray:
        out = np.zeros((len(x), len(self.labels)), dtype=np.float32)
        for at in range(0, len(x), batch):
            b = x[at : at + batch]
            pair = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            features = []
            for w, looks in tables:
                n = WINDOW - w + 1
                r = None
                for j, t in looks:
                    got = t.take(pair[:, j : j + n] if len(t) > 256 else b[:, j : j + n], axis=0)
                    r = got if r is None else np.add(r, got, out=r)
                features.append(np.maximum(r.max(axis=1) + self.bias[w], 0))
            out[at : at + batch] = self.softmax(np.concatenate(features, axis=1))
        return out


def train(docs: DataFrame, sample: int = SAMPLE, seed: int = 7) -> ByteCNN | None:
    """Learns from docs (doc_id, text, lang) with a lang and a text: about `sample` documents of each language, by a
    hash of doc_id and text, WINDOWS_OF windows of each (the bound: 2 * sample * WINDOWS_OF windows a language).
    Without any, there is no network."""
    labelled = docs.filter("lang is not null and text is not null and length(text) > 0").withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) / F.lit(float(1 << 53)))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(sample / n))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, part = [], []
            for k, t, u in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                t, rng = t.lower(), np.random.default_rng(int(u * (1 << 53)))
                all_ = -(-len(t) // WINDOW)
                for i in sorted(rng.choice(all_, min(WINDOWS_OF, all_), replace=False).tolist()):
                    lang.append(k)
                    part.append(t[i * WINDOW : (i + 1) * WINDOW].ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(part, pa.binary())], names=["lang", "part"])

    base.small_batches(docs.sparkSession)
    rows = labelled.filter(F.col("u") < F.element_at(share, F.col("lang"))).select("lang", "text", "u").mapInArrow(cut, "lang string, part binary").collect()
    rows = sorted((r["lang"], bytes(r["part"])) for r in rows)
    kept, seen = [], dict.fromkeys(counts, 0)
    for k, part in rows:
        seen[k] += 1
        if seen[k] <= 2 * sample * WINDOWS_OF:
            kept.append((k, part))
    labels = sorted({k for k, _ in kept})
    x = np.frombuffer(b"".join(p for _, p in kept), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([labels.index(k) for k, _ in kept])
    rng = np.random.default_rng(seed)
    return ByteCNN(labels, rng).fit(x, y, rng)


def identify(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """docs (doc_id, text, ...) with lang_pred and score. und with score 0 for a null text, a text without a letter,
    or without a network. Whole texts are read; other columns pass through, one of those names gives way."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    spark = docs.sparkSession
    base.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = F.struct(*([F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(1).alias("none")])).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.tables()
        for b in batches:
            texts = [(t or b"").lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
            total, lo, size = np.zeros((len(texts), len(net.labels))), 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t)
                if size >= 1 << 21 or hi == len(texts):
                    part = texts[lo:hi]
                    if size:
                        x, owner, n = windows(np.frombuffer(b"".join(part), dtype=np.uint8), np.array([len(p) for p in part], dtype=np.int64))
                        np.add.at(total[lo:hi], owner, net.probabilities(x, tables) * n[:, None])
                    lo, size = hi, 0
            best = total.argmax(axis=1)
            score = total.max(axis=1) / np.maximum(1e-9, total.sum(axis=1))
            letters = b.column("has_letter").to_pylist()
            lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lang, pa.string()), pa.array([s if ok else 0.0 for s, ok in zip(score.tolist(), letters)], pa.float64())], names=["row", "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    asked = docs.select(rest, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    return asked.mapInArrow(run, StructType([asked.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])).select("row.*", "lang_pred", "score")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the others."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", FOLDS, HELD).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text", "held_out"), model)


QUERIES, SQL = {"op9_langid": op9_langid}, {}
