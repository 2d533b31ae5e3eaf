"""Token counts by byte-pair merging on a heap over a linked list.

A word's symbols form a doubly linked list; a heap holds its adjacent pairs by merge rank. The lowest pair is popped
and merged, its new neighbours are pushed, stale entries are skipped. The count is the symbols at the start less the
merges; no token identifier is made. Each distinct word of a batch of texts is merged once.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base

LIMIT = 2048
#: Words whose counts a task remembers; beyond, the memory starts anew.
REMEMBERED = 400_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the others follow from U+0100 in order."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(rest)}


class PairCounter:
    """Counts a text's tokens under a merge list with word ends, as read from a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): n for n, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.known: dict[str, int] = {}

    def count_word(self, word: str) -> int:
        symbols: list[str | None] = [self.letters[b] for b in word.encode("utf-8")]
        n = len(symbols)
        if not n:
            return 0
        symbols[-1] += self.end
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, merges = self.rank, 0
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one side was merged meanwhile
            symbols[i], symbols[j], merges = left + right, None, merges + 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return n - merges

    def normal(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case letter by letter (so a final capital sigma is like any)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, at = 0, 0
        if "<|" in text:
            for m in self.special.finditer(text):
                total += 1 + self._count(text[at : m.start()])
                at = m.end()
        return total + self._count(text[at:] if at else text)

    def _count(self, text: str) -> int:
        known, total = self.known, 0
        for word, times in Counter(self.split.findall(self.normal(text))).items():
            n = known.get(word)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = self.count_word(word)
                if len(word) <= 64:
                    known[word] = n
            total += n * times
        return total


def count_tokens(rows: DataFrame, text: str, path: str, into: str = "n_tokens") -> DataFrame:
    """rows with a column `into` (long): the tokens of each text under the vocabulary file at path.

    A null or empty text has 0 tokens; special tokens' strings inside a text count as one token each. All other
    columns pass through as they are; a column of that name gives way. An empty table gives no rows.
    """
    base.small_batches(rows.sparkSession)
    rows = rows.drop(into)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.LongType())])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PairCounter(path)
        for b in batches:
            n = pa.array([counter.count(t) for t in b.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, into])

    return rows.mapInArrow(run, schema)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, "text", public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES, SQL = {"op5_tokens": op5_tokens}, {}
