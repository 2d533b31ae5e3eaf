"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

A rule has measures that it needs as columns, and a condition on which it rejects, into which its own measures are
written. On a bounded sample each rule's cost (time that it adds to reading the sample) and selectivity (share rejected)
are estimated; rules then run in the order of rejection per cost, and what one rule rejects isn't measured for the next.
The order never changes the verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.llm import base

SYMBOLS = "#*$%&|<>"
#: Documents on which the rules' costs are estimated, and how often each is timed (the least time counts).
SAMPLE, TIMES = 500, 2
#: Places that fit beside a hash in one long.
PACKED = 1 << 17


def found(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def n_of(text: str, chars: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(found(text)) - F.length(F.translate(found(text), chars, ""))).cast("long")


def n_word_chars(text: str) -> Column:
    return F.length(F.translate(found(text), " \t\n\x0b\x0c\r", "")).cast("long")


def lines(text: str) -> Column:
    """The lines with a word."""
    return F.filter(F.split(found(text), "\n", -1), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)


def n_dup(some: Column) -> Column:
    return (F.size(some) - F.size(F.array_distinct(some))).cast("long")


def m_words(df: DataFrame, text: str) -> DataFrame:
    return _held(df.withColumn("_words", base.words(F.col(text))).withColumn("n_words", F.size("_words").cast("long")))


def m_repeats(df: DataFrame, text: str) -> DataFrame:
    """n_repeat_words: the words in three-word windows that occur twice or more. A window's hash and its place share a
    long, sorted as such; up to PACKED words that leaves 47 bits of hash or more. Longer texts sort (hash, place).
    Windows of equal hash are compared by their words; a text in which they differ is sorted by the words themselves."""
    w = F.col("_words")
    n = F.size(w)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    alike = lambda i, j: (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))
    places = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    bits = F.ceil(F.log2(n + 1.0)).cast("int")
    low = F.expr("shiftleft(1L, _bits) - 1L")
    df = _held(df.withColumn("_bits", bits))
    packed = F.sort_array(F.transform(places, lambda i: window(i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    empty = F.expr("array()").cast("array<bigint>")
    df = _held(df.withColumn("_packed", F.when((n >= 4) & (n <= PACKED), packed).otherwise(empty)))
    p, at = F.col("_packed"), lambda x: x.bitwiseAND(low).cast("int")
    same = lambda a, b: F.coalesce((a.bitwiseXOR(b) <= low) & (a.bitwiseXOR(b) >= 0), F.lit(False))
    df = _held(df.withColumn("_twice", F.transform(F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))), lambda x: x.bitwiseAND(low))))
    clash = F.exists(F.filter(p, lambda x, i: same(x, F.get(p, i + 1)) & ~alike(at(x), at(F.get(p, i + 1)))), lambda x: F.lit(True))
    beside = lambda s: F.transform(F.filter(s, lambda x, i: F.coalesce(x.h == F.get(s, i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False))), lambda x: x.i)
    by_words = base.let(F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i")))), beside)
    sorted_ = F.array_sort(F.transform(places, lambda i: F.struct(window(i).alias("h"), i.cast("long").alias("i"))))
    differ = lambda s: F.exists(F.filter(s, lambda x, i: F.coalesce(x.h == F.get(s, i + 1).h, F.lit(False)) & ~alike(x.i.cast("int"), F.get(s, i + 1).i.cast("int"))), lambda x: F.lit(True))
    wide = base.let(sorted_, lambda s: F.when(differ(s), by_words).otherwise(beside(s)))
    df = _held(df.withColumn("_starts", F.sort_array(F.when(n > PACKED, wide).when(F.size("_twice") == 0, F.col("_twice")).when(clash, by_words).otherwise(F.col("_twice")))))
    s = F.col("_starts")
    covered = F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(s, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.withColumn("n_repeat_words", F.when(F.size(s) > 0, covered).otherwise(F.lit(0).cast("long"))).drop("_bits", "_packed", "_twice", "_starts")


def _held(df: DataFrame) -> DataFrame:
    """df with a column that keeps the optimizer from working an expression out again for each use above it."""
    return df.withColumn("_row", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Rule:
    """needs: add columns that a rule shares with others; rejects(text column): the condition, with what else the rule
    measures written into it, so that it is worked out only where the rule is asked."""

    name: str
    needs: tuple[Callable[[DataFrame, str], DataFrame], ...]
    rejects: Callable[[str], Column]


def few_words(least: int) -> Rule:
    return Rule(f"few_words_{least}", (m_words,), lambda text: F.col("n_words") < least)


REPEATS = Rule("repeats", (m_words, m_repeats), lambda text: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
#: The base rules, then those of the method.
BASE = (few_words(50), REPEATS)
OWN = (
    Rule("symbols", (m_words,), lambda text: 10 * n_of(text, SYMBOLS) > F.col("n_words")),
    Rule("shouts", (m_words,), lambda text: 4 * n_of(text, "!") > F.col("n_words")),
    Rule("dup_lines", (), lambda text: base.let(lines(text), lambda x: base.let(n_dup(x), lambda d: (d >= 3) & (100 * d > 30 * F.size(x))))),
    Rule("word_length", (m_words,), lambda text: base.let(n_word_chars(text), lambda x: (x < 2 * F.col("n_words")) | (x > 15 * F.col("n_words")))),
)
RULES = (*BASE, *OWN)
#: What a corpus loses: a short text that is clean otherwise stays, one without a word goes.
FILTER = (few_words(1), REPEATS, *OWN)


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The rules by rejection per cost on the first `sample` documents that Spark returns, best first. A rule's cost is
    the least time of TIMES jobs over the sample less that of jobs that only split words, which all share; the first job
    of each, which compiles it, doesn't count. Costs within a factor of two count as equal."""
    some = base.stash(docs.select(F.col(f"`{text}`").alias("text")).limit(sample).coalesce(1))

    def timed(needs: tuple, rejects: Column) -> tuple[float, int, int]:
        df, took = some, []
        for m in needs:
            df = m(df, "text")
        job = df.agg(F.count(F.lit(1)), F.sum(rejects.cast("int")))
        for _ in range(TIMES + 1):
            began = time.perf_counter()
            n, out = job.first()
            took.append(time.perf_counter() - began)
        return min(took[1:]), n, out or 0

    least = timed((m_words,), F.col("n_words") < 0)[0]
    scored = []
    for k, rule in enumerate(rules):
        took, n, out = timed(rule.needs, rule.rejects("text"))
        cost = round(math.log2(max(took - least, 0.1 * least)))
        scored.append((-math.log2((out + 1) / (n + 1)) + cost, k, rule))
    return [r for *_, r in sorted(scored, key=lambda x: x[:2])]


def measured(df: DataFrame, needs, text: str) -> DataFrame:
    for m in dict.fromkeys(needs):
        df = m(df, text)
    return df


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, with docs' columns as they were, whatever their names. Rules run in the order
    estimated on docs; each one's measures are worked out on what the rules before it left. A null text counts as an empty
    one (no words). Repeated rows get the same verdict each; no rows give no rows."""
    df, had = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text")), set()
    for rule in order(docs, rules, text):
        df = measured(df, [m for m in rule.needs if m not in had], "text")
        had.update(rule.needs)
        df = _held(df).filter(~rule.rejects("text") & (F.col("_row") >= 0))
    return df.select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document. The base columns are asked of every text; the
    method's own rules run as a cascade on those that the base and the rules before them leave."""
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    df = measured(docs, [m for r in RULES for m in r.needs], "text")
    failed = F.coalesce(BASE[0].rejects("text") | BASE[1].rejects("text"), F.lit(False))
    df = df.withColumn("_failed", failed)
    verdict = F.lit(True)
    for rule in reversed(order(docs, OWN)):  # the first rule of the cascade is asked first
        verdict = F.when(rule.rejects("text"), F.lit(False)).otherwise(verdict)
    return df.select("doc_id", "n_words", n_word_chars("text").alias("word_chars"), n_of("text", SYMBOLS).alias("n_symbols"), n_dup(lines("text")).alias("n_dup_lines"), "n_repeat_words", F.col("_failed").alias("base_failed"), F.when(F.col("_failed"), F.lit(False)).otherwise(verdict).alias("kept"))


SQL_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
p AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + k AS at FROM c, (VALUES (0), (1), (2)) v(k)) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(replace(text, '!', '')) AS n_shouts
 FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT (10 * n_symbols > n_words OR 4 * n_shouts > n_words OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM b
"""

QUERIES, SQL = {"op4_quality": op4_quality}, {"op4_quality": SQL_OP4}
