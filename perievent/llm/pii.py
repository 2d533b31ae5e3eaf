"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions alone.

Base spans are the seeds of their kinds; long tokens of letters and digits mixed are the seeds of a further kind, secret.
The words around a seed are its lexical patterns: the last word before it, the last two, and the last before with the
first after. A pattern's instances are the identifier-like stretches (tokens with a digit or an @, groups of digits over
several tokens, spelled-out addresses) in the same words anywhere. Spark scores the graph of patterns and instances in
rounds: a pattern's confidence for a kind is the mean score of its distinct instances (a seed's is 1), an instance's
score the best confidence of its patterns. A pattern needs enough seeds or confident instances, so what one round finds
induces patterns in the next. Confident patterns give their kind to the instances that no base pattern knows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.llm import base

KINDS = ("email", "ip", "card", "phone")
#: What only the method finds.
SECRET = "secret"
ROUNDS, CONFIDENT, SEEDS = 3, 0.8, 5
#: Code points before an identifier in which its context is looked for.
CONTEXT = 64

_LOCAL = "A-Za-z0-9._%+-"
#: What the base patterns match, written so that no run of characters is read more than twice (a match may start at a
#: run's first character or where the last match ended, nothing is given back).
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPACE, _TOKEN = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
_DIGITS = r"[0-9()+./-]*[0-9][0-9()+./-]*"
#: An identifier-like stretch of whole tokens: groups of digits, a spelled-out address, or a token with a digit or an @.
LIKE = rf"""(?<!{_TOKEN})(?:{_DIGITS}(?:\x20{_DIGITS})+[,;:!?"'\]>]*+(?!{_TOKEN})|{_TOKEN}++\x20[(\[]?at[)\]]?\x20{_TOKEN}++\x20[(\[]?dot[)\]]?\x20{_TOKEN}++|(?={_TOKEN}*[0-9@]){_TOKEN}{{5,}})"""
MARKS = r"^[^\p{L}\p{N}+(]+|[^\p{L}\p{N})]+$"
#: A seed of the kind secret, around which marks may stand.
SECRET_LIKE = r"^[^0-9A-Za-z]*(?=[0-9_-]*[A-Za-z])(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{32,}[^0-9A-Za-z]*$"

SPANS = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def prefix_sums(x: Column, block: int = 64) -> Column:
    """Running sums of an array of longs, in blocks, so that long arrays aren't summed anew for each element."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda p, q: p + q)

    def within(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        before = base.let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return base.let(before, lambda s: F.transform(a, lambda _, i: F.get(s, F.floor(i / block).cast("int")) + total(F.slice(a, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return base.let(x, within)


def spans(text: Column, pattern: str, asked: Column) -> Column:
    """The matches of a pattern in text as SPANS: code points, end exclusive; before and after: the CONTEXT code points
    between a match and its neighbours."""
    none = F.lit(None).cast(SPANS)

    def placed(s: Column) -> Column:
        gaps = F.transform(s.m, lambda m, i: (F.length(F.get(s.p, i)) + F.coalesce(F.length(F.get(s.m, i - 1)), F.lit(0))).cast("long"))
        return base.let(prefix_sums(gaps), lambda at: F.transform(s.m, lambda m, i: F.struct(F.get(at, i).alias("start"), (F.get(at, i) + F.length(m)).alias("end"), m.alias("value"), F.right(F.get(s.p, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s.p, i + 1), F.lit(CONTEXT)).alias("after"))))

    cut = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"))
    return F.coalesce(F.when(asked, base.let(cut, lambda s: F.when(F.size(s.m) > 0, placed(s)))), none, F.expr("array()").cast(SPANS))


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    def total(d: Column) -> Column:
        n = F.length(d)
        place = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")
        doubled = lambda i: F.when(i % 2 == 0, place(i)).when(place(i) > 4, 2 * place(i) - 9).otherwise(2 * place(i))
        return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + doubled(i)) % 10 == 0).otherwise(F.lit(False))

    return base.let(digits(v), total)


def valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(v, r"\.", -1), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return luhn(v)
    if kind == "phone":
        return F.length(digits(v)).between(9, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda s: valid(kind, s.value)


def contexts(s: Column) -> Column:
    """The patterns of an identifier (of SPANS), in lower case: the last word before it, the last two, and the last one
    with the first after it; none where it doesn't start a token or nothing is before it. A word loses the marks at its
    ends, unless it is all marks."""
    bare = lambda w: base.let(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), lambda x: F.when(x != "", x).otherwise(w))
    of = lambda c: F.transform(F.filter(F.split(base.lower_ascii(c), r"[\x20\x09-\x0D]+", -1), lambda w: F.length(w) > 0), bare)
    ends = F.coalesce(s.before.rlike(r"[\x20\x09-\x0D]\z"), F.lit(False))
    one = lambda t: F.concat(F.lit("< "), F.element_at(t, -1))
    two = lambda t: F.concat(F.lit("<< "), F.element_at(t, -2), F.lit(" "), F.element_at(t, -1))
    both = lambda t: F.concat(F.lit("<> "), F.element_at(t, -1), F.lit(" "), F.get(of(F.regexp_replace(s.after, r"^[^\x20\x09-\x0D]+", "")), 0))
    all_ = base.let(of(s.before), lambda t: F.when(F.size(t) > 0, F.filter(F.array(one(t), F.when(F.size(t) > 1, two(t)), both(t)), lambda x: x.isNotNull())))
    return F.coalesce(F.when(ends, all_), F.expr("array()").cast("array<string>"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (docs' columns without the text), for each kind its base spans (SPANS), others (identifier-like stretches that
    overlap no base span) and like (a text's key). A null text is an empty one."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(1).alias("none")]
    df = docs.select(F.struct(*rest).alias("row"), t.alias("text"))
    t = F.col("text")
    asks = {"email": F.contains(t, F.lit("@")), "ip": t.rlike("[0-9]"), "card": t.rlike("[0-9]"), "phone": F.contains(t, F.lit("+"))}
    for kind in KINDS:
        df = df.withColumn(kind, F.filter(spans(t, PATTERNS[kind], asks[kind]), _valid(kind)))
    df = df.withColumn("base", F.concat(*KINDS)).withColumn("stretches", F.when(asks["email"] | asks["ip"] | t.rlike(r" [(\[]?dot[)\]]? "), spans(t, LIKE, F.lit(True))))
    free = F.filter("stretches", lambda s: ~F.exists("base", lambda b: (b.start < s.end) & (s.start < b.end)))
    df = df.withColumn("others", F.coalesce(free, F.expr("array()").cast(SPANS))).withColumn("like", F.when(F.size("others") > 0, F.md5(t)))
    return df.select("row", *KINDS, "others", "like")


@dataclass(frozen=True)
class Bootstrap:
    """rounds of scoring; the confidence that patterns and instances need; the distinct seeds or confident instances that
    a pattern needs."""

    rounds: int = ROUNDS
    confident: float = CONFIDENT
    seeds: int = SEEDS


def learn(found: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(kind, pattern, confidence): the confident patterns of find's result. Instances are told apart by a 64-bit hash,
    without the marks around them."""
    instance = F.xxhash64(F.regexp_replace(base.lower_ascii(F.col("s.value")), MARKS, "")).alias("instance")
    around = F.explode(contexts(F.col("s"))).alias("pattern")
    of_kinds = base.union_all([found.select(F.lit(k).alias("kind"), F.explode(k).alias("s")) for k in KINDS])
    others = found.select(F.explode("others").alias("s"))
    seeds = of_kinds.select("kind", around, instance).unionByName(others.filter(F.col("s.value").rlike(SECRET_LIKE)).select(F.lit(SECRET).alias("kind"), around, instance)).distinct()
    seeds, others = base.stash(seeds), others.select(around, instance).distinct()
    # Patterns of fewer instances than a pattern needs can't become one.
    size = base.stash(seeds.select("pattern", "instance").unionByName(others).distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= how.seeds))
    seeds = base.stash(seeds.join(size.select("pattern"), "pattern", "left_semi"))
    others = base.stash(others.join(size.select("pattern"), "pattern", "left_semi"))
    scored = seeds.select("kind", "pattern", "instance", F.lit(1.0).alias("score"))
    for turn in range(how.rounds):
        known = scored.groupBy("kind", "pattern", "instance").agg(F.max("score").alias("score"))
        sums = known.groupBy("kind", "pattern").agg(F.sum("score").alias("total"), F.sum((F.col("score") >= how.confident).cast("int")).alias("sure"))
        able = base.stash(sums.filter(F.col("sure") >= how.seeds).join(size, "pattern").select("kind", "pattern", (F.col("total") / F.col("size")).alias("confidence")).filter(F.col("confidence") >= how.confident))
        if turn + 1 < how.rounds:
            best = others.join(able, "pattern").groupBy("kind", "instance").agg(F.max("confidence").alias("score"))
            # A seed of another kind under a pattern is no instance of this one.
            best = best.join(seeds.select("instance").distinct(), "instance", "left_anti")
            scored = base.stash(seeds.select("kind", "pattern", "instance", F.lit(1.0).alias("score")).unionByName(others.join(best, "instance").select("kind", "pattern", "instance", "score")))
    return able


def personal_data(docs: DataFrame, text: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:
    """row (a struct of docs' other columns, whatever their names), the base spans of each kind, and added
    (array<struct<kind,start,end>>): the identifiers that contexts gave away, without the marks around them. Equal texts
    get equal spans; repeated rows stay; no rows give no rows."""
    found = base.stash(find(docs, text))
    patterns = learn(found, how)
    told = found.filter("like is not null").select("like", F.explode("others").alias("s")).distinct()
    inner = lambda mark: F.length(F.regexp_extract("s.value", mark, 0))
    start, end = (F.col("s.start") + inner(MARKS.split("|")[0]), F.col("s.end") - inner(MARKS.split("|")[1]))
    told = told.select("like", start.alias("start"), end.alias("end"), F.explode(contexts(F.col("s"))).alias("pattern"))
    told = told.join(patterns, "pattern").groupBy("like", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    added = told.groupBy("like").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    none = F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint>>")
    # Most texts have nothing to look up: they stay out of the join, whose key they would all share.
    asked = found.filter("like is not null").drop("others").join(added, "like", "left").drop("like").withColumn("added", F.coalesce("added", none))
    return asked.unionByName(found.filter("like is null").drop("others", "like").withColumn("added", none))


def _written(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x.start, x.end)


def _of_kind(kind: str):
    return lambda a: a.kind == kind


def joined(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined."""
    parts = [F.transform(F.array_sort(F.transform(s, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))), _written(k)) for k, s in kinds]
    return F.array_join(F.concat(*parts), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_sha256 and all spans of every document (those of the kind secret last), and their
    number."""
    found = personal_data(base.table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))
    plain = [(k, F.transform(k, place)) for k in KINDS]
    both = [(k, F.concat(s, F.transform(F.filter("added", _of_kind(k)), place))) for k, s in plain] + [(SECRET, F.transform(F.filter("added", _of_kind(SECRET)), place))]
    n_spans = sum((F.size(s) for _, s in both), F.lit(0)).cast("long")
    return found.select("row.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined(plain), 256).alias("base_sha256"), joined(both).alias("spans"), n_spans.alias("n_spans"))


QUERIES, SQL = {"op6_pii": op6_pii}, {}
