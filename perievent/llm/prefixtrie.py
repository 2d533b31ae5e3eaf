"""The prefix trie of conversations, as a z-fast trie that Spark holds in tables.

A conversation is a string of turns (role, text). Every prefix has a signature that is a sum of hashes of its turns with
their places (126 bits), so that running sums in range slices give all of them and no conversation has to fit a task.
A compacted node (rep, a, b) stands for the prefixes of depths a+1 to b of conversation rep. It is filed under its
handle, the prefix whose depth is the two-fattest number in (a, b]. Distinct conversations go in by three batches of
growing size. A batch finds the deepest node of each conversation's path by fat binary search: in each round all
conversations look one handle up, in one join, and the rounds are the bits of the greatest length. Exit edges are split
where conversations leave them or end; what leaves the trie becomes new nodes where the batch itself branches or ends.
In the end the members of each node are gathered by looking up their paths, and edges expand to a row a depth.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perievent.llm import base

#: Turns of conversation c - c % GROUP that c begins with: crc32(c) % MOST.
GROUP, MOST = 5, 9
#: Distinct conversations of a batch, in 64ths, the last one takes the rest.
BATCHES = (1, 7, 56)
_NONE = sha256(b"").hexdigest()


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (decimal) of `sums` within each key in `order`. Rows are dealt in slices of a range, so that a
    key of very many rows spans several; a slice begins within one key at most, whose sum so far is looked up."""
    s = base.stash(df.withColumns({f"_{k}": c for k, c in sums.items()}).repartitionByRange(F.col(key), *order).withColumn("_slice", F.spark_partition_id()))
    parts = s.groupBy(key, "_slice").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    so_far = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select(key, "_slice", *[F.sum(f"_{k}").over(so_far).alias(f"_before_{k}") for k in sums]).filter(" or ".join(f"_before_{k} is not null" for k in sums))
    here = W.partitionBy("_slice", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = s.withColumns({k: F.sum(f"_{k}").over(here) for k in sums}).drop(*[f"_{k}" for k in sums])
    met = own.join(F.broadcast(carry), [key, "_slice"], "left")  # a row a slice at most
    return met.withColumns({k: F.col(k) + F.coalesce(f"_before_{k}", F.lit(0)) for k in sums}).drop("_slice", *[f"_before_{k}" for k in sums])


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (a digest of role and text), bytes of rows (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    part = lambda n: F.conv(F.substring("digest", n, 15), 16, 10).cast("long")
    plain = rows.filter("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    plain = plain.select("conv_id", "turn", part(1).alias("d1"), part(16).alias("d2"), "bytes")
    placed = running(plain, "conv_id", [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")], {"pos": F.lit(1).cast("decimal(20,0)")})
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "d1", "d2", "bytes")


def taken(conv: Column) -> Column:
    """Turns that a conversation asks of its group's first."""
    return (F.crc32(conv.cast("string").cast("binary")) % MOST).cast("long")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, steps): every conversation's length and its turns (conv, d, len, d1, d2, bytes), its group's first ones
    before its own."""
    own = base.stash(turns(rows))
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = sizes.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    convs = sizes.withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP).join(firsts, "first", "left")
    h = taken(F.col("conv_id"))
    convs = base.stash(convs.select(F.col("conv_id").alias("conv"), "first", h.alias("h"), F.least(h, F.coalesce("first_n", F.lit(0))).alias("k"), "n").withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    before = own.filter(F.col("pos") < MOST).select(F.col("conv_id").alias("first"), F.col("pos").alias("d"), "d1", "d2", "bytes").join(convs.filter("k > 0"), "first").filter("d <= k").select("conv", "d", "len", "d1", "d2", "bytes")
    after = own.filter(F.col("pos") > h).withColumnRenamed("conv_id", "conv")
    after = base.join_hot(after, convs.select("conv", "h", "k", "len"), ["conv"], F.col("pos")).select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("d"), "len", "d1", "d2", "bytes")
    return convs.select("conv", "len"), before.unionByName(after)


def signed(steps: DataFrame) -> DataFrame:
    """conv, d, len, bytes, upto (bytes of the first d turns), p1, p2 (the prefix's signature), q1, q2 (its parent's) of
    steps (conv, d, len, d1, d2, bytes). A signature is a sum of hashes of (place, turn)."""
    terms = {"s1": F.xxhash64(F.lit(1), "d", "d1", "d2"), "s2": F.xxhash64(F.lit(2), "d2", "d", "d1")}
    terms = {k: c.cast("decimal(20,0)") for k, c in terms.items()}
    long = lambda c: (c % F.lit(Decimal(1 << 63))).cast("long")
    found = running(steps.select("conv", "d", "len", "bytes", *[c.alias(f"t{k}") for k, c in terms.items()]), "conv", [F.col("d")], {"upto": F.col("bytes").cast("decimal(20,0)"), "s1": F.col("ts1"), "s2": F.col("ts2")})
    return found.select("conv", "d", "len", "bytes", F.col("upto").cast("long").alias("upto"), long(F.col("s1")).alias("p1"), long(F.col("s2")).alias("p2"), long(F.col("s1") - F.col("ts1")).alias("q1"), long(F.col("s2") - F.col("ts2")).alias("q2"))


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the highest power of two divides."""
    apart = a.bitwiseXOR(b)
    for k in (1, 2, 4, 8, 16, 32):
        apart = apart.bitwiseOR(F.shiftright(apart, k))
    low = F.shiftright(apart, 1)  # all bits under the highest that differs
    return b.bitwiseAND(F.bitwise_not(low))


def keyed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes (rep, a, b) with the signatures of their extent x (depth b), handle h, first prefix c (depth a + 1) and
    parent q (depth a)."""
    depths = F.explode(F.array(F.struct(F.lit("x").alias("kind"), F.col("b").alias("d")), F.struct(F.lit("h").alias("kind"), two_fattest(F.col("a"), F.col("b")).alias("d")), F.struct(F.lit("c").alias("kind"), (F.col("a") + 1).alias("d")))).alias("k")
    asked = nodes.select("rep", "a", "b", depths).select(F.col("rep").alias("conv"), "a", "b", "k.kind", "k.d")
    met = asked.join(paths.select("conv", "d", "p1", "p2", "q1", "q2"), ["conv", "d"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return met.groupBy(F.col("conv").alias("rep"), "a", "b").agg(*[of(k, f"p{i}").alias(f"{k}{i}") for k in "xhc" for i in (1, 2)], *[of("c", f"q{i}").alias(f"q{i}") for i in (1, 2)])


def located(batch: DataFrame, paths: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """conv, rep, b (its exit node, null where it leaves at a node), a, e: the depth up to which the trie holds a
    conversation. batch: conv, len; paths: their prefixes and the representatives'."""
    own = paths.join(batch.select("conv"), "conv", "left_semi")
    state = batch.select("conv", "len", F.lit(0).cast("long").alias("lo"), F.col("len").alias("hi"), *[F.lit(None).cast("long").alias(c) for c in ("rep", "a", "b", "x1", "x2")])
    handles = nodes.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), *[F.col(c).alias(f"n_{c}") for c in ("rep", "a", "b", "x1", "x2")])
    for _ in range(longest.bit_length()):
        asked = state.withColumn("d", F.when(F.col("lo") < F.col("hi"), two_fattest(F.col("lo"), F.col("hi")))).join(own.select("conv", "d", "p1", "p2"), ["conv", "d"], "left")
        met = base.join_hot(base.stash(asked), handles, ["p1", "p2"], F.col("conv"), "left")
        hit = F.col("n_rep").isNotNull()
        state = met.select("conv", "len", F.when(hit, F.col("n_b")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("d").isNotNull() & ~hit, F.col("d") - 1).otherwise(F.col("hi")).alias("hi"), *[F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("rep", "a", "b", "x1", "x2")])
    # The last node found holds the path up to its handle. Does its extent belong to the path, too?
    at = base.stash(state).join(own.select("conv", F.col("d").alias("b"), "p1", "p2"), ["conv", "b"], "left")
    whole = F.col("rep").isNull() | (F.coalesce(F.col("p1") == F.col("x1"), F.lit(False)) & F.coalesce(F.col("p2") == F.col("x2"), F.lit(False)))
    at = at.withColumn("whole", whole)
    inside = at.filter("not whole").select("conv", "len", "rep", "a", "b")
    here = at.filter("whole").select("conv", "len", F.coalesce("b", F.lit(0)).alias("a"))
    first = base.stash(here.join(own.select("conv", (F.col("d") - 1).alias("a"), "p1", "p2"), ["conv", "a"], "left"))
    below = base.join_hot(first, nodes.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), "rep", "b"), ["p1", "p2"], F.col("conv"), "left").select("conv", "len", "rep", "a", "b")
    exits = base.stash(inside.unionByName(below))
    edge = exits.filter("rep is not null").join(own.select("conv", "d", "p1", "p2"), "conv").filter("d > a and d <= b")
    of_rep = paths.select(F.col("conv").alias("rep"), "d", F.col("p1").alias("r1"), F.col("p2").alias("r2"))
    shared = base.join_hot(base.stash(edge), of_rep, ["rep", "d"], F.col("conv")).filter("p1 = r1 and p2 = r2").groupBy("conv").agg(F.max("d").alias("e"))
    return exits.join(shared, "conv", "left").select("conv", "rep", "a", "b", F.coalesce("e", "a").alias("e"))


def inserted(nodes: DataFrame | None, exits: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes (rep, a, b) with a batch in it. exits: conv, rep, a, b, e of each of its conversations."""
    rows = paths.join(exits.select("conv", "e"), "conv").filter("d > e")
    rows = base.stash(rows)
    forks = rows.filter(F.col("d") > F.col("e") + 1).select("q1", "q2", "p1", "p2").distinct().groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    extents = forks.unionByName(rows.filter("d = len").select("p1", "p2")).distinct()
    marks = base.join_hot(rows, extents, ["p1", "p2"], F.col("conv"))
    marks = marks.withColumn("a", F.coalesce(F.lag("d").over(W.partitionBy("conv").orderBy("d")), F.col("e")))
    new = marks.groupBy("p1", "p2").agg(F.min(F.struct("conv", "a", "d")).alias("k")).select(F.col("k.conv").alias("rep"), "k.a", F.col("k.d").alias("b"))
    if nodes is None:
        return base.stash(new)
    cuts = exits.filter("rep is not null and e > a and e < b").select("rep", "b", F.col("e").alias("at")).distinct()
    ends = nodes.select("rep", "b", F.col("b").alias("at"), "a").unionByName(cuts.withColumn("a", F.lit(None).cast("long")))
    pieces = W.partitionBy("rep", "b").orderBy("at")
    first = F.max("a").over(W.partitionBy("rep", "b"))
    old = ends.select("rep", F.coalesce(F.lag("at").over(pieces), first).alias("a"), F.col("at").alias("b"))
    return base.stash(old.unionByName(new))


def compacted(classes: DataFrame, paths: DataFrame) -> DataFrame:
    """The compacted nodes of classes (conv, len), each a distinct conversation with turns, with their signatures."""
    lane = F.pmod(F.xxhash64("conv"), F.lit(sum(BATCHES)))
    longest = classes.agg(F.max("len")).first()[0] or 0
    nodes, low = None, 0
    for share in BATCHES:
        batch = base.stash(classes.filter((lane >= low) & (lane < low + share)))
        low += share
        if nodes is None:
            none = F.lit(None).cast("long")
            exits = batch.select("conv", none.alias("rep"), none.alias("a"), none.alias("b"), F.lit(0).cast("long").alias("e"))
        else:
            exits = base.stash(located(batch, paths, base.stash(keyed(nodes, paths)), longest))
        nodes = inserted(nodes, exits, paths)
    return base.stash(keyed(nodes, paths))


def digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of ends (p1, p2, conv): rows come sorted and a hash takes them one by one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int64()), pa.array([k[1] for k, _ in found], pa.int64()), pa.array([h.hexdigest() for _, h in found], pa.string())], names=["p1", "p2", "ends_sha256"])

        now, h, done = None, None, []
        for b in batches:
            for p1, p2, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (p1, p2) == now:
                    h.update(b",%d" % conv)
                    continue
                if now is not None:
                    done.append((now, h))
                now, h = (p1, p2), sha256(b"%d" % conv)
            yield told(done)
            done = []
        if now is not None:
            yield told([(now, h)])

    return ends.select("p1", "p2", "conv").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "conv").mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix of the
    rebuilt conversations of rows (conv_id, turn, role, text), the textless root among them.

    Turns go by `turn`, null first; turns of one number by a digest of role and text; repeated rows are repeated turns.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation and go; an empty table gives no
    rows. c % 5 keeps the sign of c. Other columns are not looked at. The members that end at one prefix go through one
    hash in their order, so through one task, which holds none of them.
    """
    with base.scratch(rows.sparkSession) as keep:
        convs, steps = rebuilt(rows.select("conv_id", "turn", "role", "text"))
        all_paths = base.stash(signed(steps))
        last = all_paths.filter("d = len").select("conv", "len", "p1", "p2", "upto")
        ends = base.stash(last.unionByName(convs.filter("len = 0").select("conv", "len", *[F.lit(0).cast("long").alias(c) for c in ("p1", "p2", "upto")])))
        classes = base.stash(ends.groupBy("p1", "p2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("len").alias("len"), F.first("upto").alias("total")))
        paths = base.stash(all_paths.join(classes.select("conv"), "conv", "left_semi"))
        nodes = compacted(classes.filter("len > 0").select("conv", "len"), paths)
        kids = base.stash(nodes.groupBy(F.col("q1").alias("x1"), F.col("q2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children")))
        # Members: each distinct conversation looks its path up; the root, of signature 0, holds all.
        zero = [F.lit(0).cast("long").alias(c) for c in ("b", "x1", "x2", "before")]
        looked = base.join_hot(paths.select("conv", F.col("d").alias("b"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), (F.col("upto") - F.col("bytes")).alias("before")), nodes.select("x1", "x2", "a"), ["x1", "x2"], F.col("conv"))
        lone = classes.join(kids.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), "n_children"), ["p1", "p2"], "left").select("conv", "n", "total", F.col("n_children").isNull().cast("long").alias("leaf"))
        members = base.stash(looked.select("conv", "b", "x1", "x2", "before", "a").unionByName(classes.select("conv", *zero, F.lit(-1).cast("long").alias("a"))).join(lone, "conv"))
        owners = base.stash(members.groupBy("x1", "x2", "a", "b").agg(F.min("conv").alias("owner"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves")))
        # From depth o on a conversation is the smallest member of its prefixes; `kept` are its bytes before.
        top = owners.groupBy(F.col("owner").alias("conv")).agg(F.min("a").alias("d"))
        top = top.join(paths.select("conv", "d", "upto"), ["conv", "d"], "left").select("conv", F.greatest("d", F.lit(0)).alias("o"), F.coalesce("upto", F.lit(0)).alias("kept"))
        part = F.when(F.col("o").isNull(), F.col("total") - F.col("before")).when(F.col("b") <= F.col("o"), F.col("kept") - F.col("before")).otherwise(F.lit(0))
        part = part + (F.col("n") - 1) * (F.col("total") - F.col("before"))
        saved = members.join(top, "conv", "left").groupBy("x1", "x2").agg(F.sum(part).alias("saved"))
        one = classes.filter("n = 1").select("p1", "p2", F.sha2(F.col("conv").cast("string").cast("binary"), 256).alias("ends_sha256"))
        many = digests(ends.join(classes.filter("n > 1").select("p1", "p2"), ["p1", "p2"], "left_semi"))
        told = one.unionByName(many).select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), "ends_sha256")
        of_parent = owners.select(F.col("x1").alias("q1"), F.col("x2").alias("q2"), F.col("owner").alias("parent"))
        full = owners.join(saved, ["x1", "x2"]).join(kids, ["x1", "x2"], "left").join(told, ["x1", "x2"], "left")
        full = full.join(nodes.select("x1", "x2", "q1", "q2"), ["x1", "x2"], "left").join(of_parent, ["q1", "q2"], "left")
        full = base.stash(full.select("owner", "a", "b", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256")))
        root = full.filter("b = 0").select(F.col("owner").alias("conv_id"), F.col("b").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")
        # Edges expand along their owner's path: a depth belongs to the first node at or below it.
        on = paths.join(full.filter("b > 0").withColumnRenamed("owner", "conv").withColumn("d", F.col("b")), ["conv", "d"], "left")
        below = W.partitionBy("conv").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
        info = F.struct("a", "b", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", (F.col("upto") - F.col("bytes")).alias("to"))
        on = on.withColumn("u", F.last(F.when(F.col("b").isNotNull(), info), ignorenulls=True).over(below)).filter(F.col("d") > F.col("u.a"))
        at_end = F.col("d") == F.col("u.b")
        edge = on.select(
            F.col("conv").alias("conv_id"),
            F.col("d").alias("depth"),
            F.when(F.col("d") == F.col("u.a") + 1, F.col("u.parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
            "u.n_convs",
            F.when(at_end, F.col("u.n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            "u.n_leaves",
            (F.col("u.saved") + (F.col("u.n_convs") - 1) * (F.col("u.to") - (F.col("upto") - F.col("bytes")))).alias("saved_tokens"),
            F.when(at_end, F.col("u.ends_sha256")).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        )
        return keep(base.stash(root.unionByName(edge)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix."""
    return prefix_trie(base.table(spark, sf_dir, "conversations"))


_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos, m, bytes FROM
  (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM n),
k AS (SELECT h.c, h.h, h.c - h.c % 5 AS f, least(h.h, coalesce(n.n, 0)) AS k FROM h LEFT JOIN n ON n.c = h.c - h.c % 5),
s AS (SELECT k.c, pos AS d, m, bytes FROM k JOIN t ON t.c = k.f AND pos <= k.k UNION ALL SELECT k.c, k.k + pos - h, m, bytes FROM k JOIN t ON t.c = k.c AND pos > h),
p AS (SELECT c, d, bytes, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS key FROM s UNION ALL SELECT c, 0, 0, '' FROM k),
v AS (SELECT key, min(c) AS conv_id, CAST(any_value(d) AS BIGINT) AS depth, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY key),
up AS (SELECT *, left(key, length(key) - 32) AS parent FROM v WHERE depth > 0),
kids AS (SELECT parent AS key, count(*) AS n_children FROM up GROUP BY parent),
sub AS (SELECT left(v.key, 32 * i) AS key, count(*) FILTER (kids.key IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(range(0, depth + 1)) AS i FROM v) v LEFT JOIN kids ON kids.key = v.key GROUP BY 1),
e AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM p WHERE d = (SELECT max(d) FROM p q WHERE q.c = p.c) GROUP BY key)
SELECT v.conv_id, v.depth, o.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM v JOIN sub USING (key) LEFT JOIN kids USING (key) LEFT JOIN e USING (key) LEFT JOIN v o ON v.depth > 0 AND o.key = left(v.key, length(v.key) - 32)
"""

QUERIES, SQL = {"op12_prefix_trie": op12_prefix_trie}, {"op12_prefix_trie": _SQL}
