"""Repeated passages, the trie of conversations and whitening: against plain versions, on odd rows, on hot keys."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from perievent.llm import base, prefixtrie, queries, suffixes, whitening
from tests.same import assert_same


def same_as_sql(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name])
    assert_same(got.columns, [tuple(r) for r in got.collect()], want.columns, want.fetchall())


# Repeated passages


def plain_spans(texts, threshold=100):
    """start, end of what goes of each text, by a dictionary of all windows."""
    seen, found = set(), []
    for text in texts:
        gone = bytearray(len(text))
        for s in range(len(text) - threshold + 1):
            w = text[s : s + threshold]
            if w in seen:
                gone[s : s + threshold] = b"\1" * threshold
            seen.add(w)
        cuts = [i for i in range(len(text) + 1) if (i < len(text) and gone[i]) != (i > 0 and gone[i - 1])]
        found.append(list(zip(cuts[::2], cuts[1::2])))
    return found


def spans_of(rows):
    return [[(s["start"], s["end"]) for s in r["spans"]] for r in rows]


def held_against_plain(spark, texts):
    df = spark.createDataFrame([(i, t.decode("latin-1")) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    data = [t.decode("latin-1").encode() for t in texts]
    got = sorted(suffixes.without_repeats(df).collect(), key=lambda r: r["row"]["doc_id"])
    want = plain_spans(data)
    assert spans_of(got) == want
    for r, d, spans in zip(got, data, want):
        keep = bytearray(d)
        for a, b in reversed(spans):
            del keep[a:b]
        assert r["kept"] == bytes(keep) and r["n_bytes"] == len(d)


def edited(rng, n):
    """Copies of a few texts with substitutions, blocks moved and repeated, and periodic stretches."""
    letters = bytes(range(97, 123))
    texts = [bytes(rng.choices(letters, k=rng.randrange(90, 900))) for _ in range(6)]
    out = []
    for _ in range(n):
        t = bytearray(rng.choice(texts))
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice(letters)
        if rng.random() < 0.5:
            a = rng.randrange(len(t))
            t[a:a] = rng.choice(texts)[: rng.randrange(300)]
        if rng.random() < 0.3:
            t += bytes(rng.choices(b"ab", k=rng.randrange(1, 4))) * rng.randrange(150)
        out.append(bytes(t))
    return out + [b"", b"x" * 99, b"x" * 100, b"x" * 101, b"y" * 100, b"y" * 100, "é漢".encode() * 60]


def test_op11_query(spark, sf, duck):
    same_as_sql(spark, sf, duck, "op11_suffixes")


@pytest.mark.parametrize("together", [1 << 15, 2])
def test_repeats_equal_a_plain_version(spark, monkeypatch, together):
    """With 2, nearly all anchors are sorted as windows; pieces of 300 bytes cut texts."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    monkeypatch.setattr(suffixes, "PIECE", 300)
    monkeypatch.setattr(suffixes, "SUFFIXES", 500)
    monkeypatch.setattr(base, "HOT_ROWS", 10)
    held_against_plain(spark, edited(random.Random(3), 60))


def test_an_anchor_goes_on_over_batches(spark):
    """A line in very many texts, each with another start: its anchor's contexts span Arrow batches of ten rows."""
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = random.Random(5)
        line = bytes(rng.choices(b"abcdefghij ", k=150))
        held_against_plain(spark, [bytes(rng.choices(b"klmnop", k=80)) + line + bytes(rng.choices(b"qrs", k=rng.choice([0, 40]))) for _ in range(80)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_repeats_of_odd_rows(spark):
    """Null texts and ids, one id twice, equal rows, an empty table, columns of any name."""
    shape = "doc_id long, text string, doc string, row int, spans string, may boolean"
    a, b = "a long sentence that stands here more than once " * 4, "another one " * 20
    rows = [(3, a, "x", 1, "s", True), (3, a, "x", 1, "s", True), (3, b, None, 2, None, None), (None, a, "n", 3, "", False), (1, None, "z", 4, "", True), (2, "", "e", 5, "", True)]
    got = suffixes.without_repeats(spark.createDataFrame(rows, shape)).collect()
    assert len(got) == 6
    size = lambda r: sum(s["end"] - s["start"] for s in r["spans"])
    of_a = sorted((r["row"]["doc_id"] is None, size(r)) for r in got if r["row"]["text"] == a)
    inner = sum(y - x for x, y in plain_spans([a.encode()])[0])
    assert of_a == [(False, inner), (False, len(a)), (True, len(a))]
    assert [len(r["kept"]) for r in got if r["row"]["doc_id"] in (1, 2)] == [0, 0]
    assert suffixes.without_repeats(spark.createDataFrame([], shape)).collect() == []
    with pytest.raises(ValueError):
        suffixes.repeated_windows(spark.createDataFrame([], "doc long, text string"), 10)


# The trie


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            conv[c].append((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in conv.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) or 1
        saved[k] = sum(saved[c] for c in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def trie_of(spark, rows, shape="conv_id long, turn long, role string, text string"):
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefixtrie.prefix_trie(spark.createDataFrame(rows, shape)).collect())


def test_op12_query(spark, sf, duck):
    same_as_sql(spark, sf, duck, "op12_prefix_trie")


def test_trie_equals_a_plain_version(spark, monkeypatch):
    """Deep shared starts, conversations that end inside others' edges, copies, a few turns in all and many."""
    monkeypatch.setattr(base, "HOT_ROWS", 10)
    rng = random.Random(2)
    rows = []
    for c in range(90):
        branch, n = rng.choice(["a", "b"]), rng.choice([1, 2, 9, 10, 14, 14, 25])
        leave = rng.choice([n, n, rng.randrange(n)])
        rows += [(c, t, "user" if t % 2 else "", f"{branch if t < leave else rng.randrange(3)}{t}" * rng.choice([1, 1, 1, 2] if t >= leave else [1])) for t in range(n)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    """Null ids, turns, roles and texts; repeated rows and ties; conversations without a first one or without turns."""
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, 1, "user", "é"), (7, 1, "user", "é"), (7, 1, "system", "b"), (8, 2, "user", "late"), (8, None, "user", "first"), (11, 1, "user", ""), (12, 1, "user", ""), (1003, 5, "user", "alone")]
    rows += [(10, t, "user", f"t{t}") for t in range(3)]
    assert trie_of(spark, rows) == plain_trie(rows)
    assert trie_of(spark, []) == []
    got = prefixtrie.prefix_trie(spark.createDataFrame([(7, 1, "u", "a", 1, 2)], "conv_id long, turn long, role string, text string, d int, p1 int")).collect()
    assert {r["depth"] for r in got} == {d for _, d, *_ in plain_trie([(7, 1, "u", "a")])}


def test_two_fattest_numbers(spark):
    df = spark.createDataFrame([(a, b) for a in range(0, 40, 3) for b in range(a + 1, 70, 7)], "a long, b long")
    from pyspark.sql import functions as F

    for r in df.withColumn("f", prefixtrie.two_fattest(F.col("a"), F.col("b"))).collect():
        assert r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda x: x & -x)


# Whitening


def plain_whitening(vectors, components=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    dev = [int(((n * r.astype(object) - s.astype(object)) ** 2).sum()) for r in x]
    return dev, y @ v / np.sqrt(e), e / np.var(x, axis=0).sum()


def test_op13_query(spark, sf, duck):
    rows = sorted(duck.sql("select vec_id, embedding from embeddings").fetchall())
    got = queries.QUERIES["op13_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    dev, w, share = plain_whitening([v for _, v in rows])
    assert got.vec_id.tolist() == [i for i, _ in rows for _ in range(8)] and got.component.tolist() == [*range(1, 9)] * len(rows)
    assert got.deviation.tolist() == [d for d in dev for _ in range(8)] and set(got.n) == {len(rows)}
    signs = np.sign((got.whitened.to_numpy().reshape(-1, 8) * w).sum(axis=0))
    assert np.abs(got.whitened.to_numpy().reshape(-1, 8) * signs - w).max() < 1e-9
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8), share, rtol=1e-10) and got.identity_error.max() < 1e-9


def turned(values):
    q, _ = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values), len(values))))
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize(
    "a",
    [turned(np.arange(40.0)), turned([5, 5, 5, 2, 2, 1, 1, 0.0]), turned(10.0 ** -np.arange(16)), turned(1 + 1e-9 * np.arange(30)), np.eye(9) * 3, np.zeros((4, 4)), np.array([[0.0, 1], [1, 0]]), np.diag([1.0, 2, 3]), np.outer(np.arange(5.0), np.arange(5.0)), turned([1.0, 1, 1, 1, -3])],
)
def test_spectrum(a):
    a = (a + a.T) / 2
    k = min(8, len(a))
    e, v = whitening.spectrum(a, k)
    scale = max(1e-300, np.linalg.norm(a))
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ v - v * e) <= 1e-13 * scale and np.linalg.norm(v.T @ v - np.eye(k)) < 1e-13


def test_polar_factor():
    a = turned([3, 1e-9, -2, -1e-12, 5.0])
    u = whitening.polar(a)
    assert np.linalg.norm(u @ u - np.eye(5)) < 1e-12 and round(np.trace(u)) == 1


def test_whitening_of_odd_rows(spark):
    """Null, empty, short, infinite and huge vectors go; repeated rows stay; flat, single and no vectors have no
    component; large values stay exact."""
    shape = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType()), T.StructField("component", T.IntegerType())])
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in v], "a", 9) for i, v in enumerate(rng.standard_normal((40, 3)) * [1, 50, 1e4])]
    odd = [(100, None, "n", 1), (101, [], "e", 1), (102, [1.0, None, 2.0], "h", 1), (103, [1.0, float("nan"), 2.0], "q", 1), (104, [float("inf"), 0.0, 0.0], "i", 1), (105, [1e300, 0.0, 0.0], "b", 1), (106, [1.0], "s", 1), (None, [1.0, 2.0, 3.0], None, None), (0, good[0][1], "a", 9)]
    got = whitening.whiten(spark.createDataFrame(good + odd, shape)).collect()
    used = good + odd[-2:]
    dev, w, share = plain_whitening([v for _, v, *_ in used])
    assert len(got) == 3 * len(used) and {r["n"] for r in got} == {len(used)}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(dev)
    assert np.allclose(sorted({r["explained"] for r in got}, reverse=True), share, rtol=1e-6) and got[0]["identity_error"] < 1e-6
    for rows in ([], odd[:2], [good[0]], [good[0]] * 3):
        assert whitening.whiten(spark.createDataFrame(rows, shape)).collect() == []
    wide = whitening.whiten(spark.createDataFrame([(i, [float(i << 33)]) for i in range(50)], "vec_id long, embedding array<double>")).collect()
    assert len(wide) == 50 and {r["deviation"] for r in wide} == {None} and wide[0]["identity_error"] < 1e-9
