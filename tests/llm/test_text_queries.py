"""The registered queries on whole small tables, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from perievent.llm import base, decontaminate, lm, quality, queries
from tests.llm import brute
from tests.same import assert_same


@pytest.fixture(scope="module")
def docs(duck):
    return {i: (t, lang, s) for i, t, lang, s in duck.sql("select doc_id, text, lang, source from documents").fetchall()}


def run(spark, sf, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf).collect()]


def test_op1(spark, sf, docs):
    got = run(spark, sf, "op1_mixing")
    assert len(got) == len(docs)
    total, taken, target, size = sum(r["size"] for r in got), defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["size"] == len(brute.words(docs[r["doc_id"]][0])) and r["taken"] in (0, r["size"], 2 * r["size"])
        s = docs[r["doc_id"]][2]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * total)
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(5, 0.01 * target[s])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    free = {s: target[s] / weights[s] for s in size if target[s] < 2 * size[s] - 1e-6}
    assert max(free.values()) == pytest.approx(min(free.values()))
    assert sorted((r["doc_id"], r["taken"]) for r in run(spark, sf, "op1_mixing")) == sorted((r["doc_id"], r["taken"]) for r in got)


def test_op2(spark, sf, docs):
    got = {r["doc_id"]: r for r in run(spark, sf, "op2_simhash")}
    ids = sorted(docs)
    fps = [brute.fingerprint(docs[i][0]) for i in ids]
    roots = brute.near(fps)
    for k, i in enumerate(ids):
        assert got[i]["fingerprint"] == f"{fps[k]:016x}" and got[i]["component_id"] == ids[roots[k]]


def test_op3(spark, sf, duck):
    """Each page's article, read by the library's own parser."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks, self.now = 0, [], []

        def cut(self):
            self.blocks.append(" ".join("".join(self.now).split()))
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag == "article":
                self.inside, self.now = 1, []
            elif tag == "br":
                self.now.append(" ")
            elif tag in ("p", "h1"):
                self.cut()

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article") and self.inside:
                self.cut()
            if tag == "article":
                self.inside = 0

        def handle_data(self, data):
            if self.inside:
                self.now.append(data)

    got = {r["page_id"]: r for r in run(spark, sf, "op3_html")}
    rows = duck.sql("select page_id, url, html from pages").fetchall()
    assert len(got) == len(rows)
    for i, u, h in rows:
        a = Article()
        a.feed(h)
        text = "\n".join(filter(None, a.blocks))
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (u, text, len(text))


def test_op4(spark, sf, docs, duck):
    df = quality.op4_quality(spark, sf)
    rel = duck.sql(quality.SQL_OP4)
    rows = [tuple(r) for r in df.collect()]
    assert_same(df.columns, rows, rel.columns, rel.fetchall())
    at = df.columns.index("n_repeat_words")
    for r in rows:
        assert r[at] == brute.repeat_words(docs[r[0]][0])


def test_op5(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in run(spark, sf, "op5_tokens"):
        text = docs[r["doc_id"]][0]
        assert r["n_tokens"] == len(t.encode(text, add_special_tokens=False).ids) and r["n_bytes"] == len(text.encode()) and r["over_limit"] == (r["n_tokens"] > 2048)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def ok(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_op6(spark, sf, docs):
    for r in run(spark, sf, "op6_pii"):
        spans = base_spans(docs[r["doc_id"]][0])
        line = ",".join("%s:%d:%d" % s for s in spans)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r["spans"].split(",")) | {""}
        assert all(r[f"n_{k}"] == sum(s[0] == k for s in spans) for k in BASE)


def test_op7(spark, sf, docs):
    got = run(spark, sf, "op7_sharding")
    slots, bytes_, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        text = docs[r["doc_id"]][0]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        homes[text].add(r["shard"])
    assert len(got) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values()) and max(bytes_.values()) - min(bytes_.values()) < 0.02 * sum(bytes_.values()) / 16


def test_op8(spark, sf, docs, duck):
    """Exactly the pairs of documents and items with a window of 13 aligned tokens of which 11 agree."""
    items = dict(duck.sql("select item_id, text from benchmark").fetchall())
    pad = np.arange(-2, 0)  # a window may reach beyond a text's edges
    codes = {i: np.concatenate([pad, decontaminate.token_codes(t.encode()).astype(np.int64), pad]) for i, (t, *_) in docs.items()}
    want = {}
    for k, x in items.items():
        x = decontaminate.token_codes(x.encode()).astype(np.int64)
        assert len(x) >= 13
        for i, d in codes.items():
            some = np.flatnonzero(np.isin(d, x))
            for shift in {int(a - b) for a in some for b in np.flatnonzero(x == d[a])} if len(some) >= 11 else ():
                lo, hi = max(0, -shift), min(len(x), len(d) - shift)
                same = np.cumsum(np.pad(x[lo:hi] == d[lo + shift : hi + shift], (1, 0)))
                best = int((same[13:] - same[:-13]).max(initial=0))
                if best >= 11:
                    want[i, k] = max(want.get((i, k), 0), best)
    got = run(spark, sf, "op8_decontaminate")
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got} == want and want
    assert all(0 <= r["start"] < r["end"] <= len(codes[r["doc_id"]]) - 4 and r["n_items"] == 1 for r in got)


def test_op9(spark, sf, docs):
    got = run(spark, sf, "op9_langid")
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]][1] for r in held) >= 0.95 * len(held)


def test_op10(spark, sf, docs):
    got = run(spark, sf, "op10_lm")
    tokens = {i: t.encode().lower().split() + [None] for i, (t, *_) in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    c = Counter(x for i, t in tokens.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(x in c for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel=1e-9)
        assert r["score"] < 0
    # What the model spends on held-out texts, spelling included, against a word model that is told all unseen words' spelling.
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > 1.2 * sum(r["base_score"] for r in out)


def test_op10_spends_less_than_words_that_are_known(spark, sf):
    """On held-out texts whose words training has seen, where spelling is no excuse, six bytes of context take fewer digits
    than words."""
    docs = base.table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    got = lm.score(docs, lm.DEEPEST).filter("held_out and n_known = n_tokens").collect()
    assert len(got) >= 20 and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_pipeline(spark, sf, docs, duck):
    import corpus_pipeline

    df = base.table(spark, sf, "documents")
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        df = base.stash(stage(spark, df, sf))
        kept.append(df)
    good = {i for i, (t, *_) in docs.items() if brute.clean(t)}
    assert {r["doc_id"] for r in kept[0].collect()} == good
    # near-dedup: the least id of each group of similar texts
    ids = sorted(good)
    sets, groups = {i: brute.shingles(docs[i][0]) for i in ids}, brute.Groups(ids)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                groups.join(i, j)
    assert {r["doc_id"] for r in kept[1].collect()} == {i for i in ids if groups.root(i) == i}
    leaks = {r["row"]["doc_id"] for r in decontaminate.leaks(kept[1].select("doc_id", "text"), base.table(spark, sf, "benchmark")).collect()}
    assert {r["doc_id"] for r in kept[2].collect()} == {r["doc_id"] for r in kept[1].collect()} - leaks
    assert set(kept[3].columns) == set(base.table(spark, sf, "documents").columns)
    times = Counter(r["doc_id"] for r in kept[3].collect())
    assert max(times.values()) <= 2
    assert kept[4].count() == kept[3].count()
    assert {r["shard"] for r in kept[4].collect()} <= set(range(16))
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.select("doc_id", "shard", "slot").collect())) == sorted(map(str, kept[4].select("doc_id", "shard", "slot").collect()))
