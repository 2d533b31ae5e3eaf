"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; and the parts on their own."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perievent.llm import base, decontaminate, html, langid, lm, mixing, pii, quality, sharding, simhash, tokens
from tests.llm import brute

SHAPE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()), T.StructField("row", T.StringType())])
ODD = [(1, None, None, None, 0, 7, "x"), (2, "", "en", "a", 0, None, None), (3, " \t\n", "en", "b", 3, 1, "y"), (None, "a b c d " * 40, "en", None, 9, 1, "z"), (5, "word " * 60_000, "fr", "a", 1, 1, "w"), (5, "word " * 60_000, "fr", "a", 1, 1, "w"), (6, "é ß 漢字 🙂 " * 30, None, "c", 1, 1, ""), (7, "x", "en", "b", 1, 1, "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def everything(spark, df):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, None), (3, ""), (None, "five short words are here")], "item_id long, text string")
    docs = df.select("doc_id", "text", "lang", "source", "n_chars")
    return {
        "mix": mixing.mixed_documents(df), "shard": sharding.sharded_documents(df), "quality": quality.keep(df), "dedup": simhash.deduplicate(df), "clean": decontaminate.clean(df, bench), "leaks": decontaminate.leaks(df, bench),
        "lang": langid.identify(df, langid.train(docs)), "lm": lm.score(df), "pii": pii.personal_data(df), "fingerprints": simhash.fingerprints(docs.select("doc_id", "text"), "text", 3),
    }


def test_odd_rows_have_results(spark, odd):
    got = {k: v.collect() for k, v in everything(spark, odd).items()}
    assert len(got["shard"]) == len(got["lang"]) == len(got["lm"]) == len(got["pii"]) == len(got["fingerprints"]) == len(ODD)
    assert [r["lang_pred"] for r in got["lang"] if r["doc_id"] in (1, 2, 3)] == ["und"] * 3
    ends = [r["score"] for r in got["lm"] if r["doc_id"] in (1, 2)]  # a null and an empty text are their ends
    assert len(ends) == 2 and ends[0] == ends[1] < 0
    # texts without a word are one group, and the repeated row goes
    assert len(got["dedup"]) == len(ODD) - 3
    assert len(got["clean"]) == len(ODD) and got["leaks"] == []
    assert "size" in got["shard"][0].asDict() and sorted(r["slot"] for r in got["shard"] if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in got["shard"])))


def test_odd_texts_and_clashing_names(spark):
    """Counts and pages of odd rows; columns of a caller's that have the names that operators use inside."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [None, "", " \t\n", "x", "x", "word " * 60_000, "é ß 漢字 🙂 " * 30, "some fine words stand here"]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, has_letter string, like string, _node string, n_tokens string")
    got = {r["doc_id"]: r for r in tokens.count_tokens(df, "text", path).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: len(Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert all(r["like"] == "b" for r in got.values())
    docs = df.select("doc_id", "text", F.lit("en").alias("lang"), "has_letter", "like", "_node")
    for out in (langid.identify(docs, langid.train(docs)), simhash.deduplicate(docs), quality.keep(docs, quality.FILTER), decontaminate.clean(docs, docs.select(F.col("doc_id").alias("item_id"), F.lit(None).cast("string").alias("text"))), sharding.sharded_documents(docs)):
        rows = out.collect()
        assert rows and all((r["has_letter"], r["like"], r["_node"]) == ("a", "b", "c") for r in rows)
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "like")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert got == {i: "" if i in (0, 1, 2) else t.strip() for i, t in enumerate(texts)} and len(got) == 8


def test_empty_tables_give_no_rows(spark, none):
    for k, v in everything(spark, none).items():
        assert v.count() == 0, k
    assert tokens.count_tokens(none.select("doc_id", "text"), "text", __import__("public_tokenizers").path("word_bpe_49k.json")).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_mixing_targets():
    got = mixing.source_targets({"a": 10, "b": 1000, None: 1000, "c": 100})
    assert list(got) and got["a"] == 20 and sum(got.values()) == pytest.approx(1.5 * 2110) and all(got[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 1000, None: 1000, "c": 100}.items())
    assert mixing.source_targets({"a": 0}) == {"a": 0.0}


def test_knapsack_is_best():
    rng = random.Random(4)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        got = mixing.knapsack(lengths, counts, budget)
        best = min(abs(int((np.array(c) * lengths).sum()) - budget) for c in itertools.product(*[range(n + 1) for n in counts]))
        assert (got <= counts).all() and abs((got * lengths).sum() - budget) == best
        assert (mixing.fit_counts(lengths, counts, budget) <= counts).all()


def test_large_budget_is_met():
    rng = np.random.default_rng(0)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 5, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    assert abs((mixing.fit_counts(lengths, counts, budget) * lengths).sum() - budget) <= 2


def test_differencing_is_tight():
    rng = random.Random(1)
    items = sorted((rng.randint(1, 10**6), str(i)) for i in range(2000))
    got = sharding.differencing(items, 16)
    sums = [sum(s for s, i in items if got[i] == k) for k in range(16)]
    assert len(got) == 2000 and max(sums) - min(sums) <= 50
    assert sharding.differencing([], 4) == {} and sharding.differencing([(5, "a")], 4) == {"a": 0}
    assert sorted(sharding.differencing([(4, "a"), (5, "b"), (6, "c"), (7, "d"), (8, "e")], 2).values()).count(0) in (2, 3)


def test_links_equal_brute_force(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:
        for _ in range(3):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3]))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(0, f) for f in signed] + [(0, None)], "t int, fp long")
    truth = brute.near(fps)
    for together in (simhash.TOGETHER, 1):  # 1: every key with company is dealt again
        old, simhash.TOGETHER = simhash.TOGETHER, together
        try:
            groups = dict(map(tuple, base.components(simhash.links(df)).collect()))
        finally:
            simhash.TOGETHER = old
        got = [groups.get(f, f) for f in signed]
        assert all((got[i] == got[j]) == (truth[i] == truth[j]) for i in range(len(fps)) for j in range(i))


def test_near_duplicates_and_only_those_go(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(3000)]
    base_docs = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(d)) for i, d in enumerate(base_docs)]
    for i, d in enumerate(base_docs[:15]):
        e = list(d)
        for at in rng.sample(range(200), 2):
            e[at] = "changed"
        rows.append((100 + i, " ".join(e)))
        rows.append((200 + i, " ".join(d)))
    got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(30))


def test_copies_that_only_meet_by_a_text_unlike_both(spark, monkeypatch):
    """A has the words of B and C in another order: every fingerprint agrees, and the least node may be A."""
    rng = random.Random(11)
    rows = []
    for i in range(0, 60, 3):
        w = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(60)]
        for _ in range(8):
            rows.append((1000 + len(rows), " ".join(rng.sample(w, 60))))
        rows += [(i, " ".join(w)), (i + 1, " ".join(w).upper()), (i + 2, "  ".join(w))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _ in rows} - {k for i in range(0, 60, 3) for k in (i + 1, i + 2)}
    assert {r["doc_id"] for r in simhash.deduplicate(df).collect()} == want
    monkeypatch.setattr(simhash, "TOGETHER", 1)
    monkeypatch.setattr(simhash, "AT_ONCE", 1)
    monkeypatch.setattr(simhash, "FEW", 3)
    monkeypatch.setattr(simhash, "MANY", 5)
    monkeypatch.setattr(simhash, "SOME", 1)
    assert {r["doc_id"] for r in simhash.deduplicate(df).collect()} == want


def edited(rng, w, kind):
    """A copy of the words w with five-word shingles 0.8 or more alike."""
    new = lambda n: ["".join(rng.choices("klmnopqrst", k=8)) for _ in range(n)]
    cut = rng.randrange(10, 150)
    return {"added": w + new(48), "put in": w[:cut] + new(40) + w[cut:], "cut off": w[:164], "cut out": w[:cut] + w[cut + 30 :], "words": [x if i not in (50, 110) else new(1)[0] for i, x in enumerate(w)]}[kind]


def test_every_kind_of_edit_is_found(spark):
    rng, rows, kinds = random.Random(12), [], {}
    for kind in ("added", "put in", "cut off", "cut out", "words"):
        for _ in range(20):
            w, i = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(200)], 2 * len(kinds)
            e = edited(rng, w, kind)
            a, b = brute.shingles(" ".join(w)), brute.shingles(" ".join(e))
            assert len(a & b) >= 0.8 * len(a | b)
            rows += [(i, " ".join(w)), (i + 1, " ".join(e))]
            kinds[i + 1] = kind
    got = [r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter(kinds[i] for i in got if i % 2) == {} and len(got) == 100


def test_quality_longer_than_packed(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 50, 400)] + [" ".join(str(rng.randint(0, 60)) for _ in range(140_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.measured(df, quality.REPEATS.needs, "text").select("doc_id", "n_words", "n_repeat_words").collect():
        assert r["n_words"] == len(brute.words(texts[r["doc_id"]])) and r["n_repeat_words"] == brute.repeat_words(texts[r["doc_id"]])


def test_equal_hashes_of_other_words_are_told_apart(spark, monkeypatch):
    """With four bits of hash most windows of a text clash."""
    rng = random.Random(14)
    texts = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (3, 4, 10, 60, 500) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    xx = F.xxhash64
    for packed in (1 << 17, 1):
        with monkeypatch.context() as m:
            m.setattr(quality, "PACKED", packed)
            m.setattr(quality.F, "xxhash64", lambda *c: F.shiftleft(xx(*c) % 8, 58))
            rows = quality.measured(df, quality.REPEATS.needs, "text").select("doc_id", "n_repeat_words")
        assert {r["doc_id"]: r["n_repeat_words"] for r in rows.collect()} == {i: brute.repeat_words(t) for i, t in enumerate(texts)}


def test_rejected_texts_are_not_measured_again(spark, monkeypatch):
    """A rule that can't be asked of some texts runs after one that rejects them."""
    bad = "junk " * 5
    df = spark.createDataFrame([(i, bad if i % 2 else f"fine text {i}", "mine") for i in range(50)], "doc_id long, text string, _words string")
    first = quality.Rule("first", (), lambda text: F.col(text) == bad)
    second = quality.Rule("second", (), lambda text: F.when(F.col(text) == bad, F.raise_error(F.lit("asked again")).cast("boolean")).otherwise(F.lit(False)))
    monkeypatch.setattr(quality, "order", lambda docs, rules, *a: list(rules))
    got = quality.keep(df, (first, second)).collect()
    assert {r["doc_id"] for r in got} == set(range(0, 50, 2)) and all(r["_words"] == "mine" for r in got)
    with pytest.raises(Exception, match="asked again"):
        quality.keep(df, (second, first)).collect()


def test_order_is_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 300 if i % 2 else "x! " * 200) for i in range(200)], "doc_id long, text string")
    never = quality.Rule("never", (), lambda text: F.lit(False))
    half = quality.Rule("half", (), lambda text: F.contains(F.col(text), F.lit("!")))
    assert [r.name for r in quality.order(df, (never, quality.REPEATS, half))][0] != "never"
    assert [r.name for r in quality.order(df, (never, half))] == ["half", "never"]


def test_tokens_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, c, rng = Tokenizer.from_file(path), tokens.PairCounter(path), random.Random(7)
    pool = "aAbBéÉßΣσςİıǅﬁ①²½٣中文ひ한🙂́‍ 　 \t\n\x85 '<|endoftext|>.,-_0123'S's'll"
    for _ in range(3000):
        x = "".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x"])
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    assert c.count("ab" * 5000) == len(t.encode("ab" * 5000, add_special_tokens=False).ids)


def test_personal_data_edges(spark):
    texts = ["a@b.c@d.e", "a@b.com_x@y.z", "1.2.3.4.5.6.7.8", "999.1.1.1 000255.1.2.3", "+1 (743) 555-3824.", "4111 1111-1111 1111", "é🙂 +12 345 678 901)", "a" * 20000, "1-" * 9000 + "1", "x@y.z " * 400, "@", ""]
    got = {r["row"]["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    from tests.llm.test_text_queries import base_spans

    for i, t in enumerate(texts):
        assert [(k, s["start"], s["end"]) for k in pii.KINDS for s in got[i][k]] == base_spans(t), t[:40]


def added(spark, rows):
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, email string")
    got = pii.personal_data(df).collect()
    assert all(r["row"]["email"] == "mine" for r in got)
    text = dict(rows)
    return {r["row"]["doc_id"]: [(a["kind"], text[r["row"]["doc_id"]][a["start"] : a["end"]]) for a in r["added"]] for r in got}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"please mail reach me {i}user@mail.example.com now number {i} of them") for i in range(20)]
    rows += [(100 + i, f"please mail reach me user{i}x(at)mail today") for i in range(3)] + [(200 + i, f"nothing here code{i}77 at all") for i in range(9)]
    got = added(spark, rows)
    assert all(got[100 + i] == [("email", f"user{i}x(at)mail")] for i in range(3))
    assert all(not got[200 + i] for i in range(9)) and all(not got[i] for i in range(20))


def test_found_identifiers_induce_patterns(spark):
    """Recall and precision on planted identifiers: of several tokens, in words that only found ones share, secrets."""
    hexa = lambda i: f"{i * 7919:08x}a0" * 4
    rows = [(i, f"you can call +1 (743) 555-{3000 + i} or write") for i in range(30)]
    rows += [(100 + i, f"you can call 743 555 {4000 + i} or write") for i in range(6)]  # the same words, another form
    rows += [(200 + i, f"my line is 743 555 {4000 + i}, thanks") for i in range(6)] + [(300, "my line is 020 7946 0958, thanks")]  # words of the found ones
    rows += [(400 + i, f'set token = "{hexa(i)}"; done') for i in range(8)] + [(450, 'set token = "short1pass"; done')]
    rows += [(500 + i, f"mail {i}box@mail.example.com today") for i in range(25)] + [(550, "mail ann at example dot com today")]
    rows += [(600 + i, f"version {i}.{i}.1 of item{i}x costs {i}000 units in 2020 or 20{i:02d}") for i in range(40)] + [(700, "the line is 12 units long and 1234 wide")]
    got = added(spark, rows)
    want = {100 + i: [("phone", f"743 555 {4000 + i}")] for i in range(6)} | {200 + i: [("phone", f"743 555 {4000 + i}")] for i in range(6)} | {300: [("phone", "020 7946 0958")]}
    want |= {400 + i: [("secret", hexa(i))] for i in range(8)} | {450: [("secret", "short1pass")], 550: [("email", "ann at example dot com")]}
    assert {i: x for i, x in got.items() if x} == want


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="nav-open">
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div id="cookie-notice">We use cookies</div>
<main><article><h1>Head &amp; line</h1><p>First  <b>bold</b> &eacute;<br>same block<p>Second<aside>Side</aside> para<form>Mail <input><textarea>x</textarea></form>
<div class="ad">Buy</div></article><section class="comments"><article>Me too!</article></section></main><footer>Bye</footer></body></html>"""


def test_page_text(spark):
    pages = [(1, "http://h.example/1", PAGE), (2, None, None), (3, "http://h.example/3", ""), (4, "::bad[", "<p>plain"), (5, "x", "<div>a &lt; b<!-- no --> c</div>")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    text = "Head & line\nFirst bold é same block\nSecond\npara"
    assert got[1] == (text, len(text)) and got[2] == got[3] == ("", 0) and got[4] == ("plain", 5) and got[5][0] == "a < b c"


@pytest.mark.parametrize(
    "page",
    [
        '<div style="overflow:hidden"><article><p>One</p><p>Two</p></article></div>',
        '<article title="Hidden gems" data-id="comments" data-hidden="x"><p>One</p><p>Two</p></article>',
        "<article><p>One</p><svg viewBox='0 0 1 1'/><iframe src=a />  <p>Two</p></article>",
        "<article><p>One</p><div><select><option>no</div><p>Two</p></article>",
        "<article><p>One</p><iframe src=http://x/>no</iframe><p>Two</p></article>",
        "<article><p>One</p><div class='x' hidden>no</div><div hidden=''>no</div><div id=comments>no</div><p>Two</p></article>",
    ],
)
def test_attributes_and_raw_elements(page):
    assert [t for t, main, dropped, _ in html.blocks(page) if main and not dropped] == ["One", "Two"]


def test_repeated_runs_of_a_host_go(spark):
    shared = "this line stands on every page of the host and says nothing at all"
    pages = [(i, f"http://a.example/{i}", f"<div>{shared}</div><div>own words of page number {i} that no other page has {'x' * i}</div>") for i in range(6)]
    pages += [(10, "http://b.example/", f"<div>{shared}</div>"), (11, "http://a.example/copy", pages[0][2])]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(shared not in got[i] and "own words" in got[i] for i in range(6)) and got[10] == shared and got[11] == got[0]


def test_hints_inside_an_article_are_settled_by_repetition(spark):
    own = lambda i: " ".join(f"w{i}w{k}" for k in range(12))
    same = "follow us on every network and tell all your friends"
    page = lambda i: f"<article><p>Text {i}</p><section id='related-work'><p>{own(i)}</p></section><div class='share'>{same}</div><p>{same}</p><p class='share'>{own(i)[::-1]}</p></article>"
    pages = [(i, f"http://a.example/{i}", page(i)) for i in range(4)] + [(9, "http://b.example/", page(9)), (9, "http://b.example/", page(9))]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    text = lambda i, shared: "\n".join([f"Text {i}", own(i), *[same] * shared, own(i)[::-1]])
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([(i, text(i, 1)) for i in range(4)] + [(9, text(9, 2))] * 2)


def test_runs_equal_brute_force(spark):
    """Pages without an article: what is left is what no other page of the host has in a run of eight tokens."""
    rng = random.Random(13)
    runs = [[rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(6, 30))] for _ in range(12)]
    pages = {}
    for i in range(40):
        lines = [rng.choice(runs) if rng.random() < 0.5 else ["".join(rng.choices("klmnop", k=7)) for _ in range(rng.randint(1, 20))] for _ in range(8)]
        pages[i] = (f"http://{'ab'[i % 2]}.example/{i}", lines)
    pages[90] = pages[0]
    rows = [(i, u, "".join(f"<p>{' '.join(x)}</p>" for x in p), "x") for i, (u, p) in pages.items()] + [(99, "http://a.example/long", "<p>" + "word " * 200_000 + "</p>", "x")]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[99] == " ".join(["word"] * 200_000)
    stream = {i: [w for x in p for w in x] for i, (_, p) in pages.items()}
    grams = {i: {tuple(s[k : k + 8]) for k in range(len(s) - 7)} for i, s in stream.items()}
    for i, (u, p) in pages.items():
        others = set().union(*(grams[j] for j, (v, _) in pages.items() if v[:8] == u[:8] and stream[j] != stream[i]))
        s = stream[i]
        hidden = {k + n for k in range(len(s) - 7) if tuple(s[k : k + 8]) in others for n in range(8)}
        want, at = [], 0
        for x in p:
            own = [w for k, w in enumerate(x) if at + k not in hidden]
            want.append(" ".join(own if 2 * len(own) <= len(x) else x))
            at += len(x)
        assert got[i] == "\n".join(filter(None, want))


def test_leaks_tolerate_substitutions(spark):
    rng = random.Random(8)
    w = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    item, short, tiny = w(40), w(7), w(3)
    swapped = list(item)
    for at in range(3, 40, 8):
        swapped[at] = "other"
    docs = [(1, w(50) + item + w(50)), (2, w(9) + swapped), (3, w(200)), (4, w(5) + short + w(5)), (5, w(5) + tiny + w(5)), (6, item[:14]), (7, item[:9] + w(9) + item[9:18]), (8, item[-11:])]
    items = [(10, " ".join(item).upper()), (11, " ".join(short)), (12, " ".join(tiny)), (13, " ".join(item)), (14, " ".join(w(20) + item[10:] + w(3)))]
    docs = spark.createDataFrame([(i, " ".join(d), "mine") for i, d in docs], "doc_id long, text string, start string")
    items = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, items).collect()
    assert {(r["row"]["doc_id"], r["item_id"]) for r in got} == {(1, 10), (2, 10), (4, 11), (5, 12), (6, 10), (8, 10), (1, 14), (2, 14), (8, 14)}
    assert all(r["row"]["start"] == "mine" for r in got) and {r["item_id"]: r["n_items"] for r in got} == {10: 2, 11: 1, 12: 1, 14: 1}
    assert 12 not in {r["item_id"] for r in decontaminate.leaks(docs, items, shortest=5).collect()}
    assert {(r["start"], r["end"]) for r in got if r["row"]["doc_id"] == 4} == {(5, 12)}
    assert {(r["start"], r["end"]) for r in got if r["row"]["doc_id"] == 8} == {(0, 11)}
    assert {(r["item_id"], r["class_id"]) for r in decontaminate.item_classes(items).collect()} == {(10, 10), (11, 11), (12, 12), (13, 10), (14, 14)}
    assert {r["doc_id"] for r in decontaminate.clean(docs.withColumn("like", F.lit(1)), items).collect()} == {3, 7}
    assert {r["doc_id"] for r in decontaminate.clean(docs.withColumn("like", F.lit(1)), items, shortest=5).collect()} == {3, 5, 7}
    named = items.withColumn("item_id", F.concat(F.lit("item "), "item_id"))
    assert {r["item_id"] for r in decontaminate.leaks(docs, named, shortest=3).collect()} == {"item 10", "item 11", "item 12", "item 14"}


def test_every_substitution_that_a_leak_allows_is_seen(spark):
    """All pairs of substitutions in 13 tokens, all single ones in 7 to 12, none in 5 and 6; more are no leak."""
    rng = random.Random(9)
    w = lambda n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    items, docs, want = [], [], set()
    for n in range(5, 14):
        item, allowed = w(n), n - math.ceil(n * decontaminate.NEEDED / decontaminate.WINDOW)
        assert allowed == (2 if n == 13 else 1 if n >= 7 else 0)
        items.append((n, " ".join(item)))
        for k in (allowed, allowed + 1):
            for places in itertools.combinations(range(n), k):
                doc_id = len(docs)
                docs.append((doc_id, " ".join(w(14) + ["zzz" if i in places else x for i, x in enumerate(item)] + w(14))))
                if k == allowed:
                    want.add((doc_id, n))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["row"]["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_block_estimate():
    for a, b in ((0, 0), (3, 5), (40, 0)):
        exact, n0, n1 = 0.0, 0, 0
        for bit in [0] * a + [1] * b:
            exact += math.log((n1 if bit else n0) + 0.5) - math.log(n0 + n1 + 1)
            n0, n1 = n0 + (1 - bit), n1 + bit
        assert lm.kt_block(np.array([float(a)]), np.array([float(b)]))[0] == pytest.approx(exact, abs=1e-9)


@pytest.mark.parametrize("depth", [lm.DEPTH, lm.DEEPEST])
def test_tree_equals_a_plain_one(spark, monkeypatch, depth):
    """Scores against context-tree weighting written out node by node, with all runs looked up in tasks and with none."""
    train = {i: t for i, t in enumerate(["abracadabra", "abba", "cab", "abé", "", "zz top abracadabra"]) if zlib.crc32(str(i).encode()) % 7 != 2}
    count = {}
    for t in train.values():
        d = t.encode() + lm.END
        for i, y in enumerate(d):
            for k in range(depth + 1):
                c = tuple(d[i - j] if i >= j else 0 for j in range(1, k + 1))
                for level in range(8):
                    node = count.setdefault((c, (1 << level) | (y >> (8 - level))), [0, 0])
                    node[y >> (7 - level) & 1] += 1

    def block(c, p):
        own = float(lm.kt_block(np.array([float(count[c, p][0])]), np.array([float(count[c, p][1])]))[0])
        if len(c) == depth:
            return own, 1.0
        below = sum(block(k, p)[0] for k, q in list(count) if q == p and len(k) == len(c) + 1 and k[: len(c)] == c)
        both = np.logaddexp(own, below) - math.log(2)
        return both, math.exp(own - math.log(2) - both)

    def one(c, p, k=0):
        if (c[:k], p) not in count:
            return 0.5
        a, b = count[c[:k], p]
        kt = (b + 0.5) / (a + b + 1)
        if k == depth or (c[: k + 1], p) not in count:
            return kt
        w = block(c[:k], p)[1]
        return w * kt + (1 - w) * one(c, p, k + 1)

    def plain(t):
        d, total = t.encode() + lm.END, 0.0
        for i, y in enumerate(d):
            c = tuple(d[i - k] if i >= k else 0 for k in range(1, depth + 1))
            chances = [one(c, (1 << level) | (y >> (8 - level))) for level in range(8)]
            total += sum(math.log10(q if y >> (7 - level) & 1 else 1 - q) for level, q in enumerate(chances))
        return total

    tests = {100 + i: t for i, t in enumerate(["abra", "zab", "", "cabcab", "abracadabra", "étude abra"])}
    tests = {i: t for i, t in tests.items() if zlib.crc32(str(i).encode()) % 7 == 2} or dict([next((i, "zab étude abracadabra cab") for i in range(200, 300) if zlib.crc32(str(i).encode()) % 7 == 2)])
    rows = [*train.items(), *tests.items()]
    for common in (1 << 22, 1e-9):
        monkeypatch.setattr(lm, "COMMON", common)
        got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), depth).collect()}
        assert got == {i: pytest.approx(plain(t), abs=1e-9) for i, t in rows}


def test_byte_chances_sum_to_one(spark):
    """Over all 256 next bytes, after seen and unseen contexts."""
    grams = lm.count(spark.createDataFrame([("the cat sat on the mat",), ("a hat",)], "text string"), 6).filter("gram is not null").select("gram", "n")
    nodes = lm.tree(base.stash(grams), 6)
    rows = [(int.from_bytes(c, "little") << 8 | y,) for c in (b"e ht e", b"zzzzzz", b"t ah\0\0", b"\0\0\0\0\0\0") for y in range(256)]
    values = lm.unseen_values(spark.createDataFrame(rows, "gram long"), nodes)
    sums = values.groupBy(F.shiftright("gram", 8).alias("c")).agg(F.sum(F.pow(F.lit(10.0), "value")).alias("s")).collect()
    assert [r["s"] for r in sums] == [pytest.approx(1)] * 4


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm.score(spark.createDataFrame([(held, "abc")], "doc_id long, text string")).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 2, 0, 0) and r["score"] == pytest.approx(4 * math.log10(1 / 256))


def test_depth_has_bounds(spark):
    with pytest.raises(ValueError):
        lm.score(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), 7)


def test_an_empty_text_costs_its_end(spark):
    """Texts that end at once are likelier the more of them training has seen, and never certain."""
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    ends = []
    for empty in (1, 20):
        rows = [(i, "" if k < empty else "abc") for k, i in enumerate(train[:40])] + [(held, None)]
        ends.append(next(r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == held))
    assert ends[0] < ends[1] < 0 and 10 ** ends[1] == pytest.approx(0.5, abs=0.1)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content-with-sidebar"><article><h1>T</h1><p>Hello world</p></article></div>', "T\nHello world"),
        ('<div class="layout has-menu"><main><p>Hello world</p></main></div>', "Hello world"),
        ('<article class="post sidebar"><p>Hello world</p></article>', "Hello world"),
        ('<div id="page-header-wrap"><p>Hello world</p></div>', "Hello world"),
        ('<article><p>Our dishes</p><section class="menu"><p>Soup 4</p></section></article>', "Our dishes\nSoup 4"),
        ('<article><p id="notice">Be careful</p><p>Text</p></article>', "Be careful\nText"),
        ('<article><p>Text</p><section class="user-comments"><p>First!</p></section></article>', "Text"),
        ('<article><p>Text</p></article><article class="comment"><p>First!</p></article>', "Text"),
        ('<div class="post-with-comments"><article><p>Text</p><div class="reader-comment">no</div></article></div>', "Text"),
        ('<nav><article><p>Not this</p></article></nav><main><p>This</p></main>', "This"),
    ],
)
def test_names_around_and_inside_an_article(spark, page, want):
    df = spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")
    assert html.extract(df).first()["text"] == want


def test_hinted_text_of_pages_without_an_article_goes_where_it_repeats(spark):
    rng = random.Random(8)
    own = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(3)]
    wrap = '<div class="share-widget">share this page with all of your good old friends today</div>'
    rows = [(i, "http://h.x/1", f'<div>{wrap}<p>{t}</p><p class="promo">{t[::-1]}</p></div>') for i, t in enumerate(own)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{t}\n{t[::-1]}" for i, t in enumerate(own)}


def page_texts(spark, rows):
    return {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_an_article_is_part_of_its_page_stream(spark):
    """Pages differ by their articles, and an article's text tells that another page's teaser repeats it."""
    rng = random.Random(21)
    own = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(4)]
    share = '<div class="share">follow us on every network and tell all your friends</div>'
    rows = [(i, "http://h.x/1", f"<article><p>{t}</p>{share}</article>") for i, t in enumerate(own)]
    rows += [(8, "http://i.x/1", f"<article><p>{own[0]}</p></article>"), (9, "http://i.x/2", f'<article><p>{own[1]}</p><div class="related">{own[0][:83]}</div><p class="promo">{own[2]}</p></article>')]
    # What an article holds is no boilerplate of a page without one.
    rows += [(10, "http://j.x/1", rows[4][2]), (11, "http://j.x/2", f'<div><p>{own[0]}</p><p class="promo">{own[0][:83]}</p></div>')]
    assert page_texts(spark, rows) == dict(enumerate(own)) | {8: own[0], 9: f"{own[1]}\n{own[2]}", 10: own[0], 11: own[0]}


@pytest.mark.parametrize("chunk", [1, 1 << 21])
def test_runs_of_most_articles_of_a_host_go(spark, monkeypatch, chunk):
    """An unnamed block goes if over three quarters of a host's articles have it; what three quarters or half of them have,
    copies, and what small hosts repeat stay."""
    monkeypatch.setattr(html, "CHUNK", chunk)
    rng = random.Random(22)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    notice, passage, own = text(9), text(12), [[text(15), text(15)] for _ in range(12)]
    page = lambda *blocks: "<article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"
    rows, want = [], {}
    for i, (a, b) in enumerate(own):
        has = [notice] * (i < 10)
        rows += [(i, "http://a.x/", page(a, *has, b, *[passage] * (i % 2))), (100 + i, "http://b.x/", page(a, *[notice] * (i < 9), b))]
        want |= {i: [a, b, *[passage] * (i % 2)], 100 + i: [a, *[notice] * (i < 9), b]}
        rows.append((200 + i, "http://c.x/", page(own[0][0], own[0][1], f"version {i}")))
        want[200 + i] = [*own[0], f"version {i}"]
        if i < 7:
            rows.append((300 + i, "http://d.x/", page(a, notice, b)))
            want[300 + i] = [a, notice, b]
    # Copies of a page are one page: nine of twelve different ones aren't over three quarters.
    rows += [(400 + i, "http://b.x/", page(own[0][0], notice, own[0][1])) for i in range(5)]
    want |= {400 + i: [own[0][0], notice, own[0][1]] for i in range(5)}
    assert page_texts(spark, rows) == {i: "\n".join(x) for i, x in want.items()}


def test_a_short_item_word_for_word_is_a_leak(spark):
    docs = spark.createDataFrame([(1, "he said open sesame now please and went"), (2, "open the door"), (3, "Open Sesame, now please")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "open sesame now please")], "item_id long, text string")
    assert sorted(r["row"]["doc_id"] for r in decontaminate.leaks(docs, items).collect()) == [1, 3]
    assert [r["doc_id"] for r in decontaminate.clean(docs, items).collect()] == [2]


def test_a_line_of_very_many_texts_costs_no_more_steps(spark):
    """Near-dedup takes as many jobs for a common line in 60 texts as in 600."""
    rng, jobs = random.Random(4), []
    for n in (60, 600):
        line = "this very line of eight words stands everywhere "
        rows = [(i, line * 3 + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12))) for i in range(n)]
        sc = spark.sparkContext
        sc.setJobGroup(f"line{n}", "near-dedup")
        got = {r["doc_id"] for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"line{n}")))
        sh = [(i, brute.shingles(t)) for i, t in rows]
        if n == 60:
            same = {i: min([j for j, b in sh if len(a & b) >= 0.8 * len(a | b)]) for i, a in sh}
            assert got == {i for i in same if same[i] == i}
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= 1.5 * jobs[0] + 20
