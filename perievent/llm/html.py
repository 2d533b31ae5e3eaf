"""Main text of HTML pages, with repeated runs of a host's pages told by a suffix array.

A page is read into blocks of text, and all of its text, its article too, is a token stream. The suffix array of a host's
streams is ordered to a depth of RUN tokens and never built in one place: suffixes are dealt over the cluster by host and
the hash of that prefix, where equal prefixes meet; the repeated substrings of RUN or more tokens are the unions of such
prefixes. Left out are only suffixes whose prefix can't be one that a page's text depends on. Pages are different if
their streams are, so copies of a page don't empty each other.

What a run decides depends on where it stands:
* Blocks inside an article or main element whose own or whose containers' names hint at boilerplate go if another page
  of the host has them anywhere.
* On pages without such an element, blocks that elements and names don't drop go if another page has them outside of
  articles, blocks with a hint if it has them anywhere.
* An article's plain blocks go if they stand in the articles of over three quarters of the host's pages, of LEAST different
  ones at least, and aren't most of the article: articles of one host share passages and copies of each other, which are text.
  The README has the figures.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perievent.llm import base

RUN = 8
#: Of so many different pages of a host at least, what stands in over three quarters of their articles isn't theirs.
LEAST = 8
#: Article runs are compared within a task, so many at a time.
CHUNK = 1 << 21
#: Where a run of a host's is found: on two different pages, so outside of articles, in most articles.
ANY, OPEN, MOST = 1, 2, 4
#: Elements whose text is never shown or never belongs to an article.
RAW = frozenset("script style template noscript iframe object svg math textarea title select option button canvas audio video".split())
DROPPED = frozenset("nav aside footer form dialog menu head".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class or id that name what isn't the article, those that may mean a part of one, and values of role.
NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr masthead nav navbar navigation newsletter sidebar signup sponsor sponsored subscribe subscription".split())
HINTS = frozenset("banner copyright header login menu modal notice popup promo promoted related reply replies respond share sharing social toolbar widget widgets".split())
#: Last words of names of what readers write.
COMMENTS = frozenset("comment comments commentlist disqus replies".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
#: A closed paragraph: the elements that end an open p or li of their own kind.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")
_BARE = re.compile(r"=\s*[^\s\"'>]+/$")
_SPLIT = re.compile(r"[^a-z0-9]+")


def named(attrs: str, article: bool = False) -> str:
    """drop, hint (at boilerplate), main or nothing, by an element's class, id, role and the like. A name of several
    words drops if all of them do, or if the last one says that readers write there; it hints if one does. An article
    drops by its names only if all of them say so."""
    verdict, names = "", []
    for m in _ATTR.finditer(attrs):
        key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "drop"
        if key in ("class", "id"):
            for name in value.split():
                words = [x for x in _SPLIT.split(name) if x]
                parts = set(words)
                out = bool(parts) and (parts <= NAMES or words[-1] in COMMENTS and parts.isdisjoint({"with", "has", "no"}))
                if out and not article:
                    return "drop"
                names.append(out)
                if not parts.isdisjoint(NAMES | HINTS):
                    verdict = verdict or "hint"
        elif key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
            verdict = "main"
    return "drop" if names and all(names) else verdict


def raw_end(html: str, at: int, name: str, parents: list[str]) -> int:
    """Where a raw element that starts before `at` ends: after its own end tag, or, without one, where the innermost open
    element that has an end tag ends."""
    for x, own in ((name, True), *((p, False) for p in reversed(parents))):
        end = re.compile(rf"</{re.escape(x)}(?=[\s/>])[^>]*>", re.I).search(html, at)
        if end:
            return end.end() if own else end.start()
    return len(html)


#: A block: its text, whether it is in an article or main element, whether its container is boilerplate, whether a name
#: (inside the article, or anywhere on a page without one) hints at that.
Block = tuple[str, bool, bool, bool]


def blocks(html: str | None) -> list[Block]:
    """The page's blocks in order. Character references are decoded, white space is one space, empty blocks are left out.
    Broken markup (open elements, stray ends) is read as far as it goes."""
    out: list[Block] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # element, in main, dropped (1 by a form alone: some wrap whole pages), hint
    html, at, n = html or "", 0, len(html or "")

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                main, dropped, hint = stack[-1][1:] if stack else (False, 0, False)
                out.append((text, main, dropped > 0, hint))

    while at < n:
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            parts.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[1]:
            parts.append(m[1])
        if not m[3]:
            continue
        name = m[3].lower()
        if name in RAW and not m[2]:
            if not m[4].endswith("/") or _BARE.search(m[4]):  # the slash of a bare value closes nothing
                at = raw_end(html, at, name, [x for x, *_ in stack])
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in MAIN | DROPPED and name not in BLOCKS:
                    break  # a stray inline end doesn't leave a container
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in CLOSES or name == "p":
            while stack and stack[-1][0] in CLOSES.get(name, {"p"}):
                stack.pop()
        main, dropped, hint = stack[-1][1:] if stack else (False, 0, False)
        verdict = named(m[4], name in MAIN) if m[4] else ""
        outside = name in DROPPED or name == "header" and not main or verdict == "drop" and name not in ("html", "body")
        starts = (name in MAIN or verdict == "main") and dropped < 2
        inside = (main or starts) and not outside
        # What a name around an article hints at isn't said of the article.
        stack.append((name, inside, max(dropped, (1 if name == "form" and verdict != "drop" else 2) if outside else 0), hint and (main or not starts) or verdict == "hint" and not (starts and not main)))
    flush()
    return out


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def prefixes(tokens: list[str], host: str) -> np.ndarray:
    """The hash of the RUN tokens from each suffix's start on, and of the host."""
    n = max(len(tokens) - RUN + 1, 0)
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    h = np.full(n, xxhash.xxh64_intdigest(host), np.uint64)
    for k in range(RUN if n else 0):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += each[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def stream(page: list[Block]) -> list[str]:
    """The tokens of a page, all of which the suffix array is about."""
    return " ".join([text for text, *_ in page]).split()


def suffixes(page: list[Block], host: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each suffix's first RUN tokens; whether all of them are an article's plain text, whether none is, and
    whether the page's text depends on any page that repeats them."""
    sizes = [text.count(" ") + 1 for text, *_ in page]  # white space in blocks is one space
    has_main = any(main for _, main, *_ in page)

    def count(flags: list[bool]) -> np.ndarray:
        c = np.cumsum(np.concatenate([[0], np.repeat(np.array(flags, dtype=np.int64), sizes)]))
        return c[RUN:] - c[:-RUN]

    plain = count([main and not hint for _, main, _, hint in page])
    asks = count([main and hint if has_main else not dropped for _, main, dropped, hint in page])
    return prefixes(stream(page), host), plain == RUN, plain == 0, asks > 0


def unique_text(page: list[Block], host: str, runs: dict[int, int]) -> str:
    """The page's text: its article, or, where it has none, what isn't boilerplate by name, without what the runs (the hash
    of a prefix, and where it is found) say is boilerplate."""
    has_main = any(main for _, main, *_ in page)
    if not runs:
        return "\n".join([text for text, main, dropped, _ in page if main or not dropped and not has_main])
    tokens = stream(page)
    covered = np.zeros(len(tokens), np.uint8)
    for i, h in enumerate(prefixes(tokens, host).tolist()):
        if h in runs:
            covered[i : i + RUN] |= runs[h]
    blocks_of, at = [], 0
    for block in page:
        found = block[0].split()
        blocks_of.append((*block, found, covered[at : at + len(found)]))
        at += len(found)
    shared = [(c & MOST) > 0 for _, main, _, hint, _, c in blocks_of if main and not hint]
    few = 2 * sum(int(c.sum()) for c in shared) <= sum(map(len, shared))  # else the articles are copies
    kept = []
    for text, main, dropped, hint, found, c in blocks_of:
        if main and not hint:
            if not (few and ((c & MOST) > 0).all()):
                kept.append(text)
            continue
        hidden = (c & (ANY if hint else OPEN)) > 0
        # A run may reach a few words into a block of its page's own; a block loses words if it is covered by half.
        left = [w for w, x in zip(found, hidden) if not x] if 2 * int(hidden.sum()) >= len(found) else found
        if left and (main or not dropped and not has_main):
            kept.append(" ".join(left))
    return "\n".join(kept)


def pack(pages: list[list[Block]]) -> pa.ListArray:
    """Blocks as array<struct<text, kind>>, the kind's bits are main, dropped and hint."""
    flat = [x for page in pages for x in page]
    columns = [pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] + 2 * x[2] + 4 * x[3] for x in flat], pa.int8())]
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, pages)]).astype(np.int32), pa.StructArray.from_arrays(columns, ["text", "kind"]))


def unpack(column: pa.ListArray) -> list[list[Block]]:
    flat, sizes = column.flatten(), column.value_lengths().to_pylist()
    found = iter([(x, bool(k & 1), bool(k & 2), bool(k & 4)) for x, k in zip(flat.field("text").to_pylist(), flat.field("kind").to_pylist())])
    return [[next(found) for _ in range(n)] for n in sizes]


def most(n, of):
    return 4 * n > 3 * of


def frequent(runs: dict[str, list[np.ndarray]]) -> tuple[list[str], list[list[int]]]:
    """Hosts, and the runs that most of their pages here have: a run of most of all pages is such a one in at least one
    of the parts that the pages are split into."""
    out: dict[str, list[int]] = {}
    for name, pages in runs.items():
        h, n = np.unique(np.concatenate(pages), return_counts=True)
        out[name] = h[most(n, len(pages))].tolist()
    return list(out), list(out.values())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html); a null or empty html gives an empty text.

    Repetition needs two pages of one host whose streams differ, so copies of a page don't empty each other. Null urls
    count as one host. Repeated rows are extracted each, other columns are left out; no rows give no rows.
    """
    spark = pages.sparkSession
    base.small_batches(spark, 500)
    types = dict(pages.dtypes)
    names = ["page_id", "url", "host", "whole", "blocks", "runs"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: dict[str, list[np.ndarray]] = {}
        size, kinds = 0, None

        def candidates() -> pa.RecordBatch:
            """Rows without a page: runs that may be those of most of a host's articles."""
            hosts, runs = frequent(common)
            none = [pa.nulls(len(hosts), k) for k in (*kinds, pa.int64(), pack([]).type)]
            return pa.RecordBatch.from_arrays([*none[:2], pa.array(hosts, pa.string()), *none[2:], pa.array(runs, pa.list_(pa.int64()))], names=names)

        for b in batches:
            kinds = b.column("page_id").type, b.column("url").type
            found, hosts, wholes, asked = [], [], [], []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                page, name = blocks(html), host(url)
                h, plain, _, asks = suffixes(page, name)
                common.setdefault(name, []).append(np.unique(h[plain]))
                size += len(h)
                found.append(page)
                hosts.append(name)
                wholes.append(xxhash.xxh64_intdigest(" ".join([x for x, *_ in page])) - (1 << 63))
                asked.append(np.unique(h[asks]).tolist())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(hosts, pa.string()), pa.array(wholes, pa.int64()), pack(found), pa.array(asked, pa.list_(pa.int64()))], names=names)
            if size >= CHUNK:
                yield candidates()
                common, size = {}, 0
        if common:
            yield candidates()

    shape = f"page_id {types['page_id']}, url {types['url']}, host string, whole long, blocks array<struct<text:string,kind:tinyint>>, runs array<long>"
    # Parsed once; a page's number is given to it before it is written, so it stays with the row.
    parsed = base.stash(pages.select("page_id", "url", "html").mapInArrow(read, shape).withColumn("page", F.monotonically_increasing_id()))
    texts = parsed.filter("blocks is not null")
    hosts = texts.groupBy("host", "whole").agg(F.count(F.lit(1)).alias("n")).groupBy("host").agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("different"))
    common = base.join_hot(parsed.filter("blocks is null").select("host", F.explode("runs").alias("h")), hosts.filter(F.col("different") >= LEAST), ["host"], F.col("h"))
    asked = base.stash(texts.select(F.explode("runs").alias("h")).unionByName(common.select("h")))
    bits = spark.sparkContext.broadcast(base.bit_table(asked))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for number, name, whole, page in zip(b.column("page").to_pylist(), b.column("host").to_pylist(), b.column("whole").to_pylist(), unpack(b.column("blocks"))):
                h, *flags = suffixes(page, name)
                at = np.flatnonzero(base.may_hold(bits.value, h.view(np.uint64)))
                if len(at):
                    one, place = np.unique(h[at], return_inverse=True)
                    for column, x in zip(rows, ([number] * len(one), [name] * len(one), [whole] * len(one), one.tolist(), *((np.bincount(place, f[at]) > 0).tolist() for f in flags))):
                        column.extend(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["page", "host", "whole", "h", "plain", "open", "asks"])

    # The suffixes, a row a page and prefix; equal prefixes of a host meet.
    array = base.stash(texts.select("page", "host", "whole", "blocks").mapInArrow(find, "page long, host string, whole long, h long, plain boolean, open boolean, asks boolean"))
    each = array.groupBy("host", "h", "whole").agg(F.max("open").cast("long").alias("open"), F.max("plain").cast("long").alias("plain"), F.sum(F.col("plain").cast("long")).alias("n"))
    runs = base.stash(each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("any"), *[F.sum(c).alias(c) for c in ("open", "plain", "n")]).filter(F.col("any") > 1))
    template = (F.col("different") >= LEAST) & most(F.col("plain"), F.col("different")) & most(F.col("n"), F.col("pages"))
    how = F.lit(ANY) + F.when(F.col("open") > 1, OPEN).otherwise(0) + F.when(template, MOST).otherwise(0)
    told = base.join_hot(runs, hosts, ["host"], F.col("h")).select("host", "h", how.alias("how"))
    met = base.join_hot(array.filter("asks or plain"), told, ["host", "h"], F.col("page")).filter(F.col("asks") | (F.col("how") >= MOST))
    answers = base.stash(met.groupBy("page").agg(F.collect_list(F.struct("h", "how")).alias("runs")))
    # Only pages with an answer are joined, each under its own number.
    mark = F.xxhash64("page").alias("mark")
    marks = spark.sparkContext.broadcast(base.bit_table(answers.select(mark.alias("h"))))
    final = f"page_id {types['page_id']}, url {types['url']}, text string"

    def chosen(b: pa.RecordBatch, answered: bool) -> pa.RecordBatch:
        may = base.may_hold(marks.value, np.asarray(b.column("mark")).view(np.uint64)).astype(bool)
        return b.filter(pa.array(may == answered))

    def finished(b: pa.RecordBatch, runs: list[dict[int, int]]) -> pa.RecordBatch:
        out = [unique_text(*x) for x in zip(unpack(b.column("blocks")), b.column("host").to_pylist(), runs)]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = chosen(b, False)
            yield finished(b, [{}] * b.num_rows)

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield chosen(b, True)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield finished(b, [{x["h"]: x["how"] for x in r or ()} for r in b.column("runs").to_pylist()])

    left = texts.select("page", mark, "page_id", "url", "host", "blocks")
    asking = left.mapInArrow(those, left.schema).join(answers, "page", "left").select("page_id", "url", "host", "blocks", "runs")
    return left.mapInArrow(without, final).unionByName(asking.mapInArrow(answered, final)).withColumn("n_chars", F.length("text").cast("long"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(base.table(spark, sf_dir, "pages"))


QUERIES, SQL = {"op3_html": op3_html}, {}
