"""Plain versions of what the operators do, for small tables."""

import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text, n=3):
    w = words(lower(text))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(s))


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def root(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def near(fps, distance=2):
    """Root (least index) of each fingerprint's group."""
    g = Groups(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                g.join(i, j)
    return [g.root(i) for i in range(len(fps))]


def shingles(text, n=5):
    w = words(lower(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or {tuple(w)}


def repeat_words(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})


def clean(text):
    """What the pipeline's quality rules keep."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    dup, chars, count = len(lines) - len(set(lines)), sum(map(len, w)), lambda chars: sum(c in chars for c in text)
    bad = not w or 2 * repeat_words(text) > len(w) or 10 * count("#*$%&|<>") > len(w) or 4 * count("!") > len(w) or dup >= 3 and 100 * dup > 30 * len(lines)
    return not bad and 2 * len(w) <= chars <= 15 * len(w)
