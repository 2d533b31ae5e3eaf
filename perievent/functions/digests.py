"""md5 of many short texts at once, as seeded orders take it."""

from __future__ import annotations

import math

import numpy as np

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _block(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digests of one block each: m has a row for each of its sixteen words. All steps write into the same arrays."""
    a, b, c, d = (np.full(m.shape[1], x) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, _SINES[i], out=a)
        np.add(a, m[g], out=a)
        np.left_shift(a, np.uint32(_TURNS[i]), out=t)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    w = [(x + s).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START)]
    return w[0] << np.uint64(32) | w[1], w[2] << np.uint64(32) | w[3]


def md5_words(before: str, numbers: np.ndarray, after: str = "", chunk: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """The upper and lower half of md5(before + number + after) for each number (not negative), as integers: they order as
    the digests' hexadecimal digits do. A text has 55 bytes at most."""
    n = np.asarray(numbers, dtype=np.int64)
    if (n < 0).any():
        raise ValueError("negative number")
    head, tail = before.encode(), after.encode()
    digits = np.ones(len(n), dtype=np.int64)
    for k in range(1, 19):
        digits += n >= 10**k
    hi, lo = np.empty(len(n), dtype=np.uint64), np.empty(len(n), dtype=np.uint64)
    for d in np.unique(digits):
        size = len(head) + int(d) + len(tail)
        if size > 55:
            raise ValueError("a text of over 55 bytes")
        form = np.zeros(64, dtype=np.uint8)
        form[: len(head)] = np.frombuffer(head, dtype=np.uint8)
        form[len(head) + d : size] = np.frombuffer(tail, dtype=np.uint8)
        form[size] = 128
        form[56:64] = np.frombuffer((size * 8).to_bytes(8, "little"), dtype=np.uint8)
        of = np.flatnonzero(digits == d)
        for at in range(0, len(of), chunk):
            rows = of[at : at + chunk]
            words = np.repeat(form.view("<u4")[:, None], len(rows), axis=1)
            rest = n[rows] if d > 9 else n[rows].astype(np.uint32)
            for k in range(len(head) + int(d) - 1, len(head) - 1, -1):
                fewer = rest // 10
                words[k // 4] |= (rest - fewer * 10 + 48).astype(np.uint32) << np.uint32(k % 4 * 8)
                rest = fewer
            hi[rows], lo[rows] = _block(words)
    return hi, lo


def ordered(hi: np.ndarray, lo: np.ndarray, *ties: np.ndarray) -> np.ndarray:
    """The places of digests in ascending order; equal ones by ties, the first one first."""
    o = np.argsort(hi, kind="stable")
    h = hi[o]
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        o = np.lexsort((*ties[::-1], lo, hi))
    return o
