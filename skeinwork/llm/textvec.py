"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

_SEED = np.random.default_rng(0x5EED)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random value for each byte; ASCII capitals have those of their small letters.
BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
#: Bytes of words: ASCII letters and digits, and all beyond ASCII, of which words() takes out punctuation and spaces.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Scripts that are written without spaces: each character, with its marks, is a word.
UNSPACED = [(0xE00, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)]
BREAK, LETTER, ALONE, MARK = range(4)
#: Bytes that are hashed at a time.
BLOCK = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every bit of the input moves every bit of the output."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values, broken at the offsets."""
    if not len(flag):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = flag.copy()
    begin[1:] &= ~flag[:-1]
    end = flag.copy()
    end[:-1] &= ~flag[1:]
    inner = offsets[(offsets > 0) & (offsets < len(flag))]
    begin[inner] = flag[inner]
    end[inner - 1] = flag[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end, without case for ASCII; the spans are in order."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        # no more than BLOCK bytes at a time, but for a span that is longer
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        a, z = start[i], end[j - 1]
        p, inv = powers(z - a + 1)
        c = np.zeros(z - a + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data[a:z]] * p[:-1], out=c[1:])
        out[i:j] = (c[end[i:j] - a] - c[start[i:j] - a]) * inv[start[i:j] - a]
        i = j
    return mix(out)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point: one that breaks words, one within them, one that is a word, a mark of such a one."""
    table = np.full(0x110000, LETTER, np.uint8)
    for first, last in UNSPACED:
        table[first : last + 1] = ALONE
    for c in (*range(0x80, 0xD800), *range(0xF900, 0x20000)):
        kind = unicodedata.category(chr(c))
        if kind[0] in "PZ" or kind == "Cc":
            table[c] = BREAK
        elif kind[0] == "M" and table[c] == ALONE:
            table[c] = MARK
    return table


def beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the bytes of characters beyond ASCII that break words are, and where words are cut since a character is a word."""
    at = np.flatnonzero((data == 0xC2) | (data >= 0xCC))  # between them are letters only
    if not len(at):
        return at, at
    wide = np.concatenate([data, np.zeros(4, np.uint8)])
    b = [wide[at + k].astype(np.int64) for k in range(4)]
    more = [x & 0x3F for x in b]
    size = np.where(b[0] < 0xE0, 2, np.where(b[0] < 0xF0, 3, 4))
    two = (b[0] & 0x1F) << 6 | more[1]
    three = (b[0] & 0x0F) << 12 | more[1] << 6 | more[2]
    four = (b[0] & 0x07) << 18 | more[1] << 12 | more[2] << 6 | more[3]
    kind = _kinds()[np.minimum(np.where(size == 2, two, np.where(size == 3, three, four)), 0x10FFFF)]
    breaks = np.concatenate([at[(kind == BREAK) & (size > k)] + k for k in range(4)])
    of = np.full(len(wide), LETTER, np.uint8)
    of[at] = kind
    after = (at + size)[kind >= ALONE]
    after = after[of[np.minimum(after, len(data))] != MARK]
    return breaks[breaks < len(data)], np.union1d(at[kind == ALONE], after)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each text (one entry more than texts)."""
    flag = IS_WORD[data]
    breaks, cuts = beyond_ascii(data)
    flag[breaks] = False
    start, end = runs(flag, np.union1d(offsets, cuts) if len(cuts) else offsets)
    return start, end, np.searchsorted(start, offsets)
