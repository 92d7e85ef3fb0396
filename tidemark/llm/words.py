"""Words and word shingles of many texts at once, as hashes in numpy.

A batch's texts lie in one buffer of UTF-8 bytes. A-Z is lower-cased and words end at blanks and the control
characters 9 to 13, as bytes. A word's hash is a polynomial over a fixed random number per byte value, taken from
running sums, and mixed; so the cost is a few passes over the bytes, whatever the words' number or length.
"""

from __future__ import annotations

import numpy as np

#: Characters that are hashed at once, but for a longer single text.
PIECE = 1 << 19
_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
#: For shingles: an odd factor for each place.
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out[:n]


class _Powers:
    def __init__(self, base: int):
        self.base, self.kept = base, powers(base, 1 << 16)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.kept):
            self.kept = powers(self.base, 1 << (n - 1).bit_length())
        return self.kept[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def words(texts: list[str], strip: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each text's words begin and end (len + 1 bounds).

    strip: bytes that are left out of words; a word of nothing else stays as an empty one.
    """
    if len(texts) > 1 and sum(map(len, texts)) > PIECE:
        return _in_pieces(texts, strip)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" ".join(raw), dtype=np.uint8)  # the joining blank ends a text's last word
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    if not len(buffer):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    blank = _BLANK[buffer]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    letters = _LETTER[buffer]
    if strip:
        letters[np.isin(buffer, np.frombuffer(strip, dtype=np.uint8))] = 0
        kept = ~np.isin(buffer, np.frombuffer(strip, dtype=np.uint8))
        place = np.concatenate([[0], np.cumsum(kept)])
        up = _UP.upto(len(buffer) + 1)[place[:-1]]
    else:
        place, up = np.arange(len(buffer) + 1), _UP.upto(len(buffer))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up, dtype=np.uint64)])
    hashes = mix((sums[end] - sums[start]) * _DOWN.upto(len(buffer) + 1)[place[start]])
    return hashes, np.concatenate([np.searchsorted(start, begins), [len(start)]])


def _in_pieces(texts: list[str], strip: bytes) -> tuple[np.ndarray, np.ndarray]:
    """words() of some texts at a time: its arrays have many times a text's size."""
    parts, some, size = [], [], 0
    for t in texts:
        if some and size + len(t) > PIECE:
            parts.append(words(some, strip))
            some, size = [], 0
        some.append(t)
        size += len(t)
    parts.append(words(some, strip))
    counts = np.concatenate([np.diff(b) for _, b in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(counts)])


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within a text, and each text's bounds.

    A text of fewer words than size has its whole word sequence as its only shingle; one without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), n)
    ends = np.cumsum(n)
    first = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(bounds[:-1], n)
    value = np.zeros(len(first), np.uint64)
    last = bounds[1:][owner] if len(owner) else np.zeros(0, np.int64)
    for k in range(size):
        there = first + k < last
        value += np.where(there, mix(hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] * _PLACE[k] + np.uint64(k + 1)) if len(hashes) else 0, np.uint64(0))
    value = mix(value + np.minimum(counts, size)[owner].astype(np.uint64) * _PLACE[-1]) if len(owner) else value
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def gathered(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words in one text's hashes, in order, repeats too."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value += mix(hashes[k : k + n] * _PLACE[k] + np.uint64(k + 1))
    return mix(value + np.uint64(size) * _PLACE[-1])
