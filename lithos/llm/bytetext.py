"""Word and byte arithmetic on UTF-8 buffers, vectorised with numpy.

Hashes are polynomials over a random symbol table modulo 2**64 with an odd base, so the
hash of any stretch comes from two prefix sums and one power. Such hashes collide on texts
built to that end (Thue-Morse words) once these are about 512 symbols long, so stretches over
LONG symbols are hashed by XXH64 of their bytes instead (stretch_hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
SYMBOL = _rng.integers(0, 2**64, 256, dtype=np.uint64)
#: 3 modulo 8: B - 1 and B + 1 have the fewest factors of two, so no two words of up to LONG symbols collide by design.
BASE = int(_rng.integers(0, 2**61)) * 8 + 3
LONG = 256
INVERSE = pow(BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n; kept, and grown by doubling."""
    for k, b in enumerate((BASE, INVERSE)):
        while len(_powers[k]) < n:
            p = _powers[k]
            _powers[k] = np.concatenate([p, p * U(pow(b, len(p), 2**64))])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * BASE**j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (p[end] - p[start]) * powers(len(p))[1][start]


def stretch_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Hash of each data[start:end], however long; values: the symbols' random values (bytes: SYMBOL)."""
    size = end - start
    h = span_hash(prefix(SYMBOL[data] if values is None else values), start, end)
    h += size.astype(np.uint64)
    long = np.flatnonzero(size > LONG)
    if len(long):
        h[long] = [xxhash.xxh64_intdigest(data[a:z].tobytes(), 99) for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return mix(h)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column without nulls."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    o = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(col: pa.Array, budget: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about budget bytes: arrays stay in cache."""
    data, offs = buffers(col)
    lo, n = 0, len(col)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and each text's first word (n + 1). Words never cross texts."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = ~sep[data]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    full = offs[1:] > offs[:-1]
    b = offs[:-1][full]
    s[b] = m[b]
    b = offs[1:][full] - 1
    e[b] = m[b]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    return start, end, np.searchsorted(start, offs)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return stretch_hash(data, start, end)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the first item of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, regardless of texts."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix(values)
    return mix((p[k:] - p[:-k]) * powers(n)[1])


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """For each item, whether k items from it on lie in one text; the last k - 1 items are left out."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, bool)
    return (np.repeat(first[1:], np.diff(first)) - np.arange(n))[: n - k + 1] >= k


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags over each text's items."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with a blank after each."""
    return np.insert(data, offs[1:], np.uint8(32)), offs + np.arange(len(offs))


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> list[bytes]:
    """Each text's words (those to keep) joined by one blank; data must come from spaced()."""
    at = first
    if keep is not None:
        start, end, at = start[keep], end[keep], np.append(0, np.cumsum(keep))[first]
    edge = np.zeros(len(data) + 2, np.int8)
    edge[start] += 1
    edge[end + 1] -= 1  # the byte after a word is white space, so edges of two words may only meet
    inside = np.cumsum(edge, dtype=np.int8)[: len(data)] > 0
    flat = data[inside]
    length = np.append(0, np.cumsum(end - start + 1))
    flat[length[1:] - 1] = 32
    flat = flat.tobytes()
    where = length[at]
    return [flat[a : max(a, z - 1)] for a, z in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]


class Table:
    """Open-addressing map from 64-bit hashes to 0, 1, 2, ...; look-ups and inserts take whole arrays."""

    def __init__(self, bits: int = 21):
        self.bits, self.size = bits, 0
        self.keys, self.index = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 if absent. Zero is no hash."""
        out = np.full(len(h), -1, np.int32)
        todo, slot = np.arange(len(h)), (h >> U(64 - self.bits)).astype(np.int64)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.index[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """New, distinct hashes; they get the next indexes in their order."""
        slot, todo = (h >> U(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.index[slot[won]] = self.size + todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)
        self.size += len(h)

    def room(self, n: int) -> bool:
        return (self.size + n) * 2 <= 1 << self.bits


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start:start + size] for each pair, one after another."""
    total = int(size.sum())
    step = np.ones(total + 1, np.int64)
    at = np.append(0, np.cumsum(size))
    keep = size > 0
    s, z, at = start[keep], size[keep], at[:-1][keep]
    if not total:
        return flat[:0]
    step[at[0]] = s[0]
    step[at[1:]] = s[1:] - (s[:-1] + z[:-1] - 1)
    return flat[np.cumsum(step[:total])]
