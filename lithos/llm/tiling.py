"""Benchmark decontamination by greedy string tiling.

Seeds of `match` words shared by a document and a benchmark item are joined; for each pair
with a seed, the longest common runs that overlap no tile yet are marked, longest first,
found by running Karp-Rabin hashes at a falling length, until none of `match` words is left.
The share of an item's words under tiles is its coverage: passages count however they are
reordered.
"""

from __future__ import annotations

from collections import defaultdict, deque
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import held, prepare, record, scan, strings

BLOCK_BYTES = 32 << 20
#: Words of benchmarks are compared without case in A-Z and without the ASCII punctuation around them.
EDGE = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def tokens(text: bytes) -> list[bytes]:
    return [w for x in text.lower().split() if (w := x.strip(EDGE))]


def numbered(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of each text, and each text's first token; the same tokens as tokens()."""
    data = bt.LOWER[data]
    start, end, first = bt.words(data, offs)
    while True:  # strip punctuation at the edges, a byte a round
        i = np.flatnonzero((start < end) & PUNCT[data[np.minimum(start, len(data) - 1)]]) if len(data) else start
        j = np.flatnonzero((start < end) & PUNCT[data[end - 1]])
        if not len(i) and not len(j):
            break
        start[i] += 1
        end[j] = np.maximum(end[j] - 1, start[j])
    keep = start < end
    return bt.word_hashes(data, start[keep], end[keep]), np.append(0, np.cumsum(keep))[first]


PUNCT = np.zeros(256, bool)
PUNCT[list(EDGE)] = True


def tile(a: np.ndarray, b: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token sequences a and b (64-bit hashes): (start in a, start in b,
    length), longest first; of equal lengths the first in a, then in b.

    The match length falls: Karp-Rabin hashes of all unmarked stretches of one length, running
    over both sequences, tell whether they share one, a binary search finds the longest such
    length, and its matches are marked from left to right. A partner once marked is never
    looked at again, so a round is linear in the two sequences, however repetitive they are."""
    tiles: list[tuple[int, int, int]] = []
    top = min(len(a), len(b))
    pa_, pb = bt.prefix(a), bt.prefix(b)
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)

    def unmarked(p: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.append(0, np.cumsum(~free))
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, bt.span_hash(p, at, at + size)

    def common(size: int):
        (i, x), (j, y) = unmarked(pa_, free_a, size), unmarked(pb, free_b, size)
        return i, x, j, y, np.isin(x, y)

    while top >= match and common(match)[4].any():
        low = match
        while low < top:  # the longest length shared; a shared length implies all shorter ones
            middle = (low + top + 1) // 2
            if common(middle)[4].any():
                low = middle
            else:
                top = middle - 1
        i, x, j, y, hit = common(top)
        partners = defaultdict(deque)
        for q, h in zip(j.tolist(), y.tolist(), strict=True):
            partners[h].append(q)
        end = 0
        for q, h in zip(i[hit].tolist(), x[hit].tolist(), strict=True):
            if q < end:
                continue
            ways = partners[h]
            while ways and not (free_b[ways[0]] and free_b[ways[0] + top - 1]):
                ways.popleft()
            if ways and np.array_equal(a[q : q + top], b[ways[0] : ways[0] + top]):
                r = ways.popleft()
                free_a[q : q + top] = free_b[r : r + top] = False
                tiles.append((q, r, top))
                end = q + top
        top -= 1
    return tiles


def shortest(n: int, match: int) -> int:
    """Words of the shortest tile for an item of n words: `match`, less for an item of under 4 * match
    words (a quarter of it, at least 3), the whole of one shorter than `match`."""
    return n if n < match else min(match, max(3, n // 4))


def coverage(docs: DataFrame, benchmark: DataFrame, match: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = 0.0) -> DataFrame:
    """Pairs with at least one tile: id_col, item_id, n_tiles, n_covered, n_item_words, coverage.

    Tiles have at least `match` words, or fewer in short items (see shortest): an item of fewer
    than `match` words is matched as a whole. Pairs whose seeds can't reach a coverage of `least` are left out
    before they are tiled. The benchmark is taken in blocks of at most BLOCK_BYTES of
    text, each sent to all executors and held against every document, so its size is
    bounded whatever the benchmark's is. Null texts have no words; null and repeated ids
    are passed on, one row per pair of rows.
    """
    spark = prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))
    blocks, size = [[]], 0
    for r in items.toLocalIterator():
        if size > BLOCK_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((r.i, r.t.encode()))
        size += len(r.t)
    out = None
    for block in blocks:
        one = against(docs, spark.sparkContext.broadcast(block), match, id_col, text_col, least)
        out = one if out is None else out.unionByName(one)
    return out.withColumnRenamed("id", id_col)


def against(docs: DataFrame, shared, match: int, id_col: str, text_col: str, least: float) -> DataFrame:
    key = uuid4().hex

    def built():
        """Hashed items; for each length of seeds the sorted hashes of all, with item and place of each."""
        hashed, by_size = [], defaultdict(list)
        for n, (_, t) in enumerate(shared.value):
            d = np.frombuffer(t, np.uint8)
            hashed.append(w := numbered(d, np.array([0, len(d)]))[0])
            if len(w):
                size = shortest(len(w), match)
                g = bt.grams(w, size)
                by_size[size].append((g, np.full(len(g), n, np.int32), np.arange(len(g), dtype=np.int32)))
        seeds = []
        for size, each in sorted(by_size.items()):
            g, item, place = (np.concatenate(x) for x in zip(*each, strict=True))
            by = np.argsort(g, kind="stable")
            seeds.append((size, g[by], item[by], place[by]))
        return hashed, seeds

    def pairs(h: np.ndarray, first: np.ndarray, size: int, known: np.ndarray, item: np.ndarray, place: np.ndarray, lengths: np.ndarray):
        """(text, item) with seeds of this length that may cover enough."""
        at = np.flatnonzero(bt.whole(first, size))
        if not len(at):
            return
        g = bt.grams(h, size)[at]
        left = np.minimum(np.searchsorted(known, g), len(known) - 1)
        hit = np.flatnonzero(known[left] == g)
        text = np.searchsorted(first, at[hit], "right") - 1
        met = np.unique(text.astype(np.int64) * len(known) + left[hit])
        text, left = met // len(known), met % len(known)
        right = np.searchsorted(known, known[left], "right")
        cuts = np.flatnonzero(np.diff(text, prepend=-1))
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(text)], strict=False):
            many = right[lo:hi] - left[lo:hi]
            i = np.arange(many.sum()) + np.repeat(left[lo:hi] - np.cumsum(many) + many, many)
            by = np.lexsort((place[i], item[i]))
            n, p = item[i][by], place[i][by]
            begin = np.flatnonzero(np.diff(n, prepend=-1))
            step = np.minimum(np.diff(p, append=0), size)
            step[np.append(begin[1:], len(n)) - 1] = size
            reach = np.add.reduceat(step, begin)
            for x in n[begin][reach >= least * lengths[n[begin]] - 1e-6].tolist():
                yield int(text[lo]), x

    def fn(b: pa.RecordBatch):
        hashed, seeds = held(key, built)
        ids, rows = b.column(0), []
        lengths = np.array([len(w) for w in hashed])
        for r0, _, data, offs in bt.pieces(strings(b.column(1))):
            h, first = numbered(data, offs)
            for size, *known in seeds:
                for d, n in pairs(h, first, size, *known, lengths):
                    w = hashed[n]
                    t = tile(h[first[d] : first[d + 1]], w, size)
                    covered = sum(x[2] for x in t)
                    rows.append((r0 + d, shared.value[n][0], len(t), covered, len(w), covered / len(w)))
        if not rows:
            return None
        c = list(zip(*rows, strict=True))
        return record(id=ids.take(pa.array(c[0])), item_id=pa.array(c[1], pa.int64()), n_tiles=pa.array(c[2], pa.int64()), n_covered=pa.array(c[3], pa.int64()), n_item_words=pa.array(c[4], pa.int64()), coverage=pa.array(c[5], pa.float64()))

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return scan(source, fn, f"id {dict(source.dtypes)['id']}, item_id long, n_tiles long, n_covered long, n_item_words long, coverage double")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, match: int = 8, **names: str) -> DataFrame:
    """Pairs of a row and a benchmark item of which it holds at least `threshold` (see coverage)."""
    return coverage(docs, benchmark, match, least=threshold, **names).where(F.col("coverage") >= threshold)
