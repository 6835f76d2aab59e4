"""SimHash fingerprints and near-duplicate groups.

Fingerprints within the radius are found by exact tiled comparison: numpy exclusive-or and
bit counts between tiles sorted by population count, skipping what differs in population
count by more than the radius, in tiles of any size. Comparing all tiles is quadratic, so
tiles are cells of the pigeonhole principle: of k bit blocks, two fingerprints at distance r
or less agree on at least k - r whole blocks, and only fingerprints that share k - r blocks
are compared; k grows with the number of distinct fingerprints. cells=False compares all.
Equal fingerprints collapse before any comparison, however many documents share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, discard, keyed, prepare, public_id, record, scan, strings

TILE = 4096
SALTS = 32
EMPTY_SUM = np.zeros((1, 64), np.int64)


def fingerprints_of(col: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    out = np.zeros(len(col), np.uint64)
    xx = xxhash.xxh64_intdigest
    for r0, r1, data, offs in bt.pieces(col, 1 << 19):
        data, offs = bt.spaced(bt.LOWER[data], offs)
        start, end, first = bt.words(data, offs)
        text = bt.joined(data, start, end, first)
        size = end - start + 1
        hashes, each = [], []
        for i, t in enumerate(text):
            a, z = int(first[i]), int(first[i + 1])
            if z == a:
                each.append(0)
                continue
            at = np.append(0, np.cumsum(size[a:z]))
            n = max(1, z - a - shingle + 1)
            e = at[shingle:] - 1 if z - a >= shingle else at[-1:] - 1
            hashes += [xx(t[x:y], seed) for x, y in zip(at[:n].tolist(), e.tolist(), strict=True)]
            each.append(n)
        if not hashes:
            continue
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        each = np.array(each)
        has = np.flatnonzero(each)
        at = np.append(0, np.cumsum(each[has]))
        for row, a, z in zip(has.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            major = 2 * bits[a:z].sum(axis=0, dtype=np.int32) > z - a
            out[r0 + row] = np.packbits(major, bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(rows: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """rows: _id, _th, text → _id, _th, fp (the 64 bits as a signed long)."""

    def fn(b: pa.RecordBatch):
        return record(_id=b.column(0), _th=b.column(1), fp=fingerprints_of(strings(b.column(2)), shingle, seed).view(np.int64))

    return scan(rows, fn, "_id long, _th long, fp long")


def block_masks(count: int, radius: int) -> list[int]:
    """Bit masks, one for each choice of blocks that must agree, of the cheapest block number for `count` fingerprints."""
    k = min(range(radius + 1, 2 * radius + 1), key=lambda k: comb(k, radius) * count * (16 + count / 2 ** (64 * (k - radius) // k)))
    cuts = [64 * i // k for i in range(k + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(c) for c in combinations(block, k - radius)]


def neighbours(group: np.ndarray, fp: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of each group within the radius, once each: a tile is sorted by population count, and a
    row meets only those after it whose count exceeds its own by the radius or less."""
    pop = np.bitwise_count(fp).astype(np.int64)
    by = np.lexsort((pop, group))
    v, f = group[by] * 128 + pop[by], fp[by]
    until = np.searchsorted(v, v + radius, "right")  # counts end at 64, so a sum never reaches the next group
    many = until - np.arange(len(v)) - 1
    total = np.append(0, np.cumsum(many))
    lo = 0
    while lo < len(v):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), many[lo:hi])
        j = np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], many[lo:hi]) + i + 1
        near = np.bitwise_count(f[i] ^ f[j]) <= radius
        if near.any():
            yield by[i[near]], by[j[near]]
        lo = hi


def across(left: np.ndarray, right: np.ndarray, radius: int, side: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of two tiles within the radius, in blocks; blocks whose population counts lie further apart are skipped."""
    left_by, right_by = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    x, y = left[left_by], right[right_by]
    px, py = np.bitwise_count(x).astype(int), np.bitwise_count(y).astype(int)
    for i in range(0, len(x), side):
        for j in range(0, len(y), side):
            if py[j] - px[min(i + side, len(x)) - 1] > radius or px[i] - py[min(j + side, len(y)) - 1] > radius:
                continue
            u, v = np.nonzero(np.bitwise_count(x[i : i + side, None] ^ y[None, j : j + side]) <= radius)
            if len(u):
                yield left_by[i + u], right_by[j + v]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE, cells: bool = True) -> DataFrame:
    """fps: fp (distinct). All pairs a < b (unsigned order of no meaning) at distance 1 to radius, once each.
    cells: whether only tiles that agree on some bit blocks are compared, or (quadratic) all tiles."""
    masks = block_masks(max(1, fps.count()), radius) if cells else [0]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    kind = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    banded = fps.select("fp", kind.alias("x")).select("fp", "x.m", "x.key", F.bit_count("fp").alias("pop"))
    # A cell is cut into tiles of about `tile` fingerprints by population count and hash, so that tasks stay
    # small; a tile is sent only to tiles whose population count is within the radius.
    sizes = banded.groupBy("m", "key").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.when(F.col("c") > tile, F.ceil(F.col("c") / tile).cast("int")).otherwise(0)
    rows = banded.join(sizes.select("m", "key", parts.alias("p")), ["m", "key"])
    rows = rows.withColumn("mine", F.when(F.col("p") > 0, F.col("pop") * 65536 + F.pmod(F.xxhash64("fp"), F.col("p"))).otherwise(0))
    other = F.when(
        F.col("p") > 0,
        F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), F.col("pop") - radius), F.least(F.lit(64), F.col("pop") + radius)), lambda q: F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda h: (q * 65536 + h).cast("long")))),
    ).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.select("m", "key", "fp", "mine", F.explode(other).alias("o"))
    rows = rows.select("m", "key", F.least("mine", "o").alias("a"), F.greatest("mine", "o").alias("b"), (F.col("mine") > F.col("o")).alias("right"), "fp")
    rows = rows.repartition("m", "key", "a", "b").sortWithinPartitions("m", "key", "a", "b", "right").select("m", "key", "a", "b", "right", "fp")
    lower = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def compared(c: list[np.ndarray], new: np.ndarray):
            """c: m, key, a, b, right, fp of whole tile pairs, which begin where new is set."""
            group, (m, a, b), right, fp = np.cumsum(new) - 1, (c[0], c[2], c[3]), c[4], c[5].view(np.uint64)
            own = np.flatnonzero(a == b)
            found = [(own[i], own[j]) for i, j in neighbours(group[own], fp[own], radius)]
            at = np.append(np.flatnonzero(new), len(new))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if a[s] != b[s]:
                    cut_at = s + int(np.searchsorted(right[s:e], True))
                    found += [(s + i, cut_at + j) for i, j in across(fp[s:cut_at], fp[cut_at:e], radius)]
            for i, j in found:
                # a pair that agrees under several masks counts under the first
                first = ((fp[i] ^ fp[j])[:, None] & lower[None, :] == 0).argmax(axis=1)
                once = first == m[i]
                if once.any():
                    x, y = fp[i[once]], fp[j[once]]
                    yield record(a=np.minimum(x, y).view(np.int64), b=np.maximum(x, y).view(np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if held is not None:
                c = [np.concatenate(x) for x in zip(held, c, strict=True)]
            new = np.ones(len(c[0]), bool)
            new[1:] = False
            for x in c[:4]:
                new[1:] |= x[1:] != x[:-1]
            last = int(np.flatnonzero(new)[-1])
            yield from compared([x[:last] for x in c], new[:last])
            held = [x[last:] for x in c]
        if held is not None:
            new = np.zeros(len(held[0]), bool)
            new[0] = True
            yield from compared(held, new)

    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, checkpoint_every: int = 1) -> DataFrame:
    """edges: a, b (long). Each node with the smallest node it can reach: node, root.

    Alternating large-star and small-star contraction: a few rounds whatever the shape of
    the graph, each one a grouping by node. A hub's neighbours are never gathered: the
    smallest neighbour is an aggregate joined back, and adaptive execution splits hubs.
    """
    e = cut(edges.where("a <> b").select("a", "b").distinct(), "edges")
    signature = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # now every edge is (larger, smaller)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, cut(small, "edges")
        discard(before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    stars = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, cells: bool = True) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), n_near, component_id.

    A-Z are lower-cased; shingles are runs of `shingle` words without ASCII white space;
    shorter texts are one shingle; texts without words (null ones too) have fingerprint
    zero, which is linked like any other. n_near counts the other rows within the radius,
    equal fingerprints included; component_id is the smallest id reachable over links.
    Repeated rows are rows of their own and link; null ids count as the smallest id, and
    show as null. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    prints = cut(fingerprints(rows, shingle, seed).select("_id", "fp"), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.count("*").alias("c"), F.min("_id").alias("low")), "distinct")
    pairs = cut(links(distinct.select("fp"), radius, tile, cells), "links")
    # per fingerprint: how many rows are linked, and the component
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reach = both.join(distinct.select(F.col("fp").alias("b"), "c"), "b").groupBy("a").agg(F.sum("c").alias("others")).withColumnRenamed("a", "fp")
    root = components(pairs).withColumnRenamed("node", "fp")
    info = distinct.join(root, "fp", "left").join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = info.groupBy("root").agg(F.min("low").alias("component"))
    info = info.join(low, "root").select("fp", (F.coalesce("others", F.lit(0)) + F.col("c") - 1).alias("n_near"), "component").where("n_near > 0")
    # A hot fingerprint's rows are spread over salts; rows without a link need no partner.
    info = info.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(info, ["fp", "salt"], "left")
    component = F.coalesce("component", "_id")
    return out.select(
        public_id(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(component != F.lit(-(2**63)), component).alias("component_id"),
    )
