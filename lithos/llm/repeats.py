"""Windows of W consecutive symbols (words or bytes) that repeat across a corpus, exactly.

Shuffling one row per window would move more data than the corpus itself, so windows are
handled level by level:

1. Every window elects the k-symbol window inside it with the smallest hash, the leftmost
   on a tie. The choice depends on the content alone, so equal windows elect equal
   k-windows; consecutive windows mostly elect the same one. One row stands for a run of
   windows with one elected k-window ("anchor"). A window whose anchor occurs once in the
   whole corpus cannot repeat.
2. Windows with a repeated anchor go on to twice that k, by the same election among those
   left, and so on while k is below W; the text is met again with the anchors that repeat.
3. At the last k, anchors whose whole run (all its windows, at the same offsets) is equal are
   grouped. Here almost all copied text is settled, without a row per window.
4. What is left are k-windows met in different surroundings, mostly at the ends of copied
   passages. Only their runs, one per distinct surrounding, are taken apart: long ones into
   blocks first, of which only those whose common core repeats go on, then into single
   windows of full length, which are counted.

A window is identified by two 64-bit hashes, one of its anchor and one of its content.
A place is packed in one long: the anchor's position, how far before it the first window of
the run starts, and the number of windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, discard, record, scan, strings

POS_BITS = 31  # a string column holds fewer than 2**31 bytes
FIELD = 12
MASK = (1 << FIELD) - 1
WINDOW_LIMIT = MASK
SEED = "kg long, _id long, _th long, at int"
ENTRY = "kg long, ctx long, _id long, _th long, place long"
U = np.uint64


def packed(at: np.ndarray, back: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << 2 * FIELD) | (back.astype(np.int64) << FIELD) | n.astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 2 * FIELD, (place >> FIELD) & MASK, place & MASK


def symbols(data: np.ndarray, offs: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbol hashes and each text's first symbol."""
    if unit == "byte":
        return bt.SYMBOL[data], offs
    start, end, first = bt.words(data, offs)
    return bt.word_hashes(data, start, end), first


def sliding_min(a: np.ndarray, m: int) -> np.ndarray:
    step, cur = 1, a
    while step * 2 <= m:
        cur = np.minimum(cur[:-step], cur[step:])
        step *= 2
    n = len(a) - m + 1
    return np.minimum(cur[:n], cur[m - step : m - step + n])


def election(values: np.ndarray, first: np.ndarray, window: int, k: int, alive: np.ndarray | None = None):
    """(starts of the windows, the k-window each elects, hashes of all k-windows, prefix sums) or None.
    alive: which window starts are still in question."""
    ok = bt.whole(first, window)
    if alive is not None:
        ok = ok & alive[: len(ok)]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return None
    p = bt.prefix(values)
    n = len(values) - k + 1
    g = bt.mix((p[k:] - p[:-k]) * bt.powers(len(p))[1][:n])
    low = U((1 << POS_BITS) - 1)
    pick = (sliding_min((g & ~low) | np.arange(n, dtype=np.uint64), window - k + 1) & low).astype(np.int64)[starts]
    return starts, pick, g, p


def runs(values: np.ndarray, first: np.ndarray, window: int, k: int, alive: np.ndarray | None = None):
    """Anchors of all windows: (text, anchor hash, run hash, anchor in its text, its distance from the first window, number of windows)."""
    if (e := election(values, first, window, k, alive)) is None:
        return None
    starts, pick, g, p = e
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lo, count = starts[at], np.diff(np.append(at, len(starts)))
    anchor, hi = pick[at], lo + count + window - 1
    ctx = bt.mix(bt.mix(bt.span_hash(p, lo, hi)) + (anchor - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15) + count.astype(np.uint64) * U(0xC2B2AE3D27D4EB4F))
    text = np.searchsorted(first, lo, "right") - 1
    return text, bt.mix(g[anchor] + U(1)), ctx, anchor - first[text], anchor - lo, count


def level(kept: pa.ListArray, row0: int, row1: int, number: int, first: np.ndarray) -> np.ndarray:
    """Positions, among the symbols of rows row0 to row1, of the anchors that repeat at a level."""
    part = kept.slice(row0, row1 - row0)
    levels = part.flatten()
    each = levels.take(pa.array(np.arange(row1 - row0) * (len(levels) // max(1, row1 - row0)) + number))
    size = np.asarray(each.value_lengths()).astype(np.int64)
    return each.flatten().to_numpy().astype(np.int64) + np.repeat(first[:-1], size)


def anchors(docs: DataFrame, unit: str, window: int, lengths: list[int], last: bool) -> DataFrame:
    """One row per anchor of length lengths[-1] (ENTRY if last, else SEED). docs: _id, _th, text, and with
    more than one length kept (for each length before, the positions of anchors that repeat)."""

    def fn(b: pa.RecordBatch):
        ids, th, out = b.column(0).to_numpy(), b.column(1).to_numpy(), []
        for r0, r1, data, offs in bt.pieces(strings(b.column(2))):
            values, first = symbols(data, offs, unit)
            alive = None
            for i, k in enumerate(lengths[:-1]):
                e = election(values, first, window, k, alive)
                if e is None:
                    break
                good = np.zeros(len(values), bool)
                good[level(b.column(3), r0, r1, i, first)] = True
                alive = np.zeros(len(values), bool)
                alive[e[0]] = good[e[1]]
            r = runs(values, first, window, lengths[-1], alive)
            if r is None:
                continue
            text, kg, ctx, at, back, n = r
            who = (ids[r0 + text], th[r0 + text])
            if last:
                out.append((kg.view(np.int64), ctx.view(np.int64), *who, packed(at, back, n)))
            else:  # a k-window elected by two runs of one text is one candidate
                one = np.append(True, (text[1:] != text[:-1]) | (at[1:] != at[:-1]))
                out.append((kg.view(np.int64)[one], who[0][one], who[1][one], at[one].astype(np.int32)))
        if not out:
            return None
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return record(**dict(zip(("kg", "ctx", "_id", "_th", "place") if last else ("kg", "_id", "_th", "at"), cols, strict=True)))

    return scan(docs, fn, ENTRY if last else SEED)


def survivors(entries: DataFrame) -> DataFrame:
    """Anchors whose k-window occurs at least twice. Counting combines on the map side, and
    only repeated keys are joined back; adaptive execution splits a hot key's share."""
    twice = entries.groupBy("kg").agg(F.count("*").alias("_c")).where("_c > 1").select("kg")
    return entries.join(twice, "kg")


def extended(docs: DataFrame, unit: str, window: int, seed: int) -> tuple[DataFrame | None, int]:
    """Level-wise doubling: (entries of windows whose anchors repeat at every length, the last length).
    Lengths are seed, twice that and so on below window; None once no candidate survives."""
    lengths, kept = [min(seed, window)], None
    while True:
        last = 2 * lengths[-1] >= window
        source = docs if kept is None else docs.join(kept, ["_id", "_th"]).select("_id", "_th", "text", "kept")
        entries = anchors(source, unit, window, lengths, last)
        if kept is not None:
            entries = cut(entries, "candidates")
        found = survivors(entries)
        if last:
            out = cut(found, "seeds")
        else:
            # a set: rows alike in id and text share their positions
            places = found.groupBy("_id", "_th").agg(F.array(F.collect_set("at")).alias("here"))
            if kept is not None:
                places = places.join(kept, ["_id", "_th"]).select("_id", "_th", F.concat("kept", "here").alias("here"))
            out = cut(places.select("_id", "_th", F.col("here").alias("kept")), "level")
        if kept is not None:
            discard(entries, kept)
        if not out.take(1):
            discard(out)
            return None, lengths[-1]
        if last:
            return out, lengths[-1]
        kept = out
        lengths.append(2 * lengths[-1])


def open_parts(docs: DataFrame, unit: str, window: int, block: int) -> DataFrame:
    """docs: _id, _th, text, runs (array of kg, place). The runs taken apart, as new entries.

    With block = 1 each window is an entry (kg, ctx, place with n = 1) of its own content. With a larger
    block a run is cut where the distance to its anchor is a multiple of block, so that equal
    content is cut alike; the new anchor of a part is the stretch that all windows of a whole
    block have in common: if that occurs once, no window of the part can repeat."""

    def fn(b: pa.RecordBatch):
        ids, th, text, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), strings(b.column(2)), b.column(3)
        each = lists.flatten()
        kg, (anchor, back, n) = each.field(0).to_numpy(), unpacked(each.field(1).to_numpy())
        cuts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        out = []
        for r0, r1, data, offs in bt.pieces(text):
            values, first = symbols(data, offs, unit)
            p = bt.prefix(values)
            s = slice(cuts[r0], cuts[r1])
            row = np.repeat(np.arange(r1 - r0), np.diff(cuts[r0 : r1 + 1]))
            # distance of the anchor from the first and the last window of the run
            far, near = back[s], back[s] - n[s] + 1
            k0, k1 = near // block, far // block
            parts = k1 - k0 + 1
            run = np.repeat(np.arange(len(row)), parts)
            k = k0[run] + np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
            d1, d0 = np.minimum(far[run], (k + 1) * block - 1), np.maximum(near[run], k * block)
            base, at = first[row[run]], anchor[s][run]
            start, end = base + at - d1, base + at - d0 + window
            ctx = bt.mix(bt.mix(bt.span_hash(p, start, end)) + (d1 - d0).astype(np.uint64))
            key = kg[s][run].view(np.uint64)
            if block > 1:
                core = bt.span_hash(p, base + at - k * block, base + at - (k + 1) * block + 1 + window)
                key = bt.mix(key ^ bt.mix(core + k.astype(np.uint64)))
            out.append((key.view(np.int64), ctx.view(np.int64), ids[r0 + row[run]], th[r0 + row[run]], packed(at, d1, d1 - d0 + 1)))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return record(**dict(zip(("kg", "ctx", "_id", "_th", "place"), cols, strict=True)))

    return scan(docs, fn, ENTRY)


def repeated(docs: DataFrame, found: DataFrame, unit: str, window: int, k: int, earlier_only: bool) -> DataFrame:
    """Repeated windows of each text, as runs: _id, _th, cover (array of places), from its survivors.

    earlier_only: a window counts if it also starts in a row with a smaller _id; otherwise
    if it also starts at any other place. Runs are settled whole, then in blocks, then singly."""
    hit, first = F.expr("_id > _d0" if earlier_only else "_c > 1"), F.expr("coalesce(_several, false) and _id = _d0")
    key, covers, block = ["kg", "ctx"], [], (window - k + 1) // 8
    for size in [block, 1] if block >= 4 else [1]:
        group = found.groupBy(*key).agg(F.min("_id").alias("_d0"), F.count("*").alias("_c"))
        several = group.groupBy("kg").agg(F.count("*").alias("_m")).where("_m > 1").select("kg", F.lit(True).alias("_several"))
        group = group.join(several, "kg", "left").where("_c > 1 or _several")
        marked = found.join(group, key).where(hit | first)
        settled = F.collect_set(F.when(hit, F.col("place"))).alias("cover")
        opened = F.collect_set(F.when(first, F.struct("kg", "place"))).alias("runs")
        marked = cut(marked.groupBy("_id", "_th").agg(settled, opened), "runs")
        discard(found)
        covers.append(marked)
        unsure = docs.join(marked.where("size(runs) > 0").select("_id", "_th", "runs"), ["_id", "_th"])
        parts = open_parts(unsure.select("_id", "_th", "text", "runs"), unit, window, size)
        found = cut(parts, "parts")
        if size > 1:
            parts, found = found, cut(survivors(found), "parts")
            discard(parts)
    if earlier_only:
        seen = found.groupBy(*key).agg(F.min("_id").alias("_d0"), F.max("_id").alias("_d1")).where("_d0 < _d1").drop("_d1")
        more = found.join(seen, key).where("_id > _d0")
    else:
        seen = found.groupBy(*key).agg(F.count("*").alias("_c")).where("_c > 1").select(*key)
        more = found.join(seen, key, "left_semi")
    every = more.groupBy("_id", "_th").agg(F.collect_set("place").alias("cover"))
    for marked in covers:
        every = every.unionByName(marked.where("size(cover) > 0").select("_id", "_th", "cover"))
    cover = cut(every.groupBy("_id", "_th").agg(F.flatten(F.collect_list("cover")).alias("cover")), "cover")
    discard(found, *covers)
    return cover


def covered(cover: pa.ListArray, row0: int, row1: int, first: np.ndarray, window: int) -> np.ndarray:
    """Whether each symbol lies in a repeated window, for rows row0 to row1 of a batch."""
    part = cover.slice(row0, row1 - row0)
    size = np.nan_to_num(np.asarray(part.value_lengths().fill_null(0)), nan=0).astype(np.int64)
    at, back, n = unpacked(part.flatten().to_numpy().astype(np.int64))
    lo = np.repeat(first[:-1], size) + at - back
    step = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n + window - 1, -1)
    return np.cumsum(step)[:-1] > 0


def with_cover(docs: DataFrame, cover: DataFrame | None) -> DataFrame:
    if cover is None:
        return docs.select("_id", "text", F.lit(None).cast("array<long>").alias("cover"))
    return docs.join(cover, ["_id", "_th"], "left").select("_id", "text", "cover")
