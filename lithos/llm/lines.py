"""Line dedup over an index that can take documents in and out again.

The index is an exact table of line keys with the number of documents that hold each one,
and, for the keys that reach the threshold, a cuckoo filter per shard of the key space.
Lines are first looked up in the filters, which rejects nearly all of them where the text
is read; what passes is confirmed in the exact table. Filters support removal, so deleting
documents restores lines that are no longer common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import NO_ID, cut, keyed, prepare, public_id, record, scan, strings

BLANKS = b" \t\n\x0b\x0c\r"
SEED2 = 0x5DEECE66D
FILTER_BYTES = 64 << 20
U = np.uint64


class CuckooFilter:
    """16-bit fingerprints, 4 to a bucket, partial-key cuckoo hashing; items are 64-bit hashes."""

    def __init__(self, slots: np.ndarray | int):
        if isinstance(slots, int):
            slots = np.zeros((1 << max(2, int(slots * 1.2 / 4).bit_length()), 4), np.uint16)
        self.slots, self.mask = slots, len(slots) - 1

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = (h & U(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        one = ((h >> U(16)) & U(self.mask)).astype(np.int64)
        return fp, one, one ^ self.jump(fp)

    def jump(self, fp: np.ndarray) -> np.ndarray:
        return (bt.mix(fp.astype(np.uint64)) & U(self.mask)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, one, two = self.places(h)
        return (self.slots[one] == fp[:, None]).any(axis=1) | (self.slots[two] == fp[:, None]).any(axis=1)

    def insert(self, h: np.ndarray) -> bool:
        """False if it is full; the caller then builds a larger one."""
        for fp, one, two in zip(*self.places(h), strict=True):
            for n, at in enumerate((one, two)):
                free = np.flatnonzero(self.slots[at] == 0)
                if len(free):
                    self.slots[at, free[0]] = fp
                    break
            else:
                for n in range(500):
                    k = n & 3
                    fp, self.slots[at, k] = self.slots[at, k], fp
                    at ^= int(self.jump(np.array([fp], np.uint16))[0])
                    free = np.flatnonzero(self.slots[at] == 0)
                    if len(free):
                        self.slots[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def remove(self, h: np.ndarray) -> None:
        """Items must have been inserted."""
        for fp, one, two in zip(*self.places(h), strict=True):
            for at in (one, two):
                held = np.flatnonzero(self.slots[at] == fp)
                if len(held):
                    self.slots[at, held[0]] = 0
                    break

    @staticmethod
    def build(h: np.ndarray) -> CuckooFilter:
        room = max(8, len(h))
        while not (f := CuckooFilter(room)).insert(h):
            room *= 2
        return f


def line_keys(text: bytes) -> list[bytes]:
    return [x.strip(BLANKS).lower() for x in text.split(b"\n")]


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    xx = xxhash.xxh64_intdigest
    return np.array([xx(k, 42) for k in keys], np.uint64), np.array([xx(k, SEED2) for k in keys], np.uint64)


def key_counts(rows: DataFrame, least: int) -> DataFrame:
    """k1, k2, n: rows holding each key of at least `least` code points, summed per batch before any shuffle."""

    def fn(b: pa.RecordBatch):
        every = []
        for t in strings(b.column(0)).cast(pa.binary()).to_pylist():
            every += {k for k in line_keys(t) if len(k) >= least and (least <= 1 or len(k.decode()) >= least)}
        if not every:
            return None
        one, two = hashes(every)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        return record(k1=one[new].view(np.int64), k2=two[new].view(np.int64), n=np.diff(np.append(new, len(one))).astype(np.int64))

    return scan(rows.select("text"), fn, "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("n"))


class LineIndex:
    """Reference counts of line keys; insert and delete take documents (id_col, text_col)."""

    def __init__(self, spark: SparkSession, threshold: int = 10, least: int = 1, shards: int = 64, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.threshold, self.least, self.shards, self.names = prepare(spark), threshold, least, shards, (id_col, text_col)
        self.refs: DataFrame | None = None
        self.filters: DataFrame | None = None

    def insert(self, docs: DataFrame) -> None:
        self.change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """docs must have been inserted."""
        self.change(docs, -1)

    def change(self, docs: DataFrame, sign: int) -> None:
        fresh = key_counts(keyed(docs, *self.names), self.least).withColumn("n", F.col("n") * sign)
        if self.refs is None:
            self.refs = cut(fresh, "lines")
            changed = self.frequent().withColumn("step", F.lit(1))
            held = self.spark.createDataFrame([], "shard int, blob binary")
        else:
            both = self.refs.select("k1", "k2", "n", F.lit(0).cast("long").alias("d")).unionByName(fresh.select("k1", "k2", F.lit(0).cast("long").alias("n"), F.col("n").alias("d")))
            new = cut(both.groupBy("k1", "k2").agg(F.sum("n").alias("old"), F.sum("d").alias("d")).withColumn("n", F.col("old") + F.col("d")), "lines")
            self.refs = new.where("n <> 0").select("k1", "k2", "n")
            step = F.when((F.col("old") < self.threshold) & (F.col("n") >= self.threshold), 1).when((F.col("old") >= self.threshold) & (F.col("n") < self.threshold), -1)
            changed = new.withColumn("step", step).where("step is not null").select("k1", "k2", "step")
            held = self.filters
        shards, key = self.shards, F.pmod("k1", F.lit(self.shards)).cast("int")

        def refresh(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return right
            h = bt.mix(left["k1"].to_numpy().view(np.uint64) ^ left["k2"].to_numpy().view(np.uint64))
            up, down = h[left["step"] > 0], h[left["step"] < 0]
            shard = int(left["k1"].iloc[0] % shards)
            if not len(right):
                return pd.DataFrame({"shard": [shard], "blob": [CuckooFilter.build(up).slots.tobytes()]})
            f = CuckooFilter(np.frombuffer(right["blob"].iloc[0], np.uint16).reshape(-1, 4).copy())
            f.remove(down)
            # full: an empty blob asks for a rebuild from the exact table
            return pd.DataFrame({"shard": [shard], "blob": [f.slots.tobytes() if f.insert(up) else b""]})

        changed = changed.withColumn("shard", key)
        filters = cut(changed.groupBy("shard").cogroup(held.groupBy("shard")).applyInPandas(refresh, "shard int, blob binary"), "filters")
        full = filters.where("length(blob) = 0").select("shard")
        if full.take(1):
            again = self.frequent().withColumn("shard", key).join(full, "shard", "left_semi").withColumn("step", F.lit(1))
            none = self.spark.createDataFrame([], "shard int, blob binary")
            rebuilt = again.groupBy("shard").cogroup(none.groupBy("shard")).applyInPandas(refresh, "shard int, blob binary")
            filters = cut(filters.where("length(blob) > 0").unionByName(rebuilt), "filters")
        self.filters = filters

    def frequent(self) -> DataFrame:
        return self.refs.where(F.col("n") >= self.threshold).select("k1", "k2")

    def common_lines(self, rows: DataFrame) -> DataFrame:
        """rows: _id, _th, text → _id, _th, drop (sorted numbers of the lines to drop), for rows with any."""
        sizes = {r.shard: r.n for r in self.filters.select("shard", F.length("blob").alias("n")).collect()}  # a row a shard
        groups: list[list[int]] = [[]]
        room = FILTER_BYTES
        for shard, n in sorted(sizes.items()):  # texts are read once for each FILTER_BYTES of filters
            if groups[-1] and n > room:
                groups.append([])
                room = FILTER_BYTES
            groups[-1].append(shard)
            room -= n
        lines = [self.looked_up(rows, group) for group in groups]
        every = reduce(DataFrame.unionByName, lines)
        return every.join(self.frequent(), ["k1", "k2"]).groupBy("_id", "_th").agg(F.sort_array(F.collect_set("i")).alias("drop"))

    def looked_up(self, rows: DataFrame, group: list[int]) -> DataFrame:
        """Lines (k1, k2, _id, _th, i) that pass the filters of these shards, which are broadcast."""
        some = self.filters.where(F.col("shard").isin(group)) if group else self.filters.where("false")
        shared = self.spark.sparkContext.broadcast({r.shard: bytes(r.blob) for r in some.toLocalIterator()})
        shards, least = self.shards, self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter(np.frombuffer(v, np.uint16).reshape(-1, 4)) for k, v in shared.value.items()}
            for b in batches:
                keys, row, number = [], [], []
                for r, t in enumerate(strings(b.column(2)).cast(pa.binary()).to_pylist()):
                    for i, k in enumerate(line_keys(t)):
                        if len(k) >= least:
                            keys.append(k), row.append(r), number.append(i)
                if not keys:
                    continue
                one, two = hashes(keys)
                ok = np.zeros(len(keys), bool)
                shard, h = one.view(np.int64) % shards, bt.mix(one ^ two)
                for s, f in filters.items():
                    at = np.flatnonzero(shard == s)
                    ok[at] = f.contains(h[at])
                row = np.array(row)[ok]
                yield record(k1=one[ok].view(np.int64), k2=two[ok].view(np.int64), _id=b.column(0).to_numpy()[row], _th=b.column(1).to_numpy()[row], i=np.array(number, np.int32)[ok])

        return rows.mapInArrow(run, "k1 long, k2 long, _id long, _th long, i int")


def drop_common_lines(docs: DataFrame, threshold: int = 10, least: int = 1, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_lines (before dropping), n_dropped, kept_sha256, and
    with keep_text the remaining lines joined by a line feed (`kept`).

    A line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased. Keys of at least `least` code points found in `threshold` rows or more
    lose all their lines. Null and empty texts are one empty line, which stays. Every row
    counts as a document, repeated rows too; a line repeated in one row counts once. Other
    columns are ignored. index: an index to use as it stands, instead of one made of docs.
    """
    spark = prepare(docs.sparkSession)
    if index is None:
        index = LineIndex(spark, threshold, least, id_col=id_col, text_col=text_col)
        index.insert(docs)
    rows = keyed(docs, id_col, text_col)

    def fn(b: pa.RecordBatch):
        n, gone, sha, kept = [], [], [], []
        for t, drop in zip(strings(b.column(1)).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
            n.append(t.count(b"\n") + 1)
            gone.append(len(drop or ()))
            if drop:
                drop = set(drop)
                t = b"\n".join(x for i, x in enumerate(t.split(b"\n")) if i not in drop)
            sha.append(hashlib.sha256(t).hexdigest())
            if keep_text:
                kept.append(t.decode())
        cols = {"_id": b.column(0), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return record(**cols, **({"kept": pa.array(kept, pa.string())} if keep_text else {}))

    joined = rows.join(index.common_lines(rows), ["_id", "_th"], "left").select("_id", "text", "drop")
    out = scan(joined, fn, "_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * keep_text)
    return out.select(public_id(id_col), *out.columns[1:])


def rewrite(docs: DataFrame, index: LineIndex) -> DataFrame:
    """docs with all their columns, whatever their names, text without the index's common lines.
    Null texts stay null; empty texts and texts without common lines stay as they are; rows that
    repeat are each rewritten; an empty table stays empty."""
    id_col, text_col = index.names
    rows = keyed(docs, id_col, text_col)
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_th"))
    out = tagged.join(index.common_lines(rows), ["_id", "_th"], "left")
    text = F.col("row")[text_col]
    left = F.array_join(F.filter(F.split(text.cast("string"), "\n", -1), lambda x, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), text).otherwise(left)
    return out.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
