"""Suffix-array dedup by bytes: drop bytes in long strings that occur at two places.

A logarithmic family of sparse suffix arrays. Of each 200-byte window one position is elected
by its content (see repeats), so equal windows elect alike; about 1.5 % of all suffixes start
there. An array holds the suffixes of its batches that start at elected positions, in
alphabetical order of their first `depth` bytes, equal beginnings as one entry with a count.
It is stored in buckets by beginning, each in order, so that two arrays are compared by one
merge scan without moving either: a beginning found on both sides is a match of `depth` bytes
or more. A new batch is scanned against every level; while its level is taken, the scan that
compares the two also writes their union as an array of twice the size. An index of n batches
has at most log2(n) + 1 levels and rewrites an entry at most log2(n) times.
Matches are then followed to full length in the texts (see repeats).
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, discard, keyed, prepare, public_id, record, scan, shared_dir, strings
from .repeats import WINDOW_LIMIT, anchors, covered, repeated, runs, symbols, with_cover


def beginnings(rows: DataFrame, window: int, depth: int) -> DataFrame:
    """rows: text. (head, kg): the first `depth` bytes of each suffix at an elected position, and their hash."""

    def fn(b: pa.RecordBatch):
        out = []
        for _, _, data, offs in bt.pieces(strings(b.column(0))):
            if (r := runs(*symbols(data, offs, "byte"), window, depth)) is not None:
                text, kg, _, at, _, _ = r
                at = offs[text] + at
                one = np.append(True, at[1:] != at[:-1])
                out.append((data[at[one][:, None] + np.arange(depth)], kg[one].view(np.int64)))
        if not out:
            return None
        flat = np.concatenate([x for x, _ in out])
        head = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * depth), pa.py_buffer(np.ascontiguousarray(flat))])
        return record(head=head, kg=pa.array(np.concatenate([k for _, k in out])))

    return scan(rows.select("text"), fn, "head binary, kg long")


class SuffixLevels:
    """levels[i] is None or the array of 2**i batches: head, kg, c (suffixes with that beginning), in
    `buckets` buckets by head. `found` holds the beginnings that merge scans met on both sides."""

    def __init__(self, spark: SparkSession, window: int = 200, depth: int = 64, buckets: int | None = None):
        self.spark, self.window, self.depth = prepare(spark), window, min(depth, window)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []
        self.found: list[DataFrame] = []

    def stored(self, rows: DataFrame) -> str:
        name = f"lithos_suffixes_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        rows.write.bucketBy(self.buckets, "head").sortBy("head").option("path", path).format("parquet").saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        df = self.spark.createDataFrame([], "a int")
        df._lithos_path = f"{shared_dir(self.spark).rstrip('/')}/{name}"
        discard(df)

    def arrays(self) -> list[str]:
        return [x for x in self.levels if x is not None]

    def scanned(self, one: str, two: str, how: str) -> DataFrame:
        """Merge scan of two arrays: each beginning with its counts on either side (n, m)."""
        a = self.spark.table(one).select("head", "kg", F.col("c").alias("n")).hint("merge")
        b = self.spark.table(two).select("head", F.col("kg").alias("kg2"), F.col("c").alias("m"))
        return a.join(b, "head", how)

    def append(self, rows: DataFrame) -> None:
        """rows: text. Beginnings that occur twice are noted, those new and those met in a level."""
        heads = beginnings(rows, self.window, self.depth).groupBy("head").agg(F.first("kg").alias("kg"), F.count("*").alias("c"))
        fresh = self.stored(heads)  # grouped by head already: a task writes whole buckets
        self.found.append(cut(self.spark.table(fresh).where("c > 1").select("kg"), "found"))
        i, merging = 0, True
        for i, old in enumerate([*self.levels, None]):
            if old is None:
                if merging:
                    if i == len(self.levels):
                        self.levels.append(None)
                    self.levels[i], merging = fresh, False
                continue
            if merging:  # the scan writes the union; beginnings on both sides have their counts added
                both = self.scanned(old, fresh, "full_outer")
                n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
                union = self.stored(both.select("head", F.coalesce("kg", "kg2").alias("kg"), (n + m).alias("c"), ((n > 0) & (m > 0)).alias("met")))
                self.found.append(cut(self.spark.table(union).where("met").select("kg"), "found"))
                self.drop(old)
                self.drop(fresh)
                self.levels[i], fresh = None, union
            else:
                self.found.append(cut(self.scanned(old, fresh, "inner").select("kg"), "found"))

    def matched(self) -> DataFrame:
        """Hashes of the beginnings that occur at two places in all batches so far."""
        return reduce(DataFrame.unionByName, self.found).distinct()

    def close(self) -> None:
        for name in self.arrays():
            self.drop(name)
        discard(*self.found)
        self.levels, self.found = [], []


def drop_repeated_bytes(docs: DataFrame, window: int = 200, depth: int = 64, batches: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, and with
    keep_text the remaining bytes (`kept`, binary: a cut may fall inside a character).

    A byte goes if a string of `window` bytes over it also starts at any other place, in the
    same text or another, judged on the input; overlaps count. Null texts are empty. Rows
    that repeat, whether id or text, are each a place of their own. Other columns are ignored.
    batches: how many batches, by a hash of the id, the index takes the rows in; the result
    is the same. An empty table gives an empty result. window: at most WINDOW_LIMIT.
    """
    spark = prepare(docs.sparkSession)
    if not 1 <= window <= WINDOW_LIMIT:
        raise ValueError(f"window {window}")
    rows = keyed(docs, id_col, text_col)
    index = SuffixLevels(spark, window, depth)
    for i in range(batches):
        index.append(rows if batches == 1 else rows.where(F.pmod(F.xxhash64("_id"), F.lit(batches)) == i))
    matched = cut(index.matched(), "matched")
    index.close()
    found = cut(anchors(rows, "byte", window, [index.depth], last=True).join(matched, "kg", "left_semi"), "suffixes")
    discard(matched)
    cover = repeated(rows, found, "byte", window, index.depth, earlier_only=False)

    def fn(b: pa.RecordBatch):
        n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
        for r0, r1, data, offs in bt.pieces(strings(b.column(1))):
            gone = covered(b.column(2), r0, r1, offs, window)
            n_bytes += np.diff(offs).tolist()
            n_removed += bt.per_text(gone, offs).tolist()
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edge = offs[:-1][offs[1:] > offs[:-1]]
            head[edge] = gone[edge]
            n_spans += bt.per_text(head, offs).tolist()
            flat, at = data[~gone].tobytes(), np.append(0, np.cumsum(~gone))[offs].tolist()
            out = [flat[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
            sha += [hashlib.sha256(x).hexdigest() for x in out]
            if keep_text:
                kept += out
        cols = {"_id": b.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha)}
        return record(**cols, **({"kept": pa.array(kept, pa.binary())} if keep_text else {}))

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = scan(with_cover(rows, cover), fn, schema)
    return out.select(public_id(id_col), *out.columns[1:])
