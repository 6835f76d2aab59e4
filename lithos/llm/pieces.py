"""SentencePiece encoding and decoding over a table of distinct chunks.

In a model none of whose pieces has a marker after another character, no merge crosses
from one marked word to the next. Each distinct marked word of a batch is segmented once;
texts are then put together by position from that table. The table lives in the worker
and is bounded, so neither its size nor a shuffle grows with the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import held, prepare, record, strings

MARK = "▁"
STEP = 4096


class ChunkTable:
    def __init__(self, model: bytes, bits: int = 20, budget: int = 1 << 19):
        import sentencepiece

        self.bits, self.budget = bits, budget
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces cross markers")
        probe = "  a  b " + MARK
        if "".join(sp.id_to_piece(i) for i in sp.encode(probe)) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises white space")
        self.alone, self.lead, self.end = sp.piece_to_id(MARK), sp.piece_to_id("a"), sp.eos_id()
        self.reset()

    def reset(self) -> None:
        self.known = bt.Table(self.bits)
        n = 1 << (self.bits - 1)
        self.count, self.at, self.width, self.faithful = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        self.digits, self.used = np.zeros(1 << 20, np.uint8), 0
        self.odd: dict[int, bytes] = {}

    def learn(self, chunks: list[bytes], hashes: np.ndarray) -> None:
        """Segment new chunks: their number of ids, the ids as " 12 345", and whether they decode to themselves."""
        coded = [x or [self.alone] for x in self.sp.encode([c[1:].decode() for c in chunks], num_threads=1)]
        plain = self.sp.decode([[self.lead, *x] for x in coded], num_threads=1)
        text = ["".join(f" {i}" for i in x).encode() for x in coded]
        n0, n1 = self.known.size, self.known.size + len(chunks)
        width = np.array([len(x) for x in text])
        self.count[n0:n1], self.width[n0:n1] = [len(x) for x in coded], width
        self.at[n0:n1] = self.used + np.cumsum(width) - width
        flat = np.frombuffer(b"".join(text), np.uint8)
        while self.used + len(flat) > len(self.digits):
            self.digits = np.concatenate([self.digits, np.zeros_like(self.digits)])
        self.digits[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        for i, (c, t) in enumerate(zip(chunks, plain, strict=True)):
            t = t[1:].encode()
            self.faithful[n0 + i] = t == c
            if t != c:
                self.odd[n0 + i] = t
        self.known.add(hashes)

    def encode(self, col: pa.Array):
        """For each text (number of ids without the end id, decimal ids each after a blank, decoded text), as bytes."""
        for r0, r1, data, offs in bt.pieces(col, self.budget):
            # a marker before each text, and every blank is one
            data = np.insert(data, offs[:-1], np.uint8(32))
            offs = offs + np.arange(len(offs))
            blank = data == 32
            start = blank.copy()
            start[1:] &= ~blank[:-1]
            start[offs[:-1]] = True
            start = np.flatnonzero(start)
            end = np.append(start[1:], len(data))
            raw = data.tobytes()
            h = bt.stretch_hash(data, start, end) | np.uint64(1)
            at = self.known.find(h)
            while len(new := np.unique(h[at < 0])):
                if not self.known.room(len(new)):  # forget, or grow if one stretch fills the table
                    if self.known.size == 0:
                        self.bits += 1
                    self.reset()
                    at = self.known.find(h)
                    continue
                i = np.flatnonzero(at < 0)
                i = i[np.unique(h[i], return_index=True)[1]]
                for k in range(0, len(new), STEP):  # few at a time: the library's lists take far more room than the table
                    some = i[k : k + STEP]
                    self.learn([raw[a:z] for a, z in zip(start[some].tolist(), end[some].tolist(), strict=True)], new[k : k + STEP])
                at = self.known.find(h)
            flat = bt.gather(self.digits, self.at[at], self.width[at]).tobytes()
            first = np.searchsorted(start, offs)
            c = np.append(0, np.cumsum(self.count[at], dtype=np.int64))[first]
            w = np.append(0, np.cumsum(self.width[at], dtype=np.int64))[first].tolist()
            true = np.append(0, np.cumsum(~self.faithful[at]))[first]
            for r in range(r1 - r0):
                if offs[r + 1] - offs[r] == 1:  # an empty text has no marker
                    yield 0, b"", b""
                    continue
                text = raw[offs[r] + 1 : offs[r + 1]]
                if true[r + 1] > true[r]:
                    a, z = first[r], first[r + 1]
                    text = b"".join(self.odd.get(k, raw[s:e]) for k, s, e in zip(at[a:z].tolist(), start[a:z].tolist(), end[a:z].tolist(), strict=True))[1:]
                yield int(c[r + 1] - c[r]), flat[w[r] : w[r + 1]], text


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per input row: id_col, n_tokens, ids_sha256, decoded_sha256, and with keep the
    ids (array<int>) and the decoded text themselves.

    model: path of a sentencepiece model, read by the driver and sent as it is. An end id
    is added, no begin id. Null and empty texts encode as the end id alone and decode as
    the empty text. Ids are passed on as they are, null or repeated; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(f"pieces {hashlib.sha256(shared.value).hexdigest()}", lambda: ChunkTable(shared.value))
        for b in batches:
            rows = []
            for n, ids, text in table.encode(strings(b.column(1))):
                ids = (ids + f" {table.end}".encode())[1:]
                rows.append((n + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), *([list(map(int, ids.split(b" "))), text.decode()] if keep else [])))
            cols = list(zip(*rows, strict=True))
            out = {"id": b.column(0), "n_tokens": pa.array(cols[0], pa.int64()), "ids_sha256": pa.array(cols[1]), "decoded_sha256": pa.array(cols[2])}
            if keep:
                out |= {"ids": pa.array(cols[3], pa.list_(pa.int32())), "decoded": pa.array(cols[4], pa.string())}
            yield record(**out)

    source = docs.select(F.col(id_col).alias("id"), F.replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(MARK), F.lit(" ")).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
