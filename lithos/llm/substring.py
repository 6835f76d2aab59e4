"""Substring dedup by words: drop words in windows that an earlier document already has.

Level-wise doubling: windows that repeat at one length alone are extended to twice that
length, until no candidate survives or the length asked for is reached (see repeats). With
4-word seeds and 13-word windows the lengths are 4, 8, 13. At 4 and 8 only the windows that
13-word windows elect are counted, which loses none; at 13 equal runs of windows are counted
as one, the others one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytetext as bt
from .common import keyed, prepare, public_id, record, scan, strings
from .repeats import WINDOW_LIMIT, covered, extended, repeated, with_cover


def drop_repeats(docs: DataFrame, window: int = 13, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256, and with keep_text the
    kept words joined by one space (`kept`).

    Words are maximal runs without ASCII white space. A word goes if a window of `window`
    words over it also starts in a row with a smaller id, judged on the input. Null texts
    have no words and hash as the empty string; a null id counts as the smallest; rows with
    one id never remove each other's words, whether they repeat or differ. Other columns
    are ignored. A text shorter than a window is kept whole. window: at most WINDOW_LIMIT.
    """
    prepare(docs.sparkSession)
    if not 1 <= window <= WINDOW_LIMIT:
        raise ValueError(f"window {window}")
    rows = keyed(docs, id_col, text_col)
    found, k = extended(rows, "word", window, seed)
    cover = None if found is None else repeated(rows, found, "word", window, k, earlier_only=True)

    def fn(b: pa.RecordBatch):
        text, n_words, n_removed, sha, kept = strings(b.column(1)), [], [], [], []
        for r0, r1, data, offs in bt.pieces(text):
            data, offs = bt.spaced(data, offs)
            start, end, first = bt.words(data, offs)
            gone = covered(b.column(2), r0, r1, first, window)
            n_words += np.diff(first).tolist()
            n_removed += bt.per_text(gone, first).tolist()
            out = bt.joined(data, start, end, first, ~gone)
            sha += [hashlib.sha256(x).hexdigest() for x in out]
            if keep_text:
                kept += [x.decode() for x in out]
        cols = {"_id": b.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha)}
        return record(**cols, **({"kept": pa.array(kept, pa.string())} if keep_text else {}))

    schema = "_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    out = scan(with_cover(rows, cover), fn, schema)
    return out.select(public_id(id_col), *out.columns[1:])
