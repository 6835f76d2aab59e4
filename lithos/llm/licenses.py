"""Licence scan: ordered signature rules behind a keyword prefilter.

A multi-string automaton finds the rules' keywords; only rules whose keyword occurs are
tried. Overlapping detections are resolved by priority: a detection inside the interval of
one of higher priority, or inside a longer one of equal priority, is suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import prepare, record, scan, strings
from .license_rules import rules

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
NOT_WORD = ~WORD
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
_in, _out = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"
BASE = [(re.compile(b"(?<!" + _in + b")" + (_out + b"+").join(p.encode().split(b" ")) + b"(?!" + _in + b")"), p.encode().split(b" ")[-1], label) for p, label in PHRASES]
#: A mark that begins (or ends) a line of a comment, and what is reduced to one blank: line ends with such marks about them, and other white space.
MARK = r"""(?:/\*+!?|\*+/?|//+!?|\#+!?|;+|--+>?|%+|<!--+|!+|>+|\||\.?\\"|["'](?=\s)|(?:dnl|rem)\b)"""
GAP = re.compile(rf"[^\S\n]*(?:(?<=\s){MARK}[^\S\n]*)?\n(?:\s*{MARK})*\s*|\s\s+|[^\S ]")


def flattened(text: str) -> tuple[str, list[int], list[int]]:
    """text with each GAP as one blank; where its unchanged stretches begin, there and in text."""
    parts, here, there, end, n = [], [0], [0], 0, 0
    for m in GAP.finditer(text):
        parts += text[end : m.start()], " "
        n += m.start() - end + 1
        end = m.end()
        here.append(n)
        there.append(end)
    return "".join([*parts, text[end:]]), here, there


@lru_cache(maxsize=1)
def compiled():
    import ahocorasick

    every = [(label, priority, word, re.compile(pattern), weight, "licen[sc]e" in pattern) for label, priority, word, pattern, weight in rules()]
    auto, by = ahocorasick.Automaton(), {}
    for i, r in enumerate(every):
        by.setdefault(r[2], []).append(i)
    for word, at in by.items():
        auto.add_word(word, (word, at))
    auto.make_automaton()
    return every, auto


@lru_cache(maxsize=1)
def required():
    """For each rule the blank-free strings that any text it matches holds: flattening only makes blanks,
    so these stand in the raw text as well. And an automaton of all of them."""
    import ahocorasick

    needs = [frozenset(word.split()) | frozenset(x for x in ("licen",) if named) | frozenset(x for x in ("0",) if "mit[- ]0" in p.pattern) | frozenset(x for x in ("by",) if "cc[ -]by" in p.pattern) for _, _, word, p, _, named in compiled()[0]]
    auto = ahocorasick.Automaton()
    for x in frozenset().union(*needs):
        auto.add_word(x, x)
    auto.make_automaton()
    return frozenset(needs), auto


def may_match(text: str) -> bool:
    """Whether all that some rule requires stands in the text; if not, no rule matches it."""
    needs, auto = required()
    held = {x for _, x in auto.iter(text)}
    return any(n <= held for n in needs)


def detections(text: str) -> list[tuple[int, int, int, str, float]]:
    """(start, end, priority, label, weight) in lower-cased text, suppressed ones left out, by start.
    Rules see the text flattened, so that phrases may be wrapped; places are those in text."""
    every, auto = compiled()
    text, here, there = flattened(text)

    def place(p: int) -> int:
        k = bisect_right(here, p) - 1
        return there[k] + p - here[k]

    named = "licen" in text
    tried = sorted({i for _, (_, at) in auto.iter(text) for i in at if named or not every[i][5]})
    found = [(m.start(), m.end(), every[i][1], every[i][0], every[i][4], i) for i in tried for m in every[i][3].finditer(text) if m.end() > m.start()]
    # kept detections inside no other one, by start: their ends rise too, so one look tells whether d is inside any
    kept, starts, ends = [], [], []
    for d in sorted(found, key=lambda d: (d[2], d[0] - d[1], d[0], d[5])):
        k = bisect_right(starts, d[0])
        if k and ends[k - 1] >= d[1]:
            continue
        kept.append(d)
        k = bisect_left(starts, d[0])
        last = bisect_right(ends, d[1])
        starts[k:last], ends[k:last] = [d[0]], [d[1]]
    return sorted((place(d[0]), place(d[1] - 1) + 1, *d[2:5]) for d in kept)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per input row: id_col, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and with spans the detections themselves (start and end in code points).

    Texts are lower-cased in A-Z; words are runs of digits, letters and characters beyond
    ASCII. Base detections are the phrases in PHRASES wherever their words stand one after
    another; the rules add labels. score is the chance that at least one label holds, from
    the rules' weights as if independent (base phrases: 0.9). Null and empty texts have no
    words, empty labels and score 0. Ids are passed on as they are; repeated rows each count.
    """
    prepare(docs.sparkSession)

    def fn(b: pa.RecordBatch):
        col = strings(b.column(1))
        n_words, out = [], []
        for _, _, data, offs in bt.pieces(col):
            data = bt.LOWER[data]
            start, _, first = bt.words(data, offs, NOT_WORD)
            n_words += np.diff(first).tolist()
            raw = data.tobytes()
            for r in range(len(offs) - 1):
                text = raw[offs[r] : offs[r + 1]]
                s = text.decode()
                base, weights, places = set(), [], []
                for pattern, must, label in BASE:
                    if must in text:
                        at = [m.start() for m in pattern.finditer(text)]
                        if at:
                            places += at
                            base.add(label)
                            weights.append(0.9)
                found = detections(s) if may_match(s) else []
                best = {}
                for d in found:
                    best[d[3]] = max(best.get(d[3], 0.0), d[4])
                labels = base | set(best)
                weights += [w for k, w in best.items() if k not in base]
                word = [int(np.searchsorted(start, offs[r] + p) - first[r]) for p in places]
                miss = 1.0
                for w in weights:
                    miss *= 1 - w
                out.append((len(word), min(word, default=None), max(word, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1 - miss, [{"start": d[0], "end": d[1], "label": d[3]} for d in found]))
        cols = list(zip(*out, strict=True))
        names = (("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()))
        made = {k: pa.array(c, t) for (k, t), c in zip(names, cols, strict=False)}
        if spans:
            made["spans"] = pa.array(cols[6], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string())])))
        return record(id=b.column(0), n_words=pa.array(n_words, pa.int64()), **made)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" + ", spans array<struct<start:int,end:int,label:string>>" * spans
    return scan(source, fn, schema).withColumnRenamed("id", id_col)
