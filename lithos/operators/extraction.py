"""Measurements in text with their sentence context.

Spans need positions of every match, which the built-in regular expression functions do
not give; this runs in Arrow batches. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STOPS = re.compile(r"[.!?;。！？；](?:\s+|$)|\n+")
CLAUSE = re.compile(r"[,;:]\s+")
NUMBER, DASH = r"\d+(?:\.\d+)?", "[–-]"
PRESSURE = re.compile(r"\b(\d{2,3})\s*/\s*(\d{2,3})\s*mmhg\b", re.I)
PULSE = re.compile(r"\b(\d{2,3})\s*(bpm|beats/min|beats/minute)\b", re.I)
_units = ["mmol/l", "mg/dl", "ms", "s", "sec", "seconds", "minutes", "min", "hours", "h", "days", "day", "weeks", "week", "months", "month", "years", "year", "%", "mmhg"]
VALUE = re.compile(rf"({NUMBER}|\d+\s*{DASH}\s*{NUMBER})\s*({'|'.join(_units)})\b", re.I)
RANGE = re.compile(rf"({NUMBER})\s*{DASH}\s*({NUMBER})\s*(mmol/l|mg/dl|ms|%|mmhg)\b", re.I)
_shared = {
    "ECG": r"\b(?:qtc?|bazett|electrocardiogram|ecg)\b", "BP": r"\b(?:blood pressure|mmhg|hypertension|hypotension)\b", "HR": r"\b(?:heart rate|beats/min(?:ute)?|bpm)\b",
    "CALCIUM": r"\b(?:calcium\b|ca2\+\b)", "MAGNESIUM": r"\b(?:magnesium\b|mg2\+\b)",
}
_shared["EF"] = r"\b(?:ejection fraction|ef|lvef)\b"
#: Two vocabularies are in use: `rerun` (the default, the one of the published corpus) and `online`.
VOCABULARY = {
    "rerun": (_shared | {"FREQ": r"\b(?:every|per day|daily|times|episodes)\b", "DUR": r"\b(?:over the past|for the previous|last(?:ing|ed)|duration|follow-?up)\b"}, ("ECG", "BP", "HR", "CALCIUM", "MAGNESIUM", "EF", "FREQ", "DUR"), ("over the past", "for the previous", "every", "per day", "per month", "follow-up", "follow up", "blood pressure", "heart rate", "ejection fraction", "bazett", "electrocardiogram", "ionized calcium", "ogtt")),
    "online": (_shared | {"FREQ": r"\b(?:every|per day|per month|times|episodes)\b", "DUR": r"\b(?:over the past|for the previous|last(?:ing|ed)|duration)\b"}, ("ECG", "BP", "HR", "EF", "CALCIUM", "MAGNESIUM", "FREQ", "DUR"), ("over the past", "for the previous", "every", "per day", "per month", "lasting", "blood pressure", "heart rate", "ejection fraction", "bazett", "electrocardiogram", "ionized calcium")),
}


def cut_at(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in pattern.finditer(text):
        spans.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        spans.append((at, len(text)))
    return spans


def sentence_spans(text: str, least: int = 25) -> list[tuple[int, int]]:
    """Sentences; one shorter than `least` joins the one before, the first never does."""
    out: list[tuple[int, int]] = []
    for a, b in cut_at(text or "", STOPS):
        if out and b - a < least:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def pick(spans: list[tuple[int, int]], a: int, b: int) -> tuple[int, int]:
    """The span around [a, b), else the one with the nearest middle."""
    return next((s for s in spans if s[0] <= a and b <= s[1]), None) or min(spans, key=lambda s: abs((s[0] + s[1]) / 2 - (a + b) / 2))


def squeeze(s: str) -> str:
    return " ".join(s.split())


class Sentences:
    """The sentences of one text, cut once; pieces around a match."""

    def __init__(self, text: str):
        self.text, self.spans = text, sentence_spans(text)
        self.clauses: dict[int, list[tuple[int, int]]] = {}
        self.made: dict[tuple[int, int], str] = {}

    def around(self, a: int, b: int, clause: bool) -> str:
        """The sentence around a match, or its clause and 40 characters on either side."""
        if not self.spans:
            return squeeze(self.text[max(0, a - 120) : b + 120])
        s, e = pick(self.spans, a, b)
        lo, hi = s, e
        if clause:
            if s not in self.clauses:
                self.clauses[s] = cut_at(self.text[s:e], CLAUSE)
            if inner := self.clauses[s]:
                x, y = pick(inner, a - s, b - s)
                lo, hi = s + max(0, x - 40), min(e, s + y + 40)
        if (lo, hi) not in self.made:
            self.made[lo, hi] = squeeze(self.text[lo:hi])
        return self.made[lo, hi]


def context(text: str, a: int, b: int, clause: bool) -> str:
    return Sentences(text).around(a, b, clause)


@lru_cache(maxsize=None)
def families(vocabulary: str) -> tuple:
    patterns, order, literal = VOCABULARY[vocabulary]
    return tuple((k, re.compile(patterns[k], re.I)) for k in order), literal


@lru_cache(maxsize=4096)
def anchors(ctx: str, vocabulary: str = "rerun") -> list[str]:
    """Families whose pattern occurs, in their order, then literals, distinct."""
    patterns, literal = families(vocabulary)
    low = ctx.lower()
    return list(dict.fromkeys([k for k, p in patterns if p.search(ctx)] + [x for x in literal if x in low]))


FIELDS = ("span_start", "span_end", "surface", "raw_unit", "kind", "num", "low", "high", "systolic", "diastolic", "anchors_hit", "context", "ref_low", "ref_high", "ref_unit")


def found_in(text: str, vocabulary: str = "rerun") -> list[tuple]:
    """Blood pressures, then heart rates, then other values, each group by position (T04-T09), as FIELDS."""
    out, pressure, around = [], [], Sentences(text).around

    def add(m, unit: str, clause: bool, kind: str, num=None, low=None, high=None, systolic=None, diastolic=None, ranged: bool = False) -> None:
        a, b = m.span()
        ctx = around(a, b, clause)
        ref = next((r for r in RANGE.finditer(ctx) if r[3].lower() == unit.lower()), None) if ranged else None
        out.append((a, b, m[0], unit, kind, num, low, high, systolic, diastolic, anchors(ctx, vocabulary), ctx, *((float(ref[1]), float(ref[2]), T.UNITS.get(unit.lower(), unit)) if ref else (None, None, None))))

    for m in PRESSURE.finditer(text):
        pressure.append(m.span())
        add(m, "mmHg", True, "pressure", systolic=float(m[1]), diastolic=float(m[2]))
    for m in PULSE.finditer(text):
        if not any(s <= m.start() and m.end() <= e for s, e in pressure):
            add(m, m[2], True, "number", num=float(m[1]))
    for m in VALUE.finditer(text):
        if any(m.start() < e and s < m.end() for s, e in pressure):
            continue
        ends = [x.strip() for x in re.split(DASH, m[1])]
        value = {"kind": "range", "low": float(ends[0]), "high": float(ends[1])} if len(ends) == 2 else {"kind": "number", "num": float(m[1])}
        add(m, m[2], m[2].lower() in T.LAB, ranged=True, **value)
    return out


def mentions_in(text: str, vocabulary: str = "rerun") -> list[dict]:
    return [dict(zip(FIELDS, m, strict=True)) for m in found_in(text, vocabulary)]


MENTION = "span_start int, span_end int, surface string, raw_unit string, kind string, num double, low double, high double, systolic double, diastolic double, anchors_hit array<string>, context string, ref_low double, ref_high double, ref_unit string"
KINDS = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def extract(chunks: DataFrame, key: str = "chunk_key", text: str = "text", vocabulary: str = "rerun") -> DataFrame:
    """One row per mention: key, span_start, span_end, surface, raw_unit, value, anchors_hit, context,
    ref_range, unit, label_options, span_id."""
    # most text has no digit followed by a unit: the prefilter runs before anything leaves the JVM
    likely = chunks.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"\d\s*(?i:mm|mg|ms|bpm|beats|[smhdwy%])"))
    kinds = [KINDS[x.strip().split(" ", 1)[1]] for x in MENTION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a text that occurs again in the batch is not read again: its mentions are copied as columns
            texts = b.column(1).dictionary_encode()
            found = [found_in(t, vocabulary) for t in texts.dictionary.to_pylist()]
            each = np.array([len(x) for x in found], np.int64)
            if not each.sum():
                continue
            cols = [pa.array(c, t) for c, t in zip(zip(*[m for x in found for m in x], strict=True), kinds, strict=True)]
            at = texts.indices.to_numpy()
            n, start = each[at], (np.cumsum(each) - each)[at]
            row = np.repeat(np.arange(len(at)), n)
            mention = pa.array(np.arange(len(row)) - np.repeat(np.cumsum(n) - n - start, n))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *[c.take(mention) for c in cols]], names=["k", *FIELDS])

    kind = dict(likely.dtypes)["k"]
    m = likely.mapInArrow(run, f"k {kind}, {MENTION}")
    value = F.struct("kind", "num", "low", "high", "systolic", "diastolic").alias("value")
    ref = F.when(F.col("ref_unit").isNotNull(), F.struct(F.col("ref_low").alias("low"), F.col("ref_high").alias("high"), F.col("ref_unit").alias("unit"))).alias("ref_range")
    out = m.select(F.col("k").alias(key), "span_start", "span_end", "surface", "raw_unit", value, "anchors_hit", "context", ref, T.unit("raw_unit").alias("unit"), T.label_options("raw_unit", "anchors_hit", "context").alias("label_options"))
    return out.withColumn("span_id", F.sha1(F.concat_ws("|", F.col(key).cast("string"), "surface", "unit")))


def extract_repeated(chunks: DataFrame, text: str = "text", vocabulary: str = "rerun") -> DataFrame:
    """As extract, for texts that occur many times: each distinct one is read once, and every chunk gets
    its mentions by a join on the text. The chunk's columns but the text, then those of a mention without span_id."""
    once = chunks.select(F.col(text).alias("_key"), F.col(text).alias("_text")).distinct()
    found = extract(once, "_key", "_text", vocabulary).drop("span_id")
    return chunks.join(found, F.col(text) == F.col("_key")).drop(text, "_key")


def repacked(mentions: DataFrame) -> DataFrame:
    """Normalised copies of the text columns."""
    labels = F.array_distinct(F.filter(F.transform("label_options", lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return mentions.withColumns({"surface_norm": T.phrase("surface"), "unit_norm": T.phrase("unit"), "context_norm": T.phrase("context"), "label_options_norm": labels})
