"""Token counts of a byte-level BPE vocabulary, mostly by table lookup.

Offline, each vocabulary string is proved to be a whole token: it is one pre-token of the
splitting pattern and the merges, run on its bytes, end in that single entry. Texts are
then split by the pattern; a pre-token in the proved table counts one, and only the rest
is merged.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import held, prepare, record, strings

# White space is spelled out: the \s of this library also takes U+001C to U+001F.
BLANK = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"


def byte_symbols() -> str:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in plain else chr(next(rest)) for b in range(256))


SYMBOLS = byte_symbols()


def visible(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(SYMBOLS)


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merges: the lowest rank first, the leftmost of equals."""
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: ranks.get((symbols[i], symbols[i + 1]), 1 << 60))
        if (symbols[best], symbols[best + 1]) not in ranks:
            break
        symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
    return symbols


@lru_cache(maxsize=4)
def proved(spec: str) -> frozenset[str]:
    """Vocabulary strings that, as they stand in a text, are one pre-token and encode as one token."""
    model = json.loads(spec)["model"]
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    back = {c: i for i, c in enumerate(SYMBOLS)}
    split = regex.compile(PATTERN)
    good = set()
    for token in model["vocab"]:
        if any(c not in back for c in token):
            continue
        try:
            text = bytes(back[c] for c in token).decode()
        except UnicodeDecodeError:
            continue
        if split.findall(text) == [text] and merge(list(token), ranks) == [token]:
            good.add(text)
    return frozenset(good)


def letter_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for each code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, np.uint8)
    for c, pattern in enumerate((r"\p{L}", r"\p{N}")):
        out[[ord(x) for x in regex.findall(pattern, every)]] = c
    out[[ord(x) for x in regex.findall(f"[{BLANK}]", every)]] = 3
    return out


def pre_tokens(cp: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pattern's pre-tokens start, for texts of code points laid end to end (first: n + 1 offsets)."""
    n = len(cp)
    kind = classes[cp]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    # the last blank of a run before other characters stands alone or, if U+0020, opens the next pre-token
    b = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[:-1] == 3)) + 1
    start[b - 1] = True
    start[b[cp[b - 1] == 0x20]] = False
    q = np.flatnonzero((cp == 0x27) & start & run[:n])
    q = q[q + 1 < n]
    if len(q):
        pad = np.append(cp, [0, 0, 0])
        one, two = pad[q + 1], pad[q + 2]
        is2 = ~edge[q + 1] & np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        inside = ~edge[q + 1] & ~edge[np.minimum(q + 2, n)]
        is3 = inside & (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C))
        start[q[is2 | is3] + 1] = False
        after = np.concatenate([q[is2] + 2, q[is3] + 3])
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


class Counter:
    """Counts the tokens of texts. Starts with the proved table; merged pre-tokens are remembered while there is room."""

    def __init__(self, spec: str, table: frozenset[str], bits: int = 21):
        from tokenizers import Tokenizer

        self.proved, self.model, self.bits = sorted(table), Tokenizer.from_str(spec).model, bits
        self.split, self.classes = regex.compile(PATTERN), letter_classes()
        special = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.reset()

    def reset(self) -> None:
        self.known, self.sizes = bt.Table(self.bits), np.ones(1 << (self.bits - 1), np.int32)
        cp = np.frombuffer("".join(self.proved).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(x) for x in self.proved])
        self.known.add(self.hashes(cp, end - [len(x) for x in self.proved], end))

    def hashes(self, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return bt.stretch_hash(cp, start, end, bt.mix(cp.astype(np.uint64) + np.uint64(7))) | np.uint64(1)

    def merged(self, piece: str) -> int:
        return len(self.model.tokenize(visible(piece)))

    def slow(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(map(self.merged, (y for x in parts for y in self.split.findall(x))))

    def count(self, col: pa.Array) -> np.ndarray:
        out = np.zeros(len(col), np.int64)
        for r0, r1, data, offs in bt.pieces(col):
            text = data.tobytes().decode()
            cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            first = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offs]
            start = pre_tokens(cp, first, self.classes)
            end = np.append(start[1:], len(cp))
            h = self.hashes(cp, start, end)
            at = self.known.find(h)
            gone = np.flatnonzero(at < 0)
            if len(gone):
                new, i = np.unique(h[gone], return_index=True)
                i = gone[i]
                if not self.known.room(len(new)):
                    self.reset()
                    at = self.known.find(h)
                    new, i = np.unique(h[at < 0], return_index=True)
                    i = np.flatnonzero(at < 0)[i]
                sizes = np.array([self.merged(text[a:z]) for a, z in zip(start[i].tolist(), end[i].tolist(), strict=True)], np.int32)
                if self.known.room(len(new)):
                    self.sizes[self.known.size : self.known.size + len(new)] = sizes
                    self.known.add(new)
                    at[at < 0] = self.known.find(h[at < 0])
                    each = self.sizes[at]
                else:  # more distinct pre-tokens in one stretch than the table holds
                    each = np.where(at < 0, sizes[np.minimum(np.searchsorted(new, h), len(new) - 1)], self.sizes[at])
            else:
                each = self.sizes[at]
            c = np.append(0, np.cumsum(each, dtype=np.int64))
            w = np.searchsorted(start, first)
            out[r0:r1] = c[w[1:]] - c[w[:-1]]
            if self.special and self.special.search(text):
                for r in range(r0, r1):
                    t = text[first[r - r0] : first[r - r0 + 1]]
                    if self.special.search(t):
                        out[r] = self.slow(t)
        return out


def supported(spec: str) -> None:
    j = json.loads(spec)
    pre, model = j["pre_tokenizer"] or {}, j["model"]
    if j["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in j["added_tokens"]) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("not a plain byte-level BPE file")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE .json file, read by the driver; executors get its
    content and the proved table, whose size the vocabulary fixes. Added special strings
    found in a text count as one token each, as the library does by default. Null texts
    are empty: no bytes, no tokens. Ids are passed on as they are, null or repeated.
    """
    spark = prepare(docs.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    supported(spec)
    shared = spark.sparkContext.broadcast((spec, proved(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = held(f"tokens {hashlib.sha256(shared.value[0].encode()).hexdigest()}", lambda: Counter(*shared.value))
        for b in batches:
            yield record(id=b.column(0), n_bytes=b.column(2), n_tokens=counter.count(strings(b.column(1))))

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(source.dtypes)["id"]
    out = source.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
