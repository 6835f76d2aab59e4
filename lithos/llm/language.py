"""Language of texts by a linear-chain conditional random field over their words.

A word's potentials are sums of learnt weights of its affixes and character n-grams (read
over the word with a mark at both ends) and of the word itself as a lexicon entry; learnt
transition weights tie neighbours. Forward-backward labels every word, so text that
switches language part-way is told apart; a text's language is the one with the largest
mean posterior.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import held, prepare, record, scan, strings

BITS = 17
BLOCK = 128
APART = np.ones(256, bool)
APART[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = False
U = np.uint64


def words_of(data: np.ndarray, offs: np.ndarray):
    low = bt.LOWER[data]
    start, end, first = bt.words(low, offs, APART)
    return low, start, end, first


def feature_sums(low: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray | None = None):
    """With weights: the potentials of each word (words x labels). Without: (word, feature) for every feature."""
    size = end - start
    n = len(size)
    wide = size + 2
    at = np.cumsum(wide) - wide
    buf = np.full(int(wide.sum()) + 4, 32, np.uint8)
    inner = np.ones(len(buf) - 4, bool)
    inner[at] = inner[at + wide - 1] = False
    buf[:-4][inner] = bt.gather(low, start, size)
    b = buf.astype(np.uint64)
    owner = np.repeat(np.arange(n), wide)
    left = np.repeat(at + wide, wide) - np.arange(len(owner))
    out = np.zeros((n, weights.shape[1]), np.float32) if weights is not None else []
    code = b.copy()
    total = len(owner)

    def put(word, feature):
        if weights is None:
            out.append((word, feature))
        else:
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(word, weights[feature, k], n).astype(np.float32)

    for k in (2, 3, 4):  # those that touch a mark are the affixes
        code = code[: len(code) - 1] * U(257) + b[k - 1 :]
        ok = left >= k
        put(owner[ok], (bt.mix(code[:total][ok] + U(k << 56)) >> U(64 - BITS)).astype(np.int64))
    lexicon = bt.mix(bt.word_hashes(low, start, end) + U(99)) >> U(64 - BITS)
    put(np.arange(n), lexicon.astype(np.int64))
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def forward_backward(potential: np.ndarray, length: np.ndarray, move: np.ndarray, start: np.ndarray, head: np.ndarray | None = None, pairs: bool = False):
    """Marginals (blocks x steps x labels) of blocks of words padded at the end; move[i, j] and start are
    log weights. A block without `head` goes on where the one before it ends, so chains of any length
    are exact: the product of each block's steps carries the messages from block to block. With pairs
    also the expected transitions within blocks (labels x labels)."""
    s, t, n = potential.shape
    e = potential - potential.max(axis=2, keepdims=True)
    np.exp(e, out=e)
    m = np.exp(move - move.max())
    into, last = np.tile(np.exp(start - start.max()), (s, 1)), np.ones((s, n))
    if head is not None and not head.all():
        number = np.arange(s) - np.maximum.accumulate(np.where(head, np.arange(s), 0))
        part = np.flatnonzero((number > 0) | np.append(number[1:] > 0, False))
        product = np.eye(n)[None] * e[part, 0, None, :]
        for i in range(1, t):
            step = (product.reshape(-1, n) @ m).reshape(-1, n, n) * e[part, i, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            product = np.where((i < length[part])[:, None, None], step, product)
        whole = np.zeros((s, n, n))
        whole[part] = product
        for k in range(1, int(number.max()) + 1):
            at = np.flatnonzero(number == k)
            into[at] = scaled(scaled(np.einsum("si,sij->sj", into[at - 1], whole[at - 1])) @ m)
        for k in range(int(number.max()), 0, -1):
            at = np.flatnonzero(number == k)
            last[at - 1] = scaled(np.einsum("sij,sj->si", whole[at], last[at]) @ m.T)
    p = np.empty((t, s, n))  # forward messages first, each step then multiplied by its backward message
    for i in range(t):
        p[i] = scaled(e[:, i] * (into if i == 0 else p[i - 1] @ m))
    back, both = last, np.zeros((n, n))
    for i in range(t - 1, -1, -1):
        if i + 1 < t:
            ahead = e[:, i + 1] * back
            if pairs:
                x = p[i][:, :, None] * m * ahead[:, None, :]
                both += (x / x.sum(axis=(1, 2), keepdims=True))[i + 1 < length].sum(axis=0)
            back = np.where((i + 1 < length)[:, None], scaled(ahead @ m.T), last)
            p[i + 1] = done
        done = scaled(p[i] * back)
    p[0] = done
    p = p.transpose(1, 0, 2)
    return (p, both) if pairs else p


def fit(snippets: list[tuple[str, bytes]], epochs: int = 12, seed: int = 7) -> dict:
    """snippets: (label, a few words joined by blanks). Half of the chains are one snippet, half
    join two snippets of any labels, so that transitions are learnt too."""
    labels = sorted({x for x, _ in snippets})
    n = len(labels)
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    data = np.frombuffer(b" ".join(t for _, t in snippets), np.uint8)
    offs = np.append(0, np.cumsum([len(t) + 1 for _, t in snippets]))
    offs[-1] = len(data)
    low, start, end, first = words_of(data, offs)
    word, feature = (np.concatenate(c) for c in zip(*feature_sums(low, start, end), strict=True))
    order = np.argsort(word, kind="stable")
    feature = feature[order]
    per_word = np.searchsorted(word[order], np.arange(len(start) + 1))
    gold = np.repeat([number[x] for x, _ in snippets], np.diff(first))
    weights, step = np.zeros((1 << BITS, n), np.float32), np.full((1 << BITS, n), 1e-2, np.float32)
    move, begin = np.zeros((n, n)), np.zeros(n)
    move2, begin2 = np.full((n, n), 1e-2), np.full(n, 1e-2)
    count, rate = len(snippets), 0.3
    has = np.flatnonzero(np.diff(first) > 0)
    for _ in range(epochs if len(has) else 0):
        chains = [np.arange(first[i], first[i + 1]) for i in has]
        chains += [np.concatenate([chains[a], chains[b]]) for a, b in zip(rng.integers(0, len(has), len(has)), rng.integers(0, len(has), len(has)), strict=True)]
        for part in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            length = np.array([len(chains[i]) for i in part])
            w = np.concatenate([chains[i] for i in part])
            row, col = np.repeat(np.arange(len(part)), length), np.arange(len(w)) - np.repeat(np.cumsum(length) - length, length)
            width = per_word[w + 1] - per_word[w]
            f, own = bt.gather(feature, per_word[w], width), np.repeat(np.arange(len(w)), width)
            pot = np.zeros((len(part), int(length.max()), n))
            score = np.stack([np.bincount(own, weights[f, k], len(w)) for k in range(n)], axis=1)
            pot[row, col] = score
            p, both = forward_backward(pot, length, move, begin, pairs=True)
            p = p[row, col]
            g = -p
            g[np.arange(len(w)), gold[w]] += 1
            g /= len(part)
            grad = np.stack([np.bincount(f, g[own, k], 1 << BITS) for k in range(n)], axis=1) - 1e-6 * weights
            step += (grad * grad).astype(np.float32)
            weights += (rate * grad / np.sqrt(step)).astype(np.float32)
            nxt = np.flatnonzero(col[1:] > 0)
            seen = np.zeros((n, n))
            np.add.at(seen, (gold[w[nxt]], gold[w[nxt + 1]]), 1)
            gm = (seen - both) / len(part) - 1e-3 * move
            move2 += gm * gm
            move += rate * gm / np.sqrt(move2)
            gb = (np.bincount(gold[w[col == 0]], minlength=n) - p[col == 0].sum(axis=0)) / len(part)
            begin2 += gb * gb
            begin += rate * gb / np.sqrt(begin2)
    return {"labels": labels, "weights": weights, "move": move, "start": begin, "trained_on": count}


def snippets_of(docs: DataFrame, label: str, text_col: str, per_label: int, each: int = 4, length: int = 24) -> list[tuple[str, bytes]]:
    """Of each label the per_label different texts with the smallest hashes, and from each up to `each`
    stretches of `length` words spread over the whole text. Copies count once, so that no more
    than per_label * each stretches a label are sent to the driver."""
    rows = docs.select(F.col(label).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).where("label is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    # twice as many as needed by a threshold, then exactly the smallest of them
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, (2 * per_label + 100) / max(1, n))))])
    place = F.pmod("h", F.lit(1 << 40))
    some = rows.where(place < rate[F.col("label")] * float(1 << 40))
    order = Window.partitionBy("label").orderBy(place, "h")
    least = some.select("label", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_label).select("label", "h")
    chosen = some.join(F.broadcast(least), ["label", "h"]).select("label", "text")

    def fn(b: pa.RecordBatch):
        out = []
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            d = np.frombuffer(text.encode(), np.uint8)
            low, start, end, _ = words_of(d, np.array([0, len(d)]))
            n = len(start)
            for at in sorted({int(i * max(0, n - length) / max(1, each - 1)) for i in range(each)}) if n else ():
                last = min(n, at + length)
                out.append((label, b" ".join(bytes(low[s:e][:64]) for s, e in zip(start[at:last], end[at:last], strict=True))))
        return record(label=pa.array([x for x, _ in out], pa.string()), words=pa.array([x for _, x in out], pa.binary())) if out else None

    return sorted((r.label, bytes(r.words)) for r in scan(chosen, fn, "label string, words binary").distinct().collect())


class Tagger:
    """Applies a fitted model; potentials of words met before are kept while there is room."""

    def __init__(self, model: dict, bits: int = 20):
        self.model, self.n = model, len(model["labels"])
        self.bits = bits
        self.reset()

    def reset(self) -> None:
        self.known, self.scores = bt.Table(self.bits), np.zeros((1 << (self.bits - 1), self.n), np.float32)

    def potentials(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = bt.word_hashes(low, start, end) | U(1)
        at = self.known.find(h)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.scores[at]
        key, i = np.unique(h[new], return_index=True)
        if not self.known.room(len(key)):
            self.reset()
            at = self.known.find(h)
            key, i = np.unique(h, return_index=True)
            new = np.arange(len(h))
            if not self.known.room(len(key)):
                return feature_sums(low, start, end, self.model["weights"])
        i = new[i]
        self.scores[self.known.size : self.known.size + len(key)] = feature_sums(low, start[i], end[i], self.model["weights"])
        self.known.add(key)
        return self.scores[self.known.find(h)]

    def marginals(self, data: np.ndarray, offs: np.ndarray):
        """Posterior of each label for each word, and each text's first word. A text is one chain,
        computed in blocks of BLOCK words."""
        low, start, end, first = words_of(data, offs)
        if not len(start):
            return np.zeros((0, self.n)), first
        each = np.diff(first)
        i = np.arange(len(start)) - np.repeat(first[:-1], each)
        row, col = np.cumsum(i % BLOCK == 0) - 1, i % BLOCK
        length = np.bincount(row)
        pot = np.zeros((len(length), int(length.max()), self.n))
        pot[row, col] = self.potentials(low, start, end)
        return forward_backward(pot, length, self.model["move"], self.model["start"], i[col == 0] == 0)[row, col], first


def identify(docs: DataFrame, label: str = "lang", per_label: int = 400, id_col: str = "doc_id", text_col: str = "text", segments: bool = False, key_col: str | None = None) -> DataFrame:
    """One row per input row: id_col (key_col where given), held_out, lang_pred, score, and with segments the runs of
    words of one language (array of first word, number of words, label).

    Learns from rows with a label whose crc32(id as text) mod 3 is not 1, of which a bounded
    sample (at most per_label different texts a label, chosen by hash, four stretches of 24
    words of at most 64 bytes from each) goes to the driver, where the model is fitted. Predictions use the text alone. held_out: that remainder
    is 1 (null id: false, and not learnt from). lang_pred is `und` with score 0 where the
    text is null or has no letter, or nothing could be learnt; score is the mean posterior
    of the predicted label over the text's words; of equal ones the first label in code point order
    wins. Repeated rows are predicted alike, however long; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    rest = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))
    model = fit(snippets_of(docs.where(rest != 1), label, text_col, per_label))
    import uuid

    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(model)

    def fn(b: pa.RecordBatch):
        tagger = held(key, lambda: Tagger(shared.value))
        labels = tagger.model["labels"]
        pred, score, runs = [], [], []
        for r0, r1, data, offs in bt.pieces(strings(b.column(2))):
            if not labels:
                pred += ["und"] * (r1 - r0)
                score += [0.0] * (r1 - r0)
                runs += [[]] * (r1 - r0)
                continue
            p, first = tagger.marginals(data, offs)
            total = np.concatenate([np.zeros((1, len(labels))), np.cumsum(p, axis=0)])
            total = total[first[1:]] - total[first[:-1]]
            n = np.diff(first)
            best = total.argmax(axis=1)
            ascii_letters = bt.per_text(~APART[data] & (data < 0x80), offs)
            best_word = p.argmax(axis=1)
            for r in range(r1 - r0):
                letters = n[r] and (ascii_letters[r] or any(c.isalpha() for c in data[offs[r] : offs[r + 1]].tobytes().decode()))
                pred.append(labels[best[r]] if letters else "und")
                score.append(min(1.0, max(0.0, float(total[r, best[r]] / n[r]))) if letters else 0.0)
                if segments:
                    w = best_word[first[r] : first[r + 1]]
                    cut = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, int)
                    runs.append([{"first": int(a), "n": int(z - a), "lang": labels[w[a]]} for a, z in zip(cut, np.append(cut[1:], len(w)), strict=True)] if letters else [])
        cols = {"id": b.column(0), "held_out": b.column(1), "lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
        if segments:
            cols["segments"] = pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())])))
        return record(**cols)

    key_col = key_col or id_col
    source = docs.select(F.col(key_col).alias("id"), F.coalesce(rest == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, held_out boolean, lang_pred string, score double" + ", segments array<struct<first:int,n:int,lang:string>>" * segments
    return scan(source, fn, schema).withColumnRenamed("id", key_col)
