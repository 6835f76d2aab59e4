"""Document quality by weak supervision.

Rules look at one property each and vote good, vote bad or abstain. No rule is trusted as
it is: expectation-maximisation over the table of vote patterns estimates how often each
rule is right and how common good documents are, and a document is kept by the posterior
probability that it is good, not by passing every rule.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import cut, prepare, record, scan, strings

MARKS = np.zeros(256, bool)
MARKS[list(b"#*$%&|<>")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_digits", "n_stops", "n_distinct", "n_alpha_words")


def first_of_each(keys: np.ndarray) -> np.ndarray:
    flag = np.zeros(len(keys), bool)
    flag[np.unique(keys, return_index=True)[1]] = True
    return flag


def counts_of(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """COUNTS of each text, in order."""
    start, end, first = bt.words(data, offs)
    owner, salt = bt.owners(first), bt.mix(np.arange(1, len(offs), dtype=np.uint64))
    h = bt.word_hashes(data, start, end)
    chars = bt.per_text((data & 0xC0) != 0x80, offs) - bt.per_text(bt.SPACE[data], offs)
    # lines: \n-split, and only those with a word count
    ls, le, lf = bt.words(data, offs, NEWLINE)
    lh = bt.stretch_hash(data, ls, le) ^ salt[bt.owners(lf)]
    has = np.searchsorted(start, le) > np.searchsorted(start, ls)
    again = has.copy()
    again[has] = ~first_of_each(lh[has])
    # words in windows found twice or more in their text
    covered = np.zeros(len(h) + 1, np.int64)
    ok = bt.whole(first, WINDOW)
    if ok.any():
        at = np.flatnonzero(ok)
        w = bt.grams(h, WINDOW)[at] ^ salt[owner[at]]
        _, inverse, n = np.unique(w, return_inverse=True, return_counts=True)
        hit = at[n[inverse] > 1]
        covered[hit] += 1
        covered[hit + WINDOW] -= 1
    letters = np.append(0, np.cumsum(LETTER[data]))
    return [
        np.diff(first), chars, bt.per_text(MARKS[data], offs), bt.per_text(again, lf), bt.per_text(np.cumsum(covered)[:-1] > 0, first),
        bt.per_text(has, lf), bt.per_text(LETTER[data], offs), bt.per_text(DIGIT[data], offs), bt.per_text(STOP[data], offs), bt.per_text(first_of_each(h ^ salt[owner]), first), bt.per_text(letters[end] > letters[start], first),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the counts in COUNTS for each row; a null text has no words."""

    def fn(b: pa.RecordBatch):
        parts = [counts_of(data, offs) for _, _, data, offs in bt.pieces(strings(b.column(1)))]
        return record(id=b.column(0), **{k: np.concatenate(c).astype(np.int64) for k, c in zip(COUNTS, zip(*parts, strict=True), strict=True)})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return scan(source, fn, f"id {dict(source.dtypes)['id']}, " + ", ".join(f"{k} long" for k in COUNTS)).withColumnRenamed("id", id_col)


def vote(good: str, bad: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstain. Null and empty texts abstain or vote bad."""
    return {
        "length": vote("n_words >= 40", "n_words < 20"),
        "word_length": vote("word_chars between 3 * n_words and 10 * n_words", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
        "symbols": vote("200 * n_symbols <= n_words", "10 * n_symbols > n_words"),
        "line_repeats": vote("n_lines >= 2 and n_dup_lines = 0", "n_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
        "word_repeats": vote("n_words >= 20 and 100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 30 * n_words"),
        "letters": vote("10 * n_letters >= 8 * word_chars and n_words > 0", "10 * n_letters < 7 * word_chars"),
        "wordless": vote("100 * n_alpha_words >= 95 * n_words and n_words > 0", "10 * n_alpha_words < 8 * n_words"),
        "digits": vote("50 * n_digits <= word_chars and n_words >= 20", "5 * n_digits > word_chars"),
        "sentences": vote("n_stops > 0 and n_words between 2 * n_stops and 60 * n_stops", "n_words >= 100 and n_stops = 0"),
        "variety": vote("n_words >= 20 and 4 * n_distinct >= n_words", "n_words >= 50 and 10 * n_distinct < n_words"),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, tolerance: float = 1e-9) -> dict:
    """EM for one hidden label (good or bad) and rules that vote independently given it.

    A rule's accuracies are P(vote | label) for its three outcomes, bad, abstain and good,
    because a rule may be sharp on bad texts and blunt on good ones. It starts from
    responsibilities that fall with the number of bad votes; every update is smoothed by two
    votes of the starting belief, and no rule may favour the wrong label. Returns prior,
    given_good and given_bad (rules x outcomes), and accuracy: P(right | it votes).
    """
    if not patterns:
        return {"prior": 0.5, "given_good": np.zeros((0, 3)), "given_bad": np.zeros((0, 3)), "accuracy": np.zeros(0)}
    votes, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    belief = np.array([[0.05, 0.15, 0.8], [0.5, 0.2, 0.3]])
    good = 0.95 * 0.3 ** (votes < 0).sum(axis=1)
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((good * n).sum() / n.sum(), 0.05, 0.95))
        theta = np.stack([(w[:, None, None] * hot).sum(axis=0) + 2 * b for w, b in zip((good * n, (1 - good) * n), belief, strict=True)])
        theta /= theta.sum(axis=2, keepdims=True)
        wrong = (theta[0, :, 0] > theta[1, :, 0]) | (theta[1, :, 2] > theta[0, :, 2])
        theta[:, wrong] = theta.mean(axis=0)[wrong]
        odds = np.log(prior / (1 - prior)) + (hot * np.log(theta[0] / theta[1])).sum(axis=(1, 2))
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved = float(np.abs(new - good).max())
        good = new
        if moved < tolerance:
            break
    right = theta[0, :, 2] * prior + theta[1, :, 0] * (1 - prior)
    cast = right + theta[0, :, 0] * prior + theta[1, :, 2] * (1 - prior)
    return {"prior": prior, "given_good": theta[0], "given_bad": theta[1], "accuracy": right / cast}


def posterior(model: dict, votes: list[Column]) -> Column:
    odds = F.lit(log(model["prior"] / (1 - model["prior"])))
    for v, g, b in zip(votes, model["given_good"], model["given_bad"], strict=True):
        low, mid, high = (float(log(x / y)) for x, y in zip(g, b, strict=True))
        odds = odds + F.when(v < 0, low).when(v > 0, high).otherwise(mid)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5, with_votes: bool = False) -> DataFrame:
    """One row per input row: id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality (posterior probability of being good).

    base_failed: fewer than 20 words, or over 30 % of the words in 8-word windows found twice
    or more in the text. kept is false then, else quality >= keep_at; the estimates come from
    the rows that do not fail. Null and empty texts
    have no words and fail. Rows are scored one by one, ids passed on as they are; repeated
    rows each weigh in the estimates. The driver gets the vote patterns with their counts,
    at most 3 to the power of the number of rules. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    names = list(rules())
    marked = cut(features(docs, id_col, text_col).select("*", *[c.alias(f"vote_{k}") for k, c in rules().items()]), "votes")
    cols = [f"vote_{k}" for k in names]
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    table = sorted((tuple(r[:-1]), r[-1]) for r in marked.where(~failed).groupBy(*cols).count().collect())
    quality = posterior(estimate(table), [F.col(c) for c in cols]) if table else F.lit(0.5)
    out = marked.select(id_col, *COUNTS[:5], failed.alias("base_failed"), (~failed & (quality >= keep_at)).alias("kept"), quality.alias("quality"), *(cols if with_votes else []))
    return out
