"""Gate of generated lines: keyword hits, coverage, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def hits(line, anchors) -> Column:
    """Keys of the map anchors (key → keywords) with a keyword in the line."""
    held = lambda x: F.filter(F.map_entries(T.col(anchors)), lambda e: F.exists(e["value"], lambda a: (a != "") & F.contains(x, F.concat(F.lit(" "), a, F.lit(" ")))))
    found = T.let(F.concat(F.lit(" "), T.alnum(line), F.lit(" ")), held)
    return F.transform(found, lambda e: e["key"])


def blacklisted(line, words: tuple[str, ...] = T.BLACKLIST) -> Column:
    x = F.lower(F.coalesce(T.col(line), F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def gated(items: DataFrame, lines: str = "lines", anchors: str = "anchors", seed: str | None = "seed", least_hits: int = 2, words: tuple[str, ...] = T.BLACKLIST) -> DataFrame:
    """Adds valid (lines that pass, distinct in order), covered (sorted keys they hit), missing
    and coverage (F18, A17, O04). seed: a key every line must hit, or None."""
    # each line is normalised and matched once: (line, the keys it hits)
    met = F.transform(F.filter(lines, lambda x: ~blacklisted(x, words)), lambda x: F.struct(T.strip(x).alias("x"), hits(x, anchors).alias("h")))
    good = F.filter(met, lambda m: (F.size(m["h"]) >= least_hits) & (F.array_contains(m["h"], F.col(seed)) if seed else F.lit(True)))
    out = items.withColumn("_good", good)
    out = out.withColumns({"valid": F.array_distinct(F.transform("_good", lambda m: m["x"])), "covered": F.array_sort(F.array_distinct(F.flatten(F.transform("_good", lambda m: m["h"]))))}).drop("_good")
    return out.withColumns({"missing": F.array_except(F.map_keys(anchors), "covered"), "coverage": F.size("covered") / F.greatest(F.lit(1), F.size(anchors))})


def diversity(lines) -> Column:
    """struct(div_ok, reason, dup_start_ratio, near_dup_pairs) of the lines of one item.
    Pairs are within one item's few generated lines."""
    def of(tokens: Column) -> Column:
        """tokens: for each line its tokens in order, computed once."""
        n = F.size(tokens)
        starts = F.transform(tokens, lambda t: F.array_join(F.slice(t, 1, 3), " "))
        ratio = 1.0 - F.size(F.array_distinct(F.filter(starts, lambda s: s != ""))) / F.greatest(F.lit(1), n)

        def close(a: Column, b: Column) -> Column:
            # sets of sizes p <= q with Jaccard >= 0.92 have p >= 0.92 q: most pairs are settled by their sizes
            p, q = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
            same = F.size(F.array_intersect(a, b))
            return F.when((p == 0) | (p < q * 0.92), F.lit(False)).otherwise(same / (p + q - same) >= 0.92)

        count = lambda sets: F.aggregate(F.transform(sets, lambda a, i: F.size(F.filter(F.slice(sets, i + 2, F.size(sets)), lambda b: close(a, b)))), F.lit(0), lambda s, x: s + x)
        pairs = T.let(F.transform(tokens, lambda t: F.array_distinct(t)), count)
        return F.struct(n.alias("n"), ratio.alias("ratio"), pairs.alias("pairs"))

    d = T.let(F.transform(T.col(lines), lambda x: F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), of)

    def judged(d: Column) -> Column:
        n, ratio, pairs = d["n"], d["ratio"], d["pairs"]
        many = pairs >= F.greatest(F.lit(3), F.floor(n / 2).cast("int"))
        reason = F.when(n == 0, "no_lines").when(many, "near_duplicates").when(ratio > 0.55, "duplicate_starts").otherwise("ok")
        return F.struct((reason == "ok").alias("div_ok"), reason.alias("reason"), F.when(n == 0, 1.0).otherwise(ratio).alias("dup_start_ratio"), F.when(n == 0, 0).otherwise(pairs).alias("near_dup_pairs"))

    return T.let(d, judged)


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Most valid lines, then coverage, then diversity; the earliest of equals (W09). attempts has
    attempt, valid, coverage, div_ok."""
    rank = F.struct(F.size("valid"), F.round("coverage", 9), F.col("div_ok"), -F.col("attempt"))
    rest = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(key, "b.*")


def keyword_block(anchors, least_hits: int = 2, show: int = 4, title: str = "Required keywords") -> Column:
    """Prompt block that lists each key's keywords."""
    rows = F.transform(F.map_entries(T.col(anchors)), lambda e: F.concat(F.lit("* "), e["key"], F.lit(": "), F.array_join(F.slice(e["value"], 1, show), ", ")))
    return F.concat(F.lit(f"{title} (each line needs {least_hits}):\n"), F.array_join(rows, "\n"))


def verdict(text) -> Column:
    """struct(label, confidence, why) of a pair judgement's VERDICT, CONF and WHY lines."""
    get = lambda k, p: F.nullif(F.trim(F.regexp_extract(F.coalesce(T.col(text), F.lit("")), rf"(?im)^\s*{k}\s*[:=]\s*({p})", 1)), F.lit(""))
    return F.struct(F.upper(get("VERDICT", "yes|maybe|no")).alias("label"), get("CONF", r"[0-9.]+").try_cast("double").alias("confidence"), get("WHY", ".*").alias("why"))


def run_summary(items: DataFrame) -> DataFrame:
    """n, n_ok, n_fail, mean attempts, mean coverage of items with any."""
    return items.agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum((~F.col("ok")).cast("long")).alias("n_fail"), F.avg("attempts").alias("mean_attempts"), F.avg(F.when(F.col("coverage") > 0, F.col("coverage"))).alias("mean_coverage"))
