"""Reproducible sampling: every choice comes from a hash of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def k_of_n(rows: DataFrame, group: list[str], key: list[str], k: int, seed: int) -> DataFrame:
    """k rows of each group without replacement, the same ones in any order of arrival."""
    u = T.uniform(seed, *group, *key)
    w = Window.partitionBy(*group).orderBy("_u", *key)
    return rows.withColumn("_u", u).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("_u")


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """rows with `at`, their place (0, 1, ...) in the given order: a range-partitioned sort, written
    once with each row's place in its partition, and the counts of the partitions before."""
    from .graph import stored

    kept = stored(rows.sort(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    before = kept.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))
    before = before.select("_p", "_first", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each partition
    return kept.join(F.broadcast(before), "_p").withColumn("at", F.col("_base") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_base")


def shuffled_range(rows: DataFrame, key: str, seed: int, start: int, stop: int) -> DataFrame:
    """Rows start to stop of the shuffled order."""
    placed = numbered(rows.select(F.col(key), T.uniform(seed, key).alias("_u")), ["_u", key])
    return rows.join(placed.where((F.col("at") >= start) & (F.col("at") < stop)).select(key), key, "left_semi")


def weighted_pick(rows: DataFrame, group: list[str], item: str, weight: str, seed: int, draws: int = 1, least: float = 0.001) -> DataFrame:
    """draws items of each group, with replacement, by weight."""
    w = F.greatest(F.lit(least), F.col(weight))
    order = Window.partitionBy(*group).orderBy(F.desc(weight), item)
    cum = rows.withColumn("_cum", F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum(w).over(Window.partitionBy(*group)))
    each = cum.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    target = T.uniform(seed, *group, "draw") * F.col("_all")
    return each.where(F.col("_cum") > target).groupBy(*group, "draw").agg(F.min_by(item, "_cum").alias(item))


def phrase_of(scales: list[str], seed: int, key: str) -> Column:
    """A phrase of the first non-empty list."""
    first = F.coalesce(*[F.when(F.size(s) > 0, F.col(s)) for s in scales])
    return F.element_at(first, F.floor(T.uniform(seed, key) * F.size(first)).cast("int") + 1)


def query_text(kind: str, phrases: list[str], case_filter: str = "") -> Column:
    """seed0 "p"; seed1 and neg "p" AND "q"; seed2 "p" AND ("q" OR "r"); then the case filter."""
    q = [T.quoted(p) for p in phrases]
    if kind == "seed2":
        out = F.concat(q[0], F.lit(" AND ("), q[1], F.lit(" OR "), q[2], F.lit(")"))
    else:
        out = F.concat_ws(" AND ", *q)
    return F.concat(out, F.lit(f" AND ({case_filter})")) if case_filter else out


def repaired(rows: DataFrame, phrases: str = "phrases", rewritten: str = "rewritten", hits: str = "hits", new_hits: str = "new_hits") -> DataFrame:
    """Repair policy (R09): rewrite a weak phrase or one without hits; use the repaired query if
    it is new and finds at least as much."""
    weak = T.is_weak(phrases)
    want = weak | (F.coalesce(F.col(hits), F.lit(1)) == 0)
    new = F.when(want & (T.phrase(rewritten) != "") & (T.phrase(rewritten) != T.phrase(phrases)), F.col(rewritten))
    better = new.isNotNull() & (F.coalesce(F.col(new_hits), F.lit(0)) > F.coalesce(F.col(hits), F.lit(0)))
    return rows.withColumns({"weak": weak, "repaired": new.isNotNull(), "used": F.when(better, new).otherwise(F.col(phrases))})


def non_neighbours(ids: DataFrame, key: str, edges: DataFrame, src: str, dst: str, seed: int) -> DataFrame:
    """For each id one that is neither itself nor a neighbour, drawn evenly by hash (J17): a place among
    those left, moved on past the places left out. An id that neighbours all others has no row.
    A row gathers the places of one id's neighbours."""
    places = numbered(ids.select(key).distinct(), [key])
    n = places.count()
    near = edges.select(F.col(src).alias(key), F.col(dst).alias("_o")).unionByName(ids.select(key, F.col(key).alias("_o"))).distinct()
    out = near.join(places.withColumnRenamed(key, "_o"), "_o").groupBy(key).agg(F.array_sort(F.collect_list("at")).alias("_out"))
    draw = F.floor(T.uniform(seed, key) * (n - F.size("_out"))).cast("long")
    at = F.aggregate("_out", draw, lambda p, e: F.when(e <= p, p + 1).otherwise(p))
    picked = ids.select(key).distinct().join(out, key).where(F.size("_out") < n).select(key, at.alias("at"))
    return picked.join(places.withColumnRenamed(key, "other"), "at").select(key, "other")


def inspection(rows: DataFrame, key: str, n_col: str, n: int, seed: int) -> DataFrame:
    """n ids to look at (A27): half with the highest counts, half with the lowest, the rest by hash."""
    half = max(1, n // 2)
    top = rows.orderBy(F.desc(n_col), key).limit(half).select(key, F.lit(0).alias("_w"))
    tail = rows.orderBy(F.asc(n_col), F.desc(key)).limit(half).select(key, F.lit(1).alias("_w"))
    rest = rows.select(key).join(top.unionByName(tail).select(key), key, "left_anti").orderBy(T.uniform(seed, key), key).limit(n).select(key, F.lit(2).alias("_w"))
    every = top.unionByName(tail).unionByName(rest).groupBy(key).agg(F.min("_w").alias("_w"))
    return every.orderBy("_w", T.uniform(seed, key), key).limit(n).select(key)


def term_sets(knn: DataFrame, labels: DataFrame, k_min: int, k_max: int, per_seed: int = 40, same_ratio: float = 0.85, seed: int = 42, least: int = 2) -> DataFrame:
    """Cluster-aware sets around each seed (R13): from its `per_seed` nearest neighbours k - 1 are
    taken, where k is drawn from k_min to k_max; each place prefers the seed's cluster with
    probability same_ratio and falls back to the other side. Sets below `least` members and
    repeated sets are dropped. knn: i, j, rank; labels: id, cluster. Returns seed, k, members,
    clusters, n_same, n_cross, signature."""
    l1, l2 = labels.select(F.col("id").alias("i"), F.col("cluster").alias("ci")), labels.select(F.col("id").alias("j"), F.col("cluster").alias("cj"))
    near = knn.where(F.col("rank") <= per_seed).join(l1, "i").join(l2, "j")
    k = F.lit(k_min) + F.floor(T.uniform(seed, F.lit("k"), "i") * (k_max - k_min + 1)).cast("int")
    near = near.withColumns({"k": k, "same": F.col("ci") == F.col("cj"), "u": T.uniform(seed, F.lit("m"), "i", "j")})
    rank = F.row_number().over(Window.partitionBy("i", "same").orderBy("u", "j"))
    side = F.count(F.when(F.col("same"), 1)).over(Window.partitionBy("i"))
    near = near.withColumns({"r": rank, "n_same_all": side, "n_all": F.count("*").over(Window.partitionBy("i"))})
    places = F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("k")))
    wish = F.size(F.filter(places, lambda p: T.uniform(seed, F.lit("c"), "i", p) < same_ratio))
    wish = F.when(F.col("k") < 2, 0).otherwise(wish)
    n_cross_all = F.col("n_all") - F.col("n_same_all")
    same_n = F.least(F.col("n_same_all"), F.greatest(wish, F.col("k") - 1 - n_cross_all))
    cross_n = F.least(n_cross_all, F.col("k") - 1 - same_n)
    took = near.where(F.when(F.col("same"), F.col("r") <= same_n).otherwise(F.col("r") <= cross_n))
    sets = took.groupBy("i", "ci", "k").agg(F.array_sort(F.collect_list(F.struct("u", "j", "cj"))).alias("m"))
    members = F.concat(F.array("i"), F.transform("m", lambda x: x["j"]))
    clusters = F.concat(F.array("ci"), F.transform("m", lambda x: x["cj"]))
    out = sets.select(F.col("i").alias("seed"), "k", members.alias("members"), clusters.alias("clusters")).where(F.size("members") >= least)
    out = out.withColumns({"n_same": F.size(F.filter("clusters", lambda c: c == F.element_at("clusters", 1))), "signature": T.signature(F.transform("members", lambda x: x.cast("string")))})
    out = out.withColumn("n_cross", F.size("clusters") - F.col("n_same"))
    return out.groupBy("signature").agg(F.min(F.struct("seed", "k", "members", "clusters", "n_same", "n_cross")).alias("s")).select("s.*", "signature")
