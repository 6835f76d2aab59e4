"""Evidence: joins between queries, documents and terms, selection, coverage (J, A, W, O rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def rows_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Normalised text, its length and hash."""
    norm = T.compact(text)
    return docs.withColumns({"text_norm": norm, "len_norm": F.length(norm), "sha1_norm": F.sha1(norm)})


def year_number(year) -> Column:
    return F.when(T.col(year).rlike("^[0-9]+$"), T.col(year).cast("int"))


def select_documents(docs: DataFrame, group: str, key: str, year: str, text: str = "text", order: str | None = None, least: int = 50, most: int = 20) -> DataFrame:
    """Documents of `least` characters or more; of those of a group with one text, or where texts are
    empty one key, the first by `order` (default key); ranked by year (unknown last), length, key, the
    best `most` (W01). Copies collapse with partial aggregation, so a hot group of copies is one row."""
    rows = rows_of(docs, text).where(F.col("len_norm") >= least).withColumn("_same", F.when(F.col("len_norm") > 0, F.col("sha1_norm")).otherwise(F.col(key).cast("string")))
    rest = [c for c in rows.columns if c not in (group, "_same")]
    one = rows.groupBy(group, "_same").agg(F.min_by(F.struct(*rest), F.struct(order or key, key)).alias("d")).select(group, "d.*")
    return top_k(one, [group], [F.desc_nulls_last(F.when(F.col(year) >= 0, F.col(year))), F.desc("len_norm"), F.col(key)], most)


def evidence_reason(key, title, abstract, least: int = 8) -> Column:
    """Why a row of an evidence pool is left out, null if it stays."""
    body = F.trim(F.concat_ws("\n", F.nullif(T.compact(title), F.lit("")), F.nullif(T.compact(abstract), F.lit(""))))
    return F.when(F.coalesce(F.trim(T.col(key).cast("string")), F.lit("")) == "", "no_id").when(T.compact(abstract) == "", "no_abstract").when(F.length(body) < least, "short_text")


def counted(rows: DataFrame, reason: str, group: list[str] | None = None) -> DataFrame:
    """Rows by reason, `kept` for none."""
    return rows.groupBy(*(group or []), F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count("*").alias("n"))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def spread(pairs: DataFrame, left: str, via: DataFrame, key: str, right: str) -> DataFrame:
    """left → right through a shared key, distinct."""
    return pairs.join(via, key).select(left, right).distinct()


def with_name(rows: DataFrame, key: str, names: DataFrame, id_col: str, name_col: str, out: str) -> DataFrame:
    """Left join to names, falling back to the key itself."""
    n = names.select(F.col(id_col).alias("_k"), F.col(name_col).alias("_n"))
    return rows.join(n, rows[key] == n["_k"], "left").withColumn(out, F.coalesce("_n", F.col(key).cast("string"))).drop("_k", "_n")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the finished work."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def jobs(ids: DataFrame, key: str, links: DataFrame, docs: DataFrame, doc_key: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, failures): ids with a linked document that exists, and why the others have none."""
    x = ids.join(links.select(key, doc_key), key, "left").join(docs.withColumn("_have", F.lit(True)), doc_key, "left")
    why = F.when(F.col(doc_key).isNull(), "no_link").when(F.col("_have").isNull(), "no_document")
    x = x.withColumn("error", why).drop("_have")
    return x.where("error is null").drop("error"), x.where("error is not null").select(key, doc_key, "error")


def resume_key(source, term, doc, pmid, pmcid, chunk) -> Column:
    """Key of finished work: source, term, document, chunk; rows written before there was a source count
    as pmc, and a missing document is the pmid or pmcid; null if a part is missing (J15)."""
    text = lambda c: F.nullif(F.trim(T.col(c).cast("string")), F.lit(""))
    s = F.coalesce(text(source), F.lit("pmc"))
    d = F.coalesce(text(doc), F.when(s == "pubmed", text(pmid)).otherwise(text(pmcid)))
    return F.when(d.isNotNull() & text(term).isNotNull() & text(chunk).isNotNull(), F.concat_ws("\t", s, text(term), d, text(chunk)))


def covered_ids(ids: DataFrame, key: str, pubmed: DataFrame, pmc: DataFrame, mode: str = "either") -> DataFrame:
    """ids with a document of the kind asked for: pubmed, pmc or either."""
    some = {"pubmed": pubmed.select(key), "pmc": pmc.select(key), "either": pubmed.select(key).unionByName(pmc.select(key))}[mode]
    return ids.join(some.distinct(), key, "left_semi")


def chunk_jobs(ids: DataFrame, key: str, links: DataFrame, doc_key: str, candidates: DataFrame, chunk: str, per_id: int, per_doc: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(jobs, failures): of each id per_id linked documents, of each of these per_doc candidates, chosen by
    hash; failures are ids without a document, documents without a candidate, and candidates without a chunk key (J10)."""
    from .sampling import k_of_n

    some = k_of_n(links.select(key, doc_key).distinct(), [key], [doc_key], per_id, seed).select(key, doc_key)
    none = ids.select(key).join(some, key, "left_anti").select(key, F.lit(None).cast(dict(some.dtypes)[doc_key]).alias(doc_key), F.lit("no_document").alias("error"))
    chosen = ids.select(key).join(some, key)
    cand = candidates.select(doc_key, chunk, F.xxhash64(F.coalesce(F.col(chunk).cast("string"), F.lit(""))).alias("_h"))
    cand = k_of_n(cand, [doc_key], ["_h", chunk], per_doc, seed).select(doc_key, chunk)
    met = chosen.join(cand.withColumn("_have", F.lit(True)), doc_key, "left")
    why = F.when(F.col("_have").isNull(), "no_candidate").when(F.coalesce(F.trim(F.col(chunk).cast("string")), F.lit("")) == "", "bad_candidate")
    met = met.withColumn("error", why).drop("_have")
    return met.where("error is null").drop("error"), met.where("error is not null").select(key, doc_key, "error").unionByName(none)


def with_fallback(docs: DataFrame, doc_key: str, links: DataFrame, id_col: str, seed: str) -> DataFrame:
    """One row per document and linked id, or with the document's seed where it has no link."""
    x = docs.join(links.select(doc_key, id_col).distinct(), doc_key, "left")
    return x.withColumn(id_col, F.coalesce(id_col, seed)).where(F.col(id_col).isNotNull())


def grouped_queries(rows: DataFrame, query: str, seed: str, kind: str) -> DataFrame:
    """Each query once with its distinct seeds and kinds in order."""
    return rows.groupBy(query).agg(F.array_sort(F.collect_set(seed)).alias("seeds"), F.array_sort(F.collect_set(kind)).alias("kinds"), F.count("*").alias("n"))


def seed_stats(rows: DataFrame, seed: str, repaired: str, hits: str) -> DataFrame:
    """Per seed: records, repaired ones and their share, and hits that are zero, positive, unknown."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    out = rows.groupBy(seed).agg(F.count("*").alias("n"), n(F.col(repaired)).alias("n_repaired"), n(F.col(hits) == 0).alias("hits_zero"), n(F.col(hits) > 0).alias("hits_some"), n(F.col(hits).isNull()).alias("hits_null"))
    return out.withColumn("repair_rate", F.col("n_repaired") / F.col("n"))


def aligned(ids: DataFrame, key: str, pool: DataFrame) -> DataFrame:
    """ids with how many rows the pool has for each, and whether any: n, mask."""
    n = pool.groupBy(key).agg(F.count("*").alias("n"))
    return ids.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().cast("int").alias("mask"))


def lines_by_id(rows: DataFrame, key: str, source: str, position: str, most: int = 50) -> DataFrame:
    """rows: key, source (struct lines, source), position → the first `most` lines of each id in order."""
    each = rows.select(key, position, F.posexplode(F.col(source)["lines"]).alias("i", "line")).where(F.length("line") >= 3)
    best = top_k(each, [key], [F.col(position), F.col("i")], most)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))


def quantiles(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """n, min, max, mean and exact interpolated p50, p90, p95, p99."""
    p = F.percentile(value, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    out = rows.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), p.alias("p"))
    return out.select(*(group or []), "n", "lo", "hi", "mean", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99"))])


def hit_sentences(docs: DataFrame, key: str, text: str, phrases: str, most: int = 5) -> DataFrame:
    """Best sentences that hold a phrase, ranked by score, else the first two."""
    ph = F.filter(F.transform(phrases, lambda p: T.matchable(p)), lambda p: p != "")
    rows = docs.select(key, T.sentences(text).alias("s"), ph.alias("ph"))
    # each different sentence is normalised and matched once
    held = F.transform(F.array_distinct("s"), lambda s, i: F.struct(i.alias("i"), s.alias("s"), T.let(T.matchable(s), lambda m: F.size(F.filter("ph", lambda p: F.contains(m, p)))).alias("n")))
    rows = rows.select(key, "s", F.filter(held, lambda x: x["n"] > 0).alias("hit"))
    scored = F.array_sort(F.transform("hit", lambda x: F.struct(F.round(-T.sentence_score(x["s"], x["n"]), 9).alias("a"), x["i"].alias("i"), x["s"].alias("s"))))
    best = F.slice(F.transform(scored, lambda x: x["s"]), 1, most)
    return rows.select(key, F.when(F.size("hit") > 0, best).otherwise(F.slice("s", 1, 2)).alias("sentences"))


def missing_scales(rows: DataFrame, scales: list[str]) -> DataFrame:
    """Number of rows with each list empty."""
    return rows.agg(*[F.sum((F.coalesce(F.size(c), F.lit(0)) <= 0).cast("long")).alias(f"missing_{c}") for c in scales])


def anchored(lines, context) -> Column:
    """Lines whose phrase, or its singular, stands in the context."""
    ctx = T.matchable(context)
    return F.filter(T.col(lines), lambda x: (T.matchable(x) != "") & (F.contains(ctx, T.matchable(x)) | F.contains(ctx, F.regexp_replace(T.matchable(x), "s$", ""))))


def is_none(lines, token: str = "NONE") -> Column:
    return (F.size(T.col(lines)) == 1) & (F.upper(F.element_at(T.col(lines), 1)) == token)


def evidence_text(sets: DataFrame, key: str, members: str, docs: DataFrame, member: str, text: str, order: str, per_member: int = 2, cap: int = 4000) -> DataFrame:
    """For each set the texts of its members' best documents, in member order, capped."""
    m = sets.select(key, F.posexplode(members).alias("pos", member))
    best = top_k(docs.select(member, text, order), [member], [F.col(order)], per_member, "_r")
    rows = m.join(best, member, "left").where(F.col(text).isNotNull())
    each = F.array_sort(F.collect_list(F.struct("pos", "_r", F.col(text).alias("t"))))
    out = rows.groupBy(key).agg(F.substring(F.array_join(F.transform(each, lambda x: x["t"]), "\n"), 1, cap).alias("evidence"))
    return sets.select(key).join(out, key, "left").select(key, F.coalesce("evidence", F.lit("")).alias("evidence"))


def set_context(sets: DataFrame, key: str, members: str, names: DataFrame, evidence: DataFrame, chunks: DataFrame, seed: int, cap: int = 1400) -> DataFrame:
    """Context of each set (J23): its members with their names, the evidence (key, evidence) and one
    example chunk, drawn by a hash of the members; capped. names: id, name; chunks: number (0, 1, ...), text."""
    m = sets.select(key, F.posexplode(members).alias("pos", "id")).join(names, "id", "left")
    listed = m.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" | ", F.concat(F.lit("- "), F.col("id").cast("string")), "name").alias("t")))).alias("l"))
    size = chunks.count()
    at = F.floor(T.uniform(seed, T.signature(F.transform(members, lambda x: x.cast("string")))) * size).cast("long")
    x = sets.select(key, at.alias("number")).join(listed, key).join(evidence, key, "left").join(chunks.select("number", F.col("text").alias("example")), "number", "left")
    parts = F.concat_ws("\n", F.lit("SET:"), F.array_join(F.transform("l", lambda e: e["t"]), "\n"), F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit("EVIDENCE:\n"), "evidence")), F.concat(F.lit("EXAMPLE:\n"), "example"))
    return x.select(key, T.capped(parts, cap, "\n[TRUNCATED]").alias("context"))
