"""The registered queries of the corpus operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licenses, lines, pieces, quality, simhash, substring, suffix_levels, tiling, token_count
from .common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), radius=4)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=1024)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(documents(spark, sf_dir), window=13)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.drop_repeated_bytes(documents(spark, sf_dir), window=200, batches=4)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_common_lines(documents(spark, sf_dir), threshold=10, least=1)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_tiles", "n_covered", "n_item_words", F.round("coverage", 6).alias("coverage"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash_near_dedup, op3_token_counts, op4_substring_dedup, op5_suffix_array_dedup, op6_line_dedup, op7_sentencepiece, op8_language_id, op9_license_scan, op10_decontamination)}

WORDS = r"'[^ \t\n\x0b\x0c\r]+'"
ORACLES = {
    "op4_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
r AS (SELECT g.doc_id, list(g.i) AS hits FROM g JOIN m USING (s) WHERE g.doc_id > m.low GROUP BY g.doc_id),
x AS (SELECT d.doc_id, d.w, list_distinct(flatten(list_transform(coalesce(r.hits, []), lambda i: generate_series(i, i + 12)))) AS gone FROM d LEFT JOIN r USING (doc_id)),
k AS (SELECT doc_id, w, len(gone) AS n_removed, list_has_any([1], [1]) AS ok, gone FROM x),
u AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, gone, unnest(generate_series(1, len(w))) AS i FROM k) WHERE NOT list_contains(gone, i)),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, k.n_removed::BIGINT AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
}
