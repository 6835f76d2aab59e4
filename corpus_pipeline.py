"""A training-text pipeline over `documents`: each stage works on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents. Null ids, null and empty texts and repeated rows go
through as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm import language, lines, pieces, simhash, tiling
from lithos.llm.common import cut, shared_dir, table
from lithos.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language is this uncertain is rejected; text in two languages stays well above.
LEAST_SCORE = 0.3
BROADCAST_IDS = 1_000_000


def with_key(docs: DataFrame) -> DataFrame:
    """docs with _key: the id and two hashes of the text. Rows alike in these are alike for every
    decision on a text alone; ids, null or repeated, don't tell rows apart."""
    t = F.coalesce("text", F.lit(""))
    return docs.withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("h2")))


def short(rows: DataFrame) -> DataFrame:
    """rows written first; only if they are known to be few are they broadcast, else both sides of a join are shuffled."""
    rows = cut(rows, "rows")
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs (see with_key) without the rows whose key is in keys (one column _key)."""
    gone = short(keys.select("_key.*").distinct().toDF("_id", "_h", "_h2"))
    same = F.col("_key.id").eqNullSafe(gone["_id"]) & (F.col("_key.h") == gone["_h"]) & (F.col("_key.h2") == gone["_h2"])
    return docs.join(gone, same, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language cannot be told, go."""
    docs = with_key(docs)
    found = language.identify(docs, key_col="_key").where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE))
    return without(docs, found)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all of them; documents stay, shortened."""
    index = lines.LineIndex(spark, threshold=10, least=1)
    index.insert(docs)
    return lines.rewrite(docs, index).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, of the smallest id (null first). Rows are
    numbered, and written with their numbers so that these stay the same."""
    rows = cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = cut(simhash.near_duplicates(rows, id_col="_row").where("n_near > 0").select("_row", "component_id"), "groups")
    stay = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("first._row")
    return rows.join(short(groups.join(stay, "_row", "left_anti").select("_row")), "_row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    docs = with_key(docs)
    return without(docs, tiling.contaminated(docs, table(spark, sf_dir, "benchmark"), id_col="_key"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with the digests that show what they encode and decode to."""
    return pieces.encode_decode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
