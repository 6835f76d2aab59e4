"""Writers (K01-K19). Spark's commit protocol makes each one atomic as a whole."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """One folder per key; only the folders of keys in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_json(value: object, path: str) -> None:
    """A small document, replaced atomically."""
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    os.replace(part, target)


def id_index(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key → sorted distinct values, keys without any left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def unit_line(meta: bool = False) -> Column:
    """Tab-separated line of a supported unit, null otherwise."""
    canonical, support = F.substring(T.compact("canonical_phrase"), 1, 120), F.substring(T.compact("support_sentence"), 1, 420)
    parts = [F.col("hpo_id"), T.compact("hpo_name"), F.col("pmid").cast("string"), canonical, support]
    if meta:
        approx = T.approx_flag("hpo_name", canonical, support)
        parts += [F.concat(F.lit("conf="), F.coalesce(F.col("confidence").cast("string"), F.lit(""))), F.concat(F.lit("approx="), approx.cast("string")), F.concat(F.lit("note="), T.compact("note"))]
    good = (F.lower(T.compact("verdict")) == "support") & (canonical != "") & (support != "")
    return F.when(good, F.concat_ws("\t", *parts))


def failures(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, dead letters)."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A report table of a small result."""
    cells = [[("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r] for r in rows.limit(most).collect()]
    lines = ["| " + " | ".join(x) + " |" for x in [rows.columns, ["---"] * len(rows.columns), *cells]]
    return "\n".join([f"## {title}", "", *lines, ""])


def finished(done: str, keys: DataFrame) -> None:
    """Adds keys to the table of finished work (K10); readers anti-join it (evidence.remaining)."""
    keys.write.mode("append").parquet(done)


def snapshot(folder: str, tables: dict[str, DataFrame], meta: dict) -> None:
    """Tables as Parquet under folder and what they are in meta.json, with their row counts."""
    counts = {}
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts[name] = rows.sparkSession.read.parquet(f"{folder}/{name}").count()
    write_json(meta | {"rows": counts}, f"{folder}/meta.json")


def clusters(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(hpo_id, name, cluster) lines of a clustering, names missing as empty."""
    return labels.join(names, "id", "left").select(F.to_json(F.struct(F.col("id").alias("hpo_id"), F.coalesce("name", F.lit("")).alias("name"), "cluster")).alias("line"))


def manifest(rows: DataFrame, stamp: str, **config) -> dict:
    """Run configuration with the number of rows written and the time given."""
    return {"at": stamp, "config": config, "columns": rows.columns, "rows": rows.count()}
