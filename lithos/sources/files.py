"""JSON Lines, ontology and plain readers."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

TERM = "map<string,string>"


def jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """strict: a malformed line fails the query. Otherwise malformed lines (a torn last one)
    are dropped and a missing file is an empty table."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    try:
        return reader.json(path)
    except AnalysisException as e:
        if strict or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def head(rows: DataFrame, n: int) -> DataFrame:
    return rows.limit(n)


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """An ontology file, an object of terms by id or a list of terms, as (id, term: field → JSON text)."""
    raw = spark.read.text(path, wholetext=True)
    by_id = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "t"))
    listed = raw.select(F.explode(F.from_json("value", "array<string>")).alias("t")).select(F.lit(None).cast("string").alias("key"), "t")
    parsed = F.from_json("t", TERM)
    rows = by_id.where(F.col("t").startswith("{")).unionByName(listed.where(F.col("t").startswith("{"))).select("key", parsed.alias("term"))
    return rows.select(F.coalesce(T.first_text(F.col("term")["Id"], F.col("term")["id"], F.col("term")["hpo_id"]), "key").alias("id"), "term").where("id is not null")


def field(*names: str):
    """All values of the first present field, scalar or list."""
    return T.clean_list(T.scalar_or_list(F.coalesce(*[F.col("term")[n] for n in names])))


def terms(onto: DataFrame, root: str | None = None, prefix: str | None = None, max_synonyms: int = 8, max_parents: int = 80) -> DataFrame:
    """id, name, synonyms, definition, llm_def, llm_add_def, comment, parents."""
    father = F.map_keys(F.from_json(F.coalesce(F.col("term")["Father"], F.lit("{}")), "map<string,string>"))
    parents = F.when(F.size(father) > 0, father).otherwise(field("Is_a", "is_a"))
    out = onto.select(
        "id", F.element_at(F.concat(field("Name", "name", "label"), F.array(F.lit(None).cast("string"))), 1).alias("name"),
        F.slice(field("Synonym", "synonyms"), 1, max_synonyms).alias("synonyms"),
        F.element_at(F.concat(field("Def", "definition"), F.array(F.lit(""))), 1).alias("definition"), F.coalesce(F.col("term")["llm_def"], F.lit("")).alias("llm_def"), F.coalesce(F.col("term")["llm_add_def"], F.lit("")).alias("llm_add_def"),
        field("Comment", "comment").alias("comment"), F.slice(F.transform(parents, T.term_id), 1, max_parents).alias("parents"),
    )
    if prefix:
        out = out.where(F.col("id").startswith(prefix))
    return out.where(F.col("id") != root) if root else out


def definition_text(min_len: int = 60):
    """Curated definition if long enough, else generated, added, name, [EMPTY] (P10): struct(text, source)."""
    pick = lambda c, s: F.struct(T.compact(c).alias("text"), F.lit(s).alias("source"))
    return (
        F.when(F.length(T.compact("definition")) >= min_len, pick("definition", "def")).when(T.compact("llm_def") != "", pick("llm_def", "llm_def")).when(T.compact("llm_add_def") != "", pick("llm_add_def", "llm_add_def"))
        .when(T.compact("name") != "", pick("name", "name")).otherwise(F.struct(F.lit("[EMPTY]").alias("text"), F.lit("empty").alias("source")))
    )


def compact_definition(max_len: int = 900):
    """Definitions, comments and synonyms in one text."""
    d = T.compact("definition")
    parts = F.concat_ws(" ", F.nullif(T.compact("llm_def"), F.lit("")), F.when((d != "") & ~F.contains(T.compact("llm_def"), d), d), F.nullif(T.compact("llm_add_def"), F.lit("")), F.array_join(F.slice("comment", 1, 2), " "), F.when(F.size("synonyms") > 0, F.concat(F.lit("Synonyms: "), F.array_join(F.slice("synonyms", 1, 4), "; "))))
    return T.capped(parts, max_len, " ...")


def edges(rows: DataFrame) -> DataFrame:
    """(child, parent) of terms."""
    return rows.select(F.col("id").alias("child"), F.explode("parents").alias("parent")).distinct()


def last_wins(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's last row."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def read_text(path: str) -> str:
    """A prompt or other small text; an empty file is an error."""
    out = Path(path).read_text(encoding="utf-8").strip()
    if not out:
        raise ValueError(f"empty: {path}")
    return out


def require_all(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows of the listed ids; a listed id without a row is an error when the plan runs."""
    joined = ids.select(key).distinct().join(rows.withColumn("_there", F.lit(True)), key, "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return joined.where(ok).drop("_there")


def first_seen(rows: DataFrame, key: str, position: list[str]) -> DataFrame:
    """Distinct non-empty values of key with the place they are first met at, in that order."""
    x = rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return x.groupBy(key).agg(F.min(F.struct(*position)).alias("first")).orderBy("first")


def phrase_table(rows: DataFrame, key: str, scales: list[str]) -> DataFrame:
    """Lower-case compact phrases of each scale, empty ones left out."""
    return rows.select(key, *[F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: T.phrase(x)), lambda x: x != "").alias(c) for c in scales])


def neighbour_table(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, neighbour, sim, rank from a JSON list of {id, sim}."""
    each = F.posexplode(F.from_json(json, "array<struct<id:string,sim:double>>")).alias("p", "n")
    return rows.select(key, each).select(key, F.col("n.id").alias("neighbour"), F.col("n.sim").alias("sim"), (F.col("p") + 1).alias("rank"))


def cached_texts(spark: SparkSession, folder: str, suffix: str = ".xml") -> DataFrame:
    """(id, text) of a folder of files named by id, ids normalised and distinct."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    raw = spark.read.option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    return raw.select(T.pmcid(name).alias("id"), F.col("value").alias("text")).where("id is not null").groupBy("id").agg(F.min("text").alias("text"))


def id_list(json) -> Column:
    """Ids of a document that is a list, an object with ids or hpo_ids, or an object keyed by id."""
    j = T.col(json)
    listed = F.from_json(j, "array<string>")
    named = F.from_json(F.coalesce(F.get_json_object(j, "$.ids"), F.get_json_object(j, "$.hpo_ids")), "array<string>")
    keys = F.map_keys(F.from_json(j, "map<string,string>"))
    return F.when(F.ltrim(j).startswith("["), listed).otherwise(F.coalesce(named, keys))


def names(rows: DataFrame, id_col: str, name_col: str, prefix: str = "") -> DataFrame:
    """(id, name) of rows with both, the id with the given prefix."""
    x = rows.select(F.trim(id_col).alias("id"), T.compact(name_col).alias("name"))
    return x.where((F.col("id") != "") & (F.col("name") != "") & F.col("id").startswith(prefix))


def ranges(json) -> Column:
    """[s, e] or {"s": s, "e": e} as struct(s, e), null for anything else."""
    j = T.col(json)
    pair = F.from_json(j, "array<long>")
    both = F.when(F.size(pair) == 2, F.struct(pair[0].alias("s"), pair[1].alias("e")))
    s, e = F.get_json_object(j, "$.s").cast("long"), F.get_json_object(j, "$.e").cast("long")
    return F.coalesce(both, F.when(s.isNotNull() & e.isNotNull(), F.struct(s.alias("s"), e.alias("e"))))


def resolved(path: str) -> str:
    """path/out where that exists, else path."""
    return str(Path(path) / "out") if (Path(path) / "out").is_dir() else path
