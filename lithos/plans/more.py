"""Further registered queries: readers, projections, joins, counters, generation and query sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import blocks, evidence, extraction, gating, graph, models, sampling
from ..sources import files, markup, remote, sinks
from .queries import DOT, KNN, U, embeddings, read, register


def folder(spark, name: str) -> str:
    return f"{graph.shared(spark)}/{name}-{uuid.uuid4().hex}"


def words(c) -> F.Column:
    return F.split(c, " ")


@register("SELECT p_partkey, p_name, p_size, 2 AS copies FROM part")
def jsonl_roundtrip(spark, sf_dir):
    """Written as JSON Lines, appended to, read strictly."""
    p, path = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), folder(spark, "jsonl")
    sinks.write_jsonl(p, path)
    sinks.write_jsonl(p, path, append=True)
    return files.jsonl(spark, path, "p_partkey long, p_name string, p_size int").groupBy("p_partkey", "p_name", "p_size").agg(F.count("*").alias("copies"))


@register("SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 > 0")
def tolerant_jsonl(spark, sf_dir):
    """Torn lines are skipped."""
    whole = F.to_json(F.struct("p_partkey", "p_name"))
    path = folder(spark, "torn")
    read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 > 0, whole).otherwise(F.concat(F.lit('{"p_partkey": '), F.col("p_partkey")))).write.text(path)
    return files.jsonl(spark, path, "p_partkey long, p_name string", strict=False)


@register("""SELECT 'HP:' || lpad((n_nationkey + 2)::VARCHAR, 7, '0') AS id, n_name AS name, n_name || ' x,' || n_name || ' y' AS synonyms, 'HP:' || lpad((n_regionkey + 2)::VARCHAR, 7, '0') || CASE WHEN n_nationkey % 2 = 0 THEN ',HP:0000001' ELSE '' END AS parents FROM nation""")
def ontology_terms(spark, sf_dir):
    """An ontology file of terms by id, read without its root."""
    n = read(spark, sf_dir, "nation")
    hp = lambda c: F.concat(F.lit("HP:"), F.lpad((F.col(c) + 2).cast("string"), 7, "0"))
    up = F.when(F.col("n_nationkey") % 2 == 0, F.array(hp("n_regionkey"), F.lit("HP:0000001"))).otherwise(F.array(F.regexp_replace(hp("n_regionkey"), ":", "_")))
    term = F.struct(hp("n_nationkey").alias("Id"), F.array("n_name").alias("Name"), F.array(F.concat("n_name", F.lit(" x")), F.concat("n_name", F.lit("  y")), F.concat("n_name", F.lit(" x"))).alias("Synonym"), F.map_from_arrays(up, F.transform(up, lambda x: F.lit(1))).alias("Father"))
    each = n.select(hp("n_nationkey").alias("k"), F.to_json(term).alias("v"))
    body = each.agg(F.concat_ws(",", F.lit('"HP:0000001":{"Id":"HP:0000001","Name":"All"},"x":3'), F.collect_list(F.concat(F.lit('"'), "k", F.lit('":'), "v"))).alias("b"))  # one file holds an ontology
    path = folder(spark, "ontology")
    body.select(F.concat(F.lit("{"), "b", F.lit("}"))).coalesce(1).write.text(path)
    t = files.terms(files.ontology(spark, path), root="HP:0000001", prefix="HP:")
    return t.select("id", "name", F.array_join("synonyms", ",").alias("synonyms"), F.array_join("parents", ",").alias("parents"))


@register("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS last_status FROM orders GROUP BY 1")
def last_values(spark, sf_dir):
    """The last row of each key wins."""
    return files.last_wins(read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), "o_custkey", "o_orderstatus", "o_orderkey").withColumnRenamed("o_orderstatus", "last_status")


@register("SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY 1")
def first_seen_seeds(spark, sf_dir):
    """Distinct seeds in the order met."""
    rows = files.first_seen(read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")), "l_suppkey", ["at"])
    return rows.select("l_suppkey", F.col("first.at").alias("first_at"))


@register("SELECT p_partkey, lower(p_name) || ';' || lower(p_brand) AS scale1, lower(p_type) AS scale2, '' AS scale3 FROM part")
def phrase_table(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", F.array(F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_brand").alias("scale1"), F.array("p_type").alias("scale2"), F.lit(None).cast("array<string>").alias("scale3"))
    t = files.phrase_table(rows, "p_partkey", ["scale1", "scale2", "scale3"])
    return t.select("p_partkey", *[F.array_join(c, ";").alias(c) for c in ("scale1", "scale2", "scale3")])


@register("SELECT p_partkey, v.r AS rank, 'n' || (p_partkey + v.r) AS neighbour, v.r / 4.0 AS sim FROM part, (VALUES (1), (2)) v(r)")
def neighbour_table(spark, sf_dir):
    one = lambda r: F.concat(F.lit('{"id":"n'), F.col("p_partkey") + r, F.lit(f'","sim":{r / 4}}}'))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]")).alias("j"))
    return files.neighbour_table(rows, "p_partkey", "j").select("p_partkey", "rank", "neighbour", "sim")


@register("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def encounter_docs(spark, sf_dir):
    """First rows of each id as they come."""
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return evidence.top_k(rows, ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 3)


REASON = "CASE WHEN doc_id % 11 = 0 THEN 'no_id' WHEN length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g'))) = 0 THEN 'no_abstract' WHEN length(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g'))) < 8 THEN 'short_text' ELSE 'kept' END"


@register(f"SELECT source, reason, count(*) AS n FROM (SELECT source, {REASON} AS reason FROM documents) GROUP BY 1, 2")
def evidence_reasons(spark, sf_dir):
    """Rows of a pool by the reason they are dropped for."""
    d = read(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 11 > 0, F.col("doc_id")).alias("id"), "text")
    return evidence.counted(d.select("source", evidence.evidence_reason("id", F.lit(""), "text").alias("reason")), "reason", ["source"])


@register("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 200")
def head_rows(spark, sf_dir):
    """The first rows in order."""
    return files.head(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), 200)


@register("SELECT s_suppkey, 'a' || s_suppkey || ',b' || s_suppkey AS ids FROM supplier")
def id_lists(spark, sf_dir):
    """Ids from a list, an object with ids or hpo_ids, or an object by id."""
    k = F.col("s_suppkey")
    both = F.concat(F.lit('["a'), k, F.lit('", "b'), k, F.lit('"]'))
    j = F.when(k % 4 == 0, both).when(k % 4 == 1, F.concat(F.lit('{"ids": '), both, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit('{"hpo_ids": '), both, F.lit("}"))).otherwise(F.concat(F.lit('{"a'), k, F.lit('": 1, "b'), k, F.lit('": {"x": 2}}')))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(files.id_list(j), ",").alias("ids"))


@register("SELECT '{\"hpo_id\":\"' || c_custkey || '\",\"name\":\"' || CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END || '\",\"cluster\":' || c_nationkey || '}' AS line FROM customer")
def cluster_lines(spark, sf_dir):
    """Cluster lines with names."""
    c = read(spark, sf_dir, "customer")
    named = files.names(c.select(F.col("c_custkey").cast("string").alias("i"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("n")), "i", "n")
    return sinks.clusters(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("cluster")), named)


@register("SELECT c_nationkey AS cluster, count(*) AS n FROM customer GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    """A10."""
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("n"))


@register("""WITH r AS (SELECT label AS k, min(vec_id) AS s, min(vec_id) + 6 AS e FROM embeddings WHERE label % 3 > 0 GROUP BY 1), l AS (SELECT k, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM r JOIN embeddings ON vec_id >= s AND vec_id < least(e, (SELECT count(*) FROM embeddings))),
m AS (SELECT k, pos, avg(x) AS m FROM l GROUP BY 1, 2), mu AS (SELECT k, pos, m / (sqrt(sum(m * m) OVER (PARTITION BY k)) + 1e-12) AS m FROM m), s AS (SELECT k, vec_id, round(sum(x * m), 12) AS s FROM l JOIN mu USING (k, pos) GROUP BY 1, 2),
t AS (SELECT k, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 3), q AS (SELECT k, pos, avg(x) AS m, count(*) AS n FROM l SEMI JOIN t USING (k, vec_id) GROUP BY 1, 2)
SELECT k, n, round(max(abs(v)), 5) AS top, round(sum(v), 5) AS total FROM (SELECT k, n, m / (sqrt(sum(m * m) OVER (PARTITION BY k)) + 1e-12) AS v FROM q) GROUP BY 1, 2""")
def range_prototypes(spark, sf_dir):
    """Prototypes of the pool rows in each id's range."""
    e = embeddings(spark, sf_dir)
    size = e.count()
    ids = e.groupBy(F.col("label").alias("k")).agg(F.min("id").alias("s"))
    text = F.when(F.col("k") % 2 == 0, F.concat(F.lit("["), "s", F.lit(", "), F.least(F.col("s") + 6, F.lit(size)), F.lit("]"))).otherwise(F.concat(F.lit('{"s": '), "s", F.lit(', "e": '), F.least(F.col("s") + 6, F.lit(size)), F.lit("}")))
    ranges = ids.select("k", files.ranges(text).alias("r"))
    out = graph.range_pool(ids.select("k", F.when(F.col("k") % 3 > 0, 1).otherwise(0).alias("mask")), "k", "mask", ranges, e.select(F.col("id").alias("row"), "vec"), 3)
    return out.select("k", "n", F.round(F.array_max(F.transform("vec", lambda x: F.abs(x))), 5).alias("top"), F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@register("SELECT c_custkey, coalesce(n, 0) AS n, (n IS NOT NULL)::INT AS mask FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def aligned_pool(spark, sf_dir):
    """J13."""
    return evidence.aligned(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@register("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'pubmed' ELSE 'pmc' END || chr(9) || o_custkey || chr(9) || CASE WHEN o_orderkey % 2 = 0 THEN 'd' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'm' || o_orderkey ELSE 'c' || o_orderkey END || chr(9) || o_orderpriority AS key FROM orders WHERE o_orderstatus <> 'P'""")
def resume_keys(spark, sf_dir):
    """Composite keys with the defaults of older rows."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda p: F.concat(F.lit(p), k)
    key = evidence.resume_key(F.when(k % 3 == 0, "pubmed").when(k % 3 == 1, "pmc"), "o_custkey", F.when(k % 2 == 0, text("d")), text("m"), text("c"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return o.select(key.alias("key")).where("key is not null")


@register("SELECT mode, count(*) AS n FROM (SELECT 'pubmed' AS mode, c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey UNION ALL SELECT 'pmc', c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') ON o_custkey = c_custkey UNION ALL SELECT 'either', c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O')) ON o_custkey = c_custkey) GROUP BY 1")
def covered_ids(spark, sf_dir):
    """F15."""
    c, o = read(spark, sf_dir, "customer").select("c_custkey"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    f, p = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")
    each = [evidence.covered_ids(c, "c_custkey", f, p, m).agg(F.lit(m).alias("mode"), F.count("*").alias("n")) for m in ("pubmed", "pmc", "either")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("mode", "n").where("n > 0")


@register(f"""WITH c AS (SELECT o_custkey AS k, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY {U.format("concat_ws('|', '3', o_custkey, o_orderkey)")}, o_orderkey) AS r FROM orders), p AS (SELECT k, d FROM c WHERE r <= 2), l AS (SELECT l_orderkey, min(l_linenumber) AS lo, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT c_custkey AS k, error, count(*) AS n FROM (SELECT c_custkey, CASE WHEN d IS NULL THEN 'no_document' WHEN n IS NULL THEN 'no_candidate' WHEN d % 4 = 0 THEN 'bad_candidate' ELSE 'job' END AS error, least(coalesce(n, 1), 2) AS m FROM customer LEFT JOIN p ON k = c_custkey LEFT JOIN l ON l_orderkey = d), range(2) x(i) WHERE i < m GROUP BY 1, 2""")
def chunk_jobs(spark, sf_dir):
    """Jobs and the three kinds of failure."""
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("d"))
    cand = read(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("d"), F.when(F.col("l_orderkey") % 4 > 0, F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("chunk"))
    good, bad = evidence.chunk_jobs(ids, "k", links, "d", cand, "chunk", 2, 2, 3)
    return good.select("k", F.lit("job").alias("error")).unionByName(bad.select("k", "error")).groupBy("k", "error").agg(F.count("*").alias("n"))


@register("SELECT o_orderkey, coalesce(l_suppkey, o_custkey) AS id FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey % 4 = 0) ON l_orderkey = o_orderkey")
def seed_fallback(spark, sf_dir):
    """J08."""
    links = read(spark, sf_dir, "lineitem").where("l_suppkey % 4 = 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("id"))
    return evidence.with_fallback(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", links, "id", "o_custkey").select("o_orderkey", "id")


@register("SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def spread_links(spark, sf_dir):
    """Ids joined through a shared key."""
    return evidence.spread(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey", "l_suppkey")


KEYS = ["output_lines", "B2.units", "from_b1.lines", "unit_lines", "NOT_FOUND"]


@register("""WITH x AS (SELECT p_size AS k, p_partkey, p_partkey % 5 AS m, unnest(CASE WHEN p_partkey % 5 = 4 THEN [] WHEN p_partkey % 5 = 1 THEN [p_name] ELSE [p_name, p_type] END) AS line, generate_subscripts(CASE WHEN p_partkey % 5 = 4 THEN [] WHEN p_partkey % 5 = 1 THEN [p_name] ELSE [p_name, p_type] END, 1) AS i FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey, i) AS r FROM x) SELECT k, count(*) AS n, sha1(string_agg(line, '|' ORDER BY r)) AS digest FROM r WHERE r <= 50 GROUP BY 1""")
def line_sources(spark, sf_dir):
    """Lines under whichever key holds them, gathered by id."""
    k = F.col("p_partkey") % 5
    two = F.concat(F.lit('["'), "p_name", F.lit('", " ", "'), "p_type", F.lit('"]'))
    j = F.when(k == 0, F.concat(F.lit('{"output_lines": '), two, F.lit("}"))).when(k == 1, F.concat(F.lit('{"B2": {"units": "'), "p_name", F.lit('"}}'))).when(k == 2, F.concat(F.lit('{"from_b1": {"lines": '), two, F.lit("}}"))).when(k == 3, F.concat(F.lit('{"unit_lines": '), two, F.lit("}"))).otherwise(F.lit('{"other": ["x"]}'))
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("k"), "p_partkey", blocks.line_source(j).alias("s"))
    return evidence.lines_by_id(rows, "k", "s", "p_partkey").select("k", F.size("lines").cast("long").alias("n"), F.sha1(F.array_join("lines", "|")).alias("digest"))


@register("SELECT CASE p_partkey % 5 WHEN 0 THEN 'output_lines' WHEN 1 THEN 'B2.units' WHEN 2 THEN 'from_b1.lines' WHEN 3 THEN 'unit_lines' ELSE 'NOT_FOUND' END AS source, count(*) AS n FROM part GROUP BY 1")
def line_source_counts(spark, sf_dir):
    """Which key held the lines."""
    key = F.element_at(F.array(*map(F.lit, KEYS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    j = F.when(key == "NOT_FOUND", F.lit("{}")).when(F.contains(key, F.lit(".")), F.concat(F.lit('{"'), F.split_part(key, F.lit("."), F.lit(1)), F.lit('": {"'), F.split_part(key, F.lit("."), F.lit(2)), F.lit('": []}}'))).otherwise(F.concat(F.lit('{"'), key, F.lit('": []}')))
    return read(spark, sf_dir, "part").select(blocks.line_source(j)["source"].alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@register("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '|' || p_type || '|' || p_brand WHEN p_size % 3 = 1 THEN p_brand || '|x' ELSE '' END AS lines, CASE WHEN p_size % 3 = 0 THEN 'canonical+support+from_b1.output_lines' WHEN p_size % 3 = 1 THEN 'evidence_lines' ELSE 'NOT_FOUND' END AS source FROM part""")
def unit_sources(spark, sf_dir):
    """P17."""
    m = F.col("p_size") % 3
    j = F.when(m == 0, F.to_json(F.struct(F.concat(F.lit(" "), "p_name").alias("canonical_phrase"), F.col("p_type").alias("support_sentence"), F.struct(F.array("p_brand").alias("output_lines")).alias("from_b1")))).when(m == 1, F.to_json(F.struct(F.array("p_brand", F.lit("x")).alias("evidence_lines")))).otherwise(F.lit('{"lines": []}'))
    s = blocks.unit_source(j)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(s["lines"], "|").alias("lines"), s["source"].alias("source"))


@register("SELECT p_partkey, p_name || ' ; ' || p_type || ' ; ' || p_brand || ' ; ' || p_brand || ' x' AS e3 FROM part WHERE p_partkey % 7 > 0")
def datapack_text(spark, sf_dir):
    """Terms with id and name and their phrases as one text."""
    none = F.array().cast("array<string>")
    p = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).otherwise("").alias("name"), F.array("p_type").alias("s2"), none.alias("s3"), F.array("p_brand", F.lit(" "), F.concat("p_brand", F.lit("  x"))).alias("s4"))
    return p.where("name <> ''").select("p_partkey", blocks.concatenated("name", [T.clean_list(c) for c in ("s2", "s3", "s4")]).alias("e3"))


@register("""SELECT p_partkey, left(trim(g), 700) || CASE WHEN length(g) > 700 THEN ' ...' ELSE '' END AS guidance, CASE WHEN p_size % 3 = 0 THEN p_type || '. note ' || p_brand ELSE p_name END AS text, CASE WHEN p_size % 3 = 0 THEN 'curated_def+comment' ELSE 'llm_def' END AS source,
left(p_name || '. ' || p_name, 320) AS short, left(d, 900) || CASE WHEN length(d) > 900 THEN ' ...' ELSE '' END AS compact
FROM (SELECT *, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END AS g, p_name || ' ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' ' || p_brand ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' note ' || p_brand ELSE '' END || ' Synonyms: ' || p_brand || '; ' || p_type AS d FROM part)""")
def definition_blocks(spark, sf_dir):
    """P08, P09, P11, P26, P30, P31."""
    add = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    note = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("note "), "p_brand"))
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", blocks.guidance("p_name", add).alias("guidance"), blocks.definition_with_comment("p_name", F.concat("p_type", F.lit(".")), note, "p_name", add).alias("t"), blocks.short_definition("p_name", F.lit("unused"), "p_name").alias("short"),
        F.col("p_type").alias("definition"), F.col("p_name").alias("llm_def"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("llm_add_def"), F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>")).alias("comment"), F.array("p_brand", "p_type").alias("synonyms"),
    )
    return rows.select("p_partkey", "guidance", "t.text", "t.source", "short", T.compact(files.compact_definition()).alias("compact"))


@register("SELECT n_nationkey, n_name || chr(10) || 'x' AS synonyms_block, '' AS def_block, n_name AS llm_add_def_block, r_name || chr(10) || 'root' AS ancestor_names_block FROM nation JOIN region ON r_regionkey = n_regionkey")
def term_blocks(spark, sf_dir):
    """P12, J01."""
    n = evidence.with_name(read(spark, sf_dir, "nation"), "n_regionkey", read(spark, sf_dir, "region"), "r_regionkey", "r_name", "up")
    return n.select("n_nationkey", blocks.term_blocks(F.array("n_name", F.lit("x")), F.lit(None).cast("string"), "n_name", F.array("up", F.lit("root"))).alias("b")).select("n_nationkey", "b.*")


@register("""SELECT p_partkey, 'TITLE: ' || p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'JOURNAL: ' || p_brand || ' | YEAR: ' || p_size ELSE 'YEAR: ' || p_size END || chr(10) || 'ABSTRACT:' || chr(10) || p_type AS abstract_block,
CASE WHEN p_size % 2 = 0 THEN 'SURFACE: ' || p_brand || chr(10) || 'UNIT: ms' || chr(10) || 'LABEL_OPTIONS: A, B' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || p_name ELSE p_name END AS candidate_block,
'PHENOTYPES:' || chr(10) || '- ID: a' || chr(10) || '  Name: ' || p_name || chr(10) || '- ID: b' || chr(10) || '  Name:' AS phenotype_block FROM part""")
def prompt_blocks(spark, sf_dir):
    """P24, P25, P27."""
    even = F.col("p_size") % 2 == 0
    none = F.lit(None).cast("string")
    members = F.array(F.struct(F.lit("a").alias("id"), F.col("p_name").alias("name")), F.struct(F.lit("b").alias("id"), none.alias("name")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", blocks.abstract_block("p_name", F.when(even, F.col("p_brand")), F.col("p_size").cast("string"), none, "p_type").alias("abstract_block"),
        blocks.candidate_block(F.when(even, F.col("p_brand")), F.when(even, F.lit("ms")), F.when(even, F.array(F.lit("A"), F.lit("B"))), F.concat(F.lit("  "), "p_name")).alias("candidate_block"), blocks.phenotype_block(members).alias("phenotype_block"),
    )


@register("""SELECT p_partkey, 'HPO_ID: ' || p_partkey || chr(10) || 'HPO_NAME: ' || p_name || chr(10) || 'DEFINITION: ' || p_name || '. ' || p_type || chr(10) || 'PHRASE_CANDIDATES:' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type || chr(10) || 'CANDIDATE_SENTENCES:' || chr(10) || '1) ' || p_name || chr(10) || chr(10) || 'Judge.' AS unit_prompt,
'Say' || chr(10) || chr(10) || 'INPUT:' || chr(10) || '[HPO_ID] ' || p_partkey || chr(10) || '[HPO_NAME] ' || p_name || chr(10) || chr(10) || '[CONTEXT]' || chr(10) || p_type || chr(10) || chr(10) || 'OUTPUT:' || chr(10) AS plain_prompt, 'Say ' || p_name AS slot_prompt,
'INPUT_META={"task":"b1","hpo_id":"' || p_partkey || '","hpo_name":"' || p_name || '","extra":{"n":"' || p_size || '"}}' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || p_type || chr(10) || chr(10) || 'rules' AS task_prompt, 'Instruct: find' || chr(10) || 'Query: ' || p_name AS instruction FROM part""")
def prompts(spark, sf_dir):
    """X18-X20, X22, U02, U25."""
    key = F.col("p_partkey").cast("string")
    fill = lambda t: blocks.prompt(t, {"NAME": "p_name"}, [("HPO_ID", key), ("HPO_NAME", "p_name"), ("CONTEXT", "p_type")])
    return read(spark, sf_dir, "part").select(
        "p_partkey", blocks.unit_prompt(key, "p_name", "p_type", F.lit(None).cast("string"), F.array("p_brand", F.lit(""), "p_type"), F.array("p_name"), "Judge.").alias("unit_prompt"), fill("Say").alias("plain_prompt"), fill("Say {{NAME}}").alias("slot_prompt"),
        blocks.task_prompt(F.lit("b1"), key, "p_name", "p_type", F.create_map(F.lit("n"), F.col("p_size").cast("string")), "rules").alias("task_prompt"), models.instruction("p_name", "find").alias("instruction"),
    )


@register("SELECT o_orderpriority || o_orderstatus AS query, count(DISTINCT o_custkey) AS n_seeds, min(o_custkey) AS first_seed, string_agg(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'seed0' ELSE 'neg' END, ',' ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN 'seed0' ELSE 'neg' END) AS kinds, count(*) AS n FROM orders GROUP BY 1")
def grouped_queries(spark, sf_dir):
    """A02."""
    o = read(spark, sf_dir, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("query"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "seed0").otherwise("neg").alias("kind"))
    return evidence.grouped_queries(o, "query", "o_custkey", "kind").select("query", F.size("seeds").cast("long").alias("n_seeds"), F.get("seeds", F.lit(0)).alias("first_seed"), F.array_join("kinds", ",").alias("kinds"), "n")


@register(f"""WITH n AS (SELECT n_regionkey AS parent, count(*) AS n FROM nation GROUP BY 1) SELECT parent, n FROM n""")
def child_counts(spark, sf_dir):
    """A06."""
    return graph.children(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")))


@register(f"""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT k, 0 AS w FROM c ORDER BY n DESC, k LIMIT 10), b AS (SELECT k, 1 AS w FROM c ORDER BY n, k DESC LIMIT 10), r AS (SELECT k, 2 AS w FROM c WHERE k NOT IN (SELECT k FROM t UNION ALL SELECT k FROM b) ORDER BY {U.format("concat_ws('|', '9', k)")}, k LIMIT 20),
e AS (SELECT k, min(w) AS w FROM (SELECT * FROM t UNION ALL SELECT * FROM b UNION ALL SELECT * FROM r) GROUP BY 1) SELECT k FROM e ORDER BY w, {U.format("concat_ws('|', '9', k)")}, k LIMIT 20""")
def inspection_sample(spark, sf_dir):
    """A27."""
    c = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return sampling.inspection(c, "k", "n", 20, 9)


@register("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_repaired, count(*) FILTER (h = 0) AS hits_zero, count(*) FILTER (h > 0) AS hits_some, count(*) FILTER (h IS NULL) AS hits_null, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS repair_rate FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN 0 ELSE event_id END AS h FROM events) GROUP BY 1")
def seed_stats(spark, sf_dir):
    """A15, A16, U27."""
    h = F.when(F.col("event_id") % 5 == 1, 0).when(F.col("event_id") % 5 > 1, F.col("event_id"))
    rows = read(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("repaired"), h.alias("hits"))
    return evidence.seed_stats(rows, "user_id", "repaired", "hits").withColumn("repair_rate", F.round("repair_rate", 9))


@register(f"""WITH {KNN}, m AS (SELECT i, j FROM k WHERE rank <= 4), s AS (SELECT i, avg({DOT.format('a.embedding', 'b.embedding')}) AS s, count(*) AS n FROM m JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j GROUP BY 1) SELECT i AS seed, round(s, 6) AS mean_sim, n FROM s""")
def seed_similarity(spark, sf_dir):
    """A21."""
    e = embeddings(spark, sf_dir)
    sets = graph.knn(e, 4).groupBy(F.col("i").alias("seed")).agg(F.array_sort(F.collect_list("j")).alias("m")).select("seed", F.concat(F.array("seed"), "m").alias("members"))
    return graph.seed_similarity(sets, "seed", "members", e).withColumn("mean_sim", F.round("mean_sim", 6))


@register(f"""WITH {KNN}, c AS (SELECT * FROM k WHERE sim >= 0.3 AND rank <= 5), n AS (SELECT vec_id AS i, count(c.i) AS c FROM embeddings LEFT JOIN c ON c.i = vec_id GROUP BY 1)
SELECT i, j, rank::INT AS rank, round(sim, 6) AS sim FROM c UNION ALL SELECT i, i, r::INT, 1.0 FROM n, range(1, 6) x(r) WHERE r > c""")
def padded_neighbours(spark, sf_dir):
    """F20, F21."""
    e = embeddings(spark, sf_dir)
    return graph.padded(graph.knn(e, 5).where("sim >= 0.3"), e.select("id"), 5).withColumn("sim", F.round("sim", 6))


@register("""WITH n AS (SELECT doc_id, source, doc_id % 40 + 1990 AS y, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g')) AS t FROM documents), h AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE y END AS yy, length(t) AS l, sha1(t) AS h FROM n WHERE length(t) >= 50),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS r FROM h) WHERE r = 1) SELECT source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN yy >= 0 THEN yy END DESC NULLS LAST, l DESC, doc_id) AS rank FROM d) WHERE rank <= 20""")
def selected_documents(spark, sf_dir):
    """W01, P22."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text", F.when(F.col("doc_id") % 7 == 0, F.lit("n/a")).otherwise((F.col("doc_id") % 40 + 1990).cast("string")).alias("y"))
    d = d.withColumn("year", F.coalesce(evidence.year_number("y"), F.lit(-1)))
    return evidence.select_documents(d, "source", "doc_id", "year").select("source", "doc_id", "rank")


@register("""SELECT p_partkey, '"' || p_name || '"' AS quoted, p_size AS n, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS maybe, p_size % 2 = 0 AS flag, CASE WHEN length(p_name) > 8 THEN rtrim(left(p_name, 8)) || '..' ELSE p_name END AS shown, p_type || ' ' || p_brand AS joined, p_type AS first FROM part""")
def coercions(spark, sf_dir):
    """P15, P30, P31, X03, X31."""
    even = F.col("p_size") % 2 == 0
    j = F.to_json(F.array("p_type", F.lit(" "), "p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", T.quoted("p_name").alias("quoted"), T.to_int(F.concat(F.lit(" "), F.col("p_size"))).alias("n"), T.to_int(F.when(even, F.col("p_size").cast("string")).otherwise("x1")).alias("maybe"), T.to_bool(F.when(even, F.lit(" Yes")).otherwise("no")).alias("flag"), T.capped("p_name", 8, "..").alias("shown"), blocks.paragraph(j).alias("joined"), blocks.first_entry(j).alias("first"))


@register("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ',' || p_type ELSE '' END AS kept, p_size % 3 = 0 AS none, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS approx FROM part""")
def anchored_lines(spark, sf_dir):
    """Lines that stand in their context, NONE answers, approximate matches."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", F.array("p_name", F.lit("zzz qqq"), F.concat("p_type", F.lit("s"))).alias("l"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("(The "), F.upper("p_name"), F.lit("), of "), "p_type", F.lit("."))).otherwise("nothing").alias("ctx"), "p_name", "p_type")
    kept = F.array_join(F.transform(evidence.anchored("l", "ctx"), lambda x: F.regexp_replace(x, "s$", "")), ",")
    return rows.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(","), F.regexp_extract(kept, "[^,]*$", 0))).otherwise(kept).alias("kept"), evidence.is_none(F.when(F.col("p_size") % 3 == 0, F.array(F.lit("none"))).otherwise(F.array(F.lit("none"), F.lit("x")))).alias("none"), T.approx_flag("p_type", "ctx", F.lit("")).alias("approx"))


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey || chr(9) || s_name || chr(9) || s_nationkey || chr(9) || s_name || chr(9) || 'seen' || chr(9) || 'conf=0.5' || chr(9) || 'approx=' || CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 1 END || chr(9) || 'note=n 1' END AS line FROM supplier")
def unit_lines_meta(spark, sf_dir):
    """K18 with its further fields, F19, K12."""
    s = read(spark, sf_dir, "supplier")
    rows = s.select("s_suppkey", F.col("s_suppkey").cast("string").alias("hpo_id"), F.col("s_name").alias("hpo_name"), F.col("s_nationkey").alias("pmid"), F.when(F.col("s_suppkey") % 3 > 0, "support").otherwise("unclear").alias("verdict"), F.col("s_name").alias("canonical_phrase"), F.lit("seen").alias("support_sentence"), F.lit(0.5).alias("confidence"), F.lit(" n  1").alias("note"))
    rows = rows.withColumn("hpo_name", F.when(F.col("s_suppkey") % 2 == 0, F.col("hpo_name")).otherwise("missingword"))
    out = rows.select("s_suppkey", "hpo_name", sinks.unit_line(meta=True).alias("line"))
    name = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return out.join(name, "s_suppkey").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("line")).otherwise(F.replace("line", F.lit("missingword"), F.col("s_name"))).alias("line"))


@register("SELECT ok, count(*) AS n FROM (SELECT o_orderstatus <> 'F' AS ok FROM orders) GROUP BY 1")
def dead_letters(spark, sf_dir):
    """K12."""
    good, bad = sinks.failures(read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "failed").alias("error")))
    return good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok"))).groupBy("ok").agg(F.count("*").alias("n"))


@register(f"""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN [p_name, p_type] WHEN p_size % 3 = 1 THEN [p_brand] ELSE [p_type] END AS l FROM part), q AS (SELECT p_partkey, p_name, l[floor({U.format("concat_ws('|', '4', p_partkey)")} * len(l))::INT + 1] AS p0 FROM p)
SELECT p_partkey, '"' || p0 || '"' AS seed0, '"' || p0 || '" AND "' || p_name || '" AND (case report)' AS seed1, '"' || p0 || '" AND ("' || p_name || '" OR "x")' AS seed2 FROM q""")
def query_texts(spark, sf_dir):
    """R01, R04-R08."""
    none = F.array().cast("array<string>")
    m = F.col("p_size") % 3
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(m == 0, F.array("p_name", "p_type")).otherwise(none).alias("a"), F.when(m == 1, F.array("p_brand")).alias("b"), F.array("p_type").alias("c"), F.lit("x").alias("x"))
    rows = rows.withColumn("p0", sampling.phrase_of(["a", "b", "c"], 4, "p_partkey"))
    return rows.select("p_partkey", sampling.query_text("seed0", ["p0"]).alias("seed0"), sampling.query_text("seed1", ["p0", "p_name"], "case report").alias("seed1"), sampling.query_text("seed2", ["p0", "p_name", "x"]).alias("seed2"))


@register("""SELECT p_partkey, p_size % 4 = 0 AS weak, p_size % 4 = 0 OR p_size % 4 = 1 AS repaired, CASE WHEN p_size % 4 = 0 AND p_size % 8 = 0 OR p_size % 4 = 1 THEN 'better ' || p_brand ELSE CASE WHEN p_size % 4 = 0 THEN 'patient, ' || p_brand ELSE p_brand END END AS used FROM part""")
def repaired_queries(spark, sf_dir):
    """Weak phrases and those without hits are rewritten, and used if they find more."""
    m = F.col("p_size") % 4
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, F.concat(F.lit("patient, "), "p_brand")).otherwise(F.col("p_brand")).alias("phrases"), F.when(m == 1, 0).when(m == 0, 3).otherwise(1).alias("hits"), F.when((m == 1) | (F.col("p_size") % 8 == 0), 9).otherwise(2).alias("new_hits"), F.concat(F.lit("better "), "p_brand").alias("rewritten"))
    return sampling.repaired(rows).select("p_partkey", "weak", "repaired", "used")


@register("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'short form' END AS rewritten FROM part")
def rewritten_phrases(spark, sf_dir):
    """U17."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, F.lit("signs, of it")).otherwise(F.col("p_brand")).alias("p"))
    return models.repair_phrases(rows, "p_partkey", "p", models.canned({"signs": " short form \nother"})).select("p_partkey", "rewritten")


@register("""SELECT p_partkey, v.t AS surface, replace(v.ctx, '#', p_size::VARCHAR) AS context, v.anchors, v.low, v.high, v.unit FROM part, (VALUES ('BP', 'Blood pressure was #/70 mmHg, heart rate was 80 bpm.', 'BP,HR,blood pressure,heart rate', NULL::DOUBLE, NULL::DOUBLE, 'mmHg'), ('HR', 'Blood pressure was #/70 mmHg, heart rate was 80 bpm.', 'BP,HR,blood pressure,heart rate', NULL, NULL, 'bpm'), ('LAB', 'Ionized calcium was low at # mmol/L (range 1-2 mmol/L).', 'CALCIUM,ionized calcium', 1.0, 2.0, 'mmol/L'), ('R', 'Ionized calcium was low at # mmol/L (range 1-2 mmol/L).', 'CALCIUM,ionized calcium', 1.0, 2.0, 'mmol/L')) v(t, ctx, anchors, low, high, unit) WHERE p_size >= 10""")
def measurement_context(spark, sf_dir):
    """Sentence and clause context, anchors and reference ranges of measurements."""
    n = F.col("p_size")
    text = F.concat(F.lit("Blood pressure was "), n, F.lit("/70 mmHg, heart rate was 80 bpm. Ionized calcium was low at "), n, F.lit(" mmol/L (range 1-2 mmol/L)."))
    m = extraction.extract(read(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("chunk_key"), text.alias("text")))
    surface = F.when(F.col("unit") == "mmHg", "BP").when(F.col("unit") == "bpm", "HR").when(F.col("value.kind") == "range", "R").otherwise("LAB")
    return m.select(F.col("chunk_key").alias("p_partkey"), surface.alias("surface"), "context", F.array_join("anchors_hit", ",").alias("anchors"), F.col("ref_range.low").alias("low"), F.col("ref_range.high").alias("high"), "unit")


@register("SELECT p_partkey, sha1(p_partkey || '|' || p_size || ' ms|ms') AS span_id, p_size || ' ms' AS surface_norm, 'QTC,QT,PR,QRS,OTHER' AS labels FROM part WHERE p_size < 100")
def repacked_mentions(spark, sf_dir):
    """P23, X12, X13, T10."""
    m = extraction.extract(read(spark, sf_dir, "part").where("p_size < 100").select(F.col("p_partkey").alias("chunk_key"), F.concat(F.lit("interval of "), "p_size", F.lit(" ms there")).alias("text")))
    return extraction.repacked(m).select(F.col("chunk_key").alias("p_partkey"), "span_id", "surface_norm", F.array_join("label_options_norm", ",").alias("labels"))


@register("SELECT doc, chunks, mentions FROM (SELECT n_nationkey AS doc, 2 AS chunks, 1 AS mentions FROM nation WHERE n_nationkey % 2 = 1)")
def document_runs(spark, sf_dir):
    """Cached documents that are not finished are read, parsed, cut, measured and marked."""
    base = folder(spark, "runs")
    body = F.concat(F.lit("<article><front><abstract><p>Rate was 80 bpm.</p></abstract></front><body><sec><title>Case</title><p>"), "n_name", F.lit("</p></sec></body></article>"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("PMC"), F.col("n_nationkey")).alias("id"), "n_nationkey", body.alias("xml"))
    docs = n.select("id", "xml")
    sinks.finished(f"{base}/done", docs.where("pmod(cast(substring(id, 4, 9) as int), 2) = 0").select("id"))
    todo = evidence.remaining(docs, spark.read.parquet(f"{base}/done"), ["id"])
    chunks = markup.chunks(markup.parse_articles(todo))
    found = extraction.extract(chunks)
    per = chunks.groupBy("pmcid").agg(F.count("*").alias("chunks"))
    hits = found.groupBy(F.split_part("chunk_key", F.lit("|"), F.lit(1)).alias("pmcid")).agg(F.count("*").alias("mentions"))
    out = graph.stored(per.join(hits, "pmcid", "left").select(F.col("pmcid").alias("id"), "chunks", F.coalesce("mentions", F.lit(0)).alias("mentions")), "runs")
    sinks.finished(f"{base}/done", out.select("id"))
    left = evidence.remaining(docs, spark.read.parquet(f"{base}/done"), ["id"])
    return out.join(left, "id", "left_anti").select(F.substring("id", 4, 9).cast("int").alias("doc"), "chunks", "mentions")


ENCODER = models.hashing_encoder()


@register("SELECT n_nationkey, 1.0::DOUBLE AS cosine, 1 AS rank, n_name AS word FROM nation")
def word_contributions(spark, sf_dir):
    """A text of one word is that word."""
    out = models.contributions(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "n_name", ENCODER)
    return out.select("n_nationkey", F.round("cosine", 5).alias("cosine"), "rank", "word")


@register("SELECT n_nationkey, 1.0::DOUBLE AS same, 0.0::DOUBLE AS gone FROM nation")
def word_ablation(spark, sf_dir):
    """A text without words that it does not hold is the same; without its only word it is nothing."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("fever")).alias("t"))
    a, b = models.ablation(rows, "n_nationkey", "t", ["cough"], ENCODER), models.ablation(rows, "n_nationkey", "t", ["fever"], ENCODER)
    return a.select("n_nationkey", F.round("cosine", 5).alias("same")).join(b.select("n_nationkey", (F.round("cosine", 5) + 0.0).alias("gone")), "n_nationkey")


@register("SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), string_split(p_name || ' ' || p_type, ' ')))::DOUBLE AS score FROM part")
def reranked(spark, sf_dir):
    """U05 with a reranker that counts shared words."""
    make = lambda: lambda pairs: [float(len(set(q.split()) & set(c.split()))) for q, c in pairs]
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_type").alias("c"))
    return models.rerank(rows, "p_name", "c", make).select("p_partkey", "score")


@register("SELECT view, count(*) AS n, true AS unit FROM part, (VALUES ('E0'), ('E1'), ('E2'), ('E3')) v(view) GROUP BY 1")
def embedding_views(spark, sf_dir):
    """Four views of every term, all of length 1 or 0."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.array("p_type").alias("m"), F.array("p_brand").alias("d"), blocks.concatenated("p_name", [F.array("p_type"), F.array("p_brand")]).alias("t"))
    v = models.views(p, "p_partkey", "p_name", "m", "d", "t", ENCODER)
    return v.groupBy("view").agg(F.count("*").alias("n"), F.min(V.let(V.norm("vec"), lambda n: (F.abs(n - 1) < 1e-5) | (n < 1e-5))).alias("unit"))  # phrases may cancel out


@register("SELECT p_partkey, true AS same FROM part")
def definition_vectors(spark, sf_dir):
    """Given vectors are used when whole, else names are encoded."""
    ids = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    made = models.definition_vectors(ids, "p_partkey", "p_name", None, ENCODER)
    given = models.definition_vectors(ids, "p_partkey", "p_name", made, ENCODER).withColumnRenamed("vec", "v2")
    return made.join(given, "p_partkey").select("p_partkey", (F.abs(V.dot("vec", "v2") - 1) < 1e-5).alias("same"))


@register("""SELECT n_nationkey, 'a ' || n_nationkey || '|b' AS s2, '' AS s3, CASE WHEN n_nationkey % 2 = 0 THEN 'given' ELSE 'c' END AS s4, true AS failed FROM nation""")
def generated_scales(spark, sf_dir):
    """Three scales of each term; one fails; only empty ones are filled in."""
    def make():
        def model(system, user):
            if "mechanism" in user:
                raise OSError("down")
            return f" a {user.split()[-1]} \nb\nb" if "describe" in user else "c"
        return model

    n = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("describe "), "n_nationkey").alias("p2"), F.lit("mechanism").alias("p3"), F.lit("domain").alias("p4"))
    made = models.generate_scales(n, "n_nationkey", {"s2": "p2", "s3": "p3", "s4": "p4"}, make, tries=1)
    half = made.withColumn("s4", F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("given"))))
    full = models.refill_scales(half.join(n, "n_nationkey"), "n_nationkey", {"s2": "p2", "s4": "p4"}, make, tries=1)
    return full.select("n_nationkey", *[F.array_join(c, "|").alias(c) for c in ("s2", "s3", "s4")], F.col("s3_error").isNotNull().alias("failed"))


@register("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NATION' WHEN 1 THEN 'none' ELSE 'unanchored' END AS result FROM nation")
def grounded_generation(spark, sf_dir):
    """U20, F13, F14, P28."""
    n = read(spark, sf_dir, "nation")
    prompt = F.element_at(F.array(F.lit("good"), F.lit("nil"), F.lit("bad")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = n.select("n_nationkey", prompt.alias("p"), F.regexp_replace("n_name", "_.*", " here").alias("ctx"))
    good, bad = models.grounded_lines(rows, "n_nationkey", "p", "ctx", models.canned({"good": "NATION\nzzz", "nil": "NONE"}, "qqq"))
    return good.select("n_nationkey", F.array_join("lines", ",").alias("result")).unionByName(bad.select("n_nationkey", F.col("reason").alias("result")))


@register("SELECT source, CASE WHEN source = 'web' THEN 'weak' ELSE 'strong' END AS strength, count(*) AS n FROM documents GROUP BY 1, 2")
def evidence_strength(spark, sf_dir):
    """P28."""
    return read(spark, sf_dir, "documents").groupBy("source", blocks.evidence_row("source", "web").alias("strength")).agg(F.count("*").alias("n"))


@register("SELECT o_custkey, count(*) AS n_members, sha1(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR)) AS signature FROM orders GROUP BY 1")
def corpus_items(spark, sf_dir):
    """A set with its members, context and signature; here what SQL can hold against it."""
    sets = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    return sets.select("o_custkey", F.size("members").cast("long").alias("n_members"), F.sha1(T.signature(F.transform("members", lambda x: x.cast("string")))).alias("signature"))


@register(f"""WITH m AS (SELECT o_custkey AS k, list(o_orderkey ORDER BY o_orderkey) AS l, string_agg('- ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' | ' || o_orderstatus ELSE '' END, chr(10) ORDER BY o_orderkey) AS t, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey::VARCHAR) AS s FROM orders GROUP BY 1),
x AS (SELECT k, 'SET:' || chr(10) || t || chr(10) || 'EVIDENCE:' || chr(10) || 'e' || k || chr(10) || 'EXAMPLE:' || chr(10) || p_name AS c FROM m JOIN part ON p_partkey = floor({U.format("concat_ws('|', '6', s)")} * (SELECT count(*) FROM part))::BIGINT) SELECT k, CASE WHEN length(c) > 90 THEN rtrim(left(c, 90)) || chr(10) || '[TRUNCATED]' ELSE c END AS context FROM x""")
def set_contexts(spark, sf_dir):
    """J23 with names and an example chunk, P27, P29."""
    o = read(spark, sf_dir, "orders")
    sets = o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    names = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    chunks = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("text"))
    return evidence.set_context(sets, "k", "members", names, sets.select("k", F.concat(F.lit("e"), "k").alias("evidence")), chunks, 6, 90)


@register("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stream_distinct(spark, sf_dir):
    """Extension: rows once within the watermark, from a stream run to its end, held against batch."""
    from ..streaming import resume
    from .queries import event_stream

    out = folder(spark, "distinct")
    src = resume.distinct_within(event_stream(spark, sf_dir).select("ts", "user_id", "event_type"), "ts", ["user_id", "event_type"], "3650 days")
    src.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_type")




@register("SELECT p_partkey::VARCHAR AS key, p_partkey % 2 = 0 AS cached FROM part")
def cached_lookup(spark, sf_dir):
    """Only keys without a cached body are asked for."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"))
    cache = p.where("cast(key as long) % 2 = 0").select("key", F.lit('{"esearchresult": {"count": "1"}}').alias("body"))
    asked = remote.fetch(remote.missing(p, "key", cache), "key", lambda keys: dict.fromkeys(keys, "{}"), gap=0.0)
    return cache.select("key", F.lit(True).alias("cached")).unionByName(asked.where("body is not null").select("key", F.lit(False).alias("cached")))


@register("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), t AS (SELECT doc_id, ' ' || i || '. ' || x || ' ' || i || ' ' AS x, i FROM l) SELECT doc_id, count(*) AS n, sha1(string_agg(trim(regexp_replace(trim(x, ' '), '^\\s*[-*\\d.)\\]]+\\s*', ''), ' '), chr(10) ORDER BY i)) AS digest FROM t WHERE trim(regexp_replace(trim(x, ' '), '^\\s*[-*\\d.)\\]]+\\s*', ''), ' ') <> '' GROUP BY 1 HAVING count(*) > 1")
def plain_lines(spark, sf_dir):
    """Numbered lines with blanks and digits at both ends."""
    each = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit(" "), i + 1, F.lit(". "), x, F.lit(" "), i + 1, F.lit(" ")))
    rows = read(spark, sf_dir, "documents").select("doc_id", T.lines_plain(F.array_join(each, "\n")).alias("l"), F.size(each).alias("n"))
    return rows.where("n > 1").select("doc_id", F.size("l").cast("long").alias("n"), F.sha1(F.array_join("l", "\n")).alias("digest"))
