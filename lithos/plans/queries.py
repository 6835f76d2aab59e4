"""Registered queries: the engine's operators over the driver's tables, each with the SQL that
gives the same rows where SQL can say it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evidence, extraction, gating, graph, models, sampling
from ..sources import files, markup, remote, sinks
from ..streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WS = "'[ \\t\\n\\x0b\\x0c\\r]+'"
COMPACT = f"trim(regexp_replace(coalesce(text, ''), {WS}, ' ', 'g'))"
U = "(('0x' || substr(sha1({}), 1, 8))::BIGINT / 4294967296.0)"


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@register(f"""
WITH n AS (SELECT doc_id, source, {COMPACT} AS t FROM documents),
h AS (SELECT doc_id, source, length(t) AS len_norm, sha1(t) AS sha1_norm FROM n WHERE length(t) >= 50),
d AS (SELECT *, row_number() OVER (PARTITION BY source, sha1_norm ORDER BY doc_id) AS r FROM h)
SELECT source, doc_id, len_norm, sha1_norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len_norm DESC, doc_id) AS rank FROM d WHERE r = 1) WHERE rank <= 20""")
def evidence_top_docs(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = evidence.rows_of(docs).select("doc_id", "source", "len_norm", "sha1_norm", F.col("text_norm").alias("text"))
    rows = rows.where("len_norm >= 50").groupBy("source", "sha1_norm").agg(F.min("doc_id").alias("doc_id"), F.min("len_norm").alias("len_norm"))
    return evidence.top_k(rows, ["source"], [F.desc("len_norm"), F.col("doc_id")], 20).select("source", "doc_id", "len_norm", "sha1_norm", "rank")


@register(f"""
SELECT source, count(*) AS n, min(l) AS lo, max(l) AS hi, round(avg(l), 6) AS mean, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.9), 6) AS p90, round(quantile_cont(l, 0.95), 6) AS p95, round(quantile_cont(l, 0.99), 6) AS p99
FROM (SELECT source, length({COMPACT}) AS l FROM documents) GROUP BY source""")
def evidence_quantiles(spark, sf_dir):
    rows = evidence.rows_of(read(spark, sf_dir, "documents").select("source", "text")).select("source", "len_norm")
    return evidence.quantiles(rows, "len_norm", ["source"]).withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p90", "p95", "p99")})


@register("SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS doc_ids FROM documents GROUP BY source")
def source_doc_index(spark, sf_dir):
    index = sinks.id_index(read(spark, sf_dir, "documents"), "source", "doc_id", "ids")
    return index.select("source", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("doc_ids"))


@register("""
SELECT sha1(o_orderpriority || chr(10) || o_orderstatus) AS query_key, count(*) AS n, min(o_orderkey) AS first_order
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def query_key_dedup(spark, sf_dir):
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = evidence.remaining(read(spark, sf_dir, "orders"), done, ["o_orderkey"])
    return rows.groupBy(T.query_key("o_orderpriority", "o_orderstatus").alias("query_key")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def hierarchy(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("child"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return s.unionByName(n).unionByName(read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("root").alias("parent")))


EDGES = "e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region)"


@register(f"WITH RECURSIVE {EDGES}, a(id, ancestor, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT a.id, e.parent, a.depth + 1 FROM a JOIN e ON e.child = a.ancestor WHERE a.depth < 80) SELECT DISTINCT id, ancestor FROM a")
def ontology_ancestors(spark, sf_dir):
    return graph.ancestors(hierarchy(spark, sf_dir))


@register(f"WITH {EDGES} SELECT DISTINCT x.child AS id, y.child AS sibling FROM e x JOIN e y ON x.parent = y.parent AND x.child <> y.child")
def ontology_siblings(spark, sf_dir):
    return graph.siblings(hierarchy(spark, sf_dir))


@register("""
WITH p AS (SELECT s_suppkey AS i, s_suppkey + 1 AS j FROM supplier), s AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS x FROM lineitem), n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT p.i, p.j, count(*) AS c FROM p JOIN s a ON a.k = p.i JOIN s b ON b.k = p.j AND a.x = b.x GROUP BY 1, 2)
SELECT p.i, p.j, round(CASE WHEN coalesce(a.n, 0) + coalesce(b.n, 0) > 0 THEN coalesce(c.c, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(c.c, 0)) ELSE 0 END, 9) AS jaccard
FROM p LEFT JOIN c USING (i, j) LEFT JOIN n a ON a.k = p.i LEFT JOIN n b ON b.k = p.j""")
def ancestor_jaccard(spark, sf_dir):
    pairs = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") + 1).alias("j"))
    sets = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("x"))
    return graph.set_jaccard(pairs, sets, "k", "x").withColumn("jaccard", F.round("jaccard", 9))


@register("SELECT c_custkey, coalesce(n.n_name, c_nationkey::VARCHAR) AS nation_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) n ON c_nationkey = n_nationkey")
def parent_name_fallback(spark, sf_dir):
    names = read(spark, sf_dir, "nation").where("n_nationkey % 3 > 0")
    return evidence.with_name(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names, "n_nationkey", "n_name", "nation_name").select("c_custkey", "nation_name")


DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"
KNN = f"k AS (SELECT i, j, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(sim, 12) DESC, j) AS rank FROM (SELECT a.vec_id AS i, b.vec_id AS j, {DOT.format('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= 10)"


@register(f"WITH {KNN} SELECT i, j, round(sim, 6) AS sim, rank FROM k")
def knn_topk_exact(spark, sf_dir):
    return graph.knn(embeddings(spark, sf_dir), 10).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@register(f"WITH {KNN} SELECT least(i, j) AS a, greatest(i, j) AS b, round(max(sim), 6) AS weight FROM k WHERE sim >= 0.2 GROUP BY 1, 2")
def knn_graph_symmetric(spark, sf_dir):
    return graph.symmetric(graph.knn(embeddings(spark, sf_dir), 10), "max", 0.2).withColumn("weight", F.round("weight", 6))


@register(f"WITH {KNN} SELECT least(i, j) AS a, greatest(i, j) AS b, round(avg(sim), 6) AS weight FROM k GROUP BY 1, 2")
def knn_graph_mean(spark, sf_dir):
    return graph.symmetric(graph.knn(embeddings(spark, sf_dir), 10), "mean", -1.0).withColumn("weight", F.round("weight", 6))


@register(f"WITH p AS (SELECT vec_id AS i, vec_id + 7 AS j FROM embeddings) SELECT p.i, p.j, round({DOT.format('a.embedding', 'b.embedding')}, 6) AS sim FROM p JOIN embeddings a ON a.vec_id = p.i JOIN embeddings b ON b.vec_id = p.j")
def edge_similarity(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return graph.similarity(e.select(F.col("id").alias("i"), (F.col("id") + 7).alias("j")), e).withColumn("sim", F.round("sim", 6))


LONG = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)"
MU = f"{LONG}, m0 AS (SELECT label, pos, avg(x) AS m FROM l GROUP BY 1, 2), mu AS (SELECT label, pos, m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12) AS m FROM m0)"


def long_vector(rows, key, vec="vec"):
    return rows.select(key, F.posexplode(vec).alias("pos", "x")).select(key, (F.col("pos") + 1).alias("pos"), (F.round("x", 6) + 0.0).alias("x"))


@register(f"WITH {MU} SELECT label, pos, round(m, 6) + 0.0 AS x FROM mu")
def label_centroid(spark, sf_dir):
    return long_vector(V.mean_vector(embeddings(spark, sf_dir), ["label"]), "label")


@register(f"WITH {MU}, v AS (SELECT vec_id, pos, 0.92 * x + 0.08 * m AS y FROM l JOIN mu USING (label, pos)) SELECT vec_id AS id, pos, round(y / (sqrt(sum(y * y) OVER (PARTITION BY vec_id)) + 1e-12), 6) + 0.0 AS x FROM v")
def cluster_smooth(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return long_vector(graph.smoothed(e, e.select("id", "label"), 0.08, cluster="label"), "id")


@register(f"""WITH {MU}, s AS (SELECT vec_id, label, round(sum(x * m), 12) AS s FROM l JOIN mu USING (label, pos) GROUP BY 1, 2), t AS (SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 5),
q AS (SELECT label, pos, avg(x) AS m FROM l SEMI JOIN t USING (vec_id) GROUP BY 1, 2) SELECT label, pos, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12), 6) + 0.0 AS x FROM q""")
def topk_mean_pool(spark, sf_dir):
    return long_vector(graph.topk_pool(embeddings(spark, sf_dir), "label", 5, "id"), "label")


@register(f"""WITH {MU}, d AS (SELECT l.vec_id, l.label, l.pos, 0.6 * l.x + 0.4 * o.x AS a FROM l JOIN l o ON o.vec_id = l.vec_id + 1 AND o.pos = l.pos), a AS (SELECT vec_id, label, pos, a / (sqrt(sum(a * a) OVER (PARTITION BY vec_id)) + 1e-12) AS a FROM d),
c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), g AS (SELECT vec_id, a.label, greatest(0, sum(a * m)) * 0.15 * least(1, ln(1 + max(n)) / ln(11)) AS g FROM a JOIN mu USING (label, pos) JOIN c ON c.label = a.label GROUP BY 1, 2),
v AS (SELECT a.vec_id, a.pos, a + g * m AS v FROM a JOIN g USING (vec_id) JOIN mu ON mu.label = a.label AND mu.pos = a.pos) SELECT vec_id AS id, pos, round(v / (sqrt(sum(v * v) OVER (PARTITION BY vec_id)) + 1e-12), 6) + 0.0 AS x FROM v""")
def fuse_vectors(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    pool = V.mean_vector(e, ["label"]).select("label", F.col("vec").alias("p"), "n")
    rows = e.join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("dom")), "id").join(pool, "label")
    return long_vector(rows.select("id", V.fused("vec", "dom", [("p", "n", 10, 0.15)]).alias("vec")), "id")


@register(f"""WITH {KNN}, r AS (SELECT k.*, (a.label = b.label)::INT AS rel FROM k JOIN embeddings a ON a.vec_id = i JOIN embeddings b ON b.vec_id = j), q AS (SELECT q, i, max(rel) AS hit, avg(rel) AS p FROM r, (VALUES (1), (5), (10)) v(q) WHERE rank <= q GROUP BY 1, 2)
SELECT q AS k, count(*) AS n, round(avg(hit), 6) AS hit_rate, round(avg(p), 6) AS precision FROM q GROUP BY 1""")
def retrieval_metrics_at_k(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    found = graph.knn(e, 10)
    labels = e.select("id", "label")
    same = found.join(labels.withColumnRenamed("id", "i").withColumnRenamed("label", "li"), "i").join(labels.withColumnRenamed("id", "j").withColumnRenamed("label", "lj"), "j").where("li = lj")
    out = graph.retrieval_metrics(found, same, (1, 5, 10))
    return out.select("k", "n", F.round("hit_rate", 6).alias("hit_rate"), F.round("precision", 6).alias("precision"))


@register("SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-3) AS n_off FROM embeddings")
def unit_norm_check(spark, sf_dir):
    return embeddings(spark, sf_dir).agg(F.count("*").alias("n"), F.sum((F.abs(V.norm("vec") - 1) > 1e-3).cast("long")).alias("n_off"))


@register("SELECT p_partkey, p_name LIKE '%case%' OR len(string_split(lower(trim(p_name)), ' ')) > 5 OR regexp_matches(lower(p_name || ' ' || p_type), '[(),]|signs|symptoms|with|without|near|induced|presenting|diagnosed|patient|case|clinical|pathophysiology|mechanism|lack of|due to|in the setting of') OR len(string_split(p_name || ' ' || p_type, ' ')) > 5 AS weak FROM part")
def weak_phrase(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", T.is_weak(F.concat_ws(" ", "p_name", "p_type")).alias("weak"))


UNIT = "(['ms', 'mmHg', 'bpm', 'mmol/L', 'mg/dL', '%', 'days', 'Minutes', 'furlong'])[l_linenumber + 1]"


def measured(spark, sf_dir):
    u = F.array(*map(F.lit, ["ms", "mmHg", "bpm", "mmol/L", "mg/dL", "%", "days", "Minutes", "furlong"]))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.element_at(u, F.col("l_linenumber") + 1).alias("unit"), F.when(F.col("l_quantity") < 10, "serum low, calcium").when(F.col("l_quantity") > 40, "Elevated ef above Normal").otherwise("plain").alias("ctx"))
    return rows


@register(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {UNIT} AS u, CASE WHEN l_quantity < 10 THEN 'lo' WHEN l_quantity > 40 THEN 'hi' ELSE 'no' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE lower(u) WHEN 'mmhg' THEN 'mmHg' WHEN 'days' THEN 'd' WHEN 'minutes' THEN 'min' WHEN 'mmol/l' THEN 'mmol/L' WHEN 'mg/dl' THEN 'mg/dL' ELSE u END AS unit_norm,
CASE WHEN lower(u) = 'ms' THEN 'QTc,QT,PR,QRS,OTHER' WHEN lower(u) = 'mmhg' THEN 'BLOOD_PRESSURE,OTHER' WHEN u = 'bpm' THEN 'HEART_RATE,OTHER' WHEN lower(u) IN ('mmol/l', 'mg/dl') THEN CASE WHEN c = 'lo' THEN 'IONIZED_CALCIUM,SERUM_CALCIUM,OTHER' ELSE 'LAB_VALUE,OTHER' END
WHEN u = '%' THEN CASE WHEN c = 'hi' THEN 'LVEF,OTHER' ELSE 'PERCENT_VALUE,OTHER' END WHEN lower(u) IN ('days', 'minutes') THEN 'DURATION,FREQUENCY,OTHER' ELSE 'OTHER' END
|| CASE WHEN lower(u) IN ('ms', 'mmhg', 'bpm', 'mmol/l', 'mg/dl', '%') THEN CASE c WHEN 'lo' THEN ',LOW_FLAG' WHEN 'hi' THEN ',HIGH_FLAG,NORMAL_FLAG' ELSE '' END ELSE '' END AS labels FROM x""")
def label_options(spark, sf_dir):
    anchors = F.filter(F.array(F.when(F.contains("ctx", F.lit("calcium")), "CALCIUM"), F.when(F.contains("ctx", F.lit(" ef ")), "EF")), lambda v: v.isNotNull())
    rows = measured(spark, sf_dir)
    return rows.select("l_orderkey", "l_linenumber", T.unit("unit").alias("unit_norm"), F.array_join(T.label_options("unit", anchors, "ctx"), ",").alias("labels"))


@register("""WITH x AS (SELECT l_orderkey, l_linenumber, 'BP was ' || (90 + l_linenumber) || '/' || (50 + l_linenumber) || ' mmHg and heart rate ' || (60 + l_linenumber) || ' bpm.' AS a, ' Serum calcium low at ' || l_linenumber || '.5 mmol/L for ' || (l_linenumber + 1) || ' days.' AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, span_start, surface, unit, num FROM (
SELECT l_orderkey, l_linenumber, 7 AS span_start, (90 + l_linenumber) || '/' || (50 + l_linenumber) || ' mmHg' AS surface, 'mmHg' AS unit, (90 + l_linenumber)::DOUBLE AS num FROM x UNION ALL
SELECT l_orderkey, l_linenumber, length(a) - 7, (60 + l_linenumber) || ' bpm', 'bpm', 60.0 + l_linenumber FROM x UNION ALL
SELECT l_orderkey, l_linenumber, length(a) + 22, l_linenumber || '.5 mmol/L', 'mmol/L', l_linenumber + 0.5 FROM x UNION ALL
SELECT l_orderkey, l_linenumber, length(a) + 37, (l_linenumber + 1) || ' days', 'd', l_linenumber + 1.0 FROM x)""")
def measurement_extract(spark, sf_dir):
    n = F.col("l_linenumber")
    text = F.concat(F.lit("BP was "), n + 90, F.lit("/"), n + 50, F.lit(" mmHg and heart rate "), n + 60, F.lit(" bpm. Serum calcium low at "), n, F.lit(".5 mmol/L for "), n + 1, F.lit(" days."))
    # a small file is one row group, thus one task: the keys are spread before texts are made of them
    keys = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").repartition(spark.sparkContext.defaultParallelism, "l_orderkey", "l_linenumber")
    m = extraction.extract_repeated(keys.select("l_orderkey", "l_linenumber", text.alias("text")))
    return m.select("l_orderkey", "l_linenumber", "span_start", "surface", "unit", F.coalesce("value.num", "value.systolic").alias("num"))


SENT = f"s0 AS (SELECT doc_id, string_split(regexp_replace({COMPACT}, '([.?!]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s0)"
NORM = "trim(regexp_replace(regexp_replace(lower(s), '[()\\[\\]{},;:\"''`]', ' ', 'g'), ' +', ' ', 'g'))"


@register(f"""WITH {SENT}, m AS (SELECT doc_id, i, s, {NORM} AS n FROM s WHERE s <> ''), h AS (SELECT doc_id, i, s, 2.0 * ((contains(n, 'the'))::INT + (contains(n, 'ent'))::INT)
+ CASE WHEN regexp_matches(s, '(?i)\\b(is|are|was|were) (defined|characteri[sz]ed|caused|a|an|the)\\b|\\brefers? to\\b|\\bconsists? of\\b') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(s, '(?i)\\b(method|methods|protocol|guideline|guidelines|questionnaire|software|algorithm|we (used|performed|conducted))\\b') THEN 6 ELSE 0 END - length(s) * 0.005 AS score FROM m WHERE contains(n, 'the') OR contains(n, 'ent')),
f AS (SELECT doc_id, s, min(i) AS i, min(score) AS score FROM h GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, i) AS r FROM f),
z AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM m WHERE doc_id NOT IN (SELECT doc_id FROM h))
SELECT doc_id, r AS place, sha1(s) AS sentence FROM r WHERE r <= 5 UNION ALL SELECT doc_id, r, sha1(s) FROM z WHERE r <= 2""")
def sentence_rank(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lit("The"), F.lit("ent")).alias("phrases"))
    out = evidence.hit_sentences(docs, "doc_id", "text", "phrases")
    return out.select("doc_id", F.posexplode("sentences").alias("p", "s")).select("doc_id", (F.col("p") + 1).alias("place"), F.sha1("s").alias("sentence"))


@register(f"SELECT l_suppkey, l_orderkey, l_linenumber, pick FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {U.format("concat_ws('|', '7', l_suppkey, l_orderkey, l_linenumber)")}, l_orderkey, l_linenumber) AS pick FROM lineitem) WHERE pick <= 3")
def reservoir_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return sampling.k_of_n(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], 3, 7)


@register(f"""WITH {KNN}, c AS (SELECT *, sum(w) OVER (PARTITION BY i ORDER BY w0 DESC, j ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY i) AS tot FROM (SELECT i, j, round(sim, 6) AS w0, greatest(0.001, round(sim, 6)) AS w FROM k)),
d AS (SELECT *, {U.format("concat_ws('|', '13', i, d)")} * tot AS t FROM c, (VALUES (1), (2)) v(d)) SELECT i, d AS draw, arg_min(j, cum) AS j FROM d WHERE cum > t GROUP BY 1, 2""")
def weighted_neighbour(spark, sf_dir):
    near = graph.knn(embeddings(spark, sf_dir), 10).withColumn("sim", F.round("sim", 6))
    return sampling.weighted_pick(near, ["i"], "j", "sim", 13, draws=2)


@register(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {U.format("'5|' || o_orderkey")}, o_orderkey) AS r FROM orders) WHERE r > 100 AND r <= 300")
def shuffled_shard(spark, sf_dir):
    return sampling.shuffled_range(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5, 100, 300)


@register("SELECT c_custkey, o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'no_link' ELSE 'no_document' END AS error FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) d ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def job_failures(spark, sf_dir):
    links = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    docs = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return evidence.jobs(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", links, docs, "o_orderkey")[1]


@register("SELECT event_type, count(*) AS n, count(*) FILTER (value > 0) AS n_ok, count(*) FILTER (value IS NULL) AS n_null, round(count(*) FILTER (value > 0) / count(*), 9) AS rate, sum((props->>'$.k')::BIGINT)::BIGINT AS k_sum FROM events GROUP BY 1")
def event_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ok = F.sum(F.coalesce(F.col("value") > 0, F.lit(False)).cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), ok.alias("n_ok"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"), F.round(ok / F.count("*"), 9).alias("rate"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


@register("SELECT count(*) FILTER (NOT contains(p_name, 'e')) AS missing_a, count(*) FILTER (p_size % 2 = 0) AS missing_b FROM part")
def missing_scale_counts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    rows = p.select(F.when(F.contains("p_name", F.lit("e")), F.array("p_name")).otherwise(none).alias("a"), F.when(F.col("p_size") % 2 == 1, F.array("p_type")).alias("b"))
    return evidence.missing_scales(rows, ["a", "b"])


@register("SELECT source, sum(n) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING)::BIGINT - n AS start_at, sum(n) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING)::BIGINT AS end_at FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def pool_offsets(spark, sf_dir):
    n = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))  # a row per source
    return n.select("source", (end - F.col("n")).alias("start_at"), end.alias("end_at"))


@register("SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def union_distinct(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")).distinct()


@register("(SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT -o_custkey FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events))")
def except_intersect(spark, sf_dir):
    c, o = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    both = o.intersect(read(spark, sf_dir, "events").select(F.col("user_id").alias("id")))
    return c.subtract(o).unionAll(both.select((-F.col("id")).alias("id")))


@register("SELECT signature, count(*) AS n, min(l_orderkey) AS first_order FROM (SELECT l_orderkey, string_agg(DISTINCT l_suppkey::VARCHAR, '|' ORDER BY l_suppkey::VARCHAR) AS signature FROM lineitem GROUP BY 1) GROUP BY 1")
def set_signatures(spark, sf_dir):
    sets = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("ids"))
    return sets.groupBy(T.signature("ids").alias("signature")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


GATE = {"k1": ["the", "of"], "k2": ["la", "le"], "k3": ["the", "and the"], "k4": ["der", "die"]}


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), n AS (SELECT doc_id, x, ' ' || array_to_string(regexp_extract_all(lower(x), '[a-z0-9]+'), ' ') || ' ' AS t FROM l),
h AS (SELECT doc_id, trim(x, ' ') AS x, (contains(t, ' the ') OR contains(t, ' of '))::INT AS k1, (contains(t, ' la ') OR contains(t, ' le '))::INT AS k2, (contains(t, ' the '))::INT AS k3, (contains(t, ' der ') OR contains(t, ' die '))::INT AS k4 FROM n WHERE NOT regexp_matches(lower(x), 'rash|erythematous|acid phosphatase|alkaline phosphatase|arylsulfatase'))
SELECT d.doc_id, coalesce(count(DISTINCT h.x), 0) AS n_valid, (coalesce(max(k1), 0) + coalesce(max(k2), 0) + coalesce(max(k3), 0) + coalesce(max(k4), 0)) / 4 AS coverage FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id AND k1 + k2 + k3 + k4 >= 2 GROUP BY 1""")
def line_gate(spark, sf_dir):
    anchors = F.create_map(*[x for k, v in GATE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"), anchors.alias("anchors"))
    return gating.gated(rows, seed=None).select("doc_id", F.size("valid").cast("long").alias("n_valid"), "coverage")


@register("""WITH t AS (SELECT p_partkey, list_filter(string_split(array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' '), ' '), lambda x: x NOT IN ('', 'abnormal', 'circulating', 'plasma', 'serum', 'blood', 'of', 'the', 'and', 'level', 'concentration', 'activity')) AS t, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS n FROM part),
u AS (SELECT p_partkey, unnest([array_to_string(t[1:3], ' '), array_to_string(t[1:4], ' ')] || t[1:5] || [n]) AS a FROM t)
SELECT p_partkey, count(DISTINCT array_to_string((string_split(a, ' '))[1:5], ' ')) AS n_anchors, max(a) AS last_anchor FROM u WHERE a <> '' GROUP BY 1""")
def name_anchors(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", T.name_anchors("p_name").alias("a"))
    return rows.select("p_partkey", F.size("a").cast("long").alias("n_anchors"), F.array_max("a").alias("last_anchor"))


@register("""WITH n AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS n FROM conversations), s AS (SELECT conv_id, turn, array_to_string((string_split(n, ' '))[1:3], ' ') AS st, list_filter(list_distinct(string_split(n, ' ')), lambda x: x <> '') AS k FROM n),
p AS (SELECT a.conv_id, count(*) AS p FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.k) > 0 AND len(b.k) > 0 AND len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) >= 0.92 GROUP BY 1)
SELECT s.conv_id, round(1 - count(DISTINCT st) FILTER (st <> '') / count(*), 9) AS dup_start_ratio, coalesce(max(p.p), 0) AS near_dup_pairs FROM s LEFT JOIN p ON p.conv_id = s.conv_id GROUP BY 1""")
def line_diversity(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("lines"))
    return rows.select("conv_id", gating.diversity("lines").alias("d")).select("conv_id", F.round("d.dup_start_ratio", 9).alias("dup_start_ratio"), F.col("d.near_dup_pairs").cast("long").alias("near_dup_pairs"))


@register("SELECT l_orderkey, attempt FROM (SELECT l_orderkey, l_linenumber AS attempt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity::INT % 5 DESC, round(l_discount, 9) DESC, l_tax > 0.04 DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def best_attempt(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), F.array_repeat(F.lit("x"), (F.col("l_quantity").cast("int") % 5)).alias("valid"), F.col("l_discount").alias("coverage"), (F.col("l_tax") > 0.04).alias("div_ok"))
    return gating.best_attempt(rows, "l_orderkey").select("l_orderkey", "attempt")


@register("SELECT count(*) AS n, count(*) FILTER (l_quantity > 10) AS n_ok, count(*) FILTER (l_quantity <= 10) AS n_fail, round(avg(l_linenumber), 9) AS mean_attempts, round(avg(l_discount) FILTER (l_discount > 0), 9) AS mean_coverage FROM lineitem")
def run_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 10).alias("ok"), F.col("l_linenumber").alias("attempts"), F.col("l_discount").alias("coverage"))
    return gating.run_summary(rows).withColumns({"mean_attempts": F.round("mean_attempts", 9), "mean_coverage": F.round("mean_coverage", 9)})


@register("SELECT p_partkey::VARCHAR AS pmid, p_name AS title, p_brand AS journal, (1990 + p_size)::VARCHAR AS year, p_type || ' ' || p_name AS abstract FROM part")
def abstract_parse(spark, sf_dir):
    date = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<Year>"), F.col("p_size") + 1990, F.lit("</Year>")))
    body = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><PMID>"), "p_partkey", F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), F.coalesce(date, F.concat(F.lit("<MedlineDate>"), F.col("p_size") + 1990, F.lit(" Jan-Feb</MedlineDate>"))), F.lit("</PubDate></JournalIssue><Title>"), "p_brand", F.lit("</Title></Journal><ArticleTitle>"), "p_name", F.lit("</ArticleTitle><Abstract><AbstractText>"), "p_type", F.lit("</AbstractText><AbstractText> "), "p_name", F.lit("</AbstractText></Abstract></Article></PubmedArticle></PubmedArticleSet>"))
    return markup.parse_abstracts(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), body.alias("xml"))).select("pmid", "title", "journal", "year", "abstract")


@register("""SELECT 'PMC' || n_nationkey AS pmcid, s AS section, i::INT AS para_idx, t AS text FROM (
SELECT n_nationkey, 'Abstract' AS s, 0 AS i, n_name AS t FROM nation UNION ALL SELECT n_nationkey, 'Case ' || n_name, j, n_name || ' ' || j FROM nation, (VALUES (0), (1)) v(j) WHERE n_regionkey > 1 UNION ALL
SELECT n_nationkey, 'Methods', 0, 'm' FROM nation WHERE n_regionkey <= 1 UNION ALL SELECT n_nationkey, 'Results', 0, 'r' FROM nation WHERE n_regionkey <= 1)""")
def article_chunks(spark, sf_dir):
    case = F.concat(F.lit("<sec><title>Case "), "n_name", F.lit("</title><p>"), "n_name", F.lit(" 0</p><p> "), "n_name", F.lit("  1</p></sec>"))
    body = F.concat(F.lit("<article><front><abstract><p>"), "n_name", F.lit("</p></abstract></front><body><sec><title>Methods</title><p>m</p></sec>"), F.when(F.col("n_regionkey") > 1, case).otherwise(F.lit("<sec><title>Results</title><p>r</p></sec>")), F.lit("</body></article>"))
    rows = read(spark, sf_dir, "nation").select(F.concat(F.lit("PMC"), "n_nationkey").alias("id"), body.alias("xml"))
    return markup.chunks(markup.parse_articles(rows)).select("pmcid", "section", "para_idx", "text")


@register("SELECT l_orderkey, string_agg('PMC' || l_suppkey, ',' ORDER BY p, 'PMC' || l_suppkey) AS pmcids FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS p FROM lineitem WHERE l_suppkey % 7 > 0 GROUP BY 1, 2) GROUP BY 1")
def linked_ids(spark, sf_dir):
    raw = F.when(F.col("l_suppkey") % 7 == 0, F.lit("n/a")).when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" pmc"), "l_suppkey")).otherwise(F.col("l_suppkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", raw.alias("raw"), F.col("l_linenumber").alias("pos"))
    return remote.linked(rows, "l_orderkey", "raw").select("l_orderkey", F.array_join("pmcids", ",").alias("pmcids"))


@register("SELECT p_partkey::VARCHAR AS key, p_partkey % 3 > 0 AS found, CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 2 ELSE 0 END AS hits FROM part")
def replayed_lookup(spark, sf_dir):
    def ask(keys):
        if any(int(k) % 3 == 0 for k in keys):
            raise ValueError("bad batch")
        return {k: '{"esearchresult": {"count": "%d", "idlist": []}}' % (2 * int(k)) for k in keys}

    keys = read(spark, sf_dir, "part").select("p_partkey")
    got = remote.fetch(keys, "p_partkey", ask, batch=4, gap=0.0, workers=4)
    return got.select("key", F.col("error").isNull().alias("found"), F.coalesce(F.get_json_object("body", "$.esearchresult.count").cast("long"), F.lit(0)).alias("hits"))


@register("""SELECT p_partkey::VARCHAR AS id, CASE WHEN length(d) >= 60 THEN d WHEN p_size % 2 = 0 THEN p_brand ELSE p_name END AS text, CASE WHEN length(d) >= 60 THEN 'def' WHEN p_size % 2 = 0 THEN 'llm_def' ELSE 'name' END AS source, n_syn::INT AS n_syn
FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN p_name || ' ' || repeat(p_type || ' ', 4) || '.' ELSE 'short' END AS d, 2 AS n_syn FROM part)""")
def definition_select(spark, sf_dir):
    d = F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit(" "), F.repeat(F.concat("p_type", F.lit(" ")), 4), F.lit("."))).otherwise(F.lit("short"))
    fields = F.struct(F.col("p_partkey").alias("Id"), F.array("p_name").alias("Name"), F.array(d).alias("Def"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("llm_def"), F.array("p_type", "p_brand", "p_type").alias("Synonym"))
    raw = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.from_json(F.to_json(fields), files.TERM).alias("term"))
    return files.terms(raw).select("id", files.definition_text().alias("t"), F.size("synonyms").alias("n_syn")).select("id", "t.text", "t.source", "n_syn")


@register("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), t AS (SELECT doc_id, trim(x, ' ') AS x, i FROM l WHERE trim(x, ' ') <> ''),
d AS (SELECT doc_id, arg_min(x, i) AS x, min(i) AS i FROM t GROUP BY doc_id, lower(x)) SELECT c.doc_id, coalesce(count(d.x), 0) AS n_lines, sha1(coalesce(string_agg(d.x, chr(10) ORDER BY d.i), '')) AS digest FROM documents c LEFT JOIN d USING (doc_id) GROUP BY 1""")
def parsed_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", T.lines_nocase("text").alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.sha1(F.array_join("l", "\n")).alias("digest"))


@register("SELECT o_orderkey, (['YES', 'MAYBE', 'NO'])[o_orderkey % 3 + 1] AS label, (o_orderkey % 10) / 10 AS confidence, o_orderstatus AS status FROM orders")
def judged_answers(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    label = F.element_at(F.array(F.lit("yes"), F.lit("Maybe"), F.lit("NO")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    body = F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('", "note": "a } b"}'))
    wrapped = F.when(F.col("o_orderkey") % 3 == 0, body).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Sure {x}: "), body, F.lit(" done")))
    rows = o.select("o_orderkey", F.concat(F.lit("VERDICT: "), label, F.lit("\nCONF: 0."), F.col("o_orderkey") % 10, F.lit("\nWHY: because")).alias("v"), wrapped.alias("answer"))
    rows = models.answers(rows, "answer", "status string, note string").withColumn("j", gating.verdict("v"))
    return rows.select("o_orderkey", "j.label", "j.confidence", "value.status")


@register("SELECT s_suppkey, 'HP:' || lpad(s_suppkey::VARCHAR, 7, '0') || chr(9) || s_name || chr(9) || s_nationkey || chr(9) || s_name || ' x' || chr(9) || 'seen ' || s_name AS line FROM supplier WHERE s_suppkey % 3 > 0")
def unit_lines(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    hp = F.concat(F.lit("HP_"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    rows = s.select("s_suppkey", T.term_id(hp).alias("hpo_id"), F.col("s_name").alias("hpo_name"), F.col("s_nationkey").alias("pmid"), F.when(F.col("s_suppkey") % 3 > 0, " Support ").otherwise("reject").alias("verdict"), F.concat("s_name", F.lit("  x")).alias("canonical_phrase"), F.concat(F.lit("seen\n"), "s_name").alias("support_sentence"))
    return rows.select("s_suppkey", sinks.unit_line().alias("line")).where("line is not null")


@register("SELECT s_suppkey, 'Term ' || s_name || ' of ' || coalesce(CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey::VARCHAR END, '') || '.' AS prompt FROM supplier")
def filled_prompts(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", T.filled("Term {{name}} of {place}.", {"name": "s_name", "place": F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey"))}).alias("prompt"))


@register("""WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), b AS (SELECT * FROM (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r <= 2)
SELECT c.o_custkey, coalesce(substr(string_agg('line ' || l_linenumber || ' of ' || l_orderkey, chr(10) ORDER BY p, r), 1, 100), '') AS evidence FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN m USING (o_custkey) LEFT JOIN b ON l_orderkey = o_orderkey GROUP BY 1""")
def set_evidence(spark, sf_dir):
    sets = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("members"))
    docs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("member"), F.col("l_linenumber").alias("at"), F.concat(F.lit("line "), "l_linenumber", F.lit(" of "), "l_orderkey").alias("t"))
    return evidence.evidence_text(sets, "o_custkey", "members", docs, "member", "t", "at", 2, 100)


def event_stream(spark, sf_dir):
    """The events table as a stream, whether it is one file or a folder of files."""
    path = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(path).schema
    if os.path.isfile(path):
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)


@register("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Extension: the same event-time windows from a stream, run to its end."""
    src = event_stream(spark, sf_dir)
    name = f"w{uuid.uuid4().hex}"
    q = resume.windowed(src, "ts", "value", "event_type").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.col("w.start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@register("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_resume(spark, sf_dir):
    """Two runs over the same input append each key once."""
    base = f"{graph.shared(spark)}/resume-{uuid.uuid4().hex}"
    for run in range(2):
        src = event_stream(spark, sf_dir)
        resume.append_new(src.select("user_id", "event_type"), lambda b: b, ["user_id", "event_type"], f"{base}/out", f"{base}/state{run}").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("user_id").agg(F.count("*").alias("n"))


@register()
def graph_communities(spark, sf_dir):
    return graph.communities(graph.symmetric(graph.knn(embeddings(spark, sf_dir), 10), "max", 0.0))


@register()
def two_round_clusters(spark, sf_dir):
    e = embeddings(spark, sf_dir).select("id", "vec")
    first = graph.communities(graph.symmetric(graph.knn(e, 10), "max"))
    smooth = graph.smoothed(e, first, 0.08).select("id", "vec")
    return graph.communities(graph.symmetric(graph.knn(smooth, 10), "max"))


@register()
def term_sets(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    near = graph.knn(e, 40)
    sets = sampling.term_sets(near, e.select("id", F.col("label").alias("cluster")), 3, 7)
    return sets.select("seed", "k", "n_same", "n_cross", "signature")


@register()
def approximate_neighbours(spark, sf_dir):
    return graph.approximate_knn(embeddings(spark, sf_dir), 10).select("i", "j", F.round("sim", 6).alias("sim"), "rank")


@register(f"""WITH {KNN}, p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pl FROM embeddings), e AS (SELECT i, j FROM k UNION SELECT vec_id, vec_id FROM embeddings), x AS (SELECT i, list(pl ORDER BY pl) AS l FROM e JOIN p ON vec_id = j GROUP BY 1),
d AS (SELECT i, list_reduce(list_prepend(floor({U.format("concat_ws('|', '11', i)")} * ((SELECT count(*) FROM p) - len(l)))::BIGINT, l), lambda a, b: CASE WHEN b <= a THEN a + 1 ELSE a END) AS pl FROM x) SELECT i AS id, vec_id AS other FROM d JOIN p USING (pl)""")
def non_neighbours(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return sampling.non_neighbours(e, "id", graph.knn(e, 10), "i", "j", 11)


@register()
def encoded_neighbours(spark, sf_dir):
    # a small file is one task: the texts are spread before they are encoded
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("t")).repartition(spark.sparkContext.defaultParallelism, "id")
    return graph.knn(models.encode(p, "t", models.hashing_encoder()), 5).select("i", "j", F.round("sim", 5).alias("sim"), "rank")


@register("SELECT n_name, 2 AS attempt, true AS ok, 1.0::DOUBLE AS coverage FROM nation")
def gated_generation(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_name", F.create_map(F.lit("a"), F.array(F.lit("fever")), F.lit("b"), F.array(F.lit("low valine"))).alias("anchors"), F.lit("a").alias("seed"), F.concat(F.lit("Write on "), "n_name").alias("prompt"))
    reply = "1. Fever came with low valine.\n2. Low valine, then fever again.\n- Late fever and low valine persist."
    return models.generate_gated(n, "n_name", "", "prompt", models.canned({"Required": reply, "FRANCE": reply}, "nothing")).select("n_name", "attempt", "ok", "coverage")


from . import more  # noqa: E402, F401  (registers further queries)
