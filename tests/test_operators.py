import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithos.functions import text as T
from lithos.functions import vectors as V
from lithos.operators import extraction, gating, graph, models, sampling
from lithos.sources import files, markup, remote, sinks


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [
        ("BP was 120/80 mmHg and heart rate 88 bpm.", [(7, 18, "mmHg"), (34, 40, "bpm")]),
        ("QTc 450-470 ms (normal 350–440 ms), elevated.", [(4, 14, "ms"), (23, 33, "ms")]),
        ("Serum calcium low at 1.8 mmol/L for 3 days.", [(21, 31, "mmol/L"), (36, 42, "d")]),
        ("EF 35% of predicted; EF 35%x", [(24, 27, "%")]),
        ("1 minute, 2 minutes, 1 hour, 5 h, 140 / 90 mm Hg", [(10, 19, "min"), (29, 32, "h")]),
        ("", []),
    ],
)
def test_measurements(text, want):
    assert [(m["span_start"], m["span_end"], T.UNITS.get(m["raw_unit"].lower(), m["raw_unit"])) for m in extraction.mentions_in(text)] == want


def test_extract_agrees_with_the_prefilter(spark):
    texts = ["QTc 450-470 ms (normal 350–440 ms), elevated.", "EF 35%x", "no number", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_key string, text string")
    got = sorted((r.chunk_key, r.span_start) for r in extraction.extract(df).collect())
    assert got == sorted((str(i), m["span_start"]) for i, t in enumerate(texts) if t for m in extraction.mentions_in(t))


def test_short_sentences_join_the_previous():
    assert extraction.sentence_spans("Short. This sentence is certainly longer than it. Tiny; end") == [(0, 7), (7, 59)]


def test_ids_and_phrases(spark):
    f = spark.createDataFrame([("HP_0000118",), ("hp-0000118",), ("0000118",), ("other",), (None,)], "x string")
    assert [r.y for r in f.select(T.term_id("x").alias("y")).collect()] == ["HP:0000118"] * 3 + ["other", ""]
    p = spark.createDataFrame([("pmc12",), ("12",), ("x",), (None,)], "x string")
    assert [r.y for r in p.select(T.pmcid("x").alias("y")).collect()] == ["PMC12", "PMC12", None, None]
    w = spark.createDataFrame([("renal cyst",), ("a, b",), ("lack of x",), ("",), (None,), ("a b c d e f",)], "x string")
    assert [r.y for r in w.select(T.is_weak("x").alias("y")).collect()] == [False, True, True, True, True, True]


def test_lines(spark):
    assert one(spark, T.lines_plain("t"), t="1. First one\n- second\n\n * third") == ["First one", "second", "third"]
    long = "This line is long enough to be cut up by its own sentences. Here is the second of them. And then there is one third sentence more."
    assert len(one(spark, T.lines_plain("t"), t=long)) == 3
    assert one(spark, T.lines_nocase("t"), t="Abc\nabc\nx") == ["Abc", "x"]
    assert models.first_json('x {a} {"k": "}"} y') == '{"k": "}"}' and models.first_json(None) is None


def test_lines_keep_digits_and_lose_blanks(spark):
    """Blanks go at both ends whatever a line's place, and digits stay."""
    text = "  a  \nb1\n\t year 2022 \nx 3\nX 3\n"
    assert one(spark, T.lines("t"), t=text) == ["a", "b1", "year 2022", "x 3", "X 3"]
    assert one(spark, T.lines_nocase("t"), t=text) == ["a", "b1", "year 2022", "x 3"]
    many = "\n".join(f" l{i} " for i in range(12000)) + "\nL7\nl0"
    assert one(spark, T.lines_nocase("t"), t=many) == [f"l{i}" for i in range(12000)]
    assert one(spark, T.lines("t"), t=many) == [f"l{i}" for i in range(12)]
    assert one(spark, T.sentences("t"), t=" One is 1 of 11.  Two 2?\nThree 3! 4 ") == ["One is 1 of 11.", "Two 2?", "Three 3!", "4"]
    assert one(spark, T.lines_plain("t"), t="2022 was 1\n - b 2 \n") == ["was 1", "b 2"]
    rows = spark.createDataFrame([(["  fever 1 low 0 ", "fever 1 low 0", "low fever 11", "fever", "rash fever low"], {"a": ["fever"], "b": ["low"]})], "lines array<string>, anchors map<string,array<string>>")
    r = gating.gated(rows, seed=None).first()
    assert r.valid == ["fever 1 low 0", "low fever 11"] and r.covered == ["a", "b"] and r.coverage == 1.0


def test_diversity_against_pairs(spark):
    rnd = np.random.default_rng(3)
    voc = [f"w{i}" for i in range(14)]
    for n in (0, 1, 5, 12):
        lines = [" ".join(rnd.permutation(voc)[: rnd.integers(0, 15)]) for _ in range(n)] + (["a b c", "a b c"] if n > 1 else [])
        sets = [set(x.split()) for x in lines]
        want = sum(bool(a) and bool(b) and len(a & b) / len(a | b) >= 0.92 for i, a in enumerate(sets) for b in sets[i + 1 :])
        d = spark.createDataFrame([(lines,)], "lines array<string>").select(gating.diversity("lines").alias("d")).first().d
        assert d.near_dup_pairs == want and (d.reason == "no_lines") == (n == 0)


def test_ontology_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("C", "A"), ("E", "C"), ("P", "Q"), ("Q", "P")], "child string, parent string")
    got = {}
    for r in graph.ancestors(e).collect():
        got.setdefault(r.id, set()).add(r.ancestor)
    assert got["D"] == {"A", "B", "C"} and got["E"] == {"A", "C"} and got["P"] == {"P", "Q"}
    assert {(r.id, r.sibling) for r in graph.siblings(e).collect()} >= {("B", "C"), ("D", "E")}


def test_ontology_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"HP:0000001": {"Id": "HP:0000001", "Name": "All"}, "HP:0000002": {"Id": "HP:0000002", "Name": ["Size"], "Synonym": "Big", "Father": {"HP:0000001": 1}}, "x": 3}))
    rows = files.terms(files.ontology(spark, str(path)), root="HP:0000001", prefix="HP:").collect()
    assert [(r.id, r.name, r.synonyms, r.parents) for r in rows] == [("HP:0000002", "Size", ["Big"], ["HP:0000001"])]
    path.write_text(json.dumps([{"hpo_id": "HP:0000003", "label": "L"}, "no"]))
    assert [(r.id, r.name) for r in files.terms(files.ontology(spark, str(path))).collect()] == [("HP:0000003", "L")]


def test_tolerant_and_strict_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert sorted(r.a for r in files.jsonl(spark, str(path), "a int", strict=False).collect()) == [1, 2]
    assert files.jsonl(spark, str(tmp_path / "none"), "a int", strict=False).count() == 0
    with pytest.raises(Exception):
        files.jsonl(spark, str(path), "a int").collect()
    ids = spark.createDataFrame([(1,), (9,)], "a int")
    with pytest.raises(Exception):
        files.require_all(files.jsonl(spark, str(path), "a int", strict=False), ids, "a").collect()


def test_damaged_article_batch(spark):
    good = "<article><body><sec><title>T</title><p>x</p></sec></body></article>"
    rows = spark.createDataFrame([("1", f"<set>{good}<article>"), ("2", "<broken"), ("3", None)], "id string, xml string")
    got = {r.id: (r.sections, r.error) for r in markup.parse_articles(rows).collect()}
    assert got["1"][0][0].paras == ["x"] and got["2"][1] and got["3"][1]


def test_lookup_cache_and_replay(spark, tmp_path):
    keys = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    got = remote.fetch(keys, "k", remote.replay({"a": "1"}), gap=0.0)
    assert {(r.key, r.error) for r in got.collect()} == {("a", None), ("b", "missing")}
    assert [r.key for r in remote.missing(keys.where("k is not null"), "k", got).collect()] == ["b"]
    assert remote.search_result('{"esearchresult": {"count": "7", "idlist": ["1"]}}') == (["1"], 7)
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"a": "1", "b": "2"}))
    spark.dataSource.register(remote.ReplaySource)
    assert spark.read.format("replay").option("path", str(path)).load().count() == 2


def test_vectors(spark):
    assert one(spark, V.unit_vector("v"), v=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert one(spark, V.unit_vector("v"), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, V.unit_vector("v"), v=[float("nan"), 1.0]) == pytest.approx([0.0, 1.0])


def test_siblings_of_large_families_are_spread_and_told_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "SIBLINGS", 7)
    rows = [(f"c{i}", "big") for i in range(60)] + [(f"c{i}", "other") for i in range(50, 70)] + [("c1", "big"), ("x", "lone"), (None, "big"), ("c3", None)]
    out = graph.siblings(spark.createDataFrame(rows, "child string, parent string"))
    assert sum(n > 0 for n in out.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 8
    kids = {}
    for c, p in rows:
        kids.setdefault(p, set()).add(c)
    want = {(a, b) for p in ("big", "other", "lone") for a in kids[p] for b in kids[p] if a and b and a != b}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lookup_hands_on_many_keys_at_once(spark, monkeypatch):
    import pandas as pd

    made, tables = [], []

    class Keys:
        def select(self, *_):
            return self

        where = distinct = repartition = alias = select

        def mapInPandas(self, run, schema):
            made.append(run)

    def ask(keys):
        if "k5" in keys:
            raise ValueError("bad")
        return {k: k + "!" for k in keys}

    remote.fetch(Keys(), "k", ask, batch=4, gap=0.0)
    keys = [f"k{i}" for i in range(103)]
    tables += list(made[0](iter([pd.DataFrame({"key": keys[:60]}), pd.DataFrame({"key": keys[60:]})])))
    assert len(tables) == 2  # not one for every four keys
    got = pd.concat(tables)
    assert list(got["key"]) == keys and [k for k, e in zip(got["key"], got["error"], strict=True) if e] == ["k5"]
    assert all(b == k + "!" for k, b in zip(got["key"], got["body"], strict=True) if k != "k5")


def test_extraction_reads_a_repeated_text_once(spark, tmp_path):
    texts = ["BP was 120/80 mmHg and heart rate 88 bpm.", "none at 5 mmm", "Calcium at 1.8 mmol/L for 3 days.", "EF 35%x"]
    rows = [(f"c{i}", texts[i % 4]) for i in range(50)]
    df = spark.createDataFrame(rows, "chunk_key string, text string").coalesce(1)
    log, plain = tmp_path / "log", extraction.found_in

    def counted(text, vocabulary="rerun"):
        with log.open("a") as f:
            f.write("x")
        return plain(text, vocabulary)

    extraction.found_in = counted
    try:
        run = []
        real = type(df).mapInArrow
        type(df).mapInArrow = lambda self, f, schema: run.append(f) or real(self, f, schema)
        extraction.extract(df)
    finally:
        type(df).mapInArrow = real
    import pyarrow as pa

    try:
        out = [m for b in run[0](iter([pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["k", "t"])])) for m in b.to_pylist()]
    finally:
        extraction.found_in = plain
    assert len(log.read_text()) == 4
    assert out == [{"k": k} | m for k, t in rows for m in extraction.mentions_in(t)]


def test_extraction_of_repeated_texts_gives_every_chunk_its_mentions(spark):
    texts = ["BP was 120/80 mmHg and heart rate 88 bpm.", "none", None, "Calcium at 1.8 mmol/L for 3 days."]
    df = spark.createDataFrame([(i, f"c{i % 7}", texts[i % 4]) for i in range(50)], "n int, chunk_key string, text string")
    shown = ["chunk_key", "span_start", "span_end", "surface", "unit", "value", "anchors_hit", "context", "ref_range", "label_options"]
    rows = lambda d: sorted(repr(r) for r in d.select(*shown).collect())
    assert rows(extraction.extract_repeated(df)) == rows(extraction.extract(df)) != []


def test_views_average_each_list_once(spark):
    rows = [(i, n, m, d, t) for i, (n, m, d, t) in enumerate([("a b", ["c"], ["d", "a b"], "a b c d"), ("a b", ["c"], ["d"], None), ("e", [], [], "e")] * 2)]
    terms = spark.createDataFrame(rows, "k long, n string, m array<string>, d array<string>, t string")
    out = models.views(terms, "k", "n", "m", "d", "t", models.hashing_encoder(16))
    assert "posexplode" not in out._jdf.queryExecution().toString()  # no row for each place of a vector
    code = models.hashing_encoder(16)()
    unit = lambda v: v / (np.linalg.norm(v) + 1e-12)
    mean = lambda *ps: unit(np.mean([unit(code([p])[0]) for p in ps], axis=0))
    want = {"E0": [mean("a b"), mean("a b"), mean("e")], "E1": [mean("a b", "d")] * 2 + [mean("e")], "E2": [mean("a b", "c", "d")] * 2 + [mean("e")], "E3": [mean("a b c d"), None, mean("e")]}
    got = {(r.k, r.view): r.vec for r in out.collect()}
    assert len(got) == 22
    for (k, view), v in got.items():
        assert v == pytest.approx(want[view][k % 3], abs=1e-6)


def test_knn_blocks_ties_and_small_tables(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 8)).tolist()
    v[5] = v[6] = v[7]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, vec array<double>")
    whole = sorted(tuple(r) for r in graph.knn(df, 3).select("i", "rank", "j").collect())
    parts = sorted(tuple(r) for r in graph.knn(df, 3, block_bytes=600).select("i", "rank", "j").collect())
    m = np.array(v)
    s = m @ m.T
    want = sorted((i, r + 1, j) for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-round(s[i, j], 12), j))[:3]))
    assert whole == parts == want
    assert graph.knn(df.limit(2), 5).count() == 2 and graph.knn(df.limit(0), 5).count() == 0


def test_knn_copies_repeated_ids_and_values_that_are_not_finite(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(-1, 2, (70, 4)).astype(float)  # many ties and copies
    ids = [*range(100, 30, -1)]
    ids[3] = ids[4] = ids[5]
    v[10, 2] = np.nan
    df = spark.createDataFrame([*zip(ids, v.tolist()), (None, [1.0] * 4), (7, None)], "id long, vec array<double>")
    monkeypatch.setattr(graph, "TILE", (16, 8))
    monkeypatch.setattr(graph, "CHUNK", 5)
    got = sorted(tuple(r) for r in graph.knn(df, 6, block_bytes=300).select("i", "rank", "j", "sim").collect())
    s, want = np.round(v @ v.T, 12) + 0.0, []
    for i in {i for x, i in enumerate(ids) if x != 10}:
        all_j = [(-s[x, y], ids[y]) for x in range(70) if ids[x] == i for y in range(70) if 10 not in (x, y) and ids[y] != i]
        want += [(i, r + 1, j, -m) for r, (m, j) in enumerate(sorted(all_j)[:6])]
    assert got == sorted(want)


def test_knn_holds_a_tile_of_products(spark):
    import tracemalloc

    m = np.random.default_rng(4).standard_normal((60_000, 16))
    tracemalloc.start()
    top = graph.Top(np.arange(500), m[:500], 11)
    for s in range(0, len(m), 4096):
        top.add(np.arange(s, min(len(m), s + 4096)), m[s : s + 4096])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # products with all at once would be 240e6
    sims = np.round(m[7] @ m.T, 12)
    assert top.ids[7].tolist() == np.lexsort((np.arange(len(m)), -sims))[:11].tolist()


def test_encoder_gets_each_text_of_a_batch_once(spark):
    def make():
        def model(texts):
            assert len(set(texts)) == len(texts)
            return np.array([[len(t), 1.0] for t in texts], np.float32)

        return model

    df = spark.createDataFrame([(i, ["a", "bb", None][i % 3]) for i in range(30)], "id int, t string").coalesce(1)
    got = {r.id: list(r.vec) for r in models.encode(df, "t", make, normalize=False).collect()}
    assert got == {i: [float([1, 2, 0][i % 3]), 1.0] for i in range(30)}


def test_approximate_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    assert graph.recall(graph.approximate_knn(e, 10, tables=40, bits=4), graph.knn(e, 10)).first().recall >= 0.9


def test_approximate_pieces_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((90, 8)).tolist()
    v[10:60] = [v[10]] * 50
    df = spark.createDataFrame([*enumerate(v), (None, v[0]), (99, None)], "id long, vec array<double>")
    monkeypatch.setattr(graph, "PIECE", 20)
    got = sorted(tuple(r) for r in graph.approximate_knn(df, 3, tables=60, bits=1).select("i", "rank", "j").collect())
    assert got == sorted(tuple(r) for r in graph.knn(df, 3).select("i", "rank", "j").collect())


def test_communities_split_two_cliques(spark):
    pairs = [(a, b) for g in (range(6), range(6, 12)) for a in g for b in g if a < b] + [(0, 6)]
    got = {r.id: r.cluster for r in graph.communities(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(6, 12)}) == 1 and got[1] != got[7]


def test_sampling_is_stable_and_excludes_neighbours(spark):
    rows = spark.range(200).select((F.col("id") % 5).alias("g"), "id")
    a, b = (sorted(tuple(r) for r in sampling.k_of_n(x, ["g"], ["id"], 3, 1).select("g", "id").collect()) for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 15
    ids = spark.range(30)
    near = ids.select(F.col("id").alias("i"), ((F.col("id") + 1) % 30).alias("j"))
    assert all(r.other not in (r.id, (r.id + 1) % 30) for r in sampling.non_neighbours(ids, "id", near, "i", "j", 3).collect())


def test_retry_and_stream():
    calls = []

    def flaky(system, user):
        calls.append(user)
        if len(calls) < 3:
            raise OSError("down")
        return " ok "

    assert models.patient(flaky, tries=4, base=0.0)("", "u") == ("ok", None, 3)
    assert models.patient(lambda s, u: "", tries=2, base=0.0, empty_is_error=True)("", "u") == ("", "empty", 2)
    lines = ['data: {"choices": [{"delta": {"content": "a"}}]}', ": ping", "data: nonsense", "data: [DONE]", 'data: {"choices": [{"delta": {"content": "z"}}]}']
    assert list(models.stream(lambda s, u: iter(lines), "", "")) == ["a"]


def test_sinks(spark, tmp_path):
    sinks.write_json({"b": 1}, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == {"b": 1}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_partitioned(df, str(tmp_path / "p"), "k")
    sinks.write_partitioned(df.where("k = 'a'").withColumn("v", F.lit(5)), str(tmp_path / "p"), "k")
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).select("k", "v").collect()) == [("a", 5), ("b", 2)]
    assert "| a | 1 |" in sinks.markdown(df, "t")


def test_snapshot_manifest_and_readers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.snapshot(str(tmp_path), {"rows": df}, {"stamp": "t"})
    assert json.loads((tmp_path / "meta.json").read_text()) == {"rows": {"rows": 2}, "stamp": "t"}
    assert sinks.manifest(df, "t", seed=1) == {"at": "t", "config": {"seed": 1}, "columns": ["k", "v"], "rows": 2}
    assert files.resolved(str(tmp_path)) == str(tmp_path)
    (tmp_path / "out").mkdir()
    assert files.resolved(str(tmp_path)) == str(tmp_path / "out")
    cache = tmp_path / "xml"
    cache.mkdir()
    for name in ("PMC2", "pmc1", "note"):
        (cache / f"{name}.xml").write_text(f"<a>{name}</a>\nend")
    assert sorted((r.id, r.text) for r in files.cached_texts(spark, str(cache)).collect()) == [("PMC1", "<a>pmc1</a>\nend"), ("PMC2", "<a>PMC2</a>\nend")]
    np.save(tmp_path / "m.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert {r.id: r.vec for r in graph.import_matrix(spark, str(tmp_path / "m.npy"), ["x", "y", "z"]).collect()} == {"x": [0.0, 1.0], "y": [2.0, 3.0], "z": [4.0, 5.0]}
    with pytest.raises(ValueError):
        graph.import_matrix(spark, str(tmp_path / "m.npy"), ["x"])
    (tmp_path / "p.txt").write_text(" hi ")
    assert files.read_text(str(tmp_path / "p.txt")) == "hi"


def test_last_token_of_padded_texts():
    states = np.arange(12).reshape(2, 3, 2)
    assert models.last_token(states, np.array([[1, 1, 0], [1, 0, 0]])).tolist() == [[2, 3], [6, 7]]
    assert models.last_token(states, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == [[4, 5], [10, 11]]


def test_ranges_out_of_bounds_fail(spark):
    ids = spark.createDataFrame([(1, 1), (2, 0)], "k long, mask int")
    pool = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row long, vec array<double>")
    ranges = spark.createDataFrame([(1, "[0, 2]"), (2, "[0, 9]")], "k long, j string").select("k", files.ranges("j").alias("r"))
    assert [r.k for r in graph.range_pool(ids, "k", "mask", ranges, pool, 2).collect()] == [1]
    with pytest.raises(Exception):
        graph.range_pool(ids.withColumn("mask", F.lit(1)), "k", "mask", ranges, pool, 2).collect()


def test_non_neighbours_of_dense_graphs(spark):
    """Exact, however few are left; an id that neighbours all others has none."""
    ids = spark.range(12)
    near = ids.select(F.col("id").alias("i")).crossJoin(spark.range(12).select(F.col("id").alias("j"))).where("i <> j and (j <> (i + 5) % 12 or i = 3)")
    got = {r.id: r.other for r in sampling.non_neighbours(ids, "id", near, "i", "j", 3).collect()}
    assert got == {i: (i + 5) % 12 for i in range(12) if i != 3}


def test_chunk_titles(spark):
    xml = "<article><front><abstract><p>a</p></abstract></front><body><sec><p>x</p></sec></body></article>"
    rows = markup.chunks(markup.parse_articles(spark.createDataFrame([("PMC1", xml)], "id string, xml string"))).collect()
    assert [(r.section, r.text) for r in rows] == [("Abstract", "a"), ("UNKNOWN", "x")]
