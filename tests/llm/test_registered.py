"""The registered opN_ queries and the pipeline over whole small tables: SQL, libraries or brute force."""

import glob
import hashlib
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from lithos.llm import language, tiling
from lithos.llm.queries import ORACLES, QUERIES, tokenizer
from test_corpus import WORD, brute_bytes, brute_lines, brute_windows, lower, order

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def extreme(spark, tmp_path_factory):
    """Very long, repeated, null and empty texts, with ids null and repeated."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    long = " ".join(t for _, t, *_ in base if t)
    long = "\n".join([long] * (1 + 3_000_000 // len(long)))
    rows = base + [(1000, long, "en", "s", 0), (1001, long[: len(long) // 2] + " tail", "en", "s", 0), (None, None, None, None, None), (1002, "", "en", "s", 0), (7, base[3][1], "en", "s", 0), (7, base[3][1], "en", "s", 0), (None, base[3][1], "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("extreme"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path, [(d, t) for d, t, *_ in rows]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert order(map(tuple, got[cols].astype(str).values)) == order(map(tuple, want[cols].astype(str).values))


def test_windows_bytes_lines(spark, docs):
    assert order(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, SF).collect()) == brute_windows(docs, 13)
    assert order(tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, SF).collect()) == brute_bytes(docs, 200)
    assert order(tuple(r) for r in QUERIES["op6_line_dedup"](spark, SF).collect()) == brute_lines(docs, 10)


def libraries(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    bpe = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    counts, coded = [], []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, t in rows:
        t = t or ""
        n = len(bpe.encode(t, add_special_tokens=False).ids)
        counts.append((d, len(t.encode()), n, n > 1024))
        ids = sp.encode(t, add_eos=True)
        coded.append((d, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    return order(counts), order(coded)


def test_tokens_and_pieces(spark, docs, extreme):
    for path, rows in ((SF, docs), extreme):
        counts, coded = libraries(rows)
        assert order(tuple(r) for r in QUERIES["op3_token_counts"](spark, path).collect()) == counts
        assert order(tuple(r) for r in QUERIES["op7_sentencepiece"](spark, path).collect()) == coded


def fingerprint(t):
    w = WORD.findall(lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    if not h:
        return 0
    bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def groups(prints):
    """Index of the first row reachable from each over links of at most 4 bits, and the number of direct links."""
    f, n = np.array(prints, np.uint64), len(prints)
    near = [np.flatnonzero(np.bitwise_count(f ^ x) <= 4) for x in f]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min(root[j] for j in near[i])
            for j in near[i]:
                if root[j] != low:
                    root[j], changed = low, True
    return root, [len(x) - 1 for x in near]


def test_near_duplicates(spark, docs, extreme):
    for path, rows in ((SF, docs), extreme):
        prints = [fingerprint(t) for _, t in rows]
        root, near = groups(prints)
        low = defaultdict(list)
        for (d, _), r in zip(rows, root):
            low[r].append(d)
        least = {r: None if None in ds else min(ds) for r, ds in low.items()}
        want = [(d, f"{p:016x}", n, least[r]) for (d, _), p, n, r in zip(rows, prints, near, root)]
        assert order(tuple(r) for r in QUERIES["op2_simhash_near_dedup"](spark, path).collect()) == order(want)


def test_extreme_texts(spark, extreme):
    """Long texts, repeats, nulls: words, bytes and lines as brute force has them; the others give a row a row."""
    path, rows = extreme
    assert order(tuple(r) for r in QUERIES["op4_substring_dedup"](spark, path).collect()) == brute_windows(rows, 13)
    assert order(tuple(r) for r in QUERIES["op6_line_dedup"](spark, path).collect()) == brute_lines(rows, 10)
    short = [(d, t) for d, t in rows if len(t or "") < 20_000]
    spark.createDataFrame(short, "doc_id long, text string").write.mode("overwrite").parquet(f"{path}/short/documents.parquet")
    assert order(tuple(r) for r in QUERIES["op5_suffix_array_dedup"](spark, f"{path}/short").collect()) == brute_bytes(short, 200)
    for name in ("op1_quality_rules", "op5_suffix_array_dedup", "op8_language_id", "op9_license_scan"):
        assert Counter(r.doc_id for r in QUERIES[name](spark, path).collect()) == Counter(d for d, _ in rows), name


def brute_coverage(text, item, match):
    """Share of the item's tokens under greedy tiles."""
    a, b = tiling.tokens((text or "").encode()), tiling.tokens(item.encode())
    if not b:
        return 0.0
    size = tiling.shortest(len(b), match)
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    places = defaultdict(list)
    for j in range(len(b) - size + 1):
        places[tuple(b[j : j + size])].append(j)
    seeds = [(i, j) for i in range(len(a) - size + 1) for j in places.get(tuple(a[i : i + size]), ())]
    while True:
        best, found = size, []
        for i, j in seeds:
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                n += 1
            if n > best:
                best, found = n, [(i, j)]
            elif n == best:
                found.append((i, j))
        if not found:
            return covered / len(b)
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                covered += best


def test_decontamination(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for d, t in docs:
        for k, s in items:
            if (c := brute_coverage(t, s, 8)) >= 0.6:
                want.append((d, k, round(c, 6)))
    got = [(r.doc_id, r.item_id, r.coverage) for r in QUERIES["op10_decontamination"](spark, SF).collect()]
    assert order(got) == order(want) and want


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() on a small corpus: the language model's verdicts as they are, all other stages by brute force."""
    columns = corpus_pipeline.COLUMNS
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*columns)
    rows = [tuple(r) for r in real.collect()]
    rows += [(None, "12 34 56", None, "s", 8), (5, rows[5][1], rows[5][2], "s", 1), (None, rows[9][1], rows[9][2], "s", 1), (9001, None, None, None, None), (9002, "", None, None, 0)]
    spark.createDataFrame(rows, real.schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    verdict = {}
    for r in language.identify(corpus_pipeline.with_key(given), key_col="_key").collect():
        verdict[(r["_key"].id, r["_key"].h, r["_key"].h2)] = r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE
    keep = [(r.doc_id, r.text) for r in corpus_pipeline.with_key(given).collect() if verdict[(r["_key"].id, r["_key"].h, r["_key"].h2)]]
    assert 0 < len(keep) < len(rows)
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")] for _, t in keep]
    n = Counter(k for ks in keys for k in set(ks) if k)
    keep = [(d, "\n".join(x for x, k in zip(t.split("\n"), ks) if n[k] < 10)) for (d, t), ks in zip(keep, keys)]
    keep.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    root, _ = groups([fingerprint(t) for _, t in keep])
    first = {}
    for i, r in enumerate(root):
        first.setdefault(r, i)
    keep = [keep[i] for i in sorted(first.values())]
    items = [r.text for r in bench.collect()]
    keep = [(d, t) for d, t in keep if not any(brute_coverage(t, s, 8) >= 0.6 for s in items)]
    want = Counter(d for d, _ in keep)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == want
    _, coded = libraries(keep)
    by = lambda rows: order(tuple(r)[:4] for r in rows if want[tuple(r)[0]] == 1 and tuple(r)[0] is not None)
    assert by((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == by(coded)


def test_base_failed_follows_its_counts(spark, docs):
    for r in QUERIES["op1_quality_rules"](spark, SF).collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
    good = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in QUERIES["op1_quality_rules"](spark, SF).collect()}
    right = [kept[d] for d, q in good.items() if q == 1]
    assert sum(right) >= 0.9 * len(right)


def test_posterior_against_brute_force():
    """The EM of the rules gives the posterior that Bayes' rule has for its own estimates."""
    from lithos.llm import quality

    table = [((1, 1, 0), 500), ((1, -1, 1), 60), ((-1, -1, 1), 40), ((-1, -1, -1), 80), ((0, 0, 0), 20)]
    m = quality.estimate(table)
    good = {}
    for votes, _ in table:
        a = m["prior"] * np.prod([m["given_good"][i][v + 1] for i, v in enumerate(votes)])
        b = (1 - m["prior"]) * np.prod([m["given_bad"][i][v + 1] for i, v in enumerate(votes)])
        good[votes] = a / (a + b)
    assert good[(1, 1, 0)] > 0.9 > 0.1 > good[(-1, -1, -1)]
    total = sum(n for _, n in table)
    assert abs(sum(good[v] * n for v, n in table) / total - m["prior"]) < 0.01


def test_words_are_the_contract():
    assert re.findall("[^\x20\x09-\x0d]+", "a\x1fb\x85c d") == ["a\x1fb\x85c", "d"] == WORD.findall("a\x1fb\x85c d")
