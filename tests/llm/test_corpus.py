"""Corpus operators against brute force, libraries or held-out labels, and on awkward tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lithos.llm import language, licenses, lines, pieces, quality, simhash, substring, suffix_levels, tiling, token_count
from lithos.llm.queries import tokenizer

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"
ODD = [(None, "null id here"), (200, None), (201, ""), (202, " \n\t "), (203, "a " * 300), (204, "aaaa" * 100), (205, "é" * 40), (1, "x y z"), (1, "x y z")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def small():
    rnd = random.Random(3)
    voc = ["a", "bb", "ccc", "dé", "E", "the", "f."]
    return [(i, "".join(rnd.choice(voc) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.randint(0, 60)))) for i in range(90)] + ODD


def frame(spark, rows):
    """Extra columns whose names clash with those the operators use inside."""
    wide = [(*r, 7, "k", [1]) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, _id int, kg string, drop array<int>").repartition(3)


def brute_windows(rows, w):
    toks = [WORD.findall(t or "") for _, t in rows]
    ids = [-(2**63) if d is None else d for d, _ in rows]
    first = {}
    for d, x in zip(ids, toks):
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, x, (raw, _) in zip(ids, toks, rows):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if first[tuple(x[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out.append((raw, len(x), sum(gone), sha(" ".join(a for a, g in zip(x, gone) if not g).encode())))
    return order(out)


def brute_bytes(rows, w):
    texts = [(t or "").encode() for _, t in rows]
    c = collections.Counter(b[i : i + w] for b in texts for i in range(len(b) - w + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if c[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return order(out)


@pytest.mark.parametrize("window,seed", [(4, 2), (5, 4), (13, 4)])
def test_substring_dedup(spark, small, window, seed):
    got = substring.drop_repeats(frame(spark, small), window, seed).collect()
    assert order(tuple(r) for r in got) == brute_windows(small, window)


@pytest.mark.parametrize("window,seed,batches", [(9, 3, 1), (40, 6, 2), (12, 5, 5)])
def test_suffix_levels(spark, small, window, seed, batches):
    got = suffix_levels.drop_repeated_bytes(frame(spark, small), window, seed, batches).collect()
    assert order(tuple(r) for r in got) == brute_bytes(small, window)


def test_suffix_levels_merge_geometrically(spark):
    texts = ["".join(random.Random(i).choices("abcdefgh", k=200)) for i in range(7)]
    texts[5] = texts[2][50:150] + texts[5]
    index, taken = suffix_levels.SuffixLevels(spark, 20, 8, buckets=4), []
    for t in texts:
        index.append(spark.createDataFrame([(t,)], "text string"))
        taken.append([x is not None for x in index.levels])
    assert taken == [[True], [False, True], [True, True], [False, False, True], [True, False, True], [False, True, True], [True, True, True]]
    # each level: alphabetical in its buckets, every beginning once, with its count in the level's batches
    for name in index.arrays():
        parts = [[bytes(r.head) for r in p] for p in spark.table(name).rdd.glom().collect()]
        assert all(p == sorted(set(p)) for p in parts)
    heads = collections.Counter(bytes(r.head) for t in texts for r in suffix_levels.beginnings(spark.createDataFrame([(t,)], "text string"), 20, 8).collect())
    assert sum(r.c for n in index.arrays() for r in spark.table(n).collect()) == sum(heads.values())
    assert index.matched().count() == sum(c > 1 for c in heads.values()) > 0
    index.close()


@pytest.mark.parametrize("tile", [4096, 3])
def test_near_duplicates(spark, small, tile):
    def print_of(t):
        w = WORD.findall(lower(t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f, n = [print_of(t) for _, t in small], len(small)
    near = [[j for j in range(n) if j != i and (f[i] ^ f[j]).bit_count() <= 4] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        want.append((small[i][0], f"{f[i]:016x}", len(near[i]), min((small[j][0] for j in seen), key=lambda d: -(2**63) if d is None else d) if None not in {small[j][0] for j in seen} else None))
    got = simhash.near_duplicates(frame(spark, small), tile=tile).collect()
    assert order(tuple(r) for r in got) == order(want)


def brute_lines(rows, threshold):
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in rows]
    n = collections.Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (d, t), ks in zip(rows, keys):
        keep = [x for x, k in zip((t or "").split("\n"), ks) if n[k] < threshold]
        out.append((d, len(ks), len(ks) - len(keep), sha("\n".join(keep).encode())))
    return order(out)


def test_line_dedup_and_its_reversal(spark, small):
    got = lines.drop_common_lines(frame(spark, small), threshold=3).collect()
    assert order(tuple(r) for r in got) == brute_lines(small, 3)
    index = lines.LineIndex(spark, threshold=3)
    index.insert(frame(spark, small[:40]))
    index.insert(frame(spark, small[40:]))
    index.delete(frame(spark, small[:40]))
    left = small[40:]
    got = lines.drop_common_lines(frame(spark, left), index=index).collect()
    assert order(tuple(r) for r in got) == brute_lines(left, 3)


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.int64).astype(np.uint64)
    f = lines.CuckooFilter.build(h)
    assert f.contains(h).all()
    f.remove(h[:2500])
    assert f.contains(h[2500:]).all() and f.contains(h[:2500]).mean() < 0.02


def fuzz(n=3000):
    rnd = random.Random(2)
    pool = [chr(x) for x in [*range(0, 0x300), 0x1680, 0x2003, 0x2028, 0x2581, 0x3000, 0xFEFF, 0x1F600, 0x4E2D, 0x0660, 0x2160]] + ["<|endoftext|>", "'s", "'re", " ", "  ", "\n", " the", "don't"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", "x" * 5000, " " * 3000]


@pytest.mark.parametrize("bits", [21, 17])
def test_token_counts(bits):
    from tokenizers import Tokenizer

    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    texts = fuzz()
    want = [len(e.ids) for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(spec, token_count.proved(spec), bits).count(pa.array(texts)).tolist() == want


@pytest.mark.parametrize("bits,budget", [(20, 1 << 20), (6, 1 << 12)])
def test_pieces(bits, budget):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        table = pieces.ChunkTable(f.read(), bits, budget)
    texts = fuzz(1500)
    got = [((ids + b" 2")[1:].decode(), t.decode()) for _, ids, t in table.encode(pa.array([x.replace("▁", " ") for x in texts]))]
    assert got == [(" ".join(map(str, ids)), sp.decode(ids)) for ids in (sp.encode(x, add_eos=True) for x in texts)]


def test_quality_base_counts(spark, small):
    def base(t):
        t = t or ""
        w, seen, dup = WORD.findall(t), set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {x for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for x in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(hit)

    rows = quality.score(frame(spark, small)).collect()
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == order((d, *base(t)) for d, t in small)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in rows)


def test_quality_em_finds_the_sharp_rule():
    rnd = random.Random(5)
    seen = collections.Counter()
    for _ in range(5000):
        good = rnd.random() < 0.8
        seen[tuple((1 if good else -1) if rnd.random() < p else (-1 if good else 1) for p in (0.95, 0.9, 0.7))] += 1
    acc = quality.estimate(sorted(seen.items()))["accuracy"]
    assert acc[0] > acc[2] and acc[1] > acc[2]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs, per_label=60).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 — 3", "en"), (None, "the and of", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd).collect()}
    assert got[1] == ("und", 0.0) and got[2] == ("und", 0.0)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    pot, move, start = rng.standard_normal((2, 4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    got = language.forward_backward(pot, np.array([4, 2]), move, start)
    for c, n in ((0, 4), (1, 2)):
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            s = start[path[0]] + sum(pot[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
            for t, y in enumerate(path):
                want[t, y] += np.exp(s)
        assert np.allclose(got[c, :n], want / want.sum(axis=1, keepdims=True))


def test_license_base_detections(spark):
    texts = ["CC-BY and cc by; General\nPublic License. cc bye", "All rights reserved.", "", None, "écc by", "Released under the MIT License."]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].last_word, rows[0].base_labels) == (3, 0, 5, "cc-by,gpl")
    assert rows[1].base_labels == "reserved" and rows[3].n_words == 0 and rows[4].n_base == 0 and rows[5].labels == "mit"
    assert [d[3] for d in licenses.detections("spdx-license-identifier: gpl-3.0-only")] == ["gpl-3.0"]


def test_license_base_phrases_alone(spark):
    """Any run of non-word characters may stand between the words, whatever else the text holds."""
    cases = [(gap.join(words), label) for words, label in ((["CC", "BY"], "cc-by"), (["General", "Public", "License"], "gpl"), (["All", "rights", "reserved"], "reserved")) for gap in (" ", "  ", "\n", "-", ", ", "\n * ")]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, [(i, f"See: {t}.") for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, label) in enumerate(cases):
        r = rows[i]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (1, 1, 1, label), text
        assert label in r.labels.split(",") and r.score >= 0.9 - 1e-9


def test_license_rules_match_wrapped_texts():
    for text, label in (
        ("redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"), ("you can redistribute it and/or modify\n * it under the terms of the gnu lesser", "lgpl"),
        ("# the gnu general public\n#license version  2", "gpl-2.0"), ("// x *\n// gnu general *\r\n\n// public license,\tversion 3", "gpl-3.0"), ("mit\u00a0license", "mit"),
    ):
        for edge in ("", "ü\n\n *  "):
            found = licenses.detections(edge + text + "\n end")
            assert label in [d[3] for d in found], text
    text = "é\n * \n * see the gnu  general\n * public license.\n"
    ((start, end, *_),) = licenses.detections(text)
    assert text[start:end] == "gnu  general\n * public license"
    assert licenses.detections("mit * license, general ; public license") == []


def test_tiling_catches_reordered_passages(spark):
    item = " ".join(f"w{i}" for i in range(40))
    w = item.split()
    docs = [(1, "x y " + " ".join(w[20:] + ["gap"] + w[:20]).upper() + "."), (2, " ".join(w[::-1])), (3, None), (4, ""), (5, item), (5, item)]
    bench = spark.createDataFrame([(9, item), (8, "too short"), (7, None)], "item_id long, text string")
    rows = tiling.contaminated(frame(spark, docs), bench).collect()
    assert order((r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in rows) == [(1, 9, 2, 1.0), (5, 9, 1, 1.0), (5, 9, 1, 1.0)]


def test_tiling_of_short_items(spark):
    w = [f"w{i}" for i in range(15)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "the capital of France"), (3, "a b c d e f g h")], "item_id long, text string")
    docs = [(1, " ".join(["x", *w[7:], "y", *w[:7]])), (2, " ".join([*w[:7], "new", *w[8:]])), (3, "What is the Capital of France?"), (4, "the capital of Spain, of France"), (5, "a b c d X f g h"), (6, "a b c X d e X f X g h"), (None, "w1 w2 w3 w4 w5 w6 w7 w8")]
    rows = tiling.contaminated(frame(spark, docs), bench).collect()
    assert order((r.doc_id, r.item_id, r.n_covered) for r in rows) == [(1, 1, 15), (2, 1, 14), (3, 2, 4), (5, 3, 7)]


def test_empty_tables(spark):
    none = frame(spark, []) if False else spark.createDataFrame([], "doc_id long, text string, lang string")
    path, bench = tokenizer("piece_bpe_32k.model"), spark.createDataFrame([], "item_id long, text string")
    for df in (quality.score(none), simhash.near_duplicates(none), token_count.count_tokens(none, tokenizer("byte_bpe_50k.json")), substring.drop_repeats(none), suffix_levels.drop_repeated_bytes(none), lines.drop_common_lines(none), pieces.encode_decode(none, path), language.identify(none), licenses.scan_licenses(none), tiling.contaminated(none, bench)):
        assert df.count() == 0


def kept(df):
    return order((r.doc_id, r.text) for r in df.collect())


def test_pipeline_stages_drop_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdef"]
    rows = [(None, words[0]), (None, words[0]), (None, words[1]), (5, words[2]), (5, words[2]), (5, words[3]), (9, words[4]), (4, words[4]), (7, words[1]), (8, words[5])]
    want = [(None, words[0]), (None, words[1]), (5, words[2]), (5, words[3]), (4, words[4]), (8, words[5])]
    assert kept(corpus_pipeline.near_duplicates(spark, docs(rows), "")) == order(want)
    spark.createDataFrame([(1, words[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, "x " + words[0]), (None, words[1]), (5, words[0]), (5, words[2]), (5, words[2]), (None, None)]
    assert kept(corpus_pipeline.decontamination(spark, docs(rows), str(tmp_path))) == order([rows[1], *rows[3:]])
    real = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    one = real.where("lang = 'en'").orderBy("doc_id").first()
    more = docs([(one.doc_id, "12 34"), (None, "56 78"), (None, one.text), (None, None)])
    before, after = kept(real), kept(corpus_pipeline.language_id(spark, real.unionByName(more), SF))
    assert (one.doc_id, one.text) in after and (None, one.text) in after and not {(one.doc_id, "12 34"), (None, "56 78"), (None, None)} & set(after)
    assert len(after) <= len(before) + 1


def test_near_duplicates_all_tiles_alike(spark):
    """The quadratic comparison of all tiles and the one by cells find the same links, in small and large tiles."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(20):
            x = b
            for bit in rng.choice(62, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4}
    rows = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    for args in ({}, {"tile": 8}, {"cells": False}, {"cells": False, "tile": 16}):
        got = [(r.a, r.b) for r in simhash.links(rows, 4, **args).collect()]
        assert len(got) == len(set(got)) and set(got) == want, args


def test_line_index_filters_in_groups(spark, small, monkeypatch):
    """More filters than one broadcast may hold: the same rows."""
    monkeypatch.setattr(lines, "FILTER_BYTES", 64)
    got = lines.drop_common_lines(frame(spark, small), threshold=2).collect()
    assert order(tuple(r) for r in got) == brute_lines(small, 2)


def test_line_rewrite_keeps_columns(spark, small):
    rows = spark.createDataFrame([(*r, 7, "k", [1]) for r in small], "doc_id long, text string, _did int, `a.b` string, drop array<int>")
    index = lines.LineIndex(spark, threshold=3)
    index.insert(rows)
    out = lines.rewrite(rows, index)
    assert out.columns == rows.columns
    got = order((r.doc_id, None if r.text is None else sha(r.text.encode()), r._did, r["a.b"], r["drop"]) for r in out.collect())
    keys = [[lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for _, t in small]
    n = collections.Counter(k for ks in keys for k in set(ks) if k)
    want = [(d, None if t is None else sha("\n".join(x for x, k in zip(t.split("\n"), ks) if n[k] < 3).encode()), 7, "k", [1]) for (d, t), ks in zip(small, keys)]
    assert got == order(want)


def brute_tiles(a, b, match):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = match, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                out.append((i, j, best))


def test_tiles_against_brute_force():
    rnd = random.Random(8)
    for case in range(60):
        k = rnd.choice([2, 3, 8])
        a, b = [[rnd.randrange(k) for _ in range(rnd.randint(0, 40))] for _ in range(2)]
        hashed = [np.array([hash((7, x)) & (2**63 - 1) for x in s], np.uint64) for s in (a, b)]
        assert tiling.tile(*hashed, 3) == brute_tiles(a, b, 3), case


def test_tiles_of_one_word_repeated():
    same = np.full(20000, 5, np.uint64)
    assert tiling.tile(same, same[:3000], 8) == [(0, 0, 3000)]


def test_license_suppression_against_pairs():
    rnd = random.Random(6)
    words = ["mit license", "apache license 2.0", "gnu general public license version 2", "cc by sa 4.0", "all rights reserved", "licensed under the mit license", "spdx-license-identifier: mit", "bsd license", "x"]
    for _ in range(60):
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))
        every, auto = licenses.compiled()
        flat, here, there = licenses.flattened(text)
        tried = {i for _, (_, at) in auto.iter(flat) for i in at if "licen" in flat or not every[i][5]}
        found = sorted({(m.start(), m.end(), every[i][1], every[i][0], every[i][4], i) for i in tried for m in every[i][3].finditer(flat) if m.end() > m.start()}, key=lambda d: (d[2], d[0] - d[1], d[0], d[5]))
        kept = []
        for d in found:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert sorted((d[2], d[3], d[4]) for d in kept) == sorted(d[2:] for d in licenses.detections(text))


def test_license_gate_lets_all_detections_pass(spark):
    """Whatever detections() finds, the gate on the raw text lets through."""
    rnd = random.Random(12)
    words = ["mit-0", "mit license", "cc by", "cc-by-sa 4.0", "provided as is", "in the\n * public domain", "copyright (c) 2020", "(c) 2021", "spdx-license-identifier:\tisc", "tex\n# live", "do what the fun you want to\npublic license", "all rights\n// reserved", "no rights reserved", "cc0", "dual-licensed", "fair use", "apache.org/licenses/license-2.0", "gpl v3", "x", "der mit", "© 2020"]
    texts = [rnd.choice([" ", "\n", "\n * "]).join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(400)]
    assert sum(map(bool, map(licenses.detections, texts))) > 300
    assert all(licenses.may_match(t) for t in texts if licenses.detections(t))
    assert not licenses.may_match("keit mit einer, der accord")


def test_license_base_columns_against_brute_force(spark):
    rnd = random.Random(9)
    voc = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "x1", "é"]
    rows = [(i, "".join(rnd.choice(voc).upper() + rnd.choice([" ", "-", "\n", ", ", "...", "_"]) for _ in range(rnd.randint(0, 40)))) for i in range(150)] + ODD
    got = {}
    for r in licenses.scan_licenses(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
    want = {}
    for d, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
        at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.setdefault(d, []).append((len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert {k: order(v) for k, v in got.items()} == {k: order(v) for k, v in want.items()}


def test_forward_backward_over_blocks():
    """A chain cut into blocks has the marginals of the whole chain; expected transitions are exact."""
    rng = np.random.default_rng(1)
    n, total, block = 3, 11, 4
    pot, move, start = 3 * rng.standard_normal((1, total, n)), rng.standard_normal((n, n)), rng.standard_normal(n)
    want, both = language.forward_backward(pot, np.array([total]), move, start, pairs=True)
    cut = np.zeros((4, block, n))
    for i in range(total):
        cut[i // block, i % block] = pot[0, i]
    cut[3, :2] = pot[0, :2]
    got = language.forward_backward(cut, np.array([4, 4, 3, 2]), move, start, np.array([True, False, False, True]))
    assert np.allclose(np.concatenate([got[0], got[1], got[2][:3]]), want[0])
    assert np.allclose(got[3][:2], language.forward_backward(pot[:, :2], np.array([2]), move, start)[0])
    short = pot[:, :4]
    _, both = language.forward_backward(short, np.array([4]), move, start, pairs=True)
    brute, z = np.zeros((n, n)), 0.0
    for path in np.ndindex(*[n] * 4):
        w = np.exp(start[path[0]] + sum(short[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        z += w
        for a, b in zip(path, path[1:]):
            brute[a, b] += w
    assert np.allclose(both, brute / z)


def test_language_sample_is_bounded(spark):
    """Copies count once, and no label is lost because its texts are copies."""
    rows = [(i, "the same words again and again", "en") for i in range(3000)] + [(i, f"mot {''.join(chr(97 + int(c)) for c in str(i))} de la liste", "fr") for i in range(3000, 3500)]
    got = language.snippets_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "text", 50)
    assert {x for x, _ in got} == {"en", "fr"} and sum(x == "en" for x, _ in got) == 1 and sum(x == "fr" for x, _ in got) == 50


def test_language_of_code_switched_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and length(text) > 600")
    held = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"
    by = {r.lang: r.text for r in docs.where(held).orderBy("doc_id").collect()}
    (a, x), (b, y) = sorted(by.items())[:2]
    mixed = " ".join(x.split()[:60] + y.split()[:60])
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1, mixed, None), (-2, mixed * 300, None), (-1, mixed, None)], "doc_id long, text string, lang string"))
    rows = language.identify(more.withColumns({"id": F.lit(1), "held_out": F.lit("x"), "label": F.lit(2)}), per_label=60, segments=True).where("doc_id < 0").collect()
    for r in rows:
        assert {s.lang for s in r.segments} == {a, b} and r.lang_pred in (a, b)
        if r.doc_id == -1:
            right = sum(s.n for s in r.segments if (s.lang == a) == (s.first < 58))
            assert right >= 0.85 * sum(s.n for s in r.segments)
