"""Texts on which polynomial hashes modulo 2**64 collide must not be taken for each other."""

import pyarrow as pa
import pytest

from lithos.llm import pieces, quality, substring, token_count
from lithos.llm.queries import tokenizer
from test_corpus import brute_windows, order


def thue_morse(n, one="a", two="b"):
    s = one
    flip = str.maketrans(one + two, two + one)
    while len(s) < n:
        s += s.translate(flip)
    return s, s.translate(flip)


SIZES = [256, 512, 2048, 8192]


@pytest.mark.parametrize("n", SIZES)
def test_libraries_agree(n):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [*thue_morse(n), *thue_morse(n, "b", "c")]
    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        table = pieces.ChunkTable(f.read())
    assert [(ids + b" 2")[1:].decode() for _, ids, _ in table.encode(pa.array(texts))] == [" ".join(map(str, sp.encode(t, add_eos=True))) for t in texts]
    assert [t.decode() for _, _, t in table.encode(pa.array(texts))] == texts
    with open(tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    want = [len(e.ids) for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(spec, token_count.proved(spec)).count(pa.array(texts)).tolist() == want


def test_lines_and_windows(spark):
    pairs = [thue_morse(n) for n in SIZES]
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_dup_lines == 0 for r in got)
    rows = [(2 * i + j, " ".join([w, *"x y z"])) for i, p in enumerate(pairs) for j, w in enumerate(p)]
    rows += [(100, rows[-1][1]), (101, rows[0][1])]
    words = [(200 + j, " ".join(w)) for j, w in enumerate(thue_morse(512))]
    got = substring.drop_repeats(spark.createDataFrame(rows + words, "doc_id long, text string"), 4, 2).collect()
    assert order(tuple(r) for r in got) == brute_windows(rows + words, 4)
