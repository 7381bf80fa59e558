import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ravelin.llm import wavelet as wv
from tests.llm.helpers import documents

TEXTS = ["", None, "Hello world", "two  spaces and\ttab", "line\nline\n\nend\n", " lead", "trail ", "word, word. it's we're <|endoftext|> \x00 ü", "日本語 text with nbsp here", "a\nb c\nd", "x" * 3000, "the cat sat. " * 400, "cafe, naïve. 3,000.5 (a, b.)"]


def test_matrix_against_arrays():
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 511, 512, 513, 3000):
        v = r.integers(0, 1 << 10, n).astype(np.uint16)
        v[: n // 2] = v[: n // 2] % 5
        m = wv.read_image(wv.write_image(v, 10, np.arange(1), np.ones(1, bool), np.array([n])))[0]
        assert (m.decode() == v).all()
        for i in range(0, n, 37):
            assert m.access(i) == v[i]
            assert m.rank(3, i) == (v[:i] == 3).sum()
        for value in (0, 3, 4, 1023, 5000):
            assert m.count(value) == (v == value).sum()
            assert m.occurrences(value) == np.flatnonzero(v == value).tolist()
    with pytest.raises(IndexError):
        m.access(3000)


def encoded(enc, texts):
    ids, lengths = enc.encode(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]


def test_words_equal_whole_texts():
    enc, tok = wv.Encoder(wv.vocabulary_path()), Tokenizer.from_file(wv.vocabulary_path())
    texts = [t or "" for t in TEXTS] * 2 + ["\x01", "a \x02 b", "\x03" + "1", "\u2003x", "\x1c"]
    want = [[*tok.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert encoded(enc, texts) == want == [x for t in texts for x in encoded(enc, [t])]
    small = wv.Encoder(wv.vocabulary_path(), kept=3)
    assert [encoded(small, [t])[0] for t in texts] == want


@pytest.mark.parametrize("shard", [5, 2_000_000])
def test_query_against_library(spark, shard):
    tok = Tokenizer.from_file(wv.vocabulary_path())
    got = sorted(tuple(r) for r in wv.read_documents(wv.write_shards(documents(spark, TEXTS, extra=True), shard_tokens=shard)).collect())
    want, at = [], 0
    for i, t in enumerate(TEXTS):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_defined_cases(spark):
    assert wv.wavelet_query(documents(spark, ["a"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "x"), (2, "b"), (2, "b"), (2, "a")], "doc_id long, text string")
    got = wv.wavelet_query(df).collect()
    assert sorted(r["start"] for r in got) == [0, 2, 4, 6] and [r["start"] for r in got if r["doc_id"] is None] == [0]


def test_few_kept_words_change_nothing(spark):
    texts = [" ".join(f"w{i * 37 + k}, x{k}." for k in range(40)) + "\nend" for i in range(60)] + [None, ""]
    docs = documents(spark, texts)
    enc = wv.Encoder(wv.vocabulary_path(), kept=200)
    for i in range(0, 60, 5):
        enc.encode(pa.array(texts[i : i + 5]))
    assert len(enc.known) + len(enc.older) < 1200  # two generations, none of more than half and a batch
    assert sorted(wv.wavelet_query(docs, kept_words=200).collect()) == sorted(wv.wavelet_query(docs).collect())
