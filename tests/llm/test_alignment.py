"""Alignment against a walk over every byte, and counts against dictionaries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ravelin.llm import alignment as al
from ravelin.llm.wavelet import vocabulary_path
from tests.llm.helpers import documents, rows

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a = Tokenizer.from_file(vocabulary_path(al.VOCABULARY_A))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary_path(al.VOCABULARY_B)), ByteLevel()


def letters():
    """Byte of each letter of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


BACK = letters()


def tokens(tokenizers, text):
    """[(id, bytes)] of both sides, or nothing where they don't spell the text."""
    a, b, _ = tokenizers
    raw = (" " + text).encode()
    x = [(i, bytes(BACK[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        y.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return (x, y) if b"".join(t for _, t in x) == raw == b"".join(t for _, t in y) else ([], [])


def walk(tokenizers, text):
    """(n_a, n_b, groups, links) of a text by looking at every byte."""
    if not text:
        return 0, 0, [], []
    x, y = tokens(tokenizers, text)
    of = []
    for side in (x, y):
        of.append([k for k, (_, t) in enumerate(side) for _ in t])
    links = sorted(set(zip(*of, strict=True)))
    ends = [set(np.cumsum([len(t) for _, t in side]).tolist()) for side in (x, y)]
    groups, here = [], ([], [])
    at = [0, 0]
    for byte in range(1, len(of[0]) + 1):
        for s, side in enumerate((x, y)):
            if byte in ends[s]:
                here[s].append(str(side[at[s]][0]))
                at[s] += 1
        if byte in ends[0] and byte in ends[1]:
            groups.append(",".join(here[0]) + "|" + ",".join(here[1]))
            here = ([], [])
    return len(x), len(y), groups, [(x[i][0], y[j][0]) for i, j in links]


def brute(tokenizers, texts):
    each = [walk(tokenizers, t) for t in texts]
    n = Counter(p for *_, links in each for p in set(links))
    most = defaultdict(int)
    for (a, _), k in n.items():
        most[a] = max(most[a], k)
    return sorted(((i, na, nb, len(g), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, (na, nb, g, links) in enumerate(each)), key=repr)


def corpus():
    rng = random.Random(11)
    some = ["The", "quick", "brown", "élan", "Straße", "naïve,", "x=1;", "don't", "3.14159", "日本語", "🙂", "über-mäßig", "foo_bar", "<s>", "<|endoftext|>", "áb", "\x00", "…", "A.B.C", "﻿", "aaaaaaaaaaaaaaaa"]
    texts = [None, "", " ", "\n", "a", "<|endoftext|>", "</s> <unk>", "a▁b", "▁", "two  spaces", " lead", "trail ", "tab\tin", "a\r\nb", "a\n\nb", "a \n b", "nb\xa0sp", "　", "x" * 5000, "one\ntwo three", "one\ntwo three"]
    for i in range(80):
        gap = (lambda: rng.choice([" ", " ", " ", "\n"])) if i % 4 else (lambda: rng.choice([" ", "  ", "\n", " \n", "\t", "\n\n\n", " "]))
        texts.append("".join(w + gap() for w in rng.choices(some, k=rng.randint(1, 60))).strip(" \n" if i % 3 else ""))
    return [*texts, "lorem ipsum dolor " * 20_000]


def test_query_equals_a_walk_over_bytes(spark, tokenizers):
    texts = corpus()
    df = documents(spark, texts, extra=True).withColumnRenamed("size", "row")
    got = al.alignment_query(df)
    assert tuple(got.columns) == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    want = brute(tokenizers, texts)
    assert rows(got, *COLUMNS) == want
    assert sum(r[1] > 0 for r in want) > 80
    some = al.alignment(documents(spark, texts).repartition(5), most_sent=40)
    assert rows(some, *COLUMNS) == want


def test_small_memory_and_small_steps_give_the_same(spark, tokenizers, monkeypatch):
    texts = corpus()[:60]
    for name, n in (("KEPT_WORDS", 10), ("DOCS_AT_ONCE", 7), ("LINKS_AT_ONCE", 50), ("PAIRS_AT_ONCE", 20)):
        monkeypatch.setattr(al, name, n)
    import pyarrow as pa

    both = al.Aligner(vocabulary_path(al.VOCABULARY_A), vocabulary_path(al.VOCABULARY_B))
    assert both.by_word
    each = [walk(tokenizers, t) for t in texts]
    for at in range(0, len(texts), 7):
        some = [t or "" for t in texts[at : at + 7]]
        counts, digests, pairs = both.documents(pa.array(some))
        assert counts.T.tolist() == [[a, b, len(g), len(n)] for a, b, g, n in each[at : at + 7]]
        assert pairs.tolist() == [a * both.many + b for *_, links in each[at : at + 7] for a, b in links]
        packed = al._by_document(counts[3], pairs)
        for image, (*_, links) in zip(packed, each[at : at + 7], strict=True):
            v, c = al.unpack(image)
            assert dict(zip(v.tolist(), c.tolist(), strict=True)) == Counter(a * both.many + b for a, b in links)
    added = Counter()
    batch = [pa.RecordBatch.from_arrays([pa.array(packed)], names=["pairs"])] * 30
    for b in al._added(iter(batch)):
        added.update(dict(zip(b.column("pair").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert added == Counter({a * both.many + b: 30 * k for (a, b), k in Counter(p for *_, links in each[56:60] for p in set(links)).items()})


def test_stabbing():
    a, b = np.array([2, 3, 1]), np.array([1, 3, 2])
    first, last = al.stab(np.cumsum(a), a, np.cumsum(b), b)
    assert first.tolist() == [0, 1, 2] and last.tolist() == [1, 2, 2]


def test_empty_tables_and_repeats(spark, tokenizers):
    assert al.alignment_query(documents(spark, ["a"]).limit(0)).count() == 0
    assert rows(al.alignment_query(documents(spark, [None, ""])), "n_a", "n_links", "count_sum", "groups_sha256") == [(0, 0, 0, "")] * 2
    same = spark.createDataFrame([(None, "a b")] * 3 + [(7, "a b")] * 2, "doc_id long, text string")
    assert {r[1:] for r in rows(al.alignment_query(same), *COLUMNS)} == {(2, 2, 2, 2, 2, 10, brute(tokenizers, ["a b"])[0][7])}
