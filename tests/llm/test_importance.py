"""Importance resampling against its definition, word by word."""

import hashlib
import math
import re
import zlib

from ravelin.llm import importance as im
from tests.llm.helpers import documents, rows

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    return [zlib.crc32(g.encode()) % 10_000 for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]


def brute(docs, target):
    """docs: (doc_id, text); ranks by a sort of all."""
    s, t = [0] * 10_000, [0] * 10_000
    for _, text in docs:
        for b in grams(text):
            s[b] += 1
    for text in target:
        for b in grams(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1.0) * (sum(s) + 10_000.0) / ((x + 1.0) * (sum(t) + 10_000.0)))) for x, y in zip(s, t, strict=True)]
    out = []
    for i, text in docs:
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(g), weight, score, None, len(words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus():
    texts = [f"Das Haus {i} steht am See, und der Wind weht; " * (i % 7 + 1) + f"word{i} ÄRGER Straße" for i in range(120)]
    texts += [None, "", " .,;! ", "one", "One ONE one", "ÀB àb İi", "a\x00b\x7fc", "x" * 40_000, "lorem ipsum " * 60_000, "tie tie " * 15, "tie tie " * 15]
    return texts


TARGET = ["The wind blows over the lake", "das Haus am See und der Wind", None, ""]


def query(spark, df):
    bench = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TARGET)], "item_id long, text string, b1 int")
    return im.resample_query(df, bench)


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def test_query_equals_brute_force(spark):
    texts = corpus()
    df = documents(spark, texts, extra=True).withColumnRenamed("size", "row")
    got = query(spark, df)
    assert tuple(got.columns) == COLUMNS and {t for _, t in got.dtypes} == {"bigint"}
    assert rows(got, *COLUMNS) == brute(list(enumerate(texts)), TARGET)
    assert rows(query(spark, documents(spark, texts).repartition(9)), *COLUMNS) == rows(got, *COLUMNS)


def test_repeated_and_missing_ids(spark):
    data = [(None if i % 3 else i // 9, f"{'some words stand here ' * 6}{i % 4}") for i in range(90)]
    got = rows(query(spark, spark.createDataFrame(data, "doc_id long, text string")), *COLUMNS)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 23))
    assert sorted((r[:4] for r in got), key=repr) == sorted((r[:4] for r in brute(data, TARGET)), key=repr)


def test_empty_tables(spark):
    assert query(spark, documents(spark, ["a"]).limit(0)).count() == 0
    df = documents(spark, ["a b c " * 10, "d"])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r[1] for r in rows(im.resample_query(df, empty), *COLUMNS)] == [59, 1]


def test_more_orders(spark):
    hashed = im.hashed_ngrams(documents(spark, ["a b c", "A"]), orders=3, buckets=1000)
    want = [tuple(zlib.crc32(g) % 1000 if g else None for g in gs) for gs in ((b"a", b"a b", b"a b c"), (b"b", b"b c", None), (b"c", None, None), (b"a", None, None))]
    assert rows(hashed, "b1", "b2", "b3") == sorted(want, key=repr)
