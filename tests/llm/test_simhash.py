import random

import numpy as np
import pytest
import xxhash

from ravelin.llm import simhash as sh
from tests.llm.helpers import documents, rows


def by_definition(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def corpus():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = ["", None, "one", "TWO words", "two WORDS", " \t\n ", "ÄÖ ü É"]
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([4, 30, 200]))]
        texts.append(" ".join(base))
        for _ in range(4):
            new = list(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                new[r.randrange(len(new))] = r.choice(vocab)
            texts.append("  ".join(new))
    return texts


def test_fingerprint_by_definition():
    for t in corpus() + ["x y z " * 5000]:
        assert sh.fingerprint(t) == by_definition(t)


@pytest.mark.parametrize("block", [1500, 3])
def test_components_against_brute_force(spark, block):
    texts = corpus()
    got = rows(sh.near_duplicates(documents(spark, texts, extra=True), block_rows=block), "doc_id", "fp", "component_id")
    fps = [sh.fingerprint(t) for t in texts]
    assert sorted(got) == sorted((i, int(np.uint64(f).view(np.int64)), c) for (i, f), c in zip(enumerate(fps), brute_components(fps), strict=True))


def test_random_bits_lose_no_link(spark):
    r = random.Random(5)
    fps = []
    for _ in range(60):
        f = r.getrandbits(64)
        for _ in range(6):
            for b in r.sample(range(64), r.choice([1, 2, 3, 4])):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    for block in (1500, 2):
        edges = sh.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block_rows=block)
        found = {r["node"]: r["root"] for r in sh.components(edges).collect()}
        want = brute_components([f for _, f in sorted(zip(signed, fps, strict=True))])
        order = sorted(signed)
        assert {f: order[w] for f, w in zip(order, want, strict=True) if order.count(f) and want.count(w) > 1} == found


def test_deduplicate_and_defined_cases(spark):
    same = "a b c d e f g h i j k"
    df = documents(spark, [same, same, "another text altogether with other words", None, ""], extra=True)
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == [(0,), (2,), (3,)]
    twice = df.union(df)
    assert rows(sh.deduplicate(twice), "doc_id") == [(0,), (2,), (3,)]
    assert sh.simhash_query(df.limit(0)).count() == 0
    assert rows(sh.simhash_query(df), "doc_id", "component_id") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)]


def test_deduplicate_keeps_unlinked_rows_of_one_id(spark):
    """Rows that share an id or have none go only if their texts are linked."""
    rows_ = [(1, "a b c d"), (1, "e f g h"), (1, "a b c d"), (None, "i j k l"), (None, "i j k l"), (None, "e f g h"), (7, "i j k l"), (None, None), (None, "m n o p")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS __did", "2 AS __th", "3 AS fp")
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id", "text") == sorted([(1, "a b c d"), (1, "e f g h"), (7, "i j k l"), (None, None), (None, "m n o p")], key=repr)
