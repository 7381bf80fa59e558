import hashlib
import re

import pytest
import xxhash

from ravelin.llm import fingerprints as fp
from tests.llm.helpers import documents

LONG = " ".join(f"word{i % 37} and{i % 11}" for i in range(400))
TEXTS = ["", None, "one", "a b c d", "a b c d e", LONG, LONG + " tail", LONG, "  Tab\tand\nline  ", "x " * 300, "Ünï cödé wörds äre cöunted by pöint nöt byte " * 5]


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def keys(text, k=fp.K, window=fp.WINDOW):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower().strip(" \t\n\x0b\x0c\r")) if w]
    if not words:
        return []
    grams = [chained(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [chained(words)]
    grams = [(h & ~((1 << 30) - 1)) | ((1 << 30) - 1 - i) for i, h in enumerate(grams)]
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        if (m := min(grams[i : i + window])) not in out:
            out.append(m)
    return out


def likeness(a, b):
    a, b = ({x >> 30 for x in s} for s in (a, b))
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def hexes(ks):
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in ks)


def expected(texts):
    out = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        own, new = keys(t), keys(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexes(own), hexes(new), likeness(own, new), likeness(own, keys(nxt))))
    return out


@pytest.mark.parametrize("texts", [TEXTS, ["alone " * 40], [None], [f"t{i} " * (i % 50) for i in range(120)]])
def test_against_brute_force(spark, texts):
    got = sorted(tuple(r) for r in fp.fingerprints_query(documents(spark, texts, extra=True)).collect())
    assert got == expected(texts)


def test_shared_passage_is_found(spark):
    shared = " ".join(f"p{i}" for i in range(fp.WINDOW + fp.K - 1))
    a, b = keys("left side words " + shared + " and more"), keys("other " * 9 + shared)
    assert {x >> 30 for x in a} & {x >> 30 for x in b}


def test_places_and_empty(spark):
    df = fp.with_fingerprint(documents(spark, [LONG]), "text", "own")
    got = df.select(fp.places(fp.F.col("own")).alias("p")).first()["p"]
    assert got == [(1 << 30) - 1 - (x & (1 << 30) - 1) for x in keys(LONG)]
    assert fp.fingerprints_query(documents(spark, TEXTS).limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "null id text here", "en", "s", 1), (3, "same id one two three four", "en", "s", 1), (3, "same id again five six", "en", "s", 1), (9, "last", "en", "s", 1)]
    got = fp.fingerprints_query(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert len(got) == 4


def test_cuts_below(spark):
    import bisect

    for n in (0, 1, 2, 7, 30):
        cuts = [3 * i for i in range(n)]
        got = fp._with_bucket(spark.range(-2, 100), cuts, "id", "b").collect()
        assert all(r["b"] == bisect.bisect_left(cuts, r["id"]) for r in got)
