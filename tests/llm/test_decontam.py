import math
import random
from collections import Counter

import numpy as np

from ravelin.llm import decontam as dc
from tests.llm.helpers import documents, rows

R = random.Random(6)
VOCAB = [f"w{i}" for i in range(60)] + [f"rare{i}" for i in range(900)]


def sentence(n):
    return " ".join(R.choice(VOCAB) for _ in range(n)).capitalize() + "."


ITEMS = [(i, " ".join(sentence(R.randint(4, 12)) for _ in range(R.randint(1, 4)))) for i in range(70)]


def test_search_loses_no_pair():
    index = dc.Index(ITEMS)
    texts = [" ".join(R.choice(ITEMS)[1].split()[: R.randint(3, 40)] + [R.choice(VOCAB) for _ in range(R.randint(0, 30))]) for _ in range(60)]
    tok = [np.array([index.terms.get(w, len(index.terms)) for w in dc.words(t)]) for t in texts]
    ends = np.cumsum([len(t) for t in tok])
    for threshold in (0.2, 0.6):
        want = set()
        for p, t in enumerate(tok):
            held = set(t.tolist())
            want |= {(p, i) for i, terms in enumerate(index.held) if sum(x for term, x in terms.items() if term in held) >= threshold - 1e-9}
        got = {(p, i): s for kind in range(len(index.classes)) for p, i, s in index.search(np.concatenate(tok), ends - [len(t) for t in tok], ends, threshold, kind)}
        assert got.keys() == want and len(index.classes) > 2
        for (p, i), s in got.items():
            assert abs(s - sum(x for term, x in index.held[i].items() if term in set(tok[p].tolist()))) < 1e-9


def brute_force(texts, items):
    """(text, item_id) -> (score, question, answer) by looking at every span of
    every text for every item."""
    counts = {i: Counter(dc.words(t)) for i, t in items if dc.words(t)}
    n, mean = len(counts), sum(sum(c.values()) for c in counts.values()) / max(1, len(counts))
    out = {}
    for i, text in items:
        if i not in counts:
            continue
        size = sum(counts[i].values())
        weight = {}
        for w, f in counts[i].items():
            df = sum(w in c for c in counts.values())
            weight[w] = math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (dc.K1 + 1) / (f + dc.K1 * (1 - dc.B + dc.B * size / mean))
        full = sum(weight.values())
        q, a = dc.halves(text)
        for d, t in enumerate(texts):
            w = dc.words(t)
            for at in range(max(1, len(w) - dc.span_of(size) + 1) if w else 0):
                held = set(w[at : at + dc.span_of(size)])
                pairs = set(zip(dc.words(text), dc.words(text)[1:]))
                if len(pairs & set(zip(w[at : at + dc.span_of(size)], w[at + 1 : at + dc.span_of(size)]))) < dc.PAIRS * len(pairs):
                    continue
                score = sum(weight[x] for x in held if x in weight) / full
                if score >= dc.THRESHOLD - 1e-9 and len(held & q) >= dc.enough(len(q)) and len(held & a) >= dc.enough(len(a)) and score > out.get((d, i), (0,))[0] + 1e-9:
                    out[d, i] = (score, len(held & q) / len(q), len(held & a) / len(a))
    return out


def quotes():
    r = random.Random(9)
    texts = []
    for k in range(40):
        w = dc.words(ITEMS[r.randrange(70)][1])
        for _ in range(int(len(w) * 0.1 * (k % 4))):  # up to 30 % of the words changed
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append(" ".join([r.choice(VOCAB) for _ in range(r.randint(0, 90))] + w + [r.choice(VOCAB) for _ in range(r.randint(0, 90))]))
    return [*texts, None, "", "w1"]


def test_whole_query_against_brute_force(spark):
    items = [*ITEMS, (70, sentence(400)), (71, "rare1"), (72, None)]
    texts = quotes()
    want = brute_force(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1000, 9):  # scores don't depend on the parts
        got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in dc.leaks(documents(spark, texts), bench, most).collect()}
        assert got.keys() == want.keys() and len(want) > 20
        assert all(abs(x - y) < 1e-9 for k in got for x, y in zip(got[k][:1], want[k][:1], strict=True))


def test_one_long_item_makes_no_false_hits():
    r = random.Random(1)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(15))) for i in range(200)] + [(200, " ".join(r.choice(vocab) for _ in range(4000)))]
    texts = [" ".join(r.choice(vocab) for _ in range(8000)) for _ in range(3)]
    assert dc.Index(items).leaks(texts) == [[], [], []]


def test_leaks(spark):
    filler = [sentence(200) for _ in range(6)]
    item = ITEMS[5][1]
    edited = item.upper().replace(".", " !")
    texts = [*filler, f"{filler[0]} {item} {filler[1]}", f"{filler[2]}\n{edited}", item[: len(item) // 3], None, "", " ".join([filler[3]] * 60) + item]
    bench = spark.createDataFrame([*ITEMS, (500, None), (501, ""), (502, item)], "item_id long, text string")
    docs = documents(spark, texts, extra=True)
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()}
    assert got == {(d, i) for d in (6, 7, 11) for i in (5, 502)}
    clean = dc.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert {r[0] for r in rows(clean, "doc_id")} == set(range(12)) - {6, 7, 11}
    assert dc.leaks(docs.union(docs), bench).count() == 6


def test_parts_and_empty(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, [t for _, t in ITEMS[:5]])
    assert sum(len(i.ids) for i in dc.indexes(bench, 20)) == 70
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()} >= {(i, i) for i in range(5)}
    assert dc.leaks(docs.limit(0), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs, bench.limit(0)).count() == 5
