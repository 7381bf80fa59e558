import random
import zlib

import numpy as np
import pytest

from ravelin.llm import toxicity as tx
from tests.llm.helpers import documents

INSULTS = ["grumblehead", "snotwaffle", "blockbrain"]


def corpus(n=400):
    r = random.Random(4)
    vocab = ["".join(r.choice(["ta", "lo", "mi", "ren", "os", "ku", "pa"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(15, 60))]
        bad = i % 4 == 0
        if bad:
            w = r.choice(INSULTS)
            at = r.randrange(1, len(w))
            words.insert(r.randrange(len(words)), [w, w.upper() + "!!", w[:at] + "*" + w[at:], w + r.choice(["s", "ish", "ery"])][r.randrange(4)])
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    return texts, labels


@pytest.fixture(scope="module")
def machine():
    texts, labels = corpus()
    return tx.Machine([sorted(tx.bag_of_words(t)) for t in texts], np.array([y for *_, y in labels]))


def test_folded_table_is_the_kernel_machine(machine):
    words = [w for t in ("grumblehead", "gr*umble-head", "tarenlo", "mi", "kupa!!", "a-b-c") for w in tx.windows(t)]
    got = machine.margins(words)
    marks = [m for m in machine.landmarks]
    gram = np.array([[tx.ssk(a, b) / np.sqrt(tx.ssk(a, a) * tx.ssk(b, b)) for b in marks] for a in words])
    w = np.linalg.lstsq(machine.marks.T.astype(float), machine.table, rcond=None)[0]
    assert np.allclose(got, gram @ w + machine.bias, atol=1e-3)


def test_expansion_is_the_kernel():
    words = [tx.windows(w)[0] for w in ("banana", "ab-ab", "xyz", "aaaa")]
    for some, _, _, self_k in tx.expand(words):
        for p, k in zip(some, self_k, strict=True):
            assert k == pytest.approx(tx.ssk(words[p], words[p]))


def test_gapped_insults(machine):
    found = machine.scores(["x grumblehead y", "GRUMBLE-HEAD!!", "g r u m b l e h e a d", "gr.umb.lehead ta", "sn0twaffle"], {})
    assert (found >= 0.5).all()
    assert (machine.scores(["ta lo mi ren", "", None, "pakulo osmi"], {}) < 0.5).all()


def test_held_out(spark):
    texts, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tx.toxicity_query(documents(spark, texts, extra=True), lab).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) / len(held) > 0.95


def test_defined_cases(spark, machine):
    docs = documents(spark, ["word " * 9, None, "", "z" * 5000, "ta lo"], extra=True)
    lab = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (None, 1, 1), (4, 1, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    assert tx.toxicity_query(docs, lab).count() == 5
    assert {r["score"] for r in tx.toxicity_query(docs, lab.limit(0)).collect()} == {0.0}
    assert tx.toxicity_query(docs.limit(0), lab).count() == 0
    kept = {}
    assert machine.scores(["ta " * 50] * 3, kept).tolist() == machine.scores(["ta " * 50], {}).tolist() * 3
