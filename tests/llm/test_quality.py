import random
import zlib

from ravelin.llm import quality as q
from tests.llm.helpers import documents, rows


def corpus(n=240):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(30, 90))]
        good = i % 3 != 0
        if good:
            text = ". ".join(" ".join(words[a : a + 9]).capitalize() for a in range(0, len(words), 9)) + "."
        else:
            text = [" | ".join(words), "!! ".join(w.upper() for w in words), " ".join(w for w in words[:8] for _ in range(7))][i // 3 % 3]
        texts.append(text)
        labels.append((i, int(good), 0))
    return texts, labels


def test_held_out_accuracy(spark):
    texts, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = q.quality_query(documents(spark, texts, extra=True), lab).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    right = sum(r["predicted"] == labels[r["doc_id"]][1] for r in held)
    assert right / len(held) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    texts, labels = corpus(90)
    docs = documents(spark, texts)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (rows(q.quality_query(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")), "doc_id", "score") for x in (labels, flipped))
    assert a == b


def test_blocked_products_equal_plain_ones():
    texts, labels = corpus(60)
    model = q.Voter([q.terms(t) for t in texts], q.np.array([y for _, y, _ in labels], float))
    got = model.score([*texts, None, ""])

    def dense(text):  # by the definition, term by term
        x = q.np.zeros(q.TERMS)
        for at, w in zip(*q.terms(text), strict=True):
            x[at] += w * model.idf[at]
        x = x / q.np.linalg.norm(x) @ model.basis
        return x / q.np.linalg.norm(x)

    sim = q.np.round(q.np.array([dense(t) for t in texts]) @ model.vectors.T, 6)
    for i in range(5):
        top = q.np.argsort(-sim[i])[: model.k]
        w = q.np.maximum(sim[i][top], 1e-6) ** model.power
        assert abs(got[i] - (w * model.labels[top]).sum() / w.sum()) < 1e-4
    assert q.np.isfinite(got).all()


def test_defined_cases(spark):
    texts, labels = corpus(30)
    docs = documents(spark, [*texts, None, "", "long " * 30000], extra=True)
    lab = spark.createDataFrame([*labels, (1, None, 0), (1, 0, 0), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert q.quality_query(docs, lab).count() == 33
    none = q.quality_query(docs, lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert q.quality_query(docs.limit(0), lab).count() == 0
    kept = q.keep_good(docs, lab)
    assert kept.columns == docs.columns and kept.count() <= 33
