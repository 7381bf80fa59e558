from ravelin.llm import mixture as mx
from tests.llm.helpers import documents, rows


def water(sizes, weights, budget, cap):
    """Targets by reshare until none is above, as the contract says it."""
    total, open_ = budget * sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        share = {i: total * weights[i] / w for i in open_}
        over = [i for i in open_ if share[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = share[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            total -= out[i]
            open_.discard(i)
    return out


def corpus():
    texts, sources = [], []
    for s, n, size in (("a", 40, 30), ("b", 5, 10), ("c", 60, 25), ("d", 1, 400), (None, 8, 12), ("ü", 3, 7)):
        for i in range(n):
            texts.append("w " * (size + i % 9))
            sources.append(s)
    return [*texts, None, "", " "], [*sources, "a", "b", "e"]


def test_targets_and_taken(spark):
    texts, sources = corpus()
    got = mx.mixture_query(documents(spark, texts, sources, extra=True)).collect()
    assert len(got) == len(texts)
    order = sorted({s for s in sources if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in order}
    want = dict(zip(order, water([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2.0), strict=True))
    taken = dict.fromkeys(order, 0)
    for r in got:
        s = sources[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split())
        assert r["source_size"] == size[s]
        assert abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in order:
        most = max(len((t or "").split()) for t, x in zip(texts, sources, strict=True) if x == s)
        assert abs(taken[s] - want[s]) <= most / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mx.mixture_query(documents(spark, texts, sources).repartition(7)).collect()))


def test_mixed_repeats_rows(spark):
    texts, sources = corpus()
    df = documents(spark, texts, sources, extra=True)
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in mx.mixture_query(df).collect() if r["size"]}
    out = mx.mixed(df)
    assert out.columns == df.columns
    count = dict(rows(out.groupBy("doc_id").count(), "doc_id", "count"))
    assert {d: n for d, n in copies.items() if n} == {d: n for d, n in count.items() if len((texts[d] or "").split())}


def test_mixed_with_repeated_ids(spark):
    """Rows that tie at the cut are taken in part all the same."""
    df = spark.createDataFrame([(None, "x y z", "a")] * 9 + [(i, "p q", "b") for i in range(40)] + [(90 + i, "k", None) for i in range(30)], "doc_id long, text string, source string")
    taken = {r["source"]: r["n"] for r in mx.mixed(df).selectExpr("source", "size(split(text, ' ')) AS w").groupBy("source").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()}
    want = {r["source"]: r["target"] for r in mx.targets(df.selectExpr("source", "size(split(text, ' ')) AS size")).collect()}
    assert all(abs(taken[s] - want[s]) <= 2 for s in want)


def test_empty_and_no_words(spark):
    assert mx.mixture_query(documents(spark, ["a"]).limit(0)).count() == 0
    assert rows(mx.mixture_query(documents(spark, [None, ""])), "size", "target", "taken") == [(0, 0.0, 0), (0, 0.0, 0)]
