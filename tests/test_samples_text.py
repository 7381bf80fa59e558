import json

import pytest
from pyspark.sql import functions as F

from ravelin import sources
from ravelin.functions import text as tx
from ravelin.operators import eda, labels, lexicon, marketing, sampling
from ravelin.sources.files import REVIEW_SCHEMA


def allocated(spark, cells, total):
    df = spark.createDataFrame(list(cells.items()) or [], "stratum string, n long")
    return {r["stratum"]: r["alloc"] for r in sampling.allocate(df, total).collect()}


def test_allocation(spark):
    assert allocated(spark, {"p": 70, "q": 20, "r": 10}, 30) == {"p": 21, "q": 6, "r": 3}
    assert allocated(spark, {"p": 5, "q": 4, "r": 4}, 7) == {"p": 3, "q": 2, "r": 2}
    assert allocated(spark, {"p": 2, "q": 7}, 50) == {"p": 2, "q": 7}
    assert allocated(spark, {"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 0}
    assert allocated(spark, {"p": 4}, 0) == {"p": 0} and allocated(spark, {}, 3) == {}


def test_share_allocation():
    """What a cap holds back goes round by largest fraction, then key."""
    assert sampling.share_allocation({"a": 0.30, "b": 0.26, "c": 0.14, "d": 0.30}, 10, {"d": 2}) == {"a": 3, "b": 3, "c": 2, "d": 2}
    assert sampling.share_allocation({"x": 0.7, "y": 0.2, "z": 0.1}, 25) == {"x": 18, "y": 5, "z": 2}
    assert sampling.share_allocation({"x": 0.25, "y": 0.25}, 8) == {"x": 4, "y": 4}
    assert sampling.share_allocation({"x": 0.9, "y": 0.1}, 20, {"x": 6, "y": 5}) == {"x": 6, "y": 5}
    assert sampling.share_allocation({"x": 0.5, "y": 0.5}, 0) == {"x": 0, "y": 0}


def test_frames_are_disjoint_and_repeatable(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 5).cast("string").alias("s"), (F.col("id") % 9 == 0).alias("flag"))
    out = sampling.frames(df, F.col("s"), 200, [("boost", F.col("flag"), 50)], 42)
    assert out.count() == 250 and out.select("row_id").distinct().count() == 250
    assert out.filter("frame = 'boost' AND NOT flag").count() == 0
    again = sampling.frames(df.repartition(7), F.col("s"), 200, [("boost", F.col("flag"), 50)], 42)
    assert out.select("row_id", "frame").exceptAll(again.select("row_id", "frame")).count() == 0


def test_worker_slices_partition_rows(spark):
    df = spark.range(101).withColumnRenamed("id", "row_id")
    parts = [{r["row_id"] for r in sampling.worker_slice(df, w, 3).collect()} for w in range(3)]
    assert set().union(*parts) == set(range(101)) and sum(map(len, parts)) == 101


def test_holdout(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.when(F.col("id") < 49, "a").otherwise("b").alias("s"))
    got = sampling.holdout(df, F.col("s"), 0.1, 1).groupBy("s", "part").count().collect()
    assert {(r["s"], r["part"]): r["count"] for r in got} == {("a", "holdout"): 5, ("a", "train"): 44, ("b", "train"): 1}


def test_length_buckets(spark):
    df = spark.createDataFrame([(n,) for n in (1, 14, 15, 39, 40, 900)], "n int")
    assert [r[0] for r in df.select(tx.length_bucket(F.col("n"))).collect()] == ["<15", "<15", "15-40", "15-40", ">=40", ">=40"]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (0, 2, 3, 501)], "n int").select(tx.right_closed(F.col("n"))).collect()] == ["1-2", "1-2", "3-5", ">500"]


KIN = ["aunt", "uncle", "niece", "twin"]
FAMILIES = {
    "evidence": lexicon.compile_family([r"wrapped (?:it|them) for my {kin}", r"my {kin} (?:unwrapped|adores) (?:it|them)"], {"kin": KIN}),
    "speculative": lexicon.compile_family([r"might suit an? {kin}"], {"kin": KIN}),
    "received": lexicon.compile_family([r"my {kin} sent (?:it|them) to me"], {"kin": KIN}),
}


def test_lexicon(spark):
    texts = [
        ("Wrapped it for my NIECE before Easter.", {"evidence"}, "niece"),
        ("The twins laughed; my twin adores them.", {"evidence"}, "twin"),
        ("A dull clock that might suit an uncle.", {"speculative"}, "uncle"),
        ("My aunt sent it to me from Porto.", {"received"}, "aunt"),
        ("Plain soap, smells of nothing.", set(), None),
        ("My aunt sent it to me, so I wrapped it for my uncle.", {"evidence", "received"}, "aunt"),
    ]
    df = spark.createDataFrame([(i, t, "Some title") for i, (t, _, _) in enumerate(texts)], "row_id int, text string, title string")
    got = sorted(lexicon.scan(df, FAMILIES, {"recipient": rf"\b({'|'.join(KIN)})\b"}, title="title", evidence="evidence", against="received").collect())
    for r, (_, families, kin) in zip(got, texts, strict=True):
        assert {k for k in FAMILIES if r[f"kw_{k}"]} == families and r["kw_recipient"] == kin
    assert got[0]["kw_proxy"] and not got[-1]["kw_proxy"]
    assert "text" not in lexicon.scan(df, FAMILIES).columns


def test_text_functions(spark):
    df = spark.createDataFrame([("Çok güzel,  bought it", "a  b", "x a b y")], "t string, s string, u string")
    r = df.select(tx.word_count(F.col("t")), tx.find(F.col("t"), "bought"), tx.byte_offset(F.col("t"), tx.find(F.col("t"), "bought")), tx.is_verbatim(F.col("s"), F.col("u")), tx.is_verbatim(F.lit(" "), F.col("u")), tx.non_ascii(F.col("t"))).first()
    assert tuple(r) == (4, 12, 16, True, False, True)
    notes = ["Boş  Kâğıt", "BOŞ-KAĞIT!", "boş kağıt değil", " ", None]
    n = spark.createDataFrame([(x,) for x in notes], "n string").select(tx.note_code(F.col("n"), {"boskagit": "EMPTY"}))
    assert [x[0] for x in n.collect()] == ["EMPTY", "EMPTY", "boş kağıt değil", None, None]
    t = spark.createDataFrame([("{x}", "")], "a string, b string").select(tx.template({"a": F.col("a"), "b": F.col("b")}, "A: {a}; B: {b}."))
    assert t.first()[0] == "A: {x}; B: (none)."
    p = spark.range(1).select(tx.common_prefix_length(F.lit("abc1"), F.lit("abd")), tx.common_prefix_length(F.lit(""), F.lit("x")))
    assert tuple(p.first()) == (2, 0)
    v = spark.createDataFrame([('{"label":"self","span":"x"}',), ('{"label":"nope","span":"x"}',), ('{"label":"self"}',), ("{",)], "j string")
    assert [x[0] for x in v.select(tx.valid_label(F.col("j"), ["self"], ["label", "span"])).collect()] == [True, False, False, False]


def test_files(spark, tmp_path):
    lines = [{"rating": 5.0, "title": "t", "text": "x", "asin": "0001", "parent_asin": "0001", "user_id": "u", "timestamp": 1, "verified_purchase": True, "helpful_vote": 0, "images": [1]}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    df = sources.read_ndjson(spark, str(tmp_path / "r.jsonl"), REVIEW_SCHEMA)
    assert df.first()["parent_asin"] == "0001" and "images" not in df.columns
    assert sources.probe_schema(spark, str(tmp_path / "r.jsonl"), ["rating"])["images"] == "list"
    with pytest.raises(ValueError, match="missing"):
        sources.probe_schema(spark, str(tmp_path / "r.jsonl"), ["nothing"])
    sources.write_tsv(df.select("user_id", "parent_asin", "timestamp"), str(tmp_path / "t"), {"user_id": "token", "parent_asin": "token", "timestamp": "float"}, order=["user_id"])
    back = sources.read_tsv(spark, str(tmp_path / "t"), {"timestamp": "bigint"})
    assert back.first().asDict() == {"user_id": "u", "parent_asin": "0001", "timestamp": 1}
    ids = spark.range(10)
    assert sources.append_missing(ids.filter("id < 6"), str(tmp_path / "a"), ["id"]) == 6
    assert sources.append_missing(ids, str(tmp_path / "a"), ["id"]) == 4
    assert sources.with_row_index(df).first()["row_id"] == 0
    sources.same_manifest(tmp_path / "m.json", {"a": 1})
    with pytest.raises(ValueError):
        sources.same_manifest(tmp_path / "m.json", {"a": 2})
    assert sources.md_table([[1, 2]], ["a", "b"]).splitlines()[1] == "| --- | --- |"
    assert sources.should_skip(tmp_path / "m.json") and not sources.should_skip(tmp_path / "m.json", force=True)


def test_annotation_keeps_every_row(spark):
    df = spark.createDataFrame([(i, f"text number {i}", "c") for i in range(30)], "row_id int, text string, category string")
    out = labels.annotate(df)
    assert out.count() == 30 and out.filter("NOT parse_ok").count() == 0
    joined = labels.downgrade(out.join(df, "row_id").withColumn("span", F.when(F.col("row_id") == 0, "no such words").otherwise(F.col("span"))))
    bad = joined.filter("row_id = 0").first()
    assert bad["label"] == "unclear" or not bad["span_downgraded"]
    assert labels.run_statistics(joined).agg(F.sum("n")).first()[0] == 30
    broken = labels.annotate(df, backend=lambda t: [{"label": "??"} for _ in t])
    assert broken.filter("label = 'unclear' AND NOT parse_ok").count() == 30
    b = labels.bundle(out, df.select("row_id", "text", "category"), spark.createDataFrame([(3,)], "row_id int"), ["row_id"])
    assert b.count() == 29
    with pytest.raises(ValueError):
        labels.bundle(out, df.select("row_id", "text", "category"), spark.createDataFrame([(99,)], "row_id int"), ["row_id"])


def test_token_batches_and_student(spark):
    got = labels.token_batches([5, 1, 9, 2], budget=10, most=3)
    assert sorted(i for b in got for i in b) == [0, 1, 2, 3] and all(len(b) <= 3 for b in got)
    rows = spark.createDataFrame([(f"good apple {i}", "a") for i in range(20)] + [(f"bad pear {i}", "b") for i in range(20)], "text string, label string")
    assert labels.train_student(rows).transform(rows).filter("predicted <> label").count() == 0


def test_ingest(spark):
    sample = spark.createDataFrame([(1,), (2,)], "sample_id int")
    sheet = spark.createDataFrame([(1, "self"), (2, " ")], "sample_id int, label string")
    assert sorted(tuple(r) for r in labels.ingest({"A": sheet}, sample).collect()) == [(1, "self"), (2, None)]
    for bad in (sheet.limit(1), sheet.union(sheet), spark.createDataFrame([(1, "nope"), (2, "")], "sample_id int, label string")):
        with pytest.raises(ValueError):
            labels.ingest({"A": bad}, sample)
    with pytest.raises(ValueError):
        labels.ingest({"a": sheet}, sample)


def test_marketing(spark):
    h = spark.createDataFrame([("u1", "P", 1, 1, "gift_given"), ("u1", "D", 2, 2, "self"), ("u2", "P", 1, 3, "gift_given"), ("u2", "P", 2, 4, "self"), ("u3", "G", 1, 5, "gift_given"), ("u3", None, 2, 6, "gift_given")], "user_id string, subcat string, ts int, row_id int, label string")
    only = marketing.gift_only(h, F.col("label") == "gift_given")
    assert sorted(map(tuple, only.collect())) == [("u1", "P"), ("u3", "G")]
    items = spark.createDataFrame([(f"{c}{i}", c) for c in "PD" for i in range(10)], "item string, subcat string")
    topk = spark.createDataFrame([("u1", f"P{i}") for i in range(10)] + [("u1", f"D{i}") for i in range(10)] + [("u2", f"P{i}") for i in range(10)] + [("u3", None)], "user_id string, item string")
    assert dict(map(tuple, marketing.list_share(topk, items, only, 20).collect())) == {"u1": 0.5, "u2": 0.0, "u3": 0.0}
    assert sorted(map(tuple, marketing.gift_buckets(h, F.col("label") == "gift_given", F.col("label") == "self", only).collect())) == [("u1", "P", 1)]
    t = marketing.terciles(spark.createDataFrame([(f"u{n}", n) for n in range(2, 8)], "user_id string, n int")).groupBy("tercile").count()
    assert dict(map(tuple, t.collect())) == {"low": 2, "mid": 2, "high": 2}


def test_eda(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,)], "v double")
    assert [round(r["share"], 4) for r in sorted(eda.ecdf_grid(df, "v", (0.5, 1, 5)).collect())] == [0.0, 0.6667, 1.0]
    assert sorted((r["x"] or 0, r["n"]) for r in eda.value_grid(df, F.col("v"), [1, 2]).collect()) == [(0, 2), (1, 2), (2, 0)]


def test_two_level_sample(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("r"), F.when(F.col("id") < 290, "a").otherwise("b").alias("s"))
    out, short = sampling.two_level(df, F.col("r"), F.col("s"), {"x": 0.5, "y": 0.5}, {"a": 0.5, "b": 0.5}, 40, 3, excluded=df.filter("row_id < 100").select("row_id"))
    rows = out.collect()
    assert len(rows) == 40 and {r["sample_id"] for r in rows} == set(range(1, 41)) and min(r["row_id"] for r in rows) >= 100
    assert sum(r["role"] == "x" for r in rows) == 20 and short["x|b"] == 10 - sum(r["role"] == "x" and r["stratum"] == "b" for r in rows)


def test_text_drift(spark):
    c = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, text string")
    s = spark.createDataFrame([(1, "a"), (2, None), (3, "x"), (4, "d")], "k int, text string")
    assert tuple(sampling.text_drift(s, c, ["k"]).first()) == (4, 1, 1)
    with pytest.raises(ValueError, match="1 of 4"):
        sampling.rebuilt(s, c, c.select("k"), "k")
    same = c.filter("k < 3")
    assert sampling.rebuilt(same, c, spark.createDataFrame([(1, "u")], "k int, url string"), "k").count() == 2
    titled = sampling.with_texts(c.select("k"), c, spark.createDataFrame([(1, " t "), (2, "  ")], "k int, title string"), "k").collect()
    assert {r["k"]: (r["title"], r["no_title"]) for r in titled} == {1: ("t", False), 2: ("", True), 3: ("", True)}


def test_config_and_formatters(tmp_path):
    import subprocess

    from ravelin.config import Config, provenance, redacted

    (tmp_path / "c.json").write_text('{"a": {"b": null, "c": 2}}')
    c = Config.read(tmp_path / "c.json")
    assert c.get("a.c") == 2 and c.get("a.b") is None and c.get("a.c.d", 5) == 5
    with pytest.raises(KeyError):
        c.get("a.x")
    assert provenance(tmp_path) is None
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", *args], cwd=tmp_path, check=True)
    stamp = provenance(tmp_path, ("c.json",))
    (tmp_path / "c.json").write_text("{}")
    assert provenance(tmp_path, ("c.json",)) == f"{stamp}-dirty" and provenance(tmp_path, (":(none)x",)) == f"{stamp}-unknown"
    assert redacted(tmp_path / "d" / "e", tmp_path) == "d/e" and redacted("/elsewhere/f", tmp_path) == "f"
    assert (tx.percent(0.1234), tx.thousands(1234567), tx.times(1.5), tx.percent(None)) == ("12.3%", "1,234,567", "1.50×", "-")
