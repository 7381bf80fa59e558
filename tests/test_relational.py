import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravelin.operators import relational as rel
from ravelin.operators import sequence as seq
from ravelin.sources import store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_k_core_cascade(spark):
    """A block of three by three; w hangs on e, d hangs on w."""
    pairs = [(u, i) for u in "abc" for i in "xyz"] + [("d", "x"), ("d", "y"), ("d", "w"), ("e", "w"), ("e", "x"), ("a", "w")]
    core, passes = rel.k_core(spark.createDataFrame(pairs, "user_id string, item string"), 3)
    assert rows(core.select("user_id", "item")) == sorted((u, i) for u in "abc" for i in "xyz")
    assert passes == [(1, 13), (2, 11), (3, 9), (4, 9)]


def test_k_core_may_end_empty(spark):
    ring = spark.createDataFrame([(n, n) for n in range(3)] + [(n, (n + 1) % 3) for n in range(3)], "user_id int, item int")
    core, passes = rel.k_core(ring, 3)
    assert core.count() == 0 and passes == [(1, 0)]


VISITS = [
    ("ben", "park", 30, True, 12), ("ben", "park", 10, True, 8), ("ben", "lake", 20, False, 9), ("cleo", "park", 5, True, 2),
    ("cleo", "mill", 7, True, 6), ("cleo", "mill", 7, True, 7), ("dov", "lake", 1, True, 5),
]


def test_funnel_and_dedup(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(VISITS)], "row_id int, user_id string, item string, ts long, verified boolean, n_words int")
    first = F.row_number().over(Window.partitionBy("user_id", "item").orderBy("ts", "row_id")) == 1
    stages = [("all", F.lit(True)), ("verified", F.col("verified")), ("long", F.col("n_words") >= 5), ("first", F.col("first"))]
    got = {r["stage"]: (r["n_rows"], r["n_users"], r["n_items"]) for r in rel.funnel(df.withColumn("first", first), stages).collect()}
    assert got == {"all": (7, 3, 3), "verified": (6, 3, 3), "long": (5, 3, 3), "first": (3, 3, 3)}
    assert {r["row_id"] for r in rel.dedup(df, ["user_id", "item"], ["ts", "row_id"]).collect()} == {1, 2, 3, 4, 6}
    assert {r["row_id"] for r in rel.dedup(df, ["user_id", "item"], ["ts", "row_id"], last=True).collect()} == {0, 2, 3, 5, 6}


def test_first_by_key_and_relaxed_union(spark):
    df = spark.createDataFrame([("b", 2, None), ("b", 1, "x"), (None, 3, "y"), ("c", 4, None)], "k string, n int, v string")
    first, facts = rel.first_by_key(df, "k", ["n"], ["v"])
    assert rows(first.select("k", "n")) == [("b", 1), ("c", 4)]
    assert facts.first().asDict() == {"n_no_key": 1, "n": 2, "null_rate_v": 0.5, "n_repeated": 1}
    both = rel.union_relaxed([spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([("2",)], "n string")], {"n": "bigint"})
    assert rows(both) == [(1,), (2,)]


def test_join_checked(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    assert rel.join_checked(left, spark.createDataFrame([(1, 9), (2, 8)], "k int, y int"), ["k"]).count() == 2
    with pytest.raises(ValueError, match="repeats"):
        rel.join_checked(left, spark.createDataFrame([(1, 9), (1, 8)], "k int, y int"), ["k"])
    with pytest.raises(ValueError, match="no partner"):
        rel.join_checked(left, spark.createDataFrame([(1, 9)], "k int, y int"), ["k"])
    assert rel.same_keys(left, left, "k") and not rel.same_keys(left, left.filter("k = 1"), "k")


def test_nearest_quantile_by_definition(spark):
    values = [5.0, 1.0, 1.0, 2.0, 9.0, 7.0, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    known = sorted(v for v in values if v is not None)
    for q in (0.0, 0.2, 0.5, 0.9, 1.0):
        assert rel.nearest_quantile(df, "x", q).first()["value"] == known[round((len(known) - 1) * q)]


def test_nearest_quantile_narrows_down(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5003).cast("double").alias("x"))
    known = sorted((i * 7919) % 5003 for i in range(5000))
    for q in (0.001, 0.33, 0.9):
        assert rel.nearest_quantile(df, "x", q, at_once=50).first()["value"] == known[round((len(known) - 1) * q)]
    assert rel.nearest_quantile(df.limit(0), "x", 0.5).count() == 0


STAYS = [
    ("ines", "b", 7, 4, "self"), ("ines", "a", 3, 9, "gift_given"), ("ines", "c", 7, 5, "household"),
    ("jo", "d", 2, 1, "self"), ("jo", "e", 1, 2, "self"), ("jo", "f", 4, 3, "self"), ("jo", "g", 3, 0, "gift_given"),
]


def test_leave_one_out(spark):
    """In order of time and then row_id: a, b, c and e, d, g, f."""
    df = seq.leave_one_out(spark.createDataFrame(STAYS, "user_id string, item string, ts long, row_id long, label string"))
    assert {r["item"]: r["split"] for r in df.collect()} == {"a": "train", "b": "valid", "c": "test", "e": "train", "d": "train", "g": "valid", "f": "test"}
    assert rows(seq.eligible_users(df)) == [("jo",)]


def test_single_row_user_is_test_and_first(spark):
    df = seq.leave_one_out(spark.createDataFrame([("u", "i", 1, 1, "self")], "user_id string, item string, ts long, row_id long, label string"))
    assert df.first()["split"] == "test"
    assert df.select(seq.slot(F.col("seq_pos"), F.col("seq_len"))).first()[0] == "first"


def test_expand(spark):
    log = {"kai": "m:train n:train o:train p:valid q:test", "lou": "r:valid s:test", "mia": "t:train u:valid v:test:gift_given"}
    made = []
    for user, told in log.items():
        for n, part in enumerate(told.split()):
            item, split, label = [*part.split(":"), "self"][:3]
            made.append((user, item, n, len(made), label, split))
    df = spark.createDataFrame(made, "user_id string, item string, ts long, row_id long, label string, split string")
    got = {(r["split"], r["target"]): "".join(r["history"]) for r in seq.expand(df, most=3).collect()}
    assert got == {("train", "n"): "m", ("train", "o"): "mn", ("valid", "p"): "mno", ("test", "q"): "nop", ("test", "s"): "r", ("valid", "u"): "t"}


def test_elapsed_days_are_not_calendar_days(spark):
    df = spark.sql("SELECT 1 AS user_id, 1 AS row_id, TIMESTAMP_NTZ '2024-01-01 02:00:00' AS ts UNION ALL SELECT 1, 2, TIMESTAMP_NTZ '2024-01-02 01:00:00' UNION ALL SELECT 1, 3, TIMESTAMP_NTZ '2024-01-03 01:00:00'")
    assert sorted((r["row_id"], r["gap_days"]) for r in seq.with_gap(df).collect()) == [(1, 0), (2, 1), (3, None)]


def core_by_hand(pairs, k):
    """Rows and passes, every degree counted anew in every pass."""
    rows, passes, before = list(pairs), [], len(pairs)
    while True:
        u, i = Counter(r[0] for r in rows), Counter(r[1] for r in rows)
        rows = [r for r in rows if None not in r and u[r[0]] >= k and i[r[1]] >= k]
        passes.append((len(passes) + 1, len(rows)))
        if len(rows) == before or not rows:
            return sorted(rows), passes
        before = len(rows)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_k_core_by_deltas(spark, monkeypatch, sent):
    monkeypatch.setattr(rel, "MAX_SENT", sent)
    rng = random.Random(8)
    chain = [(f"c{i}", f"d{i + j}") for i in range(12) for j in range(2)]  # falls apart link by link
    pairs = [*chain, *((f"u{rng.randrange(40)}", f"i{int(rng.random() ** 2 * 30)}") for _ in range(220)), (None, "i1"), ("u1", None), ("u2", "i2"), ("u2", "i2")]
    df = spark.createDataFrame(pairs, "user_id string, item string").withColumn("pad", F.lit(1))
    for k in (2, 4) if sent else (4,):
        before = store.mark()
        core, passes = rel.k_core(df, k)
        want, steps = core_by_hand(pairs, k)
        assert passes == steps and sorted((r["user_id"], r["item"]) for r in core.collect()) == want
        assert core.columns == df.columns and store.mark() == before + 1  # the passes' tables are gone
    if sent:
        assert rel.k_core(df.filter("user_id IS NULL"), 2)[1] == [(1, 0)]
