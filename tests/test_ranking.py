"""Rankings against full sorts, and counts of common users against sets."""

import random
from collections import Counter

import pytest

from ravelin.operators import ranking as rk


def test_factor_topk_equals_full_sorts(spark, monkeypatch):
    monkeypatch.setattr(rk, "SCORES_AT_ONCE", 40)
    rng = random.Random(2)
    users = [(f"u{i}", [rng.choice([-1.0, 0.0, 1.0, 0.5]) for _ in range(3)]) for i in range(25)] + [("none", None)]
    items = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(30)] + [(99, None)]
    masked = [(f"u{i}", rng.randrange(32)) for i in range(25) for _ in range(i)] + [("u24", i) for i in range(30)] + [("else", 3)]
    u, i = spark.createDataFrame(users, "user_id string, vector array<double>"), spark.createDataFrame(items, "item long, vector array<double>").repartition(3)
    m = spark.createDataFrame(masked, "user_id string, item long")
    want = []
    for name, v in users[:-1]:
        hidden = {b for a, b in masked if a == name}
        best = sorted((-round(sum(x * y for x, y in zip(v, w, strict=True)), 9), item) for item, w in items[:-1] if item not in hidden)[:4]
        want += [(name, item, rank, -s) for rank, (s, item) in enumerate(best, 1)]
    for at_once in (50_000, 7):
        monkeypatch.setattr(rk, "ITEMS_AT_ONCE", at_once)
        assert sorted(tuple(r) for r in rk.factor_topk(u, i, 4, m).collect()) == sorted(want)
    assert rk.factor_topk(u, i, 100).filter("user_id = 'u0'").count() == 30
    assert rk.factor_topk(u, i.limit(0), 4).count() == 0 and rk.factor_topk(u.limit(0), i, 4).count() == 0


@pytest.mark.parametrize("heavy", [200, 5, 0])
def test_common_users(spark, monkeypatch, heavy):
    monkeypatch.setattr(rk, "HEAVY", heavy)
    monkeypatch.setattr(rk, "BLOCK", 8)
    rng = random.Random(3)
    held = {f"u{i}": rng.sample(range(40), min(40, 1 + i * 2)) for i in range(25)}
    want = Counter((a, b) for items in held.values() for a in items for b in items if a != b)
    df = spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "user_id string, at long").repartition(4)
    assert {(r["a"], r["b"]): r["c"] for r in rk.common_users(df).collect()} == want


def test_a_heavy_user_emits_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(rk, "HEAVY", 10)
    df = spark.range(300).selectExpr("'u' AS user_id", "id AS at")
    plan = rk.common_users(df)
    assert plan.count() == 300 * 299
    assert df.selectExpr("at div 512 AS b").distinct().count() == 1  # one row a block, not 90,000


def test_neighbours_limit_what_counts(spark):
    rows = [("u1", "a"), ("u1", "b"), ("u1", "c"), ("u2", "a"), ("u2", "b"), ("u3", "b"), ("u3", "d"), ("u4", "a")]
    log = spark.createDataFrame([(u, i, n, str(n), "train") for n, (u, i) in enumerate(rows)] + [("u4", "z", 99, "99", "test")], "user_id string, item string, ts long, row_id string, split string")
    every = {(r["user_id"], r["item"]): r["score"] for r in rk.cooccurrence_topk(log, 5).collect()}
    assert every["u4", "b"] == pytest.approx(2 / 3) and every["u4", "c"] == pytest.approx(1 / 3**0.5)
    one = rk.cooccurrence_topk(log, 5, neighbours=1).filter("user_id = 'u4'").collect()
    assert [r["item"] for r in one] == ["b"]
