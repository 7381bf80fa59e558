"""Draws by a cutting hash against sorted strata."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.operators import experiment as ex
from ravelin.operators import sampling as sm
from ravelin.functions.seeds import seed_for


@pytest.fixture(params=[50_000, 6])
def few(request, monkeypatch):
    """Whole strata in a window, and prefixes of several rounds."""
    monkeypatch.setattr(sm, "FEW", request.param)
    monkeypatch.setattr(sm, "DIGITS", 2)
    return request.param


def key(seed, *parts):
    return hashlib.md5("|".join(str(p) for p in (seed, *parts) if p is not None).encode()).hexdigest()


ROWS = [(f"r{i}", "hot" if i % 3 else ["a", "b", None][i % 9 // 3], i) for i in range(400)] + [("lone", "lone", -1)]


def wanted(alloc, seed):
    strata = defaultdict(list)
    for r, s, _ in ROWS:
        strata[s].append((key(seed, s, r), r))
    return sorted(r for s, rows in strata.items() for _, r in sorted(rows)[: alloc(s, len(rows))])


def test_draws(spark, few):
    df = spark.createDataFrame(ROWS, "row_id string, label string, n long").repartition(5)
    got = sm.draw(df, F.col("label"), 17, 5)
    assert set(got.columns) == {"row_id", "label", "n", "stratum"}
    assert sorted(r["row_id"] for r in got.collect()) == wanted(lambda s, n: 17, 5)
    got = sm.draw(df, F.col("label"), {"hot": 100, "a": 0, "b": 10_000}, 6)
    assert sorted(r["row_id"] for r in got.collect()) == wanted(lambda s, n: {"hot": 100, "b": n}.get(s, 0), 6)
    assert sm.draw(df.limit(0), F.col("label"), 3, 5).count() == 0
    assert sm.draw(df, F.col("label"), {}, 5).count() == 0


def test_repeated_rows_are_drawn_as_often_as_told(spark, few):
    df = spark.createDataFrame([("same",)] * 50 + [("other",)], "row_id string")
    for n in (20, 60):
        assert sm.draw(df, F.lit("x"), n, 1).count() == min(n, 51)


def test_holdout(spark, few):
    df = spark.createDataFrame(ROWS, "row_id string, stratum string, n long")
    got = sm.holdout(df, F.col("stratum"), 0.25, 7)
    assert set(got.columns) == {"row_id", "stratum", "n", "part"} and got.count() == len(ROWS)
    assert sorted(r["row_id"] for r in got.filter("part = 'holdout'").collect()) == wanted(lambda s, n: 0 if n < 2 else round(n * 0.25), 7)


def test_placebo_is_a_share_without_a_sort(spark, few):
    log = spark.createDataFrame([(f"r{i}", "train" if i % 10 else "test", "gift_given" if i % 4 == 1 else "self") for i in range(300)], "row_id string, split string, label string")
    train = [i for i in range(300) if i % 10]
    n = sum(i % 4 == 1 for i in train)
    seed = seed_for(42, "C4")
    want = sorted(f"r{i}" for i in sorted(train, key=lambda i: key(seed, "train", f"r{i}"))[:n])
    got = ex.placebo_rows(log, "C4")
    assert sorted(r["row_id"] for r in got.collect()) == want
    assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
