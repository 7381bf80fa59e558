"""Quantiles by histograms against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ravelin.functions import time as tm
from ravelin.operators import quantiles as qt
from ravelin.operators import relational as rel

QS = (0.0, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0)


def order(v):
    return (math.isnan(v), v) if isinstance(v, float) else v


def linear(values, q):
    s = sorted(values, key=order)
    p = (len(s) - 1) * q
    i = math.floor(p)
    return s[i] if p == i else s[i] + (s[i + 1] - s[i]) * (p - i)


def nearest(values, q):
    return sorted(values, key=order)[round((len(values) - 1) * q)]


def groups():
    rng = random.Random(4)
    return {
        "wide": [rng.choice([1, -1]) * 10 ** rng.uniform(-300, 300) for _ in range(900)],
        "same": [2.5] * 400,
        "few": [rng.choice([0.0, -0.0, 1.0, 7.0]) for _ in range(300)],
        "close": [1.0 + i * 2**-52 for i in range(500)],
        "mix": [math.inf, -math.inf, 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 30,
        "nan": [math.nan, 1.0, 2.0] * 50,
        None: [rng.gauss(0, 1) for _ in range(700)],
        "one": [3.0],
    }


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(qt, "FEW", 20)
    monkeypatch.setattr(qt, "BINS", 8)


def check(spark, data, kind, how):
    rows = [(k, v) for k, vs in data.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, ("gone", None), ("one", None)], f"k string, x {kind}")
    got = {(r["k"], r["q"]): r["value"] for r in qt.quantiles(df, "x", QS, by=["k"], how=how).collect()}
    assert len(got) == len(data) * len(QS)
    for k, vs in data.items():
        for q in QS:
            want = (linear if how == "linear" else nearest)(vs, q)
            have = got[k, q]
            assert have == want or (math.isnan(have) and math.isnan(want)) or (how == "linear" and math.isclose(have, want, rel_tol=1e-12)), (k, q)


@pytest.mark.parametrize("how", ["linear", "nearest"])
def test_doubles_in_many_rounds(spark, small, how):
    check(spark, groups(), "double", how)


def test_whole_numbers_beyond_doubles(spark, small):
    big = 2**62
    data = {"a": [big + i // 2 for i in range(300)], "b": [-(2**63), 2**63 - 1, 0] * 40, "c": list(range(100))}
    check(spark, data, "bigint", "nearest")


def test_small_groups_need_no_rounds(spark):
    check(spark, groups(), "double", "linear")


def test_without_groups(spark, small):
    values = [float(i * i % 977) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["q"]: r["value"] for r in qt.quantiles(df, "x", QS).collect()}
    assert got == {q: pytest.approx(linear(values, q)) for q in QS}
    assert [r["value"] for r in qt.quantiles(df.limit(0), "x", [0.5]).collect()] == [None]
    assert qt.quantiles(df.limit(0).withColumn("k", F.lit(1)), "x", [0.5], by=["k"]).count() == 0


def test_no_task_holds_the_values(spark, small):
    """What a round shuffles is bounded by bins, whatever the number of values."""
    values = spark.range(200_000).select(F.struct(F.lit(0).alias("_")).alias("g"), F.rand(3).alias("v"))
    wanted = spark.createDataFrame([((0,), 100_000)], "g struct<_:int>, rank long")
    rows = []
    real = qt.cut

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    qt.cut, before = counted, qt.cut
    try:
        assert qt._at_ranks(values, wanted).count() == 1
    finally:
        qt.cut = before
    assert len(rows) > 3 and max(rows) <= 2


def test_deciles_and_epochs(spark, small):
    df = spark.range(1000).select((F.col("id") % 100).alias("x"))
    counts = {r["decile"]: r["count"] for r in rel.value_deciles(df, "x").groupBy("decile").count().collect()}
    cuts = [linear([i % 100 for i in range(1000)], i / 10) for i in range(1, 10)]
    want = {}
    for i in range(1000):
        d = 1 + sum(i % 100 > c for c in cuts)
        want[d] = want.get(d, 0) + 1
    assert counts == want
    for values, millis in (([1, 2, 3e11], False), ([1, 2e11, 3e11], True), ([1, 3e11], True), ([1, 1.5e11], False), ([1e11, 1e11], False), ([], False), ([None, 2e11], True)):
        df = spark.createDataFrame([(None if v is None else int(v),) for v in values], "timestamp long")
        assert tm.epoch_is_millis(df) is millis, values
