"""Bootstraps against weights and draws written out."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.operators import bootstrap as bs


def u(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def poisson(x):
    """How many of the cumulated Poisson(1) shares up to 7 lie at or below x."""
    out, total = 0, 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        out += x >= total
    return out


DATA = [(i, ["a", "b", None][i % 3], float(i % 7) if i % 11 else None) for i in range(90)] + [(None, "a", 2.0)]


def test_replicate_sums(spark, monkeypatch):
    monkeypatch.setattr(bs, "ROWS_AT_ONCE", 8)
    monkeypatch.setattr(bs, "GROUPS_AT_ONCE", 1)
    df = spark.createDataFrame(DATA, "k long, g string, x double").repartition(5)
    want, plain = defaultdict(float), defaultdict(float)
    for k, g, x in DATA:
        for rep in range(20):
            w = poisson(u(f"3|{rep}" + ("" if k is None else f"|{k}")))
            want[g, rep, "w"] += w
            want[g, rep, "x"] += w * (x or 0)
            plain[rep, "w"] += w
            plain[rep, "x"] += w * (x or 0)
    got = bs.replicate_sums(df, "k", {"x": F.col("x")}, 20, 3, by="g").collect()
    assert len(got) == 60 and all(r["x"] == want[r["g"], r["rep"], "x"] and r["w"] == want[r["g"], r["rep"], "w"] for r in got)
    got = bs.replicate_sums(df, "k", {"x": F.col("x")}, 20, 3).collect()
    assert len(got) == 20 and all(r["x"] == plain[r["rep"], "x"] and r["w"] == plain[r["rep"], "w"] for r in got)
    assert bs.replicate_sums(df.limit(0), "k", {"x": F.col("x")}, 20, 3).count() == 0


def test_rows_do_not_grow_with_replicates(spark):
    df = spark.range(500, numPartitions=4).withColumn("x", F.rand(1))
    rows = df.select(F.lit(None).cast("string").alias("g"), F.col("id").cast("string").alias("k"), "x")
    for replicates in (10, 300):
        sums = rows.mapInArrow(bs._weighed(["x"], replicates, 1), bs._SUMS)
        assert sums.count() == 4 and sums.select(F.max(F.size("sums"))).first()[0] == 2 * replicates


STRATA = [(i, ["x", "y"][i % 2], ["p", "q", None][i % 3], i % 4 == 0, 1.0 + i % 3) for i in range(70)]


@pytest.mark.parametrize("block", [10_000, 5])
def test_strata_keep_their_sizes(spark, block):
    df = spark.createDataFrame(STRATA, "k long, c string, r string, hit boolean, v double").repartition(3)
    groups = defaultdict(list)
    for k, c, r, hit, v in STRATA:
        groups[f"{c}|{r or ''}"].append((hashlib.md5(f"9|order|{k}".encode()).hexdigest(), str(k), hit, v))
    want = defaultdict(Counter)
    for name, rows in groups.items():
        rows.sort()
        for rep in range(15):
            for b in range(0, len(rows), block):
                some = rows[b : b + block]
                for j in range(len(some)):
                    _, _, hit, v = some[math.floor(u(f"9|{rep}|{name}|{b // block}|{j}") * len(some))]
                    want[rep]["hit"] += v * hit
                    want[rep][name] += 1
    columns = {"hit": F.when(F.col("hit"), F.col("v")).otherwise(0.0), **{name: (F.concat_ws("|", F.col("c"), F.coalesce("r", F.lit(""))) == name).cast("int") for name in groups}}
    got = bs.stratified_sums(df, "k", ["c", "r"], columns, 15, 9, block).collect()
    assert len(got) == 15
    for r in got:
        assert r["w"] == len(STRATA) and all(r[name] == len(rows) for name, rows in groups.items())
        assert r["hit"] == want[r["rep"]]["hit"]


def test_stratified_scores(spark):
    rows = [(i, "s" + str(i % 2), "a" if i % 3 else "b", "a" if i % 5 else "b", 1.0 + i % 2) for i in range(60)] + [(99, "s0", None, "a", 1.0)]
    df = spark.createDataFrame(rows, "k long, s string, ref string, pred string, v double")
    got = {(r["label"], r["score"]): r for r in bs.stratified_scores(df, "k", "ref", "pred", ["s"], ["a", "b", "never"], "v", replicates=50).collect()}
    seen = [r for r in rows if r[2]]
    right = sum(v for *_, r, p, v in seen if r == p) / sum(r[4] for r in seen)
    assert got["all", "accuracy"]["value"] == pytest.approx(right)
    assert got["all", "accuracy"]["lo"] <= right <= got["all", "accuracy"]["hi"]
    assert got["never", "f1"]["value"] is None and got["never", "f1"]["lo"] is None
    f1 = [got[c, "f1"]["value"] for c in "ab"]
    assert got["all", "macro_f1"]["value"] == pytest.approx(sum(f1) / 2)
    same = bs.stratified_scores(df.repartition(7), "k", "ref", "pred", ["s"], ["a", "b", "never"], "v", replicates=50).collect()
    assert {(r["label"], r["score"]): (r["lo"], r["hi"]) for r in same} == {k: (r["lo"], r["hi"]) for k, r in got.items()}
