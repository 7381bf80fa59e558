"""Checks of labels against people and against each other, with intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.labels import in_set
from ravelin.operators.bootstrap import interval, replicate_sums
from ravelin.operators.stats import consensus, wilson


def precision_by_stratum(df: DataFrame, stratum: str, right: Column, z: float = 1.96) -> DataFrame:
    """(stratum, n, n_right, share, lo, hi); the interval is clipped to 0 and 1."""
    g = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"))
    lo, hi = wilson(F.col("n_right"), F.col("n"), z)
    return g.select(stratum, "n", "n_right", (F.col("n_right") / F.col("n")).alias("share"), F.greatest(lo, F.lit(0.0)).alias("lo"), F.least(hi, F.lit(1.0)).alias("hi"))


def two_axis_seasonality(df: DataFrame, month: Column, label: Column, peak: Sequence[int], trough: Sequence[int]) -> DataFrame:
    """(axis, peak_rate, trough_rate, ratio) for the narrow and the broad set."""
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), in_set(label, a).cast("double").alias("hit")) for a in ("narrow", "broad")]))
    rows = df.select(month.alias("__month"), both.alias("s"))
    m = F.col("__month")
    g = rows.groupBy("s.axis").agg(F.avg(F.when(m.isin(*peak), F.col("s.hit"))).alias("peak_rate"), F.avg(F.when(m.isin(*trough), F.col("s.hit"))).alias("trough_rate"))
    return g.withColumn("ratio", F.col("peak_rate") / F.nullif(F.col("trough_rate"), F.lit(0.0)))


def overlap_agreement(a: DataFrame, b: DataFrame, key: str, label: str = "label") -> DataFrame:
    """One row: rows that both label, and the share on which they agree."""
    j = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("agreement"))


def cross_tab(df: DataFrame, human: str, model: str) -> DataFrame:
    """(side, label, n): counts of human labels, of model labels and of changes
    from the one to the other, written human>model."""
    human_, model_ = F.col(human), F.col(model)
    each = F.array(F.struct(F.lit("human").alias("side"), human_.alias("label")), F.struct(F.lit("model").alias("side"), model_.alias("label")), F.struct(F.lit("change").alias("side"), F.concat(human_, F.lit(">"), model_).alias("label")))
    return df.select(F.explode(each).alias("s")).groupBy("s.side", "s.label").agg(F.count(F.lit(1)).alias("n"))


def common_seeds(runs: DataFrame, condition: str = "condition", seed: str = "seed") -> DataFrame:
    """Seeds under which every condition has a run."""
    n = runs.agg(F.count_distinct(condition).alias("conditions"))
    return runs.groupBy(seed).agg(F.count_distinct(condition).alias("k")).crossJoin(F.broadcast(n)).filter("k = conditions").select(seed)


def primary_reference(df: DataFrame, raters: Sequence[str], name: str) -> DataFrame:
    """df with `reference`: a named rater's label, or the majority of two or more."""
    if name == "majority":
        if len(raters) < 2:
            raise ValueError("a majority needs two raters")
        return df.withColumn("reference", consensus([F.col(r) for r in raters]))
    if name not in raters:
        raise ValueError(f"no rater {name}")
    return df.withColumn("reference", F.col(name))


def _rate(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0.0))


def _with_interval(rows: DataFrame, columns: dict[str, Column], value: Column, name: str, key: str, replicates: int, seed: int) -> DataFrame:
    """One row: a value of the columns' sums under the given name, lo and hi."""
    point = rows.agg(*[F.sum(c).alias(n) for n, c in columns.items()]).select(value.alias(name))
    return point.crossJoin(interval(replicate_sums(rows, key, columns, replicates, seed), value))


def ratio_ci(df: DataFrame, key: str, hit: Column, top: Column, bottom: Column, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the ratio of the rates of hit among rows of top and of bottom, with
    lo and hi; replicates without a bottom rate do not count."""
    rows = df.select(key, hit.cast("double").alias("h"), top.alias("t"), bottom.alias("b"))
    columns = {f"{c}{part}": F.when(F.col(c), F.col("h") if part == "h" else F.lit(1.0)).otherwise(0.0) for c in "tb" for part in "hn"}
    return _with_interval(rows, columns, _rate("th", "tn") / F.nullif(_rate("bh", "bn"), F.lit(0.0)), "ratio", key, replicates, seed)


def f1_ci(df: DataFrame, key: str, ref: Column, pred: Column, replicates: int = 2000, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """One row: F1 of a two-valued label with lo and hi, rows weighted if asked."""
    rows = df.select(key, ref.alias("r"), pred.alias("p"), (weight if weight is not None else F.lit(1.0)).alias("v"))
    r, p = F.col("r"), F.col("p")
    columns = {name: F.when(on, F.col("v")).otherwise(0.0) for name, on in (("tp", r & p), ("in_ref", r), ("in_pred", p))}
    f1 = 2 * F.col("tp") / F.nullif(F.col("in_ref") + F.col("in_pred"), F.lit(0.0))
    return _with_interval(rows, columns, f1, "f1", key, replicates, seed)


def calibrated_ci(model: DataFrame, checked: DataFrame, key: str, label: str, right: Column, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the calibrated rate with lo and hi. model: all rows with their model
    label; checked: rows with the label and whether a person calls it positive.
    Shares and predictive values are resampled apart; replicates in which a label
    with a share lacks a value do not count."""

    def rate(shares: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
        j = shares.join(values, [*by, label], "left")
        bad = F.bool_or((F.col("share") > 0) & F.col("ppv").isNull())
        g = j.groupBy(*by) if by else j.groupBy()
        return g.agg(F.when(~bad, F.sum(F.col("share") * F.coalesce("ppv", F.lit(0.0)))).alias("m"))

    def shares(n: DataFrame, by: list[str]) -> DataFrame:
        total = n.groupBy(*by).agg(F.sum("n").alias("t"))
        j = n.join(total, by) if by else n.crossJoin(F.broadcast(total))
        return j.select(*by, label, _rate("n", "t").alias("share"))

    ok = checked.select(key, label, right.cast("double").alias("__r"))
    n = model.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    point = rate(shares(n, []), ok.groupBy(label).agg(F.avg("__r").alias("ppv")), [])
    a = replicate_sums(model, key, {}, replicates, seed, by=label).withColumnRenamed("w", "n")
    b = replicate_sums(ok, key, {"r": F.col("__r")}, replicates, seed + 1, by=label).select("rep", label, _rate("r", "w").alias("ppv"))
    return point.withColumnRenamed("m", "rate").crossJoin(interval(rate(shares(a, ["rep"]), b, ["rep"]), F.col("m")))
