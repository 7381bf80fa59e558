"""Exact quantiles by repeated histograms.

A rank of a group's values is found in rounds. A round counts the values of every
interval that still holds a wanted rank by bin, with each bin's least and greatest
value: at first by sign and power of two, then in BINS equal parts, which is monotone
in the value whatever the rounding. Counts are added up before they are shuffled, so
what travels is a row for a bin and task, not a value; an interval's bins are ranked in
one bounded window and the bins that hold wanted ranks are the next round's intervals.
All groups, all ranks and both neighbours of an interpolated quantile go through the
same rounds. Groups and intervals of FEW values or less are ranked value by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.sources.store import cut

BINS = 4096
#: Values that are ranked one by one in a window.
FEW = 50_000
#: Intervals (a row each) that are broadcast at most; more are joined by a shuffle.
MAX_SENT = 100_000
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _power(x: Column) -> Column:
    """A number that never falls as x grows: sign and power of two."""
    own = F.signum(x) * (F.floor(F.log2(F.abs(x))) + 2000)
    return F.when(F.isnan(x), 9999).when(F.abs(x) == float("inf"), F.signum(x) * 5000).when(x == 0, 0).otherwise(own).cast("double")


def _at_ranks(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, rank, v): the value of each wanted rank of a group from 0. values: g, v;
    wanted: g, rank, each once. Runs jobs."""
    kind = dict(values.dtypes)["v"]
    # an interval: its group, number, ends, and the values of its group below it
    sizes = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    active = cut(sizes.join(wanted.select(F.col("g").alias("wg")).distinct(), F.col("g").eqNullSafe(F.col("wg"))).select("g", F.lit(0.0).alias("i"), "lo", "hi", F.lit(0).cast("long").alias("below"), "n"))
    out = None
    for number in range(40):  # 12 bits of 64 or more a round
        left = active.filter("lo < hi").count()
        done = _holding(active.filter("lo = hi"), wanted).select("g", "rank", F.col("lo").alias("v"))
        out = done if out is None else out.unionAll(done)
        if not left:
            return out
        some = active.filter("lo < hi").withColumnsRenamed({"g": "ag", "n": "held"})
        x, lo, hi = F.col("v").cast("double"), F.col("lo").cast("double"), F.col("hi").cast("double")
        by_part = F.least(F.floor((x - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("double")
        if kind in _INTEGRAL:  # neighbours beyond 2 ** 53 may be one double
            by_part = F.when(lo == hi, (F.col("v") - F.col("lo")).cast("double")).otherwise(by_part)
        bin_ = F.when(F.col("held") <= FEW, x).otherwise(by_part if number else _power(x))
        inside = values.join(F.broadcast(some) if left <= MAX_SENT else some, F.col("g").eqNullSafe(F.col("ag")) & F.col("v").between(F.col("lo"), F.col("hi")))
        bins = inside.groupBy("g", "i", "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("g", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        held = _holding(bins, wanted).select("g", "below", "lo", "hi", "n").distinct()
        # the values below an interval number it: no two intervals of a group have the same
        active = cut(held.select("g", F.col("below").cast("double").alias("i"), "lo", "hi", "below", "n"))
    raise RuntimeError("a rank was not found")


def _holding(intervals: DataFrame, wanted: DataFrame) -> DataFrame:
    """intervals joined with the wanted ranks that they hold."""
    w = wanted.withColumnRenamed("g", "wg")
    return intervals.join(w, F.col("g").eqNullSafe(F.col("wg")) & (F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (), how: str = "linear") -> DataFrame:
    """(by ..., q, value) of the values that are not null, for each group (null is a
    group) and q. how: "linear" interpolates between the neighbours of rank (n - 1) q,
    "nearest" takes the value at rank round((n - 1) q), halves to even. Without by a
    table without values gives null. Whole numbers stay exact; decimals count as
    doubles; NaN is the greatest value. Runs jobs over a copy of the columns read."""
    if how not in ("linear", "nearest"):
        raise ValueError(how)
    kind = dict(df.dtypes)[col]
    v = F.col(col) if kind in _INTEGRAL else F.col(col).cast("double")
    keys = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("_"))
    values = cut(df.filter(F.col(col).isNotNull()).select(keys.alias("g"), v.alias("v")))
    if kind not in _INTEGRAL:
        values = values.withColumn("v", F.when(F.isnan("v"), F.lit(float("nan"))).otherwise(F.col("v") + 0.0))
    sizes = cut(values.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)]))
    place = (F.col("n") - 1) * F.col("q")
    near = (F.rint(place) if how == "nearest" else F.floor(place)).cast("long")
    asked = sizes.select("g", "n", each.alias("e")).select("g", "n", "e.k", "e.q").withColumn("place", place).withColumn("r0", near)
    asked = asked.withColumn("r1", F.when(F.col("place") > F.col("r0"), F.col("r0") + 1).otherwise(F.col("r0")) if how == "linear" else F.col("r0"))
    ranks = asked.select("g", "n", F.explode(F.array("r0", "r1")).alias("rank")).distinct()
    big = ranks.filter(F.col("n") > FEW).drop("n")
    n_big = sizes.filter(F.col("n") > FEW).count()
    few = values
    if n_big:
        large = sizes.filter(F.col("n") > FEW).select(F.col("g").alias("lg"))
        few = values.join(F.broadcast(large) if n_big <= MAX_SENT else large, F.col("g").eqNullSafe(F.col("lg")), "left_anti")
    turn = F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1  # FEW rows at most
    small = few.withColumn("rank", turn).join(ranks.select(F.col("g").alias("wg"), F.col("rank").alias("wr")), F.col("g").eqNullSafe(F.col("wg")) & (F.col("rank") == F.col("wr"))).select("g", F.col("rank").cast("long").alias("rank"), "v")
    found = cut(small.unionAll(_at_ranks(values, cut(big)))) if n_big else cut(small)
    a, b = (found.select(F.col("g").alias(f"g{i}"), F.col("rank").alias(f"rank{i}"), F.col("v").alias(f"v{i}")) for i in "01")
    out = asked.join(a, F.col("g").eqNullSafe(F.col("g0")) & (F.col("r0") == F.col("rank0"))).join(b, F.col("g").eqNullSafe(F.col("g1")) & (F.col("r1") == F.col("rank1")))
    part = F.col("place") - F.col("r0")
    value = F.when(F.col("r0") == F.col("r1"), F.col("v0").cast("double")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part) if how == "linear" else F.col("v0")
    out = out.select(*[F.col(f"g.{c}").alias(c) for c in by], "q", value.alias("value"))
    if by:
        return out
    every = df.sparkSession.createDataFrame([(float(q),) for q in qs], "q double").distinct()
    return every.join(F.broadcast(out.distinct()), "q", "left")


def spread(found: DataFrame, names: Sequence[tuple[float, str]], by: Sequence[str] = ()) -> DataFrame:
    """quantiles() with a column for each (q, name) in place of rows."""
    columns = [F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name) for q, name in names]
    return found.groupBy(*by).agg(*columns) if by else found.agg(*columns)
