"""Tables and figure datasets: rates by group, grids, empirical distributions.

Distributions on a grid are computed from counts by value, never by crossing a
grid with rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_by(df: DataFrame, by: Sequence[Column], hit: Column, least: int = 0) -> DataFrame:
    """(by, n, n_hits, rate) of the groups of at least so many rows."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hits"))
    out = out.filter(F.col("n") >= least) if least else out
    return out.withColumn("rate", F.col("n_hits") / F.col("n"))


def ecdf_grid(df: DataFrame, value: str, grid: Sequence[float]) -> DataFrame:
    """(x, share): the share of values not null at or below each grid point."""
    place = F.lit(0)
    for g in grid:
        place = place + (F.col(value) > F.lit(float(g))).cast("int")
    counts = df.filter(F.col(value).isNotNull()).groupBy(place.alias("i")).agg(F.count(F.lit(1)).alias("c"))
    points = df.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "i int, x double")
    total = counts.agg(F.sum("c").alias("total"))
    j = points.join(counts, "i", "left").withColumn("c", F.coalesce("c", F.lit(0))).crossJoin(F.broadcast(total))
    upto = F.sum("c").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row for each grid point
    return j.select("x", (upto / F.col("total")).alias("share"))


def survival(counts: DataFrame, n: str, most: int) -> DataFrame:
    """(x, share): the share of rows whose n is x or more, x = 1 to most."""
    by = counts.groupBy(F.least(F.col(n), F.lit(most)).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.count(F.lit(1)).alias("total"))
    grid = counts.sparkSession.range(1, most + 1).select(F.col("id").alias("x"))
    j = grid.join(by, "x", "left").crossJoin(F.broadcast(total)).withColumn("c", F.coalesce("c", F.lit(0)))
    over = F.sum("c").over(Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return j.select(F.col("x").cast("long").alias("x"), (over / F.col("total")).alias("share"))


def value_grid(df: DataFrame, value: Column, grid: Sequence[int]) -> DataFrame:
    """(x, n): rows with each grid value, 0 where there is none, and last a row
    with x null for those that have none of them."""
    on = F.when(value.isin(*[int(g) for g in grid]), value.cast("long"))
    counts = df.groupBy(on.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    points = df.sparkSession.createDataFrame([(int(g),) for g in grid] + [(None,)], "x long")
    j = points.alias("p").join(counts.alias("c"), F.col("p.x").eqNullSafe(F.col("c.x")), "left")
    return j.select("p.x", F.coalesce("c.c", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) over equal bins; the last is closed at its upper end."""
    b = F.least(F.floor((F.col(value) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1))
    counts = df.filter(F.col(value).between(lo, hi)).groupBy(b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def profile(df: DataFrame, user: str, item: str) -> DataFrame:
    """One row: rows, users, items, density, mean and median rows by user and item,
    share of rows that the busiest tenth of items holds (at least one item)."""
    u = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    i = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    us = u.agg(F.count(F.lit(1)).alias("n_users"), F.avg("n").alias("mean_user"), F.median("n").alias("median_user"), F.sum("n").alias("n_rows"))
    it = i.agg(F.count(F.lit(1)).alias("n_items"), F.avg("n").alias("mean_item"), F.median("n").alias("median_item"))
    levels = i.groupBy("n").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(i.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / F.lit(10))).alias("top"))))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # different counts only
    held = levels.withColumn("take", F.greatest(F.lit(0), F.least(F.col("c"), F.col("top") - before))).agg(F.sum(F.col("take") * F.col("n")).alias("held"))
    j = us.crossJoin(it).crossJoin(held)
    return j.select("n_rows", "n_users", "n_items", (F.col("n_rows") / (F.col("n_users") * F.col("n_items"))).alias("density"), "mean_user", "median_user", "mean_item", "median_item", (F.col("held") / F.col("n_rows")).alias("top_decile_share"))


def feasibility(df: DataFrame, hit: Column, user: str = "user_id") -> DataFrame:
    """One row over users: share with a hit, with a hit in the last row, with hits
    only, eligible (last is none), and the mean share of hits among those with one."""
    u = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"), F.max_by(hit, F.struct("ts", "row_id")).alias("last"))
    k = F.col("k") > 0
    return u.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg(k.cast("double")).alias("share_any"),
        F.avg(F.col("last").cast("double")).alias("share_last"),
        F.avg((F.col("k") == F.col("n")).cast("double")).alias("share_all"),
        F.avg(1 - F.col("last").cast("double")).alias("share_eligible"),
        F.avg(F.when(k, F.col("k") / F.col("n"))).alias("mean_share"),
    )


def digest(text: str = "text") -> Column:
    """A text's 256-bit digest: to be selected in its stead before duplicates()."""
    return F.sha2(F.col(text).cast("binary"), 256)


def duplicates(key: str = "digest") -> Column:
    """Whether a row's key occurs more than once."""
    return F.count(F.lit(1)).over(Window.partitionBy(key)) > 1


def item_concentration(df: DataFrame, hit: Column, least: int = 20) -> DataFrame:
    """(item, n, rate) of items with at least so many rows."""
    return rate_by(df, [F.col("item")], hit, least).select("item", "n", "rate")
