"""Shares of ranked lists spent on categories that a user only ever bought as gifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators.sequence import ORDER


def gift_only(history: DataFrame, gift: Column, user: str = "user_id", category: str = "subcat") -> DataFrame:
    """(user, category) with a gift row and no other."""
    g = history.filter(F.col(category).isNotNull()).groupBy(user, category).agg(F.bool_or(gift).alias("any"), F.bool_or(~gift).alias("other"))
    return g.filter("any AND NOT other").select(user, category)


def list_share(topk: DataFrame, items: DataFrame, target: DataFrame, k: int, user: str = "user_id", category: str = "subcat") -> DataFrame:
    """(user, share): slots of a user's list in a target category, over k; users
    without a slot there have 0. topk has an item of null for an empty list."""
    j = topk.join(items, "item", "left").join(target.withColumn("__hit", F.lit(1)), [user, category], "left")
    return j.groupBy(user).agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.lit(float(k))).alias("share"))


def gift_buckets(history: DataFrame, gift: Column, own: Column, only: DataFrame, most: int = 10, user: str = "user_id", category: str = "subcat") -> DataFrame:
    """(user, category, bucket) of users whose last gift lies in a gift-only
    category: how many of their own rows followed it, at most `most`."""
    w = Window.partitionBy(user).orderBy(*ORDER)
    rows = history.withColumn("__pos", F.row_number().over(w)).withColumn("__gift", gift).withColumn("__own", own)
    last = rows.filter("__gift").groupBy(user).agg(F.max("__pos").alias("__at"), F.max_by(category, "__pos").alias(category)).join(only, [user, category], "left_semi")
    after = rows.join(last, user).filter("__own AND __pos > __at").groupBy(user).agg(F.count(F.lit(1)).alias("n"))
    return last.select(user, category).join(after, user, "left").select(user, category, F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("int").alias("bucket"))


def excess_points(buckets: DataFrame, a: DataFrame, b: DataFrame, items: DataFrame, k: int, user: str = "user_id", category: str = "subcat") -> DataFrame:
    """(bucket, n_users, share_a, share_b, excess) from gift_buckets(): the mean
    shares of the lists a and b that lie in the category of a user's last gift, and
    their difference; users that lack a list are left out."""
    target = buckets.select(user, category)
    x = list_share(a, items, target, k, user, category).withColumnRenamed("share", "x")
    y = list_share(b, items, target, k, user, category).withColumnRenamed("share", "y")
    g = buckets.join(x, user).join(y, user).groupBy("bucket")
    return g.agg(F.count(F.lit(1)).alias("n_users"), F.avg("x").alias("share_a"), F.avg("y").alias("share_b"), F.avg(F.col("x") - F.col("y")).alias("excess"))


def terciles(lengths: DataFrame, n: str = "n", user: str = "user_id") -> DataFrame:
    """(user, tercile) by linear quantiles at 1/3 and 2/3; ties go low."""
    cuts = lengths.agg(F.percentile(n, [1 / 3, 2 / 3]).alias("q"))
    j = lengths.crossJoin(F.broadcast(cuts))
    return j.select(user, F.when(F.col(n) <= F.col("q")[0], "low").when(F.col(n) <= F.col("q")[1], "mid").otherwise("high").alias("tercile"))


def waste_contrast(a: DataFrame, b: DataFrame, items: DataFrame, target: DataFrame, k: int, user: str = "user_id", category: str = "subcat") -> DataFrame:
    """One row over users with a target category (exposed): n_exposed, mean_a,
    mean_b, diff of the shares of their lists a and b that lie in it."""
    exposed = target.select(user).distinct()
    x = list_share(a, items, target, k, user, category).withColumnRenamed("share", "x")
    y = list_share(b, items, target, k, user, category).withColumnRenamed("share", "y")
    j = exposed.join(x, user).join(y, user)
    return j.agg(F.count(F.lit(1)).alias("n_exposed"), F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.avg(F.col("x") - F.col("y")).alias("diff"))


def segment_contrast(a: DataFrame, b: DataFrame, segments: DataFrame, metric: str, segment: str = "tercile", user: str = "user_id") -> DataFrame:
    """(segment, n_users, diff): mean difference of a metric between two runs inside
    each segment of users."""
    j = a.select(user, F.col(metric).alias("x")).join(b.select(user, F.col(metric).alias("y")), user).join(segments, user)
    return j.groupBy(segment).agg(F.count(F.lit(1)).alias("n_users"), F.avg(F.col("x") - F.col("y")).alias("diff"))
