"""Ordered histories of users: positions, gaps, splits, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.time import elapsed_days, micros
from ravelin.operators.quantiles import quantiles

ORDER = ("ts", "row_id")


def by_user(user: str = "user_id") -> Window:
    return Window.partitionBy(user).orderBy(*ORDER)


def with_position(df: DataFrame, user: str = "user_id") -> DataFrame:
    """df with seq_pos (0 and up by time and row id) and seq_len."""
    return df.withColumn("seq_pos", (F.row_number().over(by_user(user)) - 1).cast("long")).withColumn("seq_len", F.count(F.lit(1)).over(Window.partitionBy(user)))


def slot(pos: Column, n: Column) -> Column:
    """first, middle or last; of a single row, first."""
    return F.when(pos == 0, "first").when(pos == n - 1, "last").otherwise("middle")


def with_gap(df: DataFrame, user: str = "user_id") -> DataFrame:
    """df with gap_days to the next row of the user (null at the last)."""
    return df.withColumn("gap_days", elapsed_days(F.lead("ts").over(by_user(user)), F.col("ts")))


def median_gap(df: DataFrame, user: str = "user_id") -> DataFrame:
    """median_gap_days: the median over users of their median gap between rows. Runs jobs."""
    gap = (micros(F.col("ts")) - micros(F.lag("ts").over(by_user(user)))) / F.lit(86_400_000_000)
    each = quantiles(df.select(user, gap.alias("gap")), "gap", [0.5], by=[user])
    return quantiles(each, "value", [0.5]).select(F.col("value").alias("median_gap_days"))


def leave_one_out(df: DataFrame, user: str = "user_id") -> DataFrame:
    """df with split: a user's last row is test, the one before valid, others train."""
    left = F.col("seq_len") - F.col("seq_pos")
    return with_position(df, user).withColumn("split", F.when(left == 1, "test").when(left == 2, "valid").otherwise("train"))


def eligible_users(split: DataFrame, label: str = "self", user: str = "user_id") -> DataFrame:
    """Users whose test row has the label."""
    return split.filter((F.col("split") == "test") & (F.col("label") == label)).select(user).distinct()


def expand(split: DataFrame, most: int = 50, label: str = "self", user: str = "user_id") -> DataFrame:
    """A row for each item to predict with the items before it: history (an array
    of at most `most`) and target. Train starts at a user's second item, valid
    without history is left out, test is kept for the label alone."""
    w = by_user(user).rowsBetween(-most, -1)
    rows = split.withColumn("history", F.collect_list("item").over(w))
    keep = ((F.col("split") != "test") & (F.size("history") > 0)) | ((F.col("split") == "test") & (F.col("label") == label))
    return rows.filter(keep).select(user, "split", "row_id", F.col("item").alias("target"), "history")


def first_and_last(df: DataFrame, value: str, user: str = "user_id") -> DataFrame:
    """For each user the value of the first, last and second-last row."""
    key = F.struct("ts", "row_id")
    w = Window.partitionBy(user).orderBy(*ORDER)
    prev = df.withColumn("__prev", F.lag(value).over(w))
    return prev.groupBy(user).agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"), F.max_by("__prev", key).alias("second_last"))


def turn_alternation(turns: DataFrame) -> DataFrame:
    """For each conversation: turns, changes of role between neighbours, and
    whether the first and last roles are user and assistant."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    t = turns.withColumn("changed", (F.col("role") != F.lag("role").over(w)).cast("long"))
    key = F.struct("turn", "role")
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_changes"), F.min_by("role", key).alias("first_role"), F.max_by("role", key).alias("last_role"))
