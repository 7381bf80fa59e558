"""Histories of users: positions, gaps, splits, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.labels import in_set
from ravelin.operators import sequence as seq
from ravelin.plans.registry import EV, SPLIT, query
from ravelin.sources.views import events_log, table


@query(f"WITH {SPLIT} SELECT user_id, row_id, seq_pos, seq_len FROM pos")
def sequence_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.with_position(events_log(spark, sf_dir)).select("user_id", "row_id", "seq_pos", "seq_len")


@query(f"""WITH {SPLIT} SELECT CASE WHEN seq_pos = 0 THEN 'first' WHEN seq_pos = seq_len - 1 THEN 'last' ELSE 'middle' END AS slot, count(*) AS n,
round(avg((label = 'gift_given')::INT::DOUBLE), 6) AS rate FROM pos GROUP BY 1""")
def slot_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.with_position(events_log(spark, sf_dir)).withColumn("slot", seq.slot(F.col("seq_pos"), F.col("seq_len")))
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(in_set(F.col("label")).cast("double")), 6).alias("rate"))


@query(f"""WITH {EV} SELECT row_id, user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, row_id)) - epoch_us(ts)) // 86400000000 AS gap_days FROM ev""")
def gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.with_gap(events_log(spark, sf_dir)).select("row_id", "user_id", "gap_days")


@query(f"""WITH {EV}, g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, row_id))) / 86400000000::DOUBLE AS gap FROM ev),
u AS (SELECT user_id, median(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT round(median(gap), 6) AS median_gap_days FROM u""")
def median_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.median_gap(events_log(spark, sf_dir)).select(F.round("median_gap_days", 6).alias("median_gap_days"))


@query(f"""WITH {EV}, g AS (SELECT *, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, row_id)) - epoch_us(ts)) // 86400000000 AS gap FROM ev)
SELECT (label = 'gift_given') AS after_gift, count(*) AS n, round(avg((gap = 0)::INT::DOUBLE), 6) AS same_day FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def same_day_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.with_gap(events_log(spark, sf_dir)).filter("gap_days IS NOT NULL")
    return rows.groupBy(in_set(F.col("label")).alias("after_gift")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("gap_days") == 0).cast("double")), 6).alias("same_day"))


@query(f"WITH {SPLIT} SELECT user_id, item, row_id, label, split FROM sp")
def loo_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.leave_one_out(events_log(spark, sf_dir)).select("user_id", "item", "row_id", "label", "split")


@query(f"WITH {SPLIT} SELECT DISTINCT user_id FROM sp WHERE split = 'test' AND label = 'self'")
def eval_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.eligible_users(seq.leave_one_out(events_log(spark, sf_dir)))


@query(f"""WITH {SPLIT}, h AS (SELECT *, list(item) OVER (PARTITION BY user_id ORDER BY ts, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hist FROM sp)
SELECT user_id, split, row_id, item AS target, coalesce(array_to_string(hist, ' '), '') AS history FROM h
WHERE (split <> 'test' AND len(coalesce(hist, [])) > 0) OR (split = 'test' AND label = 'self')""")
def sequence_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq.expand(seq.leave_one_out(events_log(spark, sf_dir)), most=10)
    return rows.withColumn("history", F.array_join("history", " "))


@query(f"""WITH {SPLIT}, f AS (SELECT user_id, label AS l, seq_pos, seq_len FROM pos)
SELECT user_id, max(CASE WHEN seq_pos = 0 THEN l END) AS first, max(CASE WHEN seq_pos = seq_len - 1 THEN l END) AS last, max(CASE WHEN seq_pos = seq_len - 2 THEN l END) AS second_last FROM f GROUP BY 1""")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.first_and_last(events_log(spark, sf_dir), "label")


@query("""WITH t AS (SELECT *, (role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role))::BIGINT AS changed FROM conversations)
SELECT conv_id, count(*) AS n_turns, coalesce(sum(changed), 0)::BIGINT AS n_changes, arg_min(role, (turn, role)) AS first_role, arg_max(role, (turn, role)) AS last_role FROM t GROUP BY 1""")
def turn_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.turn_alternation(table(spark, sf_dir, "conversations"))
