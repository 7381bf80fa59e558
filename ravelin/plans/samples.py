"""Allocation, draws and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.operators import sampling as sm
from ravelin.plans.registry import DOC, OD, query
from ravelin.sources.store import cut
from ravelin.sources.views import documents_log, orders_log

_ST = "month(ts) || '|' || label AS stratum"
_COUNTS = f"{OD}, st AS (SELECT *, {_ST} FROM od), c AS (SELECT stratum, count(*) AS n FROM st GROUP BY 1)"


def _alloc(counts: str, total: int, name: str = "al") -> str:
    return f"""{name}0 AS (SELECT *, (sum(n) OVER ())::BIGINT AS s, least({total}, (sum(n) OVER ())::BIGINT) AS want FROM {counts}),
{name}1 AS (SELECT *, n * want // s AS fl, n * want % s AS rest FROM {name}0),
{name} AS (SELECT stratum, n, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= want - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS alloc FROM {name}1)"""


def _stratum():
    return F.concat_ws("|", F.month("ts").cast("string"), F.col("label"))


@query(f"WITH {_COUNTS}, {_alloc('c', 5000)} SELECT * FROM al")
def strata_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir).withColumn("stratum", _stratum())
    return sm.allocate(log.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")), 5000)


@query(f"""WITH {_COUNTS}, {_alloc('c', 5000)}, d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || stratum || '|' || row_id), row_id) AS rn FROM st)
SELECT d.stratum, d.row_id FROM d JOIN al USING (stratum) WHERE rn <= alloc""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.stratified(orders_log(spark, sf_dir), _stratum(), 5000, 42).select("stratum", "row_id")


_MAIN = f"""{_COUNTS}, {_alloc('c', 2000)}, d AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || stratum || '|' || row_id), row_id) AS rn FROM st),
mainf AS (SELECT d.row_id FROM d JOIN al USING (stratum) WHERE rn <= alloc)"""


@query(f"""WITH {_MAIN}, b AS (SELECT row_id, row_number() OVER (ORDER BY md5('43|boost|' || row_id), row_id) AS rn FROM od WHERE label = 'gift_given' AND row_id NOT IN (SELECT row_id FROM mainf))
SELECT 'main' AS frame, row_id FROM mainf UNION ALL SELECT 'boost', row_id FROM b WHERE rn <= 500""")
def boost_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(orders_log(spark, sf_dir).select("row_id", "label", _stratum().alias("of")))  # read in every pass of the draws
    return sm.frames(log, F.col("of"), 2000, [("boost", F.col("label") == "gift_given", 500)], 42).select("frame", "row_id")


@query(f"""WITH {DOC}, f AS (SELECT regexp_matches(lower(text), '\\bthe\\b') AS p, regexp_matches(lower(text), '\\bof\\b') AS s, regexp_matches(lower(text), '\\bthat\\b') AS r FROM doc)
SELECT CASE WHEN p THEN 'proxy' WHEN r THEN 'received' WHEN s THEN 'speculative' ELSE 'unflagged' END AS stratum, count(*) AS n FROM f GROUP BY 1""")
def trial_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.col("text"))
    flags = [t.rlike(rf"\b{w}\b") for w in ("the", "of", "that")]
    return documents_log(spark, sf_dir).select(sm.trial_stratum(*flags).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOC}, r AS (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY md5('7|' || category || '|' || row_id), row_id) AS rn FROM doc)
SELECT row_id, category, CASE WHEN rn <= CASE WHEN n < 2 THEN 0 ELSE round_even(n * 0.1::DOUBLE, 0) END THEN 'holdout' ELSE 'train' END AS part FROM r""")
def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.holdout(documents_log(spark, sf_dir), F.col("category"), 0.1, 7).select("row_id", "category", "part")


@query(f"WITH {DOC}, s AS (SELECT row_id, md5('5|main|' || row_id) AS k FROM doc), p AS (SELECT row_id, row_number() OVER (ORDER BY k, row_id) AS rn FROM s), q AS (SELECT row_id FROM p WHERE rn <= 100) SELECT row_id, (row_number() OVER (ORDER BY md5('6|shuffle|' || row_id), row_id))::INT AS sample_id FROM q")
def shuffled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = sm.draw(documents_log(spark, sf_dir).select("row_id"), F.lit("main"), 100, 5)
    return sm.shuffled(some, 6).select("row_id", "sample_id")


@query(f"WITH {OD}, r AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i FROM od) SELECT row_id FROM r WHERE i % 4 = 1")
def worker_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.worker_slice(orders_log(spark, sf_dir).select("row_id"), 1, 4)


@query(f"""WITH {DOC}, n AS (SELECT row_id, len(regexp_extract_all(text, '[^\\s\\x0b]+')) AS n FROM doc)
SELECT CASE WHEN n < 15 THEN '<15' WHEN n < 40 THEN '15-40' ELSE '>=40' END AS bucket, count(*) AS n FROM n GROUP BY 1""")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_log(spark, sf_dir).select(tx.length_bucket(tx.word_count(F.col("text"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
