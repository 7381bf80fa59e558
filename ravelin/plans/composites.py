"""Composite operators: two-level samples, drift, benchmark files, contrasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import experiment as ex
from ravelin.operators import marketing as mk
from ravelin.operators import sampling as sm
from ravelin.plans.experiments import _TWO, _per_user, _split
from ravelin.plans.measures import _HIST, _ONLY, _history, _hit
from ravelin.plans.registry import DOC, SPLIT, query
from ravelin.sources.views import documents_log, events_log, table

_ROLES = {"en": 0.5, "de": 0.3, "fr": 0.2}
_STRATA = {"short": 0.5, "long": 0.5}
_WANT = {f"{r}|{s}": n for r, m in sm.share_allocation(_ROLES, 60).items() for s, n in sm.share_allocation(_STRATA, m).items()}
_VALUES = ", ".join(f"('{k}', {n})" for k, n in _WANT.items())


@query(f"""WITH {DOC}, c AS (SELECT row_id, lang AS role, CASE WHEN length(text) < 1500 THEN 'short' ELSE 'long' END AS stratum FROM doc WHERE row_id % 10 <> 0),
d AS (SELECT *, row_number() OVER (PARTITION BY role, stratum ORDER BY md5('11|' || role || '|' || stratum || '|' || row_id), row_id) AS rn FROM c), w(cell, n) AS (VALUES {_VALUES}),
s AS (SELECT row_id, role, stratum FROM d JOIN w ON cell = role || '|' || stratum WHERE rn <= n)
SELECT *, (row_number() OVER (ORDER BY md5('11|shuffle|' || row_id), row_id))::INT AS sample_id FROM s""")
def trial_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir)
    out, _ = sm.two_level(d, F.col("lang"), F.when(F.char_length("text") < 1500, "short").otherwise("long"), _ROLES, _STRATA, 60, 11, excluded=d.filter("row_id % 10 = 0").select("row_id"))
    return out.select("row_id", "role", "stratum", "sample_id")


@query(f"""WITH {DOC}, s AS (SELECT row_id, CASE WHEN row_id % 50 = 0 THEN text || '!' ELSE text END AS text FROM doc UNION ALL SELECT -1, 'x')
SELECT count(*) AS n, count(*) FILTER (doc.row_id IS NULL) AS missing, count(*) FILTER (doc.row_id IS NOT NULL AND s.text <> doc.text) AS drifted FROM s LEFT JOIN doc ON s.row_id = doc.row_id""")
def text_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir).select("row_id", "text")
    s = d.withColumn("text", F.when(F.col("row_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return sm.text_drift(s.unionAll(spark.createDataFrame([(-1, "x")], "row_id long, text string")), d, ["row_id"])


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items FROM sp WHERE split <> 'test' OR label = 'self' GROUP BY 1")
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ex.benchmark_split(_split(spark, sf_dir))
    return b.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item").alias("n_items"))


_LISTS = "ta AS (SELECT user_id, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, row_id) AS r FROM h) WHERE r <= 10), tb AS (SELECT user_id, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY price, row_id) AS r FROM h) WHERE r <= 10)"


def _share(name: str) -> str:
    return f"(SELECT t.user_id, count(go.subcat) / 10.0::DOUBLE AS share FROM {name} t JOIN part ON t.item = p_partkey LEFT JOIN go ON go.user_id = t.user_id AND go.subcat = p_type GROUP BY 1)"


@query(f"""WITH {_HIST}, {_ONLY}, {_LISTS}, e AS (SELECT DISTINCT user_id FROM go)
SELECT count(*) AS n_exposed, round(avg(x.share), 6) AS mean_a, round(avg(y.share), 6) AS mean_b, round(avg(x.share - y.share), 6) AS diff FROM e JOIN {_share('ta')} x USING (user_id) JOIN {_share('tb')} y USING (user_id)""")
def m1_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)

    def top(order) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy(order, "row_id")
        return h.withColumn("r", F.row_number().over(w)).filter("r <= 10").select("user_id", "item")

    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("subcat"))
    c = mk.waste_contrast(top(F.desc("price")), top(F.asc("price")), items, mk.gift_only(h, _hit()), 10)
    return c.select("n_exposed", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "diff")])


@query(f"""WITH {_TWO}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1), q AS (SELECT quantile_cont(n, {1 / 3!r}::DOUBLE) AS a, quantile_cont(n, {2 / 3!r}::DOUBLE) AS b FROM n),
t AS (SELECT user_id, CASE WHEN n <= a THEN 'low' WHEN n <= b THEN 'mid' ELSE 'high' END AS tercile FROM n, q)
SELECT tercile, count(*) AS n_users, round(avg(x.ndcg_10 - y.ndcg_10), 6) AS diff FROM m x JOIN m4 y USING (user_id) JOIN t USING (user_id) GROUP BY 1""")
def m3_segment_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    seg = mk.terciles(events_log(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    a, b = (_per_user(sp, ex.condition(sp, c)) for c in ("C1", "C4"))
    return mk.segment_contrast(a, b, seg, "ndcg_10").withColumn("diff", F.round("diff", 6))
