"""Funnels, degrees, k-core, dedup, joins, sets, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import relational as rel
from ravelin.operators.quantiles import quantiles, spread
from ravelin.plans.registry import EV, OD, query
from ravelin.sources.views import events_log, orders_log, table

_FUNNEL = f"""WITH {EV}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, row_id) = 1 AS is_first FROM ev),
l AS (SELECT *, CASE WHEN NOT coalesce(event_type <> 'error', false) THEN 1 WHEN NOT coalesce(value >= 1.0, false) THEN 2 WHEN NOT is_first THEN 3 ELSE 4 END AS lev FROM f)
SELECT s.stage, count(*) FILTER (lev >= s.k) AS n_rows, count(DISTINCT CASE WHEN lev >= s.k THEN user_id END) AS n_users, count(DISTINCT CASE WHEN lev >= s.k THEN item END) AS n_items
FROM l, (VALUES ('01_raw', 1), ('02_no_error', 2), ('03_min_value', 3), ('04_dedup', 4)) s(stage, k) GROUP BY s.stage"""


@query(_FUNNEL)
def interactions_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("user_id", "item").orderBy("ts", "row_id")) == 1
    log = events_log(spark, sf_dir).withColumn("is_first", first)
    stages = [("01_raw", F.lit(True)), ("02_no_error", F.col("event_type") != "error"), ("03_min_value", F.col("value") >= 1.0), ("04_dedup", F.col("is_first"))]
    return rel.funnel(log, stages)


@query(f"""WITH {OD}, n AS (SELECT user_id, count(*) AS n FROM od GROUP BY 1)
SELECT count(*) AS n_keys, round(avg(n), 6) AS mean_rows, median(n)::DOUBLE AS median_rows, max(n) AS max_rows, round(avg((n >= 40)::INT::DOUBLE), 6) AS share_k FROM n""")
def density_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rel.density(orders_log(spark, sf_dir), "user_id", 40)
    return d.select("n_keys", F.round("mean_rows", 6).alias("mean_rows"), "median_rows", "max_rows", F.round("share_k", 6).alias("share_k"))


def _core_sql(k: int, passes: int, tail: str) -> str:
    ctes = [OD, "p0 AS MATERIALIZED (SELECT DISTINCT user_id, item FROM od)"]
    for i in range(1, passes + 1):
        p = f"p{i - 1}"
        ctes.append(f"p{i} AS MATERIALIZED (SELECT * FROM {p} WHERE user_id IN (SELECT user_id FROM {p} GROUP BY 1 HAVING count(*) >= {k}) AND item IN (SELECT item FROM {p} GROUP BY 1 HAVING count(*) >= {k}))")
    return "WITH " + ",\n".join(ctes) + "\n" + tail


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).select("user_id", "item").distinct()


@query(_core_sql(20, 14, "SELECT * FROM p14"))
def k_core_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.k_core(_pairs(spark, sf_dir), 20)[0].select("user_id", "item")


@query(_core_sql(45, 24, "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM p24"))
def k_core_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.k_core(_pairs(spark, sf_dir), 45)[0].agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"))


_PASSES = 14


@query(_core_sql(20, _PASSES, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS pass, (SELECT count(*) FROM p{i}) AS n_rows, (SELECT count(*) FROM p{i - 1}) AS prev, {'true' if i < 2 else f'(SELECT count(*) FROM p{i - 2}) <> (SELECT count(*) FROM p{i - 1}) AND (SELECT count(*) FROM p{i - 1}) > 0'} AS runs" for i in range(1, _PASSES + 1)) + ") WHERE runs").replace("SELECT * FROM (SELECT 1", "SELECT pass, n_rows FROM (SELECT 1"))
def k_core_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(rel.k_core(_pairs(spark, sf_dir), 20)[1], "pass int, n_rows long")


@query(f"WITH {EV} SELECT * FROM (SELECT user_id, item, row_id, label, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, row_id) AS rn FROM ev) WHERE rn = 1".replace("SELECT * FROM (SELECT user_id", "SELECT user_id, item, row_id, label FROM (SELECT user_id"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.dedup(events_log(spark, sf_dir), ["user_id", "item"], ["ts", "row_id"]).select("user_id", "item", "row_id", "label")


@query(f"WITH {EV} SELECT user_id, item, row_id, label FROM (SELECT user_id, item, row_id, label, row_number() OVER (PARTITION BY user_id, item ORDER BY ts DESC, row_id DESC) AS rn FROM ev) WHERE rn = 1")
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.dedup(events_log(spark, sf_dir), ["user_id", "item"], ["ts", "row_id"], last=True).select("user_id", "item", "row_id", "label")


@query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM c)
SELECT p_type, p_brand, n, rank::INT AS rank, round(n / (sum(n) OVER (PARTITION BY p_type))::DOUBLE, 6) AS share FROM r WHERE rank <= 5""")
def top_n_within_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    return rel.top_n_within(j, "p_type", "p_brand", 5).withColumn("share", F.round("share", 6))


@query(f"""WITH {EV}, u AS (SELECT row_id, 'main' AS frame, value, NULL::VARCHAR AS note FROM ev WHERE label = 'self'
UNION ALL SELECT row_id, 'boost', value, event_type FROM ev WHERE label = 'gift_given')
SELECT frame, count(*) AS n, count(note) AS n_note, round(sum(value), 4) AS total FROM u GROUP BY 1""")
def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    main = log.filter("label = 'self'").select("row_id", F.lit("main").alias("frame"), "value")
    boost = log.filter("label = 'gift_given'").select("row_id", F.lit("boost").alias("frame"), "value", F.col("event_type").alias("note"))
    both = main.unionByName(boost, allowMissingColumns=True)
    return both.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("n_note"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)) AS with_large,
count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)) AS without_large FROM customer GROUP BY 1""")
def anti_semi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    has = customer.join(large, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    none = customer.join(large, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    return has.join(none, "c_mktsegment", "full").select("c_mktsegment", F.coalesce("n", zero).alias("with_large"), F.coalesce("m", zero).alias("without_large"))


@query("""WITH k AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), j AS (SELECT d.doc_id, k.n FROM documents d LEFT JOIN k USING (doc_id))
SELECT count(*) AS left_rows, count(n) AS matched, count(*) - count(n) AS missed, coalesce(sum(n), 0)::BIGINT AS joined_rows, (SELECT count(*) FROM k WHERE n > 1) AS repeated_keys FROM j""")
def join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.join_audit(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT DISTINCT value FROM r WHERE i = round_even((n - 1) * 0.9, 0)::BIGINT")
def nearest_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.nearest_quantile(table(spark, sf_dir, "events"), "value", 0.9)


@query("SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def linear_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [(p, f"q{round(p * 100)}") for p in (0.25, 0.5, 0.9)]
    found = spread(quantiles(table(spark, sf_dir, "events"), "value", [p for p, _ in names], by=["event_type"]), names, ["event_type"])
    return found.select("event_type", *[F.round(name, 6).alias(name) for _, name in names])


@query(f"""WITH {EV}, c AS (SELECT user_id, label, count(*) AS n FROM ev GROUP BY 1, 2),
u AS (SELECT user_id, count(*) AS k, max(CASE WHEN n > 12 THEN 1 ELSE 0 END) AS heavy FROM c GROUP BY 1)
SELECT count(*) AS n_users, count(*) FILTER (k >= 2) AS cross_users, count(*) FILTER (k >= 2 AND heavy = 1) AS cross_heavy, count(*) FILTER (k = 5) AS all_five FROM u""")
def cross_category_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = events_log(spark, sf_dir).groupBy("user_id", "label").agg(F.count(F.lit(1)).alias("n"))
    u = c.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("n") > 12).alias("heavy"))
    return u.agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.expr("k >= 2")).alias("cross_users"), F.count_if(F.expr("k >= 2 AND heavy")).alias("cross_heavy"), F.count_if(F.expr("k = 5")).alias("all_five"))


@query("SELECT regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, page_id FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(F.regexp_extract(url, "^(https?)://", 1).alias("scheme"), F.regexp_extract(url, "^https?://([^/:?#]+)", 1).alias("host"), "page_id")


_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT {_LINE}, row_number() OVER (ORDER BY {_LINE}) - 1 AS row_id FROM lineitem")
def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.sources.files import with_row_index

    keys = _LINE.split(", ")
    return with_row_index(table(spark, sf_dir, "lineitem").select(*keys), order=keys)
