"""Conditions, masks, rankings and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.seeds import seed_for
from ravelin.operators import experiment as ex
from ravelin.operators import stats
from ravelin.operators.ranking import factor_topk
from ravelin.operators.sequence import leave_one_out
from ravelin.plans.registry import SPLIT, query
from ravelin.sources.files import with_row_index
from ravelin.sources.views import events_log, table

_BROAD = "('gift_given', 'household', 'received')"


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leave_one_out(events_log(spark, sf_dir)).select("user_id", "item", "ts", "row_id", "label", "split", "event_type", "value")


def _placebo(name: str, labels: str, code: str) -> str:
    seed = seed_for(42, code)
    return f"""{name}_n AS (SELECT count(*) AS n FROM sp WHERE split = 'train' AND label IN {labels}),
{name}_d AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('{seed}|train|' || row_id), row_id) AS rn FROM sp WHERE split = 'train'), {name}_n WHERE rn <= n),
{name} AS (SELECT * FROM sp WHERE row_id NOT IN (SELECT row_id FROM {name}_d))"""


_C1 = "c1 AS (SELECT * FROM sp WHERE NOT (split = 'train' AND label = 'gift_given'))"
_C1B = f"c1b AS (SELECT * FROM sp WHERE NOT (split = 'train' AND label IN {_BROAD}))"
_C4 = _placebo("c4", "('gift_given')", "C4")
_C4B = _placebo("c4b", _BROAD, "C4b")
_C3 = "c3 AS (SELECT * REPLACE (CASE WHEN split = 'train' AND label = 'gift_given' THEN item || '::gift' ELSE item END AS item) FROM sp)"


def _report_sql(cte: str, name: str) -> str:
    return f"""WITH {SPLIT}, {cte} SELECT (SELECT count(*) FROM sp) AS n_before, (SELECT count(*) FROM {name}) AS n_after,
(SELECT count(*) FROM sp WHERE split = 'train') - (SELECT count(*) FROM {name} WHERE split = 'train') AS n_removed,
round(((SELECT count(*) FROM sp WHERE split = 'train') - (SELECT count(*) FROM {name} WHERE split = 'train')) / (SELECT count(*) FROM sp WHERE split = 'train')::DOUBLE, 6) AS share_removed,
(SELECT count(DISTINCT item) FROM sp WHERE split = 'train' AND item NOT IN (SELECT item FROM {name} WHERE split = 'train' AND item NOT LIKE '%::gift')) AS items_lost,
(SELECT count(DISTINCT item) FROM {name} WHERE item LIKE '%::gift') AS n_shadow,
(SELECT count(DISTINCT user_id) FROM sp WHERE user_id NOT IN (SELECT user_id FROM {name})) AS users_gone"""


def _report(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    return ex.report(sp, ex.condition(sp, code)).withColumn("share_removed", F.round("share_removed", 6))


@query(f"WITH {SPLIT}, {_C1} SELECT user_id, row_id, item, split FROM c1")
def condition_c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition(_split(spark, sf_dir), "C1").select("user_id", "row_id", "item", "split")


@query(f"WITH {SPLIT}, {_C1B} SELECT user_id, row_id, item, split FROM c1b")
def condition_c1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition(_split(spark, sf_dir), "C1b").select("user_id", "row_id", "item", "split")


@query(f"WITH {SPLIT}, {_C4} SELECT user_id, row_id, item, split FROM c4")
def condition_c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition(_split(spark, sf_dir), "C4").select("user_id", "row_id", "item", "split")


@query(f"WITH {SPLIT}, {_C4B} SELECT user_id, row_id, item, split FROM c4b")
def condition_c4b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition(_split(spark, sf_dir), "C4b").select("user_id", "row_id", "item", "split")


@query(f"WITH {SPLIT}, {_C3} SELECT user_id, row_id, item, split FROM c3")
def condition_c3_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.condition(_split(spark, sf_dir), "C3").select("user_id", "row_id", "item", "split")


@query(_report_sql(_C1B, "c1b"))
def condition_report_c1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "C1b")


@query(_report_sql(_C3, "c3"))
def condition_report_c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir, "C3")


@query(f"WITH {SPLIT}, {_C1B} SELECT DISTINCT item FROM sp WHERE split = 'train' AND item NOT IN (SELECT item FROM c1b WHERE split = 'train')")
def items_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    left = ex.condition(sp, "C1b").filter("split = 'train'").select("item").distinct()
    return sp.filter("split = 'train'").select("item").distinct().join(left, "item", "left_anti")


@query(f"""WITH {SPLIT}, {_C4} SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, item FROM c4 EXCEPT SELECT DISTINCT user_id, item FROM sp)) = 0 AS subset_ok,
(SELECT count(DISTINCT user_id) FROM sp) AS n_users, (SELECT count(DISTINCT user_id) FROM c4) AS n_users_after""")
def universe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _universe(_split(spark, sf_dir))


def _universe(sp: DataFrame) -> DataFrame:
    c4 = ex.condition(sp, "C4")
    outside = c4.select("user_id", "item").distinct().subtract(sp.select("user_id", "item")).agg((F.count(F.lit(1)) == 0).alias("subset_ok"))
    return outside.crossJoin(sp.agg(F.count_distinct("user_id").alias("n_users"))).crossJoin(c4.agg(F.count_distinct("user_id").alias("n_users_after")))


@query(f"""WITH {SPLIT}, {_C1} SELECT DISTINCT user_id, item FROM sp WHERE split = 'train' AND (user_id, item) NOT IN (SELECT (user_id, item) FROM c1 WHERE split = 'train')""")
def eval_mask_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    return ex.eval_mask(sp, ex.condition(sp, "C1"))


_POP = """pc AS (SELECT item, count(*) AS n FROM {src} WHERE split = 'train' GROUP BY 1),
seen AS (SELECT DISTINCT user_id, item FROM {src} WHERE split <> 'test'),
cand AS (SELECT u.user_id, pc.item, row_number() OVER (PARTITION BY u.user_id ORDER BY pc.n DESC, pc.item) AS rank
  FROM (SELECT DISTINCT user_id FROM {src} WHERE split = 'test') u CROSS JOIN pc ANTI JOIN seen s ON s.user_id = u.user_id AND s.item = pc.item),
topk AS (SELECT user_id, item, rank::INT AS rank FROM cand WHERE rank <= 10)"""


@query(f"WITH {SPLIT}, {_POP.format(src='sp')} SELECT * FROM topk")
def popularity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.popularity_topk(_split(spark, sf_dir), 10)


_FACTORS = """iv AS (SELECT item, e.embedding::DOUBLE[] AS iv FROM (SELECT item, row_number() OVER (ORDER BY item) - 1 AS place FROM (SELECT DISTINCT item FROM sp WHERE split = 'train' AND item IS NOT NULL)) JOIN embeddings e ON e.vec_id = place),
uv AS (SELECT user_id, e.embedding::DOUBLE[] AS uv FROM (SELECT DISTINCT user_id FROM sp WHERE split = 'test') JOIN embeddings e ON e.vec_id = user_id % (SELECT count(*) FROM embeddings)),
hid AS (SELECT user_id, item FROM sp WHERE split <> 'test' UNION SELECT user_id, item FROM sp WHERE split = 'train' AND (user_id, item) NOT IN (SELECT (user_id, item) FROM c1 WHERE split = 'train')),
fs AS (SELECT user_id, item, round(list_inner_product(uv, iv), 6) AS score FROM uv CROSS JOIN iv ANTI JOIN hid USING (user_id, item)),
ftop AS (SELECT * FROM (SELECT user_id, item, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item))::INT AS rank FROM fs) WHERE rank <= 10)"""


def _by_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings by given factors: what a user has, and what C1 took from training, is
    never ranked."""
    sp = _split(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    items = with_row_index(sp.filter("split = 'train' AND item IS NOT NULL").select("item").distinct(), "vec_id", ["item"]).join(e, "vec_id")
    n = e.agg(F.count(F.lit(1)).alias("n"))
    users = sp.filter("split = 'test'").select("user_id").distinct().crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("user_id") % F.col("n")).join(e, "vec_id")
    hidden = sp.filter("split <> 'test'").select("user_id", "item").union(ex.eval_mask(sp, ex.condition(sp, "C1"))).distinct()
    return factor_topk(users, items, 10, hidden, digits=6).drop("score")


@query(f"WITH {SPLIT}, {_C1}, {_FACTORS} SELECT * FROM ftop")
def factor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_factors(spark, sf_dir)


@query(f"""WITH {SPLIT}, ui AS (SELECT DISTINCT user_id, item FROM sp WHERE split = 'train'), pn AS (SELECT item, count(*) AS n FROM ui GROUP BY 1),
co AS (SELECT x.item AS a, y.item AS b, count(*) AS c FROM ui x JOIN ui y ON x.user_id = y.user_id AND x.item <> y.item GROUP BY 1, 2),
sm AS (SELECT a, b, c / sqrt((p.n * q.n)::DOUBLE) AS sim FROM co JOIN pn p ON a = p.item JOIN pn q ON b = q.item),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM sm) WHERE r <= 20),
sc AS (SELECT user_id, b AS item, round(sum(sim), 9) AS score FROM ui JOIN nb ON ui.item = a GROUP BY 1, 2),
rk AS (SELECT user_id, item, (row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item))::INT AS rank FROM sc ANTI JOIN (SELECT DISTINCT user_id, item FROM sp WHERE split <> 'test') USING (user_id, item))
SELECT * FROM rk WHERE rank <= 10""")
def cooccurrence_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.cooccurrence_topk(_split(spark, sf_dir), 10, neighbours=20).drop("score")


def _metrics_sql(suffix: str, topk: str) -> str:
    out = []
    for k in (5, 10):
        out += [f"round(coalesce(h{k}, 0) / n_pos::DOUBLE, 9) AS recall_{k}", f"(coalesce(h{k}, 0) > 0)::INT AS hit_{k}", f"round(coalesce(g{k}, 0) / list_sum(list_transform(range(1, least(n_pos, {k})::BIGINT + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg_{k}"]
    hits = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= {k}) AS g{k}" for k in (5, 10))
    return f"""pp{suffix} AS (SELECT DISTINCT user_id, item FROM sp WHERE split = 'test'), np{suffix} AS (SELECT user_id, count(*) AS n_pos FROM pp{suffix} GROUP BY 1),
ht{suffix} AS (SELECT user_id, {hits} FROM {topk} SEMI JOIN pp{suffix} USING (user_id, item) GROUP BY 1),
m{suffix} AS (SELECT user_id, {', '.join(out)} FROM np{suffix} LEFT JOIN ht{suffix} USING (user_id))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _per_user(sp: DataFrame, log: DataFrame) -> DataFrame:
    return _rounded(ex.metrics(ex.popularity_topk(log, 10), sp.filter("split = 'test'"), (5, 10)))


@query(f"WITH {SPLIT}, {_POP.format(src='sp')}, {_metrics_sql('', 'topk')} SELECT * FROM m")
def peruser_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    return _per_user(sp, sp)


@query(f"WITH {SPLIT}, {_C1}, {_FACTORS}, {_metrics_sql('', 'ftop')} SELECT * FROM m")
def factor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ex.metrics(_by_factors(spark, sf_dir), _split(spark, sf_dir).filter("split = 'test'"), (5, 10)))


_TWO = f"{SPLIT}, {_C1}, {_C4}, {_POP.format(src='c1')}, {_metrics_sql('', 'topk')}, " + _POP.format(src="c4").replace("pc", "pc4").replace("seen", "seen4").replace("cand", "cand4").replace("topk", "topk4") + ", " + _metrics_sql("4", "topk4")


@query(f"""WITH {_TWO}, d AS (SELECT a.ndcg_10 AS x, b.ndcg_10 AS y FROM m a JOIN m4 b USING (user_id))
SELECT count(*) AS n_users, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b, round(avg(x - y), 6) AS diff, round(avg(x - y) / nullif(avg(y), 0), 6) AS relative_diff FROM d""")
def paired_contrast_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    a, b = (_per_user(sp, ex.condition(sp, c)) for c in ("C1", "C4"))
    d = stats.paired(a, b, "ndcg_10")
    return d.select("n_users", *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "diff", "relative_diff")])


_THRESHOLDS = stats.POISSON


@query(f"""WITH {_TWO}, d AS (SELECT user_id, a.ndcg_10 - b.ndcg_10 AS x FROM m a JOIN m4 b USING (user_id)),
r AS (SELECT d.user_id, d.x, b.range AS rep, ('0x' || substr(md5('42|' || b.range || '|' || d.user_id), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM d, range(200) b),
w AS (SELECT rep, x, {' + '.join(f'(u >= {t!r}::DOUBLE)::INT' for t in _THRESHOLDS)} AS w FROM r),
s AS (SELECT rep, sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY 1)
SELECT round((SELECT avg(x) FROM d), 6) AS diff, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM s""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bootstrap(_split(spark, sf_dir))


def _bootstrap(sp: DataFrame) -> DataFrame:
    a, b = (_per_user(sp, ex.condition(sp, c)) for c in ("C1", "C4"))
    d = a.select("user_id", F.col("ndcg_10").alias("x")).join(b.select("user_id", F.col("ndcg_10").alias("y")), "user_id").select("user_id", (F.col("x") - F.col("y")).alias("x"))
    ci = stats.bootstrap_mean(d, "user_id", "x", replicates=200, seed=42)
    return ci.select(F.round("mean", 6).alias("diff"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(f"""WITH {SPLIT}, {_C1}, {_C4}, n0 AS (SELECT user_id, count(*) AS n0 FROM sp WHERE split = 'train' GROUP BY 1), na AS (SELECT user_id, count(*) AS na FROM c1 WHERE split = 'train' GROUP BY 1), nb AS (SELECT user_id, count(*) AS nb FROM c4 WHERE split = 'train' GROUP BY 1)
SELECT CASE WHEN n0 > coalesce(na, 0) AND n0 > coalesce(nb, 0) THEN 'both' WHEN n0 > coalesce(na, 0) THEN 'a_only' WHEN n0 > coalesce(nb, 0) THEN 'b_only' ELSE 'neither' END AS exposure, count(*) AS n_users
FROM n0 LEFT JOIN na USING (user_id) LEFT JOIN nb USING (user_id) GROUP BY 1""")
def exposure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    return ex.exposure(sp, ex.condition(sp, "C1"), ex.condition(sp, "C4")).groupBy("exposure").agg(F.count(F.lit(1)).alias("n_users"))


@query(f"""WITH {SPLIT} SELECT sha256(string_agg(user_id || chr(9) || item || chr(10), '' ORDER BY user_id::VARCHAR, item)) AS sha256 FROM (SELECT DISTINCT user_id, item FROM sp WHERE split = 'test')""")
def test_pairs_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.pairs_sha256(_split(spark, sf_dir).filter("split = 'test'").select("user_id", "item").distinct())


@query(f"""WITH {SPLIT}, p AS (SELECT DISTINCT user_id::VARCHAR AS u, item FROM sp), o AS (SELECT *, row_number() OVER (ORDER BY u, item) - 1 AS n0 FROM p),
b AS (SELECT n0 // 100 AS n1, sha256(string_agg(u || chr(9) || item || chr(10), '' ORDER BY n0)) AS d FROM o GROUP BY 1),
c AS (SELECT n1 // 100 AS n2, sha256(string_agg(d || chr(10), '' ORDER BY n1)) AS d FROM b GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n, CASE WHEN count(*) = 1 THEN any_value(d) ELSE sha256(string_agg(d || chr(10), '' ORDER BY n2)) END AS sha256 FROM c""")
def pairs_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.pairs_digest(_split(spark, sf_dir).select("user_id", "item").distinct(), lines=100, steps=2)


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(qe, embedding)::DOUBLE, 4) AS score FROM q, embeddings WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, rank::INT AS rank FROM r WHERE rank <= 10""")
def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return stats.cosine_topk(e.filter("vec_id % 50 = 0"), e, 10, digits=4)


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT qid, vec_id, round(list_cosine_similarity(qe, embedding)::DOUBLE, 4) AS score FROM q, embeddings WHERE vec_id <> qid),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT qid, vec_id, rank::INT AS rank FROM r WHERE rank <= 5""")
def embedding_topk_fiftieth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return stats.cosine_topk(e.filter("vec_id % 50 = 0"), e, 5, digits=4)
