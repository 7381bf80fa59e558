"""Contrasts over seeds, gates, samples with texts, builds and checks of their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.functions import time as tm
from ravelin.functions.seeds import seed_for
from ravelin.operators import experiment as ex
from ravelin.operators import gates, labels, stats
from ravelin.operators import marketing as mk
from ravelin.operators import relational as rel
from ravelin.operators import sampling as sm
from ravelin.operators import sequence as seq
from ravelin.operators import validation as va
from ravelin.plans.experiments import _BROAD, _C1, _C1B, _C3, _POP, _metrics_sql, _per_user, _split
from ravelin.plans.measures import _HIST, _ONLY, _RATED, _history, _hit, _rated
from ravelin.plans.registry import DOC, EV, OD, ORACLES, SPLIT, query
from ravelin.sources.store import cut
from ravelin.sources.views import documents_log, events_log, orders_log, table

_SEEDS = (1, 2)


def _placebo(name: str, labels_: str, code: str, base: int) -> str:
    return f"""{name} AS (SELECT * FROM sp WHERE row_id NOT IN (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('{seed_for(base, code)}|train|' || row_id), row_id) AS rn FROM sp WHERE split = 'train')
WHERE rn <= (SELECT count(*) FROM sp WHERE split = 'train' AND label IN {labels_})))"""


def _run_sql(name: str, src: str) -> str:
    """CTEs of one run: per-user metrics as m<name>."""
    pop = _POP.format(src=src)
    for cte in ("pc", "seen", "cand", "topk"):
        pop = pop.replace(cte, f"{cte}_{name}")
    return f"{pop}, {_metrics_sql('_' + name, 'topk_' + name)}"


_RUNS_SQL = ",\n".join(
    [SPLIT, _C1, _C1B, _C3, *[_placebo(f"c4s{s}", "('gift_given')", "C4", s) for s in _SEEDS], *[_placebo(f"c4bs{s}", _BROAD, "C4b", s) for s in _SEEDS]]
    + [_run_sql(n, src) for n, src in [("c0", "sp"), ("c1", "c1"), ("c1b", "c1b"), ("c3", "c3"), *[(f"c4{s}", f"c4s{s}") for s in _SEEDS], *[(f"c4b{s}", f"c4bs{s}") for s in _SEEDS]]]
    + [f"mean_{n} AS (SELECT user_id, avg(ndcg_10) AS x FROM ({' UNION ALL '.join(f'SELECT user_id, ndcg_10 FROM m_{n}{s}' for s in _SEEDS)}) GROUP BY 1)" for n in ("c4", "c4b")]
    + [f"mean_{n} AS (SELECT user_id, ndcg_10 AS x FROM m_{n})" for n in ("c0", "c1", "c1b", "c3")]
)


def _stored_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What conditions and runs read of the split log, ordered and written once."""
    return cut(_split(spark, sf_dir).select("user_id", "item", "row_id", "label", "split"))


def _runs(spark: SparkSession, sf_dir: str) -> dict[tuple[str, int], DataFrame]:
    sp = _stored_split(spark, sf_dir)
    one = {c: rel._settled(_per_user(sp, ex.condition(sp, c))) for c in ("C0", "C1", "C1b", "C3")}
    runs = {(c, s): df for c, df in one.items() for s in _SEEDS}
    return runs | {(c, s): rel._settled(_per_user(sp, ex.condition(sp, c, s))) for c in ("C4", "C4b") for s in _SEEDS}


@query("WITH " + _RUNS_SQL + "\n" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, 2 AS n_seeds, count(*) AS n_users, round(avg(p.x), 6) AS mean_a, round(avg(q.x), 6) AS mean_b, round(avg(p.x - q.x), 6) AS diff FROM mean_{a.lower()} p JOIN mean_{b.lower()} q USING (user_id)" for a, b in ex.CONTRASTS))
def seed_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ex.contrasts(_runs(spark, sf_dir), "ndcg_10")
    return c.select("a", "b", "n_seeds", "n_users", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "diff")])


@query("WITH " + _RUNS_SQL + " SELECT user_id, round(x, 9) AS ndcg_10 FROM mean_c4")
def replicate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    m = ex.replicate_mean([_per_user(sp, ex.condition(sp, "C4", s)) for s in _SEEDS], "ndcg_10")
    return m.select("user_id", F.round("ndcg_10", 9).alias("ndcg_10"))


@query("WITH " + _RUNS_SQL + ", d AS (SELECT avg(p.ndcg_10 - q.ndcg_10) AS diff FROM m_c1 p JOIN m_c41 q USING (user_id) UNION ALL SELECT avg(p.ndcg_10 - q.ndcg_10) FROM m_c1 p JOIN m_c42 q USING (user_id)) SELECT round(avg(diff), 9) AS mean, round(stddev_samp(diff), 9) AS sd, round(stddev_samp(diff) / sqrt(count(*)), 9) AS se, (CASE WHEN avg(diff) > 0 THEN count(*) FILTER (diff > 0) ELSE count(*) FILTER (diff < 0) END) || '/' || count(*) AS sign_agreement FROM d")
def seed_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    c1 = _per_user(sp, ex.condition(sp, "C1"))
    diffs = None
    for s in _SEEDS:
        d = stats.paired(c1, _per_user(sp, ex.condition(sp, "C4", s)), "ndcg_10").select("diff")
        diffs = d if diffs is None else diffs.unionAll(d)
    return stats.seed_summary(diffs).select(*[F.round(c, 9).alias(c) for c in ("mean", "sd", "se")], "sign_agreement")


@query("WITH " + _RUNS_SQL + """, n0 AS (SELECT user_id, count(*) AS n0 FROM sp WHERE split = 'train' GROUP BY 1), na AS (SELECT user_id, count(*) AS na FROM c1 WHERE split = 'train' GROUP BY 1), nb AS (SELECT user_id, count(*) AS nb FROM c1b WHERE split = 'train' GROUP BY 1),
g AS (SELECT user_id, CASE WHEN n0 > coalesce(na, 0) AND n0 > coalesce(nb, 0) THEN 'both' WHEN n0 > coalesce(na, 0) THEN 'a_only' WHEN n0 > coalesce(nb, 0) THEN 'b_only' ELSE 'neither' END AS exposure FROM n0 LEFT JOIN na USING (user_id) LEFT JOIN nb USING (user_id))
SELECT exposure, count(*) AS n_users, round(avg(p.ndcg_10), 6) AS mean_a, round(avg(q.ndcg_10), 6) AS mean_b, round(avg(p.ndcg_10 - q.ndcg_10), 6) AS diff FROM m_c1 p JOIN m_c1b q USING (user_id) JOIN g USING (user_id) GROUP BY 1""")
def exposure_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = _split(spark, sf_dir)
    a, b = (ex.condition(sp, c) for c in ("C1", "C1b"))
    c = ex.exposure_contrasts(ex.exposure(sp, a, b), _per_user(sp, a), _per_user(sp, b), "ndcg_10")
    return c.select("exposure", "n_users", *[F.round(x, 6).alias(x) for x in ("mean_a", "mean_b", "diff")])


@query(
    "WITH " + _RUNS_SQL + """, hits AS (SELECT count(*) AS h FROM (SELECT DISTINCT user_id, item FROM sp WHERE split = 'test') SEMI JOIN topk_c0 USING (user_id, item)),
told AS (SELECT round(h / (SELECT count(DISTINCT user_id) FROM sp WHERE split = 'test')::DOUBLE, 6) AS recall_10, round((SELECT max(ndcg_10) FROM m_c0), 6) AS ndcg_10 FROM hits)
SELECT count(*) AS n_users, count(*) - count(DISTINCT user_id) AS repeated, abs(avg(m.recall_10) - any_value(told.recall_10)) <= 5e-7 AS recall_10_ok, abs(avg(m.ndcg_10) - any_value(told.ndcg_10)) <= 5e-7 AS ndcg_10_ok FROM m_c0 m, told"""
)
def metric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report against the users' metrics. Its recall is counted from the lists (a user
    has one test row); its ndcg is the best user's in the place of the mean, which shows."""
    sp = _split(spark, sf_dir)
    test = sp.filter("split = 'test'")
    per = rel._settled(_per_user(sp, sp))
    hits = ex.popularity_topk(sp, 10).join(test.select("user_id", "item").distinct(), ["user_id", "item"], "left_semi").count()
    told = {"recall_10": round(hits / test.select("user_id").distinct().count(), 6), "ndcg_10": round(per.agg(F.max("ndcg_10")).first()[0], 6)}
    return ex.consistency(per, told)


def _differ_sql(kind: str, a: str, b: str) -> str:
    one, two = (f"SELECT user_id, ndcg_10, hit_10 FROM {m}" for m in (a, b))
    return f"SELECT '{kind}' AS kind, (SELECT count(*) FROM ({one} EXCEPT ALL {two})) AS only_first, (SELECT count(*) FROM ({two} EXCEPT ALL {one})) AS only_second"


@query("WITH " + _RUNS_SQL + " " + _differ_sql("again", "m_c41", "m_c41") + " UNION ALL " + _differ_sql("other_seed", "m_c41", "m_c42") + " UNION ALL " + _differ_sql("stale", "m_c41", "m_c1"))
def reproduction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placebo's run against a second run of it over a log dealt otherwise, against
    another seed's, and against a copy left by another condition."""
    sp = _stored_split(spark, sf_dir)

    def run(log: DataFrame, code: str, seed: int) -> DataFrame:
        return _per_user(log, ex.condition(log, code, seed)).select("user_id", "ndcg_10", "hit_10")

    first = rel._settled(run(sp, "C4", 1))
    others = {"again": run(sp.repartition("row_id"), "C4", 1), "other_seed": run(sp, "C4", 2), "stale": run(sp, "C1", 1)}
    return spark.createDataFrame([(kind, *gates.reproduced(first, other).values()) for kind, other in others.items()], "kind string, only_first long, only_second long")


_SO = f"{_HIST}, {_ONLY}, po AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_id) - 1 AS seq_pos, count(*) OVER (PARTITION BY user_id) AS seq_len FROM od), so AS (SELECT *, CASE WHEN seq_len - seq_pos = 1 THEN 'test' WHEN seq_len - seq_pos = 2 THEN 'valid' ELSE 'train' END AS split FROM po), so1 AS (SELECT * FROM so WHERE NOT (split = 'train' AND label = 'gift_given'))"


def _list_sql(name: str, src: str) -> str:
    pop = _POP.format(src=src)
    for cte in ("pc", "seen", "cand", "topk"):
        pop = pop.replace(cte, f"{cte}_{name}")
    return f"{pop}, sh_{name} AS (SELECT t.user_id, count(*) FILTER (p_type = g.subcat) / 10.0::DOUBLE AS share FROM topk_{name} t JOIN part ON t.item = p_partkey JOIN bu g ON g.user_id = t.user_id GROUP BY 1)"


@query(f"""WITH {_SO}, pp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_id) AS pos FROM h),
la AS (SELECT user_id, max(pos) AS at_, arg_max(subcat, pos) AS subcat FROM pp WHERE label = 'gift_given' GROUP BY 1), gl AS (SELECT la.* FROM la SEMI JOIN go ON go.user_id = la.user_id AND go.subcat = la.subcat),
af AS (SELECT pp.user_id, count(*) AS n FROM pp JOIN gl USING (user_id) WHERE pp.label = 'self' AND pp.pos > gl.at_ GROUP BY 1), bu AS (SELECT gl.user_id, gl.subcat, least(coalesce(af.n, 0), 10)::INT AS bucket FROM gl LEFT JOIN af USING (user_id)),
{_list_sql('x', 'so')}, {_list_sql('y', 'so1')}
SELECT bucket, count(*) AS n_users, round(avg(x.share), 6) AS share_a, round(avg(y.share), 6) AS share_b, round(avg(x.share - y.share), 6) AS excess FROM bu JOIN sh_x x USING (user_id) JOIN sh_y y USING (user_id) GROUP BY 1""")
def m2_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _excess(spark, sf_dir).select("bucket", "n_users", *[F.round(c, 6).alias(c) for c in ("share_a", "share_b", "excess")])


def _excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    sp = cut(seq.leave_one_out(orders_log(spark, sf_dir)).select("user_id", "item", "label", "split", "seq_pos"))  # joined and ordered once
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("subcat"))
    h = cut(sp.join(items, "item").select("user_id", "subcat", "label", F.col("seq_pos").alias("ts"), F.lit(0).alias("row_id")))  # places order a user's rows as times do
    buckets = cut(mk.gift_buckets(h, _hit(), F.col("label") == "self", mk.gift_only(h, _hit())))
    return mk.excess_points(buckets, *[ex.popularity_topk(ex.condition(sp, c), 10) for c in ("C0", "C1")], items, 10)


#: Users that a bucket must have to count in the fit.
_LEAST = 30


@query()
def m2_half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit to m2_excess, which has SQL: none for the fit itself, which is tested
    against worlds with a known half life."""
    points = _excess(spark, sf_dir).filter(f"bucket < 10 AND n_users >= {_LEAST}").collect()  # at most ten rows
    gap = seq.median_gap(orders_log(spark, sf_dir)).first()["median_gap_days"]
    found = stats.half_life([(r["bucket"], r["excess"], r["n_users"]) for r in points]) or (None, None)
    weeks = None if found[1] is None or gap is None else found[1] * gap / 7
    return spark.createDataFrame([(*found, weeks)], "amplitude double, half_life double, weeks double")


@query(f"WITH {_RATED}, c AS (SELECT ref, pred, count(*) AS n FROM rt WHERE ref <> pred GROUP BY 1, 2) SELECT ref, pred, n, row_number() OVER (ORDER BY n DESC, ref, pred)::INT AS place FROM c")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stats.confusion(_rated(spark, sf_dir), "ref", "pred").filter("ref <> pred")
    return c.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "ref", "pred")))  # a row for each pair of labels


_FR = f"""{DOC}, st AS (SELECT *, category AS stratum FROM doc), c AS (SELECT stratum, count(*) AS n FROM st GROUP BY 1), a0 AS (SELECT *, (sum(n) OVER ())::BIGINT AS s, least(60, (sum(n) OVER ())::BIGINT) AS want FROM c), a1 AS (SELECT *, n * want // s AS fl, n * want % s AS rest FROM a0),
al AS (SELECT stratum, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= want - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS alloc FROM a1),
mn AS (SELECT d.row_id FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('9|' || stratum || '|' || row_id), row_id) AS rn FROM st) d JOIN al USING (stratum) WHERE rn <= alloc),
bo AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('10|boost|' || row_id), row_id) AS rn FROM doc WHERE lang = 'de' AND row_id NOT IN (SELECT row_id FROM mn)) WHERE rn <= 20),
fr AS (SELECT 'main' AS frame, row_id FROM mn UNION ALL SELECT 'boost', row_id FROM bo)"""


def _annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir)
    drawn = sm.frames(d.drop("text"), F.col("category"), 60, [("boost", F.col("lang") == "de", 20)], 9)
    titles = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("url").alias("title"))
    return sm.with_texts(drawn.select("frame", "row_id"), d, titles)


@query(f"WITH {_FR} SELECT fr.frame, fr.row_id, length(d.text) AS n_chars, coalesce(trim(p.url), '') AS title, coalesce(trim(p.url), '') = '' AS no_title FROM fr JOIN doc d USING (row_id) LEFT JOIN pages p ON p.page_id = fr.row_id")
def annotation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotation(spark, sf_dir).select("frame", "row_id", F.char_length("text").cast("long").alias("n_chars"), "title", "no_title")


@query(f"WITH {_FR} SELECT fr.row_id, length(d.text) AS n_chars, d.category, p.url FROM fr JOIN doc d USING (row_id) LEFT JOIN pages p ON p.page_id = fr.row_id")
def trial_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), "url")
    r = sm.rebuilt(_annotation(spark, sf_dir).select("row_id", "text"), documents_log(spark, sf_dir).select("row_id", "text", "category"), extra)
    return r.select("row_id", F.char_length("text").cast("long").alias("n_chars"), "category", "url")


_ROLES = {"en": 0.4, "de": 0.3, "fr": 0.3}
_POOLS = {"self": 0.3, "gift_given": 0.2, "household": 0.2, "received": 0.1, "unclear": 0.2}
_WANT = [(r, s, n) for r, m in sm.share_allocation(_ROLES, 50).items() for s, n in sm.share_allocation(_POOLS, m).items()]
_POOL_SQL = f"""{_RATED}, pl AS (SELECT rt.doc_id AS row_id, d.lang AS role, rt.pred AS stratum FROM rt JOIN documents d USING (doc_id)), nn AS (SELECT role, stratum, count(*) AS have FROM pl GROUP BY 1, 2),
ww(role, stratum, want) AS (VALUES {', '.join(f"('{r}', '{s}', {n})" for r, s, n in _WANT)})"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.col("doc_id").alias("row_id"), "lang", "pred")


@query(f"""WITH {_POOL_SQL} SELECT role, stratum, want::INT AS want, coalesce(have, 0) AS have FROM ww LEFT JOIN nn USING (role, stratum)""")
def validation_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame(_WANT, "role string, stratum string, want int")
    have = _pool(spark, sf_dir).groupBy(F.col("lang").alias("role"), F.col("pred").alias("stratum")).agg(F.count(F.lit(1)).alias("have"))
    return want.join(have, ["role", "stratum"], "left").select("role", "stratum", "want", F.coalesce("have", F.lit(0)).alias("have"))


@query()
def validation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by the engine's own allocation under caps, which the pools of
    validation_pools set: tested by its rule, without SQL."""
    p = _pool(spark, sf_dir)
    drawn, _ = sm.two_level(p, F.col("lang"), F.col("pred"), _ROLES, _POOLS, 50, 13)
    return drawn.select("row_id", "role", "stratum", "sample_id")


@query(f"""WITH {DOC}, s AS (SELECT row_id, lang AS role, CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'flagged' WHEN regexp_matches(lower(text), '\\bof\\b') THEN 'maybe' ELSE 'plain' END AS stratum FROM doc), w(stratum, n) AS (VALUES ('flagged', 12), ('maybe', 4), ('plain', 4)),
r AS (SELECT s.*, w.n, row_number() OVER (PARTITION BY role, s.stratum ORDER BY md5('17|' || role || '|' || s.stratum || '|' || row_id), row_id) AS rn FROM s JOIN w USING (stratum)) SELECT row_id, role, stratum FROM r WHERE rn <= n""")
def precision_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower(F.col("text"))
    stratum = F.when(t.rlike(r"\bthe\b"), "flagged").when(t.rlike(r"\bof\b"), "maybe").otherwise("plain")
    d = documents_log(spark, sf_dir).select("row_id", F.col("lang").alias("role"), stratum.alias("part"))
    counts = sm.share_allocation({"flagged": 0.6, "maybe": 0.2, "plain": 0.2}, 20)
    want = {f"{r['role']}|{s}": n for r in d.select("role").distinct().collect() for s, n in counts.items()}  # roles are few
    drawn = sm.draw(d, F.concat_ws("|", "role", "part"), want, 17)
    return drawn.select("row_id", "role", F.col("part").alias("stratum"))


@query(f"WITH {_RATED} SELECT ref AS label_A, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE third END AS label_B, count(*) AS n FROM rt GROUP BY 1, 2")
def label_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir).withColumnRenamed("doc_id", "sample_id")
    second = r.select("sample_id", F.when(F.col("sample_id") % 9 == 0, " ").otherwise(F.col("third")).alias("label"))
    out = labels.ingest({"A": r.select("sample_id", F.col("ref").alias("label")), "B": second}, r.select("sample_id"))
    return out.groupBy("label_A", "label_B").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RATED}, j AS (SELECT rt.*, doc_id % 11 <> 0 AS parse_ok, doc_id % 13 = 0 AS span_downgraded FROM rt) SELECT pred AS label, count(*) AS n, round((SELECT avg((NOT parse_ok)::INT::DOUBLE) FROM j), 6) AS parse_fail_rate, round((SELECT avg(span_downgraded::INT::DOUBLE) FROM j), 6) AS downgrade_rate FROM j GROUP BY 1")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir).select(F.col("pred").alias("label"), (F.col("doc_id") % 11 != 0).alias("parse_ok"), (F.col("doc_id") % 13 == 0).alias("span_downgraded"))
    return labels.run_statistics(r).select("label", "n", *[F.round(c, 6).alias(c) for c in ("parse_fail_rate", "downgrade_rate")])


@query(f"WITH {_RATED} SELECT doc_id, third AS reference FROM rt")
def primary_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.primary_reference(_rated(spark, sf_dir), ["ref", "pred", "third"], "third").select("doc_id", "reference")


@query(f"WITH {_RATED}, d AS (SELECT doc_id, CASE WHEN text LIKE '%and%' THEN 'and' ELSE 'zzz no such words' END AS span, coalesce(text, '') AS text FROM documents), j AS (SELECT pred AS label, span, text FROM rt JOIN d USING (doc_id)), x AS (SELECT CASE WHEN label <> 'unclear' AND strpos(text, span) = 0 THEN 'unclear' ELSE label END AS label, label <> 'unclear' AND strpos(text, span) = 0 AS span_downgraded FROM j) SELECT label, span_downgraded, count(*) AS n FROM x GROUP BY 1, 2")
def span_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    span = F.when(F.col("text").contains("and"), "and").otherwise("zzz no such words")
    j = _rated(spark, sf_dir).join(d, "doc_id").select(F.col("pred").alias("label"), F.lit("high").alias("confidence"), span.alias("span"), "text")
    return labels.downgrade(j).groupBy("label", "span_downgraded").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV}, n AS (SELECT user_id, item, label, row_id, ts FROM ev), po AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_id) - 1 AS seq_pos, count(*) OVER (PARTITION BY user_id) AS seq_len FROM n), s AS (SELECT *, CASE WHEN seq_len - seq_pos = 1 THEN 'test' WHEN seq_len - seq_pos = 2 THEN 'valid' ELSE 'train' END AS split FROM po) SELECT split, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (split = 'test' AND label = 'self') AS n_eligible FROM s GROUP BY 1")
def atomic_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    a = ex.atomic(log.drop("label"), log)
    return a.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.expr("split = 'test' AND label = 'self'")).alias("n_eligible"))


@query(f"""WITH s AS (SELECT lo FROM ({ORACLES['seasonality_ci']})), b AS (SELECT rate FROM ({ORACLES['beyond_keyword']}) WHERE NOT flagged), p AS (SELECT any_value(parse_fail_rate) AS f FROM ({ORACLES['run_statistics']})), g AS (SELECT agreement FROM ({ORACLES['overlap_agreement']}))
SELECT CASE WHEN lo < 1.2 OR rate < 0.02 OR f > 0.02 OR agreement < 0.6 THEN 'FAIL' ELSE 'PASS' END AS verdict, lo >= 1.2 AS seasonality, rate >= 0.02 AS beyond_keyword, f <= 0.02 AS schema_health, agreement >= 0.6 AS agreement FROM s, b, p, g""")
def gate_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.plans import checks, measures

    lo = checks.seasonality_ci(spark, sf_dir).first()["lo"]
    rate = measures.beyond_keyword(spark, sf_dir).filter("NOT flagged").first()["rate"]
    fail = run_statistics(spark, sf_dir).first()["parse_fail_rate"]
    agree = checks.overlap_agreement(spark, sf_dir).first()["agreement"]
    row = (gates.prevalence_gate(lo, rate, fail, agree), lo >= 1.2, rate >= 0.02, fail <= 0.02, agree >= 0.6)
    return spark.createDataFrame([row], "verdict string, seasonality boolean, beyond_keyword boolean, schema_health boolean, agreement boolean")


@query(f"""WITH u AS (SELECT subset_ok FROM ({ORACLES['universe_check']})), p AS (SELECT lo FROM ({ORACLES['bootstrap_ci']})), r AS (SELECT * FROM (WITH {_RUNS_SQL} SELECT stddev_samp(m) / avg(m) AS cv FROM (SELECT avg(ndcg_10) AS m FROM m_c41 UNION ALL SELECT avg(ndcg_10) FROM m_c42)))
SELECT CASE WHEN NOT subset_ok OR lo > 0 OR cv >= 0.1 THEN 'FAIL' ELSE 'PASS' END AS verdict, 1 AS n_hashes, subset_ok AS universe_ok, lo <= 0 AS placebo_ok, cv < 0.1 AS seeds_ok FROM u, p, r""")
def gate_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.plans import experiments

    sp = _stored_split(spark, sf_dir)
    tests = {ex.pairs_hash(ex.condition(sp, c).filter("split = 'test'").select("user_id", "item")).first()["hash"] for c in ("C0", "C1", "C1b", "C3", "C4")}
    ok = experiments._universe(sp).first()["subset_ok"]
    lo = experiments._bootstrap(sp).first()["lo"]
    means = [_per_user(sp, ex.condition(sp, "C4", s)).agg(F.avg("ndcg_10")).first()[0] for s in _SEEDS]
    middle = sum(means) / len(means)
    cv = (sum((m - middle) ** 2 for m in means) / (len(means) - 1)) ** 0.5 / middle
    return spark.createDataFrame([(gates.experiment_gate(tests, ok, lo, cv), len(tests), ok, lo <= 0, cv < 0.1)], "verdict string, n_hashes int, universe_ok boolean, placebo_ok boolean, seeds_ok boolean")


@query(f"SELECT CASE WHEN kappa >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS three_raters, 'INCOMPLETE' AS one_rater FROM ({ORACLES['fleiss_kappa']})")
def gate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    kappa = stats.fleiss(_rated(spark, sf_dir), ["ref", "pred", "third"]).first()["kappa"]
    return spark.createDataFrame([(gates.agreement_gate(kappa, 3), gates.agreement_gate(kappa, 1))], "three_raters string, one_rater string")


@query("WITH x AS (SELECT epoch_ms(ts)::BIGINT AS e FROM events) SELECT year(make_timestamp(e * 1000))::INT AS year, month(make_timestamp(e * 1000))::INT AS month, count(*) AS n, (SELECT median(e) > 1e11 FROM x) AS millis FROM x GROUP BY 1, 2")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_log(spark, sf_dir).select(F.floor(tm.micros(F.col("ts")) / 1000).cast("long").alias("timestamp"))
    millis = tm.epoch_is_millis(e)
    at = tm.from_epoch(F.col("timestamp"), millis)
    return e.groupBy(F.year(at).alias("year"), F.month(at).alias("month")).agg(F.count(F.lit(1)).alias("n")).withColumn("millis", F.lit(millis))


@query(f"WITH {OD} SELECT count(*) AS n, count(*) FILTER (ts < DATE '1993-01-01' OR ts > DATE '1997-12-31') AS out_of_range FROM od")
def out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    return log.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("ts") < F.to_timestamp_ntz(F.lit("1993-01-01"))) | (F.col("ts") > F.to_timestamp_ntz(F.lit("1997-12-31")))).alias("out_of_range"))


@query("""WITH k AS (SELECT page_id, nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(url, '\\?(.*)$', 1), '') AS args FROM pages), f AS (SELECT * FROM k WHERE host IS NOT NULL QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1)
SELECT (SELECT count(*) FROM k WHERE host IS NULL) AS n_no_key, (SELECT count(host) FROM k) - count(*) AS n_repeated, count(*) AS n, round(avg((args IS NULL)::INT::DOUBLE), 6) AS null_rate FROM f""")
def metadata_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("url", "^https?://([^/:?#]+)", 1), F.lit("")).alias("host"), F.nullif(F.regexp_extract("url", r"\?(.*)$", 1), F.lit("")).alias("args"))
    first, facts = rel.first_by_key(k, "host", ["page_id"], ["args"])
    return facts.select("n_no_key", "n_repeated", "n", F.round("null_rate_args", 6).alias("null_rate"))


@query(f"WITH {DOC} SELECT row_id, 'L: ' || coalesce(nullif(trim(lang), ''), '(none)') || '; S: ' || coalesce(nullif(trim(category), ''), '(none)') || '.' AS prompt FROM doc")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_log(spark, sf_dir).select("row_id", tx.template({"l": F.col("lang"), "s": F.col("category")}, "L: {l}; S: {s}.").alias("prompt"))


@query("""WITH u AS (SELECT p_type, p_name FROM part), m AS (SELECT p_type, min(p_name) AS a, max(p_name) AS b FROM u GROUP BY 1)
SELECT p_type, coalesce(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))), 0)::INT AS n FROM m""")
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy("p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return m.select("p_type", tx.common_prefix_length(F.col("a"), F.col("b")).cast("int").alias("n"))


_NOTES = ("Kendi çocuğu", "EMİN DEĞİL", "emin değilim!", "kendi çocuğu değil", "  ", "ok")
_CODES = {"kendicocugu": "OWN_CHILD", "emindegil": "NOT_SURE", "emindegilim": "NOT_SURE"}


@query("SELECT doc_id, [" + ", ".join(f"'{x}'" if x else "NULL" for x in ("OWN_CHILD", "NOT_SURE", "NOT_SURE", "kendi çocuğu değil", "", "ok")) + "][doc_id % 6 + 1] AS code FROM labels")
def note_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.get(F.array(*[F.lit(n) for n in _NOTES]), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", tx.note_code(note, _CODES).alias("code"))


@query(f"WITH {_RATED} SELECT doc_id, pred <> 'household' AND doc_id % 3 <> 1 AS ok FROM rt")
def valid_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.when(F.col("doc_id") % 3 == 1, "perhaps").otherwise("high")
    r = _rated(spark, sf_dir).select("doc_id", F.to_json(F.struct(F.col("pred").alias("label"), sure.alias("confidence"))).alias("answer"))
    return r.select("doc_id", tx.valid_label(F.col("answer"), ["self", "gift_given", "received", "unclear"], ["label", "confidence"], {"confidence": ["high", "low"]}).alias("ok"))


@query("SELECT doc_id, text IS NOT NULL AND length(trim(text)) > 0 AND contains(text, left(text, 20)) AND trim(left(text, 20)) <> '' AS verbatim FROM documents")
def verbatim_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(tx.is_verbatim(F.substring("text", 1, 20), F.col("text")), F.lit(False)).alias("verbatim"))


@query("SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE o_orderkey::VARCHAR END AS BIGINT) AS n FROM orders")
def dirty_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.try_cast("bigint").alias("n"))


@query("SELECT conv_id, list(role ORDER BY turn, role)[3] AS third FROM conversations GROUP BY 1")
def list_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", F.get("t", F.lit(2))["role"].alias("third"))


@query("SELECT c_custkey::BIGINT AS id, c_acctbal::DOUBLE AS amount FROM customer UNION ALL SELECT o_orderkey::BIGINT, o_custkey::DOUBLE FROM orders")
def relaxed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("int").alias("amount"))
    return rel.union_relaxed([a, b], {"id": "bigint", "amount": "double"})


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS labels_same, true AS self_same")
def same_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lb = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return spark.createDataFrame([(rel.same_keys(d, lb, "doc_id"), rel.same_keys(d, d, "doc_id"))], "labels_same boolean, self_same boolean")


@query(f"WITH {OD} SELECT label, sum(quantity)::DOUBLE AS weight FROM od GROUP BY 1")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(orders_log(spark, sf_dir), "label", "label", "quantity").select(F.col("ref").alias("label"), F.col("n").cast("double").alias("weight"))


@query(f"WITH {OD} SELECT year(ts)::INT AS year, count(*) AS n FROM od WHERE year(ts) >= 1995 GROUP BY 1")
def volume_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).filter(F.year("ts") >= 1995).groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n"))


_AT = tuple(i / 100 for i in range(101))


@query(f"WITH {DOC}, p AS (SELECT strlen(left(text, strpos(text, ' and ') - 1)) / length(text)::DOUBLE AS pos FROM doc WHERE strpos(text, ' and ') > 0) SELECT g.x::DOUBLE AS x, round(avg((pos <= g.x)::INT::DOUBLE), 6) AS share FROM p, (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in _AT)}) g(x) GROUP BY 1")
def position_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.operators import eda

    d = documents_log(spark, sf_dir).withColumn("at", F.instr("text", " and ")).filter("at > 0")
    d = d.select((tx.byte_offset(F.col("text"), F.col("at") - 1) / F.char_length("text")).alias("pos"))
    return eda.ecdf_grid(d, "pos", _AT).withColumn("share", F.round("share", 6))


@query("WITH a AS (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), t AS (SELECT p_brand FROM a ORDER BY n DESC, p_brand LIMIT 5), c AS (SELECT p_type, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'other' END AS brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_type, brand, round(count(*) / (sum(count(*)) OVER (PARTITION BY p_type))::DOUBLE, 6) AS share FROM c GROUP BY 1, 2")
def pooled_top_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    j = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_type", "p_brand")
    top = j.groupBy("p_brand").count().orderBy(F.desc("count"), "p_brand").limit(5).select(F.col("p_brand").alias("top"))
    c = j.join(F.broadcast(top), F.col("p_brand") == F.col("top"), "left").groupBy("p_type", F.coalesce("top", F.lit("other")).alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("p_type", "brand", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("p_type")), 6).alias("share"))


@query("SELECT conv_id, arg_max(role, turn) FILTER (turn < mx) AS second_last FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS mx FROM conversations) GROUP BY 1")
def second_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", F.get("t", F.size("t") - 2)["role"].alias("second_last"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(25)
