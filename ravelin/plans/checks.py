"""Checks of labels, intervals of ratios and scores, and further figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions.labels import in_set
from ravelin.operators import bootstrap as bs
from ravelin.operators import eda, stats
from ravelin.operators import relational as rel
from ravelin.operators import sequence as seq
from ravelin.operators import validation as va
from ravelin.plans.measures import _CHECKED, _IPW, _RATED, _checked, _frames, _hit, _rated
from ravelin.plans.registry import DOC, EV, OD, query
from ravelin.plans.relational import _core_sql, _pairs
from ravelin.sources.views import documents_log, events_log, orders_log, table

_Z2 = f"{1.96 * 1.96!r}::DOUBLE"


@query(f"""WITH {_RATED}, g AS (SELECT third AS stratum, count(*) AS n, count(*) FILTER (ref = pred) AS n_right FROM rt GROUP BY 1)
SELECT stratum, n, n_right, round(n_right / n::DOUBLE, 6) AS share,
round(greatest(0.0::DOUBLE, (n_right / n::DOUBLE + {_Z2} / (2 * n)) / (1 + {_Z2} / n) - 1.96::DOUBLE * sqrt((n_right / n::DOUBLE) * (1 - n_right / n::DOUBLE) / n + {_Z2} / (4.0::DOUBLE * n * n)) / (1 + {_Z2} / n)), 6) AS lo,
round(least(1.0::DOUBLE, (n_right / n::DOUBLE + {_Z2} / (2 * n)) / (1 + {_Z2} / n) + 1.96::DOUBLE * sqrt((n_right / n::DOUBLE) * (1 - n_right / n::DOUBLE) / n + {_Z2} / (4.0::DOUBLE * n * n)) / (1 + {_Z2} / n)), 6) AS hi FROM g""")
def precision_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = va.precision_by_stratum(_rated(spark, sf_dir).withColumnRenamed("third", "stratum"), "stratum", F.col("ref") == F.col("pred"))
    return p.select("stratum", "n", "n_right", *[F.round(c, 6).alias(c) for c in ("share", "lo", "hi")])


@query(f"""WITH {OD}, u AS (SELECT 'narrow' AS axis, ts, (label = 'gift_given')::INT::DOUBLE AS hit FROM od UNION ALL SELECT 'broad', ts, (label IN ('gift_given', 'household', 'received'))::INT::DOUBLE FROM od),
r AS (SELECT axis, avg(hit) FILTER (month(ts) IN (12, 1)) AS p, avg(hit) FILTER (month(ts) IN (6, 7, 8)) AS t FROM u GROUP BY 1)
SELECT axis, round(p, 6) AS peak_rate, round(t, 6) AS trough_rate, round(p / nullif(t, 0), 6) AS ratio FROM r""")
def two_axis_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = va.two_axis_seasonality(orders_log(spark, sf_dir), F.month("ts"), F.col("label"), (12, 1), (6, 7, 8))
    return s.select("axis", *[F.round(c, 6).alias(c) for c in ("peak_rate", "trough_rate", "ratio")])


@query(f"WITH {_RATED}, {_CHECKED} SELECT count(*) AS n, round(avg((a.ref = b.third)::INT::DOUBLE), 6) AS agreement FROM rt a JOIN ck b USING (doc_id)")
def overlap_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir)
    a = va.overlap_agreement(r.select("doc_id", F.col("ref").alias("label")), _checked(r).select("doc_id", F.col("third").alias("label")), "doc_id")
    return a.select("n", F.round("agreement", 6).alias("agreement"))


@query(f"WITH {_RATED} SELECT 'human' AS side, ref AS label, count(*) AS n FROM rt GROUP BY 2 UNION ALL SELECT 'model', pred, count(*) FROM rt GROUP BY 2 UNION ALL SELECT 'change', ref || '>' || pred, count(*) FROM rt GROUP BY 2")
def label_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.cross_tab(_rated(spark, sf_dir), "ref", "pred")


@query("WITH r AS (SELECT DISTINCT event_type AS condition, user_id AS seed FROM events WHERE value > 80) SELECT seed FROM r GROUP BY 1 HAVING count(DISTINCT condition) = (SELECT count(DISTINCT condition) FROM r)")
def common_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").filter("value > 80").select(F.col("event_type").alias("condition"), F.col("user_id").alias("seed")).distinct()
    return va.common_seeds(runs)


_W = " + ".join(f"(u >= {t!r}::DOUBLE)::INT" for t in stats.POISSON)


def _reps(rows: str, key: str, n: int, seed: int) -> str:
    return f"(SELECT *, {_W} AS w FROM (SELECT r.*, b.range AS rep, ('0x' || substr(md5('{seed}|' || b.range || '|' || {key}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS u FROM {rows} r, range({n}) b))"


@query(f"""WITH {EV}, x AS (SELECT row_id, ({'label = ' + repr('gift_given')})::INT::DOUBLE AS h, day(ts) <= 10 AS t, day(ts) > 20 AS b FROM ev), w AS {_reps('x', 'row_id', 100, 42)},
m AS (SELECT rep, sum(w * h) FILTER (t) / nullif(sum(w) FILTER (t), 0) / nullif(sum(w * h) FILTER (b) / nullif(sum(w) FILTER (b), 0), 0) AS m FROM w GROUP BY 1)
SELECT round((SELECT avg(h) FILTER (t) / avg(h) FILTER (b) FROM x), 6) AS ratio, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def seasonality_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = va.ratio_ci(events_log(spark, sf_dir), "row_id", _hit(), F.dayofmonth("ts") <= 10, F.dayofmonth("ts") > 20, replicates=100)
    return c.select(*[F.round(x, 6).alias(x) for x in ("ratio", "lo", "hi")])


@query(f"""WITH {_RATED}, x AS (SELECT doc_id, ref = 'gift_given' AS r, pred = 'gift_given' AS p FROM rt), w AS {_reps('x', 'doc_id', 200, 7)},
m AS (SELECT rep, 2.0::DOUBLE * sum(CASE WHEN r AND p THEN w ELSE 0 END) / nullif(sum(CASE WHEN r THEN w ELSE 0 END) + sum(CASE WHEN p THEN w ELSE 0 END), 0) AS m FROM w GROUP BY 1)
SELECT round((SELECT 2.0::DOUBLE * count(*) FILTER (r AND p) / (count(*) FILTER (r) + count(*) FILTER (p)) FROM x), 6) AS f1, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m""")
def f1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = va.f1_ci(_rated(spark, sf_dir), "doc_id", F.col("ref") == "gift_given", F.col("pred") == "gift_given", replicates=200, seed=7)
    return c.select(*[F.round(x, 6).alias(x) for x in ("f1", "lo", "hi")])


@query(f"""WITH {_RATED}, {_CHECKED.replace('ck AS', 'ck0 AS')}, ck AS (SELECT doc_id, pred AS label, (ref = 'gift_given')::INT::DOUBLE AS r FROM ck0), md AS (SELECT doc_id, pred AS label FROM rt),
wa AS {_reps('md', 'doc_id', 100, 42)}, wb AS {_reps('ck', 'doc_id', 100, 43)},
sa AS (SELECT rep, label, sum(w) / nullif((sum(sum(w)) OVER (PARTITION BY rep))::DOUBLE, 0) AS share FROM wa GROUP BY 1, 2), sb AS (SELECT rep, label, sum(w * r) / nullif(sum(w), 0) AS ppv FROM wb GROUP BY 1, 2),
m AS (SELECT rep, CASE WHEN bool_or(share > 0 AND ppv IS NULL) THEN NULL ELSE sum(share * coalesce(ppv, 0)) END AS m FROM sa LEFT JOIN sb USING (rep, label) GROUP BY 1),
p AS (SELECT sum(s.n / t.n::DOUBLE * v.ppv) AS rate FROM (SELECT label, count(*) AS n FROM md GROUP BY 1) s, (SELECT count(*) AS n FROM md) t, (SELECT label, avg(r) AS ppv FROM ck GROUP BY 1) v WHERE s.label = v.label)
SELECT round(any_value(rate), 6) AS rate, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m, p""")
def calibrated_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir)
    model = r.select("doc_id", F.col("pred").alias("label"))
    checked = _checked(r).select("doc_id", F.col("pred").alias("label"), "ref")
    c = va.calibrated_ci(model, checked, "doc_id", "label", F.col("ref") == "gift_given", replicates=100)
    return c.select(*[F.round(x, 6).alias(x) for x in ("rate", "lo", "hi")])


_CLASSES = ("self", "gift_given", "household", "received")
_BY_CLASS = ", ".join(f"sum(v) FILTER (ref = '{c}') AS r{i}, sum(v) FILTER (pred = '{c}') AS p{i}, sum(v) FILTER (ref = '{c}' AND pred = '{c}') AS t{i}" for i, c in enumerate(_CLASSES))


def _scores_sql(rows: str) -> str:
    """(rep, label, score, m) of a table with ref, pred, v and rep."""
    f1 = [f"2 * coalesce(t{i}, 0) / nullif(coalesce(r{i}, 0) + coalesce(p{i}, 0), 0)" for i in range(len(_CLASSES))]
    out = [f"SELECT rep, 'all' AS label, 'accuracy' AS score, ({' + '.join(f'coalesce(t{i}, 0)' for i in range(len(_CLASSES)))}) / nullif(s, 0) AS m FROM {rows}", f"SELECT rep, 'all', 'macro_f1', list_avg(list_filter([{', '.join(f1)}], lambda x: x IS NOT NULL)) FROM {rows}"]
    for i, c in enumerate(_CLASSES):
        out += [f"SELECT rep, '{c}', 'precision', coalesce(t{i}, 0) / nullif(p{i}, 0) FROM {rows}", f"SELECT rep, '{c}', 'recall', coalesce(t{i}, 0) / nullif(r{i}, 0) FROM {rows}", f"SELECT rep, '{c}', 'f1', {f1[i]} FROM {rows}"]
    return " UNION ALL ".join(out)


@query(f"""WITH {_IPW}, wt AS (SELECT category, label, (CASE WHEN n_sample >= 5 THEN coalesce(n, 0) / n_sample::DOUBLE ELSE 0 END + coalesce(thin, 0) / n_label::DOUBLE)::DOUBLE AS v
  FROM sn LEFT JOIN pop USING (category, label) JOIN sl USING (label) LEFT JOIN th USING (label)),
x AS (SELECT doc_id, category, label, label AS ref, pred, v, category || '|' || label AS stratum FROM smp JOIN wt USING (category, label)),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|order|' || doc_id), doc_id::VARCHAR) - 1 AS place, count(*) OVER (PARTITION BY stratum) AS size FROM x),
d AS (SELECT b.range AS rep, stratum, floor(('0x' || substr(md5('42|' || b.range || '|' || stratum || '|0|' || place), 1, 8))::UBIGINT / 4294967296.0::DOUBLE * size)::BIGINT AS place FROM o, range(100) b),
s0 AS (SELECT d.rep, sum(v) AS s, {_BY_CLASS} FROM d JOIN o USING (stratum, place) GROUP BY 1), s1 AS (SELECT 0 AS rep, sum(v) AS s, {_BY_CLASS} FROM x),
m AS ({_scores_sql('s0')}), p AS ({_scores_sql('s1')})
SELECT label, score, round(any_value(p.m), 6) AS value, round(quantile_cont(m.m, 0.025), 6) AS lo, round(quantile_cont(m.m, 0.975), 6) AS hi FROM m JOIN p USING (label, score) GROUP BY 1, 2""")
def stratified_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, population = _frames(spark, sf_dir)
    weighted = sample.join(stats.ipw(sample, population)[0].select("category", "label", "weight"), ["category", "label"])
    s = bs.stratified_scores(weighted, "doc_id", "label", "pred", ["category", "label"], _CLASSES, "weight", replicates=100)
    return s.select("label", "score", *[F.round(c, 6).alias(c) for c in ("value", "lo", "hi")])


@query(_core_sql(20, 14, "SELECT round((SELECT avg((label = 'gift_given')::INT::DOUBLE) FROM od), 6) AS clean_rate, round(avg((label = 'gift_given')::INT::DOUBLE), 6) AS core_rate FROM od SEMI JOIN p14 USING (user_id, item)"))
def clean_and_core_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    core = log.join(rel.k_core(_pairs(spark, sf_dir), 20)[0], ["user_id", "item"], "left_semi")

    def rate(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.round(F.avg(_hit().cast("double")), 6).alias(name))

    return rate(log, "clean_rate").crossJoin(rate(core, "core_rate"))


@query(f"""WITH {DOC}, f AS (SELECT category, lower(regexp_extract(text, '\\b(with|from|that|this|was)\\b', 1, 'i')) AS w FROM doc), c AS (SELECT category, w AS recipient, count(*) AS n FROM f WHERE w <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, recipient) AS rank FROM c)
SELECT category, recipient, n, rank::INT AS rank, round(n / (sum(n) OVER (PARTITION BY category))::DOUBLE, 6) AS share FROM r WHERE rank <= 3""")
def top_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.nullif(F.lower(F.regexp_extract("text", r"(?i)\b(with|from|that|this|was)\b", 1)), F.lit(""))
    d = documents_log(spark, sf_dir).select("category", found.alias("recipient"))
    return rel.top_n_within(d, "category", "recipient", 3).withColumn("share", F.round("share", 6))


_HOURS = (1, 2, 6, 12, 24, 48, 96)


@query(f"""WITH {EV}, g AS (SELECT label = 'gift_given' AS after_gift, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, row_id)) - epoch_us(ts)) / 3600000000::DOUBLE AS gap FROM ev)
SELECT after_gift, x.x::DOUBLE AS x, round(avg((gap <= x.x)::INT::DOUBLE), 6) AS share FROM g, (VALUES {', '.join(f'({h})' for h in _HOURS)}) x(x) WHERE gap IS NOT NULL GROUP BY 1, 2""")
def gap_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.functions.time import micros

    gap = (micros(F.lead("ts").over(seq.by_user())) - micros(F.col("ts"))) / F.lit(3_600_000_000)
    rows = events_log(spark, sf_dir).select(_hit().alias("after_gift"), gap.alias("gap")).filter("gap IS NOT NULL")
    out = None
    for side in (True, False):
        e = eda.ecdf_grid(rows.filter(F.col("after_gift") == side), "gap", _HOURS).select(F.lit(side).alias("after_gift"), "x", F.round("share", 6).alias("share"))
        out = e if out is None else out.unionAll(e)
    return out


@query(f"""WITH {EV}, b AS (SELECT label = 'gift_given' AS gift, least(floor(value / 20), 9)::BIGINT AS bin FROM ev WHERE value >= 0), c AS (SELECT gift, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT gift, bin, n, round(n / (sum(n) OVER (PARTITION BY gift))::DOUBLE, 6) AS share FROM c""")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events_log(spark, sf_dir).filter("value >= 0").select(_hit().alias("gift"), F.least(F.floor(F.col("value") / 20), F.lit(9)).cast("long").alias("bin"))
    c = b.groupBy("gift", "bin").agg(F.count(F.lit(1)).alias("n"))
    return c.select("gift", "bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gift")), 6).alias("share"))


@query(f"""WITH {OD}, s AS (SELECT user_id, item, label, quantity, CASE WHEN quantity <= 10 THEN 'low' ELSE 'high' END AS dose FROM od)
SELECT dose, count(*) AS n, round(avg((label = 'gift_given')::INT::DOUBLE) - avg((label = 'household')::INT::DOUBLE), 6) AS effect FROM s GROUP BY 1""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    dose = F.when(F.col("quantity") <= 10, "low").otherwise("high")
    effect = F.avg(in_set(F.col("label")).cast("double")) - F.avg((F.col("label") == "household").cast("double"))
    return orders_log(spark, sf_dir).groupBy(dose.alias("dose")).agg(F.count(F.lit(1)).alias("n"), F.round(effect, 6).alias("effect"))
