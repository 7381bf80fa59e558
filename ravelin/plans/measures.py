"""Rates, distributions, agreement, weights, prevalence and marketing measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.labels import in_set
from ravelin.operators import eda, sampling, stats
from ravelin.operators import marketing as mk
from ravelin.operators import sequence as seq
from ravelin.plans.registry import EV, OD, SPLIT, query
from ravelin.sources.views import documents_log, events_log, orders_log, table

_HIT = "label = 'gift_given'"


def _hit():
    return in_set(F.col("label"))


@query(f"WITH {OD} SELECT month(ts)::INT AS month, count(*) AS n, count(*) FILTER ({_HIT}) AS n_hits, round(count(*) FILTER ({_HIT}) / count(*)::DOUBLE, 6) AS rate FROM od GROUP BY 1")
def rates_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.rate_by(orders_log(spark, sf_dir), [F.month("ts").alias("month")], _hit()).withColumn("rate", F.round("rate", 6))


@query(f"WITH {OD} SELECT year(ts)::INT AS year, count(*) AS n, count(*) FILTER ({_HIT}) AS n_hits, round(count(*) FILTER ({_HIT}) / count(*)::DOUBLE, 6) AS rate FROM od GROUP BY 1 HAVING count(*) >= 500")
def rates_by_year_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.rate_by(orders_log(spark, sf_dir), [F.year("ts").alias("year")], _hit(), 500).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {OD}, r AS (SELECT avg(({_HIT})::INT::DOUBLE) FILTER (month(ts) IN (12, 1)) AS p, avg(({_HIT})::INT::DOUBLE) FILTER (month(ts) IN (6, 7, 8)) AS t FROM od)
SELECT round(p, 6) AS peak_rate, round(t, 6) AS trough_rate, round(p / nullif(t, 0), 6) AS ratio FROM r""")
def seasonality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.seasonality(orders_log(spark, sf_dir), F.month("ts"), _hit(), (12, 1), (6, 7, 8))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(f"""WITH {OD}, u AS (SELECT user_id, count(*) AS n FROM od GROUP BY 1), i AS (SELECT item, count(*) AS n FROM od GROUP BY 1),
t AS (SELECT sum(n)::DOUBLE AS held FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, count(*) OVER () AS m FROM i) WHERE r <= greatest(1, m // 10))
SELECT (SELECT sum(n)::BIGINT FROM u) AS n_rows, (SELECT count(*) FROM u) AS n_users, (SELECT count(*) FROM i) AS n_items,
round((SELECT sum(n) FROM u) / ((SELECT count(*) FROM u) * (SELECT count(*) FROM i))::DOUBLE, 6) AS density, round((SELECT avg(n) FROM u), 6) AS mean_user, (SELECT median(n) FROM u)::DOUBLE AS median_user,
round((SELECT avg(n) FROM i), 6) AS mean_item, (SELECT median(n) FROM i)::DOUBLE AS median_item, round((SELECT held FROM t) / (SELECT sum(n) FROM u), 6) AS top_decile_share""")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = eda.profile(orders_log(spark, sf_dir), "user_id", "item")
    return p.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes])


@query(f"WITH {OD}, i AS (SELECT count(*)::DOUBLE AS x FROM od GROUP BY item), r AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM i) SELECT round(2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = orders_log(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return stats.gini(n, "n").select(F.round("gini", 6).alias("gini"))


@query(f"""WITH {OD}, i AS (SELECT count(*)::DOUBLE AS x FROM od GROUP BY item), r AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n, sum(x) OVER () AS t FROM i)
SELECT g.range / 10.0::DOUBLE AS p, round(coalesce(sum(x) FILTER (k <= g.range * n // 10), 0) / max(t), 6) AS share FROM r, range(1, 11) g GROUP BY g.range""")
def lorenz(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = orders_log(spark, sf_dir).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return stats.lorenz(n, "n").withColumn("share", F.round("share", 6))


_GRID = (0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500)


@query("SELECT g.x::DOUBLE AS x, round(avg((value <= g.x)::INT::DOUBLE), 6) AS share FROM events, (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _GRID) + ") g(x) WHERE value IS NOT NULL GROUP BY 1")
def ecdf_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.ecdf_grid(table(spark, sf_dir, "events"), "value", _GRID).withColumn("share", F.round("share", 6))


@query("WITH u AS (SELECT count(*) AS n FROM events GROUP BY user_id) SELECT g.range AS x, round(avg((n >= g.range)::INT::DOUBLE), 6) AS share FROM u, range(1, 101) g GROUP BY 1")
def survival_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return eda.survival(n, "n", 100).withColumn("share", F.round("share", 6))


@query("""WITH v AS (SELECT floor(value)::BIGINT AS v FROM events), g AS (SELECT range AS x FROM range(1, 6))
SELECT x, count(v) AS n FROM g LEFT JOIN v ON v = x GROUP BY 1 UNION ALL SELECT NULL, count(*) FILTER (v IS NULL OR v NOT BETWEEN 1 AND 5) FROM v""")
def value_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.value_grid(table(spark, sf_dir, "events"), F.floor("value"), range(1, 6))


@query(f"""WITH {EV}, u AS (SELECT user_id, count(*) FILTER ({_HIT}) / count(*)::DOUBLE AS f FROM ev GROUP BY 1)
SELECT b.range AS bin, count(f) AS n FROM range(10) b LEFT JOIN (SELECT f, least(floor(f / 0.1::DOUBLE), 9)::BIGINT AS bin FROM u WHERE f > 0) x ON x.bin = b.range GROUP BY 1""")
def gift_fraction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = events_log(spark, sf_dir).groupBy("user_id").agg((F.count_if(_hit()) / F.count(F.lit(1))).alias("f")).filter("f > 0")
    return eda.histogram(u, "f", 0.0, 1.0, 10)


@query(f"""WITH {EV}, u AS (SELECT user_id, count(*) AS n, count(*) FILTER ({_HIT}) AS k, arg_max({_HIT}, (ts, row_id)) AS last FROM ev GROUP BY 1)
SELECT count(*) AS n_users, round(avg((k > 0)::INT::DOUBLE), 6) AS share_any, round(avg(last::INT::DOUBLE), 6) AS share_last, round(avg((k = n)::INT::DOUBLE), 6) AS share_all, round(avg(1 - last::INT::DOUBLE), 6) AS share_eligible, round(avg(CASE WHEN k > 0 THEN k / n::DOUBLE END), 6) AS mean_share FROM u""")
def sequence_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = eda.feasibility(events_log(spark, sf_dir), _hit())
    return f.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes])


@query(f"WITH {EV} SELECT item, count(*) AS n, round(count(*) FILTER ({_HIT}) / count(*)::DOUBLE, 6) AS rate FROM ev GROUP BY 1 HAVING count(*) >= 20")
def item_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.item_concentration(events_log(spark, sf_dir), _hit()).withColumn("rate", F.round("rate", 6))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_samp(value), 6) AS sd_value, round(avg((value >= 50)::INT::DOUBLE), 6) AS share_high FROM events GROUP BY 1""")
def value_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.stddev_samp("value"), 6).alias("sd_value"), F.round(F.avg((F.col("value") >= 50).cast("double")), 6).alias("share_high"))


_Z = stats.Z95


@query(f"""WITH g AS (SELECT d.lang, count(*)::DOUBLE AS n, count(*) FILTER (toxic = 1)::DOUBLE AS k FROM labels JOIN documents d USING (doc_id) GROUP BY 1)
SELECT lang, n::BIGINT AS n, k::BIGINT AS k, round(((k/n) + {_Z * _Z!r}::DOUBLE / (2*n)) / (1 + {_Z * _Z!r}::DOUBLE / n) - {_Z!r}::DOUBLE * sqrt((k/n) * (1 - k/n) / n + {_Z * _Z!r}::DOUBLE / (4*n*n)) / (1 + {_Z * _Z!r}::DOUBLE / n), 6) AS lo,
round(((k/n) + {_Z * _Z!r}::DOUBLE / (2*n)) / (1 + {_Z * _Z!r}::DOUBLE / n) + {_Z!r}::DOUBLE * sqrt((k/n) * (1 - k/n) / n + {_Z * _Z!r}::DOUBLE / (4*n*n)) / (1 + {_Z * _Z!r}::DOUBLE / n), 6) AS hi FROM g""")
def wilson_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("lang", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


# Five-valued labels and three derived raters over the labels table.
_RATED = """rt AS (SELECT doc_id, CASE quality * 2 + toxic WHEN 2 THEN 'self' WHEN 3 THEN 'gift_given' WHEN 0 THEN 'household' ELSE 'received' END AS ref,
CASE WHEN doc_id % 7 = 0 THEN 'unclear' WHEN doc_id % 5 = 0 THEN 'self' ELSE CASE quality * 2 + toxic WHEN 2 THEN 'self' WHEN 3 THEN 'gift_given' WHEN 0 THEN 'household' ELSE 'received' END END AS pred,
CASE WHEN doc_id % 3 = 0 THEN 'gift_given' ELSE CASE quality * 2 + toxic WHEN 2 THEN 'self' WHEN 3 THEN 'gift_given' WHEN 0 THEN 'household' ELSE 'received' END END AS third FROM labels)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("quality") * 2 + F.col("toxic")
    ref = F.when(code == 2, "self").when(code == 3, "gift_given").when(code == 0, "household").otherwise("received")
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", ref.alias("ref"), F.when(d % 7 == 0, "unclear").when(d % 5 == 0, "self").otherwise(ref).alias("pred"), F.when(d % 3 == 0, "gift_given").otherwise(ref).alias("third"))


#: The half of the rows that a person has checked: drawn by prediction.
_CHECKED = """ck AS (SELECT doc_id, ref, pred, third FROM (SELECT *, count(*) OVER (PARTITION BY pred) AS n, row_number() OVER (PARTITION BY pred ORDER BY md5('2|' || pred || '|' || doc_id), doc_id) AS rn FROM rt)
WHERE rn <= CASE WHEN n < 2 THEN 0 ELSE round_even(n * 0.5::DOUBLE, 0) END)"""


def _checked(rated: DataFrame) -> DataFrame:
    return sampling.holdout(rated, F.col("pred"), 0.5, 2, "doc_id").filter("part = 'holdout'").drop("part")


_CELLS = f"{_RATED}, cm AS (SELECT ref, pred, count(*) AS n FROM rt GROUP BY 1, 2)"
_PRF = f"""{_CELLS}, sd AS (SELECT ref AS label, n::DOUBLE AS r, 0.0::DOUBLE AS p, CASE WHEN ref = pred THEN n ELSE 0 END::DOUBLE AS tp FROM cm UNION ALL SELECT pred, 0.0::DOUBLE, n::DOUBLE, 0.0::DOUBLE FROM cm),
pr AS (SELECT label, sum(r) AS support, sum(tp) / nullif(sum(p), 0) AS precision, sum(tp) / nullif(sum(r), 0) AS recall, 2 * sum(tp) / nullif(sum(r) + sum(p), 0) AS f1 FROM sd GROUP BY 1)"""


@query(f"WITH {_CELLS} SELECT * FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.confusion(_rated(spark, sf_dir), "ref", "pred")


@query(f"WITH {_PRF} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.class_scores(stats.confusion(_rated(spark, sf_dir), "ref", "pred"))
    return s.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {_PRF} SELECT round(avg(f1), 6) AS macro_f1, count(f1) AS n_classes FROM pr")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.macro_f1(stats.class_scores(stats.confusion(_rated(spark, sf_dir), "ref", "pred")))
    return m.select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


@query(f"""WITH {_RATED}, b AS (SELECT ref IN ('gift_given', 'household', 'received') AS r, pred IN ('gift_given', 'household', 'received') AS p FROM rt),
c AS (SELECT count(*) FILTER (r AND p) AS tp, count(*) FILTER (NOT r AND p) AS fp, count(*) FILTER (r AND NOT p) AS fn FROM b)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1 FROM c""")
def binary_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.functions.labels import BROAD

    b = stats.binary_axis(_rated(spark, sf_dir), "ref", "pred", BROAD)
    return b.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_IPW = f"""{_RATED}, smp0 AS (SELECT rt.doc_id, d.lang AS category, rt.ref AS label, rt.pred FROM rt JOIN documents d USING (doc_id)),
smp AS (SELECT doc_id, category, label, pred FROM (SELECT *, count(*) OVER (PARTITION BY category) AS n, row_number() OVER (PARTITION BY category ORDER BY md5('4|' || category || '|' || doc_id), doc_id) AS rn FROM smp0) WHERE rn <= CASE WHEN n < 2 THEN 0 ELSE round_even(n * 0.25::DOUBLE, 0) END),
pop AS (SELECT d.lang AS category, rt.ref AS label, count(*) AS n FROM rt JOIN documents d USING (doc_id) GROUP BY 1, 2),
sn AS (SELECT category, label, count(*) AS n_sample FROM smp GROUP BY 1, 2), sl AS (SELECT label, sum(n_sample) AS n_label FROM sn GROUP BY 1),
th AS (SELECT label, sum(n) AS thin FROM pop LEFT JOIN sn USING (category, label) WHERE coalesce(n_sample, 0) < 5 GROUP BY 1)"""


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rated = _rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category")), "doc_id").withColumnRenamed("ref", "label")
    drawn = sampling.holdout(rated, F.col("category"), 0.25, 4, "doc_id").filter("part = 'holdout'").drop("part")
    return drawn, rated.groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_IPW} SELECT category, label, n_sample, round(CASE WHEN n_sample >= 5 THEN coalesce(n, 0) / n_sample::DOUBLE ELSE 0 END + coalesce(thin, 0) / n_label::DOUBLE, 6) AS weight
FROM sn LEFT JOIN pop USING (category, label) JOIN sl USING (label) LEFT JOIN th USING (label)""")
def ipw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ipw(*_frames(spark, sf_dir))[0].withColumn("weight", F.round("weight", 6))


@query(f"WITH {_IPW} SELECT round(sum(CASE WHEN n_label IS NULL THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS uncovered FROM pop LEFT JOIN sl USING (label)")
def ipw_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ipw(*_frames(spark, sf_dir))[1].select(F.round("uncovered", 6).alias("uncovered"))


@query(f"WITH {_RATED} SELECT doc_id, CASE WHEN ref = pred OR ref = third THEN ref WHEN pred = third THEN pred ELSE 'tie' END AS consensus FROM rt")
def majority_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).select("doc_id", stats.consensus([F.col(c) for c in ("ref", "pred", "third")]).alias("consensus"))


@query(f"""WITH {_RATED}, l AS (SELECT doc_id, unnest([ref, pred, third]) AS c FROM rt), n AS (SELECT doc_id, c, count(*) AS k FROM l GROUP BY 1, 2),
p AS (SELECT doc_id, (sum(k * k) - 3) / 6.0::DOUBLE AS p FROM n GROUP BY 1), e AS (SELECT sum((k / t::DOUBLE) ** 2) AS e FROM (SELECT count(*) AS k, sum(count(*)) OVER () AS t FROM l GROUP BY c))
SELECT round((avg(p) - any_value(e)) / (1 - any_value(e)), 6) AS kappa, count(*) AS n_rows, 0::BIGINT AS n_dropped FROM p, e""")
def fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = stats.fleiss(_rated(spark, sf_dir), ["ref", "pred", "third"])
    return k.select(F.round("kappa", 6).alias("kappa"), "n_rows", "n_dropped")


@query(f"""WITH {_RATED}, l AS (SELECT doc_id, unnest([ref, pred, third]) AS label FROM rt), k AS (SELECT doc_id, label, count(*) AS k FROM l GROUP BY 1, 2),
c AS (SELECT DISTINCT label FROM l), g AS (SELECT c.label, rt.doc_id, coalesce(k.k, 0) AS k FROM c CROSS JOIN rt LEFT JOIN k ON k.label = c.label AND k.doc_id = rt.doc_id),
s AS (SELECT label, sum(k) AS n_ratings, avg((k * (k - 1) + (3 - k) * (2 - k)) / 6.0::DOUBLE) AS p, sum(k) / (3.0::DOUBLE * count(*)) AS q FROM g GROUP BY 1)
SELECT label, n_ratings::BIGINT AS n_ratings, round((p - (q * q + (1 - q) * (1 - q))) / nullif(1 - (q * q + (1 - q) * (1 - q)), 0), 6) AS kappa FROM s""")
def kappa_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kappa_by_class(_rated(spark, sf_dir), ["ref", "pred", "third"]).withColumn("kappa", F.round("kappa", 6))


@query(f"""WITH {_RATED}, {_CHECKED}, sh AS (SELECT pred AS label, count(*) / (SELECT count(*) FROM rt)::DOUBLE AS share FROM rt GROUP BY 1), pv AS (SELECT pred AS label, avg((ref = 'gift_given')::INT::DOUBLE) AS ppv FROM ck GROUP BY 1)
SELECT round(CASE WHEN bool_or(share > 0 AND ppv IS NULL) THEN NULL ELSE sum(share * coalesce(ppv, 0)) END, 6) AS rate FROM sh LEFT JOIN pv USING (label)""")
def calibrated_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir)
    n = r.agg(F.count(F.lit(1)).alias("all"))
    shares = r.groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("label", (F.col("n") / F.col("all")).alias("share"))
    ppv = _checked(r).groupBy(F.col("pred").alias("label")).agg(F.avg((F.col("ref") == "gift_given").cast("double")).alias("ppv"))
    return stats.calibrated_rate(shares, ppv).select(F.round("rate", 6).alias("rate"))


@query(f"""WITH {_RATED}, j AS (SELECT d.lang, rt.* FROM rt JOIN documents d USING (doc_id))
SELECT lang, count(*) AS n, count(*) FILTER (ref = 'gift_given') AS narrow_k, count(*) FILTER (ref IN ('gift_given', 'household', 'received')) AS broad_k,
round(avg((ref = 'gift_given')::INT::DOUBLE) / nullif(avg((third = 'gift_given')::INT::DOUBLE), 0), 6) AS over_proxy FROM j GROUP BY 1""")
def prevalence_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _rated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    narrow, broad, proxy = in_set(F.col("ref")), in_set(F.col("ref"), "broad"), in_set(F.col("third"))
    rate = F.avg(narrow.cast("double")) / F.nullif(F.avg(proxy.cast("double")), F.lit(0.0))
    return j.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(narrow).alias("narrow_k"), F.count_if(broad).alias("broad_k"), F.round(rate, 6).alias("over_proxy"))


@query(f"""WITH {_RATED} SELECT (third = 'gift_given') AS flagged, count(*) AS n, round(avg((ref = 'gift_given')::INT::DOUBLE), 6) AS rate FROM rt GROUP BY 1""")
def beyond_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rated(spark, sf_dir).groupBy((F.col("third") == "gift_given").alias("flagged"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("ref") == "gift_given").cast("double")), 6).alias("rate"))


_HIST = f"{OD}, h AS (SELECT od.*, p_type AS subcat FROM od JOIN part ON item = p_partkey)"
_ONLY = "go AS (SELECT user_id, subcat FROM h GROUP BY 1, 2 HAVING bool_or(label = 'gift_given') AND NOT bool_or(label <> 'gift_given'))"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("subcat"))
    return orders_log(spark, sf_dir).join(part, "item")


#: Order lines in a task that groups them, about.
LINES_AT_ONCE = 1_000_000


@query(f"WITH {_HIST}, {_ONLY} SELECT * FROM go")
def gift_only_subcats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Few lines of a user share a category, so what is counted before a shuffle stays as long
    # as the lines: they are dealt by user first, so many to a task.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES_AT_ONCE))
    lines = _history(spark, sf_dir).select("user_id", "subcat", "label").repartition(tasks, "user_id")
    return mk.gift_only(lines, _hit())


_TOP = "tk AS (SELECT user_id, item FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY price DESC, row_id) AS r FROM h) WHERE r <= 20)"


@query(f"""WITH {_HIST}, {_ONLY}, {_TOP} SELECT tk.user_id, round(count(go.subcat) / 20.0::DOUBLE, 6) AS share FROM tk JOIN part ON tk.item = p_partkey LEFT JOIN go ON go.user_id = tk.user_id AND go.subcat = p_type GROUP BY 1""")
def m1_waste_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    h = _history(spark, sf_dir)
    topk = h.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("price"), "row_id"))).filter("r <= 20").select("user_id", "item")
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("subcat"))
    return mk.list_share(topk, items, mk.gift_only(h, _hit()), 20).withColumn("share", F.round("share", 6))


@query(f"""WITH {_HIST}, {_ONLY}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_id) AS pos FROM h),
l AS (SELECT user_id, max(pos) AS at_, arg_max(subcat, pos) AS subcat FROM p WHERE label = 'gift_given' GROUP BY 1), g AS (SELECT l.* FROM l SEMI JOIN go ON go.user_id = l.user_id AND go.subcat = l.subcat),
a AS (SELECT p.user_id, count(*) AS n FROM p JOIN g USING (user_id) WHERE p.label = 'self' AND p.pos > g.at_ GROUP BY 1)
SELECT g.user_id, g.subcat, least(coalesce(a.n, 0), 10)::INT AS bucket FROM g LEFT JOIN a USING (user_id)""")
def m2_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return mk.gift_buckets(h, _hit(), F.col("label") == "self", mk.gift_only(h, _hit()))


@query(f"""WITH {OD}, n AS (SELECT user_id, count(*) AS n FROM od GROUP BY 1), q AS (SELECT quantile_cont(n, {1 / 3!r}::DOUBLE) AS a, quantile_cont(n, {2 / 3!r}::DOUBLE) AS b FROM n)
SELECT user_id, CASE WHEN n <= a THEN 'low' WHEN n <= b THEN 'mid' ELSE 'high' END AS tercile FROM n, q""")
def m3_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.terciles(orders_log(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {SPLIT} SELECT split, label, count(*) AS n FROM sp GROUP BY 1, 2""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.leave_one_out(events_log(spark, sf_dir)).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY 1")
def language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text").cast("long")
    return documents_log(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("least"), F.max(n).alias("most"))
