"""Lexical scans and text statistics over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.operators import eda
from ravelin.operators import lexicon as lx
from ravelin.operators.quantiles import quantiles, spread
from ravelin.operators.relational import value_deciles
from ravelin.plans.registry import DOC, query
from ravelin.sources.store import cut
from ravelin.sources.views import documents_log

# A lexicon of words that the documents hold; \b and classes are plain ASCII so
# that both engines read it alike.
FAMILIES = {
    "evidence": lx.compile_family([r"\b{rel} (?:that|with|and)\b"], {"rel": ["the", "of", "in"]}),
    "speculative": r"\bwould|\band the\b",
    "received": r"\bby the\b|\bfrom the\b",
}
CAPTURES = {"recipient": r"\b(with|from|that)\b"}
_SQL = {k: rx.replace("'", "''") for k, rx in FAMILIES.items()}
_FLAGS = f"{DOC}, k AS (SELECT row_id, category, lang, text, length(text) AS text_len_chars, " + ", ".join(f"regexp_matches(text, '{rx}', 'i') AS kw_{k}" for k, rx in _SQL.items()) + " FROM doc)"


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ascii_words = {k: rx for k, rx in FAMILIES.items()}
    d = documents_log(spark, sf_dir)
    return d.select("row_id", "category", "lang", F.char_length("text").cast("long").alias("text_len_chars"), *[F.col("text").rlike(f"(?i){rx}").alias(f"kw_{k}") for k, rx in ascii_words.items()])


@query(f"WITH {_FLAGS} SELECT row_id, category, text_len_chars, kw_evidence, kw_speculative, kw_received, (kw_evidence AND NOT kw_received) AS kw_proxy FROM k")
def lexicon_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select("row_id", "category", "text_len_chars", "kw_evidence", "kw_speculative", "kw_received", (F.col("kw_evidence") & ~F.col("kw_received")).alias("kw_proxy"))


@query(f"""WITH {_FLAGS}, u AS (SELECT category, 'evidence' AS family, kw_evidence AS hit FROM k UNION ALL SELECT category, 'speculative', kw_speculative FROM k UNION ALL SELECT category, 'received', kw_received FROM k)
SELECT category, family, count(*) AS n, count(*) FILTER (hit) AS n_hits, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate FROM u GROUP BY 1, 2""")
def lexicon_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lx.rates(_scan(spark, sf_dir), [f"kw_{k}" for k in FAMILIES], ["category"])
    return r.select("category", F.substring("family", 4, 99).alias("family"), "n", "n_hits", F.round("rate", 6).alias("rate"))


@query(f"""WITH {_FLAGS}, r AS (SELECT avg((kw_evidence OR kw_speculative OR kw_received)::INT::DOUBLE) AS a, avg((kw_evidence AND NOT kw_received)::INT::DOUBLE) AS b FROM k)
SELECT round(a, 6) AS naive_rate, round(b, 6) AS proxy_rate, round(a / nullif(b, 0), 6) AS inflation FROM r""")
def naive_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    naive = F.col("kw_evidence") | F.col("kw_speculative") | F.col("kw_received")
    r = lx.inflation(_scan(spark, sf_dir), naive, F.col("kw_evidence") & ~F.col("kw_received"))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(f"""WITH {DOC} SELECT row_id, nullif(lower(regexp_extract(text, '\\b(with|from|that)\\b', 1, 'i')), '') AS kw_recipient FROM doc""")
def recipient_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.nullif(F.lower(F.regexp_extract("text", r"(?i)\b(with|from|that)\b", 1)), F.lit(""))
    return documents_log(spark, sf_dir).select("row_id", found.alias("kw_recipient"))


@query(f"""WITH {DOC}, p AS (SELECT row_id, text, strpos(text, ' and ') AS loc FROM doc)
SELECT row_id, round(strlen(left(text, loc - 1)) / length(text)::DOUBLE, 6) AS position FROM p WHERE loc > 0""")
def evidence_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir).withColumn("at", F.instr("text", " and ")).filter("at > 0")
    return d.select("row_id", F.round(tx.byte_offset(F.col("text"), F.col("at") - 1) / F.char_length("text"), 6).alias("position"))


@query(f"""WITH {DOC}, p AS (SELECT category, strlen(left(text, strpos(text, ' and ') - 1)) / length(text)::DOUBLE AS pos FROM doc WHERE strpos(text, ' and ') > 0),
r AS (SELECT category, pos, row_number() OVER (PARTITION BY category ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY category) AS n FROM p)
SELECT category, count(*) AS n, round(median(pos), 6) AS median_pos, round(max(CASE WHEN i = round_even((n - 1) * 0.9::DOUBLE, 0)::BIGINT THEN pos END), 6) AS p90_pos FROM r GROUP BY 1""")
def detection_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir).withColumn("at", F.instr("text", " and ")).filter("at > 0")
    d = d.select("category", (tx.byte_offset(F.col("text"), F.col("at") - 1) / F.char_length("text")).alias("pos"))
    d = cut(d)
    found = spread(quantiles(d, "pos", [0.5], ["category"]), [(0.5, "median_pos")], ["category"])
    high = spread(quantiles(d, "pos", [0.9], ["category"], "nearest"), [(0.9, "p90_pos")], ["category"])
    n = d.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return n.join(found, "category").join(high, "category").select("category", "n", F.round("median_pos", 6).alias("median_pos"), F.round("p90_pos", 6).alias("p90_pos"))


@query(f"WITH {DOC} SELECT row_id, len(regexp_extract_all(text, '[^\\s\\x0b]+'))::BIGINT AS n_words, length(text) AS n_chars FROM doc")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_log(spark, sf_dir).select("row_id", tx.word_count(F.col("text")).alias("n_words"), F.char_length("text").cast("long").alias("n_chars"))


@query(f"""WITH {DOC}, n AS (SELECT text, len(regexp_extract_all(text, '[^\\s\\x0b]+')) AS n, count(*) OVER (PARTITION BY text) > 1 AS dup FROM doc)
SELECT CASE WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' WHEN n <= 100 THEN '51-100' WHEN n <= 500 THEN '101-500' ELSE '>500' END AS bucket,
count(*) AS n, count(*) FILTER (dup) AS n_dup FROM n GROUP BY 1""")
def dup_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir).select(tx.right_closed(tx.word_count(F.col("text"))).alias("bucket"), eda.digest().alias("digest"))
    d = d.select("bucket", eda.duplicates().alias("dup"))  # texts stay where they are read
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("dup").alias("n_dup"))


@query(f"WITH {DOC} SELECT category, count(*) AS n, round(avg(regexp_matches(text, '[^\\x00-\\x7F]')::INT::DOUBLE), 6) AS share FROM doc GROUP BY 1")
def non_ascii_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_log(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tx.non_ascii(F.col("text")).cast("double")), 6).alias("share"))


_N = f"{DOC}, n AS (SELECT row_id, text, len(regexp_extract_all(text, '[^\\s\\x0b]+')) AS n FROM doc)"


@query(f"""WITH {_N}, q AS (SELECT quantile_cont(n, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM n),
d AS (SELECT n.*, (1 + len(list_filter(q, lambda c: n.n > c)))::INT AS decile FROM n, q)
SELECT decile, count(*) AS n, round(avg(regexp_matches(text, '\\band\\b')::INT::DOUBLE), 6) AS rate FROM d GROUP BY 1""")
def deciles_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir).withColumn("n", tx.word_count(F.col("text")))
    d = value_deciles(d, "n")
    return d.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("text").rlike(r"\band\b").cast("double")), 6).alias("rate"))


@query(f"""WITH {_N}, r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS m FROM n), c AS (SELECT max(CASE WHEN i = round_even((m - 1) * 0.2::DOUBLE, 0)::BIGINT THEN n END) AS lo, max(CASE WHEN i = round_even((m - 1) * 0.8::DOUBLE, 0)::BIGINT THEN n END) AS hi FROM r)
SELECT round(avg(CASE WHEN n <= lo THEN regexp_matches(text, '\\band\\b')::INT::DOUBLE END), 6) AS short_rate, round(avg(CASE WHEN n >= hi THEN regexp_matches(text, '\\band\\b')::INT::DOUBLE END), 6) AS long_rate FROM n, c""")
def length_confound(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.operators.relational import nearest_quantile

    d = documents_log(spark, sf_dir).select("text", tx.word_count(F.col("text")).alias("n"))
    lo, hi = (nearest_quantile(d, "n", q).withColumnRenamed("value", name) for q, name in ((0.2, "lo"), (0.8, "hi")))
    hit = F.col("text").rlike(r"\band\b").cast("double")
    j = d.crossJoin(F.broadcast(lo)).crossJoin(F.broadcast(hi))  # one row each
    return j.agg(F.round(F.avg(F.when(F.col("n") <= F.col("lo"), hit)), 6).alias("short_rate"), F.round(F.avg(F.when(F.col("n") >= F.col("hi"), hit)), 6).alias("long_rate"))


@query(f"""WITH {DOC} SELECT row_id, left(text, 6000) AS text, length(text) > 6000 AS was_cut FROM doc""")
def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, cut = tx.truncated(F.col("text"))
    return documents_log(spark, sf_dir).select("row_id", text.alias("text"), cut.alias("was_cut"))


@query(f"""WITH {DOC} SELECT category, sha256(string_agg(row_id || chr(9) || length(text) || chr(10), '' ORDER BY row_id)) AS sha256 FROM doc GROUP BY 1""")
def group_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents_log(spark, sf_dir)
    each = F.array_sort(F.collect_list(F.struct("row_id", F.char_length("text").alias("n"))))
    line = F.transform(each, lambda s: F.concat(s["row_id"].cast("string"), F.lit("\t"), s["n"].cast("string"), F.lit("\n")))
    return d.groupBy("category").agg(F.sha2(F.array_join(line, "").cast("binary"), 256).alias("sha256"))
