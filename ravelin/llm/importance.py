"""Importance resampling towards a target by hashed word n-grams.

A text's words stand in a position table: posexplode() gives (row, place, word) and
lead() over a row's places puts the following words beside each, so an n-gram of
every order is a concatenation within one row of that table. Each n-gram is hashed
into one of `buckets` buckets, and the table of hashes is written once. Counting it
by bucket, for the documents and for the target texts, gives a bucket's gain: the
logarithm of how much likelier the target is to hold it. The gains (one row for a
bucket at most, so a bounded table) are joined to the hashes and summed by row. A
document's weight is the mean gain of its n-grams; a seeded Gumbel number is added
and the highest sums are drawn, which is sampling without replacement in proportion
to the exponential of the weights.

Rows are dealt by a number of their own, not by doc_id, so repeated ids or a hot one
meet in no task; a row's words travel with it, and its places are in one task's
window, which spills. The draw needs a rank over all documents: they are range
partitioned by score and numbered there (with_row_index).

Defined cases: a null or empty text, or one without words, has no n-grams, weight 0
and no rank; a text of one word has no pair; a null doc_id hashes as empty text;
repeated rows and ids count and are ranked each, in some order among full ties; other
columns are not read, whatever their names; an empty table gives an empty result; an
empty target gives every bucket its gain from 0 counts. A text of any length is read
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import cut
from ravelin.sources.files import with_row_index

#: What stands between words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
#: N-grams of 1 to ORDERS words.
ORDERS = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20


def ascii_lower(word: Column) -> Column:
    """word with A to Z in lower case and every other character as it is."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def hashed_ngrams(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, b1, ..., b<orders>): for each place of a text's words the buckets
    of the n-grams that start there, null where the text ends before. A text without
    words has one row of nulls."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartition("row")
    # Only the first and the last piece of a text can be empty.
    places = rows.select("row", "doc_id", F.posexplode(F.split("text", BETWEEN)).alias("place", "word"))
    places = places.withColumn("word", F.nullif(ascii_lower(F.col("word")), F.lit("")))
    after = Window.partitionBy("row").orderBy("place")
    follow = [F.col("word"), *[F.lead("word", i).over(after) for i in range(1, orders)]]
    table = places.select("row", "doc_id", *[c.alias(f"w{i}") for i, c in enumerate(follow, 1)])
    out, gram = [], F.col("w1")
    for i in range(1, orders + 1):
        if i > 1:
            gram = F.concat(gram, F.lit(" "), F.col(f"w{i}"))  # null where a word is missing
        out.append((F.crc32(gram.cast("binary")) % buckets).cast("int").alias(f"b{i}"))
    return table.select("row", "doc_id", *out)


def bucket_counts(hashed: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) of a table of hashed n-grams."""
    every = hashed.select(F.explode(F.array(*[f"b{i}" for i in range(1, orders + 1)])).alias("bucket"))
    return every.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that source holds, from the counts of both:
    floor(1000 ln(target's smoothed share / source's)). At most `buckets` rows."""
    total = [df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)) for df, name in ((source, "in_source"), (target, "in_target"))]
    both = source.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").crossJoin(F.broadcast(total[0])).crossJoin(F.broadcast(total[1]))  # single rows
    t, s, all_s, all_t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("t", "n", "in_source", "in_target"))
    ratio = (t + 1) * (all_s + float(buckets)) / ((s + 1) * (all_t + float(buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def floor_div(a: Column, b: Column) -> Column:
    """The whole part of a / b towards minus infinity, in whole numbers; b is positive."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def weights(hashed: DataFrame, gain: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row."""
    joined = hashed
    for i in range(1, orders + 1):
        joined = joined.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{i}"), F.col("gain").alias(f"g{i}"))), f"b{i}", "left")
    names = range(1, orders + 1)
    n = sum((F.col(f"b{i}").isNotNull().cast("int") for i in names), F.lit(0))
    g = sum((F.coalesce(f"g{i}", F.lit(0)) for i in names), F.lit(0))
    sums = joined.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(g).alias("total"))
    return sums.select("row", "doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, floor_div(F.col("total"), F.greatest(F.col("n_features"), F.lit(1)))).otherwise(0).cast("long").alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel number) that seed and doc_id decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text):
    rank is 1 and up for the floor(percent N / 100) highest scores among the N rows of
    min_words words or more, ties to the smaller doc_id, and null for the others.
    target: text. Runs jobs."""
    hashed = cut(hashed_ngrams(docs, orders, buckets))
    wanted = hashed_ngrams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders, buckets)
    gain = cut(gains(bucket_counts(hashed, orders), bucket_counts(wanted, orders), buckets))
    scored = cut(weights(hashed, gain, orders).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = with_row_index(scored.filter(able), "at", order).withColumn("rank", F.when(F.col("at") < drawn, F.col("at") + 1).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionAll(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def resample_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the benchmark's texts
    are the target. Runs jobs."""
    return resample(docs, benchmark)


#: crc32 of each different n-gram, byte by byte over the table of its polynomial.
ORACLE = r"""
WITH RECURSIVE entry AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS step FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, step + 1 FROM entry WHERE step < 8
), crc AS (
  SELECT list(v ORDER BY i) AS t FROM entry WHERE step = 8
), d AS (
  SELECT 'd' AS side, row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT side, k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
), g AS (
  SELECT side, k, unnest(list_concat(words, list_transform(range(1, len(words)::BIGINT), lambda i: words[i] || ' ' || words[i + 1]))) AS gram FROM w
), c AS (
  SELECT gram, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(0, octet_length(encode(gram))::BIGINT), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT gram FROM g), crc
), f AS (
  SELECT side, k, bucket FROM g JOIN c USING (gram)
), n AS (
  SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM f GROUP BY 1
), tot AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM n
), gain AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM n, tot
), m AS (
  SELECT k, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1
), sc AS (
  SELECT w.k, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN m USING (k) WHERE side = 'd'
), r AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE n_words >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (k)
"""
