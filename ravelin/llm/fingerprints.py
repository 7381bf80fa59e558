"""Document fingerprints by winnowing, in DataFrame functions alone.

Words of the lower-cased text give k-grams; each k-gram's hash is the upper 34
bits of xxhash64 over its words, and below them stands the complement of its
place, so the least number of a window is the least hash and, of equal ones, the
rightmost. Window minima come by doubling (windows of 1, 2, 4, 8, 16), each kept
once: the fingerprint, hashes with places. Any passage of `WINDOW + K - 1` words
that two texts share gives both a common hash.

The next document in doc_id order is brought alongside with one shuffle of the
texts: ids are dealt by quantiles into as many buckets as a small multiple of
the shuffle partitions, the first document of each bucket also goes to the one
before, and within a bucket a window takes the next row. The driver sees the
quantiles and one id for each bucket.

Defined cases: null text is empty; texts without words have an empty fingerprint,
equal to each other and to nothing else; fewer than K words make one gram; a
null doc_id comes before all others; rows that share a doc_id are in the order of
a hash of their text; one document is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
WINDOW = 16
_PLACE = (1 << 30) - 1  # a string of at most 2 GB holds fewer words


def _words(text: Column) -> Column:
    plain = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "[\\x20\\x09-\\x0D]+"))


def _key(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.lit(_PLACE) - place.cast("long"))


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    every = F.transform(F.sequence(F.lit(0), n - k), lambda i: _key(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))
    one = F.array(_key(F.xxhash64(words), F.lit(0)))
    return F.when(n >= k, every).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, span: int, step: int) -> Column:
    """Minima of windows of span + step from those of span."""
    return F.zip_with(grams, F.slice(grams, F.lit(step + 1), F.greatest(F.size(grams), F.lit(1))), lambda x, y: F.least(x, y))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """df with the column out: the winnowed keys of the text column, in order of
    place. A step for each doubling keeps every array computed once."""
    a, b = f"{out}__w", f"{out}__m"
    df = df.withColumn(a, _words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    df = df.withColumn(a, _grams(F.col(a), k)).withColumn(b, F.col(a))
    span = 1
    while span < window:
        step = min(span, window - span)
        df = df.withColumn(b, _minima(F.col(b), span, step))
        span += step
    whole = F.slice(F.col(b), F.lit(1), F.greatest(F.size(a) - (window - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(whole)).drop(a, b)


def hashes(keys: Column) -> Column:
    """The different hashes of a fingerprint, without places."""
    return F.array_distinct(F.transform(keys, lambda x: F.shiftright(x, 30)))


def places(keys: Column) -> Column:
    """The places (numbers of the first word) of a fingerprint's grams."""
    return F.transform(keys, lambda x: (F.lit(_PLACE) - x.bitwiseAND(F.lit(_PLACE))).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))


def as_text(keys: Column) -> Column:
    """Keys as hexadecimal digits, 16 each."""
    return F.array_join(F.transform(keys, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _with_bucket(rows: DataFrame, cuts: list[int], value: str, out: str) -> DataFrame:
    """rows with how many of the ascending cuts lie below the value; looks through
    about two square roots of their number. The cuts come as one broadcast row, so the
    plan is as long for ten buckets as for ten thousand."""
    m = max(1, int(len(cuts) ** 0.5))
    fine = [cuts[i : i + m] for i in range(0, len(cuts) + 1, m)]
    one = rows.sparkSession.createDataFrame([(cuts[m - 1 :: m], fine)], "cut_coarse array<bigint>, cut_fine array<array<bigint>>")
    wide = rows.crossJoin(F.broadcast(one))  # a single row

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c < F.col(value)))

    wide = wide.withColumn("cut_at", below(F.col("cut_coarse")))
    return wide.withColumn(out, F.col("cut_at") * m + F.coalesce(below(F.get("cut_fine", F.col("cut_at"))), F.lit(0))).drop("cut_coarse", "cut_fine", "cut_at")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id and others) with `next`, a struct of the carried columns of the
    next row in doc_id order (of the first row for the last). Runs two jobs over
    doc_id; the driver gets numbers bounded by the count of buckets."""
    spark = rows.sparkSession
    buckets = 4 * max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    ids = rows.select(at.alias("at"))
    cuts = sorted(set(ids.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)], 10 * max(1000, buckets)).alias("q")).first()["q"] or []))
    first = sorted((r["b"], r["at"]) for r in _with_bucket(ids, cuts, "at", "b").groupBy("b").agg(F.min("at").alias("at")).collect())
    before = [(i, first[n - 1][0], int(n == 0)) for n, (_, i) in enumerate(first)]  # the very first follows the last
    also = spark.createDataFrame(before or [(0, 0, 0)], "first long, other int, wraps int").limit(len(before))
    dealt = _with_bucket(rows.withColumn("at", at), cuts, "at", "b").join(F.broadcast(also), F.col("at") == F.col("first"), "left")
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("copy"))
    copies = F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("other").alias("b"), (F.lit(1) + F.col("wraps")).alias("copy"))))
    dealt = dealt.withColumn("to", F.explode(copies)).drop("b", "first", "wraps", "other")
    w = Window.partitionBy("to.b").orderBy("to.copy", "at", F.xxhash64("text"))
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(w)).filter("to.copy = 0").drop("to", "at")


def fingerprints_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row of docs. Runs jobs over doc_id."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "own"), ["text", "own"])
    n = F.char_length("text")
    quarter = F.floor(n / F.lit(4)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next.text", F.lit("")), F.lit(1), quarter))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", hashes(F.col("own")).alias("own_set"), hashes(F.col("next.own")).alias("next_set"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "new").withColumn("new_set", hashes(F.col("new")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("new_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_set")).alias("near_next"),
    )
