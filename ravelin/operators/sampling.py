"""Strata, allocations and seeded draws.

Draws order rows by md5 of seed, stratum and row id, so they are the same for
any partitioning and engine. Counts by stratum are few and come to the driver
only where a caller asks for a dict.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions.seeds import draw_key
from ravelin.sources.files import with_row_index
from ravelin.sources.store import cut


def allocate(counts: DataFrame, total: int, key: str = "stratum", n: str = "n") -> DataFrame:
    """counts with `alloc`: total dealt in proportion by largest remainder, ties by
    key, never above a stratum's count. Integer arithmetic throughout; the window
    without partition runs over one row for each stratum."""
    all_ = Window.partitionBy()
    sum_ = F.sum(n).over(all_)
    rows = counts.withColumn("__sum", sum_).withColumn("__want", F.least(F.lit(total).cast("long"), F.col("__sum")))
    rows = rows.withColumn("__floor", F.expr(f"{n} * __want div nullif(__sum, 0)")).withColumn("__rest", F.expr(f"{n} * __want % nullif(__sum, 0)"))
    rows = rows.withColumn("__left", F.col("__want") - F.sum("__floor").over(all_)).withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("__rest"), key)))
    return rows.select(*counts.columns, (F.coalesce("__floor", F.lit(0)) + F.when(F.col("__rank") <= F.col("__left"), 1).otherwise(0)).cast("long").alias("alloc"))


def share_allocation(shares: Mapping[str, float], total: int, caps: Mapping[str, int] | None = None) -> dict[str, int]:
    """total dealt by fixed shares, taken as they are: each key gets the whole part of
    its share under its cap, and what is left goes round, one each, by largest
    fraction and then key, to those below their caps. For some tens of keys."""
    most = {k: (caps or {}).get(k, max(total, 0)) for k in shares}
    exact = {k: max(total, 0) * v for k, v in shares.items()}
    out = {k: min(math.floor(x), most[k]) for k, x in exact.items()}
    left = min(max(total, 0), sum(most.values())) - sum(out.values())
    turns = sorted(shares, key=lambda k: (math.floor(exact[k]) - exact[k], repr(k)))
    while left > 0:
        able = [k for k in turns if out[k] < most[k]][:left]
        for k in able:
            out[k] += 1
        left -= len(able)
        if not able:
            break
    return out


#: Rows of a stratum that are ranked in one window; in larger ones a prefix of the
#: seeded key is searched that leaves no more in question.
FEW = 50_000
#: Hex digits by which a prefix grows: 4,096 slices of a stratum at a time.
DIGITS = 3
#: Strata (a row each) that are broadcast at most.
MAX_SENT = 100_000


def _cuts(keyed: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """(stratum, alloc, prefix, below) and the prefix's length. keyed: stratum, key;
    wanted: stratum, alloc. Of a stratum all rows whose key begins with less than the
    prefix (`below` of them) are drawn, none whose key begins with more, and of the
    others the first alloc - below. Slices are counted, a row for each slice and
    stratum; no row is sorted. Runs jobs."""
    w = wanted.select(F.col("stratum").alias("s"), "alloc")
    some = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).join(w, F.col("stratum").eqNullSafe(F.col("s")))
    state = cut(some.select("stratum", F.least("alloc", "n").cast("long").alias("alloc"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"), "n"))
    length = 0
    while length + DIGITS <= 32 and (facts := state.agg(F.max("n"), F.count(F.lit(1))).first())[0] is not None and facts[0] > FEW:
        length += DIGITS
        old = state.select(F.col("stratum").alias("s"), "alloc", "prefix", "below")
        inside = keyed.join(F.broadcast(old) if facts[1] <= MAX_SENT else old, F.col("stratum").eqNullSafe(F.col("s")) & F.col("key").startswith(F.col("prefix")))
        slices = inside.groupBy("stratum", "alloc", "below", F.substring("key", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
        slices = slices.withColumn("below", F.col("below") + F.coalesce(before, F.lit(0)))
        at = F.greatest(F.col("alloc"), F.lit(1))
        state = cut(slices.filter((F.col("below") < at) & (at <= F.col("below") + F.col("n"))).select("stratum", "alloc", "prefix", "below", "n"))
    return state.drop("n"), length


def _drawn(rows: DataFrame, wanted: DataFrame, seed: int, row_id: str) -> DataFrame:
    """rows (with stratum) and __drawn: whether a row is among the first alloc of its
    stratum in the seeded order. Strata that are not wanted are left out. Runs jobs."""
    key = draw_key(seed, F.col("stratum"), F.col(row_id))
    cuts, length = _cuts(rows.select("stratum", key.alias("key")), wanted)
    cuts = cuts.withColumnRenamed("stratum", "__s")
    n = cuts.count()
    joined = rows.withColumn("__key", key).join(F.broadcast(cuts) if n <= MAX_SENT else cuts, F.col("stratum").eqNullSafe(F.col("__s")))
    begin = F.substring("__key", 1, length)
    sure = joined.filter(begin != F.col("prefix")).withColumn("__drawn", begin < F.col("prefix"))
    turn = F.row_number().over(Window.partitionBy("stratum").orderBy("__key", row_id))
    close = joined.filter(begin == F.col("prefix")).withColumn("__drawn", turn <= F.col("alloc") - F.col("below"))
    both = sure.unionByName(close) if length else close
    return both.drop("__key", "__s", "alloc", "prefix", "below")


def draw(df: DataFrame, stratum: Column, allocation: DataFrame | Mapping[str, int] | int, seed: int, row_id: str = "row_id") -> DataFrame:
    """The first rows of each stratum in the seeded order: as many as the allocation
    (stratum, alloc), a mapping, or one number for all says. A null stratum is one like
    others. Rows of equal id tie. No stratum is sorted as a whole. Runs jobs."""
    rows = df.withColumn("stratum", stratum)
    if isinstance(allocation, int):
        allocation = rows.select("stratum").distinct().withColumn("alloc", F.lit(allocation).cast("long"))
    elif not isinstance(allocation, DataFrame):
        allocation = df.sparkSession.createDataFrame([(k, v) for k, v in allocation.items()] or [("", 0)], "stratum string, alloc long")
    return _drawn(rows, allocation, seed, row_id).filter("__drawn").drop("__drawn")


def stratified(df: DataFrame, stratum: Column, total: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """A sample of total rows in proportion to the strata."""
    counts = df.withColumn("stratum", stratum).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return draw(df, stratum, allocate(counts, total), seed, row_id)


def boost(pool: DataFrame, drawn: DataFrame, n: int, seed: int, row_id: str = "row_id") -> DataFrame:
    """Up to n rows of the pool that are not among those drawn. Runs jobs."""
    gone = cut(drawn.select(row_id))  # a sample: the pool is not dealt for it
    gone = F.broadcast(gone) if gone.count() <= MAX_SENT else gone
    return draw(pool.join(gone, row_id, "left_anti"), F.lit("boost"), n, seed, row_id)


def frames(df: DataFrame, stratum: Column, total: int, pools: Sequence[tuple[str, Column, int]], seed: int, row_id: str = "row_id") -> DataFrame:
    """The main sample and its boosts as one table with a column `frame`: disjoint,
    each boost drawn from its pool minus all drawn before."""
    out = stratified(df, stratum, total, seed, row_id).withColumn("frame", F.lit("main"))
    for i, (name, where, n) in enumerate(pools, 1):
        more = boost(df.filter(where), out, n, seed + i, row_id).withColumn("frame", F.lit(name))
        out = out.unionByName(more)
    return out


def trial_stratum(proxy: Column, speculative: Column, received: Column) -> Column:
    """Four strata that partition any rows by three flags."""
    return F.when(proxy, "proxy").when(received, "received").when(speculative, "speculative").otherwise("unflagged")


def shuffled(df: DataFrame, seed: int, row_id: str = "row_id") -> DataFrame:
    """df with sample_id, 1 and up in a seeded order: for samples, whose rows meet
    in one window."""
    return df.withColumn("sample_id", F.row_number().over(Window.orderBy(draw_key(seed, F.lit("shuffle"), F.col(row_id)), row_id)))


def worker_slice(df: DataFrame, worker: int, workers: int, order: str = "row_id") -> DataFrame:
    """Every workers-th row in the order, from the worker-th (0 and up): rows are
    numbered by range partition, so no task sees all."""
    return with_row_index(df, "__i", order=[order]).filter(F.col("__i") % workers == worker).drop("__i")


def holdout(df: DataFrame, stratum: Column, fraction: float, seed: int, row_id: str = "row_id") -> DataFrame:
    """df with `part`: in each stratum of two rows or more round(n * fraction) rows
    (halves to even) are holdout, others train. Runs jobs."""
    clash = "stratum" in df.columns
    rows = df.withColumn("__mine", stratum)
    rows = (rows.withColumnRenamed("stratum", "__stratum") if clash else rows).withColumnRenamed("__mine", "stratum")
    n = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select("stratum", F.when(F.col("n") < 2, 0).otherwise(F.rint(F.col("n") * F.lit(fraction))).cast("long").alias("alloc"))
    out = _drawn(rows, wanted, seed, row_id)
    out = out.drop("stratum").withColumn("part", F.when(F.col("__drawn"), "holdout").otherwise("train")).drop("__drawn")
    return out.withColumnRenamed("__stratum", "stratum") if clash else out


def two_level(df: DataFrame, role: Column, stratum: Column, roles: Mapping[str, float], strata: Mapping[str, float], total: int, seed: int, row_id: str = "row_id", excluded: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A sample dealt first over roles and then, inside each, over strata by fixed
    shares, capped by what there is: (rows with role, stratum and sample_id, rows
    that fell short by "role|stratum"). excluded: rows (row_id) never drawn. Runs a
    job for the counts of cells."""
    pool = df.join(excluded.select(row_id), row_id, "left_anti") if excluded is not None else df
    pool = pool.withColumn("role", role).withColumn("stratum_", stratum)
    have = {f"{r['role']}|{r['stratum_']}": r["count"] for r in pool.groupBy("role", "stratum_").count().collect()}
    want: dict[str, int] = {}
    short: dict[str, int] = {}
    for r, n in share_allocation(roles, total).items():
        plain = share_allocation(strata, n)
        dealt = share_allocation(strata, n, {s: have.get(f"{r}|{s}", 0) for s in strata})
        for s in strata:
            want[f"{r}|{s}"] = dealt[s]
            if plain[s] > dealt[s]:
                short[f"{r}|{s}"] = plain[s] - dealt[s]
    drawn = draw(pool, F.concat_ws("|", "role", "stratum_"), want, seed, row_id).drop("stratum").withColumnRenamed("stratum_", "stratum")
    return shuffled(drawn, seed, row_id), short


def text_drift(sample: DataFrame, corpus: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """One row: sampled rows, rows that the corpus lacks, rows whose text differs
    from the corpus's (null counts as a value)."""
    c = corpus.select(*key, F.col(text).alias("__theirs"), F.lit(True).alias("__there"))
    j = sample.join(c, list(key), "left")
    there = F.coalesce("__there", F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(~there).alias("missing"), F.count_if(there & ~F.col(text).eqNullSafe(F.col("__theirs"))).alias("drifted"))


def with_texts(sample: DataFrame, texts: DataFrame, titles: DataFrame, key: str = "row_id") -> DataFrame:
    """sample with the text of its rows (texts: key, text; a row without one raises
    nothing but is left out) and the title (titles: key, title), blank where there
    is none, and no_title."""
    rows = sample.join(texts.select(key, "text"), key)
    rows = rows.join(titles.select(key, F.col("title").alias("__title")), key, "left")
    title = F.coalesce(F.trim("__title"), F.lit(""))
    return rows.withColumn("title", title).withColumn("no_title", title == "").drop("__title")


def rebuilt(sample: DataFrame, corpus: DataFrame, extra: DataFrame, key: str = "row_id") -> DataFrame:
    """sample (key, text) joined anew with its corpus and with extra columns by key;
    raises if a row is missing or its text differs. Runs a job."""
    n, missing, drifted = text_drift(sample, corpus, [key]).first()
    if missing or drifted:
        raise ValueError(f"{missing} of {n} rows are missing, the text of {drifted} differs")
    return sample.drop("text").join(corpus, key).join(extra, key, "left")
