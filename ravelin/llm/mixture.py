"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a cap (`max_epochs` times its size). The level
`lam` at which the sum over sources of min(lam * weight, cap) meets the budget
is found in closed form: in order of cap / weight, a source is clamped while the
level that is left for the rest lies above its ratio. A source then takes
floor(target / size) whole repetitions of each document and one more of seeded
documents until the fractional part is met. The seeded order is md5 of seed and
doc_id; running sizes are kept per (source, slice of the hash) and the slices'
offsets are added, so a source that holds a third of all rows is spread over
`SLICES` groups.

Defined cases: null text has size 0; null source is a source of its own, last in
order; sources of size 0 have target 0; repeated rows count each; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.common import WORD, cut, fresh

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 42
#: Hex digits of the hash that make a slice: 16 ** 3 slices of a source.
SLICE_DIGITS = 3
#: Sources (a row each) that are broadcast at most.
MAX_SENT = 100_000


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for a source.

    The windows without partition run over one row for each source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    src = src.withColumn("weight", w).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    src = src.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    src = src.select(
        "*",
        F.row_number().over(order).alias("at"),
        ((F.lit(float(budget)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    level = F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(every)
    src = src.withColumn("lam", F.when(F.max(F.col("level") <= F.col("ratio")).over(every), level))
    return src.select("source", "source_size", F.when(F.col("lam").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("lam") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, size_col: str | None = None, weights: tuple = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs with the columns named by mix_columns(docs) added: size, source_size,
    target and copies (whole repetitions that the mix takes of this row)."""
    size, ssize, target, copies = mix_columns(docs)
    key, part, off, run, src = fresh(docs, "key", "part", "off", "run", "src")
    rows = docs.withColumn(size, words(F.col("text")) if size_col is None else F.col(size_col)).withColumn(key, _order_key(seed))
    rows = rows.withColumn(part, F.substring(key, 1, SLICE_DIGITS))
    thin = rows.select(F.col("source"), F.col(size).alias("size"), F.col(part).alias("part"))
    slices = thin.groupBy("source", "part").agg(F.sum("size").alias("size"))
    want = targets(slices, weights, budget, max_epochs)
    offs = slices.join(want, slices["source"].eqNullSafe(want["source"])).select(
        slices["source"].alias(src),
        F.col("part").alias(f"{part}2"),
        F.col("source_size").alias(ssize),
        F.col("target").alias(target),
        F.coalesce(F.sum("size").over(Window.partitionBy(slices["source"]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(off),
    )
    inside = Window.partitionBy("source", part).orderBy(key, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn(run, F.sum(size).over(inside))
    rows = rows.join(offs, rows["source"].eqNullSafe(offs[src]) & (rows[part] == offs[f"{part}2"]), "left")
    whole = F.floor(F.col(target) / F.nullif(F.col(ssize), F.lit(0)))
    rest = F.col(target) - whole * F.col(ssize)
    extra = (F.col(off) + F.col(run) - F.col(size) / 2.0 <= rest) & (rest > 0)
    rows = rows.withColumn(copies, F.coalesce(whole + F.when(extra, 1).otherwise(0), F.lit(0)).cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], size, ssize, target, copies)


def mix_columns(docs: DataFrame) -> list[str]:
    """What mix() calls its columns size, source_size, target and copies."""
    return fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken. Runs jobs.

    The extra documents of a source are the first in the seeded order, so thin rows
    (no texts) tell the last one's place, and the texts are filtered by it where
    they are read. Only where rows with one and the same place are taken in part
    (repeated ids of equal size) the rows themselves are ordered."""
    size, ssize, target, copies = mix_columns(docs)
    seed = how.get("seed", SEED)
    thin = cut(docs.select("doc_id", "source", words(F.col("text")).alias("n_words")))
    names = mix_columns(thin)
    each = mix(thin, size_col="n_words", **how).withColumn("key", _order_key(seed)).withColumn("whole", F.floor(F.col(names[2]) / F.nullif(F.col(names[1]), F.lit(0))))
    each = each.withColumn("extra", F.col(names[3]) > F.coalesce("whole", F.lit(0)))
    cuts = each.groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("extra"), F.struct("key", "n_words"))).alias("last"))
    cuts = cut(cuts.select("source", F.coalesce("whole", F.lit(0)).alias("whole"), F.col("last.key").alias("last_key"), F.col("last.n_words").alias("last_size")))
    split = each.filter("NOT extra").join(F.broadcast(cuts), each["source"].eqNullSafe(cuts["source"]) & (F.col("key") == F.col("last_key")) & (F.col("n_words") == F.col("last_size")), "left_semi")
    if cuts.count() > MAX_SENT or split.limit(1).count():
        rows = mix(docs, **how).filter(F.col(copies) > 0)
    else:
        src, whole, key, last = fresh(docs, "src", "whole", "last_key", "last_size")
        cuts = cuts.select(F.col("source").alias(src), F.col("whole").alias(whole), F.col("last_key").alias(key), F.col("last_size").alias(last))
        rows = docs.join(F.broadcast(cuts), docs["source"].eqNullSafe(cuts[src]))
        mine = _order_key(seed)
        extra = (mine < F.col(key)) | ((mine == F.col(key)) & F.when(mine == F.col(key), words(F.col("text")) <= F.col(last)))
        rows = rows.withColumn(copies, F.col(whole) + F.coalesce(extra, F.lit(False)).cast("int")).filter(F.col(copies) > 0)
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def _order_key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mixture_query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row. Runs a job: sizes
    are counted once and written to the shared folder."""
    thin = cut(docs.select("doc_id", "source", words(F.col("text")).alias("n_words")))
    size, ssize, target, copies = mix_columns(thin)
    return mix(thin, size_col="n_words").select("doc_id", F.col(size).alias("size"), F.col(ssize).alias("source_size"), F.col(target).alias("target"), (F.col(size) * F.col(copies)).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS at_,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
       - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER ()
       - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM r
), m AS (
  SELECT arg_min(level, at_) AS lam FROM l WHERE level <= ratio
), t AS (
  SELECT source, source_size, CASE WHEN lam IS NULL THEN cap ELSE least(cap, lam * weight) END AS target FROM l LEFT JOIN m ON true
), c AS (
  SELECT d.*, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
         floor(t.target / nullif(t.source_size, 0)) AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * coalesce(whole + CASE WHEN run - size / 2.0::DOUBLE <= target - whole * source_size AND target - whole * source_size > 0 THEN 1 ELSE 0 END, 0))::BIGINT AS taken
FROM c
"""
