"""Filters, dedup, degrees, k-core, audited joins, ordered picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.sources.store import cut, mark, release


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One row for each key: the first in the order, or the last."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    by = [c.desc() for c in by] if last else by
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__rn = 1").drop("__rn")


def funnel(df: DataFrame, stages: Sequence[tuple[str, Column]], user: str = "user_id", item: str = "item") -> DataFrame:
    """Rows, users and items left after each of a chain of filters. Each row carries
    the number of filters that it passes in turn, and a user or item the most of its
    rows', so distinct ones are counted by grouping once, without expanding rows."""
    level = F.lit(len(stages))
    for i in range(len(stages) - 1, -1, -1):
        level = F.when(F.coalesce(stages[i][1], F.lit(False)), level).otherwise(F.lit(i))
    tagged = df.select(user, item, level.alias("__level"))

    def counts(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.array(*[F.count_if(F.col("__level") >= i) for i in range(1, len(stages) + 1)]).alias(name))

    def most(key: str) -> DataFrame:
        return tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("__level").alias("__level"))

    one = counts(tagged, "r").crossJoin(counts(most(user), "u")).crossJoin(counts(most(item), "i"))  # single rows
    names = F.array(*[F.lit(name) for name, _ in stages])
    each = one.select(F.explode(F.arrays_zip(names.alias("stage"), "r", "u", "i")).alias("s"))
    return each.select("s.stage", F.col("s.r").alias("n_rows"), F.col("s.u").alias("n_users"), F.col("s.i").alias("n_items"))


def density(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows for each key: mean, median, most, and the share of keys with k or more."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.avg("n").alias("mean_rows"),
        F.median("n").alias("median_rows"),
        F.max("n").alias("max_rows"),
        F.avg((F.col("n") >= k).cast("double")).alias("share_k"),
    )


#: Users or items (a row each) that are broadcast at most.
MAX_SENT = 500_000


def k_core(df: DataFrame, k: int, user: str = "user_id", item: str = "item", most: int = 50) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows whose users and items all keep k rows, and (pass, rows left) of
    every pass. Both degrees of a pass are counted on its own input; the pass
    that changes nothing counts, one that leaves no row is the last. Rows without a
    user or an item go in the first.

    All degrees are counted once. After that a pass reads the rows of the users and
    items that fell below k in the last one, and only what these rows touch is counted
    down; a degree is its first count less what the passes took. The rows are written
    once more whenever half of them are gone. Tables of the passes are removed at the
    end. Runs jobs."""
    spark, began = df.sparkSession, mark()
    rows = cut(df)
    none = F.col(user).isNull() | F.col(item).isNull()
    whole = rows.filter(~none)
    sides = (user, item)
    degree = {c: cut(rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))) for c in sides}
    taken: dict[str, list[DataFrame]] = {c: [] for c in sides}  # what passes took from a degree
    low = {c: cut(degree[c].filter(F.col("n") < k).select(c)) for c in sides}
    before = stored = left = rows.count()
    alive, dead = whole, {c: [] for c in sides}  # rows as last written, and who went since
    passes = []
    for number in range(1, most + 1):
        n_low = {c: low[c].count() for c in sides}
        gone = None
        if any(n_low.values()) or number == 1:
            hit = alive if number > 1 else rows
            for c in sides:
                for some, n in dead[c]:
                    hit = hit.join(_sent(some, n), c, "left_anti")
            for c in sides:
                hit = hit.join(_sent(low[c].withColumn(f"__low_{c}", F.lit(True)), n_low[c]), c, "left")
            gone = cut(hit.filter(F.coalesce(*[F.col(f"__low_{c}") for c in sides], none)).select(*sides))
            left -= gone.count()
        passes.append((number, left))
        if left == before or not left:
            break
        before = left
        for c in sides:
            dead[c].append((low[c], n_low[c]))
        for c in sides:
            fell = cut(gone.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).join(low[c], c, "left_anti"))
            taken[c].append(fell)
            touched, n = fell.select(c), fell.count()
            now = degree[c].join(_sent(touched, n), c, "left_semi")
            for past in taken[c]:
                now = now.unionAll(past.join(_sent(touched, n), c, "left_semi").select(c, (-F.col("n")).alias("n")))
            low[c] = cut(now.groupBy(c).agg(F.sum("n").alias("n")).filter((F.col("n") < k) & (F.col("n") > 0)).select(c))
        if left * 2 < stored:
            alive, dead, stored = cut(_without(alive, dead)), {c: [] for c in sides}, left
    rest = _without(alive, {c: [*dead[c], (low[c], low[c].count())] for c in sides}) if left else whole.limit(0)
    out = cut(rest.select(*[F.col(f"`{c}`") for c in df.columns]))
    release(spark, began, out)
    return out, passes


def _sent(some: DataFrame, n: int) -> DataFrame:
    return F.broadcast(some) if n <= MAX_SENT else some


def _without(rows: DataFrame, dead: dict[str, list[tuple[DataFrame, int]]]) -> DataFrame:
    """rows without those of the users and items that went."""
    for c, lists in dead.items():
        for some, n in lists:
            rows = rows.join(_sent(some, n), c, "left_anti")
    return rows


def _settled(df: DataFrame) -> DataFrame:
    """df, written and read back: what is planned twice is made once."""
    return cut(df)


def join_checked(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join that must keep the left side's row count: raises if the right key
    repeats or (inner) if a left row finds no partner. Runs jobs."""
    if right.groupBy(*on).count().filter("count > 1").limit(1).count():
        raise ValueError(f"join key repeats on the right: {', '.join(on)}")
    out = left.join(right, list(on), how)
    if how == "inner":
        missing = left.join(right.select(*on), list(on), "left_anti").count()
        if missing:
            raise ValueError(f"{missing} rows find no partner by {', '.join(on)}")
    return out


def join_audit(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows left, keys repeated on the right, rows with and without partner."""
    keys = right.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    j = left.join(keys, list(on), "left")
    repeated = keys.agg(F.count_if(F.col("__n") > 1).alias("repeated_keys"))
    return j.agg(F.count(F.lit(1)).alias("left_rows"), F.count_if(F.col("__n").isNotNull()).alias("matched"), F.count_if(F.col("__n").isNull()).alias("missed"), F.coalesce(F.sum("__n"), F.lit(0)).alias("joined_rows")).crossJoin(F.broadcast(repeated))


def top_n_within(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """The n most frequent values of each group, by count and then value, with
    their share of the rows shown."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), value)
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def first_by_key(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key that isn't null, in the order, and one row of facts:
    n_no_key, n_repeated (rows left out), n, null_rate_<column> of the given ones."""
    first = dedup(df.filter(F.col(key).isNotNull()), [key], order)
    kept = first.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate_{c}") for c in columns])
    every = df.agg(F.count_if(F.col(key).isNull()).alias("n_no_key"), F.count(key).alias("__with"))
    return first, every.crossJoin(kept).withColumn("n_repeated", F.col("__with") - F.col("n")).drop("__with")  # single rows


def union_relaxed(parts: Sequence[DataFrame], types: dict[str, str]) -> DataFrame:
    """All rows of tables whose columns differ in type: each is cast to the given one."""
    out = None
    for p in parts:
        p = p.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
        out = p if out is None else out.unionByName(p)
    return out


def same_keys(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether both hold the same set of keys. Runs jobs."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return not x.join(y, key, "left_anti").limit(1).count() and not y.join(x, key, "left_anti").limit(1).count()


def nearest_quantile(df: DataFrame, col: str, q: float, at_once: int = 200_000) -> DataFrame:
    """The value at rank round((n - 1) q) from 0, halves to even, of those not null.

    While more than at_once values are in question they are narrowed down between
    approximate quantiles about the rank, exactly counted; what is left is counted
    by value and ranked in one window. Runs jobs."""
    some = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("value"))
    n = some.count()
    rank = round((n - 1) * q) if n else 0
    while n > at_once:
        p = rank / (n - 1)
        lo, hi = some.agg(F.percentile_approx("value", [max(0.0, p - 3e-4), min(1.0, p + 3e-4)], 10_000).alias("v")).first()["v"]
        below, inside = some.agg(F.count_if(F.col("value") < lo), F.count_if(F.col("value").between(lo, hi))).first()
        if not below <= rank < below + inside or inside == n:
            break
        some, rank, n = some.filter(F.col("value").between(lo, hi)), rank - below, inside
    counts = some.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto)
    return ranked.filter((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)).select("value")


def value_deciles(df: DataFrame, col: str, parts: int = 10) -> DataFrame:
    """df with `decile` 1 to parts by value: breakpoints are linear quantiles, equal
    values share one, a value on a breakpoint belongs below it. Runs jobs."""
    from ravelin.operators.quantiles import quantiles

    cuts = quantiles(df, col, [i / parts for i in range(1, parts)]).filter("value IS NOT NULL").collect()  # a row for a breakpoint
    decile = F.lit(1)
    for c in sorted(r["value"] for r in cuts):
        decile = decile + (F.col(col) > c).cast("int")
    return df.withColumn("decile", decile)
