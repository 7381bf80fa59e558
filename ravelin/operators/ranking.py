"""Full rankings by factors and by item-to-item similarity.

Ranked lists hold, for each user, the k best items that are not masked, by score and
then item. Users meet items in blocks of matrices, never as joined rows: a block of
items goes out by broadcast (its size is fixed), a task multiplies its users with it and
passes on k rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.sources.files import with_row_index
from ravelin.sources.store import cut

#: Items whose factors are broadcast at once, and scores that a task holds at once.
ITEMS_AT_ONCE, SCORES_AT_ONCE = 50_000, 4_000_000
#: Items of a user from which its pairs are counted in blocks and not emitted.
HEAVY = 200
#: Items on a side of a block of counts, and groups that deal a block's users.
BLOCK, SALTS = 512, 32
#: Rows of a side that is broadcast at most.
MAX_SENT = 100_000
#: Pairs of users and items in a task that scores them, about: each meets many neighbours.
PAIRS_AT_ONCE = 250_000


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest finite scores, ties to the smaller place."""
    n = min(k, len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n] if n else np.inf
    some = np.flatnonzero((scores >= least) & np.isfinite(scores))
    return some[np.lexsort((some, -scores[some]))][:k]


def _ranked(sent, first: int, k: int, digits: int, user: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = sent.value
        step = max(1, SCORES_AT_ONCE // max(1, len(matrix)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                vectors = np.array(b.column("vector").to_pylist(), float)
                scores = np.round(vectors @ matrix.T, digits)
                who, places, values = [], [], []
                for i, masked in enumerate(b.column("masked")):
                    if masked.is_valid:
                        hidden = masked.values.to_numpy() - first
                        scores[i, hidden[(hidden >= 0) & (hidden < len(matrix))]] = -np.inf
                    best = _best(scores[i], k)
                    who += [i] * len(best)
                    places.append(best)
                    values.append(scores[i, best])
                columns = [b.column(user).take(pa.array(who, pa.int64())), pa.array(np.concatenate(places) + first), pa.array(np.concatenate(values))]
                yield pa.RecordBatch.from_arrays(columns, names=[user, "at", "score"])

    return run


def factor_topk(users: DataFrame, items: DataFrame, k: int, masked: DataFrame | None = None, user: str = "user_id", digits: int = 9) -> DataFrame:
    """(user, item, rank, score): the k items of highest inner product for each user.

    users: user, vector; items: item, vector (ids unique, vectors of one length; rows
    without a vector are left out); masked: (user, item) pairs that are never ranked,
    such as what a user has or what an experiment removed. Scores are rounded to
    `digits`, ties go to the smaller item. A user's mask is at most as long as the
    catalogue. Runs jobs: items are numbered, and each ITEMS_AT_ONCE of them are a pass
    over the users."""
    catalogue = cut(with_row_index(items.filter(F.col("vector").isNotNull()).select("item", F.col("vector").cast("array<double>").alias("vector")), "at", ["item"]))
    rows = users.filter(F.col("vector").isNotNull()).select(user, F.col("vector").cast("array<double>").alias("vector"))
    if masked is None:
        rows = rows.withColumn("masked", F.lit(None).cast("array<bigint>"))
    else:
        hidden = masked.select(user, "item").join(catalogue.select("item", "at"), "item").groupBy(user).agg(F.collect_set("at").alias("masked"))
        rows = rows.join(hidden, user, "left")
    n = catalogue.count()
    kind = f"`{user}` {dict(users.dtypes)[user]}, at long, score double"
    if not n:
        return users.sparkSession.createDataFrame([], f"`{user}` {dict(users.dtypes)[user]}, item {dict(items.dtypes)['item']}, rank int, score double")
    rows = cut(rows)

    def block(first: int) -> DataFrame:
        some = catalogue.filter(F.col("at").between(first, first + ITEMS_AT_ONCE - 1)).toArrow().sort_by("at")
        matrix = np.array(some.column("vector").to_pylist(), float)
        return rows.mapInArrow(_ranked(users.sparkSession.sparkContext.broadcast(matrix), first, k, digits, user), kind)

    best = reduce(DataFrame.unionAll, [block(first) for first in range(0, n, ITEMS_AT_ONCE)])
    turn = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("score"), "at"))  # k rows for each block
    top = best.withColumn("rank", turn).filter(F.col("rank") <= k)
    names = catalogue.select("at", "item")
    return top.join(F.broadcast(names) if n <= MAX_SENT else names, "at").select(user, "item", "rank", "score")


def _counted(block: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Counts of a block of pairs: users' items of one side with those of the other."""
        left, right = (x.as_py() * block for x in key[:2])
        counts = np.zeros((block, block), np.int64)
        for x, y in zip(rows.column("x"), rows.column("y"), strict=True):
            counts[np.ix_(x.values.to_numpy() - left, y.values.to_numpy() - right)] += 1
        a, b = np.nonzero(counts)
        return pa.table({"a": pa.array(a + left), "b": pa.array(b + right), "c": pa.array(counts[a, b])})

    return run


def common_users(pairs: DataFrame, user: str = "user_id") -> DataFrame:
    """(a, b, c): in how many users' rows items a and b (numbers, a <> b, either order)
    stand together. pairs: different (user, at).

    A user of HEAVY items or fewer emits its pairs, which are added up before they are
    shuffled. A heavier one sends its items by blocks of BLOCK numbers; a pair of blocks
    is a small matrix of counts that users, dealt into SALTS groups, are added to, so
    what it emits grows with the items and not with their square times users. The
    group of a pair of blocks holds the heavy users alone, of whom there are at most
    rows / HEAVY."""
    held = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("held"))
    heavy = cut(held.filter(F.col("held") > HEAVY).select(user))
    light = pairs
    n_heavy = heavy.count()
    if n_heavy:
        light = pairs.join(F.broadcast(heavy) if n_heavy <= MAX_SENT else heavy, user, "left_anti")
    x, y = light.withColumnRenamed("at", "a"), light.withColumnRenamed("at", "b")
    out = x.join(y, user).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    if not n_heavy:
        return out
    rows = pairs.join(F.broadcast(heavy) if n_heavy <= MAX_SENT else heavy, user, "left_semi")
    blocks = rows.groupBy(user, F.expr(f"`at` div {BLOCK}").alias("block")).agg(F.collect_list("at").alias("x"))
    each = blocks.select(user, F.col("block").alias("i"), "x").join(blocks.select(user, F.col("block").alias("j"), F.col("x").alias("y")), user)
    dealt = each.withColumn("salt", F.pmod(F.xxhash64(user), F.lit(SALTS)))
    counted = dealt.select("i", "j", "salt", "x", "y").groupBy("i", "j", "salt").applyInArrow(_counted(BLOCK), "a long, b long, c long")
    return out.unionAll(counted.filter("a <> b")).groupBy("a", "b").agg(F.sum("c").alias("c"))


def cooccurrence_topk(split: DataFrame, k: int, most_per_user: int | None = None, neighbours: int | None = None, user: str = "user_id") -> DataFrame:
    """(user, item, rank, score) by item-to-item co-occurrence in train: score is
    the sum over a user's items of common users / sqrt(product of users), seen items
    left out. A user brings all items, or at most most_per_user newest ones;
    neighbours: how many of an item's most similar ones count (ties to the smaller
    item), all if None. Runs jobs."""
    train = split.filter("split = 'train'")
    if most_per_user is not None:
        newest = Window.partitionBy(user).orderBy(F.desc("ts"), F.desc("row_id"))
        train = train.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= most_per_user)
    ui = train.select(user, "item").distinct()
    items = cut(with_row_index(ui.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "at", ["item"]))
    few = items.count() <= MAX_SENT

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    pairs = cut(ui.join(sent(items.select("item", "at")), "item").select(user, "at"))
    # Pairs take few bytes, so the engine would put very many in a task: a number is given.
    tasks = max(int(split.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // PAIRS_AT_ONCE))
    pairs = pairs.repartition(tasks, user)
    co = common_users(pairs, user)
    for side in "ab":
        co = co.join(sent(items.select(F.col("at").alias(side), F.col("n").alias(f"n{side}"))), side)
    sim = co.select("a", "b", (F.col("c") / F.sqrt(F.col("na") * F.col("nb"))).alias("sim"))
    if neighbours is not None:
        turn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
        sim = sim.withColumn("__r", turn).filter(F.col("__r") <= neighbours).drop("__r")
    if few and neighbours is not None and items.count() * neighbours <= MAX_SENT:
        sim = F.broadcast(sim)  # users stay where they are
    score = pairs.withColumnRenamed("at", "a").join(sim, "a").groupBy(user, "b").agg(F.sum("sim").alias("score"))
    seen = split.filter("split <> 'test'").select(user, "item").distinct()
    score = score.join(sent(items.select(F.col("at").alias("b"), "item")), "b").join(seen, [user, "item"], "left_anti")
    w = Window.partitionBy(user).orderBy(F.desc(F.round("score", 9)), "item")
    return score.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(user, "item", "rank", "score")


def als_topk(split: DataFrame, k: int, seed: int = 42, user: str = "user_id", **params) -> DataFrame:
    """(user, item, rank) by implicit-feedback ALS, seen items left out. Users and
    items are numbered in their order, without a list of ids on the driver; their
    factors are ranked by factor_topk(). Runs jobs."""
    from pyspark.ml.recommendation import ALS

    train = split.filter("split = 'train'")
    users, items = (cut(with_row_index(train.select(F.col(c).alias(name)).distinct(), "at", [name])) for c, name in ((user, "u"), ("item", "i")))
    rows = train.select(F.col(user).alias("u"), F.col("item").alias("i")).groupBy("u", "i").agg(F.count(F.lit(1)).cast("float").alias("r"))
    numbered = rows.join(users.withColumnRenamed("at", "un"), "u").join(items.withColumnRenamed("at", "in"), "i")
    data = cut(numbered.select(F.col("un").cast("int").alias("un"), F.col("in").cast("int").alias("in"), "r"))
    model = ALS(userCol="un", itemCol="in", ratingCol="r", implicitPrefs=True, seed=seed, **({"rank": 16, "maxIter": 5} | params)).fit(data)
    asked = split.filter("split = 'test'").select(F.col(user).alias("u")).distinct()
    of_users = model.userFactors.join(users, F.col("id") == F.col("at")).join(asked, "u").select(F.col("u").alias(user), F.col("features").alias("vector"))
    of_items = model.itemFactors.join(items, F.col("id") == F.col("at")).select(F.col("i").alias("item"), F.col("features").alias("vector"))
    seen = split.filter("split <> 'test'").select(user, "item").distinct()
    return factor_topk(of_users, of_items, k, seen, user).select(user, "item", "rank")
