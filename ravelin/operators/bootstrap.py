"""Bootstraps whose rows and shuffles don't grow with the replicates.

A task keeps the sums of all replicates of its rows in one array and passes on a row
for each group; these rows are added in two steps. A row is never copied for a
replicate. Two draws: a Poisson(1) weight for each row and replicate, and resampling
inside strata, which keeps every stratum's number of rows in every replicate. Both come
from md5 of the seed and are the same for any partitioning and in any engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.seeds import draw_key
from ravelin.sources.files import with_row_index
from ravelin.sources.store import cut

#: P(X <= k) of a Poisson(1) count for k = 0 to 7.
POISSON = tuple(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8))
#: Rows whose weights a task holds at once, and groups whose sums it holds.
ROWS_AT_ONCE, GROUPS_AT_ONCE = 256, 1000
#: Rows of sums that are added in one group of the first step.
ADDED_AT_ONCE = 256
#: Rows of a stratum that are resampled together; a larger stratum is dealt into blocks
#: of as many by a seeded order, and draws stay inside a block.
BLOCK = 10_000


def _units(texts: Iterator[bytes], n: int) -> np.ndarray:
    """The first 32 bits of each text's md5 as numbers in [0, 1)."""
    return np.frombuffer(b"".join([md5(t).digest()[:4] for t in texts]), ">u4").reshape(n, -1) / 4294967296.0


def _poisson(keys: list[str | None], replicates: int, seed: int) -> np.ndarray:
    """Weights, a row for each key."""
    first = [f"{seed}|{r}".encode() for r in range(replicates)]
    rest = [b"" if k is None else b"|" + k.encode() for k in keys]
    return np.searchsorted(POISSON, _units((f + t for t in rest for f in first), len(keys)), side="right")


_SUMS = "g string, part long, sums array<double>"


def _batch(groups: list, parts: list, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(parts, pa.int64()), pa.array([s.ravel() for s in sums], pa.list_(pa.float64()))], names=["g", "part", "sums"])


def _numbers(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> np.ndarray:
    """Columns as doubles, null as 0, and a last column of ones."""
    columns = [batch.column(c).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).cast(pa.float64()).combine_chunks().fill_null(0.0).to_numpy(zero_copy_only=False) for c in names]
    return np.stack([*columns, np.ones(batch.num_rows)], axis=1)


def _weighed(names: Sequence[str], replicates: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[str | None, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                weights, numbers, groups = _poisson(b.column("k").to_pylist(), replicates, seed), _numbers(b, names), b.column("g").to_pylist()
                for g in set(groups):
                    mine = [i for i, x in enumerate(groups) if x == g]
                    more = weights[mine].T @ numbers[mine]
                    held[g] = held[g] + more if g in held else more
                if len(held) > GROUPS_AT_ONCE:
                    yield _batch(list(held), [part] * len(held), list(held.values()))
                    held = {}
        if held:
            yield _batch(list(held), [part] * len(held), list(held.values()))

    return run


def _resampled(names: Sequence[str], replicates: int, seed: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        stratum, block = (x.as_py() for x in key)
        n, numbers = rows.num_rows, _numbers(rows, names)
        sums = np.empty((replicates, numbers.shape[1]))
        for r in range(replicates):
            first = f"{seed}|{r}|{stratum}|{block}|"
            drawn = (_units((f"{first}{j}".encode() for j in range(n)), 1)[0] * n).astype(np.int64)
            sums[r] = np.bincount(drawn, minlength=n) @ numbers
        return pa.Table.from_batches([_batch([None], [hash_of(f"{stratum}|{block}")], [sums])])

    return run


def hash_of(text: str) -> int:
    """A number that deals texts evenly."""
    return int.from_bytes(md5(text.encode()).digest()[:4], "big")


def _added(partial: DataFrame, names: Sequence[str], replicates: int, by: str | None) -> DataFrame:
    """(by, rep, names ..., w): the rows of sums of each group, added up."""

    def add(rows: pa.Table) -> np.ndarray:
        total = np.zeros(replicates * (len(names) + 1))
        for chunk in rows.column("sums").chunks:
            for sums in chunk:
                total += sums.values.to_numpy()
        return total

    def some(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch([key[0].as_py()], [key[1].as_py()], [add(rows)])])

    def last(key: tuple, rows: pa.Table) -> pa.Table:
        total = add(rows).reshape(replicates, -1)
        return pa.table([pa.array([key[0].as_py()] * replicates, pa.string()), pa.array(range(replicates), pa.int32()), *[pa.array(total[:, i]) for i in range(total.shape[1])]], names=["g", "rep", *names, "w"])

    first = partial.groupBy("g", F.pmod("part", F.lit(ADDED_AT_ONCE)).alias("dealt")).applyInArrow(some, _SUMS)
    out = first.groupBy("g").applyInArrow(last, ", ".join(["g string, rep int", *[f"`{c}` double" for c in names], "w double"]))
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def replicate_sums(df: DataFrame, key: str, columns: Mapping[str, Column], replicates: int, seed: int, by: str | None = None) -> DataFrame:
    """(by, rep, columns ..., w): for each replicate the weighted sums of columns (null
    adds nothing) and the sum of weights. A row's weight is a Poisson(1) count of md5 of
    seed, replicate and key. by: a column of few values, as text. A group without rows
    in the table has none here."""
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = df.select(group.alias("g"), F.col(key).cast("string").alias("k"), *[c.cast("double").alias(name) for name, c in columns.items()])
    names = list(columns)
    return _added(rows.mapInArrow(_weighed(names, replicates, seed), _SUMS), names, replicates, by)


def stratified_sums(df: DataFrame, key: str, strata: Sequence[str], columns: Mapping[str, Column], replicates: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(rep, columns ..., w): sums over rows drawn with replacement inside strata, as
    many as each stratum has, so w is the number of rows in every replicate. A stratum's
    rows stand in the order of md5 of seed and key; the j-th of n draws takes the row
    floor(u n), u of md5 of seed, replicate, stratum, block and j. Runs jobs."""
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    rows = df.select(stratum.alias("stratum"), F.col(key).cast("string").alias("k"), *[c.cast("double").alias(name) for name, c in columns.items()])
    numbered = cut(with_row_index(rows, "at", ["stratum", draw_key(seed, F.lit("order"), F.col("k")), "k"]))
    first = numbered.groupBy("stratum").agg(F.min("at").alias("first"))
    place = F.col("at") - F.col("first")
    numbered = numbered.join(first, "stratum").withColumn("place", place).withColumn("block", F.expr(f"place div {block}"))
    names = list(columns)
    dealt = numbered.select("stratum", "block", "place", *names).groupBy("stratum", "block")
    return _added(dealt.applyInArrow(_resampled(names, replicates, seed), _SUMS), names, replicates, None)


def interval(replicates: DataFrame, value: Column, level: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """(by ..., lo, hi): the percentile interval of a value of replicate rows; null
    values don't count. A replicate is a row, so this is small."""
    tail = (1 - level) / 2
    rows = replicates.select(*by, value.alias("m"))
    ends = [F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi")]
    return rows.groupBy(*by).agg(*ends) if by else rows.agg(*ends)


def class_columns(ref: Column, pred: Column, classes: Sequence[str], weight: Column | None = None) -> dict[str, Column]:
    """What scores() needs the sums of: rows, or weight, by class in the reference, in
    the prediction and in both."""
    v = weight if weight is not None else F.lit(1.0)
    out = {}
    for i, c in enumerate(classes):
        r, p = ref == c, pred == c
        out |= {f"ref{i}": F.when(r, v).otherwise(0.0), f"pred{i}": F.when(p, v).otherwise(0.0), f"tp{i}": F.when(r & p, v).otherwise(0.0)}
    return out | {"all": v}


def scores(classes: Sequence[str]) -> dict[tuple[str, str], Callable[[], Column]]:
    """(class or "all", score) -> a column over sums of class_columns(): accuracy, macro
    F1 over the classes whose F1 is defined, and precision, recall and F1 by class."""
    zero = F.lit(0.0)

    def f1(i: int) -> Column:
        return 2 * F.col(f"tp{i}") / F.nullif(F.col(f"ref{i}") + F.col(f"pred{i}"), zero)

    n = range(len(classes))
    each = F.filter(F.array(*[f1(i) for i in n]), lambda x: x.isNotNull())
    out = {("all", "accuracy"): sum((F.col(f"tp{i}") for i in n), zero) / F.nullif(F.col("all"), zero), ("all", "macro_f1"): F.aggregate(each, zero, lambda a, x: a + x) / F.nullif(F.size(each).cast("double"), zero)}
    for i, c in enumerate(classes):
        out |= {(c, "precision"): F.col(f"tp{i}") / F.nullif(F.col(f"pred{i}"), zero), (c, "recall"): F.col(f"tp{i}") / F.nullif(F.col(f"ref{i}"), zero), (c, "f1"): f1(i)}
    return out


def stratified_scores(df: DataFrame, key: str, ref: str, pred: str, strata: Sequence[str], classes: Sequence[str], weight: str | None = None, replicates: int = 2000, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(label, score, value, lo, hi): the scores of predictions against references, with
    intervals from resampling inside strata. Weights belong to rows and stay valid
    because strata keep their sizes. Rows without reference or prediction don't count.
    Runs jobs."""
    rows = df.filter(F.col(ref).isNotNull() & F.col(pred).isNotNull())
    columns = class_columns(F.col(ref), F.col(pred), classes, F.col(weight) if weight else None)
    wanted = scores(classes)

    def long(sums: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(name).alias("score"), value.alias("m")) for (label, name), value in wanted.items()])
        return sums.select(F.explode(each).alias("s")).select("s.label", "s.score", "s.m")

    point = long(rows.agg(*[F.sum(c).alias(name) for name, c in columns.items()])).withColumnRenamed("m", "value")
    ends = interval(long(stratified_sums(rows, key, strata, columns, replicates, seed, block)), F.col("m"), by=["label", "score"])
    return point.join(ends, ["label", "score"])
