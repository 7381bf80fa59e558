"""Tables written on the way, and the row numbers that rest on them."""

import pytest
from pyspark.sql import functions as F

from ravelin import sources


@pytest.fixture
def split_small(spark):
    """Adaptive execution that cuts the same exchange differently from plan to plan."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def wide(spark, n):
    return spark.range(n, numPartitions=7).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"), F.col("id").alias("name.d"))


def test_every_row_gets_its_own_number(spark, split_small):
    n = 300_000
    got = sources.with_row_index(wide(spark, n), order=["k"])
    assert got.columns == ["k", "pad", "name.d", "row_id"]
    facts = got.agg(F.count(F.lit(1)), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()
    assert tuple(facts) == (n, n, 0, n - 1)
    turns = got.select("k", "row_id").toPandas().sort_values("k")["row_id"].tolist()
    assert turns == list(range(n))


def test_numbers_do_not_depend_on_partitions(spark):
    rows = wide(spark, 5000)
    a = sources.with_row_index(rows, order=["k"]).select("k", "row_id")
    b = sources.with_row_index(rows.repartition(13, "pad"), "row_id", order=[F.col("k")]).select("k", "row_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    down = sources.with_row_index(rows, order=[F.col("k").desc()]).agg(F.min_by("row_id", "k")).first()[0]
    assert down == 4999


def test_unordered_ties_and_empty(spark):
    got = sources.with_row_index(spark.range(1000, numPartitions=5), "i").collect()
    assert sorted(r["i"] for r in got) == list(range(1000))
    same = sources.with_row_index(spark.range(100).select((F.col("id") % 2).alias("k")), order=["k"]).collect()
    assert sorted(r["row_id"] for r in same) == list(range(100)) and all((r["row_id"] < 50) == (r["k"] == 0) for r in same)
    assert sources.with_row_index(spark.range(0), order=["id"]).count() == 0


def test_tables_are_removed(spark):
    df = sources.cut(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and sources.clean(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
