import zlib

from pyspark.sql import functions as F

from ravelin.llm import common


def test_cut_and_clean(spark):
    df = common.cut(spark.range(5))
    assert df.count() == 5 and "ravelin-" in df.inputFiles()[0]
    assert common.clean(spark) >= 1 and common.clean(spark) == 0


def test_held_out_and_fresh(spark):
    ids = spark.range(50).withColumn("h", common.held_out(F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in ids)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(common.held_out(F.col("id"))).first()[0] is False
    df = spark.createDataFrame([(1, 2)], "`__a` int, `__A_` int")
    a, b = common.fresh(df, "a", "a")
    assert a != b and not {a.lower(), b.lower()} & {c.lower() for c in df.columns}
    assert common.no_rows(df.limit(0)) and not common.no_rows(df)
