from pyspark.sql import functions as F

import __spark_entry__ as entry
from ravelin import streaming as st


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_streaming(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:00", 1.0), (2, "2024-01-01 00:10:00", 5.0), (2, "2024-01-09 00:00:00", 5.0), (3, "2024-03-01 00:00:00", 1.0)]
    src = spark.createDataFrame(rows, "user_id int, t string, value double").withColumn("ts", F.to_timestamp("t"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    assert _run(st.deduplicated(stream, ["user_id", "ts"]), "dedup").count() == 4
    rates = _run(st.windowed_rates(stream, F.col("value") > 2, "7 days"), "rates")
    assert rates.agg(F.sum("n")).first()[0] in (None, 4)
    assert "n" in _run(st.sessions(stream), "sess").columns


def test_entry_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert "interactions_funnel" in q and set(o) <= set(q)
