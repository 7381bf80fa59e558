"""The stream of gift buckets against the batch operator over the same rows."""

import random

from pyspark.sql import functions as F

from ravelin.operators import marketing as mk
from ravelin.streaming import gifts


def test_a_replay_gives_the_batch_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(160):
        category = rng.choice(["a", "b", "c", "d", "e", None])
        label = "gift" if category in ("a", "b") and rng.random() < 0.95 else rng.choice(["gift", "self", "self", "else"])
        rows.append((f"u{rng.randrange(9)}", 1_700_000_000 + i * 3600, f"r{rng.randrange(1000):04d}-{i}", category, label))
    schema = "user_id string, sec long, row_id string, subcat string, label string"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("sec"))
    parts = [rows[:50], rows[50:110], rows[110:]]
    parts[0], parts[1] = [*parts[0][:-4], *parts[1][:4]], [*parts[0][-4:], *parts[1][4:]]  # some arrive late, within a day
    for n, part in enumerate([*parts, [("zz", 1_800_000_000, "end", "a", "self")], [("zz", 1_800_000_001, "end2", "a", "self")]]):
        rng.shuffle(part)
        out = tmp_path / "in" / f"{n}"
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("sec")).coalesce(1).write.parquet(str(out))
    key, value = gifts.STORE
    spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = gifts.gift_buckets(stream, F.col("label") == "gift", F.col("label") == "self")
        q = found.writeStream.format("memory").queryName("gift_stream").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.unset(key)
    last = spark.table("gift_stream").filter("user_id <> 'zz'").groupBy("user_id").agg(F.max_by(F.struct("category", "bucket"), "applied").alias("s"))
    got = {(r["user_id"], r["s"]["category"], r["s"]["bucket"]) for r in last.collect() if r["s"]["category"] is not None}
    gift = F.col("label") == "gift"
    want = mk.gift_buckets(df, gift, F.col("label") == "self", mk.gift_only(df, gift))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 0
    assert spark.table("gift_stream").groupBy("user_id").agg(F.max("applied").alias("n")).filter("user_id <> 'zz'").agg(F.sum("n")).first()[0] == 160
