"""The driver's tables as interaction logs: user, item, time, label, row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.labels import EVENT_LABELS, LINE_LABELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(col, labels: dict[str, str], other: str):
    out = F.lit(other)
    for key, label in labels.items():
        out = F.when(col == key, F.lit(label)).otherwise(out)
    return out


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: user_id, item, ts, row_id, label, event_type, value."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.get_json_object("props", "$.k").alias("item"), "ts", F.col("event_id").alias("row_id"), _mapped(F.col("event_type"), EVENT_LABELS, "unclear").alias("label"), "event_type", "value")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their orders: user_id, item, ts, row_id, label, price."""
    line = table(spark, sf_dir, "lineitem")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    row_id = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return line.join(order, line["l_orderkey"] == order["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item"),
        F.col("o_orderdate").alias("ts"),
        row_id.alias("row_id"),
        _mapped(F.concat("l_returnflag", "l_linestatus"), LINE_LABELS, "unclear").alias("label"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def documents_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: row_id, text, category (source), lang."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("category"), "lang")
