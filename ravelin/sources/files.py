"""Files in and out: NDJSON, Parquet, CSV and TSV, JSON reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.sources.store import cut

#: What an interaction log of reviews looks like at rest; nested fields are not read.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("helpful_vote", T.LongType()),
    ]
)
#: The catalogue of products.
CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("store", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("average_rating", T.DoubleType()),
        T.StructField("rating_number", T.LongType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
    ]
)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """JSON lines under a declared schema: columns outside it are never parsed."""
    df = spark.read.schema(schema).json(path)
    return df.select(*columns) if columns else df


#: monotonically_increasing_id() counts inside a task from its number times this.
_TASK = 1 << 33


def with_row_index(df: DataFrame, name: str = "row_id", order: Sequence[str | Column] | None = None) -> DataFrame:
    """df with a number for each row, 0 and up without gaps.

    With order (columns that make rows unique) the numbers follow it and any
    partitioning gives the same ones; rows that tie in it are numbered in some
    order. Without, they follow the order in which files are read. The rows are
    written once with the task that holds them and their place in it, and counted
    and numbered from that table: no plan is run twice, so bounds sampled anew or
    partitions merged otherwise cannot matter. Runs a job for the table; what a
    task's rows begin at is a row for each task, summed in one window."""
    place = "__place"
    rows = df
    if order:
        by = [F.col(c) if isinstance(c, str) else c for c in order]
        rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    stored = cut(rows.withColumn(place, F.monotonically_increasing_id()))
    task = F.expr(f"{place} div {_TASK}")
    sizes = stored.groupBy(task.alias("__task")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select(F.col("__task"), F.coalesce(before, F.lit(0)).alias("__base"))
    numbered = stored.join(F.broadcast(base), task == F.col("__task"))
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col(place) % _TASK).alias(name))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None, sep: str = "\t") -> DataFrame:
    """Separated values with a header of name or name:type; every column is text
    unless types names a Spark type for it, so ids that look like numbers stay."""
    df = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    out = []
    for c in df.columns:
        name = c.split(":")[0]
        kind = (types or {}).get(name, "string")
        out.append(F.expr(f"try_cast(`{c}` AS {kind})").alias(name))
    return df.select(*out)


def probe_schema(spark: SparkSession, path: str, required: Sequence[str], lines: int = 100) -> dict[str, str]:
    """Keys of the first lines and the type that each first has; raises if a
    required key is missing. Reads `lines` rows."""
    found: dict[str, str] = {}
    for row in spark.read.text(path).limit(lines).collect():
        for key, value in json.loads(row["value"]).items():
            found.setdefault(key, type(value).__name__)
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return found


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_tsv(df: DataFrame, path: str, typed: dict[str, str] | None = None, sep: str = "\t", order: Sequence[str] | None = None, mode: str = "error") -> None:
    """Separated values; typed gives names the form name:type in the header,
    order sorts within as many range partitions as the session makes."""
    if order:
        df = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    for c, kind in (typed or {}).items():
        df = df.withColumnRenamed(c, f"{c}:{kind}")
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def write_json(path: str | Path, report: dict) -> None:
    """A report on the driver's side."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False, sort_keys=False) + "\n", encoding="utf-8")


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def md_table(rows: Sequence[Sequence[object]], headers: Sequence[str]) -> str:
    """A table in Markdown."""
    lines = [headers, ["---"] * len(headers), *rows]
    return "\n".join("| " + " | ".join(str(x) for x in line) + " |" for line in lines)


def should_skip(path: str | Path, force: bool = False) -> bool:
    """Whether an output is there and need not be made again."""
    return Path(path).exists() and not force


def same_manifest(path: str | Path, manifest: dict) -> None:
    """Writes the manifest of a resumable run, or raises if another is there."""
    if Path(path).exists() and read_json(path) != manifest:
        raise ValueError(f"{Path(path).name} is of another run; remove its output first")
    write_json(path, manifest)


def append_missing(df: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends the rows whose key is not yet in the Parquet table at path and
    returns their number; what a broken-off run has left is kept. Runs jobs."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*key).distinct()
    except Exception as e:  # Spark has one class of error for a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    left = df.join(done, list(key), "left_anti") if done is not None else df
    n = left.count()
    if n:
        left.write.mode("append").parquet(path)
    return n
