"""Labels for a whole corpus, in parts that outlive a broken-off run.

The corpus is dealt into parts by a hash of its row ids and stored by part once. A part
is a Spark job of its own; its record is written after its labels, so a part without a
record was broken off and is made again, and parts with one are never made twice. A run's
folder belongs to one corpus, model and number of parts: another raises. At the end
every row has exactly one label, or the run raises.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.functions.labels import LABELS, in_set
from ravelin.operators.stats import seasonality
from ravelin.sources.store import Stale, get_json, put_json, remove, there

#: What labels of a stand-in for a model are marked with: they are never reported.
STUB, REAL = "stub", "model"


def require_gate(report: dict | None, model: str, backend: str) -> str:
    """The verdict under which a model may label a corpus. report: what its fidelity
    check has left (model, verdict). Raises if a real model has none, one of another
    model, or didn't pass; a stand-in needs none."""
    if report is None:
        if backend == STUB:
            return "NONE"
        raise FileNotFoundError("the model's fidelity was never checked")
    if report["model"] != model:
        raise Stale(f"the fidelity report is of {report['model']}, not of {model}")
    if backend != STUB and report["verdict"] != "PASS":
        raise ValueError(f"the fidelity gate says {report['verdict']}: these labels can't be used")
    return report["verdict"]


def require_reportable(labels: DataFrame, source: str = "label_source") -> None:
    """Raises if any label comes from a stand-in, or labels come from several sources.
    Runs a job."""
    found = sorted(str(r[0]) for r in labels.select(source).distinct().limit(10).collect())
    if found != [REAL]:
        raise ValueError(f"labels of {', '.join(found) or 'nothing'} can't be reported")


def corpus_facts(rows: DataFrame, key: str = "row_id", text: str = "text") -> dict:
    """What tells one corpus from another whatever its order: rows and a hash of all.
    Runs a job."""
    n, all_ = rows.select(F.xxhash64(key, text).alias("h")).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return {"rows": n, "hash": str(all_)}


def infer_in_parts(rows: DataFrame, infer: Callable[[DataFrame], DataFrame], folder: str, model: str, backend: str = REAL, rows_a_part: int = 10_000_000, report: dict | None = None, force: bool = False, key: str = "row_id", text: str = "text") -> tuple[DataFrame, dict]:
    """(labels, facts): one row for each of rows (key, text): what infer() makes of
    them (key, label and what else it has), label_source and model. folder: where parts,
    records and the dealt corpus are kept, on a store that all machines reach. infer()
    gets one part at a time. facts: gate, rows, parts, parts and rows made now, seconds,
    rows a second of this run. force: throws away what is there. Runs jobs."""
    spark = rows.sparkSession
    gate = require_gate(report, model, backend)
    facts = corpus_facts(rows, key, text)
    parts = max(1, -(-facts["rows"] // rows_a_part))
    mine = facts | {"model": model, "backend": backend, "parts": parts}
    if force:
        remove(spark, folder)
    found = get_json(spark, f"{folder}/run.json")
    if found is not None and found != mine:
        raise Stale(f"the folder holds another run: {', '.join(sorted(k for k in mine if found.get(k) != mine[k]))} differ")
    if found is None:
        remove(spark, f"{folder}/parts")
        part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
        dealt = rows.select(key, text, part.alias("part"))
        # a part's rows come from all tasks, so each task writes few files only if dealt first
        dealt.repartition("part", F.pmod(F.xxhash64(text), F.lit(16))).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/input")
        put_json(spark, f"{folder}/run.json", mine)
    schema = rows.select(key, text).schema.add("part", T.IntegerType())
    began, made, rows_made = time.time(), 0, 0
    for i in range(parts):
        if there(spark, f"{folder}/done/{i:06d}.json"):
            continue
        some = spark.read.schema(schema).parquet(f"{folder}/input").filter(F.col("part") == i).drop("part")
        infer(some).write.mode("overwrite").parquet(f"{folder}/parts/part={i}")
        n = spark.read.parquet(f"{folder}/parts/part={i}").count()
        put_json(spark, f"{folder}/done/{i:06d}.json", {"part": i, "rows": n})
        made, rows_made = made + 1, rows_made + n
    seconds = time.time() - began
    out = spark.read.parquet(f"{folder}/parts").drop("part")
    n, different = out.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
    missing = rows.select(key).join(out.select(key), key, "left_anti").count()
    if n != facts["rows"] or different != n or missing:
        raise ValueError(f"{facts['rows']} rows went in, {n} came out ({different} different, {missing} missing)")
    labels = out.withColumn("label_source", F.lit(STUB if backend == STUB else REAL)).withColumn("model", F.lit(model))
    return labels, {"gate": gate, "rows": n, "parts": parts, "parts_made": made, "rows_made": rows_made, "seconds": round(seconds, 1), "rows_a_second": round(rows_made / seconds, 1) if rows_made and seconds else None}


def label_shares(labels: DataFrame, label: str = "label") -> DataFrame:
    """(kind, name, n, pct): rows and percent of each label, and of the narrow and broad
    sets of labels."""
    each = [F.struct(F.lit("label").alias("kind"), F.col(label).alias("name"))]
    each += [F.when(in_set(F.col(label), axis), F.struct(F.lit("set").alias("kind"), F.lit(axis).alias("name"))) for axis in ("narrow", "broad")]
    counts = labels.select(F.explode(F.array_compact(F.array(*each))).alias("s")).groupBy("s.kind", "s.name").agg(F.count(F.lit(1)).alias("n"))
    all_ = labels.agg(F.count(F.lit(1)).alias("all"))
    return counts.crossJoin(F.broadcast(all_)).select("kind", "name", "n", F.round(100 * F.col("n") / F.col("all"), 3).alias("pct"))


def season_signature(labels: DataFrame, month: Column, peak: Sequence[int], trough: Sequence[int], label: str = "label") -> DataFrame:
    """(axis, peak_rate, trough_rate, ratio) of each set of labels: whether a model kept
    the season that people's labels show. No gate."""
    out = None
    for axis in ("narrow", "broad"):
        row = seasonality(labels, month, in_set(F.col(label), axis), peak, trough).select(F.lit(axis).alias("axis"), "peak_rate", "trough_rate", "ratio")
        out = row if out is None else out.unionAll(row)
    return out


def stub_labels(rows: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """(key, label, p): a stand-in for a model, by md5 of the text."""
    digits = F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 8)
    u = F.conv(digits, 16, 10).cast("long")
    return rows.select(key, F.element_at(F.array(*[F.lit(x) for x in LABELS]), (u % len(LABELS) + 1).cast("int")).alias("label"), F.lit(1.0).alias("p"))
