"""Batch annotation, agreement of spans with texts, label sheets, model bundles."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.functions.labels import LABELS
from ravelin.operators.sampling import holdout


def stub_backend(texts: list[str]) -> list[dict]:
    """A deterministic stand-in for a model: a label and a span from the text's
    checksum. What it makes is marked by its backend name and never reportable."""
    import zlib

    out = []
    for t in texts:
        c = zlib.crc32(t.encode())
        out.append({"label": LABELS[c % len(LABELS)], "confidence": ("high", "medium", "low")[c // 7 % 3], "span": " ".join(t.split()[:3])})
    return out


def annotate(df: DataFrame, backend: Callable[[list[str]], list[dict]] = stub_backend, name: str = "stub", text: str = "text", batch: int = 64) -> DataFrame:
    """row_id, label, confidence, span, parse_ok, backend of every row: one row out
    for each in. A text whose answer has no known label is asked once more and else
    is "unclear" with parse_ok false; texts are cut to 6,000 characters."""
    rows = df.select(F.col("row_id"), tx.truncated(F.coalesce(F.col(text), F.lit("")))[0].alias("text"))
    kind = dict(df.dtypes)["row_id"]

    def run(batches):
        for b in batches:
            found = []
            texts = b["text"].tolist()
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                got = backend(some)
                again = [j for j, g in enumerate(got) if g.get("label") not in LABELS]
                for j, g in zip(again, backend([some[j] for j in again]) if again else [], strict=True):
                    got[j] = g
                found += got
            ok = [g.get("label") in LABELS for g in found]
            yield pd.DataFrame({"row_id": b["row_id"], "label": [g["label"] if k else "unclear" for g, k in zip(found, ok, strict=True)], "confidence": [g.get("confidence", "low") if k else "low" for g, k in zip(found, ok, strict=True)], "span": [g.get("span", "") if k else "" for g, k in zip(found, ok, strict=True)], "parse_ok": ok, "backend": name})

    return rows.mapInPandas(run, f"row_id {kind}, label string, confidence string, span string, parse_ok boolean, backend string")


def downgrade(labels: DataFrame, text: str = "text") -> DataFrame:
    """labels (label, confidence, span and the text) with answers whose span is not
    in the text made "unclear" and "low", and span_downgraded."""
    bad = (F.col("label") != "unclear") & ~tx.is_verbatim(F.col("span"), F.col(text))
    return labels.withColumn("span_downgraded", bad).withColumn("label", F.when(bad, "unclear").otherwise(F.col("label"))).withColumn("confidence", F.when(bad, "low").otherwise(F.col("confidence")))


def run_statistics(labels: DataFrame) -> DataFrame:
    """(label, n) and, repeated, parse-failure and downgrade rates over all rows."""
    every = labels.agg(F.avg((~F.col("parse_ok")).cast("double")).alias("parse_fail_rate"), F.avg(F.col("span_downgraded").cast("double")).alias("downgrade_rate"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(every))


def bundle(labels: DataFrame, texts: DataFrame, kept_out: DataFrame, key: Sequence[str], fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Labelled texts for training: joined by key, parse failures and the kept-out
    keys left out (all of these must occur, else it raises), with part train or
    holdout, stratified by category and label. Runs jobs."""
    rows = labels.join(texts, list(key))
    missing = kept_out.join(labels, list(key), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} kept-out rows have no label")
    rows = rows.join(kept_out, list(key), "left_anti").filter("parse_ok")
    return holdout(rows, F.concat_ws("|", "category", "label"), fraction, seed)


def merge_shards(shards: DataFrame, expected: DataFrame, key: Sequence[str], order: str = "written") -> DataFrame:
    """One row for each key, the last written; raises if keys are missing. Runs a job."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    out = shards.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    missing = expected.join(out, list(key), "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows are missing from the shards")
    return out


def token_batches(lengths: Sequence[int], budget: int, most: int) -> list[list[int]]:
    """Indexes by length, cut where a batch would exceed its rows or rows times longest."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if out and len(out[-1]) < most and (len(out[-1]) + 1) * lengths[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def train_student(rows: DataFrame, features: int = 1 << 15, seed: int = 42):
    """A text classifier on (text, label) by hashed tf-idf and logistic regression;
    its transform() adds `predicted` and `probability`. Runs jobs."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    index = StringIndexer(inputCol="label", outputCol="__y", handleInvalid="skip").fit(rows)
    steps = [
        index,
        RegexTokenizer(inputCol="text", outputCol="__w", pattern=r"(?U)\W+"),
        HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(labelCol="__y", featuresCol="__x", predictionCol="__p", probabilityCol="probability", maxIter=30, regParam=1e-3),
        IndexToString(inputCol="__p", outputCol="predicted", labels=index.labels),
    ]
    return Pipeline(stages=steps).fit(rows)


def blind(sheet: DataFrame, hidden: Sequence[str] = ("kw_proxy", "frame", "label", "model", "confidence", "span")) -> DataFrame:
    """What raters may see of a label sheet."""
    return sheet.drop(*hidden)


def ingest(sheets: dict[str, DataFrame], sample: DataFrame, key: str = "sample_id") -> DataFrame:
    """sample with label_<tag> for each rater's sheet (key, label); raises if a sheet
    repeats or lacks ids or has unknown labels. Blank labels stay null. Runs jobs."""
    out = sample
    for tag, sheet in sorted(sheets.items()):
        if tag != tag.upper() or not tag:
            raise ValueError(f"annotator tag {tag!r}")
        s = sheet.select(key, F.nullif(F.trim("label"), F.lit("")).alias(f"label_{tag}"))
        if s.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"{tag}: repeated ids")
        if sample.join(s, key, "left_anti").limit(1).count() or s.join(sample, key, "left_anti").limit(1).count():
            raise ValueError(f"{tag}: other ids than the sample's")
        if s.filter(F.col(f"label_{tag}").isNotNull() & ~F.col(f"label_{tag}").isin(*LABELS)).limit(1).count():
            raise ValueError(f"{tag}: unknown labels")
        out = out.join(s, key, "left")
    return out
