"""Labels for the whole corpus, in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.labels import BROAD, LABELS
from ravelin.operators import inference as inf
from ravelin.plans.registry import DOC, query
from ravelin.sources.store import shared_dir
from ravelin.sources.views import documents_log

_STUB = f"""{DOC}, lb AS (SELECT row_id, [{', '.join(f"'{x}'" for x in LABELS)}][(('0x' || substr(md5(text), 1, 8))::UBIGINT % {len(LABELS)} + 1)::INT] AS label FROM doc)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, labelled in three parts by a stand-in for a model."""
    rows = documents_log(spark, sf_dir).select("row_id", "text")
    third = -(-rows.count() // 3)
    return inf.infer_in_parts(rows, inf.stub_labels, f"{shared_dir(spark)}/inference-{uuid.uuid4().hex}", "stub", inf.STUB, max(1, third))[0]


@query(f"WITH {_STUB} SELECT row_id, label, 'stub' AS label_source FROM lb")
def full_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("row_id", "label", "label_source")


@query(f"""WITH {_STUB}, a AS (SELECT count(*) AS a FROM lb) SELECT 'label' AS kind, label AS name, count(*) AS n, round(100.0::DOUBLE * count(*) / any_value(a), 3) AS pct FROM lb, a GROUP BY 2
UNION ALL SELECT 'set', 'narrow', count(*), round(100.0::DOUBLE * count(*) / any_value(a), 3) FROM lb, a WHERE label = 'gift_given'
UNION ALL SELECT 'set', 'broad', count(*), round(100.0::DOUBLE * count(*) / any_value(a), 3) FROM lb, a WHERE label IN {BROAD!r}""")
def inference_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.label_shares(_labels(spark, sf_dir))


@query(f"""WITH {_STUB}, t AS (SELECT doc_id, toxic FROM labels) SELECT count(*) AS n, round(avg(((label = 'gift_given') = (toxic = 1))::INT::DOUBLE), 6) AS agreement FROM lb JOIN t ON row_id = doc_id""")
def inference_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the labels agree with the rows that were labelled before."""
    from ravelin.operators.validation import overlap_agreement
    from ravelin.sources.views import table

    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("toxic") == 1).alias("label"))
    got = _labels(spark, sf_dir).select("row_id", (F.col("label") == "gift_given").alias("label"))
    return overlap_agreement(got, known, "row_id").select("n", F.round("agreement", 6).alias("agreement"))
