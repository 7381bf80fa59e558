"""From raw documents to token shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one
gets as its docs after it has been written. All but the last return the columns
of documents; what a stage decides takes effect in the rows that it returns.

Defined cases, of every stage: null and empty texts are rows like others (they
score by the voter, link with each other, leak nothing, and count no words);
repeated rows and rows without an id are kept unless their texts are linked; extra
columns stay as they are, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import decontam, mixture, quality, simhash, wavelet
from ravelin.llm.common import cut, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours don't vote down. The voter
    is fitted on the labelled rows of the documents that come in."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the least id."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixture.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the shard files."""
    return wavelet.wavelet_query(docs, kept_words=wavelet.FEW_WORDS)


STAGES = [
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixture", mix_sources),
    ("tokens", write_tokens),
]

#: Latent vectors, fingerprints by xxhash64 and token ids are beyond SQL. The stages'
#: operators are tested against brute force one by one (tests/llm), the run as a
#: whole only by what it must keep and drop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; each but the last is written to the
    shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
