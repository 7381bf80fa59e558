"""The queries of this subpackage, each over the whole of its table, and the SQL
that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import alignment, decontam, fingerprints, importance, license_scan, linededup, mixture, pii, quality, secret_scan, simhash, toxicity, wavelet
from ravelin.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_query(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_query(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_query(table(spark, sf_dir, "documents"))


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.wavelet_query(table(spark, sf_dir, "documents"))


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_query(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_query(table(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_query(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints,
        op2_quality,
        op3_decontamination,
        op4_toxicity,
        op5_secrets,
        op6_pii,
        op7_wavelet,
        op8_mixture,
        op9_simhash,
        op10_line_dedup,
        op11_importance,
        op12_licenses,
        op13_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op8_mixture": mixture.ORACLE,
    "op11_importance": importance.ORACLE,
}
