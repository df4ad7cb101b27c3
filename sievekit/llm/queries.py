"""The registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, divergence, editprint, forest, mixing, quality, quantize, secrets, simhash, suffix, topk, toxicity, warc
from sievekit.llm.common import read_table, staged


#: Production parameters of the mixture: the share of expected tokens of each domain of the labels.
TARGETS = {"prime": 0.8, "rough": 0.15, "toxic": 0.05}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"), mixing.label_domains(read_table(spark, sf_dir, "labels")), TARGETS)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.with_classes(staged(editprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(read_table(spark, sf_dir, "documents"), bpe.default_vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(read_table(spark, sf_dir, "pages"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.coded(read_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op13_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_topk": op2_topk,
    "op3_secrets": op3_secrets,
    "op4_simhash": op4_simhash,
    "op5_fingerprints": op5_fingerprints,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_suffix": op9_suffix,
    "op10_warc": op10_warc,
    "op11_codes": op11_codes,
    "op12_divergence": op12_divergence,
    "op13_forest": op13_forest,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op2_topk": topk.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_codes": quantize.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_forest": forest.ORACLE,
}
