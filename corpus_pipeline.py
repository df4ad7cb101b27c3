"""The training-data pipeline: toxicity, near-duplicates, secrets, mixture, token ids.

Each stage takes what the one before kept, as written to Parquet and read again. All but the last return the columns of
documents, and any others that came with them. In every stage null texts are empty ones, null ids are kept, rows that repeat are rows each (but for
near-duplicates, where one stays), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm import bpe, mixing, secrets, simhash, toxicity
from sievekit.llm.common import read_table, staged

#: Shares of expected tokens by the quality label's domains.
TARGETS = {"prime": 0.85, "rough": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score as toxic go."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts that are linked by a Jaccard likeness of 0.8 or more of their five-word shingles one row stays, that of the least doc_id; rows of null ids come last."""
    return simhash.near_copies(docs, words=5, least=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; n_chars follows where a text changed."""
    return secrets.redact(docs, length="n_chars")


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated so that expected tokens meet TARGETS; no row has a rate under 1, so none goes."""
    labels = read_table(spark, sf_dir, "labels")
    return mixing.mix(docs, mixing.label_domains(labels).where(F.col("domain").isin(*TARGETS)), TARGETS, least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_table(docs, bpe.default_vocabulary(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixture", mix_domains), ("token_ids", encode)]

#: Classifiers, shingle sets and byte pair merges have no SQL form: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs)
    return docs
