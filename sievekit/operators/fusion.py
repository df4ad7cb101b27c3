"""Reciprocal rank fusion of ranked lists in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: DataFrame, k: int = 10, constant: int = RRF_K, first_seen: bool = False) -> DataFrame:
    """query_id, list_ord, rank, doc_id -> query_id, doc_id, score, rank. Scores of the lists do not count. Ties go to the smaller doc_id, or with first_seen to the earlier list and rank."""
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(F.lit(1.0) / (constant + F.col("rank"))).alias("score"), F.min(F.col("list_ord").cast("long") * 100_000 + F.col("rank")).alias("seen"))
    order = [F.desc(F.round("score", 9)), *(["seen"] if first_seen else []), "doc_id"]
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def as_list(ranked: DataFrame, list_ord: int) -> DataFrame:
    return ranked.select("query_id", F.lit(list_ord).alias("list_ord"), "rank", "doc_id")


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """Two ranked lists of depth 2k fused to k."""
    return rrf(as_list(dense.where(F.col("rank") <= 2 * k), 0).unionByName(as_list(sparse.where(F.col("rank") <= 2 * k), 1)), k)


def collected(ranked: DataFrame) -> DataFrame:
    """query_id, retrieved_ids in rank order."""
    return ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved_ids"))


def agreement(dense: DataFrame, sparse: DataFrame, k: int = 10) -> DataFrame:
    """query_id, agrees: whether the first of a query's dense list is among the k first of its sparse one. Queries without a dense list have no row."""
    first = dense.where(F.col("rank") == 1).select("query_id", "doc_id")
    found = sparse.where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(True).alias("found"))
    return first.join(found, ["query_id", "doc_id"], "left").select("query_id", F.coalesce("found", F.lit(False)).alias("agrees"))
