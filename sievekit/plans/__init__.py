"""Registered queries of the engine and their SQL oracles."""

from sievekit.plans import analytics, checks, files, retrieval, streams, texts
from sievekit.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "checks", "files", "flagship", "retrieval", "streams", "texts"]


def flagship(spark, sf_dir):
    """BM25 retrieval of known items, and how well it finds them."""
    return QUERIES["bm25_recall"](spark, sf_dir)
