"""Stand-ins over the test tables for what the operators take, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.hashing import hash52
from sievekit.functions.text import tokens
from sievekit.sources.writers import scratch as scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query (words 5 to 16 of every 20th document, which is its target; all documents are searched)."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 20 == 0)
    return docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 5, 12), " ").alias("query"))


def draw(name: str) -> Column:
    return hash52(F.col("doc_id"), name)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One paired run row a document: places of the target in the base, expanded and sparse lists, and gate features."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    base = (draw("d") % 14 + 1).cast("int")
    out = docs.select("doc_id", (F.col("doc_id") % 8 + 42).alias("seed"), F.format_string("q_%07d", F.col("doc_id")).alias("query_id"), base.alias("base"), F.when(draw("same") % 3 == 0, (draw("e") % 14 + 1).cast("int")).otherwise(base).alias("full"), (draw("b") % 40 + 1).cast("int").alias("sparse"), ((draw("t") % 50000 + 40000) / 100000.0).alias("top1"), ((draw("m") % 2000) / 20000.0).alias("margin"), ((draw("c") % 7000 + 1000) / 10000.0).alias("concentration"), (draw("a") % 2 == 0).alias("agrees"))
    place = lambda c: F.when(F.col(c) <= 10, F.col(c))
    hits = {f"hit{k}_{s}": F.col(c) <= (5 if k == "" else 10) for k in ("", "10") for s, c in (("a", "base"), ("b", "full"))}
    return out.withColumns({"place_a": place("base"), "place_b": place("full"), "expanded": F.col("top1") < 0.65, **hits})


H = "CAST(('0x' || substr(md5(concat_ws('|', {0})), 1, 13)) AS BIGINT)"


def h(*parts: str) -> str:
    return H.format(", ".join(parts))


def d(name: str) -> str:
    return h("doc_id", f"'{name}'")


TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda w: w <> '')"


def tok(column: str) -> str:
    return TOK.format(column)


KNOWN = f"kq AS (SELECT doc_id AS query_id, array_to_string(({tok('text')})[5:16], ' ') AS query FROM documents WHERE doc_id % 20 = 0)"
PAIRS = f"""raw AS (SELECT doc_id, doc_id % 8 + 42 AS seed, printf('q_%07d', doc_id) AS query_id, CAST({d('d')} % 14 + 1 AS INTEGER) AS base,
  CASE WHEN {d('same')} % 3 = 0 THEN CAST({d('e')} % 14 + 1 AS INTEGER) ELSE CAST({d('d')} % 14 + 1 AS INTEGER) END AS "full", CAST({d('b')} % 40 + 1 AS INTEGER) AS sparse,
  ({d('t')} % 50000 + 40000) / CAST(100000 AS DOUBLE) AS top1, ({d('m')} % 2000) / CAST(20000 AS DOUBLE) AS margin, ({d('c')} % 7000 + 1000) / CAST(10000 AS DOUBLE) AS concentration, {d('a')} % 2 = 0 AS agrees FROM documents),
pairs AS (SELECT *, CASE WHEN base <= 10 THEN base END AS place_a, CASE WHEN "full" <= 10 THEN "full" END AS place_b, top1 < CAST(0.65 AS DOUBLE) AS expanded,
  base <= 5 AS hit_a, "full" <= 5 AS hit_b, base <= 10 AS hit10_a, "full" <= 10 AS hit10_b FROM raw)"""
