"""Aggregates over runs: recall, MRR, cost, contingencies, headroom, labels, attempts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.ranks import hit_at


def rate(condition: Column) -> Column:
    """The share of rows for which a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def recall(runs: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """runs with place (1-based place of the target, null if absent) -> recall_k for each k, mrr, n."""
    place = F.col("place")
    return runs.groupBy(*by).agg(F.count("*").alias("n"), *[rate(place <= k).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1.0 / place, F.lit(0.0))).alias("mrr"))


def expansion(runs: DataFrame, by: list[str]) -> DataFrame:
    """expansion_rate: a null is no expansion; null if no row has any."""
    return runs.groupBy(*by).agg(F.when(F.count("expanded") > 0, rate(F.col("expanded"))).alias("expansion_rate"))


def across(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean and sample deviation (null for one value)."""
    return values.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count(column).alias("n"))


def win_loss(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs with hit_a, hit_b, expanded -> counts of the 2 x 2 table, split by expanded, with net and rates."""
    a, b, e = F.col("hit_a"), F.col("hit_b"), F.col("expanded")
    cells = {"win": b & ~a, "loss": a & ~b, "both_hit": a & b, "both_miss": ~a & ~b}
    counts = [F.count_if(c & (e if side == "expanded" else ~e)).alias(f"{side}_{name}") for side in ("expanded", "kept") for name, c in cells.items()]
    win, loss = F.count_if(cells["win"]), F.count_if(cells["loss"])
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *counts, (win - loss).alias("net"), (win / F.count("*")).alias("win_rate"), (loss / F.count("*")).alias("loss_rate"))


def report(pairs: DataFrame, by: str) -> DataFrame:
    """pairs with hit_a, hit_b, expanded: a row for each value of `by` and one for all (whole is true, `by` null): n, wins, losses, net, expansion, recall_a and recall_b over rows (micro), and macro_a and macro_b, the means of the groups' recalls.

    One scan: rows are aggregated by group once, and grouping sets over these few rows give every level.
    """
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    a, b = F.col("hit_a"), F.col("hit_b")
    counts = {"wins": b & ~a, "losses": a & ~b, "hits_a": a, "hits_b": b, "expansions": F.col("expanded")}
    groups = pairs.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("n"), *[F.sum(one(c)).alias(name) for name, c in counts.items()])
    share = lambda name: F.sum(name) / F.sum("n")
    levels = groups.groupingSets([["__by"], []], "__by").agg(F.grouping("__by").alias("level"), F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), (F.sum("wins") - F.sum("losses")).alias("net"), share("expansions").alias("expansion"), share("hits_a").alias("recall_a"), share("hits_b").alias("recall_b"), F.avg(F.col("hits_a") / F.col("n")).alias("macro_a"), F.avg(F.col("hits_b") / F.col("n")).alias("macro_b"))
    return levels.where(F.col("n") > 0).select(F.col("__by").alias(by), (F.col("level") == 1).alias("whole"), *[c for c in levels.columns if c not in ("__by", "level")])


def headroom(pairs: DataFrame, by: list[str]) -> DataFrame:
    a, b = F.col("hit_a"), F.col("hit_b")
    return pairs.groupBy(*by).agg(rate(a).alias("base"), rate(b).alias("expanded"), rate(a | b).alias("oracle"), rate(b & ~a).alias("helpful"), rate(a & ~b).alias("harmful"), rate(a & b).alias("both"), (rate(a | b) - rate(a)).alias("headroom"))


def crossed(runs: DataFrame, hit: str, by: str) -> DataFrame:
    """Hits, misses and recall per value of a gate column."""
    hits = F.count_if(F.col(hit))
    return runs.groupBy(by).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), (hits / F.greatest(F.lit(1), F.count("*"))).alias("recall"))


#: Lower ends of the half-open score bins, and the last upper end.
BIN_EDGES = (0.45, 0.55, 0.60, 0.65, 0.70, 0.80)


def score_bin(score: Column) -> Column:
    """The lower end of the bin of a score; null outside all bins."""
    out = F.lit(None).cast("double")
    for low, high in zip(BIN_EDGES, BIN_EDGES[1:]):
        out = F.when((score >= low) & (score < high), F.lit(low)).otherwise(out)
    return out


def label_rates(rows: DataFrame, fields: list[str], domain: tuple[str, ...] = ("yes", "no", "uncertain")) -> DataFrame:
    """field, label, n, rate for every label of the domain, met or not; with no rows the rates are 0."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in fields])).alias("x")).select("x.*")
    counted = long.groupBy("field").agg(F.count("*").alias("total"), *[F.count_if(F.col("label") == d).alias(d) for d in domain])
    every = rows.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(counted, "field", "left")
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("label"), F.coalesce(F.col(d), F.lit(0)).alias("n")) for d in domain])).alias("x")
    return every.select("field", F.coalesce("total", F.lit(0)).alias("total"), cells).select("field", "x.label", "x.n", F.when(F.col("total") > 0, F.col("x.n") / F.col("total")).otherwise(F.lit(0.0)).alias("rate"))


def attempts(rows: DataFrame) -> DataFrame:
    """method -> attempted, solved (success is true, not null), pass_at_1, tasks."""
    solved = F.count_if(F.col("success") == F.lit(True))
    return rows.groupBy("method").agg(F.count("*").alias("attempted"), solved.alias("solved"), (solved / F.count("*")).alias("pass_at_1"), F.count_distinct(F.when(F.col("task_id") != "", F.col("task_id"))).alias("tasks"))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the one with the largest order."""
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("x")).select(key, "x.*")


def run_method(method: str, queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], k: int = 10) -> DataFrame:
    """queries query_id, query, target_id; retrieve(queries, k) -> query_id, doc_id, rank (any retriever). One row a query: method, query_id, query, target_id, retrieved_ids in rank order, hit_1, hit_k."""
    lists = retrieve(queries.select("query_id", "query"), k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved_ids"))
    rows = queries.select("query_id", "query", "target_id").join(lists, "query_id", "left")
    return rows.select(F.lit(method).alias("method"), "query_id", "query", "target_id", F.coalesce("retrieved_ids", F.slice(F.array("target_id"), 1, 0)).alias("retrieved_ids")).withColumns({f"hit_{n}": hit_at(F.col("retrieved_ids"), F.col("target_id"), d) for n, d in (("1", 1), ("k", k))})


def summary(detailed: DataFrame, k: int = 10) -> DataFrame:
    """method, n_queries, recall_1, recall_<k> of run_method()'s rows."""
    return detailed.groupBy("method").agg(F.count("*").alias("n_queries"), F.avg(F.col("hit_1").cast("double")).alias("recall_1"), F.avg(F.col("hit_k").cast("double")).alias(f"recall_{k}"))
