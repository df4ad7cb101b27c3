"""Gates that decide per query whether to expand, and expansion with fusion."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import uniform
from sievekit.functions.text import tokens
from sievekit.operators.fusion import as_list, rrf
from sievekit.sources.writers import exists

MODES = ("selective", "always", "traces", "paraphrases", "dense", "random")
THRESHOLD, RANDOM_RATE = 0.65, 0.46


def expands(mode: str, top1: Column, query_id: Column, threshold: float = THRESHOLD, rate: float = RANDOM_RATE, seed: Column | int = 42) -> Column:
    """Whether a query is expanded in a mode. A query without results has top1 0."""
    top1 = F.round(F.coalesce(top1, F.lit(0.0)), 6)
    if mode == "selective":
        return top1 < threshold
    if mode == "random":
        return uniform("gate", F.lit(seed), query_id) < rate
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    return F.lit(mode != "dense")


def variant_kinds(mode: str) -> tuple[str, ...]:
    return {"dense": (), "traces": ("trace",), "paraphrases": ("paraphrase",)}.get(mode, ("trace", "paraphrase"))


def estimated_calls(traces: Column, paraphrases: Column) -> Column:
    """One call a trace, and one for all paraphrases together."""
    return traces + F.when(paraphrases > 0, 1).otherwise(0)


def cache_key(query: Column) -> Column:
    return F.trim(query)


def cache_misses(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries whose trimmed text has no expansions in the cache (query_key, kind, ord, text)."""
    return queries.join(cache.select(F.col("query_key")).distinct(), cache_key(F.col("query")) == F.col("query_key"), "left_anti")


MEMO = "query_key string, kind string, ord int, text string, asker long, run string, at long"


def memo(spark: SparkSession, path: str) -> DataFrame:
    """The cache as it reads now: of each key, kind and place one text, that of the earliest run. Runs that asked for the same at the same time leave two rows; all readers see the same one."""
    rows = spark.read.schema(MEMO).parquet(path) if exists(spark, path) else spark.createDataFrame([], MEMO)
    first = F.min_by(F.struct("text", "asker", "run"), F.struct("at", "run", "asker", "text"))
    return rows.where("kind is not null").groupBy("query_key", "kind", "ord").agg(first.alias("x")).select("query_key", "kind", "ord", "x.*")


def expanded(queries: DataFrame, generated: DataFrame, path: str, n_traces: int = 2, n_paraphrases: int = 2) -> DataFrame:
    """queries query_id, query; generated query_id, kind, ord, text: what a model answers each query; path: the cache table, append-only, that runs share -> query_id, kind, ord, text, asked.

    A trimmed text takes what the cache holds for it, in its order. Where it holds fewer texts of a kind than wanted, the least query_id of the text asks for the rest, and the answers are appended behind: traces
    one call each, so the answers that the cache holds are not asked for again; paraphrases all in one call, whose lines follow the cached ones. Answers that are null or blank are not
    kept, so a text whose generation failed is asked for again by the next run. asked: the row came from this query's call in this run; a query without any text has one row, with asked as whether it called.
    """
    spark, run, at = queries.sparkSession, uuid.uuid4().hex, time.time_ns()
    keyed = queries.select("query_id", cache_key(F.col("query")).alias("query_key"))
    cached = memo(spark, path).groupBy("query_key", "kind").agg(F.count("*").cast("int").alias("have"))
    kinds = F.explode(F.array(F.struct(F.lit("trace").alias("kind"), F.lit(n_traces).alias("want")), F.struct(F.lit("paraphrase").alias("kind"), F.lit(n_paraphrases).alias("want"))))
    wanted = keyed.groupBy("query_key").agg(F.min("query_id").alias("query_id")).select("query_key", "query_id", kinds.alias("k")).select("query_key", "query_id", "k.*")
    askers = wanted.join(cached, ["query_key", "kind"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < want")
    answers = askers.join(generated.where(F.trim("text") != ""), ["query_id", "kind"]).where((F.col("kind") != "trace") | (F.col("ord") >= F.col("have")))
    place = F.col("have") + F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("ord", "text")) - 1
    new = answers.withColumn("place", place).where("place < want").select("query_key", "kind", F.col("place").cast("int").alias("ord"), "text", F.col("query_id").cast("long").alias("asker"), F.lit(run).alias("run"), F.lit(at).alias("at"))
    new.write.mode("append").parquet(path)
    kept = memo(spark, path).where(F.col("ord") < F.when(F.col("kind") == "trace", n_traces).otherwise(n_paraphrases))
    called = askers.select("query_id").distinct().withColumn("called", F.lit(True))
    found = keyed.join(kept, "query_key", "left").join(called, "query_id", "left")
    asked = F.when(F.col("kind").isNull(), F.coalesce("called", F.lit(False))).otherwise((F.col("run") == run) & (F.col("asker") == F.col("query_id")))
    return found.select("query_id", "kind", "ord", "text", asked.alias("asked"))


def usage(queries: DataFrame, told: DataFrame) -> DataFrame:
    """A row a query (told: expanded()'s rows for them): n_traces, n_paraphrases, estimated_calls (what they take without a cache), llm_calls, prompt_tokens, completion_tokens, total_tokens (what this run spent for it: nothing for texts of the cache). Words count as tokens; a prompt is the query."""
    of = lambda kind, asked=False: F.count_if((F.col("kind") == kind) & (F.col("asked") if asked else F.lit(True)))
    spent = F.sum(F.when(F.col("asked") & F.col("text").isNotNull(), F.size(tokens(F.col("text")))).otherwise(0))
    rows = told.groupBy("query_id").agg(of("trace").alias("n_traces"), of("paraphrase").alias("n_paraphrases"), estimated_calls(of("trace", True), of("paraphrase", True)).alias("llm_calls"), spent.alias("completion_tokens"))
    priced = queries.select("query_id", F.size(tokens(F.col("query"))).alias("words")).join(rows, "query_id").withColumn("prompt_tokens", F.col("llm_calls") * F.col("words"))
    return priced.select("query_id", "n_traces", "n_paraphrases", estimated_calls(F.col("n_traces"), F.col("n_paraphrases")).alias("estimated_calls"), "llm_calls", "prompt_tokens", "completion_tokens", (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"))


USED = ("estimated_calls", "llm_calls", "prompt_tokens", "completion_tokens", "total_tokens")


def observed_usage(ledger: DataFrame) -> tuple[DataFrame, Observation]:
    """The ledger, and its totals as they are once it has been written: one pass gives rows and totals."""
    totals = Observation("usage")
    return ledger.observe(totals, F.count(F.lit(1)).alias("queries"), *[F.sum(c).alias(c) for c in USED]), totals


def average_usage(ledger: DataFrame) -> DataFrame:
    """One row: queries, and the mean a query of calls and tokens."""
    return ledger.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in USED])


def gated_retrieval(original: DataFrame, variants: DataFrame, mode: str, dense: Callable[[DataFrame, int], DataFrame], sparse: Callable[[DataFrame, int], DataFrame], k: int = 10, threshold: float = THRESHOLD, rate: float = RANDOM_RATE, seed: int = 42) -> DataFrame:
    """original: query_id, doc_id, score, rank at depth 2k; variants: query_id, kind, ord, text -> query_id, expanded, doc_id, rank.

    The gate stands before the variants are scored, so queries that it lets pass never reach the scorers. Expanded queries
    fuse the original list with a dense and a sparse list of each trace and a dense list of each paraphrase.
    """
    top1 = original.groupBy("query_id").agg(F.max("score").alias("top1"))
    gated = top1.select("query_id", expands(mode, F.col("top1"), F.col("query_id"), threshold, rate, seed).alias("expanded"))
    plain = original.join(gated.where("not expanded"), "query_id").where(F.col("rank") <= k).select("query_id", "expanded", "doc_id", "rank")
    kinds = variant_kinds(mode)
    if not kinds:
        return plain
    wanted = gated.where("expanded").select("query_id")
    chosen = variants.where(F.col("kind").isin(*kinds)).join(wanted, "query_id")
    every = as_list(original.join(wanted, "query_id", "left_semi"), 0).unionByName(variant_lists(chosen, dense, sparse, k, kinds).drop("kind"))
    return plain.unionByName(rrf(every, k).select("query_id", F.lit(True).alias("expanded"), "doc_id", "rank"))


def variant_lists(variants: DataFrame, dense: Callable[[DataFrame, int], DataFrame], sparse: Callable[[DataFrame, int], DataFrame], k: int = 10, kinds: tuple[str, ...] = ("trace", "paraphrase")) -> DataFrame:
    """query_id, kind, list_ord, rank, doc_id: a dense list of depth 2k of each variant, and a sparse one of each trace (the sparse scorer is not called if traces are none of the kinds). The scorers see a variant as a query of the id query_id:list_ord."""
    number = F.when(F.col("kind") == "trace", F.col("ord") * 2 + 1).otherwise(F.col("ord") + 1_000)
    asked = variants.select(F.concat_ws(":", "query_id", number).alias("query_id"), "kind", F.col("text").alias("query"))
    back = lambda found, step: found.select(owner(F.col("query_id")).alias("query_id"), (F.split("query_id", ":")[1].cast("int") + step).alias("list_ord"), "rank", "doc_id")
    lists = back(dense(asked.select("query_id", "query"), 2 * k), 0)
    if "trace" in kinds:
        lists = lists.unionByName(back(sparse(asked.where("kind = 'trace'").select("query_id", "query"), 2 * k), 1))
    return lists.select("query_id", F.when(F.col("list_ord") < 1_000, "trace").otherwise("paraphrase").alias("kind"), "list_ord", "rank", "doc_id")


def owner(query_id: Column) -> Column:
    """The query that a variant's id belongs to; a query's own id is its own."""
    return F.split(query_id.cast("string"), ":")[0].cast("long")


def suite(original: DataFrame, lists: DataFrame, modes: tuple[str, ...], seed: Column, k: int = 10, threshold: float = THRESHOLD, rate: float = RANDOM_RATE) -> DataFrame:
    """Every mode over one set of lists: original query_id, doc_id, score, rank at depth 2k; lists those of all variants -> mode, query_id, expanded, doc_id, rank. seed: a column of query_id, for the random mode. No list is made twice: a mode picks the kinds that it fuses, and fusion is keyed by mode and query."""
    top1 = original.groupBy("query_id").agg(F.max("score").alias("top1"))
    gates = [F.struct(F.lit(m).alias("mode"), expands(m, F.col("top1"), F.col("query_id"), threshold, rate, seed).alias("expanded")) for m in modes]
    gated = top1.select("query_id", F.explode(F.array(*gates)).alias("g")).select("query_id", "g.*")
    plain = original.join(gated.where("not expanded"), "query_id").where(F.col("rank") <= k).select("mode", "query_id", "expanded", "doc_id", "rank")
    fuses = F.lit(False)
    for m in modes:
        fuses = fuses | ((F.col("mode") == m) & F.col("kind").isin("original", *variant_kinds(m)))
    every = as_list(original, 0).withColumn("kind", F.lit("original")).unionByName(lists)
    fused = rrf(every.join(gated.where("expanded"), "query_id").where(fuses).select(F.struct("mode", "query_id").alias("query_id"), "list_ord", "rank", "doc_id"), k)
    return plain.unionByName(fused.select("query_id.mode", "query_id.query_id", F.lit(True).alias("expanded"), "doc_id", "rank"))
