"""Extension: recall and cost of runs whose attempts arrive as a stream, retries and late rows included.

State is kept in RocksDB, for buckets of (method, query_id): the last attempt of each, by time and then number. Each micro-batch emits what it changes in the
totals: a retry takes the figures of the attempt before it away and adds its own. Changes are summed up by method and written to a folder
that carries the batch's number and replaces itself, so a batch that runs twice after a failure changes nothing; a row a method and batch.

Null times: no part. Attempts later than the watermark: dropped, not counted. Two attempts of one time and number: the larger of
(hit, calls, tokens) wins. Null method or query_id: a key like any other. Null hit, calls, tokens, attempt: 0. A row that comes twice is two attempts.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

if TYPE_CHECKING:
    import pandas as pd

PROVIDER, EMPTY_BATCHES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What an attempt adds to the totals of its method.
FIGURES = ("hits", "calls", "tokens")
#: What makes an attempt the last one, and what it adds.
ORDER = ("at_micros", "attempt", *FIGURES)
#: Buckets that a stream's keys are dealt to.
BUCKETS = 4_096
CHANGES = "method string, queries long, attempts long, hits long, calls long, tokens long"


class LastAttempt(StatefulProcessor):
    """Rows of one bucket of (method, query_id) -> the changes in the totals of its methods; each key's last attempt stays as state until no retry can come.

    A bucket's keys are one value, read and written once a batch that touches it: a call to the state store costs far more than a key.
    """

    def __init__(self, horizon_ms: int | None = None):
        self.horizon_ms = horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "keys string, timer long")

    def held(self) -> tuple[dict, int | None]:
        """(method, query_id) -> (at, attempt, hits, calls, tokens), and the time of the bucket's timer."""
        state = self.state.get()
        return ({(method, query): tuple(last) for method, query, *last in json.loads(state[0])}, state[1]) if state else ({}, None)

    def keep(self, last: dict, timer: int | None) -> None:
        if self.horizon_ms is not None and last:
            first = min(self.closes(one[0]) for one in last.values())
            if timer is None or first < timer:  # an earlier timer finds nothing and sets the next one
                self.handle.registerTimer(first)
                timer = first
        if last:
            self.state.update((json.dumps([[*key, *one] for key, one in last.items()]), timer))
        else:
            self.state.clear()

    def closes(self, at: int) -> int:
        return at // 1000 + self.horizon_ms

    def handleInputRows(self, key: Any, rows: Iterator["pd.DataFrame"], timerValues: Any) -> Iterator["pd.DataFrame"]:
        import pandas as pd

        last, timer = self.held()
        best, attempts = {}, Counter()
        for part in rows:
            methods = part["method"].tolist()
            attempts.update(methods)
            for method, query, *one in zip(methods, part["query_id"].tolist(), *[part[c].tolist() for c in ORDER]):
                old = best.get((method, query))
                if old is None or one > old:
                    best[method, query] = one
        changes = {method: [0] * (1 + len(FIGURES)) for method in attempts}
        for key, one in best.items():
            old, one = last.get(key), tuple(one)
            if old is None or one > old:
                last[key] = one
                change = changes[key[0]]
                change[0] += old is None
                for k in range(len(FIGURES)):
                    change[k + 1] += one[k + 2] - (old[k + 2] if old else 0)
        self.keep(last, timer)
        yield pd.DataFrame([(method, queries, attempts[method], *change) for method, (queries, *change) in changes.items()], columns=["method", "queries", "attempts", *FIGURES])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator["pd.DataFrame"]:
        last, timer = self.held()
        now = timerValues.getCurrentWatermarkInMs()
        fired = timer is None or expiredTimerInfo.getExpiryTimeInMs() >= timer
        self.keep({key: one for key, one in last.items() if self.closes(one[0]) > now}, None if fired else timer)
        return iter([])

    def close(self) -> None:
        pass


def evaluate_stream(attempts: DataFrame, path: str, checkpoint: str, late: str = "1 hour", horizon_ms: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a stream over method, query_id, at (timestamp), attempt, hit, calls, tokens that takes what is there now and appends its changes to the table of totals at `path`.

    Keys are dealt to so many buckets by their hash; a batch rewrites the state of the buckets that it touches, so there should be some for each thousand of keys, and a checkpoint is resumed with the number that it began with.
    horizon_ms is the caller's word that two attempts on a query are never further apart: the state of a query goes once the watermark is past it, and an attempt after that counts as another query. Without it state is kept, a row a query and method.
    """
    spark = attempts.sparkSession
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    bucket = F.pmod(F.xxhash64(F.col("method").cast("string"), F.col("query_id").cast("string")), F.lit(buckets)).cast("int").alias("bucket")
    rows = attempts.where(F.col("at").isNotNull()).select(bucket, F.col("method").cast("string").alias("method"), F.col("query_id").cast("string").alias("query_id"), "at", F.unix_micros("at").alias("at_micros"), whole("attempt"), whole("hit").alias("hits"), whole("calls"), whole("tokens"))
    changes = rows.withWatermark("at", late).groupBy("bucket").transformWithStateInPandas(LastAttempt(horizon_ms), CHANGES, "Update", "EventTime")

    def batch(found: DataFrame, number: int) -> None:
        sums = found.groupBy("method").agg(*[F.sum(c).alias(c) for c in ("queries", "attempts", *FIGURES)])
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    # a stream takes the session's settings when it starts; batches without rows serve timers alone
    settings = {PROVIDER: ROCKSDB} | ({EMPTY_BATCHES: "false"} if horizon_ms is None else {})
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return changes.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGES + ", batch long").option("basePath", path).parquet(path)


def share(hits: Column, queries: Column) -> Column:
    return hits / F.nullif(queries, F.lit(0))


def totals(spark: SparkSession, path: str) -> DataFrame:
    """method, queries, attempts, hits, calls, tokens, recall after all batches so far."""
    sums = changes(spark, path).groupBy("method").agg(*[F.sum(c).alias(c) for c in ("queries", "attempts", *FIGURES)])
    return sums.withColumn("recall", share(F.col("hits"), F.col("queries")))


def running(spark: SparkSession, path: str) -> DataFrame:
    """The same after each batch: batch, method and totals up to it. A method has a row for each batch that held attempts of it."""
    so_far = Window.partitionBy("method").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch
    sums = changes(spark, path).select("batch", "method", *[F.sum(c).over(so_far).alias(c) for c in ("queries", "attempts", *FIGURES)])
    return sums.withColumn("recall", share(F.col("hits"), F.col("queries")))
