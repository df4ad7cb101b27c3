"""Streams that are stopped and resumed, against SQL over all of their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.plans.fixtures import scratch, table
from sievekit.plans.registry import query
from sievekit.streaming import evaluation

RUN = "method string, query_id string, at timestamp, attempt long, hit long, calls long, tokens long"

ATTEMPTS = """t AS (SELECT *, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL), ends AS (SELECT min(us) AS lo, max(us) AS hi FROM t),
a AS (SELECT event_type AS method, user_id AS query_id, us, event_id, CAST(value >= 10 AS BIGINT) AS hit, event_id % 4 AS calls, CAST(floor(value * 10) AS BIGINT) AS tokens,
  (6 * (us - lo)) // (hi - lo + 1) AS part FROM t, ends)"""


@query("stream_eval", f"""WITH {ATTEMPTS}, kept AS (SELECT * FROM a WHERE NOT (part = 0 AND event_id % 10 = 3)),
last AS (SELECT *, count(*) OVER (PARTITION BY method, query_id) AS n FROM kept QUALIFY row_number() OVER (PARTITION BY method, query_id ORDER BY us DESC, event_id DESC) = 1)
SELECT method, count(*) AS queries, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(hit) / count(*)::DOUBLE, 6) AS recall FROM last GROUP BY method""")
def stream_eval(spark, sf_dir):
    """Events as attempts on queries (a user) by methods (a type), in three runs of one stream that is stopped after each; a tenth of the earliest sixth comes with the last run, past the watermark, and is dropped."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events").where("ts is not null").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    part = F.expr(f"(6 * (us - {lo})) div {hi - lo + 1}")
    run = F.when((part == 0) & (F.col("event_id") % 10 == 3), 2).otherwise(F.floor(part / 2))
    attempts = events.select(F.col("event_type").alias("method"), F.col("user_id").cast("string").alias("query_id"), F.timestamp_micros("us").alias("at"), F.col("event_id").alias("attempt"), (F.col("value") >= 10).cast("long").alias("hit"), (F.col("event_id") % 4).alias("calls"), F.floor(F.col("value") * 10).alias("tokens"), run.alias("run"))
    for k in range(3):
        attempts.where(F.col("run") == k).drop("run").write.mode("append").parquet(f"{path}/attempts")
        stream = spark.readStream.schema(RUN).parquet(f"{path}/attempts")
        evaluation.evaluate_stream(stream, f"{path}/totals", f"{path}/checkpoint", "1 hour").awaitTermination()
    return evaluation.totals(spark, f"{path}/totals").withColumn("recall", F.round("recall", 6))
