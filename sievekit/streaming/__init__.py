"""Extension: queries that arrive as a stream, answered once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from sievekit.sources.writers import append_new


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: list[str]):
    """Starts a stream that answers each micro-batch and appends the answers whose keys are not in the table yet, so that a batch that runs twice changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        append_new(answer(rows), path, keys)

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
