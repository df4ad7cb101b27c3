"""Every query against all rows, in blocks: rows are dealt to blocks of bounded size once, and queries stream past the block that a task holds.

Rows shuffled are rows + queries * blocks. A task holds one block and one batch of queries; a block gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a few short columns that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A block of fewer rows than this is not worth a task of its own.
SMALL_BLOCK = 1_024
#: Blocks in a shuffle are no more tasks than this.
MOST_TASKS = 10_000
#: Groups that entries are dealt to for a bound of the k-th largest.
GROUPS = 512


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has no more than so many rows (it is read to find out), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def block_count(spark: SparkSession, rows: Column, most: int) -> Column:
    """In how many blocks of up to `most` rows a table is dealt: enough to keep all cores busy while blocks are not small."""
    cores = F.least(F.lit(spark.sparkContext.defaultParallelism), F.ceil(rows / F.least(F.lit(SMALL_BLOCK), F.lit(most))))
    return F.greatest(F.lit(1), cores, F.ceil(rows / most)).cast("long")


def own_task(df: DataFrame, part: str, block: str, total: int) -> DataFrame:
    """Rows dealt to tasks by block number: the blocks of a part, which are numbered from 0, are a task each; total is their number over all parts."""
    tasks = max(1, min(int(total), MOST_TASKS))
    return df.repartitionById(tasks, F.pmod(F.xxhash64(part) % tasks + F.col(block), F.lit(tasks)).cast("int"))


def streamed(rows: DataFrame, queries: DataFrame, block_rows: int, build: Callable, columns: list[str]) -> DataFrame:
    """rows doc_id, queries query_id, both with the other columns, and with part where queries meet the rows of their own part only -> query_id, doc_id, score.

    build(record batch of the block's rows) -> answer(record batch of queries) -> (positions in the query batch, positions in the block, scores) as arrays.
    """
    kind = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *queries.schema.fields]}
    part = lambda df: F.coalesce(F.col("part").cast("string"), F.lit("")) if "part" in df.columns else F.lit("")
    none = lambda name: F.lit(None).cast(kind[name]).alias(name)
    held, asked = rows.select(part(rows).alias("part"), "doc_id", *columns), queries.select(part(queries).alias("part"), "query_id", *columns)
    counted = held.groupBy("part").agg(F.count("*").alias("n")).select("part", block_count(rows.sparkSession, F.col("n"), block_rows).alias("blocks")).cache()
    total, blocks = counted.agg(F.sum("blocks")).first()[0] or 1, F.broadcast(counted)  # a row a part
    held = held.join(blocks, "part").select("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("b"), F.lit(False).alias("asks"), "doc_id", none("query_id"), *columns)
    asked = asked.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"), F.lit(True).alias("asks"), none("doc_id"), "query_id", *columns)
    dealt = own_task(held.unionByName(asked), "part", "b", total).select(F.concat_ws(":", "b", "part").alias("b"), "asks", "doc_id", "query_id", *columns).sortWithinPartitions("b", "asks")
    return dealt.mapInArrow(_answered(build), f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")


def _answered(build: Callable):
    def answered(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        now, parts, block, answer = None, [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for b in pc.unique(batch.column(0)).to_pylist():
                own = table.filter(pc.equal(table["b"], b))
                if now != b:
                    now, parts, block, answer = b, [], None, None
                rows, asked = own.filter(pc.invert(own["asks"])), own.filter(own["asks"])
                if rows.num_rows:
                    parts.append(rows)
                if not asked.num_rows or not parts and block is None:
                    continue
                if block is None:
                    block, parts = pa.concat_tables(parts).combine_chunks(), []
                    answer = build(block)
                at, place, scores = answer(asked.combine_chunks())
                yield pa.RecordBatch.from_arrays([asked["query_id"].combine_chunks().take(pa.array(at)), block["doc_id"].combine_chunks().take(pa.array(place)), pa.array(scores, pa.float64())], names=["query_id", "doc_id", "score"])

    return answered


def first_k(scores, ids, k: int):
    """Positions of the k largest rounded scores, ties to the smaller id; ids are ranks of ids in their order."""
    import numpy as np

    rounded = np.round(scores, 9)
    if len(rounded) > k:
        least = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
        at = np.flatnonzero(rounded >= least)
    else:
        at = np.arange(len(rounded))
    return at[np.lexsort((ids[at], -rounded[at]))][:k]


def floor_of(scores, k: int):
    """What at least k of the scores reach (of each row, if there are rows), close to the k-th largest: the k-th of the largest of GROUPS groups, which are k different entries. Minus infinity where there are fewer than k scores."""
    import numpy as np

    n = scores.shape[-1]
    if n >= 2 * GROUPS and k <= GROUPS // 4:
        whole = scores[..., : n // GROUPS * GROUPS]
        scores = whole.reshape(*whole.shape[:-1], -1, GROUPS).max(axis=-2)
    if scores.shape[-1] < k:
        return np.full(scores.shape[:-1], -np.inf)[()]
    return np.partition(scores, scores.shape[-1] - k)[..., scores.shape[-1] - k]


def kth_of(rows, scores, n: int, k: int):
    """Of the scores of n rows, one after the other in any order, the k-th largest of each row; minus infinity where there are fewer."""
    import numpy as np

    order = np.lexsort((-scores, rows))
    firsts = np.searchsorted(rows[order], np.arange(n + 1))
    found = np.full(n, -np.inf)
    whole = np.flatnonzero(np.diff(firsts) >= k)
    found[whole] = scores[order[firsts[whole] + k - 1]]
    return found


def where(found):
    """Places of the few that hold."""
    import numpy as np

    whole = len(found) // 8 * 8
    at = (np.flatnonzero(found[:whole].view("u8"))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[found[at]], np.flatnonzero(found[whole:]) + whole])


def id_ranks(column):
    """For an Arrow column of ids, the place of each in their order."""
    import numpy as np
    import pyarrow.compute as pc

    order = pc.sort_indices(column).to_numpy()
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def ranked(scores: DataFrame, k: int, key: str = "query_id", item: str | Column = "doc_id") -> DataFrame:
    """The k best of each key by rounded score, ties to the smaller item; adds rank."""
    # as whole numbers, which cost no decimal text a row, where doubles hold them
    rounded = F.when(F.abs("score") < 1e6, F.rint(F.col("score") * 1e9)).otherwise(F.round("score", 9) * 1e9)
    order = Window.partitionBy(key).orderBy(F.desc(rounded), item)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
