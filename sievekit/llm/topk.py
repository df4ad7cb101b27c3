"""Exact top-k by inner product: no-random-access aggregation over sorted lists, in blocks.

Each slice of candidates keeps one list a dimension, sorted by component. A query reads list d from its top (or from its bottom,
where the query's component is negative), so that its contributions only fall. What a candidate has been met with so far is summed, a list that it
was not met in yet adds the contribution that was read last at most and the list's last entry at least. That gives every candidate an upper and a
lower bound. Candidates stand in a buffer of a few times k; reading stops when no outsider can qualify, that is when all whose upper bound reaches
the k-th score found so far and the k-th lower bound fit in it. Only then are scores resolved, those in the buffer. Where bounds never part
that far, as for many ties at the k-th place, the last step reads every list to its end. Slices of a block grow, so that the first one gives the
next a score to beat.

Queries are read together (`Block.search_all`): all lists are open to the same depth, so one cut table of a slice, with what was not read yet at the value that was read last, gives the bounds of many queries by one
product. Queries that have stopped leave; the others go on to the next depth. `Block.search` is the same for a single query, with lists read down to a common contribution, the frontier, which falls in steps.

Candidates are dealt to blocks once, by a hash: one task a block, and enough blocks for all cores. Every query goes to every block, where it is one row: queries stream past a block
that a task holds (BLOCK_ROWS candidates), k rows a query come out, and a last ranking merges them. Queries are so much of the table as the caller
says, hence rows shuffled are candidates + queries * blocks.

Vectors that are null, empty, or hold a null or non-finite component take no part; neither do rows with a
null id. Vectors are compared with those of the same length. Rows that repeat an id are candidates each,
but never for a query of the same id; a query id that repeats is answered once for each of its rows,
merged. Components are floor(scale * x) as 64-bit integers; scores must fit in 2^53. Ties go to the smaller id.
Empty tables give no rows. Columns of any other name are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384
#: Rows of the slices that a block is read in: the last holds the rest.
SLICES = (1_024,)
#: The frontiers of successive steps, in parts of the mean top of a query's lists. One more step reads what is left.
FRONTIERS = (0.25, 0.1, 0.0, -0.1, -0.25, -0.5)
#: Candidates that the buffer holds, in times k, whatever the number of rows.
BUFFER = 8
#: The depths to which queries that are read together open the lists, in parts of a slice. One more step reads what is left.
DEPTHS = (0.0625, 0.25, 0.5)
#: Queries that are read together.
QUERY_ROWS = 256


def integer_vectors(table: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v (array<long>) of the rows that take part."""
    raw = F.col(f"`{vector}`")
    fine = raw.isNotNull() & (F.size(raw) > 0) & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return table.where(F.coalesce(fine, F.lit(False)) & F.col(f"`{vec_id}`").isNotNull()).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(raw, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class SortedLists:
    """A slice of candidates with one sorted list a dimension."""

    def __init__(self, ids, values):
        import numpy as np

        self.ids, self.values = ids, values.astype(np.float64)
        self.order = np.ascontiguousarray(np.argsort(self.values, axis=0, kind="stable").T)
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.values.T, self.order, axis=1))
        self.most, self.places = float(np.abs(self.values).max()), {}
        for j, i in enumerate(ids.tolist()):
            self.places.setdefault(i, []).append(j)

    def depths(self, query, frontier: float):
        """How many entries of each list contribute more than the frontier: a binary search in all lists at once."""
        import numpy as np

        n, rows = len(self.ids), np.arange(len(query))
        # read from the top where the component is positive: the place of an entry that is k-th to be read
        low, high = np.zeros(len(query), dtype=np.int64), np.where(query != 0, n, n if frontier < 0 else 0)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            at = np.where(query >= 0, n - 1 - middle, middle)
            more = open_ & (self.sorted[rows, np.clip(at, 0, n - 1)] * query > frontier)
            low, high = np.where(more, middle + 1, low), np.where(open_ & ~more, middle, high)
        return low

    def entries(self, query, first, last):
        """(row numbers, contributions, list numbers) of the entries from place first to place last of each list as the query reads it."""
        import numpy as np

        n = len(self.ids)
        spans = [(d, n - b, n - a) if q >= 0 else (d, a, b) for d, (q, a, b) in enumerate(zip(query.tolist(), first.tolist(), last.tolist())) if b > a]
        rows = np.concatenate([self.order[d, a:b] for d, a, b in spans])
        lists = np.repeat([d for d, _, _ in spans], [b - a for _, a, b in spans])
        return rows, np.concatenate([self.sorted[d, a:b] for d, a, b in spans]) * query[lists], lists

    def search(self, query, own: int, k: int, best: list[tuple[float, int]]) -> tuple[list[tuple[float, int]], int]:
        """The k best (-score, id) of best and this slice, and how many entries were read."""
        import numpy as np

        n, dims = self.values.shape
        tops = query * np.where(query >= 0, self.sorted[:, -1], self.sorted[:, 0])
        floors = query * np.where(query >= 0, self.sorted[:, 0], self.sorted[:, -1])
        seen, met, sunk, depth = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(dims, dtype=np.int64)
        others = self.ids != own
        alive, unit = np.flatnonzero(others), float(np.abs(tops).mean())
        for frontier in (*(unit * part for part in FRONTIERS), float(floors.min()) - 1.0):
            if len(alive) <= BUFFER * k:
                break
            reached = np.maximum(depth, self.depths(query, frontier))
            if (reached > depth).any():
                rows, gained, lists = self.entries(query, depth, reached)
                seen += np.bincount(rows, gained, n)
                met += np.bincount(rows, minlength=n)
                sunk += np.bincount(rows, floors[lists], n)
                depth = reached
            # a list that was read shows the frontier at most from here on, another one its top
            upper = seen - met * frontier + np.minimum(tops, frontier).sum()
            bound = -best[k - 1][0] if len(best) >= k else -math.inf
            if others.sum() >= k:
                lower = (seen - sunk + floors.sum())[others]
                bound = max(bound, np.partition(lower, len(lower) - k)[len(lower) - k])
            alive = alive[upper[alive] >= bound - 1e-6]
        scores = self.values[alive] @ query
        if len(scores) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[scores >= kth], scores[scores >= kth]
        return sorted([*best, *zip((-scores).tolist(), self.ids[alive].tolist())])[:k], int(depth.sum())

    def search_all(self, queries, owns, k: int, best: list[list[tuple[float, int]]]) -> tuple[list[list[tuple[float, int]]], list[int]]:
        """search() of many queries at once, a row each: what is best with this slice, and how many entries were read."""
        import numpy as np

        n, dims = self.values.shape
        # sums of whole numbers below 2^24 are exact in single precision, those below 2^53 in double
        kind = np.float32 if dims * self.most * float(np.abs(queries).max(initial=0)) < 1 << 24 else np.float64
        values, asked = self.values.astype(kind, copy=False), queries.astype(kind)
        up, down = np.maximum(asked, 0), np.minimum(asked, 0)
        product = lambda who, tops, bottoms: up[who] @ tops.T + down[who] @ bottoms.T
        known = np.array([-found[k - 1][0] if len(found) >= k else -math.inf for found in best])
        own = [self.places.get(i, []) for i in owns]
        out, read, open_ = list(best), [0] * len(queries), np.arange(len(queries))
        for part in (*DEPTHS, 1.0):
            depth = min(n, math.ceil(part * n))
            ended = depth == n or n <= BUFFER * k
            if ended:
                upper = asked[open_] @ values.T
                bound = known[open_]
            else:
                top, bottom = self.sorted[:, n - depth].astype(kind), self.sorted[:, depth - 1].astype(kind)
                upper, bound = product(open_, np.maximum(values, top), np.minimum(values, bottom)), known[open_]
                if np.isinf(bound).any():
                    lower = product(open_, np.where(values >= top, values, self.sorted[:, 0].astype(kind)), np.where(values <= bottom, values, self.sorted[:, -1].astype(kind)))
                    bound = np.maximum(bound, self.kth(lower, open_, own, k))
            for row, q in enumerate(open_.tolist()):
                upper[row, own[q]] = -math.inf
            if ended:
                bound = np.maximum(bound, self.kth(upper, open_, own, k)) if np.isinf(bound).any() else bound
            reached = upper >= bound[:, None].astype(kind)
            if not ended:
                stopped = reached.sum(axis=1) <= BUFFER * k
            for row in range(len(open_)) if ended else np.flatnonzero(stopped):
                q = int(open_[row])
                alive = np.flatnonzero(reached[row])
                alive = alive[~np.isin(alive, own[q])] if own[q] else alive
                scores = upper[row, alive].astype(np.float64) if ended else self.values[alive] @ queries[q]
                if len(alive) > k:
                    kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                    alive, scores = alive[scores >= kth], scores[scores >= kth]
                out[q] = sorted([*best[q], *zip((-scores).tolist(), self.ids[alive].tolist())])[:k]
                read[q] = depth * int(np.count_nonzero(queries[q])) if not ended else n * dims
            open_ = open_[:0] if ended else open_[~stopped]
            if not len(open_):
                break
        return out, read

    def kth(self, scores, open_, own, k: int):
        """The k-th largest score of each row without the query's own ones; minus infinity where there are fewer."""
        import numpy as np

        scores = scores.copy()
        for row, q in enumerate(open_.tolist()):
            scores[row, own[q]] = -math.inf
        n = scores.shape[1]
        return np.partition(scores, n - k, axis=1)[:, n - k] if n >= k else np.full(len(scores), -math.inf)


class Block:
    """The candidates of one block and length, in growing slices."""

    def __init__(self, ids, values):
        ends = [0]
        while ends[-1] < len(ids):
            ends.append(min(len(ids), ends[-1] + SLICES[len(ends) - 1]) if len(ends) <= len(SLICES) else len(ids))
        self.slices = [SortedLists(ids[a:b], values[a:b]) for a, b in zip(ends, ends[1:])]

    def search(self, query, own: int, k: int) -> tuple[list[tuple[float, int]], int]:
        best, read = [], 0
        for lists in self.slices:
            best, more = lists.search(query, own, k, best)
            read += more
        return best, read

    def search_all(self, queries, owns: list[int], k: int) -> tuple[list[list[tuple[float, int]]], list[int]]:
        best, read = [], []
        for first in range(0, len(queries), QUERY_ROWS):
            found, entries = [[] for _ in owns[first : first + QUERY_ROWS]], 0
            for lists in self.slices:
                found, more = lists.search_all(queries[first : first + QUERY_ROWS], owns[first : first + QUERY_ROWS], k, found)
                entries = [a + b for a, b in zip(entries or [0] * len(more), more)]
            best, read = best + found, read + entries
        return best, read


def _searched(k: int):
    """Rows b, size, asks, vec_id, v sorted by the first three: the candidates of a block, then the queries that are asked of it."""

    def search(batches):
        import numpy as np
        import pyarrow as pa

        now, ids, rows, block = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            first = 0
            for last in range(1, len(keys) + 1):
                if last < len(keys) and keys[last] == keys[first]:
                    continue
                (b, size, asks), part = keys[first], batch.slice(first, last - first)
                first = last
                if now != (b, size):
                    now, ids, rows, block = (b, size), [], [], None
                who, vectors = part.column(3).to_numpy(), part.column(4).flatten().to_numpy().reshape(-1, size)
                if not asks:
                    ids.append(who)
                    rows.append(vectors)
                elif ids:
                    if block is None:
                        block, rows = Block(np.concatenate(ids), np.concatenate(rows)), []
                    best, read = block.search_all(vectors.astype(np.float64), who.tolist(), k)
                    out = [(q, other, -int(negative), entries) for q, found, entries in zip(who.tolist(), best, read) for negative, other in found]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(4)], names=["query_id", "vec_id", "score", "entries_read"])

    return search


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row that is_query holds for, the k best other rows of the table."""
    vectors, asked = integer_vectors(table, vec_id, vector, scale), integer_vectors(table.where(is_query), vec_id, vector, scale)
    n = vectors.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS), min(table.sparkSession.sparkContext.defaultParallelism, math.ceil(n / SLICES[0])))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    held = vectors.select(number.alias("b"), F.size("v").alias("size"), F.lit(False).alias("asks"), "vec_id", "v")
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.size("v").alias("size"), F.lit(True).alias("asks"), "vec_id", "v")
    dealt = held.unionByName(queries).repartitionById(blocks, "b").sortWithinPartitions("b", "size", "asks", "vec_id")
    found = dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long, entries_read long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
