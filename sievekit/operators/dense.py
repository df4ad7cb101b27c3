"""Exact dense retrieval: vectors, hashed text vectors, top-k by inner product in blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.functions.hashing import md5_52
from sievekit.functions.ranks import dot
from sievekit.functions.text import lowered, split_words
from sievekit.operators.blocks import floor_of, id_ranks, kth_of, ranked, streamed, where

BUCKETS = 64
#: Rows of a block, and its numbers at most; a product is of PRODUCT_ROWS queries and TILE_ROWS rows, which stay in a core's cache.
BLOCK_ROWS, BLOCK_CELLS, PRODUCT_ROWS, TILE_ROWS = 131_072, 1 << 22, 512, 2_048


def unit(vector: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def hashed_vectors(texts: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """key, embedding: counts of token hashes, normalised. Stands in for a model where none can be loaded. Texts without tokens have none. Counted in one pass over a row's tokens: no shuffle."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first in range(0, batch.num_rows, 1_000):
                ids, lists = batch.column(0).slice(first, 1_000), split_words(batch.column(1).slice(first, 1_000))
                coded, sizes = lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())
                places = md5_52(coded.dictionary) % buckets  # a word is hashed once
                met = np.flatnonzero(sizes)
                cells = np.repeat(np.arange(len(met)), sizes[met]) * buckets + places[coded.indices.to_numpy(zero_copy_only=False)]
                counts = np.bincount(cells, minlength=len(met) * buckets).reshape(len(met), buckets).astype(np.float64)
                vectors = counts / np.sqrt((counts**2).sum(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(met)), pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), buckets).cast(pa.list_(pa.float64()))], names=[key, "embedding"])

    return texts.select(key, lowered(F.col(text)).alias("text")).mapInArrow(counted, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>")


def modelled_vectors(texts: DataFrame, model: Callable, key: str = "doc_id", text: str = "text", batch_rows: int = 64) -> DataFrame:
    """key, embedding by a model: model() is called once a task (it loads what it needs there) and gives a function from a list of texts to a table of vectors, one a text. Vectors are normalised; null texts are empty ones."""

    def embedded(batches):
        import numpy as np
        import pyarrow as pa

        encode = model()
        for batch in batches:
            for first in range(0, batch.num_rows, batch_rows):
                part = batch.slice(first, batch_rows)
                raw = np.asarray(encode([t or "" for t in part.column(1).to_pylist()]), dtype=np.float64)
                if raw.shape[:1] != (part.num_rows,) or raw.ndim != 2:
                    raise ValueError(f"the model gave an array of shape {raw.shape} for {part.num_rows} texts")
                norms = np.linalg.norm(raw, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(np.divide(raw, norms, out=np.zeros_like(raw), where=norms > 0)), pa.list_(pa.float64()))], names=[key, "embedding"])

    return texts.select(key, F.col(text).cast("string").alias("text")).mapInArrow(embedded, f"{key} {texts.schema[key].dataType.simpleString()}, embedding array<double>")


def tabled_vectors(texts: DataFrame, table: DataFrame, key: str = "doc_id", table_key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, embedding from a table of vectors computed before, normalised; texts that it lacks have none."""
    held = table.select(F.col(table_key).alias(key), F.col(vector).cast("array<double>").alias("raw")).where("raw is not null")
    return texts.select(key).join(held, key).select(key, unit(F.col("raw")).alias("embedding"))


def _products(k: int):
    def matrix(column):
        import numpy as np

        lists = column.combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)

    def build(block):
        import numpy as np
        import pyarrow as pa

        base, ids = matrix(block["v"]), id_ranks(block["doc_id"].combine_chunks())
        longest = float(np.sqrt(np.einsum("ij,ij->i", base, base).max()))
        plain = not longest < 1e15  # no products in single precision
        tiles = [np.ascontiguousarray(base[first : first + TILE_ROWS].T, dtype=np.float64 if plain else np.float32) for first in range(0, len(base), TILE_ROWS)]

        def answer(asked):
            queries, at, found, scores = matrix(asked["v"]), [], [], []
            for first in range(0, len(queries), PRODUCT_ROWS):
                part = queries[first : first + PRODUCT_ROWS]
                lengths = np.sqrt((part**2).sum(axis=1))
                exact = plain or not lengths.max() < 1e15
                # near scores leave out what cannot be among the k best, whatever the rounding; scores of the others are made in doubles
                narrow = part if exact else part.astype(np.float32)
                eps = float(np.finfo(np.result_type(narrow, tiles[0])).eps)
                margin = 2 * (base.shape[1] + 4) * eps * lengths * longest + 4e-9 + eps * lengths * longest
                least, met, kept = None, 0, []
                for j, tile in enumerate(tiles):
                    near = narrow @ tile
                    if least is None:
                        least = (floor_of(near, k) - margin).astype(near.dtype)
                    rows, places = np.divmod(where((near >= least[:, None]).ravel()), near.shape[1])
                    kept.append((rows, places + j * TILE_ROWS, near[rows, places]))
                    # the k-th largest so far, looked up whenever rows are four times as many
                    if j + 1 >= 4 * met or j + 1 == len(tiles):
                        met, (rows, places, some) = j + 1, (np.concatenate(x) for x in zip(*kept))
                        least = np.maximum(least, (kth_of(rows, some, len(part), k) - margin).astype(near.dtype))
                        held = np.flatnonzero(some >= least[rows])
                        kept = [(rows[held], places[held], some[held])]
                rows, places, _ = kept[0]
                sums = np.round(np.einsum("ij,ij->i", part[rows], base[places]), 12)
                order = np.lexsort((ids[places], -np.round(sums, 9), rows))
                rows = rows[order]
                best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                at.append(rows[best] + first)
                found.append(places[order][best])
                scores.append(sums[order][best])
            return np.concatenate(at), np.concatenate(found), np.concatenate(scores)

        return answer

    return build


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """vectors doc_id, embedding; queries query_id, vector, all of one length -> query_id, doc_id, score, rank: the k largest inner products, ties to the smaller doc_id. Rows without a vector take no part. With a column part on both sides, queries meet their own part only."""
    part = ["part"] if "part" in vectors.columns else []
    held = vectors.where("embedding is not null").select(*part, "doc_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.where("vector is not null").select(*part, "query_id", F.col("vector").cast("array<double>").alias("v"))
    one = asked.select(F.size("v").alias("n")).first()  # all have one length
    rows = min(BLOCK_ROWS, max(1_024, BLOCK_CELLS // max(1, one.n))) if one else BLOCK_ROWS
    return ranked(streamed(held, asked, rows, _products(k), ["v"]), k)
