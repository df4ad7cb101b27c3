"""Functions of ranked lists: hits, ranks, reciprocal ranks, gate features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def target(target_id: Column, fallback: Column) -> Column:
    """target_id unless it is null or empty, else the fallback."""
    return F.coalesce(F.when(target_id != "", target_id), fallback)


def hit_at(ids: Column, wanted: Column, k: int) -> Column:
    """Whether the wanted id is among the first k; a missing list or id is a miss."""
    return F.coalesce(F.array_contains(F.slice(ids, 1, k), wanted), F.lit(False))


def target_rank(ids: Column, wanted: Column, depth: int = 10) -> Column:
    """The place of the first occurrence as text, or '>depth'."""
    place = F.coalesce(F.array_position(ids, wanted), F.lit(0))
    return F.when(place > 0, place.cast("string")).otherwise(F.lit(f">{depth}"))


def reciprocal_rank(ids: Column, wanted: Column) -> Column:
    place = F.coalesce(F.array_position(ids, wanted), F.lit(0)).cast("double")
    return F.when(place > 0, 1 / place).otherwise(F.lit(0.0))


def margin(scores: Column) -> Column:
    """First less second score; 0 with fewer than two."""
    return F.when(F.size(scores) > 1, F.get(scores, F.lit(0)) - F.get(scores, F.lit(1))).otherwise(F.lit(0.0))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def concentration(scores: Column, depth: int = 5) -> Column:
    """1 less the entropy of the softmax of the first scores over its maximum; 1 for a single score."""
    top = F.slice(scores, 1, depth)
    entropy = F.aggregate(softmax(top), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0)))
    return F.when(F.size(top) < 2, F.lit(1.0)).otherwise(1 - entropy / F.log(F.size(top).cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Inner product in index order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tolerance(a: Column, b: Column, most: float = 1e-9) -> Column:
    """Whether two numbers differ by more than `most`, or only one is missing."""
    return F.when(a.isNull() & b.isNull(), False).otherwise(F.coalesce(F.abs(a - b) > most, F.lit(True)))


LOG2 = math.log(2)
