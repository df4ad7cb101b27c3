"""Fitting on a bounded sample of labelled rows: which rows may teach, and small dense models in numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, on average of the hash that picks them.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 4, 2


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id is in no fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def teachable(labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, y of the labelled rows outside the held-out fold, thinned by a hash of the id to about `rows` of them. Ids that repeat count once, with their mean label."""
    known = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"))
    part = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, y of the sample; it is bounded, so it is broadcast."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(teachable(labels, label, rows)), "doc_id")


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x, y, ridge: float = 1.0, lasso: float = 0.0, weights=None, steps: int = 400):
    """(intercept, coefficients) of a logistic regression on soft labels y, by accelerated proximal gradient on standardised columns."""
    import numpy as np

    n, d = x.shape
    if not n:
        return 0.0, np.zeros(d)
    weights = np.ones(n) if weights is None else weights
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(n), (x - mean) / scale])
    total = weights.sum()
    step = 4 / (np.linalg.norm(z * np.sqrt(weights / total)[:, None], 2) ** 2 + 4 * ridge / total)
    b = a = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        grad = z.T @ (weights * (sigmoid(z @ a) - y)) / total
        grad[1:] += ridge / total * a[1:]
        new = a - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * lasso, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        a, b, t = new + (t - 1) / t_new * (new - b), new, t_new
    coefficients = b[1:] / scale
    return float(b[0] - coefficients @ mean), coefficients


def linear_score(intercept: float, terms: list[tuple[float, Column]]) -> Column:
    """The logistic function of a linear form, as a Column."""
    form = F.lit(float(intercept))
    for weight, column in terms:
        form = form + F.lit(float(weight)) * column
    return 1 / (1 + F.exp(-F.greatest(F.least(form, F.lit(40.0)), F.lit(-40.0))))
