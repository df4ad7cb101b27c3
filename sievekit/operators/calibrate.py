"""Gate calibration: recombination of hits, sweeps, split halves, grid selection, leave-one-seed-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.operators.episodes import numbered


def grid(low: int, high: int, step: int, scale: float = 100.0) -> list[float]:
    """Thresholds from whole numbers, both ends in."""
    return [k / scale for k in range(low, high + 1, step)]


#: The thresholds of the post-hoc sweep.
SWEEP = (0.45, 0.50, 0.55, 0.60, 0.62, 0.64, 0.65, 0.66, 0.68, 0.70, 0.75, 0.80)


def with_grid(rows: DataFrame, cells: list[tuple]) -> DataFrame:
    """Each row with each (policy, threshold) of a grid that is given in the call: an explode, not a join."""
    return rows.withColumn("cell", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(float(t)).alias("threshold")) for p, t in cells]))).select("*", "cell.policy", "cell.threshold").drop("cell")


#: Names of policies. Ties between policies go by name, so they are part of results.
SCORE_POLICIES = ("score_only", "score_and_no_bm25_agreement", "score_or_no_bm25_agreement")
TOP1_POLICIES = ("top1_low", "top1_low_or_no_bm25_agreement")
MARGIN_POLICIES = ("margin_low", "margin_low_or_no_bm25_agreement")
CONCENTRATION_POLICIES = ("concentration_low",)


def policy_expands(policy: Column, threshold: Column) -> Column:
    """Rows top1, margin, concentration, agrees -> whether a policy expands; null for an unknown policy. The first part of a name says what has to be low, the rest how disagreement counts."""
    low = F.when(policy.startswith("margin"), F.col("margin") < threshold).when(policy.startswith("concentration"), F.col("concentration") < threshold).when(policy.startswith("score") | policy.startswith("top1"), F.col("top1") < threshold)
    apart = ~F.col("agrees")
    return F.when(policy.endswith("_or_no_bm25_agreement"), low | apart).when(policy.endswith("_and_no_bm25_agreement"), low & apart).otherwise(low)


def evaluated(rows: DataFrame, cells: list[tuple], by: list[str]) -> DataFrame:
    """rows hit_a (base), hit_b (expanded), hit10_a, hit10_b -> by, policy, threshold, recall, recall10, expansion, n."""
    out = with_grid(rows, cells).withColumn("expand", policy_expands(F.col("policy"), F.col("threshold")))
    pick = lambda a, b: F.when(F.col("expand"), F.col(b)).otherwise(F.col(a)).cast("double")
    return out.groupBy(*by, "policy", "threshold").agg(F.avg(pick("hit_a", "hit_b")).alias("recall"), F.avg(pick("hit10_a", "hit10_b")).alias("recall10"), F.avg(F.col("expand").cast("double")).alias("expansion"), F.count("*").alias("n"))


def split_half(rows: DataFrame, by: str, key: str) -> DataFrame:
    """rows with part: train for the first floor(n / 2) of each group in the order of the key, test for the rest. Rows are numbered by ranges of both, so a large group is not sorted in one task."""
    placed = numbered(rows, [by, key])
    groups = placed.groupBy(by).agg(F.min("number").alias("__first"), F.count("*").alias("__n"))
    part = F.when(F.col("number") - F.col("__first") < F.floor(F.col("__n") / 2), "train").otherwise("test")
    return placed.join(groups, by).withColumn("part", part).select(*[F.col(f"`{c}`") for c in rows.columns], "part")


def chosen(scored: DataFrame, by: list[str], order: list[Column], budget: float | None = None) -> DataFrame:
    """The first cell of each group; with a budget, cells within it come before all others."""
    inside = [F.desc(F.round("expansion", 9) <= budget)] if budget is not None else []
    place = Window.partitionBy(*by).orderBy(*inside, *order)
    return scored.withColumn("place", F.row_number().over(place)).where("place = 1").drop("place")


def by_recall(*more: Column) -> list[Column]:
    return [F.desc(F.round("recall", 9)), *more]


def leave_one_out(scored: DataFrame, key: str = "seed") -> DataFrame:
    """Per-seed sums of cells to the sums of all other seeds: test_seed, policy, threshold, recall, expansion. The total less the own part, instead of a join of seeds with seeds."""
    cell = Window.partitionBy("policy", "threshold")
    rest = lambda c: (F.sum(F.col(c) * F.col("n")).over(cell) - F.col(c) * F.col("n")) / (F.sum("n").over(cell) - F.col("n"))
    return scored.select(F.col(key).alias("test_seed"), "policy", "threshold", rest("recall").alias("recall"), rest("expansion").alias("expansion"))
