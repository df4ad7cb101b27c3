"""Resampling inference with draws that depend on replicate and name only. The three paired procedures differ on purpose.

Resampled columns are hits or differences of hits: a resample is known by how often it holds each value, which is a multinomial draw on the
counts of the values. Rows are read once, for these counts; replicates cost a binomial draw a value. A draw takes the same time and memory for any
number of rows: transformed rejection with squeeze (Hoermann's BTRS) where the mean is 10 or more, inversion below. Its uniform numbers are hashes
of name, replicate, step and try, so a draw is the same in any partition and order. Everything is one expression a replicate: no join, no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.hashing import two_uniforms

#: Replicates of the reference: intervals of one method, paired bootstraps, gate intervals and sign flips.
CI_DRAWS, PAIR_DRAWS, GATE_DRAWS = 2_000, 5_000, 10_000
#: Different values that a resampled column may have.
MOST_VALUES = 64
#: Rejection from this mean on. Below it no draw is over MOST_SMALL, but with chance 1e-70.
LEAST_MEAN, MOST_SMALL = 10, 110
#: A try is accepted with a chance of 0.7 at least, so that all fail with chance 1e-33; the mode is taken then.
TRIES = 64
#: log(k!) less (k + 1/2) log(k + 1) - (k + 1) + log(2 pi) / 2, for k under 10; a series beyond.
STIRLING = [math.lgamma(k + 1) - (k + 0.5) * math.log(k + 1) + (k + 1) - 0.5 * math.log(2 * math.pi) for k in range(10)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def correction(k: Column) -> Column:
    """What Stirling's formula for k! is short of."""
    square = (k + 1) * (k + 1)
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - F.lit(1 / 1260) / square) / square) / (k + 1)
    return F.when(k < 10, F.get(F.array(*map(F.lit, STIRLING)), k.cast("int"))).otherwise(series)


def _rejected(n: Column, p: Column, names: list) -> Column:
    """A draw for n p >= LEAST_MEAN and p <= 1/2, in doubles that hold whole numbers."""
    scale = F.struct(n.alias("n"), (p / (1 - p)).alias("r"), F.floor((n + 1) * p).cast("double").alias("m"), (n * p + 0.5).alias("c"), F.sqrt(n * p * (1 - p)).alias("s"), p.alias("p"))

    def with_scale(x: Column) -> Column:
        b = 1.15 + 2.53 * x["s"]
        width = F.struct(b.alias("b"), (-0.0873 + 0.0248 * b + 0.01 * x["p"]).alias("a"), (0.92 - 4.2 / b).alias("squeeze"), ((2.83 + 5.1 / b) * x["s"]).alias("alpha"), ((x["m"] + 0.5) * F.log((x["m"] + 1) / (x["r"] * (x["n"] - x["m"] + 1))) + correction(x["m"]) + correction(x["n"] - x["m"])).alias("top"))
        return let(width, lambda y: F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), lambda k, t: F.when(k.isNotNull(), k).otherwise(tried(x, y, t)), lambda k: F.coalesce(k, x["m"])))

    def tried(x: Column, y: Column, t: Column) -> Column:
        one, two = two_uniforms(*names, t)
        point = F.struct((one - 0.5).alias("u"), (0.5 - F.abs(one - 0.5)).alias("us"), two.alias("v"))

        def placed(z: Column) -> Column:
            return let(F.floor((2 * y["a"] / z["us"] + y["b"]) * z["u"] + x["c"]).cast("double"), lambda k: F.when((z["us"] >= 0.07) & (z["v"] <= y["squeeze"]), k).when((k >= 0) & (k <= x["n"]) & (F.log(z["v"] * y["alpha"] / (y["a"] / (z["us"] * z["us"]) + y["b"])) <= height(k)), k))

        def height(k: Column) -> Column:
            rest = x["n"] - k + 1
            return y["top"] + (x["n"] + 1) * F.log1p((k - x["m"]) / rest) + (k + 0.5) * F.log(x["r"] * rest / (k + 1)) - correction(k) - correction(x["n"] - k)

        return let(point, placed)

    return let(scale, with_scale)


def _inverted(n: Column, p: Column, names: list) -> Column:
    """A draw for n p < LEAST_MEAN and p <= 1/2: chances are taken off the uniform number until it is used up."""
    ratio = p / (1 - p)
    first = F.struct(F.lit(0.0).alias("k"), F.exp(n * F.log1p(-p)).alias("chance"), two_uniforms(*names, F.lit(0))[0].alias("left"))
    step = lambda s, j: F.when((s["left"] > s["chance"]) & (j <= n), F.struct(j.cast("double").alias("k"), (s["chance"] * (n - j + 1) * ratio / j).alias("chance"), (s["left"] - s["chance"]).alias("left"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SMALL)), first, step, lambda s: s["k"])


def binomial_draw(trials: Column, share: Column, *names: Column | str) -> Column:
    """A draw of the binomial distribution of so many trials, as a long."""
    given = F.struct(trials.cast("double").alias("n"), F.least(share, 1 - share).alias("p"), (share > 0.5).alias("turned"))

    def drawn(x: Column) -> Column:
        k = F.when((x["n"] <= 0) | (x["p"] <= 0), F.lit(0.0)).when(x["n"] * x["p"] < LEAST_MEAN, _inverted(x["n"], x["p"], list(names))).otherwise(_rejected(x["n"], x["p"], list(names)))
        return let(k, lambda k: F.when(x["turned"], x["n"] - k).otherwise(k)).cast("long")

    return let(given, drawn)


def binomial(reps: DataFrame, name: str, step: int, share: float) -> DataFrame:
    """reps rep, m, ... -> with k, a draw of the binomial distribution of m trials."""
    return reps.withColumn("k", binomial_draw(F.col("m"), F.lit(share), name, F.col("rep"), F.lit(step)))


def value_counts(rows: DataFrame, value: str) -> list[tuple[float, int]]:
    """Values in their order with their counts; more than MOST_VALUES are an error."""
    found = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).orderBy("v").limit(MOST_VALUES + 1).collect()
    if len(found) > MOST_VALUES:
        raise ValueError(f"{value} has more than {MOST_VALUES} values")
    return [(r["v"], r["n"]) for r in found]


def replicates(rows: DataFrame, value: str, draws: int, name: str) -> DataFrame:
    """rep, mean: the means of `draws` resamples with replacement, as large as rows. Nulls are left out; without rows means are null."""
    return resampled(rows.sparkSession.range(draws).withColumnRenamed("id", "rep"), value_counts(rows, value), name)


def resampled(reps: DataFrame, counts: list[tuple[float, int]], name: str) -> DataFrame:
    """reps rep -> rep, mean: for each the mean of as many values drawn as there are, of values that come so often each."""
    n = left = sum(c for _, c in counts)
    steps = []
    for k, (v, c) in enumerate(counts):  # the last value takes what is left: its share is 1
        steps.append(F.struct(F.lit(k).alias("step"), F.lit(float(v)).alias("v"), F.lit(c / left).alias("share")))
        left -= c
    if not n:
        return reps.select("rep", F.lit(None).cast("double").alias("mean"))
    start = F.struct(F.lit(n).cast("long").alias("m"), F.lit(0.0).alias("total"))
    taken = lambda state, s: let(binomial_draw(state["m"], s["share"], name, F.col("rep"), s["step"]), lambda k: F.struct((state["m"] - k).alias("m"), (state["total"] + k * s["v"]).alias("total")))
    return reps.select("rep", F.aggregate(F.array(*steps), start, taken, lambda state: state["total"] / float(n)).alias("mean"))


#: Cells that quantiles() cuts each group into.
CELLS = 64


def quantiles(rows: DataFrame, by: list[str], value: str, asked: dict[str, float]) -> DataFrame:
    """by, and for each name the quantile at that place between 0 and 1, interpolated between the two neighbours of q * (n - 1); exact, for groups of any size. Nulls are left out, so a group without values has no row; NaN stands last.

    Equal values are one row with their count before anything is sorted. Cut points of each group, from a sketch of bounded size, deal its values to CELLS cells; the sizes of the cells tell which of
    them hold the neighbours, and only the values of those are put in order. A sketch that errs makes cells uneven, not results wrong.
    """
    own = [F.col(f"`{c}`").alias(f"__by{k}") for k, c in enumerate(by)]
    keys = [f"__by{k}" for k in range(len(by))] or ["__by"]
    own = own or [F.lit(0).alias("__by")]
    given = rows.where(F.col(f"`{value}`").isNotNull()).select(*own, F.col(f"`{value}`").cast("double").alias("__v"))
    counted = given.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    sketch = counted.groupBy(*keys).agg(F.approx_percentile("__v", [k / CELLS for k in range(1, CELLS)], 10 * CELLS).alias("__cuts"), F.sum("__c").alias("__n"))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cell = F.size(F.filter("__cuts", lambda c: c < F.col("__v")))
    placed = counted.alias("a").join(sketch.alias("b"), same("a", "b")).select(*[f"a.{k}" for k in keys], "__v", "__c", "__n", cell.alias("__cell"))
    sizes = placed.groupBy(*keys, "__cell").agg(F.sum("__c").alias("__m"), F.first("__n").alias("__n"))
    before = F.coalesce(F.sum("__m").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = lambda q: F.lit(q) * (F.col("__n") - 1)
    low, high = (lambda q: F.floor(place(q))), (lambda q: F.ceil(place(q)))
    holds = lambda q: (F.col("__before") <= high(q)) & (F.col("__before") + F.col("__m") > low(q))
    needed = F.lit(False)
    for q in asked.values():
        needed = needed | holds(q)
    cells = sizes.withColumn("__before", before).where(needed).select(*keys, "__cell", "__before")
    inside = placed.alias("a").join(cells.alias("b"), [*same("a", "b"), F.col("a.__cell") == F.col("b.__cell")]).select(*[f"a.{k}" for k in keys], "a.__cell", "__v", "__c", "__n", "__before")
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__cell").orderBy("__v"))
    ranked = inside.withColumn("__upto", upto)
    at = lambda rank: F.max(F.when((F.col("__upto") > rank) & (F.col("__upto") - F.col("__c") <= rank), F.col("__v")))
    ends = ranked.groupBy(*keys).agg(F.first("__n").alias("__n"), *[x for k, q in enumerate(asked.values()) for x in (at(low(q)).alias(f"__low{k}"), at(high(q)).alias(f"__high{k}"))])
    between = [(F.col(f"__low{k}") + F.when(place(q) > low(q), (F.col(f"__high{k}") - F.col(f"__low{k}")) * (place(q) - low(q))).otherwise(0.0)).alias(name) for k, (name, q) in enumerate(asked.items())]
    return ends.select(*[F.col(f"__by{k}").alias(c) for k, c in enumerate(by)], *between)


def nearest_rank(means: DataFrame, q: float, draws: int) -> DataFrame:
    """The mean at place int(q * draws) of the sorted ones."""
    order = Window.orderBy("mean", "rep")
    return means.withColumn("k", F.row_number().over(order)).where(F.col("k") == min(draws, int(q * draws) + 1)).select(F.col("mean").alias("v"))


def interpolated_interval(level: float = 0.95) -> list:
    q = (1 - level) / 2
    return [F.expr(f"percentile(mean, {q})").alias("low"), F.expr(f"percentile(mean, {1 - q})").alias("high")]


def interval_nearest(rows: DataFrame, value: str, draws: int = CI_DRAWS, name: str = "boot") -> DataFrame:
    """observed, low, high by nearest rank."""
    means = replicates(rows, value, draws, name)
    low, high = (nearest_rank(means, q, draws).select(F.col("v").alias(n)) for q, n in ((0.025, "low"), (0.975, "high")))
    return rows.agg(F.avg(value).alias("observed")).crossJoin(low).crossJoin(high)  # a row each


def paired_two_sided(rows: DataFrame, delta: str, draws: int = PAIR_DRAWS, name: str = "pair06") -> DataFrame:
    """Nearest-rank interval; p is twice the smaller tail, at most 1."""
    means = replicates(rows, delta, draws, name)
    low, high = (nearest_rank(means, q, draws).select(F.col("v").alias(n)) for q, n in ((0.025, "low"), (0.975, "high")))
    p = means.agg(F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("mean") <= 0).cast("double")), F.avg((F.col("mean") >= 0).cast("double")))).alias("p"))
    return rows.agg(F.avg(delta).alias("observed")).crossJoin(low).crossJoin(high).crossJoin(p)  # a row each


def paired_one_sided(rows: DataFrame, delta: str, draws: int = PAIR_DRAWS, name: str = "pair11") -> DataFrame:
    """Interpolated interval; p is the tail against the sign of the observed difference."""
    means = replicates(rows, delta, draws, name).agg(*interpolated_interval(), F.avg((F.col("mean") <= 0).cast("double")).alias("under"), F.avg((F.col("mean") >= 0).cast("double")).alias("over"))
    return rows.agg(F.avg(delta).alias("observed")).crossJoin(means).select("observed", "low", "high", F.when(F.col("observed") >= 0, F.col("under")).otherwise(F.col("over")).alias("p"))


def interval_interpolated(rows: DataFrame, value: str, draws: int = GATE_DRAWS, name: str = "ci28") -> DataFrame:
    return rows.agg(F.avg(value).alias("observed")).crossJoin(replicates(rows, value, draws, name).agg(*interpolated_interval()))


def sign_flip(rows: DataFrame, delta: str, draws: int = GATE_DRAWS, name: str = "flip") -> DataFrame:
    """p = (c + 1) / (draws + 1) for means of randomly signed differences at least as far from 0 as the observed one. Of the differences of one size a binomial number turns positive."""
    counts: dict[float, int] = {}
    every, total = 0, 0.0
    for v, c in value_counts(rows, delta):
        counts[abs(v)] = counts.get(abs(v), 0) + c
        every, total = every + c, total + v * c
    steps = [F.struct(F.lit(k).alias("step"), F.lit(size).alias("size"), F.lit(c).cast("long").alias("c")) for k, (size, c) in enumerate(sorted((v, c) for v, c in counts.items() if v))]
    reps = rows.sparkSession.range(draws).select(F.col("id").alias("rep"))
    turned = lambda total, s: total + (2 * binomial_draw(s["c"], F.lit(0.5), name, F.col("rep"), s["step"]) - s["c"]) * s["size"]
    reps = reps.select("rep", (F.aggregate(F.array(*steps), F.lit(0.0), turned) if steps else F.lit(0.0)).alias("total"))
    observed = total / every if every else None
    far = F.abs(F.col("total") / F.lit(float(every or 1))) >= F.lit(abs(observed or 0.0) - 1e-15)
    return reps.agg(F.lit(observed).cast("double").alias("observed"), ((F.count_if(far) + 1) / F.lit(draws + 1.0)).alias("p"))
