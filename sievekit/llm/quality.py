"""Quality classifier as a sparse rule ensemble.

Statistics of a text (lengths, shares of kinds of characters, repetition, function words) are Columns. Trees grown on random
parts of a bounded labelled sample give rules: every path from a root to a node is a conjunction of thresholds. A
logistic regression with a lasso penalty weighs the rules and drops most; what is left is compiled
into one Column expression, so scoring stays inside Spark.

Null texts are empty; empty texts have all statistics 0 and a score. Null doc_ids are scored and in no fold. Repeated rows are
scored each. Very long texts are read whole. Without labelled rows of both classes the score is the prior. Empty tables
give no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.learning import HELD_OUT, fold_of, labelled, linear_score, logistic
from sievekit.llm.secrets import let

THRESHOLD = 0.7
TREES, DEPTH, CUTS, TREE_ROWS, LEAF_ROWS = 48, 3, 24, 3_000, 12
MAX_RULES, LASSO = 320, 0.0008
#: Frequent function words of the languages that texts come in.
FUNCTION_WORDS = "the of and to in is that was for with la de le les des et en un une que el los las del por y der die das und mit von zu den ist nicht auf"
STATISTICS = ("chars", "words", "word_length", "symbols", "bars", "digits", "capitals", "stops", "commas", "lines", "distinct_words", "distinct_lines", "function_words", "long_words")


def statistics(text: Column, names: tuple[str, ...] = STATISTICS) -> Column:
    """array<double> of the named statistics, in their order."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    listed = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")

    def counts(w: Column) -> Column:
        known = F.size(F.filter(w, lambda x: x.isin(*FUNCTION_WORDS.split()))) if "function_words" in names else F.lit(0)
        long = F.size(F.filter(w, lambda x: F.length(x) >= 14)) if "long_words" in names else F.lit(0)
        return let(lines, lambda n: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct"), known.alias("known"), long.alias("long"), F.size(n).alias("lines"), F.size(F.array_distinct(n)).alias("distinct_lines")))

    def of(x: Column) -> Column:
        chars = F.greatest(F.length(text), F.lit(1)).cast("double")
        words = F.greatest(x["words"], F.lit(1)).cast("double")
        every = {
            "chars": F.log1p(F.length(text).cast("double")), "words": F.log1p(x["words"].cast("double")), "word_length": (chars - words) / words, "symbols": count(r"[*#%$&^~=+<>{}\[\]_@\\]") / words, "bars": count(r"\|") / words, "digits": count("[0-9]") / chars, "capitals": count(r"\p{Lu}") / words,
            "stops": count(r"[.!?](?=\s|$)") / words, "commas": count(",") / words, "lines": x["lines"] / words, "distinct_words": x["distinct"] / words, "distinct_lines": x["distinct_lines"] / F.greatest(x["lines"], F.lit(1)), "function_words": x["known"] / words, "long_words": x["long"] / words,
        }
        return F.array(*[every[n] for n in names])

    return let(let(listed, counts), of)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic number, whether above, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x):
        import numpy as np

        return np.logical_and.reduce([(x[:, f] > t) == above for f, above, t in self.terms])

    def column(self, x: Column) -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            value = F.get(x, f)
            out = out & ((value > F.lit(t)) if above else (value <= F.lit(t)))
        return out


def grow(x, y, rng, terms: tuple, rules: set, depth: int) -> None:
    """Splits by the largest fall of squared error over a random half of the statistics; every node adds its path."""
    import numpy as np

    if terms:
        rules.add(Rule(terms))
    if depth == 0 or len(y) < 2 * LEAF_ROWS or y.min() == y.max():
        return
    best = (1e-9, None, None)
    for f in rng.choice(x.shape[1], size=max(1, x.shape[1] // 2), replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))):
            low = x[:, f] <= t
            n = int(low.sum())
            if n < LEAF_ROWS or len(y) - n < LEAF_ROWS:
                continue
            gain = n * (len(y) - n) / len(y) * (y[low].mean() - y[~low].mean()) ** 2
            if gain > best[0]:
                best = (gain, int(f), float(f"{t:.6g}"))
    _, f, t = best
    if f is None:
        return
    high = x[:, f] > t
    grow(x[high], y[high], rng, (*terms, (f, True, t)), rules, depth - 1)
    grow(x[~high], y[~high], rng, (*terms, (f, False, t)), rules, depth - 1)


@dataclass
class Ensemble:
    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, text: Column) -> Column:
        return let(statistics(text), lambda x: linear_score(self.intercept, [(w, r.column(x).cast("double")) for r, w in self.rules]))


def fit(x, y, seed: int = 7) -> Ensemble:
    import numpy as np

    prior = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Ensemble(float(np.log(prior / (1 - prior))), [])
    rng, rules = np.random.default_rng(seed), set()
    ones, zeros = np.flatnonzero(y >= 0.5), np.flatnonzero(y < 0.5)
    for _ in range(TREES):  # both classes alike, so that rare ones get rules too
        part = np.concatenate([rng.choice(c, size=min(len(c), TREE_ROWS // 2), replace=False) for c in (ones, zeros)])
        grow(x[part], y[part], rng, (), rules, DEPTH)
    if not rules:  # too few rows to split
        return Ensemble(float(np.log(prior / (1 - prior))), [])
    ordered = sorted(rules, key=lambda r: r.terms)
    table = np.column_stack([r.holds(x) for r in ordered]).astype(np.float32)
    share = table.mean(axis=0)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tied = np.abs((table * (y - y.mean())[:, None]).mean(axis=0)) / spread
    keep = np.argsort(-np.where((share > 0.001) & (share < 0.999), tied, 0), kind="stable")[:MAX_RULES]
    intercept, weights = logistic(table[:, keep].astype(np.float64), y, ridge=1.0, lasso=LASSO, steps=250)
    return Ensemble(intercept, [(ordered[k], float(w)) for k, w in zip(keep, weights) if abs(w) > 1e-4])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Ensemble:
    import numpy as np

    rows = labelled(docs, labels, "quality", text, doc_id).select(statistics(F.col("text")), "y").collect()
    x = np.array([r[0] for r in rows], dtype=np.float64).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r[1] for r in rows]))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    ensemble = train(docs, labels, text, doc_id)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), ensemble.score(body).alias("score"))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
