"""Mixing sources to target weights, with soft membership.

A classifier fitted on a labelled table gives every document a posterior over domains. Each document then gets
a nonnegative rate (its expected number of copies), so that the domains' expected token totals, sum of rate * tokens *
posterior, come closest to the targets in least squares, moving rates from 1 as little as that needs.

The fit is a projected gradient descent over the documents themselves, each with a rate of its own, with lazy projection: gradients add up, and a rate is 1 less its document's sum, put back to the bounds. Per token (in the metric
that weighs a rate by its document's tokens) a document's gradient is its posterior times one vector, the domains' misses, so all that is carried from step to step is the sum of such vectors, one number a domain, and rates are
written once, at the end. A step is one aggregation over all documents, in their tasks, of what several vectors would reach: the misses by one over the gradient's Lipschitz constant in that metric (the largest eigenvalue of a
domains x domains matrix), and the misses in the metric of the documents that no bound holds, damped and lengthened by several factors. The best is taken. The first of them cannot raise the error, so no step does.

Null texts are empty: no tokens, and rate 1 (or the least). Labels that are null or outside the targets'
domains do not teach. Ids that repeat in the labelled table count once (with the least domain); rows that repeat in the documents count each. A domain of
targets that no label has is never predicted, and its target is missed: a target that is missed by more than MISSED is a warning. Without any usable labels all posteriors are equal.
Empty tables give no rows. Very long texts are read whole. Columns of docs pass whatever their names. Copies are drawn by a hash of id and
text: rows with both alike are drawn alike.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import staged
from sievekit.llm.quality import statistics
from sievekit.llm.secrets import let
from sievekit.llm.toxicity import mine_stems, trie_pattern, unlike

#: Steps of the descent at most, the share of the tokens by which totals may miss their targets when it stops, the share that is worth a warning,
#: and the number of steps that have to lower the error by a millionth.
STEPS, CLOSE, MISSED, WINDOW = 200, 1e-6, 1e-3, 6
#: What dampens the metric of the documents inside their bounds (in Lipschitz constants), and multiples of the steps in that metric.
DAMPED, LONGER = tuple(10.0**-j for j in range(11)), (1.0, 4.0)
ROOM = 1.02
#: The statistics that domains are told apart by, beside their stems: those that need no search through the text but one for symbols and one for bars.
KNOWN_BY = ("chars", "words", "word_length", "symbols", "bars", "lines", "distinct_words", "distinct_lines")
#: Labelled rows that teach at most, on average of the hash that picks them.
TEACHING_ROWS = 8_000


@dataclass
class Classifier:
    domains: list[str]
    bias: list[float]
    weights: list[list[float]]  # domains x features
    stems: list[list[str]]  # word beginnings that mark a domain, for the domains that have such

    def features(self, text: Column) -> Column:
        return features(text, self.stems)

    def posterior(self, x: Column) -> Column:
        """array<double> of the domains, from a text's features."""
        forms = []
        for bias, row in zip(self.bias, self.weights):
            form = F.lit(float(bias))
            for k, w in enumerate(row):
                form = form + F.lit(float(w)) * F.get(x, k)
            forms.append(form)

        def shares(z: Column) -> Column:
            return let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))

        return let(F.array(*forms), shares)

    def membership(self, text: Column) -> Column:
        """struct<tokens (words), posterior>."""
        return let(self.features(text), lambda x: F.struct(F.round(F.expm1(F.get(x, 1))).cast("long").alias("tokens"), self.posterior(x).alias("posterior")))


def features(text: Column, stems: list[list[str]]) -> Column:
    """array<double>: the statistics, then for each list of stems the logarithms of different stems and of hits."""
    if not stems:
        return statistics(text, KNOWN_BY)

    def marks(lower: Column) -> Column:
        found = [F.regexp_extract_all(lower, F.lit(rf"(?<!\p{{L}})({trie_pattern(x)})"), 1) for x in stems]
        return F.concat(*[let(h, lambda y: F.array(F.log1p(F.size(F.array_distinct(y)).cast("double")), F.log1p(F.size(y).cast("double")))) for h in found])

    return F.concat(statistics(text, KNOWN_BY), let(F.lower(text), marks))


def softmax_fit(x, y, classes: int, ridge: float = 2.0, steps: int = 500):
    """Bias and weights of a multinomial regression on class numbers y, by accelerated gradient on standardised columns."""
    import numpy as np

    n, d = x.shape
    if not n:
        return np.zeros(classes), np.zeros((classes, d))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([np.ones(n), (x - mean) / scale])
    truth = np.eye(classes)[y]
    step = 2 / (np.linalg.norm(z / np.sqrt(n), 2) ** 2 + 2 * ridge / n)
    b = a = np.zeros((d + 1, classes))
    t = 1.0
    for _ in range(steps):
        s = z @ a
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = z.T @ (p - truth) / n + ridge / n * a
        new = a - step * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        a, b, t = new + (t - 1) / t_new * (new - b), new, t_new
    weights = (b[1:] / scale[:, None]).T
    return b[0] - weights @ mean, weights


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", rows: int = TEACHING_ROWS) -> Classifier:
    """labelled: doc_id, domain. About `rows` of them teach, picked by a hash of the id."""
    import numpy as np

    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    part = min(1.0, rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sample = staged(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text")).join(F.broadcast(known), "doc_id"))
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    largest = max(sizes, key=lambda d: (sizes[d], d), default=None)
    stems = []
    for d in sorted(set(sizes) - {largest}):
        one = staged(unlike(sample.withColumn("y", (F.col("domain") == d).cast("double"))))
        in_it = one.where("y = 1").count()
        stems.append(mine_stems(one, in_it, one.count() - in_it))
    stems = [x for x in stems if x]
    found = sample.select(features(F.col("text"), stems), "domain").collect()
    x = np.array([r[0] for r in found], dtype=float)
    x = x.reshape(len(found), -1) if len(found) else np.zeros((0, 0))
    bias, weights = softmax_fit(x, np.array([domains.index(r[1]) for r in found], dtype=int), len(domains))
    bias = [b if d in sizes or not sizes else -60.0 for b, d in zip(bias.tolist(), domains)]
    return Classifier(domains, bias, weights.tolist(), stems)


def members(docs: DataFrame, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens (words), posterior."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(F.array(classifier.membership(body))).alias("m"))
    return found.select("doc_id", "m.tokens", "m.posterior")


@dataclass
class Fit:
    start: float
    taken: list[float]  # by domain: what the steps took from a rate in all, per unit of posterior
    steps: int
    least: float
    most: float | None
    targets: list[float]
    reached: list[float]
    errors: list[float]  # half the squared miss before each step, and after the last


def follow(posterior, start: float, taken, least: float, most: float | None):
    """Rates of documents (rows of posterior)."""
    import numpy as np

    return np.clip(start - posterior @ np.asarray(taken), least, most)


def reach(tokens, posterior, start: float, tries, least: float, most: float | None):
    """tries x (domains + domains^2): the expected tokens by domain that so much taken leaves, and the metric of the documents that are then inside their bounds."""
    import numpy as np

    weighted, out = posterior * tokens[:, None], []
    for taken in tries:
        rates = follow(posterior, start, taken, least, most)
        inside = (rates > least) & (rates < (np.inf if most is None else most))
        out.append(np.concatenate([rates @ weighted, (posterior.T @ (weighted * inside[:, None])).ravel()]))
    return np.stack(out)


def measure(table: DataFrame, domains: int, start: float, tries, least: float, most: float | None):
    """reach() summed over a table of tokens and posterior: a task sums up its documents, and only such sums are shuffled."""
    import numpy as np

    width = domains + domains * domains

    def summed(batches):
        import pyarrow as pa

        total = np.zeros((len(tries), width))
        for batch in batches:
            tokens, posterior = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, domains)
            total += reach(tokens, posterior, start, tries, least, most)
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    rows = table.select(F.col("tokens").cast("double"), "posterior").mapInArrow(summed, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(len(tries) * width)
    for r in rows:
        found[r["place"]] = r["value"]
    return found.reshape(len(tries), width)


def descend(measured: Callable, totals, metric, targets):
    """(taken, reached, errors). measured(tries) is what reach() gives; totals and metric: those of the start, with all documents inside."""
    import numpy as np

    k, inside = len(targets), metric
    largest, taken = np.linalg.eigvalsh(metric)[-1], np.zeros(k)
    errors = [float(((totals - targets) ** 2).sum()) / 2]
    while largest > 0 and len(errors) <= STEPS and np.abs(totals - targets).sum() > CLOSE * targets.sum():
        miss = totals - targets
        tries = [taken + miss / largest] + [taken + by * np.linalg.solve(inside + d * largest * np.eye(k), miss) for d in DAMPED for by in LONGER]
        found = measured(tries)
        after = ((found[:, :k] - targets) ** 2).sum(axis=1) / 2
        best = int(np.argmin(after))
        if after[best] > errors[-1]:  # the optimum, as far as sums of so many numbers can tell
            break
        taken, totals, inside = tries[best], found[best, :k], found[best, k:].reshape(k, k)
        errors.append(float(after[best]))
        if len(errors) > WINDOW and errors[-WINDOW] - errors[-1] <= 1e-6 * errors[-1]:
            break
    return taken, totals, errors


def fit_rates(table: DataFrame, shares: list[float], total: float | None = None, least: float = 0.0, most: float | None = None) -> Fit:
    """For a staged table of tokens and posterior. total: the expected tokens of the mixture, by default those of the table, or, with least > 0, as many as the targets need."""
    import numpy as np

    k, start = len(shares), max(1.0, least)
    first = measure(table, k, start, [[0.0] * k], -np.inf, np.inf)[0]
    totals, metric = first[:k], first[k:].reshape(k, k)
    natural, weights = totals / start, np.array(shares, dtype=float) / sum(shares)
    if total is None:
        # with rates of at least `least` a domain cannot shrink below that: the mixture grows until every target is a little over it, as texts that hold a little of a full domain have to grow as well
        total = float(natural.sum()) if least <= 0 else ROOM * float(max(least * n / w for n, w in zip(natural, weights) if w > 0))
    targets = weights * total
    taken, reached, errors = descend(lambda tries: measure(table, k, start, tries, least, most), totals, metric, targets)
    if np.abs(reached - targets).sum() > MISSED * max(1.0, total):
        warnings.warn(f"expected tokens of the domains are {reached.round(1).tolist()}, not {targets.round(1).tolist()}", stacklevel=2)
    return Fit(start, taken.tolist(), len(errors) - 1, least, most, targets.tolist(), reached.tolist(), errors)


def rate(posterior: Column, tokens: Column, fit: Fit) -> Column:
    """follow() as a Column. Without tokens there is no gradient: such documents keep the rate of the start."""
    form = F.lit(fit.start)
    for d, x in enumerate(fit.taken):
        form = form - F.get(posterior, d) * F.lit(float(x))
    form = F.greatest(form, F.lit(float(fit.least)))
    return F.when(tokens > 0, form if fit.most is None else F.least(form, F.lit(float(fit.most)))).otherwise(F.lit(fit.start))


def rated(table: DataFrame, fit: Fit) -> DataFrame:
    """table of tokens and posterior -> with each row's rate."""
    return table.withColumn("rate", rate(F.col("posterior"), F.col("tokens"), fit))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", total: float | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> for each domain, rate."""
    domains = sorted(targets)
    table = staged(members(docs, train(docs, labelled, domains, doc_id, text), doc_id, text))
    fit = fit_rates(table, [targets[d] for d in domains], total, least, most)
    return rated(table, fit).select("doc_id", "tokens", *[F.get("posterior", k).alias(f"p_{d}") for k, d in enumerate(domains)], "rate")


def copies(rate: Column, *key: Column) -> Column:
    """A whole number whose expectation over keys is the rate: the fraction is decided by a hash of the key."""
    part = F.pmod(F.xxhash64(*key, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(part < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", total: float | None = None, least: float = 0.0, most: float | None = None) -> DataFrame:
    """docs with each row repeated as its rate says. Texts are classified once and written beside what that gave."""
    domains = sorted(targets)
    classifier = train(docs, labelled, domains, doc_id, text)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    table = staged(docs.select(own, F.explode(F.array(classifier.membership(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))).alias("m")).select("own", "m.tokens", "m.posterior"))
    fit = fit_rates(table, [targets[d] for d in domains], total, least, most)
    number = copies(F.col("rate"), F.col("own").getField(doc_id), F.col("own").getField(text))
    return rated(table, fit).withColumn("copy", F.explode(F.sequence(F.lit(0), number))).where(F.col("copy") > 0).select("own.*")


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from a table of labels: toxic, else prime (quality 1) or rough (quality 0)."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "prime").when(F.col("quality") == 0, "rough").alias("domain"))
