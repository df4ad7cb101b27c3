"""Evaluation, inference, calibration and diagnosis over paired runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions.hashing import hash52
from sievekit.functions.ranks import concentration, softmax
from sievekit.functions.ranks import margin as score_margin
from sievekit.operators import calibrate, episodes, inference, metrics
from sievekit.plans.fixtures import PAIRS, d, h, pairs, table
from sievekit.plans.registry import query


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def long_runs(spark, sf_dir):
    """seed, method, place, expanded: one row a query and method."""
    p = pairs(spark, sf_dir)
    return p.select("seed", F.explode(F.array(F.struct(F.lit("base").alias("method"), F.col("place_a").alias("place"), F.lit(None).cast("boolean").alias("expanded")), F.struct(F.lit("full").alias("method"), F.col("place_b").alias("place"), F.col("expanded").alias("expanded")))).alias("x")).select("seed", "x.*")


LONG = f"{PAIRS}, runs AS (SELECT seed, 'base' AS method, place_a AS place, CAST(NULL AS BOOLEAN) AS expanded FROM pairs UNION ALL SELECT seed, 'full', place_b, expanded FROM pairs)"
RECALL = "round(avg(CAST(coalesce(place <= 1, false) AS INTEGER)), 6) AS recall_1, round(avg(CAST(coalesce(place <= 5, false) AS INTEGER)), 6) AS recall_5, round(avg(CAST(coalesce(place <= 10, false) AS INTEGER)), 6) AS recall_10, round(avg(coalesce(1::DOUBLE / place, 0)), 6) AS mrr"


@query("agg_recall", f"WITH {LONG} SELECT seed, method, count(*) AS n, {RECALL} FROM runs GROUP BY 1, 2")
def agg_recall(spark, sf_dir):
    return rounded(metrics.recall(long_runs(spark, sf_dir), ["seed", "method"]), "recall_1", "recall_5", "recall_10", "mrr")


@query("agg_mrr", f"WITH {LONG} SELECT method, round(avg(coalesce(1::DOUBLE / place, 0)), 6) AS mrr FROM runs GROUP BY 1")
def agg_mrr(spark, sf_dir):
    return rounded(metrics.recall(long_runs(spark, sf_dir), ["method"], ()), "mrr").select("method", "mrr")


@query("agg_exp_rate", f"WITH {LONG} SELECT method, CASE WHEN count(expanded) > 0 THEN round(avg(CAST(coalesce(expanded, false) AS INTEGER)), 6) END AS expansion_rate FROM runs GROUP BY 1")
def agg_exp_rate(spark, sf_dir):
    return rounded(metrics.expansion(long_runs(spark, sf_dir), ["method"]), "expansion_rate")


@query("agg_cost", f"WITH {PAIRS} SELECT seed, round(avg(CASE WHEN expanded THEN 3 ELSE 0 END), 6) AS calls, round(avg(coalesce(CASE WHEN expanded THEN {d('tok')} % 900 END, 0)), 6) AS tokens, round(avg(coalesce(CASE WHEN expanded THEN ({d('sec')} % 6000) / 1000::DOUBLE END, 0)), 6) AS seconds FROM pairs GROUP BY 1")
def agg_cost(spark, sf_dir):
    from sievekit.operators.gate import estimated_calls
    from sievekit.plans.fixtures import draw

    one = F.col("expanded").cast("int")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 6)
    return pairs(spark, sf_dir).groupBy("seed").agg(mean(estimated_calls(one * 2, one * 2)).alias("calls"), mean(F.when(F.col("expanded"), draw("tok") % 900)).alias("tokens"), mean(F.when(F.col("expanded"), (draw("sec") % 6000) / 1000.0)).alias("seconds"))


@query("agg_seed", f"WITH {LONG}, s AS (SELECT seed, method, avg(CAST(coalesce(place <= 5, false) AS INTEGER)) AS r FROM runs GROUP BY 1, 2) SELECT method, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, count(r) AS n FROM s GROUP BY 1")
def agg_seed(spark, sf_dir):
    return rounded(metrics.across(metrics.recall(long_runs(spark, sf_dir), ["seed", "method"], (5,)), ["method"], "recall_5"), "mean", "std")


@query("agg_gate_cross", f"WITH {PAIRS} SELECT expanded, count(*) FILTER (hit_b) AS hits, count(*) FILTER (NOT hit_b) AS misses, round(count(*) FILTER (hit_b) / greatest(1, count(*))::DOUBLE, 6) AS recall FROM pairs GROUP BY 1")
def agg_gate_cross(spark, sf_dir):
    return rounded(metrics.crossed(pairs(spark, sf_dir), "hit_b", "expanded"), "recall")


BIN = "CASE " + " ".join(f"WHEN top1 >= {a}::DOUBLE AND top1 < {b}::DOUBLE THEN {a}::DOUBLE" for a, b in zip(metrics.BIN_EDGES, metrics.BIN_EDGES[1:])) + " END"


@query("agg_bins", f"WITH {PAIRS} SELECT {BIN} AS low, count(*) AS n, round(avg(CAST(hit_a AS INTEGER)), 6) AS recall FROM pairs WHERE {BIN} IS NOT NULL GROUP BY 1")
def agg_bins(spark, sf_dir):
    binned = pairs(spark, sf_dir).withColumn("low", metrics.score_bin(F.col("top1"))).where("low is not null")
    return binned.groupBy("low").agg(F.count("*").alias("n"), F.round(metrics.rate(F.col("hit_a")), 6).alias("recall"))


CELLS = {"win": "hit_b AND NOT hit_a", "loss": "hit_a AND NOT hit_b", "both_hit": "hit_a AND hit_b", "both_miss": "NOT hit_a AND NOT hit_b"}
WINLOSS = "count(*) AS n, " + ", ".join(f"count(*) FILTER (({c}) AND {'expanded' if s == 'expanded' else 'NOT expanded'}) AS {s}_{k}" for s in ("expanded", "kept") for k, c in CELLS.items()) + f", count(*) FILTER ({CELLS['win']}) - count(*) FILTER ({CELLS['loss']}) AS net, round(count(*) FILTER ({CELLS['win']}) / count(*)::DOUBLE, 6) AS win_rate, round(count(*) FILTER ({CELLS['loss']}) / count(*)::DOUBLE, 6) AS loss_rate"


@query("agg_winloss", f"WITH {PAIRS} SELECT seed, {WINLOSS} FROM pairs GROUP BY 1")
def agg_winloss(spark, sf_dir):
    return rounded(metrics.win_loss(pairs(spark, sf_dir), ["seed"]), "win_rate", "loss_rate")


@query("agg_winloss_all", f"WITH {PAIRS} SELECT {WINLOSS} FROM pairs")
def agg_winloss_all(spark, sf_dir):
    return rounded(metrics.win_loss(pairs(spark, sf_dir), []), "win_rate", "loss_rate")


M = lambda c: f"round(avg(CAST({c} AS INTEGER)), 6)"


@query("agg_headroom", f"WITH {PAIRS} SELECT seed, {M('hit_a')} AS base, {M('hit_b')} AS expanded, {M('(hit_a OR hit_b)')} AS oracle, {M('(hit_b AND NOT hit_a)')} AS helpful, {M('(hit_a AND NOT hit_b)')} AS harmful, {M('(hit_a AND hit_b)')} AS \"both\", round(avg(CAST(hit_a OR hit_b AS INTEGER)) - avg(CAST(hit_a AS INTEGER)), 6) AS headroom FROM pairs GROUP BY 1")
def agg_headroom(spark, sf_dir):
    return rounded(metrics.headroom(pairs(spark, sf_dir), ["seed"]), "base", "expanded", "oracle", "helpful", "harmful", "both", "headroom")


AUDIT = "audit AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality = 0 THEN 'no' ELSE 'uncertain' END AS clear, CASE WHEN l.toxic = 0 THEN 'yes' WHEN l.toxic = 1 THEN 'no' ELSE 'uncertain' END AS answers FROM documents d LEFT JOIN labels l USING (doc_id))"


def audit(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    named = lambda c, yes: F.when(F.col(c) == yes, "yes").when(F.col(c) == 1 - yes, "no").otherwise("uncertain")
    return both.select("doc_id", named("quality", 1).alias("clear"), named("toxic", 0).alias("answers"))


@query("agg_label", f"WITH {AUDIT}, l AS (SELECT 'clear' AS field, clear AS label FROM audit UNION ALL SELECT 'answers', answers FROM audit), g AS (SELECT f.field, v.label FROM (VALUES ('clear'), ('answers')) f(field), (VALUES ('yes'), ('no'), ('uncertain')) v(label)) SELECT g.field, g.label, count(l.label) AS n, round(CASE WHEN (SELECT count(*) FROM audit) > 0 THEN count(l.label) / (SELECT count(*) FROM audit)::DOUBLE ELSE 0 END, 6) AS rate FROM g LEFT JOIN l ON l.field = g.field AND l.label = g.label GROUP BY 1, 2")
def agg_label(spark, sf_dir):
    return rounded(metrics.label_rates(audit(spark, sf_dir), ["clear", "answers"]), "rate")


RESULTS = "res AS (SELECT event_id % 50 AS task_id, event_type AS method, value > 100 AS success, value AS runtime, event_id FROM events)"


def results(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 50).cast("string").alias("task_id"), F.col("event_type").alias("method"), (F.col("value") > 100).alias("success"), F.col("value").alias("runtime"), "event_id")


@query("agg_pass1", f"WITH {RESULTS} SELECT method, count(*) AS attempted, count(*) FILTER (success) AS solved, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS pass_at_1, count(DISTINCT task_id) AS tasks FROM res GROUP BY 1")
def agg_pass1(spark, sf_dir):
    return rounded(metrics.attempts(results(spark, sf_dir)), "pass_at_1")


@query("agg_dups", f"WITH {RESULTS} SELECT CAST(task_id AS VARCHAR) AS task_id, method, count(*) AS n FROM res GROUP BY 1, 2 HAVING count(*) > 1")
def agg_dups(spark, sf_dir):
    return results(spark, sf_dir).groupBy("task_id", "method").agg(F.count("*").alias("n")).where("n > 1")


@query("agg_dedup_last", f"WITH {RESULTS} SELECT method, max(event_id) AS event_id, arg_max(CAST(task_id AS VARCHAR), event_id) AS task_id FROM res GROUP BY 1")
def agg_dedup_last(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("file", F.col("event_id"))
    return metrics.last_of(rows, "method", "file").select("method", "event_id", "task_id")


@query("agg_macro_micro", f"WITH {PAIRS} SELECT round((SELECT avg(r) FROM (SELECT avg(CAST(hit_b AS INTEGER)) AS r FROM pairs GROUP BY seed)), 6) AS macro, round(avg(CAST(hit_b AS INTEGER)), 6) AS micro FROM pairs")
def agg_macro_micro(spark, sf_dir):
    seeds = pairs(spark, sf_dir).groupBy("seed").agg(metrics.rate(F.col("hit_b")).alias("r"), F.count_if("hit_b").alias("hits"), F.count("*").alias("n"))
    return seeds.agg(F.round(F.avg("r"), 6).alias("macro"), F.round(F.sum("hits") / F.sum("n"), 6).alias("micro"))


@query("agg_max_depth", f"WITH {PAIRS} SELECT seed, max(least(base, 10)) AS depth FROM pairs GROUP BY 1")
def agg_max_depth(spark, sf_dir):
    lists = pairs(spark, sf_dir).select("seed", F.sequence(F.lit(1), F.least("base", F.lit(10))).alias("ids"))
    return lists.groupBy("seed").agg(F.max(F.size("ids")).alias("depth"))


SHARES = {"expansion": "expanded", "recall_a": "hit_a", "recall_b": "hit_b"}


@query("agg_report", f"""WITH {PAIRS}, s AS (SELECT seed, {', '.join(f'avg(CAST({c} AS INTEGER)) AS {n}' for n, c in SHARES.items())} FROM pairs GROUP BY 1),
m AS (SELECT avg(recall_a) AS macro_a, avg(recall_b) AS macro_b FROM s)
SELECT seed, grouping(seed) = 1 AS whole, count(*) AS n, count(*) FILTER (hit_b AND NOT hit_a) AS wins, count(*) FILTER (hit_a AND NOT hit_b) AS losses, count(*) FILTER (hit_b AND NOT hit_a) - count(*) FILTER (hit_a AND NOT hit_b) AS net,
  {', '.join(f'round(avg(CAST({c} AS INTEGER)), 6) AS {n}' for n, c in SHARES.items())}, round(CASE WHEN grouping(seed) = 1 THEN (SELECT macro_a FROM m) ELSE avg(CAST(hit_a AS INTEGER)) END, 6) AS macro_a,
  round(CASE WHEN grouping(seed) = 1 THEN (SELECT macro_b FROM m) ELSE avg(CAST(hit_b AS INTEGER)) END, 6) AS macro_b FROM pairs GROUP BY GROUPING SETS ((seed), ())""")
def agg_report(spark, sf_dir):
    """Per seed and pooled, micro and macro, from one scan."""
    return rounded(metrics.report(pairs(spark, sf_dir), "seed"), "expansion", "recall_a", "recall_b", "macro_a", "macro_b")


# resampling, at the replicate counts of the operators
def deltas(spark, sf_dir):
    return pairs(spark, sf_dir).select("query_id", F.col("hit_b").cast("int").alias("hit"), (F.col("hit_b").cast("int") - F.col("hit_a").cast("int")).alias("delta"))


def binomial_sql(name: str, reps: str, share: str, draw: str, step: int) -> str:
    """CTEs to {name}: rep, m, k, total for the CTE reps (rep, m, total), where share is the one value of a scalar query between 0 and 1: inversion for small means, else transformed rejection, the first try that is accepted."""
    st = lambda x: f"(CASE WHEN {x} < 10 THEN {inference.STIRLING!r}[CAST({x} AS INTEGER) + 1] ELSE (1 / 12::DOUBLE - (1 / 360::DOUBLE - 1 / 1260::DOUBLE / (({x} + 1) * ({x} + 1))) / (({x} + 1) * ({x} + 1))) / ({x} + 1) END)"
    half = lambda t, at: f"(CAST(('0x' || substr(md5(concat_ws('|', '{draw}', rep, {step}, {t})), {at}, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    return f"""{name}_s AS (SELECT rep, m, total, CAST(m AS DOUBLE) AS n, least(s, 1 - s) AS p, s > 0.5 AS turned FROM {reps}, (SELECT {share} AS s)),
{name}_g AS (SELECT *, sqrt(n * p * (1 - p)) AS s, 1.15::DOUBLE + 2.53::DOUBLE * sqrt(n * p * (1 - p)) AS b, p / (1 - p) AS r, floor((n + 1) * p) AS o FROM {name}_s WHERE n * p >= {inference.LEAST_MEAN}),
{name}_y AS (SELECT *, -0.0873::DOUBLE + 0.0248::DOUBLE * b + 0.01::DOUBLE * p AS a, 0.92::DOUBLE - 4.2::DOUBLE / b AS sq, (2.83::DOUBLE + 5.1::DOUBLE / b) * s AS al, (o + 0.5::DOUBLE) * ln((o + 1) / (r * (n - o + 1))) + {st('o')} + {st('(n - o)')} AS top FROM {name}_g),
{name}_u AS (SELECT *, u - 0.5::DOUBLE AS w, 0.5::DOUBLE - abs(u - 0.5::DOUBLE) AS us FROM (SELECT *, {half('t', 1)} AS u, {half('t', 14)} AS v FROM {name}_y, range({inference.TRIES}) tries(t))),
{name}_k AS (SELECT *, floor((2 * a / us + b) * w + n * p + 0.5::DOUBLE) AS k FROM {name}_u),
{name}_a AS (SELECT rep, t, k FROM (SELECT * FROM {name}_k WHERE k >= 0 AND k <= n OR us >= 0.07 AND v <= sq) WHERE us >= 0.07 AND v <= sq OR ln(v * al / (a / (us * us) + b)) <= top + (n + 1) * ln(1 + (k - o) / (n - k + 1)) + (k + 0.5::DOUBLE) * ln(r * (n - k + 1) / (k + 1)) - {st('k')} - {st('(n - k)')}),
{name}_f AS (SELECT rep, arg_min(k, t) AS k FROM {name}_a GROUP BY rep),
{name}_q AS (SELECT rep, n, p, {half('0', 1)} AS u, unnest(range({inference.MOST_SMALL + 1})) AS k FROM {name}_s WHERE n * p < {inference.LEAST_MEAN} AND n > 0 AND p > 0),
{name}_h AS (SELECT rep, k, u, n, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p))) OVER (PARTITION BY rep ORDER BY k) AS upto FROM {name}_q WHERE k <= n),
{name}_v AS (SELECT rep, min(k) AS k FROM {name}_h WHERE u <= upto OR k = n GROUP BY rep),
{name} AS (SELECT rep, m, total, CAST(CASE WHEN turned THEN n - coalesce(f.k, v.k, 0) ELSE coalesce(f.k, v.k, 0) END AS BIGINT) AS k FROM {name}_s LEFT JOIN {name}_f f USING (rep) LEFT JOIN {name}_v v USING (rep))"""


def boot_sql(value: str, name: str, draws: int) -> str:
    """Means of resamples of values of -1, 0 and 1: how many are the least value, then how many of the rest the next one. A value that no row has is drawn with a chance of 0."""
    return f"""{PAIRS}, src AS (SELECT CAST({value} AS DOUBLE) AS v FROM pairs), ct AS (SELECT v, count(*) AS c, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS vs FROM src GROUP BY v), n AS (SELECT count(*) AS n FROM src),
r0 AS (SELECT rep, n AS m, 0::DOUBLE AS total FROM range({draws}) r(rep), n), {binomial_sql('b0', 'r0', "(SELECT max(c) FILTER (i = 0) / max(n)::DOUBLE FROM ct, n)", name, 0)},
r1 AS (SELECT rep, m - k AS m, total + k * (SELECT v FROM ct WHERE i = 0) AS total FROM b0), {binomial_sql('b1', '(SELECT * FROM r1 WHERE (SELECT max(vs) FROM ct) > 2)', "(SELECT max(c) FILTER (i = 1) / (max(n) - max(c) FILTER (i = 0))::DOUBLE FROM ct, n)", name, 1)},
r2 AS (SELECT rep, m - k AS m, total + k * (SELECT v FROM ct WHERE i = 1) AS total FROM b1 UNION ALL SELECT rep, m, total FROM r1 WHERE (SELECT max(vs) FROM ct) <= 2),
means AS (SELECT rep, (total + m * (SELECT max(v) FROM ct)) / (SELECT n FROM n) AS mean FROM r2), ob AS (SELECT avg(v) AS observed FROM src)"""


HIT, DELTA = "CAST(hit_b AS INTEGER)", "CAST(hit_b AS INTEGER) - CAST(hit_a AS INTEGER)"
INTER = "(SELECT quantile_cont(mean, 0.025) FROM means) AS low, (SELECT quantile_cont(mean, 0.975) FROM means) AS high"
R6 = lambda names: ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


def near_sql(draws: int) -> str:
    place = lambda k: f"(SELECT mean FROM (SELECT mean, row_number() OVER (ORDER BY mean, rep) AS k FROM means) WHERE k = {k})"
    return f"{place(int(0.025 * draws) + 1)} AS low, {place(min(draws, int(0.975 * draws) + 1))} AS high"


@query("boot_ci", f"WITH {boot_sql(HIT, 'boot', inference.CI_DRAWS)} SELECT {R6('observed low high')} FROM (SELECT observed, {near_sql(inference.CI_DRAWS)} FROM ob)")
def boot_ci(spark, sf_dir):
    return rounded(inference.interval_nearest(deltas(spark, sf_dir), "hit"), "observed", "low", "high")


@query("boot_pair_two_sided", f"WITH {boot_sql(DELTA, 'pair06', inference.PAIR_DRAWS)} SELECT {R6('observed low high p')} FROM (SELECT observed, {near_sql(inference.PAIR_DRAWS)}, (SELECT least(1, 2 * least(avg(CAST(mean <= 0 AS INTEGER)), avg(CAST(mean >= 0 AS INTEGER)))) FROM means) AS p FROM ob)")
def boot_pair_two_sided(spark, sf_dir):
    return rounded(inference.paired_two_sided(deltas(spark, sf_dir), "delta"), "observed", "low", "high", "p")


@query("boot_pair_one_sided", f"WITH {boot_sql(DELTA, 'pair11', inference.PAIR_DRAWS)} SELECT {R6('observed low high p')} FROM (SELECT observed, {INTER}, CASE WHEN observed >= 0 THEN (SELECT avg(CAST(mean <= 0 AS INTEGER)) FROM means) ELSE (SELECT avg(CAST(mean >= 0 AS INTEGER)) FROM means) END AS p FROM ob)")
def boot_pair_one_sided(spark, sf_dir):
    return rounded(inference.paired_one_sided(deltas(spark, sf_dir), "delta"), "observed", "low", "high", "p")


@query("boot_ci_interpolated", f"WITH {boot_sql(DELTA, 'ci28', inference.GATE_DRAWS)} SELECT {R6('observed low high')} FROM (SELECT observed, {INTER} FROM ob)")
def boot_ci_interpolated(spark, sf_dir):
    return rounded(inference.interval_interpolated(deltas(spark, sf_dir), "delta"), "observed", "low", "high")


@query("ci_excludes_zero", f"WITH {boot_sql(DELTA, 'ci28', inference.GATE_DRAWS)} SELECT low > 0 OR high < 0 AS excludes_zero FROM (SELECT {INTER})")
def ci_excludes_zero(spark, sf_dir):
    return inference.interval_interpolated(deltas(spark, sf_dir), "delta").select(((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"))


@query("sign_flip", f"""WITH {PAIRS}, src AS (SELECT {DELTA} AS v FROM pairs), ob AS (SELECT avg(v) AS observed, count(*) AS n, count(*) FILTER (v <> 0) AS c FROM src),
r0 AS (SELECT rep, c AS m, 0 AS total FROM range({inference.GATE_DRAWS}) r(rep), ob), {binomial_sql('b0', 'r0', "0.5::DOUBLE", 'flip', 0)}
SELECT round(observed, 6) AS observed, round((count(*) FILTER (abs((2 * k - m) / n::DOUBLE) >= abs(observed) - 1e-15) + 1) / {inference.GATE_DRAWS + 1}::DOUBLE, 6) AS p FROM b0, ob GROUP BY observed""")
def sign_flip(spark, sf_dir):
    return rounded(inference.sign_flip(deltas(spark, sf_dir), "delta"), "observed", "p")


@query("percentiles", f"WITH {PAIRS} SELECT seed, round(quantile_cont(top1, 0.025), 6) AS p025, round(quantile_cont(top1, 0.5), 6) AS p50, round(quantile_cont(top1, 0.975), 6) AS p975 FROM pairs GROUP BY 1")
def percentiles(spark, sf_dir):
    return rounded(inference.quantiles(pairs(spark, sf_dir), ["seed"], "top1", {"p025": 0.025, "p50": 0.5, "p975": 0.975}), "p025", "p50", "p975")


@query("mean_std", f"WITH {PAIRS} SELECT seed, round(avg(top1), 6) AS mean, round(stddev_samp(top1), 6) AS std, count(top1) AS n FROM pairs GROUP BY 1")
def mean_std(spark, sf_dir):
    return rounded(metrics.across(pairs(spark, sf_dir), ["seed"], "top1"), "mean", "std")


SCORES = "[top1, top1 - margin, top1 - margin - 0.01::DOUBLE, top1 - margin - 0.05::DOUBLE, top1 - margin - 0.1::DOUBLE]"


def score_lists(spark, sf_dir):
    second = F.col("top1") - F.col("margin")
    return pairs(spark, sf_dir).withColumn("scores", F.array(F.col("top1"), second, *[second - x for x in (0.01, 0.05, 0.1)]))


@query("gate_features", f"WITH {PAIRS}, s AS (SELECT doc_id, {SCORES} AS sc, agrees FROM pairs), e AS (SELECT doc_id, sc, agrees, list_transform(sc, lambda x: exp(x - list_max(sc))) AS ex FROM s), p AS (SELECT doc_id, sc, agrees, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e) SELECT doc_id, round(sc[1], 6) AS top1, round(sc[1] - sc[2], 6) AS margin, round(1 - list_sum(list_transform(pr, lambda x: -x * ln(x))) / ln(5::DOUBLE), 6) AS concentration, agrees FROM p")
def gate_features(spark, sf_dir):
    return score_lists(spark, sf_dir).select("doc_id", F.round(F.get("scores", F.lit(0)), 6).alias("top1"), F.round(score_margin(F.col("scores")), 6).alias("margin"), F.round(concentration(F.col("scores")), 6).alias("concentration"), "agrees")


@query("softmax", f"WITH {PAIRS}, s AS (SELECT doc_id, {SCORES} AS sc FROM pairs), e AS (SELECT doc_id, list_transform(sc, lambda x: exp(x - list_max(sc))) AS ex FROM s) SELECT doc_id, round(ex[1] / list_sum(ex), 6) AS first, round(ex[5] / list_sum(ex), 6) AS last FROM e")
def softmax_scores(spark, sf_dir):
    return score_lists(spark, sf_dir).select("doc_id", softmax(F.col("scores")).alias("p")).select("doc_id", F.round(F.get("p", F.lit(0)), 6).alias("first"), F.round(F.get("p", F.lit(4)), 6).alias("last"))


# calibration
def cells_sql(cells) -> str:
    return "cells(policy, threshold) AS (VALUES " + ", ".join(f"('{p}', {t}::DOUBLE)" for p, t in cells) + ")"


LOW = "CASE WHEN policy LIKE 'margin%' THEN margin < threshold WHEN policy LIKE 'concentration%' THEN concentration < threshold ELSE top1 < threshold END"
EXPAND = f"CASE WHEN policy LIKE '%or_no_bm25_agreement' THEN {LOW} OR NOT agrees WHEN policy LIKE '%and_no_bm25_agreement' THEN {LOW} AND NOT agrees ELSE {LOW} END"


def scored_sql(cells, by: str, source: str = "pairs") -> str:
    keys = f"{by}, " if by else ""
    return f"""{cells_sql(cells)}, ex AS (SELECT *, {EXPAND} AS ex FROM {source}, cells), sc AS (SELECT {keys}policy, threshold, avg(CAST(CASE WHEN ex THEN hit_b ELSE hit_a END AS INTEGER)) AS recall,
  avg(CAST(CASE WHEN ex THEN hit10_b ELSE hit10_a END AS INTEGER)) AS recall10, avg(CAST(ex AS INTEGER)) AS expansion, count(*) AS n FROM ex GROUP BY ALL)"""


def crossed_cells(policies, values):
    return [(p, t) for p in policies for t in values]


TOP = lambda values: crossed_cells(("score_only",), values)
COARSE, FINE = calibrate.grid(45, 80, 5), calibrate.grid(45, 80, 1)
AGREEMENT, WIDE = crossed_cells(calibrate.SCORE_POLICIES, COARSE), crossed_cells(calibrate.SCORE_POLICIES, FINE)
FEATURES = [*crossed_cells(calibrate.TOP1_POLICIES, COARSE), *crossed_cells(calibrate.MARGIN_POLICIES, calibrate.grid(5, 100, 5, 1000.0)), *crossed_cells(calibrate.CONCENTRATION_POLICIES, calibrate.grid(20, 70, 5))]
OUT = "policy, threshold, round(recall, 6) AS recall, round(expansion, 6) AS expansion"
HALVES = f"{PAIRS}, hv AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY seed ORDER BY query_id) <= floor(count(*) OVER (PARTITION BY seed) / 2::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM pairs), tr AS (SELECT * FROM hv WHERE part = 'train')"


def picked(df):
    return rounded(df.select(*[c for c in df.columns if c not in ("recall10", "n")]), "recall", "expansion")


@query("sweep", f"WITH {PAIRS}, {scored_sql(TOP(calibrate.SWEEP), '')} SELECT threshold, round(recall, 6) AS recall, round(recall10, 6) AS recall10, round(expansion, 6) AS expansion, n FROM sc")
def sweep(spark, sf_dir):
    return rounded(calibrate.evaluated(pairs(spark, sf_dir), TOP(calibrate.SWEEP), []).drop("policy"), "recall", "recall10", "expansion")


@query("split_half", f"WITH {HALVES} SELECT seed, part, count(*) AS n, min(query_id) AS first FROM hv GROUP BY 1, 2")
def split_half(spark, sf_dir):
    return calibrate.split_half(pairs(spark, sf_dir), "seed", "query_id").groupBy("seed", "part").agg(F.count("*").alias("n"), F.min("query_id").alias("first"))


def train(spark, sf_dir):
    return calibrate.split_half(pairs(spark, sf_dir), "seed", "query_id").where("part = 'train'")


def first_sql(order: str, by: str = "seed", budget: float | None = None) -> str:
    inside = f"round(expansion, 9) <= {budget}::DOUBLE DESC, " if budget is not None else ""
    return f"SELECT {by}, {OUT} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {inside}{order}) AS place FROM sc) WHERE place = 1"


@query("select_validation", f"WITH {HALVES}, {scored_sql(TOP(calibrate.SWEEP), 'seed', 'tr')} " + first_sql("round(recall, 9) DESC, round(recall10, 9) DESC, round(expansion, 9), threshold"))
def select_validation(spark, sf_dir):
    scored = calibrate.evaluated(train(spark, sf_dir), TOP(calibrate.SWEEP), ["seed"])
    return picked(calibrate.chosen(scored, ["seed"], calibrate.by_recall(F.desc(F.round("recall10", 9)), F.round("expansion", 9), F.col("threshold"))))


@query("select_threshold", f"WITH {HALVES}, {scored_sql(TOP(COARSE), 'seed', 'tr')} " + first_sql("round(recall, 9) DESC, threshold"))
def select_threshold(spark, sf_dir):
    return picked(calibrate.chosen(calibrate.evaluated(train(spark, sf_dir), TOP(COARSE), ["seed"]), ["seed"], calibrate.by_recall(F.col("threshold"))))


@query("select_policy", f"WITH {HALVES}, {scored_sql(AGREEMENT, 'seed', 'tr')} " + first_sql("round(recall, 9) DESC, round(expansion, 9), policy, threshold"))
def select_policy(spark, sf_dir):
    return picked(calibrate.chosen(calibrate.evaluated(train(spark, sf_dir), AGREEMENT, ["seed"]), ["seed"], calibrate.by_recall(F.round("expansion", 9), F.col("policy"), F.col("threshold"))))


@query("select_features", f"WITH {HALVES}, {scored_sql(FEATURES, 'seed', 'tr')} " + first_sql("round(recall, 9) DESC, round(expansion, 9), policy, threshold", budget=0.55))
def select_features(spark, sf_dir):
    return picked(calibrate.chosen(calibrate.evaluated(train(spark, sf_dir), FEATURES, ["seed"]), ["seed"], calibrate.by_recall(F.round("expansion", 9), F.col("policy"), F.col("threshold")), 0.55))


LOSO = ", lo AS (SELECT a.seed AS test_seed, a.policy, a.threshold, sum(b.recall * b.n) / sum(b.n) AS recall, sum(b.expansion * b.n) / sum(b.n) AS expansion FROM sc a JOIN sc b ON a.seed <> b.seed AND a.policy = b.policy AND a.threshold = b.threshold GROUP BY 1, 2, 3)"


def loso_sql(cells, order: str) -> str:
    return f"WITH {PAIRS}, {scored_sql(cells, 'seed')}{LOSO} " + first_sql(order, "test_seed", 0.55).replace("FROM sc)", "FROM lo)")


@query("loso_threshold", loso_sql(TOP(FINE), "round(recall, 9) DESC, round(expansion, 9), threshold"))
def loso_threshold(spark, sf_dir):
    rest = calibrate.leave_one_out(calibrate.evaluated(pairs(spark, sf_dir), TOP(FINE), ["seed"]))
    return picked(calibrate.chosen(rest, ["test_seed"], calibrate.by_recall(F.round("expansion", 9), F.col("threshold")), 0.55))


@query("loso_policy", loso_sql(WIDE, "round(recall, 9) DESC, round(expansion, 9), policy, threshold"))
def loso_policy(spark, sf_dir):
    rest = calibrate.leave_one_out(calibrate.evaluated(pairs(spark, sf_dir), WIDE, ["seed"]))
    return picked(calibrate.chosen(rest, ["test_seed"], calibrate.by_recall(F.round("expansion", 9), F.col("policy"), F.col("threshold")), 0.55))


@query("recombine", f"WITH {PAIRS} SELECT doc_id, CASE WHEN top1 < 0.6::DOUBLE THEN hit_b ELSE hit_a END AS hit FROM pairs")
def recombine(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", F.when(F.col("top1") < 0.6, F.col("hit_b")).otherwise(F.col("hit_a")).alias("hit"))


@query("bm25_agrees", f"WITH {PAIRS} SELECT doc_id, sparse <= 10 AS agrees FROM pairs")
def bm25_agrees(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("doc_id", F.array(F.lit(0)).alias("dense"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.when(k == F.col("sparse"), 0).otherwise(k)).alias("bm25"))
    return rows.select("doc_id", F.coalesce(F.array_contains(F.slice("bm25", 1, 10), F.get("dense", F.lit(0))), F.lit(False)).alias("agrees"))


# sampling, sets and order
@query("shuffle_sample", f"SELECT doc_id FROM documents ORDER BY {h(chr(39) + 'sample' + chr(39), '42', 'doc_id')}, doc_id LIMIT 100")
def shuffle_sample(spark, sf_dir):
    return episodes.hash_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)


@query("heldout_slice", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {h(chr(39) + 'split' + chr(39), 'doc_id')}, doc_id) AS k FROM documents) WHERE k > 100 AND k <= 150")
def heldout_slice(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select("doc_id").withColumn("draw", hash52("split", F.col("doc_id"))).orderBy("draw", "doc_id").limit(150)
    return first.withColumn("k", episodes.numbered_by(["draw", "doc_id"])).where("k >= 100").select("doc_id")


@query("assign_split", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 AS INTEGER) AS reviewer FROM labels")
def assign_split(spark, sf_dir):
    return episodes.assigned(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 3)


@query("assign_full", "SELECT doc_id, CAST(r AS INTEGER) AS reviewer FROM labels, range(3) t(r)")
def assign_full(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("reviewer"))


@query("first_n_per_label", f"WITH {PAIRS} SELECT label, query_id FROM (SELECT query_id, CASE WHEN hit_b AND NOT hit_a THEN 'win' WHEN hit_a AND NOT hit_b THEN 'loss' ELSE 'same' END AS label, row_number() OVER (PARTITION BY CASE WHEN hit_b AND NOT hit_a THEN 'win' WHEN hit_a AND NOT hit_b THEN 'loss' ELSE 'same' END ORDER BY query_id) AS k FROM pairs) WHERE k <= 2")
def first_n_per_label(spark, sf_dir):
    from pyspark.sql import Window

    labelled = pairs(spark, sf_dir).select("query_id", F.when(F.col("hit_b") & ~F.col("hit_a"), "win").when(F.col("hit_a") & ~F.col("hit_b"), "loss").otherwise("same").alias("label"))
    return labelled.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("query_id"))).where("k <= 2").select("label", "query_id")


A, B = "SELECT doc_id FROM documents", "SELECT doc_id FROM labels"


def two_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")


@query("set_union", f"{A} UNION ALL {B}")
def set_union(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return a.unionByName(b)


@query("set_intersect", f"{A} INTERSECT {B}")
def set_intersect(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return a.intersect(b)


@query("set_except", f"{A} EXCEPT ALL {B}")
def set_except(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return a.exceptAll(b)


@query("set_symdiff", f"({A} EXCEPT {B}) UNION ({B} EXCEPT {A})")
def set_symdiff(spark, sf_dir):
    a, b = two_sets(spark, sf_dir)
    return a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("doc_id").agg(F.count_distinct("s").alias("n")).where("n = 1").select("doc_id")


@query("set_distinct", "SELECT DISTINCT lang, source FROM documents")
def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("sort_limit", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def sort_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)
