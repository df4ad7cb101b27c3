"""Small hand-made frames: ties, nulls, empty inputs and the traps of each operator."""

import json
import os
import statistics

import pytest
from pyspark.sql import functions as F

from sievekit.functions import ranks, text
from sievekit.operators import calibrate, dense, episodes, fusion, gate, inference, metrics, sparse, validate
from sievekit.sources import append_new, checkpointed, manifest, numbered_lines, read_any, read_csv, read_jsonl, read_jsonl_strict, result_files, seed_runs, tex_table, write_csv, write_json, write_jsonl, write_result_files, write_tex
from sievekit.streaming import answer_stream, evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_hits(spark):
    ids = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, ranks.hit_at(ids, ranks.target(F.lit(""), F.lit("b")), 2)) is True
    assert one(spark, ranks.hit_at(ids, F.lit(None).cast("string"), 2)) is False
    assert one(spark, ranks.hit_at(F.lit(None).cast("array<string>"), F.lit("a"), 2)) is False
    assert one(spark, ranks.hit_at(F.array().cast("array<string>"), F.lit("a"), 5)) is False
    assert one(spark, ranks.target_rank(ids, F.lit("z"))) == ">10"
    assert one(spark, ranks.reciprocal_rank(ids, F.lit("b"))) == 0.5
    assert one(spark, ranks.concentration(F.array(F.lit(1.0)))) == 1.0
    assert one(spark, ranks.concentration(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.0)
    assert one(spark, ranks.margin(F.array(F.lit(0.4)))) == 0.0


def test_head_tail(spark):
    for n in (0, 700, 701):
        got = one(spark, text.head_tail(F.lit("x" * n)))
        assert got == ("x" * n if n <= 700 else "x" * 300 + "\n... [truncated] ...\n" + "x" * 300)


def test_numbered(spark):
    reply = F.lit("1. first\n 2. lost\nnone\n3 third. fourth\n4. fifth")
    assert one(spark, text.numbered_items(reply, F.array(F.lit("kept")), 3)) == ["kept", "first", "fourth"]


def test_whole_texts(spark):
    """The full text queries against plain versions: what lies behind the first characters counts too."""
    import re

    from sievekit.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert max(len(r.text) for r in docs.values()) > 200
    got = lambda name, column: {r.doc_id: r[column] for r in QUERIES[name](spark, sf).collect()}
    tex = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", **{c: "\\" + c for c in "&%$#_{}"}}
    assert got("latex_escape", "tex") == {i: "".join(tex.get(c, c) for c in r.text) for i, r in docs.items()}
    assert got("query_template", "query") == {i: f"{r.source}\n\n{r.text}" for i, r in docs.items()}
    assert got("context_text", "context") == {i: (text.PACKET_HEAD + f"\n### Memory 1: {r.lang}\nTask ID: {i}\n{r.text}\n" + f"\n### Memory 2: {r.source}\nTask ID: \n{r.text}\n").strip(" \t\n\r\f\v") for i, r in docs.items()}
    items = lambda reply: [x.split(". ", 1)[-1].strip(" ") for x in reply.split("\n") if re.match("[0-9]", x)][:2]
    assert got("parse_numbered", "items") == {i: "|".join(items(f"1. {r.text}\n 2. lost\n3. third")) for i, r in docs.items()}


def test_episode_text(spark):
    assert one(spark, text.episode_text(F.lit("t"), F.lit(None).cast("string"), F.lit("ls"), F.lit(""))) == "[THOUGHT] t\n[ACTION] ls"
    assert one(spark, text.episode_text(F.lit(""), F.lit("bash"), F.lit("ls"), F.lit("out"))) == "[ACTION] bash: ls\n[OBSERVATION] out"


def test_extract(spark):
    rows = [("a", 0, "assistant", "c", " think ", "bash", '{"command":"ls"}'), ("a", 1, "tool", "out", None, None, None), ("a", 2, "assistant", "c", None, None, None), ("a", 3, "assistant", "c", "x" * 400, None, '{"path":"p"}'), ("a", 4, "user", "no", None, None, None), ("b", 0, "assistant", "c", None, "t", "not json")]
    got = episodes.extract(spark.createDataFrame(rows, "traj string, pos int, role string, content string, thought string, tool string, arguments string")).orderBy("traj", "pos").collect()
    assert [(r.pos, r.command, r.observation) for r in got] == [(0, "ls", "out"), (3, "p", ""), (0, "not json", "")]
    assert got[0].thought == "think" and len(got[1].thought) == 300


def test_numbers_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5).alias("g")).repartition(7)
    got = sorted((r.g, r.k, r.number) for r in episodes.numbered(rows, ["g", "k"]).collect())
    assert [n for _, _, n in got] == list(range(1000))
    assert episodes.numbered(rows.limit(0), ["k"]).count() == 0


def test_bm25_pads_and_counts_repeats(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["cat dog", "dog", "", "bird bird cat", "fish", "ant"])], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat cat"), (2, "nothing"), (3, "")], "query_id long, query string")
    got = sparse.bm25_topk(docs, queries, 3).orderBy("query_id", "rank").collect()
    assert [r.doc_id for r in got if r.query_id == 1] == [0, 3, 1]
    assert [(r.doc_id, r.score) for r in got if r.query_id == 2] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    index = sparse.Index(docs)
    single = index.matched(spark.createDataFrame([(1, "cat")], "query_id long, query string"), 9).collect()
    double = {r.doc_id: r.score for r in index.matched(queries, 9).where("query_id = 1").collect()}
    assert len(single) == 2 and all(double[r.doc_id] == pytest.approx(2 * r.score) for r in single)


@pytest.mark.parametrize("rows", [4_096, 7])
def test_bm25_blocks(spark, rows, monkeypatch):
    """Documents in several blocks, a word that all of them have, ids that tie: the plain formula's lists."""
    import math
    import random

    monkeypatch.setattr(sparse, "BLOCK_ROWS", rows)
    rnd = random.Random(3)
    docs = {k: ["the", *(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 9)))] for k in range(60)} | {60: [], 61: ["zzz"]}
    asked = {k: [rnd.choice("abcdefghijthe") for _ in range(4)] + ["the", "nowhere"] for k in range(9)}
    frame = lambda x, i, t: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{i} long, {t} string")
    got = sparse.Index(frame(docs, "doc_id", "text")).matched(frame(asked, "query_id", "query"), 5).orderBy("query_id", "rank").collect()
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    score = lambda q, d: sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in q if t in d)
    want = [(q, k + 1, i) for q, words in asked.items() for k, i in enumerate(sorted((i for i, d in docs.items() if set(d) & set(words)), key=lambda i: (-round(score(words, docs[i]), 9), i))[:5])]
    assert [(r.query_id, r["rank"], r.doc_id) for r in got] == want


def test_generic_runner(spark):
    queries = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "c", 9)], "query_id long, query string, target_id long")
    lists = spark.createDataFrame([(1, 7, 1), (1, 5, 2), (2, 5, 1), (2, 8, 2)], "query_id long, doc_id long, rank int")
    rows = metrics.run_method("m", queries, lambda q, k: lists, 2).orderBy("query_id").collect()
    assert [(r.retrieved_ids, r.hit_1, r.hit_k) for r in rows] == [([7, 5], True, True), ([5, 8], False, True), ([], False, False)]
    assert metrics.summary(metrics.run_method("m", queries, lambda q, k: lists, 2), 2).first().recall_2 == pytest.approx(2 / 3)


def test_rrf_ties(spark):
    lists = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 1, 4), (1, 0, 2, 4), (1, 1, 2, 9)], "query_id long, list_ord int, rank int, doc_id long")
    assert [r.doc_id for r in fusion.rrf(lists).orderBy("rank").collect()] == [4, 9]
    assert [r.doc_id for r in fusion.rrf(lists, first_seen=True).orderBy("rank").collect()] == [9, 4]


def test_dense_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, size=(60, 5)).astype(float)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, embedding array<double>")
    queries = vectors.where("doc_id < 7").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(dense, "BLOCK_ROWS", 16)
    monkeypatch.setattr(dense, "PRODUCT_ROWS", 3)
    got = dense.dense_topk(vectors, queries, 4).orderBy("query_id", "rank").collect()
    want = [(q, d) for q in range(7) for d in sorted(range(60), key=lambda d: (-(x[q] @ x[d]), d))[:4]]
    assert [(r.query_id, r.doc_id) for r in got] == want
    assert dense.dense_topk(vectors.limit(0), queries, 4).count() == 0


def test_every_twentieth_row_asks(spark):
    from sievekit.plans import QUERIES
    from sievekit.plans.retrieval import mixed_queries

    sf = "/root/testdata/sf0.001"
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.query_id for r in mixed_queries(spark, sf).collect()} == {i for i in ids if i % 20 == 0}
    assert {r.query_id for r in QUERIES["top1_score"](spark, sf).collect()} == {i for i in ids if i % 20 == 0}


def test_gate_skips_scoring(spark):
    original = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (2, 7, 0.1, 1)], "query_id long, doc_id long, score double, rank int")
    variants = spark.createDataFrame([(1, "trace", 0, "a"), (2, "trace", 0, "b"), (2, "paraphrase", 0, "c")], "query_id long, kind string, ord int, text string")
    asked = []

    def scorer(texts, k):
        asked.extend(r["query"] for r in texts.collect())
        return texts.select("query_id", F.lit(8).cast("long").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    got = gate.gated_retrieval(original, variants, "selective", scorer, scorer, k=5).collect()
    assert sorted(asked) == ["b", "b", "c"]
    assert {(r.query_id, r.doc_id, r.expanded) for r in got} == {(1, 5, False), (1, 6, False), (2, 7, True), (2, 8, True)}
    assert {(r.query_id, r.doc_id) for r in gate.gated_retrieval(original, variants, "dense", scorer, scorer, k=1).collect()} == {(1, 5), (2, 7)}
    with pytest.raises(ValueError):
        gate.expands("unknown", F.lit(1.0), F.lit(1))


def test_invariants(spark):
    pairs = spark.range(400).select((F.col("id") % 8).alias("seed"), (F.col("id") * 7 % 3 == 0).alias("hit_a"), (F.col("id") * 5 % 4 == 0).alias("hit_b"), (F.col("id") % 2 == 0).alias("expanded"))
    w, hr = metrics.win_loss(pairs, []).first(), metrics.headroom(pairs, []).first()
    cells = [w[f"{s}_{k}"] for s in ("expanded", "kept") for k in ("win", "loss", "both_hit", "both_miss")]
    assert sum(cells) == w.n == 400
    assert hr.expanded - hr.base == pytest.approx(w.net / 400) == pytest.approx(hr.helpful - hr.harmful)
    assert hr.oracle - hr.base == pytest.approx(hr.helpful) == pytest.approx(hr.headroom)


def test_across_one_seed(spark):
    assert metrics.across(spark.createDataFrame([("m", 0.5)], "method string, v double"), ["method"], "v").first().std is None


def test_expansion_rate_without_meta(spark):
    rows = spark.createDataFrame([("a", None), ("a", True), ("b", None)], "method string, expanded boolean")
    assert {r.method: r.expansion_rate for r in metrics.expansion(rows, ["method"]).collect()} == {"a": 0.5, "b": None}


def test_labels_of_nothing(spark):
    got = metrics.label_rates(spark.createDataFrame([], "a string"), ["a"]).collect()
    assert [(r.label, r.n, r.rate) for r in got] == [("yes", 0, 0.0), ("no", 0, 0.0), ("uncertain", 0, 0.0)]


def test_split_half_odd(spark):
    got = calibrate.split_half(spark.range(5).withColumn("g", F.lit(1)), "g", "id").orderBy("id").collect()
    assert [r.part for r in got] == ["train", "train", "test", "test", "test"]


def test_budget_falls_back(spark):
    scored = spark.createDataFrame([("p", 0.5, 0.9, 0.8), ("p", 0.6, 0.7, 0.7)], "policy string, threshold double, recall double, expansion double")
    assert calibrate.chosen(scored, [], calibrate.by_recall(F.col("threshold")), 0.1).first().threshold == 0.5
    assert calibrate.chosen(scored, [], calibrate.by_recall(F.col("threshold")), 0.75).first().threshold == 0.6


def test_resampling(spark):
    rows = spark.createDataFrame([(f"q{k}", 1 if k % 4 == 0 else 0) for k in range(80)], "query_id string, delta int")
    got = inference.paired_one_sided(rows, "delta", 200).first()
    assert got.low <= got.observed <= got.high and got.p == 0.0
    assert inference.sign_flip(rows, "delta", 200).first().p == pytest.approx(1 / 201)
    zero = rows.withColumn("delta", F.lit(0))
    assert inference.sign_flip(zero, "delta", 50).first().p == 1.0
    means = [r["mean"] for r in inference.replicates(rows, "delta", 200, "x").collect()]
    assert statistics.mean(means) == pytest.approx(0.25, abs=0.03)


def uniforms_of(*parts):
    import hashlib

    digits = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return [(int(digits[at : at + 13], 16) + 0.5) / 2**52 for at in (0, 13)]


def exact_chances(m, share):
    import math
    from fractions import Fraction

    p = Fraction(share)
    return [math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(m + 1)]


def plain_inversion(m, share, u):
    """The first k whose cumulated probability is over u, from exact binomial coefficients."""
    if share > 0.5:
        return m - plain_inversion(m, 1 - share, u)
    upto = 0
    for k, chance in enumerate(exact_chances(m, share)):
        upto += chance
        if upto > u:
            return k
    return m


def test_small_draws_follow_exact_probabilities(spark):
    for m, share in ((30, 0.3), (7, 0.9), (1, 0.5), (0, 0.3), (5, 0.0), (5, 1.0)):
        reps = spark.range(60).select(F.col("id").alias("rep"), F.lit(m).cast("long").alias("m"))
        got = {r.rep: r.k for r in inference.binomial(reps, "t", 3, share).collect()}
        assert got == {rep: plain_inversion(m, share, uniforms_of("t", rep, 3, 0)[0]) for rep in range(60)}


def test_rejected_draws_have_the_exact_distribution(spark):
    """Chi-squared of 20,000 draws against exact chances, on both sides of a half, just over the bound of the method and far from it."""
    for m, share in ((40, 0.3), (25, 0.6), (400, 0.5), (1000, 0.02)):
        reps = spark.range(20_000).select(F.col("id").alias("rep"), F.lit(m).cast("long").alias("m"))
        found = {r.k: r["count"] for r in inference.binomial(reps, "chi", 0, share).groupBy("k").count().collect()}
        cells, met, chance = [], 0, 0.0
        for k, c in enumerate(exact_chances(m, share)):
            met, chance = met + found.pop(k, 0), chance + float(c)
            if chance * 20_000 >= 10:
                cells.append((met, chance * 20_000))
                met, chance = 0, 0.0
        cells[-1] = (cells[-1][0] + met, cells[-1][1] + chance * 20_000)
        squares = sum((o - e) ** 2 / e for o, e in cells)
        assert not found and squares < len(cells) - 1 + 4 * (2 * (len(cells) - 1)) ** 0.5


def test_rejection_step_by_step(spark):
    """The same tries in plain Python."""
    import math

    def plain(m, p, rep):
        s, ratio, mode = math.sqrt(m * p * (1 - p)), p / (1 - p), math.floor((m + 1) * p)
        b = 1.15 + 2.53 * s
        a, tail = -0.0873 + 0.0248 * b + 0.01 * p, lambda k: math.lgamma(k + 1) - (k + 0.5) * math.log(k + 1) + k + 1
        for t in range(64):
            u, v = uniforms_of("t", rep, 0, t)
            u -= 0.5
            us = 0.5 - abs(u)
            k = math.floor((2 * a / us + b) * u + m * p + 0.5)
            if us >= 0.07 and v <= 0.92 - 4.2 / b:
                return k
            if 0 <= k <= m:
                height = (mode + 0.5) * math.log((mode + 1) / (ratio * (m - mode + 1))) + (m + 1) * math.log((m - mode + 1) / (m - k + 1)) + (k + 0.5) * math.log(ratio * (m - k + 1) / (k + 1))
                if math.log(v * (2.83 + 5.1 / b) * s / (a / us**2 + b)) <= height + tail(mode) + tail(m - mode) - tail(k) - tail(m - k):
                    return k

    for m, p in ((200, 0.25), (5000, 0.4)):
        reps = spark.range(500).select(F.col("id").alias("rep"), F.lit(m).cast("long").alias("m"))
        assert {r.rep: r.k for r in inference.binomial(reps, "t", 0, p).collect()} == {rep: plain(m, p, rep) for rep in range(500)}


def test_replicates_cost_the_same_for_any_number_of_rows(spark):
    """Four thousand million rows, known by their counts, and as many values as a column may have; the plan has neither join nor shuffle."""
    n = 4_000_000_000
    counts = [(-1.0, n // 10), (0.0, 6 * n // 10), (1.0, 3 * n // 10)]
    drawn = inference.resampled(spark.range(2000).withColumnRenamed("id", "rep"), counts, "big")
    means, spread = [r["mean"] for r in drawn.collect()], ((0.4 - 0.2**2) / n) ** 0.5
    assert statistics.mean(means) == pytest.approx(0.2, abs=4 * spread / 2000**0.5)
    assert statistics.stdev(means) == pytest.approx(spread, rel=0.08)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Join", "Exchange", "Window", "Generate"))
    many = inference.resampled(spark.range(300).withColumnRenamed("id", "rep"), [(float(v), 1000 + v) for v in range(64)], "many").agg(F.avg("mean")).first()[0]
    assert many == pytest.approx(sum(v * (1000 + v) for v in range(64)) / sum(1000 + v for v in range(64)), abs=0.05)


def test_resamples_are_as_wide_as_they_should_be(spark):
    """Means of many multinomial draws have the mean and the deviation of resampling with replacement, also for many rows."""
    for n in (200, 2_000_000):
        rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, -1).when(F.col("id") % 10 < 4, 1).otherwise(0).alias("delta"))
        means = [r["mean"] for r in inference.replicates(rows, "delta", 2000, "w").collect()]
        spread = ((0.4 - 0.2**2) / n) ** 0.5
        assert len(means) == 2000 and statistics.mean(means) == pytest.approx(0.2, abs=4 * spread / 2000**0.5)
        assert statistics.stdev(means) == pytest.approx(spread, rel=0.08)
    assert inference.interval_nearest(rows.limit(0), "delta", 20).first().observed is None
    flips = inference.sign_flip(spark.range(100).select(F.when(F.col("id") < 60, 1).otherwise(-1).alias("d")), "d").first()
    assert flips.p == pytest.approx(0.0569, abs=0.01)  # of 100 fair signs at least 60 or at most 40 are positive


def test_queries_draw_as_often_as_the_reference(spark, monkeypatch):
    from sievekit.plans import QUERIES

    asked = []
    monkeypatch.setattr(inference, "replicates", lambda rows, value, draws, name: asked.append(draws) or rows.select(F.lit(0).alias("rep"), F.lit(0.5).alias("mean")))
    for name in ("boot_ci", "boot_pair_two_sided", "boot_pair_one_sided", "boot_ci_interpolated", "ci_excludes_zero"):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [2000, 5000, 5000, 10000, 10000]


def test_validators(spark):
    rows = spark.createDataFrame([(1, "a", True), (2, None, None), (2, "z", False)], "id long, v string, ok boolean")
    assert validate.required(rows, "id", ["v"]).count() == 1
    assert validate.domain(rows, "id", "v", ["a"]).count() == 2
    assert [r.key for r in validate.unique(rows, ["id"]).collect()] == ["2"]
    told, found = (spark.createDataFrame([(1, x)], "k long, v double") for x in (0.5, 0.5 + 2e-9))
    assert validate.reconciled(told, found, ["k"], "v").count() == 1
    assert validate.reconciled(told, told, ["k"], "v").count() == 0
    meta = spark.createDataFrame([(1, True, 1, 1, 2, 1), (2, True, 1, None, 2, 1), (3, False, 0, 0, 1, None), (4, None, 0, 0, 1, 0)], "id long, expanded boolean, n_traces int, n_paraphrases int, n_lists int, calls int")
    assert sorted(r.key for r in validate.gate_meta(meta, "id").collect()) == ["2", "3"]
    assert {(r.key, r.detail) for r in validate.unchanged(spark.range(3), spark.range(1, 4), "id", []).collect()} == {("0", "row gone"), ("3", "row new")}
    checks = validate.unique(rows, ["id"])
    assert validate.exit_status(checks) == 1 and validate.exit_status(checks.limit(0)) == 0
    assert [(r.name, r.status, r.blocking) for r in validate.readiness(checks, {"unique": True, "other": True}).orderBy("name").collect()] == [("other", "pass", False), ("unique", "fail", True)]
    assert [r.detail for r in validate.forbidden(spark.createDataFrame([(1, '{"a": null, "b": 1}'), (2, "{}"), (3, None)], "id long, j string"), "id", "j", ["a", "c"]).collect()] == ["a"]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "id long, name string")
    write_jsonl(rows, f"{tmp_path}/x.jsonl")
    with pytest.raises(Exception):
        write_jsonl(rows, f"{tmp_path}/x.jsonl")
    assert {r.id for r in read_any(spark, f"{tmp_path}/x.jsonl", "id long, name string").collect()} == {1, 2}
    write_csv(rows, f"{tmp_path}/x.csv", ["id", "name"])
    assert {r.id for r in read_csv(spark, f"{tmp_path}/x.csv").collect()} == {"1", "2"}
    write_json(rows, f"{tmp_path}/x.json")
    write_tex(rows, f"{tmp_path}/x.tex", ["id", "name"], [F.col("id"), F.col("name")], ["id"])
    with pytest.raises(Exception, match="already exists"):
        write_tex(rows, f"{tmp_path}/x.tex", ["id"], [F.col("id")], ["id"])
    assert any("2 & --" in r.value for r in spark.read.text(f"{tmp_path}/x.tex").collect())
    assert append_new(rows, f"{tmp_path}/t", ["id"]) == 2 and append_new(rows, f"{tmp_path}/t", ["id"]) == 0
    assert manifest(spark, f"{tmp_path}/x.csv", "*.csv").count() >= 1
    with pytest.raises(ValueError):
        read_any(spark, "x.xml", "id long")


def test_lines_are_numbered_over_splits(spark, tmp_path):
    """Many splits of files, blank lines and a last line without an end."""
    for name, n in (("a.txt", 900), ("b.txt", 1)):
        (tmp_path / name).write_text("\n".join(f"{name} {k}" if k % 5 else "" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = numbered_lines(spark, str(tmp_path)).where("value <> ''").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 721 and all(r.value == f"{r.path.rsplit('/', 1)[1]} {r.line}" for r in got)


def test_checkpoints_resume(spark, tmp_path):
    rows = spark.range(70)
    assert checkpointed(rows.where("id < 40"), f"{tmp_path}/t", "id", 25) == 2
    assert checkpointed(rows, f"{tmp_path}/t", "id", 25) == 2
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == list(range(70))


def test_strict_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 3}\n')
    got = read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "id long").orderBy("_source_line").collect()
    assert [(r.id, r._source_line) for r in got] == [(1, 1), (None, 3), (3, 4)]
    assert got[1]._error.endswith("a.jsonl:3: not a JSON object") and got[0]._error is None
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long").collect()


def test_results_and_seeds(spark, tmp_path):
    for name in ("job1", "job1_retry"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(json.dumps({"task_name": name}))
    assert [r.task_name for r in result_files(spark, str(tmp_path), "task_name string").collect()] == ["job1"]
    runs = spark.createDataFrame([("fixed_memory_query", 42, 1), ("independent_memory", 42, 2), ("fixed_memory_query", 43, 3)], "family string, seed int, v int")
    runs.write.partitionBy("family", "seed").parquet(f"{tmp_path}/runs")
    assert sorted(r.v for r in seed_runs(spark, f"{tmp_path}/runs").collect()) == [2, 3]


def test_tex_table(spark):
    lines = spark.createDataFrame([(r"\textbf{Dense} & 45.5 \% & -- \\",), (r"\midrule",)], "value string")
    assert tex_table(lines).first().cells == ["Dense", "45.5 %", "--"]


def test_stream_answers_once(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, query string").write.parquet(f"{tmp_path}/in")
    for n in range(2):
        stream = spark.readStream.schema("query_id long, query string").parquet(f"{tmp_path}/in")
        answer_stream(stream, lambda q: q.withColumn("n", F.length("query")), f"{tmp_path}/out", f"{tmp_path}/checkpoint{n}", ["query_id"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


CSV_TEXTS = ["plain", "  lead trail ", 'say "hi", ok', '"', '""', "a\nb", "a\r\nb", "a\rb", "\r", "\n", "", "\\", 'a\\"b', "\t x", ",", 'x,"y"\r\n,z', " ", "end\\", None, '"quoted"', "a\r", "h,1\n2,t"]


def test_csv_keeps_text(spark, tmp_path):
    """Quotes, blanks at the ends, line ends of every kind, backslashes; empty and null fields are ''."""
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CSV_TEXTS)], "id long, `a.text` string")
    write_csv(rows.repartition(3), str(tmp_path / "x"), ["a.text", "id"])
    got = read_csv(spark, str(tmp_path / "x"))
    assert got.columns == ["a.text", "id"]
    assert {int(r["id"]): r["a.text"] for r in got.collect()} == {k: t or "" for k, t in enumerate(CSV_TEXTS)}


def test_quantiles_of_groups(spark):
    import random

    rnd = random.Random(3)
    rows = [(g, rnd.choice([0.5, 0.5, rnd.random(), None])) for g in ("a", "b", None) for _ in range(500)] + [("one", 7.0), ("none", None), ("same", 2.0), ("same", 2.0), ("two", 1.0), ("two", 2.0)]
    asked = {"low": 0.0, "q": 0.025, "half": 0.5, "far": 0.975, "high": 1.0}
    got = {r["g"]: [r[n] for n in asked] for r in inference.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", asked).collect()}

    def plain(values, q):
        values, at = sorted(values), q * (len(values) - 1)
        return values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at))

    groups = {g: [v for h, v in rows if h == g and v is not None] for g in ("a", "b", None, "one", "same", "two")}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx([plain(values, q) for q in asked.values()], abs=1e-12)
    assert inference.quantiles(spark.range(5), [], "id", {"x": 0.5}).collect()[0]["x"] == 2.0
    assert inference.quantiles(spark.range(0), [], "id", {"x": 0.5}).count() == 0


def test_quantiles_of_one_large_group(spark):
    """A million different values of one seed, in the order of a hash."""
    rows = spark.range(1_000_000).select(F.lit(42).alias("seed"), (F.pmod(F.col("id") * 7919, F.lit(1_000_000)) / 4).alias("v"))
    got = inference.quantiles(rows, ["seed"], "v", {"p": 0.025, "m": 0.5, "t": 0.9999}).first()
    assert (got.p, got.m, got.t) == pytest.approx((0.025 * 999_999 / 4, 0.5 * 999_999 / 4, 0.9999 * 999_999 / 4), abs=1e-6)


def conversation(spark, n):
    """Two actor turns a trajectory, each with a tool's answer; every third trajectory's are too short to count."""
    return spark.range(n).select((F.col("id") * 10).alias("traj"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos")).select("traj", "pos", F.when(F.col("pos") % 2 == 0, "assistant").otherwise("tool").alias("role"), F.repeat(F.lit("c"), F.when(F.col("traj") % 30 == 0, 5).otherwise(200)).alias("content"), F.lit("t").alias("thought"), F.lit("run").alias("tool"), F.lit(None).cast("string").alias("arguments"))


def test_collection_stops_at_the_trajectory_that_is_enough(spark):
    turns = conversation(spark, 500)
    # 2 * 3 * 7 = 42 episodes, two of each trajectory that counts
    got = episodes.collected(turns, 10, 4, first=8).orderBy("number").collect()
    counted = [10 * k for k in range(500) if k % 3][:21]
    assert [r.traj for r in got] == [t for t in counted for _ in range(2)] and [r.number for r in got] == list(range(42))
    # one more is wanted: the trajectory that holds it comes as a whole
    assert episodes.collected(turns, 43, 0, 1.0, first=8).count() == 44
    assert episodes.collected(turns, 100, 0, 50.0).count() == 666  # all there are
    with pytest.raises(ValueError, match="only 666"):
        episodes.collected(turns, 600, 100)
    with pytest.raises(ValueError, match="only 0"):
        episodes.collected(turns.limit(0), 1, 0)


def test_collection_does_not_read_later_ranges(spark):
    turns = conversation(spark, 5000)
    trap = F.when(F.col("traj") >= 1000, F.raise_error(F.concat(F.lit("read "), F.col("traj").cast("string")))).otherwise(F.col("thought"))
    assert episodes.collected(turns.withColumn("thought", trap), 10, 4, first=64).count() == 42


def test_cut_by_sums(spark):
    sizes = spark.createDataFrame([(k * k, 1 + k % 3) for k in range(200)], "k long, n long")
    for total in (1, 2, 3, 150, 399):
        upto, want = 0, None
        for k in range(200):
            upto += 1 + k % 3
            if upto >= total:
                want = k * k
                break
        assert episodes.cut_after(sizes, "k", "n", total, parts=5) == want


def test_checkpoints_take_one_job_for_any_number_of_buckets(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 3).alias("id"), F.lit("x").alias("v")).repartition(5)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for every in (500, 10):
        spark.sparkContext.setJobGroup(f"every{every}", "")
        assert checkpointed(rows, f"{tmp_path}/{every}", "id", every) == 1000 // every
        jobs.append(len(tracker.getJobIdsForGroup(f"every{every}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0]  # 100 buckets take no more than two
    got = spark.read.parquet(f"{tmp_path}/10")
    assert {(r.id, r.bucket) for r in got.collect()} == {(3 * k, k // 10) for k in range(1000)}
    assert checkpointed(rows, f"{tmp_path}/10", "id", 10) == 0


def answers(spark, texts):
    return spark.createDataFrame([(q, kind, k, t) for (q, kind), x in texts.items() for k, t in enumerate(x)], "query_id long, kind string, ord int, text string")


def held(told):
    out = {}
    for r in told.collect():
        out.setdefault(r.query_id, []).append((r.kind, r.ord, r.text, r.asked))
    return {q: sorted(x, key=str) for q, x in out.items()}


def test_cache_tops_up_what_it_holds_in_part(spark, tmp_path):
    queries = spark.createDataFrame([(1, "same "), (2, "same"), (3, "other"), (4, "fails")], "query_id long, query string")
    full = answers(spark, {(1, "trace"): ["t0", "t1"], (1, "paraphrase"): ["p0", "p1"], (3, "trace"): ["u0", "u1", "u2"], (4, "trace"): [None, " "]})
    path = f"{tmp_path}/cache"
    gate.expanded(queries.where("query_id = 1"), full.where("ord = 0"), path)
    got = held(gate.expanded(queries, full, path))
    # the second trace is a call of its own; paraphrases come from one call, behind the cached one
    assert got[1] == [("paraphrase", 0, "p0", False), ("paraphrase", 1, "p0", True), ("trace", 0, "t0", False), ("trace", 1, "t1", True)]
    assert [x[:3] for x in got[2]] == [x[:3] for x in got[1]] and not any(x[3] for x in got[2])
    assert got[3] == [("trace", 0, "u0", True), ("trace", 1, "u1", True)]
    assert got[4] == [(None, None, None, True)]
    # what failed is asked for again, what is there is not
    again = held(gate.expanded(queries, answers(spark, {(4, "trace"): ["late"], (1, "trace"): ["never"]}), path))
    assert again[4] == [("trace", 0, "late", True)] and [x[3] for x in again[1]] == [False] * 4
    # fewer texts are wanted: the first ones
    assert [x[2] for x in held(gate.expanded(queries, full, path, n_traces=1, n_paraphrases=0))[1]] == ["t0"]


def test_cache_of_two_runs_at_once(spark, tmp_path):
    """Both find the cache empty; each key keeps one list, that of the earlier run."""
    path, queries = f"{tmp_path}/cache", spark.createDataFrame([(k, f"q{k % 5}") for k in range(10)], "query_id long, query string")
    texts = lambda name: answers(spark, {(k, "trace"): [f"{name}{k}0", f"{name}{k}1"] for k in range(5)})
    gate.expanded(queries, texts("a"), f"{tmp_path}/a")
    gate.expanded(queries, texts("b"), f"{tmp_path}/b")
    for run in ("b", "a"):
        spark.read.parquet(f"{tmp_path}/{run}").write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 20
    told = held(gate.expanded(queries, texts("c"), path, n_paraphrases=0))
    assert {x[2] for rows in told.values() for x in rows} == {f"a{k}{j}" for k in range(5) for j in range(2)}
    assert all(len(rows) == 2 and not any(x[3] for x in rows) for rows in told.values())


def test_usage_is_attributed_and_adds_up(spark, tmp_path):
    queries = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three"), (4, "none")], "query_id long, query string")
    texts = answers(spark, {(1, "trace"): ["a b c", "d"], (1, "paraphrase"): ["e f"], (3, "trace"): ["g", "h i"], (3, "paraphrase"): ["j", "k"]})
    path = f"{tmp_path}/cache"
    gate.expanded(queries.where("query_id = 3"), texts.where("ord = 0"), path)
    ledger = gate.usage(queries, gate.expanded(queries, texts, path))
    names = ("n_traces", "n_paraphrases", "estimated_calls", "llm_calls", "prompt_tokens", "completion_tokens", "total_tokens")
    observed, totals = gate.observed_usage(ledger)
    rows = {r.query_id: tuple(r[n] for n in names) for r in observed.collect()}
    assert rows == {1: (2, 1, 3, 3, 6, 6, 12), 2: (2, 1, 3, 0, 0, 0, 0), 3: (2, 2, 3, 2, 2, 3, 5), 4: (0, 0, 0, 0, 0, 0, 0)}
    assert totals.get == {"queries": 4, "estimated_calls": 9, "llm_calls": 5, "prompt_tokens": 8, "completion_tokens": 9, "total_tokens": 17}
    assert gate.average_usage(ledger).first().llm_calls == 1.25


def test_long_lists_are_not_read_to_their_ends():
    """A frequent word behind a rare one: documents that hold only the frequent one are left out once they cannot reach the k-th score."""
    import numpy as np

    rnd = np.random.default_rng(2)
    block, n = sparse.Postings(5000), 5000
    lists = {"rare": rnd.choice(n, 40, replace=False), "often": rnd.choice(n, 4000, replace=False), "all": np.arange(n)}
    score = np.zeros(n)
    weights = {"rare": 5.0, "often": 0.5, "all": 0.01}
    for term, places in lists.items():
        impacts = np.sort(rnd.uniform(0.5, 2.5, len(places)))[::-1]
        block.add(term, float(impacts[0]), places.astype("<i4").tobytes(), impacts.astype("<f8").tobytes())
        score[places] += weights[term] * impacts
    places, scores, read, every = block.best(list(weights), list(weights.values()), 10)
    want = sorted(range(n), key=lambda i: (-round(score[i], 9), i))[:10]
    assert places.tolist() == want and np.allclose(scores, score[want]) and read < every / 10
    assert block.best(["all", "nowhere"], [-1.0, 2.0], 3)[0].tolist() == sorted(range(n), key=lambda i: (round(score_of(block, i), 9), i))[:3]


def test_whole_number_sums_leave_out_only_what_cannot_be_found():
    """Many long lists: documents are picked by sums in two bytes and scored in doubles, whatever the scale of the weights and however few rows are kept at a time."""
    import numpy as np

    rnd = np.random.default_rng(8)
    for n, most, scale in ((3000, 512, 1.0), (3000, 3, 1.0), (40, 512, 1.0), (3001, 512, 1e-6), (3000, 512, 1e6)):
        block, score = sparse.Postings(n), np.zeros(n)
        block.exact.most, block.rounded.most = most, 2 * most
        weights = {f"t{j}": float(rnd.uniform(1, 2)) * scale for j in range(20)}
        for j, (term, weight) in enumerate(weights.items()):
            places = rnd.choice(n, n * (j + 4) // 24, replace=False)
            impacts = np.sort(rnd.integers(1, 6, len(places)) / 2)[::-1]
            block.add(term, float(impacts[0]), places.astype("<i4").tobytes(), impacts.astype("<f8").tobytes())
            score[places] += weight * impacts
        for _ in range(2):
            want = sorted(range(n), key=lambda i: (-round(score[i], 9), i))[:10]
            places, scores, read, held = block.best(list(weights), list(weights.values()), 10)
            assert places.tolist() == want and np.allclose(scores, score[want], rtol=1e-12) and read <= held
            block.release()
        assert n < 1000 or most == 3 or block.rounded.held is None and block.best(list(weights), list(weights.values()), 10)[2] and block.rounded.held.dtype.itemsize == 2


def test_products_leave_out_only_what_cannot_be_found():
    """Near scores in single precision, exact ones in doubles: copies tie by id, numbers of any size."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(6)
    table = lambda i, v: pa.table({"doc_id": i, "v": pa.array(list(v), pa.list_(pa.float64()))})
    for n, k, scale in ((5, 3, 1.0), (3000, 20, 1.0), (2500, 5, 1e-3), (2500, 5, 4096.0), (40, 60, 1.0)):
        vectors, queries, ids = rnd.poisson(2, size=(n, 16)) * scale, rnd.normal(size=(70, 16)), rnd.permutation(n)
        vectors[n // 2 :] = vectors[: n - n // 2]
        at, places, scores = dense._products(k)(table(ids, vectors))(table(np.arange(70), queries))
        for q in range(70):
            want = np.round((vectors * queries[q]).sum(axis=1), 9)
            assert places[at == q].tolist() == np.lexsort((ids, -want))[:k].tolist()
            assert np.allclose(scores[at == q], want[places[at == q]])


def test_blocks_are_tasks_of_their_own(spark):
    from sievekit.operators.blocks import own_task

    rows = spark.range(4_000).select(F.lit("").alias("part"), (F.col("id") % 40).alias("b"))
    tasks = own_task(rows, "part", "b", 40).select("b", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == 40 and tasks.select("task").distinct().count() == 40


def test_postings_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, " "), (3, None), (4, "c c a")], "doc_id long, text string")
    got = sparse.postings(docs)
    assert sorted(map(tuple, got.select("doc_id", "dl", "term", "tf").collect())) == [(1, 3, "a", 1), (1, 3, "b", 2), (4, 3, "a", 1), (4, 3, "c", 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_block_starts_from_the_score_that_others_reach():
    """Lists of any length are added whole and right; documents below the floor of other blocks are left out, those at it are not."""
    import numpy as np

    from sievekit.operators.blocks import floor_of

    rnd = np.random.default_rng(5)
    for n in (50, 3000):
        block, score = sparse.Postings(n), np.zeros(n)
        weights = {f"t{j}": float(rnd.uniform(0.1, 3)) for j in range(12)}
        for j, (term, weight) in enumerate(weights.items()):
            places = rnd.choice(n, max(1, n * (j + 1) // 13), replace=False)
            impacts = np.sort(rnd.uniform(0.5, 2.5, len(places)))[::-1]
            block.add(term, float(impacts[0]), places.astype("<i4").tobytes(), impacts.astype("<f8").tobytes())
            score[places] += weight * impacts
        want = sorted(range(n), key=lambda i: (-round(score[i], 9), i))[:10]
        assert floor_of(score, 10) <= np.sort(score)[-10] and (score >= floor_of(score, 10)).sum() < 10 + n / 20
        for floor, left in ((0.0, 10), (score[want[3]], 4), (1e9, 0)):
            places, scores, _, _ = block.best(list(weights), list(weights.values()), 10, floor)
            assert places[:left].tolist() == want[:left] and np.allclose(scores, score[places])


def score_of(block, place):
    _, places, impacts = block.terms["all"]
    return float(impacts[list(places).index(place)])


def test_parts_do_not_meet(spark):
    docs = spark.createDataFrame([(1, "a", "cat dog"), (2, "a", "cat"), (3, "b", "cat"), (4, None, "cat cat"), (5, "b", "bird")], "doc_id long, memory string, text string")
    queries = spark.createDataFrame([(7, "a", "cat"), (8, "b", "cat bird"), (9, "c", "cat")], "query_id long, memory string, query string")
    got = sparse.Index(docs, part="memory").matched(queries, 5)
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == [(7, 1), (7, 2), (8, 3), (8, 5)]
    vectors = spark.createDataFrame([(k, p, [1.0, float(k)]) for k, p in ((1, "a"), (2, "a"), (3, "b"))], "doc_id long, part string, embedding array<double>")
    asked = spark.createDataFrame([(7, "a", [1.0, 1.0]), (8, "b", [1.0, 1.0])], "query_id long, part string, vector array<double>")
    assert [(r.query_id, r.doc_id, r["rank"]) for r in dense.dense_topk(vectors, asked, 5).orderBy("query_id", "rank").collect()] == [(7, 2, 1), (7, 1, 2), (8, 3, 1)]


def test_vectors_of_a_model_and_of_a_table(spark):
    texts = spark.createDataFrame([(1, "aab"), (2, None), (3, "b")], "doc_id long, text string")

    def model():
        return lambda batch: [[t.count("a"), t.count("b")] for t in batch]

    got = {r.doc_id: r.embedding for r in dense.modelled_vectors(texts, model).collect()}
    assert got[1] == pytest.approx([2 / 5**0.5, 1 / 5**0.5]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 1.0]
    table = spark.createDataFrame([(1, [3.0, 4.0]), (3, None)], "vec_id long, embedding array<float>")
    assert [(r.doc_id, r.embedding) for r in dense.tabled_vectors(texts, table).collect()] == [(1, [0.6, 0.8])]
    assert {r.doc_id for r in dense.hashed_vectors(spark.createDataFrame([(1, "x y"), (2, " "), (3, None)], "doc_id long, text string")).collect()} == {1}


def test_report_of_groups_and_of_all(spark):
    """Micro weighs rows, macro groups; a null group is a group; one scan gives every level."""
    rows = spark.createDataFrame([(1, True, True, True), (1, False, True, False), (1, False, False, None), (2, True, False, True), (None, None, True, False)], "seed int, hit_a boolean, hit_b boolean, expanded boolean")
    got = {(r.seed, r.whole): r for r in metrics.report(rows, "seed").collect()}
    assert set(got) == {(1, False), (2, False), (None, False), (None, True)}
    every = got[None, True]
    assert (every.n, every.wins, every.losses, every.net) == (5, 1, 1, 0) and every.recall_a == pytest.approx(0.4) and every.recall_b == pytest.approx(0.6)
    assert every.macro_a == pytest.approx((1 / 3 + 1 + 0) / 3) and every.macro_b == pytest.approx((2 / 3 + 0 + 1) / 3) and every.expansion == pytest.approx(0.4)
    assert got[1, False].macro_a == got[1, False].recall_a == pytest.approx(1 / 3)
    assert metrics.report(rows.limit(0), "seed").count() == 0
    plan = metrics.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("lang").alias("seed"), F.lit(True).alias("hit_a"), F.lit(False).alias("hit_b"), F.lit(True).alias("expanded")), "seed")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_agreement(spark):
    lists = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, rank int")
    got = fusion.agreement(lists([(1, 5, 1), (1, 6, 2), (2, 7, 1), (3, 8, 1)]), lists([(1, 6, 1), (1, 5, 2), (2, 7, 3), (4, 1, 1)]), 2)
    assert {r.query_id: r.agrees for r in got.collect()} == {1: True, 2: False, 3: False}


def attempted(spark, folder, rows):
    """One more file of attempts, and a run of the stream over what is new."""
    columns = "method string, query_id string, at string, attempt long, hit long, calls long, tokens long"
    spark.createDataFrame(rows, columns).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
    evaluated(spark, folder)


def evaluated(spark, folder, **settings):
    schema = "method string, query_id string, at timestamp, attempt long, hit long, calls long, tokens long"
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    evaluation.evaluate_stream(stream, f"{folder}/out", f"{folder}/state", **settings).awaitTermination()


def test_attempts_as_a_stream(spark, tmp_path):
    """Retries replace, late rows and rows without a time go, ties and nulls have a result, and a batch that runs twice after a failure changes nothing."""
    folder, day = str(tmp_path), "2024-01-01 "
    provider = spark.conf.get(evaluation.PROVIDER)
    attempted(spark, folder, [("m", "q", day + "10:00:00", 1, 0, 2, 30), ("m", "r", day + "10:00:00", 1, 1, 1, 5), ("m", "r", day + "10:00:00", 1, 0, 9, 9), (None, None, day + "10:00:00", None, None, None, None), ("m", "s", None, 1, 1, 1, 1)])
    first = {r["method"]: r for r in evaluation.totals(spark, f"{folder}/out").collect()}
    assert {k: tuple(r[c] for c in ("queries", "attempts", "hits", "calls", "tokens")) for k, r in first.items()} == {"m": (2, 3, 1, 3, 35), None: (1, 1, 0, 0, 0)}
    attempted(spark, folder, [("m", "q", day + "15:00:00", 2, 1, 4, 40), ("m", "q", day + "09:30:00", 0, 0, 7, 7)])
    attempted(spark, folder, [("m", "late", day + "09:00:00", 1, 1, 1, 1), ("m", "q", day + "14:30:00", 3, 0, 8, 8)])
    told = lambda: sorted(tuple(r) for r in evaluation.totals(spark, f"{folder}/out").where("method = 'm'").collect())
    assert told() == [("m", 2, 6, 2, 5, 45, 1.0)]
    before = told()
    commits = f"{folder}/state/commits"
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    evaluated(spark, folder)
    assert told() == before
    steps = [r["recall"] for r in evaluation.running(spark, f"{folder}/out").where("method = 'm'").orderBy("batch").collect()]
    assert steps[0] == 0.5 and steps[-1] == 1.0
    assert spark.conf.get(evaluation.PROVIDER) == provider


def test_result_files(spark, tmp_path):
    """A file a folder, written again without harm; rows without a folder or body are left out, retries not read."""
    rows = spark.createDataFrame([("a", '[{"x": 1}, {"x": 2}]'), ("b/c", '{"x": 3}'), ("d_retry", '{"x": 4}'), (None, '{"x": 5}'), ("e", None)], "folder string, body string")
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/named"):
        write_result_files(rows, path)
        write_result_files(rows, path)
        assert sorted(r["x"] for r in result_files(spark, path, "x long").collect()) == [1, 2, 3]
    assert not os.path.exists(tmp_path / "plain" / "e")


def test_state_goes_past_the_horizon(spark, tmp_path):
    """Without a horizon a later attempt replaces; with one, state is dropped once the watermark is past it, and the later attempt is another query."""
    columns, day = "method string, query_id string, at string, attempt long, hit long, calls long, tokens long", "2024-01-01 "
    for folder, horizon, queries in ((f"{tmp_path}/kept", None, 2), (f"{tmp_path}/gone", 60_000, 3)):
        for rows in ([("m", "q", day + "10:00:00", 1, 0, 1, 1)], [("m", "r", day + "20:00:00", 1, 0, 1, 1)], [("m", "q", day + "20:00:01", 2, 1, 1, 1)]):
            spark.createDataFrame(rows, columns).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
            evaluated(spark, folder, horizon_ms=horizon)
        got = evaluation.totals(spark, f"{folder}/out").first()
        assert (got["queries"], got["attempts"], got["hits"]) == (queries, 3, 1)


def test_a_bucket_of_keys_is_one_state(spark, tmp_path):
    """Keys of a bucket are read and written once a batch, whatever their number; each keeps its own last attempt, and goes past the horizon by itself."""
    import pandas as pd

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    state = State()
    processor = evaluation.LastAttempt()
    processor.init(type("Handle", (), {"getValueState": lambda self, name, schema: state})())
    frame = lambda rows: pd.DataFrame(rows, columns=["bucket", "method", "query_id", "at", "at_micros", "attempt", "hits", "calls", "tokens"])
    attempt = lambda method, q, at, n, hit: (0, method, str(q), None, at, n, hit, 1, 2)
    first = [attempt(None if q % 2 else "m", q, 5, 1, 0) for q in range(300)]
    told = lambda *parts: sorted(tuple(r) for part in processor.handleInputRows((0,), iter([frame(p) for p in parts]), None) for r in part.fillna("").itertuples(index=False))
    assert told(first[:200], first[200:]) == [("", 150, 150, 0, 150, 300), ("m", 150, 150, 0, 150, 300)] and state.calls == 2
    assert told([attempt("m", 2, 5, 2, 1), attempt("m", 4, 4, 9, 1), attempt("m", 600, 1, 1, 1), attempt("m", 600, 1, 1, 0)]) == [("m", 1, 4, 2, 1, 2)] and state.calls == 4

    columns, folder, day = "method string, query_id string, at string, attempt long, hit long, calls long, tokens long", str(tmp_path), "2024-01-01 "
    for rows in ([("m", "q", day + "10:00:00", 1, 0, 1, 1), ("m", "p", day + "19:59:59", 1, 0, 1, 1)], [("m", "r", day + "21:00:00", 1, 0, 1, 1)], [("m", "q", day + "21:00:01", 2, 1, 1, 1), ("m", "r", day + "21:00:02", 2, 1, 1, 1), ("m", "p", day + "21:00:01", 2, 1, 1, 1)]):
        spark.createDataFrame(rows, columns).withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(f"{folder}/in")
        evaluated(spark, folder, buckets=1, horizon_ms=3_000_000)
    got = evaluation.totals(spark, f"{folder}/out").first()
    assert (got["queries"], got["attempts"], got["hits"]) == (4, 6, 3)  # q is another query, p is not


def test_a_block_answers_many_queries_as_one_by_one():
    """Short and long lists, ties, floors, terms that are nowhere, weights that are zero, negative or beyond single precision: the plain sums' lists."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    for n in (1, 40, 5000):
        sizes, words = rnd.integers(1, 40, n), [f"t{j}" for j in range(30)]
        lists = {w: (p := np.sort(rnd.choice(n, max(1, n * j // 30), replace=False)), rnd.integers(1, 4, len(p)) * (70_000 if j == 7 else 1)) for j, w in enumerate(words)}
        block = sparse.Block(pa.array(np.arange(n)), sizes, 20.0)
        pack = lambda x: pa.array([v.astype("<i4").tobytes() for v in x], pa.binary())
        for some in (words[:11], words[11:]):
            block.add(pa.array(some), pack(lists[w][0] for w in some), pack(lists[w][1] for w in some))
        asked = [[(w, float(x)) for w, x in zip(rnd.choice([*words, "nowhere"], 8, replace=False), rnd.uniform(0.1, 3, 8))] for _ in range(50)] + [[("t3", -1.0), ("t20", 2.0)], [("t9", 0.0)], [("t9", 1e-40), ("t4", 1.0)], [("nowhere", 1.0)], []]
        impacts = lambda w: lists[w][1] * 2.5 / (lists[w][1] + 1.5 * (0.25 + 0.75 * sizes[lists[w][0]] / 20.0))
        coded = pa.array([w for q in asked for w, _ in q]).dictionary_encode()
        weights, counts = np.array([x for q in asked for _, x in q]), np.array([len(q) for q in asked])
        want = []
        for q in asked:
            score, met = np.zeros(n), np.zeros(n, dtype=bool)
            for w, x in q:
                if w in lists:
                    score[lists[w][0]] += x * impacts(w)
                    met[lists[w][0]] = True
            want.append([(i, score[i]) for i in sorted(np.flatnonzero(met), key=lambda i: (-round(score[i], 9), i))[:10]])
        for place, left in ((None, 10), (3, 4)):
            floors = np.array([w[place][1] if place is not None and len(w) > place and w[place][1] > 0 else 0.0 for w in want])
            queries, places, scores = block.answers(coded.indices.to_numpy(), coded.dictionary, weights, counts, floors, 10)
            for j, w in enumerate(want):
                got, w = list(zip(places[queries == j].tolist(), scores[queries == j].tolist()))[: left if floors[j] else 10], w[: left if floors[j] else 10]
                assert [i for i, _ in got] == [i for i, _ in w] and np.allclose([x for _, x in got], [x for _, x in w], rtol=1e-12)
        assert n < 5000 or (len(block.long) > 20 and block.places.itemsize == 2)


def test_a_block_is_inverted_in_bounded_memory(monkeypatch):
    """A block's postings are the plain ones however few are sorted at a time; what is held beside the input is a few dozen bytes a posting at most."""
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(9)
    table = lambda b, docs: pa.RecordBatch.from_arrays([pa.array([""] * len(docs)), pa.array([b] * len(docs), pa.int32()), pa.array(list(docs), pa.int64()), pa.array(list(docs.values()), pa.list_(pa.string()))], names=["part", "b", "doc_id", "terms"])
    docs = {k: [f"w{x}" for x in rnd.zipf(1.3, rnd.integers(0, 300)) % 5000] for k in range(4000)}
    cut = lambda first, last: {k: docs[k] for k in range(first, last)}
    plain = {b: {} for b in (0, 1)}
    for k, words in docs.items():
        for w, c in Counter(words).items():
            plain[int(k >= 2500)].setdefault(w, []).append((k - 2500 * int(k >= 2500), c))
    for at_a_time in (1_000_000, 500):
        monkeypatch.setattr(sparse, "SORTED", at_a_time)
        got, numbers = {0: {}, 1: {}}, lambda x: np.frombuffer(x, "<i4").tolist()
        for rows in sparse._inverted(iter([table(0, cut(0, 2100)), table(0, cut(2100, 2500)), table(1, cut(2500, 4000))])):
            for r in rows.to_pylist():
                if r["term"] is None:
                    assert (r["ids"], numbers(r["tf"])) == (list(cut(*((0, 2500), (2500, 4000))[r["b"]])), [len(docs[i]) for i in r["ids"]]) and r["words"] == sum(numbers(r["tf"]))
                else:
                    got[r["b"]][r["term"]] = list(zip(numbers(r["places"]), numbers(r["tf"])))
        assert got == plain
    monkeypatch.setattr(sparse, "SORTED", 20_000)
    batches = [table(0, cut(k, k + 1000)) for k in range(0, 4000, 1000)]
    tracemalloc.start()
    made = sum(r["n"].to_numpy()[1:].sum() if r["n"][0].as_py() == 4000 and r["ids"][0].is_valid else r["n"].to_numpy().sum() for r in sparse._inverted(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == sum(len(set(w)) for w in docs.values()) and peak < 50 * made


def test_paraphrases_need_no_index(spark):
    """The sparse scorer is called for traces only."""
    original = spark.createDataFrame([(1, 5, 0.1, 1)], "query_id long, doc_id long, score double, rank int")
    variants = spark.createDataFrame([(1, "trace", 0, "a"), (1, "paraphrase", 0, "b")], "query_id long, kind string, ord int, text string")
    found = lambda asked, k: asked.select("query_id", F.lit(7).cast("long").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"))

    def never(asked, k):
        raise AssertionError("asked")

    got = gate.gated_retrieval(original, variants, "paraphrases", found, never).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(5, 1), (7, 2)]
    with pytest.raises(AssertionError, match="asked"):
        gate.gated_retrieval(original, variants, "selective", found, never)


def test_blocks_that_a_task_holds_give_their_best_together(spark, monkeypatch):
    """A query leaves a task with its k best of all blocks there, not of each; and no row that goes to the workers has a null list (Spark's Arrow writer goes over these again with every row)."""
    monkeypatch.setattr(sparse, "BLOCK_ROWS", 50)
    docs = spark.createDataFrame([(i, f"a w{i % 7} " + "x " * (i % 90)) for i in range(900)], "doc_id long, text string")
    index, asked = sparse.Index(docs), spark.createDataFrame([(1, "w3"), (2, "a w5 x")], "query_id long, query string")
    tasks = -(-index.stats.first()["blocks"] // sparse.GROUP_BLOCKS)
    assert index.stats.first()["blocks"] == 18 and tasks == 5
    scored = index.scored(asked, 2).collect()
    assert len(scored) <= 2 * 2 * tasks
    every = index.scored(asked, 900).collect()
    for q in (1, 2):
        best = sorted((-round(r.score, 9), r.doc_id) for r in every if r.query_id == q)[:2]
        assert [(r.doc_id, r["rank"]) for r in index.matched(asked, 2).where(f"query_id = {q}").orderBy("rank").collect()] == [(i, k + 1) for k, (_, i) in enumerate(best)]

    def nulls(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([float(sum(batch[c].null_count for c in ("ids", "terms", "weights")))])], names=["query_id", "doc_id", "score"])

    monkeypatch.setattr(sparse, "_answered", lambda k: nulls)
    assert {r.score for r in index.scored(asked, 2).collect()} == {0.0}


def test_sums_in_two_bytes_lose_nothing():
    """Weights that differ by far in one query and between queries, and more lists than roundings up leave room for."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(8)
    n, words = 3000, [f"t{j}" for j in range(6000)]
    lists = [np.sort(rnd.choice(n, size, replace=False)) for size in [*rnd.integers(500, 2900, 20), *rnd.integers(1, 30, 5980)]]
    tf, sizes = [rnd.integers(1, 60, len(p)) for p in lists], rnd.integers(1, 30_000, n)
    block, pack = sparse.Block(pa.array(np.arange(n)), sizes, 300.0), lambda x: pa.array([v.astype("<i4").tobytes() for v in x], pa.binary())
    block.add(pa.array(words), pack(lists), pack(tf))
    asked = [(rnd.choice(6000, 24, replace=False), 10.0 ** rnd.uniform(-e, e, 24)) for e in (0, 1, 4, 9) for _ in range(20)] + [(np.concatenate([np.arange(20), rnd.choice(6000, 9, replace=False)]), np.full(29, 1e-3)), (np.arange(6000), np.full(6000, 2.0))]
    coded = pa.array([words[j] for own, _ in asked for j in own]).dictionary_encode()
    weights, counts = np.concatenate([w for _, w in asked]), np.array([len(w) for _, w in asked])
    score = np.zeros((len(asked), n))
    for q, (own, w) in enumerate(asked):
        for j, x in zip(own, w):
            score[q, lists[j]] += x * tf[j] * 2.5 / (tf[j] + 1.5 * (0.25 + 0.75 * sizes[lists[j]] / 300.0))
    for floors in (np.zeros(len(asked)), np.sort(score, axis=1)[:, -4] * (1 - 1e-12)):
        queries, places, scores = block.answers(coded.indices.to_numpy(), coded.dictionary, weights, counts, floors, 10)
        for q in range(len(asked)):
            want = np.sort(score[q][score[q] > 0])[::-1][: 4 if floors[q] else 10]
            own = queries == q
            assert np.allclose(scores[own][: len(want)], want, rtol=1e-9) and np.allclose(score[q, places[own]], scores[own], rtol=1e-9)


def test_words_are_split_and_hashed_as_in_columns(spark):
    """Splitting and MD5 many words at a time: white space of ASCII only, empty texts, words of one block and of more."""
    import hashlib

    import pyarrow as pa

    from sievekit.functions.hashing import md5_52

    texts = ["A  b\x0bc\x0cd\te\nf\r\ng", " x ", "", "   ", None, "\x1cq z y w \x85v", "İß ΑΣ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.tokens(F.col("t")).alias("w"), text.lowered(F.col("t")).alias("l")).orderBy("i").collect()
    assert text.split_words(pa.array([r.l for r in rows])).to_pylist() == [r.w for r in rows]
    assert text.split_words(pa.array(["q", "", "a b"]).slice(1)).to_pylist() == [[], ["a", "b"]]
    words = ["", *("é" * j for j in range(1, 40)), *(("ab" * 60)[:j] for j in range(1, 120))] * 100
    want = [int(hashlib.md5(w.encode()).hexdigest()[:13], 16) for w in words]
    assert md5_52(pa.array(words)).tolist() == want and md5_52(pa.array(words).slice(3, 50)).tolist() == want[3:53] and md5_52(pa.array([], pa.string())).tolist() == []


def test_the_kth_of_rows_in_any_order():
    import numpy as np

    from sievekit.operators.blocks import kth_of

    assert kth_of(np.array([2, 0, 2, 0, 0, 3]), np.array([1.0, 5.0, 4.0, 7.0, 6.0, 9.0]), 5, 2).tolist() == [6.0, -np.inf, 1.0, -np.inf, -np.inf]
