"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator has a defined result."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sievekit.llm import bpe, editprint, mixing, quality, secrets, simhash, suffix, topk, toxicity, warc

ROWS = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, "word " * 6000), (None, "no id here"), (5, "tie tie tie"), (6, "tie tie tie")]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns whose names the operators use inside."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string")
    return rows.withColumns({c: F.lit(7) for c in ("score", "rank", "fp", "th", "doc", "h", "b", "y", "rate", "tokens", "spans", "bucket", "page", "digest")}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (4, None, None), (None, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


def test_bpe(odd, none):
    got = bpe.encode_table(odd, bpe.default_vocabulary()).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert {r.ids_sha256 for r in got if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert bpe.encode_table(none, bpe.default_vocabulary()).count() == 0


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert {r.fingerprint for r in got if r.doc_id in (2, 3)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.near_duplicates(none).count() == 0


def test_suffix(odd, none):
    got = suffix.remove_repeats(odd).collect()
    assert len(got) == len(ROWS)
    assert {(r.n_removed, r.n_spans) for r in got if r.doc_id in (1, 2, 3, 5, 6, None)} == {(0, 0)}
    assert [(r.n_bytes, r.n_removed) for r in got if r.doc_id == 4] == [(30000, 30000 - 5)]
    assert suffix.remove_repeats(none).count() == 0


def test_suffix_repeated_ids(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(240))
    rows = spark.createDataFrame([(7, text), (7, text), (9, "x" + text), (7, "other " + text[:150])], "doc_id long, text string")
    got = suffix.remove_repeats(rows).collect()
    # the two equal rows are one document; the third row of id 7 and row 9 repeat, whichever of id 7 comes first
    assert len(got) == 4
    same = [r for r in got if r.n_bytes == 240]
    assert same[0] == same[1]
    assert [r.n_removed >= 140 for r in got if r.doc_id == 9] == [True]


def test_editprint(odd, none):
    got = editprint.edited_fingerprints(odd).collect()
    assert len(got) == len(ROWS)
    assert {(r.n_chars, r.fingerprint, r.near_edited) for r in got if r.doc_id in (2, 3)} == {(0, "", 1.0)}
    assert len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert editprint.edited_fingerprints(none).count() == 0
    classes = {(r.doc_id, r.class_id) for r in editprint.near_classes(editprint.fingerprints(odd)).collect()}
    assert {(5, 5), (6, 5), (1, 1), (3, 2)} <= classes


def test_single_document_is_its_own_next(spark):
    row = editprint.edited_fingerprints(spark.createDataFrame([(1, "abcdefghi")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and row.near_next == 1.0


def test_secrets(odd, none):
    got = secrets.find_secrets(odd).collect()
    assert len(got) == len(ROWS) and {r.spans for r in got} == {""}
    assert secrets.find_secrets(none).count() == 0
    long = odd.sparkSession.createDataFrame([(1, "Ab3" * 40_000), (2, "x " * 50_000 + "token=abcdefgh")], "doc_id long, text string")
    assert {r.doc_id: (r.spans, r.n_random) for r in secrets.find_secrets(long).collect()} == {1: ("", 0), 2: ("assign:100000:100014", 0)}
    assert secrets.redact(odd).columns == odd.columns
    assert secrets.redact(odd).exceptAll(odd).count() == 0 and secrets.redact(none).count() == 0


def test_toxicity(odd, none, labels):
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.scored(odd, labels.limit(0)).count() == len(ROWS) and toxicity.scored(none, labels).count() == 0
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_quality(odd, none, labels):
    got = quality.scored(odd, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(odd, labels.limit(0)).count() == len(ROWS) and quality.scored(none, labels).count() == 0


def test_mixing(odd, none, labels):
    shares = {"prime": 0.5, "rough": 0.3, "toxic": 0.2}
    got = mixing.mixed(odd, mixing.label_domains(labels), shares).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 for r in got) and all(r.rate == 1 for r in got if r.tokens == 0)
    assert mixing.mixed(odd, mixing.label_domains(labels).limit(0), shares).count() == len(ROWS)
    assert mixing.mixed(none, mixing.label_domains(labels), shares).count() == 0
    more = mixing.mix(odd, mixing.label_domains(labels), shares, least=1.0)
    assert more.columns == odd.columns and odd.exceptAll(more).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "v": F.lit(2), "query_id": F.lit(3)})
    got = topk.top_k(table, F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 65536), (0, 2, 5, 65536)]
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc(spark):
    long = "p" * 1500
    rows = [(1, "u", long), (1, "u", long), (2, None, long), (3, "u\nv", None), (4, "u", ""), (None, "u", long), (5, "u", "short"), (6, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"page": F.lit(1), "digest": F.lit("d"), "bytes": F.lit(2), "keeper": F.lit(3)})
    got = sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.roundtrip(pages).collect())
    assert got == [(0, 1500, "revisit", 2), (1, 1500, "revisit", 2), (1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None)]
    assert warc.roundtrip(pages.limit(0)).count() == 0


def test_very_long_texts(spark, labels):
    """Whole texts of some 400,000 characters count, up to their ends."""
    words = [f"w{k * 7919 % 100_003}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["other"])), (3, "short")]
    long = spark.createDataFrame(rows, "doc_id long, text string")
    walk = editprint.Walk()
    assert {r.doc_id: r.fingerprint for r in editprint.edited_fingerprints(long).collect()} == {i: walk.fingerprint(t) for i, t in rows}
    assert len({walk.fingerprint(t)[-2:] for _, t in rows[:2]}) == 2
    for made in (toxicity.scored(long, labels), quality.scored(long, labels)):
        assert all(0 <= r.score <= 1 for r in made.collect())
    assert [r.doc_id for r in simhash.near_copies(long).orderBy("doc_id").collect()] == [1, 3]
    table = quality.statistics(F.col("text"))
    assert [round(2.718281828 ** r[0][1]) for r in long.orderBy("doc_id").select(table).collect()] == [60_001, 60_001, 2]


def test_pipeline_stages(spark, labels, tmp_path):
    """Nulls in any column, empty texts, repeated rows, columns of the stages' own names, and empty tables, through every stage."""
    import corpus_pipeline

    labels.drop("text").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c d e f token=abcdefgh", "en", "s", 26), (1, "a b c d e f token=abcdefgh", "en", "s", 26), (2, None, None, None, None), (3, "", "de", None, 0), (None, "no id here", "en", "s", 10), (4, "word " * 3000, "en", None, 15000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("own", "row", "node", "__row", "__tokens", "__base", "body", "new", "cell", "rate", "copy", "m")})
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept, before = stage(spark, kept, str(tmp_path)).cache(), kept
        assert kept.columns == docs.columns and stage(spark, before.limit(0), str(tmp_path)).count() == 0, name
        assert {r[c] for r in kept.collect() for c in ("own", "row", "node", "__row", "body", "m")} == {7}
        if name == "near_duplicates":  # the null text is an empty one, the repeated row is one
            assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4]
        if name == "secrets":
            assert {(r.text, r.n_chars) for r in kept.where("doc_id = 1").collect()} == {("a b c d e f [SECRET]", 20)}
            assert [(r.text, r.n_chars) for r in kept.where("doc_id = 2").collect()] == [(None, None)]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert last.count() == kept.count() and corpus_pipeline.STAGES[-1][1](spark, kept.limit(0), str(tmp_path)).count() == 0
