"""Joins by key, and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.functions.ranks import tolerance
from sievekit.functions.text import percent, percent_range, signed_percent, table_cell
from sievekit.operators import episodes, metrics, validate
from sievekit.plans.analytics import AUDIT, RESULTS, audit, results
from sievekit.plans.fixtures import KNOWN, PAIRS, d, draw, known_items, pairs, table
from sievekit.plans.registry import query


def two_runs(spark, sf_dir):
    """Two methods' rows, each without some of the queries."""
    p = pairs(spark, sf_dir)
    return p.where("doc_id % 10 <> 3").select("seed", "query_id", "hit_a"), p.where("doc_id % 10 <> 7").select("seed", "query_id", "hit_b")


RUNS = f"{PAIRS}, ra AS (SELECT seed, query_id, hit_a FROM pairs WHERE doc_id % 10 <> 3), rb AS (SELECT seed, query_id, hit_b FROM pairs WHERE doc_id % 10 <> 7)"


@query("join_pairs", f"WITH {RUNS} SELECT seed, query_id, hit_a, hit_b FROM ra JOIN rb USING (seed, query_id)")
def join_pairs(spark, sf_dir):
    a, b = two_runs(spark, sf_dir)
    return a.join(b, ["seed", "query_id"])


@query("join_orphans", f"WITH {RUNS} SELECT query_id, CASE WHEN ra.query_id IS NULL THEN 'a' ELSE 'b' END AS missing FROM ra FULL JOIN rb USING (seed, query_id) WHERE ra.query_id IS NULL OR rb.query_id IS NULL")
def join_orphans(spark, sf_dir):
    a, b = two_runs(spark, sf_dir)
    both = a.join(b, ["seed", "query_id"], "full_outer").where("hit_a is null or hit_b is null")
    return both.select("query_id", F.when(F.col("hit_a").isNull(), "a").otherwise("b").alias("missing"))


@query("join_triple", f"WITH {RUNS} SELECT query_id, hit_a, hit_b, sparse <= 10 AS agrees FROM ra JOIN rb USING (seed, query_id) JOIN pairs USING (seed, query_id)".replace("hit_a, hit_b, sparse", "ra.hit_a, rb.hit_b, sparse"))
def join_triple(spark, sf_dir):
    a, b = two_runs(spark, sf_dir)
    third = pairs(spark, sf_dir).select("seed", "query_id", (F.col("sparse") <= 10).alias("agrees"))
    return a.join(b, ["seed", "query_id"]).join(third, ["seed", "query_id"]).select("query_id", "hit_a", "hit_b", "agrees")


@query("join_lookup", "WITH r AS (SELECT doc_id, unnest([doc_id + 1, doc_id * 2, doc_id + 7]) AS id, unnest([0, 1, 2]) AS pos FROM documents) SELECT r.doc_id, coalesce(string_agg(CASE WHEN m.doc_id IS NOT NULL THEN CAST(id AS VARCHAR) END, ',' ORDER BY pos), '') AS found, coalesce(string_agg(CASE WHEN m.doc_id IS NULL THEN CAST(id AS VARCHAR) END, ',' ORDER BY pos), '') AS missing FROM r LEFT JOIN documents m ON m.doc_id = r.id GROUP BY 1")
def join_lookup(spark, sf_dir):
    """Ids of a list to the memories they name, in order; ids without one are kept apart."""
    ids = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array(ids + 1, ids * 2, ids + 7)).alias("pos", "id"))
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(True).alias("known"))
    listed = rows.join(known, "id", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "known"))).alias("x"))
    part = lambda keep: F.array_join(F.transform(F.filter("x", keep), lambda e: e["id"].cast("string")), ",")
    return listed.select("doc_id", part(lambda e: e["known"].isNotNull()).alias("found"), part(lambda e: e["known"].isNull()).alias("missing"))


CELL = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query("join_case", f"WITH {PAIRS}, {KNOWN} SELECT p.query_id, coalesce(CASE WHEN length(q.query) <= 82 THEN q.query ELSE rtrim(left(q.query, 79)) || '...' END, p.query_id) AS query, hit_a, hit_b FROM pairs p LEFT JOIN kq q ON q.query_id = p.doc_id WHERE hit_a <> hit_b")
def join_case(spark, sf_dir):
    told = known_items(spark, sf_dir).select(F.col("query_id").alias("doc_id"), "query")
    rows = pairs(spark, sf_dir).where("hit_a <> hit_b").join(told, "doc_id", "left")
    return rows.select("query_id", F.coalesce(table_cell(F.col("query")), "query_id").alias("query"), "hit_a", "hit_b")


@query("join_semi", "SELECT count(*) AS n FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n"))


@query("join_anti", "SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first, any_value(n) AS n FROM (SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE k <= 10")
def join_anti(spark, sf_dir):
    """The first ten missing keys, and how many there are."""
    gone = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    first = gone.orderBy("doc_id").limit(10).agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first"))
    return first.crossJoin(F.broadcast(gone.agg(F.count("*").alias("n"))))  # two single rows


@query("join_resume", f"WITH {RESULTS} SELECT CAST(task_id AS VARCHAR) AS task_id, method FROM (SELECT DISTINCT task_id, method FROM res) WHERE (task_id, method) NOT IN (SELECT task_id, method FROM res WHERE event_id < 100)")
def join_resume(spark, sf_dir):
    rows = results(spark, sf_dir)
    return episodes.resumed(rows.select("task_id", "method").distinct(), rows.where("event_id < 100"), ["task_id", "method"])


@query("join_compare", "SELECT d.doc_id, f.field FROM documents d, (VALUES ('lang'), ('source')) f(field) WHERE (field = 'lang' AND doc_id % 13 = 0 AND lang <> 'en') OR (field = 'source' AND doc_id % 17 = 0)")
def join_compare(spark, sf_dir):
    source = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = source.select("doc_id", F.when(F.col("doc_id") % 13 == 0, "en").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 17 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")).alias("source"))
    return validate.unchanged(source, changed, "doc_id", ["lang", "source"]).select(F.col("key").cast("long").alias("doc_id"), F.col("detail").alias("field"))


def told_and_found(spark, sf_dir):
    found = metrics.recall(pairs(spark, sf_dir).withColumn("place", F.col("place_a")), ["seed"], (5,)).select("seed", F.col("recall_5").alias("v"))
    return found.where("seed <> 49").withColumn("v", F.col("v") + F.when(F.col("seed") == 44, 2e-9).otherwise(F.lit(0.0))), found


@query("join_recon", f"WITH {PAIRS}, f AS (SELECT seed, avg(CAST(hit_a AS INTEGER)) AS v FROM pairs GROUP BY 1), t AS (SELECT seed, v + CASE WHEN seed = 44 THEN 2e-9 ELSE 0 END AS v FROM f WHERE seed <> 49) SELECT f.seed AS seed FROM f LEFT JOIN t USING (seed) WHERE t.v IS NULL OR abs(t.v - f.v) > 1e-9")
def join_recon(spark, sf_dir):
    a, b = told_and_found(spark, sf_dir)
    both = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "seed", "full_outer")
    return both.where(tolerance(F.col("a"), F.col("b"))).select("seed")


@query("join_fold", f"WITH {PAIRS}, s AS (SELECT seed, avg(CAST(hit_a AS INTEGER)) AS r, count(*) AS n FROM pairs GROUP BY 1) SELECT a.seed AS test_seed, round(sum(b.r * b.n) / sum(b.n), 6) AS recall FROM s a JOIN s b ON a.seed <> b.seed GROUP BY 1")
def join_fold(spark, sf_dir):
    """Each seed against all others: totals less the own part."""
    from sievekit.operators.calibrate import evaluated, leave_one_out

    scored = evaluated(pairs(spark, sf_dir), [("score_only", 0.0)], ["seed"])
    return leave_one_out(scored).select("test_seed", F.round("recall", 6).alias("recall"))


@query("upsert", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END AS source FROM documents")
def upsert(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    return episodes.upserted(old, old.where("doc_id % 5 = 0").withColumn("source", F.lit("new")), ["doc_id"])


# validators: check, severity, key, detail
def sql(check: str, key: str, detail: str, rest: str, severity: str = "failure") -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail {rest}"


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("v_required", sql("required", "doc_id", "f", "FROM (SELECT doc_id, 'lang' AS f, CASE WHEN doc_id % 6 <> 0 THEN lang END AS v FROM documents UNION ALL SELECT doc_id, 'source', CASE WHEN doc_id % 9 <> 0 THEN source ELSE '' END FROM documents) WHERE coalesce(v, '') = ''"))
def v_required(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 9 != 0, F.col("source")).otherwise("").alias("source"))
    return validate.required(rows, "doc_id", ["lang", "source"])


@query("v_domain", sql("domain", "doc_id", "lang", "FROM documents WHERE lang NOT IN ('en', 'de', 'fr')"))
def v_domain(spark, sf_dir):
    return validate.domain(documents(spark, sf_dir), "doc_id", "lang", ["en", "de", "fr"])


@query("v_unique", f"WITH {RESULTS} " + sql("unique", "concat_ws('|', CAST(task_id AS VARCHAR), method)", "count(*)", "FROM res GROUP BY task_id, method HAVING count(*) > 1"))
def v_unique(spark, sf_dir):
    return validate.unique(results(spark, sf_dir), ["task_id", "method"])


@query("v_refint", sql("reference", "doc_id", "'missing'", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def v_refint(spark, sf_dir):
    return validate.referenced(documents(spark, sf_dir).select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("v_cond", f"WITH {RESULTS} " + sql("conditional", "event_id", "'failed rows need a reason'", "FROM res WHERE NOT success AND event_id % 4 = 0"))
def v_cond(spark, sf_dir):
    rows = results(spark, sf_dir).withColumn("reason", F.when(F.col("event_id") % 4 != 0, "r"))
    return validate.conditional(rows, "event_id", ~F.col("success"), F.col("reason").isNotNull(), "failed rows need a reason")


@query("v_type", "SELECT 'type' AS \"check\", 'failure' AS severity, CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 3 = 0 THEN 'maybe' ELSE CAST(-1 AS VARCHAR) END AS detail FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def v_type(spark, sf_dir):
    """success has to be a boolean and runtime a number of at least 0, as they stand in JSON."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "maybe").otherwise("true").alias("success"), F.when(F.col("event_id") % 5 == 0, "-1").otherwise("2.5").alias("runtime"))
    bad = F.when(~F.col("success").isin("true", "false"), F.col("success")).when(F.coalesce(F.expr("try_cast(runtime AS DOUBLE)"), F.lit(-1.0)) < 0, F.col("runtime"))
    return validate.failed(rows.where(bad.isNotNull()), "type", F.col("event_id"), bad)


@query("v_coverage", f"WITH {RESULTS}, r AS (SELECT DISTINCT task_id, method FROM res WHERE NOT (method = 'click' AND task_id < 5)), c AS (SELECT method, count(*) AS n FROM r GROUP BY 1), t AS (SELECT count(DISTINCT task_id) AS total FROM r) SELECT 'coverage' AS \"check\", 'failure' AS severity, method AS key, n || ' of ' || total AS detail FROM c, t WHERE n < total UNION ALL SELECT 'too few', 'failure', method, CAST(n AS VARCHAR) FROM c WHERE n < 50")
def v_coverage(spark, sf_dir):
    rows = results(spark, sf_dir).where("not (method = 'click' and cast(task_id as int) < 5)")
    return validate.coverage(rows, "method", "task_id", 50)


@query("v_recon", f"WITH {PAIRS}, f AS (SELECT seed, avg(CAST(hit_a AS INTEGER)) AS v FROM pairs GROUP BY 1) " + sql("reconcile", "seed", "'v'", "FROM f WHERE seed IN (44, 49)"))
def v_recon(spark, sf_dir):
    return validate.reconciled(*told_and_found(spark, sf_dir), ["seed"], "v")


@query("v_immutable", sql("unchanged", "doc_id", "CASE WHEN doc_id % 23 = 5 THEN 'row gone' ELSE 'source' END", "FROM documents WHERE doc_id % 17 = 0 OR doc_id % 23 = 5"))
def v_immutable(spark, sf_dir):
    source = documents(spark, sf_dir).select("doc_id", "source")
    labelled = source.withColumn("source", F.when(F.col("doc_id") % 17 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source"))).where("doc_id % 23 <> 5")
    return validate.unchanged(source, labelled, "doc_id", ["source"])


@query("v_blank", f"WITH {AUDIT} " + sql("blank", "doc_id", "'clear'", "FROM audit WHERE clear <> 'uncertain'"))
def v_blank(spark, sf_dir):
    return validate.blank(audit(spark, sf_dir).withColumn("clear", F.when(F.col("clear") == "uncertain", "  ").otherwise(F.col("clear"))), "doc_id", ["clear"])


@query("v_meta", f"WITH {PAIRS} " + sql("meta", "doc_id", "expanded", f"FROM pairs WHERE {d('odd')} % 10 = 0 OR doc_id % 29 = 7"))
def v_meta(spark, sf_dir):
    odd, e = draw("odd") % 10 == 0, F.col("expanded")
    rows = pairs(spark, sf_dir).select("doc_id", "expanded", F.when(e, 2).otherwise(0).alias("n_traces"), F.when(e, 2).otherwise(0).alias("n_paraphrases"), F.when(e, 7).otherwise(1).alias("n_lists"), F.when(F.col("doc_id") % 29 != 7, F.when(odd, F.when(e, 0).otherwise(1)).otherwise(F.when(e, 3).otherwise(0))).alias("calls"))
    return validate.gate_meta(rows, "doc_id")


@query("v_complete", f"WITH {PAIRS}, c AS (SELECT seed, count(*) AS n FROM pairs GROUP BY 1) SELECT 'complete' AS \"check\", 'failure' AS severity, CAST(g AS VARCHAR) AS key, CAST(coalesce(n, 0) AS VARCHAR) AS detail FROM range(42, 51) r(g) LEFT JOIN c ON c.seed = g WHERE coalesce(n, 0) <> 125")
def v_complete(spark, sf_dir):
    return validate.complete(pairs(spark, sf_dir), "seed", 125, list(range(42, 51)))


@query("v_phrases", "SELECT 'phrase' AS \"check\", 'failure' AS severity, CAST(doc_id AS VARCHAR) AS key, p AS detail FROM documents, (VALUES ('.', true), ('Licensed under', false), ('###', false)) t(p, needed) WHERE contains(text, p) <> needed")
def v_phrases(spark, sf_dir):
    return validate.phrases(documents(spark, sf_dir), "doc_id", "text", ["."], ["Licensed under", "###"])


@query("v_text", sql("pattern", "doc_id || ':' || pos", "'[Ll]icense'", "FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(line, '[Ll]icense')", "warning"))
def v_text(spark, sf_dir):
    return validate.pattern_lines(documents(spark, sf_dir), "doc_id", "text", "[Ll]icense")


@query("v_section", "SELECT 'section' AS \"check\", 'failure' AS severity, CAST(doc_id AS VARCHAR) AS key, '3' AS detail FROM documents WHERE doc_id % 3 = 0")
def v_section(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("# Head\nx 3\n## Limits\nvalue "), (F.col("doc_id") % 3 + 3).cast("string"), F.lit("\n# Next\n 3")).alias("text"))
    return validate.section_lacks(rows, "doc_id", "text", "## Limits", "3")


@query("v_dim", sql("dimension", "vec_id", "CASE WHEN vec_id % 20 = 0 THEN 63 ELSE 64 END", "FROM embeddings WHERE vec_id % 20 = 0"))
def v_dim(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 20 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("embedding"))
    return validate.dimension(rows, "vec_id", "embedding", 64)


@query("v_forbidden", sql("forbidden", "doc_id", "f", "FROM (SELECT doc_id, 'reward' AS f FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'success' FROM documents WHERE doc_id % 7 = 0)"))
def v_forbidden(spark, sf_dir):
    """Result fields in rows that must not have any, with and without a value."""
    row = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ', "reward": null').otherwise(""), F.when(F.col("doc_id") % 7 == 0, ', "success": true').otherwise(""), F.lit("}"))
    return validate.forbidden(documents(spark, sf_dir).select("doc_id", row.alias("row")), "doc_id", "row", ["reward", "success", "runtime_seconds"])


@query("v_table", f"WITH {PAIRS}, r AS (SELECT seed, avg(CAST(hit_a AS INTEGER)) AS a, avg(CAST(hit_b AS INTEGER)) AS b FROM pairs GROUP BY 1) " + sql("table", "seed", "'seed ' || CAST(seed AS VARCHAR) || ' & ' || printf('%.1f', 100 * a) || ' & ' || printf('%+.1f', 100 * (b - a)) || ' ' || chr(92) || chr(92)", "FROM r WHERE seed IN (43, 47)"))
def v_table(spark, sf_dir):
    """Metrics as the rows of a rendered table show them; the table lacks one seed and shows another one wrong."""
    found = pairs(spark, sf_dir).groupBy("seed").agg(metrics.rate(F.col("hit_a")).alias("a"), metrics.rate(F.col("hit_b")).alias("b"))
    line = lambda a, b: F.concat(F.lit("seed "), F.col("seed").cast("string"), F.lit(" & "), percent(a), F.lit(" & "), signed_percent(b - a), F.lit(r" \\"))
    shown = found.where("seed <> 43").withColumn("a", F.col("a") + F.when(F.col("seed") == 47, 0.01).otherwise(0.0)).select(line(F.col("a"), F.col("b")).alias("text"))
    return validate.rendered(found, "seed", line(F.col("a"), F.col("b")), shown, "text")


@query("v_provenance", """WITH i AS (SELECT DISTINCT source AS tab, lang AS src FROM documents WHERE source <> 'src4') SELECT 'provenance' AS "check", 'failure' AS severity, 'src4' AS key, 'no entry' AS detail
UNION ALL SELECT 'provenance', 'failure', 'src6', 'no table' UNION ALL SELECT 'provenance', 'failure', tab, 'no source de' FROM i WHERE src = 'de'""")
def v_provenance(spark, sf_dir):
    """An inventory of sources as tables and languages as what they come from: one table unlisted, one not made, one source gone."""
    d = documents(spark, sf_dir)
    inventory = d.where("source <> 'src4'").select(F.col("source").alias("table"), F.col("lang").alias("source")).distinct()
    return validate.provenance(inventory, d.where("source <> 'src6'").select(F.col("source").alias("table")), d.where("lang <> 'de'").select(F.col("lang").alias("source")))


@query("percent_cells", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '--' ELSE printf('%.1f', 100 * (event_id % 64 / 64::DOUBLE)) END AS share, CASE WHEN event_id % 6 = 0 THEN '--' ELSE printf('%+.1f', 100 * (event_id % 64 / 64::DOUBLE - 0.25::DOUBLE)) END AS signed, CASE WHEN event_id % 6 = 0 THEN '--' ELSE printf('%.1f', 100 * (event_id % 64 / 64::DOUBLE)) || CASE WHEN event_id % 5 = 0 THEN '' ELSE ' $' || chr(92) || 'pm$ ' || printf('%.1f', 100 * (event_id % 9 / 16::DOUBLE)) END END AS spread FROM events")
def percent_cells(spark, sf_dir):
    x = F.when(F.col("event_id") % 6 != 0, F.col("event_id") % 64 / 64.0)
    spread = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 9 / 16.0)
    rows = table(spark, sf_dir, "events").select("event_id", x.alias("x"), spread.alias("s"))
    return rows.select("event_id", percent("x").alias("share"), signed_percent(F.col("x") - 0.25).alias("signed"), percent_range(F.col("x"), F.col("s")).alias("spread"))


@query("v_readiness", """WITH b AS (SELECT 'domain' AS name, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT 'reference', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
e AS (SELECT name, string_agg(key, ',' ORDER BY key) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) AS k FROM b) WHERE k <= 5 GROUP BY name)
SELECT c.name, CASE WHEN e.name IS NULL THEN 'pass' ELSE 'fail' END AS status, c.required, coalesce(evidence, '') AS evidence, c.required AND e.name IS NOT NULL AS blocking FROM (VALUES ('domain', true), ('reference', false), ('unique', true), ('pattern', true)) c(name, required) LEFT JOIN e ON e.name = c.name""")
def v_readiness(spark, sf_dir):
    """The roll-up: required and optional checks with evidence, and whether they block; warnings do not."""
    d = documents(spark, sf_dir)
    checks = validate.report(v_domain(spark, sf_dir), v_refint(spark, sf_dir), validate.unique(d.select("doc_id"), ["doc_id"]), v_text(spark, sf_dir))
    return validate.readiness(checks, {"domain": True, "reference": False, "unique": True, "pattern": True})


@query("v_rollup", f"WITH {RESULTS} SELECT 'domain' AS \"check\", 'failure' AS severity, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de', 'fr') HAVING count(*) > 0 UNION ALL SELECT 'reference', 'failure', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) HAVING count(*) > 0")
def v_rollup(spark, sf_dir):
    return validate.rolled_up(validate.report(v_domain(spark, sf_dir), v_refint(spark, sf_dir)))
