"""Validators: each gives rows check, severity, key, detail; no rows mean that it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.functions.ranks import tolerance


def failed(rows: DataFrame, check: str, key: Column, detail: Column, severity: str = "failure") -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def required(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A failure for each null or empty required field."""
    missing = F.explode(F.filter(F.array(*[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    return failed(rows.select(key, missing.alias("field")), "required", F.col(key), F.col("field"))


def domain(rows: DataFrame, key: str, field: str, allowed: list[str]) -> DataFrame:
    return failed(rows.where(~F.coalesce(F.col(field).isin(*allowed), F.lit(False))), "domain", F.col(key), F.coalesce(F.col(field), F.lit("null")))


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A failure for each key that more than one row has."""
    return failed(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "unique", F.concat_ws("|", *keys), F.col("n"))


def referenced(rows: DataFrame, key: str, to: DataFrame, to_key: str) -> DataFrame:
    return failed(rows.join(to.select(F.col(to_key).alias("__to")).distinct(), F.col(key) == F.col("__to"), "left_anti"), "reference", F.col(key), F.lit("missing"))


def conditional(rows: DataFrame, key: str, when: Column, then: Column, detail: str) -> DataFrame:
    return failed(rows.where(when & ~F.coalesce(then, F.lit(False))), "conditional", F.col(key), F.lit(detail))


def coverage(rows: DataFrame, group: str, item: str, least: int = 0) -> DataFrame:
    """A failure for each group that lacks items which others have (how many), and for each with fewer than `least`."""
    counts = rows.select(group, item).distinct().groupBy(group).agg(F.count("*").alias("n"))
    total = rows.agg(F.count_distinct(item).alias("total"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    return failed(both.where("n < total"), "coverage", F.col(group), F.concat_ws(" of ", "n", "total")).unionByName(failed(both.where(F.col("n") < least), "too few", F.col(group), F.col("n")))


def reconciled(told: DataFrame, found: DataFrame, keys: list[str], value: str, most: float = 1e-9) -> DataFrame:
    """A failure for each key that only one side has or where values differ by more than `most`."""
    both = told.select(*keys, F.col(value).alias("a")).join(found.select(*keys, F.col(value).alias("b")), keys, "full_outer")
    return failed(both.where(tolerance(F.col("a"), F.col("b"), most)), "reconcile", F.concat_ws("|", *keys), F.lit(value))


def unchanged(source: DataFrame, labelled: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A failure for each source field that differs, compared as text, and for each row that only one side has."""
    side = lambda rows, name: rows.select(key, F.lit(True).alias(name), *[F.col(f).cast("string").alias(f"{name}_{f}") for f in fields])
    both = side(source, "a").join(side(labelled, "b"), key, "full_outer")
    differs = F.filter(F.array(*[F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    what = F.when(F.col("b").isNull(), F.array(F.lit("row gone"))).when(F.col("a").isNull(), F.array(F.lit("row new"))).otherwise(differs)
    return failed(both.select(key, F.explode(what).alias("field")), "unchanged", F.col(key), F.col("field"))


def gate_meta(rows: DataFrame, key: str) -> DataFrame:
    """Expanded rows need traces, paraphrases, several lists and calls; others must have none. A count that is missing is a failure."""
    full = (F.col("n_traces") >= 1) & (F.col("n_paraphrases") >= 1) & (F.col("n_lists") > 1) & (F.col("calls") >= 1)
    none = (F.col("n_traces") == 0) & (F.col("n_paraphrases") == 0) & (F.col("n_lists") <= 1) & (F.col("calls") == 0)
    return failed(rows.where(~F.coalesce(F.when(F.col("expanded"), full).otherwise(none), F.lit(False))), "meta", F.col(key), F.col("expanded"))


def phrases(docs: DataFrame, key: str, text: str, needed: list[str], banned: list[str]) -> DataFrame:
    """A failure for each needed phrase that a text lacks and each banned one that it has. The phrases are given in the call: an explode, not a join."""
    listed = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(n).alias("needed")) for p, n in [*((p, True) for p in needed), *((p, False) for p in banned)]])
    bad = docs.select(key, F.explode(F.filter(listed, lambda x: F.coalesce(F.contains(F.col(text), x["phrase"]), F.lit(False)) != x["needed"])).alias("x"))
    return failed(bad, "phrase", F.col(key), F.col("x.phrase"))


def pattern_lines(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """A warning for each line that a pattern is found in, with its 1-based number."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(pattern))
    return failed(lines, "pattern", F.concat_ws(":", F.col(key), F.col("pos") + 1), F.lit(pattern), "warning")


def section_lacks(docs: DataFrame, key: str, text: str, marker: str, phrase: str) -> DataFrame:
    """The text after a marker up to the next heading must not hold a phrase."""
    after = F.when(F.instr(F.col(text), marker) > 0, F.substring_index(F.substring(F.col(text), F.instr(F.col(text), marker) + len(marker), F.length(text)), "\n#", 1))
    return failed(docs.where(F.coalesce(F.contains(after, F.lit(phrase)), F.lit(False))), "section", F.col(key), F.lit(phrase))


def dimension(vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    return failed(vectors.where(F.coalesce(F.size(vector), F.lit(-1)) != size), "dimension", F.col(key), F.size(vector))


def blank(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    filled = F.explode(F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", F.lit(f)) for f in fields]), lambda x: x.isNotNull()))
    return failed(rows.select(key, filled.alias("field")), "blank", F.col(key), F.col("field"))


def complete(rows: DataFrame, group: str, size: int, groups: list[int]) -> DataFrame:
    """A failure for each expected group whose number of rows is not the expected one."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    expected = rows.sparkSession.createDataFrame([(g,) for g in groups], f"{group} long")
    return failed(expected.join(counts, group, "left").where(F.coalesce("n", F.lit(0)) != size), "complete", F.col(group), F.coalesce("n", F.lit(0)))


def forbidden(rows: DataFrame, key: str, json: str, fields: list[str]) -> DataFrame:
    """A failure for each field that a JSON object must not have, be its value null or not."""
    names = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    return failed(rows.select(key, F.explode(F.array_intersect(F.array(*map(F.lit, fields)), names)).alias("field")), "forbidden", F.col(key), F.col("field"))


def rendered(rows: DataFrame, key: str, line: Column, document: DataFrame, text: str) -> DataFrame:
    """A failure for each row whose rendered line is not a line of the document (rows of a text column, cut at line ends; white space at the ends does not count)."""
    lines = document.select(F.explode(F.split(text, "\n")).alias("l")).select(F.trim("l").alias("__line")).distinct()
    told = rows.select(key, F.trim(line).alias("__told"))
    return failed(told.join(lines, F.col("__told") == F.col("__line"), "left_anti"), "table", F.col(key), F.col("__told"))


def same_files(told: DataFrame, found: DataFrame) -> DataFrame:
    """Manifests path, bytes, sha256: a failure for each file that is gone, unlisted, or of another size or content."""
    side = lambda rows, n: rows.select("path", F.col("bytes").alias(f"{n}_bytes"), F.col("sha256").alias(f"{n}_sha256"))
    both = side(told, "told").join(side(found, "found"), "path", "full_outer")
    what = F.when(F.col("found_sha256").isNull(), "gone").when(F.col("told_sha256").isNull(), "unlisted").when(F.col("told_bytes") != F.col("found_bytes"), "size").when(F.col("told_sha256") != F.col("found_sha256"), "sha256")
    return failed(both.withColumn("what", what).where(F.col("what").isNotNull()), "manifest", F.col("path"), F.col("what"))


def provenance(inventory: DataFrame, produced: DataFrame, sources: DataFrame) -> DataFrame:
    """inventory: table, source (one row a pair); produced: table; sources: source. A failure for each table without an entry, entry without its table, and source that does not exist."""
    entries = inventory.select("table").distinct()
    untold = failed(produced.select("table").distinct().join(entries, "table", "left_anti"), "provenance", F.col("table"), F.lit("no entry"))
    unmade = failed(entries.join(produced.select("table").distinct(), "table", "left_anti"), "provenance", F.col("table"), F.lit("no table"))
    missing = inventory.join(sources.select("source").distinct(), "source", "left_anti")
    return untold.unionByName(unmade).unionByName(failed(missing, "provenance", F.col("table"), F.concat(F.lit("no source "), F.col("source"))))


def scanned_files(files: DataFrame, pattern: str, excluded: list[str]) -> DataFrame:
    """files path, line, value (numbered lines): a failure for each line that the pattern is found in, but for files whose name is excluded."""
    name = F.element_at(F.split("path", "/"), -1)
    return failed(files.where(F.col("value").rlike(pattern) & ~name.isin(*excluded)), "scan", F.concat_ws(":", name, "line"), F.lit(pattern))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def rolled_up(checks: DataFrame) -> DataFrame:
    """check, severity -> failures."""
    return checks.groupBy("check", "severity").agg(F.count("*").alias("n"))


def readiness(checks: DataFrame, required: dict[str, bool], evidence: int = 5) -> DataFrame:
    """name, status (pass or fail), required, evidence (the first keys that failed, in their order), blocking: a line for each named check, whether it has failures or not. Warnings fail no check."""
    failures = checks.where("severity = 'failure'").select(F.col("check").alias("name"), "key")
    first = failures.distinct().withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("key"))).where(F.col("k") <= evidence)
    bad = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("evidence"))
    listed = checks.sparkSession.createDataFrame(list(required.items()), "name string, required boolean")
    status = F.when(F.col("evidence").isNotNull(), "fail").otherwise("pass")
    return listed.join(bad, "name", "left").select("name", status.alias("status"), "required", F.coalesce("evidence", F.lit("")).alias("evidence"), (F.col("required") & (status == "fail")).alias("blocking"))


def exit_status(checks: DataFrame) -> int:
    """1 if any check failed, else 0: what a verifier's process returns."""
    return int(not checks.where("severity = 'failure'").isEmpty())
