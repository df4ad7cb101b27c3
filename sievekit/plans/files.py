"""Sources and sinks: each query writes test rows in a format and returns what reading them back gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit import sources
from sievekit.functions import text
from sievekit.operators import sparse, validate
from sievekit.plans.fixtures import PAIRS, pairs, scratch, table
from sievekit.plans.registry import query

ROW = "doc_id long, lang string, source string, n_chars long"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


SAME = "SELECT doc_id, lang, source, n_chars FROM documents"


@query("src_jsonl", SAME)
def src_jsonl(spark, sf_dir):
    """snk_jsonl and back, blank lines between the rows."""
    path = scratch(spark)
    lines = rows(spark, sf_dir).select(F.explode(F.array(F.to_json(F.struct("*")), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return sources.read_jsonl(spark, path, ROW)


@query("snk_jsonl", SAME)
def snk_jsonl(spark, sf_dir):
    path = scratch(spark)
    sources.write_jsonl(rows(spark, sf_dir), path)
    return sources.read_jsonl(spark, path, ROW)


@query("src_jsonl_strict", "SELECT CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS doc_id, CAST(2 * (row_number() OVER (ORDER BY doc_id) - 1) + 1 AS INTEGER) AS line, doc_id % 7 = 3 AS bad FROM documents")
def src_jsonl_strict(spark, sf_dir):
    """Line numbers and errors of files, one a task, whose every other line is blank and whose every seventh row is cut; the files follow each other in the order of the ids, so a line's number in all of them is its number in its file and the lines before it."""
    path = scratch(spark)
    line = F.to_json(F.struct("doc_id", "lang"))
    cut = F.when(F.col("doc_id") % 7 == 3, F.left(line, F.length(line) - 3)).otherwise(line)
    rows(spark, sf_dir).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").select(F.concat(cut, F.lit("\n")).alias("value")).write.text(path)
    found = sources.read_jsonl_strict(spark, path, "doc_id long, lang string").select(F.when(F.col("_error").isNull(), F.col("doc_id")).alias("doc_id"), F.col("_source_line").alias("line"), F.col("_source_file").alias("file"), F.col("_error").isNotNull().alias("bad"))
    files = sources.numbered_lines(spark, path).groupBy(F.col("path").alias("file")).agg(F.max("line").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return found.join(files.select("file", before.alias("before")), "file").select("doc_id", (F.col("line") + F.col("before")).cast("int").alias("line"), "bad")


#: Events that one JSON document of the test holds.
A_FILE = 500
TASKS = "SELECT event_id AS task_id, event_type AS text FROM events"


@query("src_json", f"SELECT * FROM ({TASKS}) UNION ALL SELECT * FROM ({TASKS})")
def src_json(spark, sf_dir):
    """Documents that are a list, and documents with a list under tasks, a file for every 500 ids."""
    path = scratch(spark)
    task = F.struct(F.col("event_id").alias("task_id"), F.col("event_type").alias("text"))
    listed = table(spark, sf_dir, "events").groupBy(F.expr(f"event_id div {A_FILE}").alias("file")).agg(F.collect_list(task).alias("tasks"))
    listed.select("file", F.to_json("tasks").alias("value")).write.partitionBy("file").text(f"{path}/a")
    listed.select("file", F.to_json(F.struct("tasks")).alias("value")).write.partitionBy("file").text(f"{path}/b")
    read = lambda part: sources.read_json_tasks(spark, f"{path}/{part}", "task_id: long, text: string")
    return read("a").unionByName(read("b"))


@query("snk_json", f"WITH {PAIRS} SELECT CAST(seed AS VARCHAR) AS seed, CAST(count(*) AS VARCHAR) AS n FROM pairs GROUP BY seed")
def snk_json(spark, sf_dir):
    """Reports, one document a row."""
    path = scratch(spark)
    sources.write_json(pairs(spark, sf_dir).groupBy("seed").agg(F.count("*").alias("n")).repartition(1), path)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)\{[^}]*\}"), F.lit(0))).alias("x"))
    return whole.select(F.get_json_object("x", "$.seed").alias("seed"), F.get_json_object("x", "$.n").alias("n"))


@query("src_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest FROM documents")
def src_csv(spark, sf_dir):
    """snk_csv and back: texts with line ends and quotes, all fields strings."""
    path = scratch(spark)
    sources.write_csv(table(spark, sf_dir, "documents"), path, ["doc_id", "text"])
    return sources.read_csv(spark, path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("snk_csv", "SELECT coalesce(source, '') AS source, doc_id, md5(coalesce(text, '')) AS digest, CAST(length(coalesce(text, '')) AS BIGINT) AS size FROM documents")
def snk_csv(spark, sf_dir):
    """Fields in a fixed order below a header, whole texts among them."""
    path = scratch(spark)
    sources.write_csv(table(spark, sf_dir, "documents"), path, ["source", "text", "doc_id"])
    return sources.read_csv(spark, path).select("source", F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("size"))


@query("src_parquet", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def src_parquet(spark, sf_dir):
    return sources.read_parquet(spark, f"{sf_dir}/embeddings.parquet").select("vec_id", F.size("embedding").alias("size"))


@query("src_dispatch", "SELECT kind, CAST(count(*) AS BIGINT) AS n FROM documents, (VALUES ('csv'), ('jsonl'), ('parquet')) k(kind) GROUP BY kind")
def src_dispatch(spark, sf_dir):
    """The reader is chosen by the extension."""
    path, d = scratch(spark), rows(spark, sf_dir)
    sources.write_jsonl(d, f"{path}/x.jsonl")
    sources.write_csv(d, f"{path}/x.csv", d.columns)
    d.write.parquet(f"{path}/x.parquet")
    out = None
    for kind in ("csv", "jsonl", "parquet"):
        one = sources.read_any(spark, f"{path}/x.{kind}", ROW).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("src_glob", f"SELECT event_id, value FROM events WHERE event_id // {A_FILE} % 3 <> 0")
def src_glob(spark, sf_dir):
    """result.json files of a folder tree, a job for every 500 events; folders of retries, every third one, are left out."""
    path, job = scratch(spark), F.expr(f"event_id div {A_FILE}")
    jobs = table(spark, sf_dir, "events").groupBy(job.alias("job")).agg(F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("body"))
    folder = F.concat(F.lit("job_"), F.col("job"), F.when(F.col("job") % 3 == 0, "_retry").otherwise(""))
    sources.write_result_files(jobs.select(folder.alias("folder"), "body"), path)
    return sources.result_files(spark, path, "event_id long, value double").select("event_id", "value")


@query("src_partition", f"WITH {PAIRS} SELECT seed, CASE WHEN seed % 3 = 0 THEN 'fixed_memory_query' ELSE 'independent_memory' END AS family, count(*) AS n FROM pairs GROUP BY 1, 2")
def src_partition(spark, sf_dir):
    """Partitions by family and seed, where a seed that the first family lacks is taken from the next one."""
    path = scratch(spark)
    p = pairs(spark, sf_dir).select("seed", "query_id")
    p.where("seed % 3 <> 0").withColumn("family", F.lit("independent_memory")).unionByName(p.withColumn("family", F.lit("fixed_memory_query"))).write.partitionBy("family", "seed").parquet(path)
    return sources.seed_runs(spark, path).groupBy(F.col("seed").cast("long").alias("seed"), "family").agg(F.count("*").alias("n"))


@query("src_index", "SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS ids, (SELECT count(*) FROM documents) AS n_docs, count(*) AS terms FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS t FROM documents)")
def src_index(spark, sf_dir):
    """An index written as tables, and loaded again."""
    path, d = scratch(spark), table(spark, sf_dir, "documents").select("doc_id", "text")
    sources.write_index(path, vectors=table(spark, sf_dir, "embeddings"), postings=sparse.postings(d), stats=sparse.corpus_stats(d), ids=d.select("doc_id"))
    index = sources.read_index(spark, path)
    count = lambda name: index[name].agg(F.count("*").alias(name))
    terms = index["postings"].agg(F.count_distinct("term").alias("terms"))
    return count("vectors").crossJoin(count("ids")).crossJoin(index["stats"].select("n_docs")).crossJoin(terms)  # a row each


@query("src_npy", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(i)")
def src_npy(spark, sf_dir):
    """Vectors written as .npy files, a file a partition, and read back."""
    path = scratch(spark)
    sources.write_npy(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding")
    return sources.read_npy(spark, path).select(F.col("id").alias("vec_id"), F.posexplode("vector").alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


BRANDS = "SELECT p_brand || ' & ' || p_type AS brand, count(*) AS n, (SELECT count(*) FROM part) AS every FROM part GROUP BY 1"


def brands(spark, sf_dir):
    """A report over all parts: brand (a text with characters to be escaped), n, every (the number of parts)."""
    p = table(spark, sf_dir, "part")
    counts = p.groupBy(F.concat("p_brand", F.lit(" & "), "p_type").alias("brand")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(p.agg(F.count("*").alias("every"))))  # one row


@query("src_tex", f"SELECT brand, CAST(n AS VARCHAR) AS n, printf('%.1f', 100 * (n / every::DOUBLE)) AS share FROM ({BRANDS})")
def src_tex(spark, sf_dir):
    """snk_latex and back to cells: escaped names, and a share as the table shows it."""
    path = scratch(spark)
    sources.write_tex(brands(spark, sf_dir), path, ["brand", "n", "share"], [text.tex_escape(F.col("brand")), F.col("n"), text.percent(F.col("n") / F.col("every"))], ["brand"])
    cells = sources.tex_table(spark.read.text(path)).select("cells").where(F.get("cells", F.lit(0)) != "brand")
    return cells.select(*[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(("brand", "n", "share"))])


@query("snk_latex", f"SELECT '\\begin{{tabular}}{{ll}}' AS first, count(*) + 6 AS lines FROM ({BRANDS})")
def snk_latex(spark, sf_dir):
    path = scratch(spark)
    sources.write_tex(brands(spark, sf_dir), path, ["brand", "n"], [text.tex_escape(F.col("brand")), F.col("n")], ["brand"])
    return sources.numbered_lines(spark, path).agg(F.min_by("value", "line").alias("first"), F.max("line").cast("long").alias("lines"))


@query("snk_append", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def snk_append(spark, sf_dir):
    """A resumed run appends what the first one did not write; a third one nothing."""
    path, d = scratch(spark), rows(spark, sf_dir).select("doc_id")
    sources.append_new(d.where("doc_id % 2 = 0").withColumn("run", F.lit("first")), path, ["doc_id"])
    sources.append_new(d.withColumn("run", F.lit("second")), path, ["doc_id"])
    sources.append_new(d.withColumn("run", F.lit("third")), path, ["doc_id"])
    return spark.read.parquet(path)


@query("snk_checkpoint", "SELECT vec_id, CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / 200) AS BIGINT) AS part FROM embeddings")
def snk_checkpoint(spark, sf_dir):
    """A folder of the table for every 200 rows in the order of the ids, all written by one job; a run that is resumed writes the rest."""
    path, e = scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id")
    sources.checkpointed(e.where("vec_id < 100"), path, "vec_id", 200)
    sources.checkpointed(e, path, "vec_id", 200)
    return spark.read.parquet(path).select("vec_id", F.col("bucket").cast("long").alias("part"))


@query("snk_no_overwrite", "SELECT name, 'refused' AS second, CAST(count(*) AS BIGINT) AS n FROM documents, (VALUES ('csv'), ('json'), ('jsonl'), ('tex')) t(name) GROUP BY name")
def snk_no_overwrite(spark, sf_dir):
    """A second write to the same place is refused, and the first one's rows stay."""
    from pyspark.errors import AnalysisException

    path, d, told = scratch(spark), rows(spark, sf_dir), []
    first = d.limit(3)
    writers = {"csv": lambda x, p: sources.write_csv(x, p, x.columns), "json": sources.write_json, "jsonl": sources.write_jsonl, "tex": lambda x, p: sources.write_tex(x.limit(5), p, ["id"], [F.col("doc_id")], ["doc_id"])}
    n = d.count()
    for name, write in writers.items():
        write(d, f"{path}/{name}")
        before = spark.read.text(f"{path}/{name}").count()
        try:
            write(first, f"{path}/{name}")
            told.append((name, "overwritten", n))
        except AnalysisException:
            told.append((name, "refused", n if spark.read.text(f"{path}/{name}").count() == before else -1))
    return spark.createDataFrame(told, "name string, second string, n long")


def listed_files(spark, sf_dir) -> str:
    """A folder of one text file for each source: its ids, sorted."""
    path = scratch(spark)
    rows(spark, sf_dir).repartition("source").sortWithinPartitions("source", "doc_id").select(F.col("doc_id").cast("string").alias("value"), "source").write.partitionBy("source").text(path)
    return path


FILES = "f AS (SELECT source, string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY source)"


def named(files: DataFrame) -> DataFrame:
    return files.withColumn("path", F.regexp_extract("path", "source=([^/]*)", 1))


@query("snk_manifest", f"WITH {FILES} SELECT source AS path, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM f")
def snk_manifest(spark, sf_dir):
    return named(sources.manifest(spark, listed_files(spark, sf_dir), "*.txt"))


@query("v_manifest", f"WITH {FILES} SELECT 'manifest' AS \"check\", 'failure' AS severity, source AS key, CASE source WHEN 'src1' THEN 'sha256' WHEN 'src2' THEN 'size' ELSE 'unlisted' END AS detail FROM f WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT 'manifest', 'failure', 'other', 'gone'")
def v_manifest(spark, sf_dir):
    """A manifest with a wrong sum, a wrong size, a file left out and one that is gone."""
    found = named(sources.manifest(spark, listed_files(spark, sf_dir), "*.txt"))
    told = found.where("path <> 'src3'").select(F.when(F.col("path") == "src0", "src0").otherwise(F.col("path")).alias("path"), (F.col("bytes") + (F.col("path") == "src2").cast("long")).alias("bytes"), F.when(F.col("path") == "src1", "0").otherwise(F.col("sha256")).alias("sha256"))
    gone = spark.createDataFrame([("other", 1, "1")], "path string, bytes long, sha256 string")
    return validate.same_files(told.unionByName(gone), found)


@query("v_scan", "SELECT 'scan' AS \"check\", 'failure' AS severity, 'a' || doc_id // 250 || '.txt:' || CAST(row_number() OVER (PARTITION BY doc_id // 250 ORDER BY doc_id) AS VARCHAR) AS key, '[Ll]icense' AS detail FROM documents QUALIFY regexp_matches(replace(text, chr(10), ' '), '[Ll]icense')")
def v_scan(spark, sf_dir):
    """Lines of files, one for every 250 documents, that a pattern is found in; the same lines in an excluded file do not count."""
    path = scratch(spark)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('a', doc_id div 250, '.txt')").alias("file"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "doc_id").select("value", "file").write.partitionBy("file").text(path)
    lines.select("value", F.lit("skipped.txt").alias("file")).write.mode("append").partitionBy("file").text(path)
    files = sources.numbered_lines(spark, path).withColumn("path", F.regexp_extract("path", "file=([^/]*)", 1))
    return validate.scanned_files(files, "[Ll]icense", ["skipped.txt"])
