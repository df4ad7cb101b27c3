"""Sources. Schemas are given, not inferred, wherever the caller knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEED_FAMILIES = ("independent_memory", "fixed_memory_query")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object a line; blank lines are skipped and a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1, blank lines counted), value of text files that may be split over any number of tasks: a line's number is its place in its split, and the lines of the splits before it in the file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("path", "block", "first", before.alias("before"))  # a row a split
    return lines.join(offsets, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int").alias("line"), "value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows with _source_file, _source_line and _error, which names file and line of a line that is no JSON object. Blank lines are skipped."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "").select(F.col("path").alias("_source_file"), F.col("line").alias("_source_line"), F.col("value").alias("__line"))
    named = schema.simpleString() if isinstance(schema, StructType) else schema
    parsed = lines.withColumn("row", F.from_json("__line", named, {"mode": "PERMISSIVE"})).withColumn("good", F.expr("try_parse_json(__line) IS NOT NULL") & F.ltrim("__line").startswith("{"))
    place = F.concat(F.col("_source_file"), F.lit(":"), F.col("_source_line"))
    return parsed.select("row.*", "_source_file", "_source_line", F.when(~F.col("good"), F.concat(place, F.lit(": not a JSON object"))).alias("_error"))


def read_json_tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document that is a list of tasks, or an object with a list under `tasks`."""
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<tasks:array<struct<{schema}>>>")["tasks"], F.from_json("value", f"array<struct<{schema}>>"))
    return text.select(F.explode(listed).alias("t")).select("t.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header, and every field a string; an empty field is ''. Doubled quotes, blanks at the ends of fields and line ends inside them are text."""
    options = {"header": True, "inferSchema": False, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "lineSep": "\n"}
    found = spark.read.options(**options).csv(path)
    return found.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in found.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """By the extension: .jsonl, .json, .csv or .parquet; others are an error."""
    kind = path.rsplit(".", 1)[-1].lower()
    readers = {"jsonl": lambda: read_jsonl(spark, path, schema), "json": lambda: read_json_tasks(spark, path, schema), "csv": lambda: read_csv(spark, path), "parquet": lambda: read_parquet(spark, path)}
    if kind not in readers:
        raise ValueError(f"no reader for {path}")
    return readers[kind]()


def trajectories(turns: DataFrame, most: int) -> DataFrame:
    """The first `most` trajectories by id: bounded like a stream that is read until enough is there, but by a key."""
    return turns.join(turns.select("traj").distinct().orderBy("traj").limit(most), "traj", "left_semi")


def result_files(spark: SparkSession, path: str, schema: str, skip: str = "_retry") -> DataFrame:
    """result.json files below a folder, with their path; folders whose name holds `skip` are left out."""
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(path)
    return found.withColumn("source", F.col("_metadata.file_path")).where(~F.contains("source", F.lit(skip)))


def seed_runs(spark: SparkSession, root: str, family: str = "auto") -> DataFrame:
    """runs partitioned by family and seed: of one family, or for each seed of the first family that has it."""
    runs = spark.read.parquet(root)
    if family != "auto":
        return runs.where(F.col("family") == family)
    order = F.array_position(F.array(*map(F.lit, SEED_FAMILIES)), F.col("family"))
    first = runs.select("family", "seed").distinct().withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy(order))).where("k = 1").drop("k")
    return runs.join(F.broadcast(first), ["family", "seed"])  # one row a seed


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("vectors", "postings", "stats", "ids")}


def tex_table(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows of a TeX table back to cells: split at '&', macros and row ends stripped."""
    rows = lines.where(F.contains(text, F.lit("&")) & F.contains(text, F.lit(r"\\")))
    cells = F.transform(F.split(F.regexp_replace(text, r"\\\\.*$", ""), r"(?<!\\)&"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\\(?:textbf|emph|texttt)\{([^}]*)\}", "$1"), r"\\([%&_#$])", "$1")))
    return rows.select(cells.alias("cells"))


def npy_vectors(files: DataFrame) -> DataFrame:
    """ids (array<long>), content (binary: a .npy array of two dimensions) -> id, vector (array<double>)."""

    def unpacked(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for ids, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(array.astype(float)), pa.list_(pa.float64()))], names=["id", "vector"])

    return files.select("ids", "content").mapInArrow(unpacked, "id long, vector array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """What write_npy() wrote. Plain .npy files are read by npy_vectors(spark.read.format("binaryFile")...) with their ids beside them."""
    return npy_vectors(spark.read.parquet(path))
