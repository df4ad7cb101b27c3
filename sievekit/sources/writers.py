"""Sinks. Writes go through Spark's commit protocol; none overwrites unless asked to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators.episodes import numbered, resumed, upserted


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where a session on one machine names none, as in tests. A cluster that names none is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sievekit-")
    return f"{base.rstrip('/')}/sievekit-{uuid.uuid4().hex}"


def write_jsonl(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_json(report: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each row one JSON document (nulls kept)."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """A header and the columns in this order; quotes inside a field are doubled, blanks at its ends and line ends kept. read_csv() gives the same text back; nulls come back as empty fields."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.select(*[F.col(f"`{c}`") for c in columns]).write.mode("overwrite" if overwrite else "errorifexists").options(**options).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys the table does not have yet; run again it appends nothing. Returns how many."""
    spark = rows.sparkSession
    there = exists(spark, path)
    new = resumed(rows, spark.read.parquet(path), keys) if there else rows
    new = new.dropDuplicates(keys).cache()
    n = new.count()
    if n or not there:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def checkpointed(rows: DataFrame, path: str, key: str, every: int) -> int:
    """Appends rows in buckets of `every` keys, in the order of a unique key: a row's bucket is its place in that order over `every`, and a folder of the table. All buckets that lack rows are written by one job, a task to a range of buckets, and a
    task's files are there once it is done: a run that breaks off leaves what its tasks finished, and the next one writes only rows whose key the table does not hold. Returns the number of buckets written to.

    The number of jobs does not depend on the number of buckets. Rows that come later stand behind the others: their keys must be larger than those written before, or buckets grow beyond `every`.
    """
    spark = rows.sparkSession
    placed = numbered(rows, [key]).withColumn("bucket", F.floor(F.col("number") / every)).drop("number")
    rest = resumed(placed, spark.read.parquet(path), [key]) if exists(spark, path) else placed
    n = rest.select("bucket").distinct().count()
    if n:
        rest.repartitionByRange("bucket").sortWithinPartitions("bucket", key).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("bucket").parquet(path)
    return n


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, bytes, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).distinct()


def upsert_manifest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return upserted(old, new, keys)


def write_index(path: str, **tables: DataFrame) -> None:
    for name, table in tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")


def tex_rows(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """One line of a TeX table a row; null cells are two dashes."""
    return rows.select(F.concat(F.concat_ws(" & ", *[F.coalesce(c.cast("string"), F.lit("--")) for c in columns]), F.lit(r" \\")).alias("value"))


#: Rows of a report table: it is one file.
REPORT_ROWS = 10_000


def write_tex(rows: DataFrame, path: str, head: list[str], columns: list[Column], order: list[str], overwrite: bool = False) -> None:
    """A report table as one file, its rows in the order given; more than REPORT_ROWS of them are an error."""
    spark = rows.sparkSession
    lines = [r["value"] for r in tex_rows(rows.orderBy(*order).limit(REPORT_ROWS + 1), columns).collect()]
    if len(lines) > REPORT_ROWS:
        raise ValueError(f"a report table has at most {REPORT_ROWS} rows")
    text = "\n".join([r"\begin{tabular}{" + "l" * len(head) + "}", r"\toprule", " & ".join(head) + r" \\", r"\midrule", *lines, r"\bottomrule", r"\end{tabular}"])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_result_files(rows: DataFrame, path: str) -> None:
    """rows folder, body (strings): body as <path>/<folder>/result.json, written by the tasks that hold the rows through pyarrow's file systems. A task that runs again writes the same files again."""

    def written(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
        n = 0
        for batch in batches:
            for folder, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store.create_dir(f"{root}/{folder}", recursive=True)
                with store.open_output_stream(f"{root}/{folder}/result.json") as out:
                    out.write(body.encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.where("folder IS NOT NULL AND body IS NOT NULL").select("folder", "body").mapInArrow(written, "n long").agg(F.sum("n")).collect()  # the action


def write_npy(rows: DataFrame, path: str, key: str, vector: str) -> None:
    """Vectors as .npy arrays (little-endian doubles, C order) beside their keys, an array for each batch of a task; written as rows name, key list, bytes of the array, through Spark's commit protocol."""

    def packed(batches):
        import io
        import uuid

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            if not batch.num_rows:
                continue
            array = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(batch.num_rows, -1)
            held = io.BytesIO()
            np.save(held, array, allow_pickle=False)
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.npy"]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.getvalue()], pa.binary())], names=["name", "ids", "content"])

    rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(packed, "name string, ids array<long>, content binary").write.mode("errorifexists").parquet(path)
