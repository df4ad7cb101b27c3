"""What the operators of this subpackage share: scratch tables in the cluster's shared folder, and file access from tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few longs that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. A session on one machine that names none gets a temporary folder; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    import tempfile

    base = "file://" + tempfile.mkdtemp(prefix="sievekit-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/sievekit-{uuid.uuid4().hex}"


def staged(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df written as Parquet to a scratch folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more: all that came of them has been written."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has no more than so many rows (it is read to find out), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def open_uri(uri: str):
    """An input file of any store that pyarrow knows, for use in a task."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + uri[5:].lstrip("/"))
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
