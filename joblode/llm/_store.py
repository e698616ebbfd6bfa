"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master without it (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-joblode-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for tables that are removed together."""
    return f"{shared_dir(spark).rstrip('/')}/joblode-{name}-{uuid.uuid4().hex}"


def _table_of(folder: str) -> str:
    return folder.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of scratch() and its table, wherever the file system that Spark reads it from lies."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_of(folder)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, under: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back, so later steps start from files.

    Unlike ``checkpoint()`` this computes the last stage once, and Parquet keeps only the columns a later
    step reads. Tables under a folder of scratch() go with it; others stay, since results still read them.
    """
    spark = df.sparkSession
    path = f"{(under or shared_dir(spark)).rstrip('/')}/joblode-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, folder: str, kind: str, key: str, buckets: int) -> DataFrame:
    """Write df to a folder of scratch(), one part for each kind, its rows in buckets by key, and read it back.

    Groups by the key then need no shuffle. A folder has one such table.
    """
    name = _table_of(folder)
    df.write.partitionBy(kind).bucketBy(buckets, key).option("path", f"{folder}/{name}").option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
