"""Reading the tables of a data folder and cutting the lineage of a plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``, a file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named in ``spark.checkpoint.dir`` or set as the context's checkpoint folder.

    Where neither is set, a local session gets a temporary folder of its own; on a cluster that
    is an error, since executors could not read each other's local files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="skein-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove_at_exit(spark: SparkSession, where: str) -> None:
    """Has a folder removed when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a Parquet table in the shared folder; lost executors do not matter.

    The table is removed when the application ends. Compared with ``checkpoint()`` the plan runs once
    instead of twice and the files are columnar and compressed.
    """
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(where)
    remove_at_exit(spark, where)
    return spark.read.schema(df.schema).parquet(where)
