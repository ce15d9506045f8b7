"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a session in one process, as in tests, may leave it unset: it gets a folder that goes when the process ends. On
    a cluster each executor would write to a disk of its own, so there an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def remove_written(spark: SparkSession) -> None:
    """Remove every table that this application has written to the shared folder; DataFrames made from them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lodestar/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage beyond its files, so a lost executor costs the tasks it ran and no earlier stage.
    """
    spark = df.sparkSession
    path = f"{_run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_dealt(df: DataFrame, column: str, n: int) -> DataFrame:
    """``written``, for a table that is dealt to n partitions by a column: Spark reads it as dealt like that, without another exchange."""
    spark, name = df.sparkSession, f"lodestar_{uuid.uuid4().hex}"
    # bucketed files are known to the catalog alone; the table read from it outlives its name there
    df.write.bucketBy(n, column).saveAsTable(name, format="parquet", path=f"{_run_folder(spark)}/{name}")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out
