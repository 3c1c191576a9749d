"""Tables that outlive executors: written to the folder all of them share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where the session names none: a temporary one if all runs in one process, else one in the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and not (folder := context.getCheckpointDir()):
        if context.master.startswith("local"):
            folder = "file://" + tempfile.mkdtemp(prefix="rosterlink-")
        else:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_rosterlink"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compiled(spark: SparkSession) -> None:
    """For rows made by long expressions: the JVM never compiles a method of more than 8000 bytes, so Spark is to make several of it."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
