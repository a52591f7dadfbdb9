"""Tables between jobs in the folder that driver and executors share: lineage ends there, and any executor can be lost later."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a ``local`` master without the setting gets a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_strataframe_tables", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.sparkContext._strataframe_tables = "file://" + tempfile.mkdtemp(prefix="strataframe-")
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back. What :func:`removed` hasn't deleted goes when the application ends."""
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/strataframe-{spark.sparkContext.applicationId}"
    fs, folder = _at(spark, top)
    if fs.mkdirs(folder):
        fs.deleteOnExit(folder)
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, folder = _at(df.sparkSession, path)
            fs.delete(folder, True)


def large(df: DataFrame, name: str) -> DataFrame:
    """A stored table whose size has no bound but the input's: joins sort and merge it and never collect it for a broadcast, small as its files may be."""
    return stored(df, name).hint("merge")
