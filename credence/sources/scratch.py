"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("credence.shared.dir", None)
        if not found:
            found = f"file://{tempfile.mkdtemp(prefix='credence-')}"
            spark.conf.set("credence.shared.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. All paths of an application are in one folder there, credence-<its id>, which the driver deletes
    when it ends; of an application that was killed it stays, and may be deleted by that name."""
    own = f"{shared(spark)}/credence-{spark.sparkContext.applicationId}"
    if spark.conf.get("credence.deleted.at.end", None) != own:
        at = spark._jvm.org.apache.hadoop.fs.Path(own)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(at)
        files.deleteOnExit(at)
        spark.conf.set("credence.deleted.at.end", own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written as Parquet in the shared folder and read again: for what is used several times, and isn't made anew."""
    at = folder(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
