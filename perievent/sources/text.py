"""Delimited text: tables written to and read from the shared folder with a given schema."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, local sessions take a temporary
    folder; others must set it, as no folder of one machine will do."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(folder, "own", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        found = folder.own = tempfile.mkdtemp(prefix="shared-")
    return found.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what place gave a path."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # at the end, the JVM may be gone already
        pass


def place(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's process ends."""
    path = f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def round_trip(df: DataFrame, sep: str = ",") -> DataFrame:
    """df written as delimited text with a header and read back under its own schema (no inference)."""
    path = place(df.sparkSession, "text")
    df.write.csv(path, sep=sep, header=True)
    return df.sparkSession.read.csv(path, sep=sep, header=True, schema=df.schema)
