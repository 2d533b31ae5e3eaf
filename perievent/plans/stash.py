"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from perievent.sources.text import place


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what is lost with an executor is read again, not made again."""
    path = place(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
