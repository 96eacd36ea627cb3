"""Reading and keeping tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.session import scratch_path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later readers prune its columns and share the work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
