"""What the operators of this folder have in common: reading a table, and the folders of `sources/scratch.py`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.scratch import bytes_of, drop_dir, new_dir, stored, stored_small

__all__ = ["bytes_of", "drop_dir", "new_dir", "small_batches", "stored", "stored_small", "table"]

#: Bytes of a batch between Spark and Python; Spark's own bound is 64 MB, which a task and its worker hold several times over.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that workers are given, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
