"""Tables written once in the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Parquet up to which a written table is broadcast.
SMALL_BYTES = 16 << 20
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset and Spark runs in this process alone, a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_dir(spark, path)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage and lets several steps read it."""
    path = new_dir(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_small(df: DataFrame, what: str, most: int = SMALL_BYTES) -> DataFrame:
    """stored(), marked for broadcast if what was written has at most so many bytes; else Spark joins it by its keys."""
    path = new_dir(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(back) if bytes_of(df.sparkSession, path) <= most else back
