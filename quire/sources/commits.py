"""Tables whose writes count once they are committed.

A write goes to a folder of its own, ``<path>/<table>/write=<id>``.  One commit row names the writes that belong
together; it is the last thing written, as one file, and what no commit names is never read.  A run that dies
before its commit has written nothing that counts, one that dies after it has written all, and a name that is
committed already is not written again.  Commits are numbered in order; a path has one writer at a time, as
many readers as there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import drop_dir, exists

#: ``replaced`` names the parts of the table that the write holds anew; null for a write that adds rows.
COMMIT = "number long, name string, writes array<struct<table:string,write:string,replaced:array<int>>>"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(number, name, writes) of all commits; none where nothing is committed."""
    at = f"{path}/commits"
    return spark.read.schema(COMMIT).json(at) if exists(spark, at) else spark.createDataFrame([], COMMIT)


def is_committed(spark: SparkSession, path: str, name: str) -> bool:
    return not commits(spark, path).where(F.col("name") == name).isEmpty()


def write(rows: DataFrame, path: str, table: str, *parts: str) -> str:
    """Write ``rows``, by ``parts``, so that a commit can name them; gives the write's id."""
    at = f"w{uuid.uuid4().hex}"
    out = rows.write.partitionBy(*parts) if parts else rows.write
    out.option("compression", "zstd").parquet(f"{path}/{table}/write={at}")
    return at


def commit(spark: SparkSession, path: str, name: str, writes: list[tuple[str, str, list[int] | None]]) -> None:
    """Make (table, write, replaced) count, all at once: one row in one file."""
    number = 1 + (commits(spark, path).agg(F.max("number")).first()[0] or 0)
    row = spark.createDataFrame([(number, name, [{"table": t, "write": w, "replaced": r} for t, w, r in writes])], COMMIT)
    row.coalesce(1).write.mode("append").json(f"{path}/commits")


def writes_of(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(number, write, replaced) of the committed writes of a table."""
    return commits(spark, path).select("number", F.explode("writes").alias("w")).where(F.col("w.table") == table).select("number", "w.write", "w.replaced")


def committed(spark: SparkSession, path: str, table: str, schema: str | None = None) -> DataFrame | None:
    """The rows of the committed writes of a table, with ``number`` and ``write``; None where it has no folder yet.

    Writes that no commit names are left out before they are read: ``write`` is the folder's name."""
    if not exists(spark, f"{path}/{table}"):
        return None
    rows = (spark.read.schema(f"{schema}, write string") if schema else spark.read).parquet(f"{path}/{table}")
    return rows.join(F.broadcast(writes_of(spark, path, table).select("write", "number")), "write")


def vacuum(spark: SparkSession, path: str, table: str, keep: list[str]) -> list[str]:
    """Delete the writes of a table that are not among ``keep``; gives the ids of what went."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [x.getPath().getName().removeprefix("write=") for x in fs.listStatus(at)] if fs.exists(at) else []
    gone = sorted(set(there) - set(keep))
    for w in gone:
        drop_dir(spark, f"{path}/{table}/write={w}")
    return gone
