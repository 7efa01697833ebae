"""Keyed tables in hash buckets: an upsert reads and writes the buckets of its keys alone.

A write holds some buckets anew, each whole; the last committed write of a bucket counts.  Since a commit is all
or nothing, an upsert can be run again whatever became of it, and readers never see a part of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import graph
from quire.sources import commits
from quire.sources.scratch import stored

BUCKETS = 64
Write = tuple[str, str, list[int]]


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def layout(spark: SparkSession, path: str, table: str, buckets: int = BUCKETS) -> int:
    """The number of buckets that a table was begun with; a new table is begun with ``buckets``."""
    known = commits.commits(spark, path).where(F.col("name") == f"layout-{table}").select(F.col("writes")[0]["write"]).first()
    if known:
        return int(known[0])
    commits.commit(spark, path, f"layout-{table}", [(table, str(buckets), [])])
    return buckets


def current(spark: SparkSession, path: str, table: str, among: list[int] | None = None) -> DataFrame | None:
    """The rows of a table as they are now, or of some of its buckets; None where there are none.

    Of each bucket only the folder that counts is listed and read."""
    last = commits.writes_of(spark, path, table).select("number", "write", F.explode("replaced").alias("bucket")).groupBy("bucket").agg(F.max_by("write", "number").alias("write"))
    last = last.where(F.col("bucket").isin(among)) if among is not None else last
    # As many rows as the table has buckets.
    folders = [f"{path}/{table}/write={r['write']}/bucket={r['bucket']}" for r in last.collect()]
    return spark.read.option("basePath", f"{path}/{table}").parquet(*folders).drop("write", "bucket") if folders else None


def replaced(rows: DataFrame, path: str, table: str, touched: list[int], key: list[str], buckets: int) -> Write:
    """Write the buckets ``touched`` anew with ``rows``, all that is to be in them; to be committed.

    Spark puts small buckets into one task and cuts large ones into several, each of a file."""
    return table, commits.write(rows.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket"), path, table, "bucket"), touched


def touched_by(rows: DataFrame, key: list[str], buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def staged(new: DataFrame, path: str, table: str, key: list[str], order: list[Column], buckets: int = BUCKETS) -> Write | None:
    """``new`` upserted into the buckets of its keys, the last row of a key by ``order``; to be committed.  None without rows."""
    spark = new.sparkSession
    buckets = layout(spark, path, table, buckets)
    last = stored(graph.latest(new, key, order), "upsert")
    touched = touched_by(last, key, buckets)
    if not touched:
        return None
    old = current(spark, path, table, touched)
    rows = last if old is None else old.join(last.select(*key), key, "left_anti").select(*last.columns).unionByName(last)
    return replaced(rows, path, table, touched, key, buckets)


def upsert(new: DataFrame, path: str, table: str, key: list[str], order: list[Column], name: str | None = None, buckets: int = BUCKETS) -> bool:
    """staged() and committed under ``name``; False if that is committed already."""
    spark = new.sparkSession
    if name and commits.is_committed(spark, path, name):
        return False
    write = staged(new, path, table, key, order, buckets)
    commits.commit(spark, path, name or uuid.uuid4().hex, [write] if write else [])
    return True
