"""Incremental runs: each batch is written under its own folder, so that a replayed one replaces itself, and
readers see the latest write of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.operators import chunks, graph
from quire.streaming import backlog


def batch_stream(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """``step`` of each batch, written as it comes; all there is now, then the query ends."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (step(batch) if step else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], order: list[F.Column] | None = None) -> DataFrame:
    """The latest row of each key over all batches: by batch, and within one by ``order``; the others are history."""
    rows = spark.read.parquet(path)
    return graph.latest(rows, key, [F.col("batch_id"), *(order or [])]).drop("batch_id")


def ingest_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """New documents (doc_id, sections) to their chunks; ids are deterministic, so a second run changes nothing."""
    return batch_stream(docs, path, checkpoint, lambda batch: chunks.chunk(chunks.sections(batch)))


def new_urls(found: DataFrame, path: str, checkpoint: str, known: Callable[[], DataFrame], ttl: str = "7 days") -> StreamingQuery:
    """Discovered (url, state) rows that the catalogue ``known()`` lacks, each url once and as pending.

    The stream keeps the urls of the last ``ttl`` as keyed state in its checkpoint, so that what is found again and
    again is dropped before it meets any table; older ones are held against what is committed, and the state does
    not grow with the catalogue.  `backlog.results` reads what came out."""
    rows = found.where("trim(url) <> ''").select("url", "state", F.current_timestamp().alias("seen_at"))
    rows = rows.withWatermark("seen_at", ttl).dropDuplicatesWithinWatermark(["url"])

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("url", "state").join(known().select("url"), "url", "left_anti")
        if not backlog.write_batch(fresh, path, backlog.batch_name(batch, batch_id), lambda x: x.withColumn("status", F.lit("pending")), "url"):
            batch.write.format("noop").mode("overwrite").save()  # a replayed batch still has to bring its state along

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path``, one file or a folder of them, as a stream of files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    # A pattern that only this file matches: the path of a file itself is taken for a folder.
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
