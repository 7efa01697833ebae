"""Backlogs (embedding, extraction) as batches that count once, whatever fails.

A batch is filtered by what is done, given to a step, and written as two tables of one commit: the results, and
the rows that failed, with all their columns.  What is done is read from committed results and nothing else, so
that a batch which dies before its commit is done anew and one which dies after it is left alone.  Rows that
failed come again with the next run, before new rows, until they have a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.known import unknown
from quire.sources import commits

Step = Callable[[DataFrame], DataFrame]
RESULTS, FAILED = "results", "failed"


def _nothing() -> None:
    """Nothing happens between the writes and their commit."""


def results(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed results, each row once; None before the first batch."""
    rows = commits.committed(spark, path, RESULTS)
    return None if rows is None else rows.drop("number", "write")


def done(spark: SparkSession, path: str, key: str, like: DataFrame) -> DataFrame:
    """(key): what has a committed result; of the type that it has in ``like``."""
    rows = results(spark, path)
    return like.select(key).limit(0) if rows is None else rows.select(F.col(key).cast(like.schema[key].dataType))


def failed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows that failed and have no result since, each once as it came last; None before the first batch."""
    rows = commits.committed(spark, path, FAILED)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in (key, "write", "number")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest, F.lit(0).alias("_")), "number").alias("r"))
    last = last.select(key, *(F.col("r")[c].alias(c) for c in rest))
    return last.join(done(spark, path, key, last), key, "left_anti")


def write_batch(rows: DataFrame, path: str, name: str, step: Step, key: str = "chunk_id", before_commit: Callable[[], None] = _nothing) -> bool:
    """Run ``step`` over the rows that are not done yet and commit what it gives; False if ``name`` is committed already.

    ``step`` gives one row for each key that it managed; the others stay pending.  Rows without a key are left
    out, of rows that repeat one any is taken, and what a step gives twice counts once."""
    spark = rows.sparkSession
    if commits.is_committed(spark, path, name):
        return False
    # Several writes read the rows: a stateful stream, or a dear one, runs once.
    once = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).persist()
    try:
        fresh = unknown(once, done(spark, path, key, rows), key)
        got = commits.write(step(fresh).where(F.col(key).isNotNull()).dropDuplicates([key]), path, RESULTS)
        # The step has run once: what it gave is read back, never made again.
        given = spark.read.parquet(f"{path}/{RESULTS}/write={got}").select(key)
        lost = commits.write(fresh.join(given, key, "left_anti"), path, FAILED)
    finally:
        once.unpersist()
    before_commit()
    commits.commit(spark, path, name, [(RESULTS, got, None), (FAILED, lost, None)])
    return True


def retry(spark: SparkSession, path: str, step: Step, key: str = "chunk_id") -> bool:
    """Give ``step`` the rows that failed in earlier batches; False if there are none."""
    rows = failed(spark, path, key)
    if rows is None or rows.isEmpty():
        return False
    return write_batch(rows, path, f"retry-{uuid.uuid4().hex}", step, key)


def batch_name(batch: DataFrame, batch_id: int) -> str:
    """A batch's name: a stream with another checkpoint, which counts from 0 again, has other ones."""
    return f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{batch_id}"


def backlog_stream(pending: DataFrame, path: str, checkpoint: str, step: Step, key: str = "chunk_id", before_commit: Callable[[], None] = _nothing) -> StreamingQuery:
    """First what failed before, then the stream's new rows, all there is now; then the query ends."""
    retry(pending.sparkSession, path, step, key)

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_name(batch, batch_id), step, key, before_commit)

    return pending.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clean(spark: SparkSession, path: str) -> int:
    """Delete what attempts without a commit have left; gives their number.  Not while a batch runs."""
    named = commits.commits(spark, path).select(F.explode("writes").alias("w")).select("w.table", "w.write").collect()
    return sum(len(commits.vacuum(spark, path, t, [r["write"] for r in named if r["table"] == t])) for t in (RESULTS, FAILED))
