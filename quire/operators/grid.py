"""Many query vectors against many rows: blocks of both meet in cells of a grid.

Vectors are packed into blocks, one row each, with a matrix of unit vectors.  A block of rows stands in one lane;
the blocks of queries go to every lane, and the join on the lane brings each pair of blocks together once.  While
the queries are few there is one lane and their blocks are broadcast, so that rows never move.  A task keeps, for
each query, the least score among the best it has passed on, and passes on what reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import SMALL_BYTES, bytes_of, new_dir

#: Bytes of a block's matrix.
BLOCK_BYTES = 4 << 20
#: Scores are compared to six places: what may round to the last one kept goes along.
ROUNDING = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def packed(vectors: DataFrame, id_col: str, name: str) -> DataFrame:
    """(``name``_part, ``name``_ids, ``name``_dim, ``name``_cells): blocks of the vectors (id, embedding), as they come.

    Vectors of another length than the one before begin a block of their own; those with a null component are zero there."""
    kind = vectors.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, cells = pa.concat_arrays([i for i, _ in held]), unit(np.concatenate([c for _, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([cells.shape[1]], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names)

        for batch in batches:
            lengths, ids = batch.column("embedding").value_lengths().to_numpy(), batch.column(id_col)
            flat = batch.column("embedding").flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            at = 0
            while at < len(lengths):
                dim = int(lengths[at])
                other = np.flatnonzero(lengths[at:] != dim)
                stop = min(at + int(other[0]) if len(other) else len(lengths), at + max(1, BLOCK_BYTES // (8 * dim)))
                if held and (held[-1][1].shape[1] != dim or size + (stop - at) * dim * 8 > BLOCK_BYTES):
                    yield block()
                    size = 0
                held.append((ids.slice(at, stop - at), flat[ends[at] : ends[stop]].reshape(-1, dim)))
                size += held[-1][1].nbytes
                at = stop
        if held:
            yield block()

    names = [f"{name}_part", f"{name}_ids", f"{name}_dim", f"{name}_cells"]
    rows = vectors.where("size(embedding) > 0").select(id_col, "embedding")
    return rows.mapInArrow(run, f"{names[0]} int, {names[1]} array<{kind.simpleString()}>, {names[2]} int, {names[3]} binary")


def met(queries: DataFrame, rows: DataFrame, lanes: int | None = None) -> DataFrame:
    """One row for each block of queries and block of rows of equal dimension.

    ``lanes`` is 1 where the queries' blocks, which are written once, are small, and else as many as Spark's shuffles have partitions."""
    spark = queries.sparkSession
    path = new_dir(spark, "queries")
    queries.withColumn("q_block", F.monotonically_increasing_id()).write.parquet(path)
    asked = spark.read.schema(queries.schema.add("q_block", "long")).parquet(path)
    few = bytes_of(spark, path) <= SMALL_BYTES
    lanes = lanes or (1 if few else int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    sent = F.broadcast(sent) if few and lanes == 1 else sent
    return rows.withColumn("lane", F.pmod(F.xxhash64("r_part", "r_ids"), F.lit(lanes)).cast("int")).join(sent, "lane").where("q_dim = r_dim")


def best(queries: DataFrame, rows: DataFrame, n: int, lanes: int | None = None) -> DataFrame:
    """(q_id, chunk_id, score): of ``rows`` (chunk_id, embedding) at least the ``n`` nearest to each of ``queries`` (q_id, embedding), by (1 + cosine) / 2."""
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("q_id", queries), ("chunk_id", rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.slice(i, 1)
                one = lambda c: cell.column(c)[0]  # noqa: B023, E731
                q_ids, r_ids = cell.column("q_ids").flatten(), cell.column("r_ids").flatten()
                q, r = (np.frombuffer(one(f"{c}_cells").as_py(), np.float64).reshape(len(ids), -1) for c, ids in (("q", q_ids), ("r", r_ids)))
                scores, key = (1 + r @ q.T) / 2, one("q_block").as_py()
                k = min(n, len(r))
                least = np.partition(scores, len(r) - k, axis=0)[len(r) - k]
                low = np.maximum(least, reached[key]) if key in reached else least
                if k == n:  # as many as are asked for have this score at least
                    reached[key] = low
                at, to = np.nonzero(scores >= low - ROUNDING)
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(to)), r_ids.take(pa.array(at)), pa.array(scores[at, to])], ["q_id", "chunk_id", "score"])

    cells = met(packed(queries, "q_id", "q"), packed(rows, "chunk_id", "r"), lanes)
    return cells.mapInArrow(run, f"{', '.join(kinds)}, score double")
