"""Hard negatives by BOND: branch and bound over vectors that are stored dimension by dimension.

Rows are packed into blocks, sorted by label, whose matrix holds one dimension after another with its least
and largest value.  Anchors are packed likewise, in smaller blocks.  A block of anchors meets a block of rows
in a cell, once for each pair of blocks: rows stay where they are, and the anchors' blocks are broadcast, in
parts of about 16 MB that take turns.  In a cell each anchor reads the dimensions in descending order of its own magnitude.
After every few of them, what the unread ones can still add at least and at most bounds each row's score, and
rows that can no longer be among the best of a window leave the candidates.  What is left at the end has exact
scores.  The best rows of each cell are merged by Spark.

First the windows are unbounded and the rows those of the anchor's label, which gives the positives; then each
positive's score makes a window of scores for rows of other labels.

A component x becomes floor(256 * x), and scores are whole numbers.

Edge cases: rows without an id, a label or a vector, or with a component that is null or not finite, take no
part; vectors of different lengths never meet; rows of an anchor's own id are no others to it; rows that repeat
an id are rows of their own, as anchors too; ties go to the smaller id; scores beyond 64 bits stand for the
nearest that fits; a positive of negative score has an empty window; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import new_dir, stored, table

BEST, NEGATIVES = 5, 5
#: A negative's score x lies close below the positive's score p: LEAST * p <= MOST * x <= MOST * p.
LEAST, MOST = 80, 100
#: Rows and anchors of a block, and dimensions between two looks at the bounds.
ROWS, ANCHORS, STEP = 8_192, 1_024, 8
#: Bytes of anchors, unpacked and with their windows, that are broadcast at a time.
SENT = 16 << 20
#: Bounds of scores held in 64 bits with room for sums.
FAR, LONGEST = 1 << 62, (1 << 63) - 1
PACKED = "lane int, dim int, low long, high long, n int, ids binary, labels binary, cells binary"


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, with whole numbers for components."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    found = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    return found.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` of the rows (id, label, v): ids and labels in order of label, and a matrix of dimensions by rows.

    Rows are dealt by range of label and id, so that a frequent label spreads over many blocks."""
    parts = -(-rows.count() // size) or 1
    dealt = rows.withColumn("dim", F.size("v")).repartitionByRange(parts, "dim", "label", "id", F.xxhash64("v")).sortWithinPartitions("dim", "label", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, held, count = TaskContext.get().partitionId(), [], 0

        def block(piece: pa.Table) -> pa.RecordBatch:
            ids, labels = piece.column("id").to_numpy(), piece.column("label").to_numpy()
            dim = piece.column("dim")[0].as_py()
            cells = pa.concat_arrays([c.flatten() for c in piece.column("v").chunks]).to_numpy(zero_copy_only=False).reshape(len(ids), dim).T
            return pa.RecordBatch.from_pylist([{"lane": lane, "dim": dim, "low": int(labels[0]), "high": int(labels[-1]), "n": len(ids), "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "cells": np.ascontiguousarray(cells, np.int64).tobytes()}], schema)

        def cut(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            rest = pa.Table.from_batches(held)
            while rest.num_rows and (all_of_it or rest.num_rows >= size):
                dims = rest.column("dim").to_numpy()[:size]
                stop = int(np.searchsorted(dims, dims[0], side="right"))
                yield block(rest.slice(0, stop).combine_chunks())
                rest = rest.slice(stop)
            held, count = rest.to_batches(), rest.num_rows

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= size:
                yield from cut(False)
        if count:
            yield from cut(True)

    schema = pa.schema([("lane", pa.int32()), ("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("cells", pa.binary())])
    return dealt.mapInArrow(run, PACKED)


def bond(q: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which columns of ``cells`` (dimensions by rows) may be among the ``k`` best of a window, and their exact scores with ``q``.

    ``low`` and ``high`` bound each dimension; a window holds the scores from its first to its second number."""
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.stack([q * low, q * high])[:, order]
    # What the dimensions from each place on add at least and at most.
    rest = [np.concatenate([np.cumsum(x[::-1])[::-1], np.zeros(1, x.dtype)]) for x in (ends.min(axis=0), ends.max(axis=0))]
    alive, scores = np.arange(cells.shape[1]), np.zeros(cells.shape[1], cells.dtype)
    for at in range(0, len(q), STEP):
        dims = order[at : at + STEP]
        scores = scores + q[dims] @ (cells[dims] if len(alive) == cells.shape[1] else cells[np.ix_(dims, alive)])
        done = min(at + STEP, len(q))
        least, most = scores + rest[0][done], scores + rest[1][done]
        keep = np.zeros(len(alive), bool)
        for first, last in windows:
            sure = least[most <= last]
            bound = first if len(sure) < k else max(first, np.partition(sure, len(sure) - k)[len(sure) - k])
            keep |= (most >= bound) & (least <= last)
        if not keep.all():
            alive, scores = alive[keep], scores[keep]
        if not len(alive):
            break
    return alive, scores


def _cells(spec: str, same: bool, k: int):
    """The work of a cell: for each anchor, and for each of its windows, the ``k`` best rows of its own label or of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in spec.split(", ")]
        for batch in batches:
            for cell in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids, labels, anchors, own = (np.frombuffer(cell[c], np.int64) for c in ("ids", "labels", "a_ids", "a_labels"))
                rows = np.frombuffer(cell["cells"], np.int64).reshape(cell["dim"], -1) if cell["dim"] else np.zeros((0, len(ids)), np.int64)
                asked = np.frombuffer(cell["a_cells"], np.int64).reshape(cell["dim"], -1) if cell["dim"] else np.zeros((0, len(anchors)), np.int64)
                # Sums of products that 64 bits can't hold are left to Python's numbers.
                most = [max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0 for x in (rows, asked)]
                kind = np.int64 if most[0] * most[1] * cell["dim"] < FAR else object
                rows, asked = rows.astype(kind), asked.astype(kind)
                low, high = (rows.min(axis=1), rows.max(axis=1)) if rows.size else (np.zeros(len(rows), kind),) * 2
                wide = {p: [] for p in range(len(anchors))} if not same else {p: [(-FAR if kind is np.int64 else -(1 << 200), FAR if kind is np.int64 else 1 << 200)] for p in range(len(anchors))}
                for w in () if same else cell["windows"]:
                    p = w["score"]
                    if -(-LEAST * p // MOST) <= p:
                        wide[w["pos"]].append((-(-LEAST * p // MOST), p if p < LONGEST else 1 << 200))
                out: list[list[np.ndarray]] = [[] for _ in names]
                for pos in range(len(anchors)):
                    if not wide[pos]:
                        continue
                    a, b = np.searchsorted(labels, own[pos], side="left"), np.searchsorted(labels, own[pos], side="right")
                    for part in [slice(a, b)] if same else [slice(0, a), slice(b, len(labels))]:
                        there = ids[part]
                        if not len(there):
                            continue
                        one = rows[:, part]
                        # Rows of the anchor's id leave room for themselves, then go.
                        extra = int((there == anchors[pos]).sum()) if same else 0
                        found, scores = bond(asked[:, pos], one, low, high, wide[pos], k + extra)
                        other = there[found] != anchors[pos]
                        found, scores = found[other], scores[other]
                        for first, last in wide[pos]:
                            within = np.flatnonzero((scores >= first) & (scores <= last))
                            within = within[np.lexsort((there[found[within]], -scores[within]))][:k]
                            if len(within):
                                held = np.clip(scores[within], -LONGEST - 1, LONGEST).astype(np.int64)
                                values = (np.full(len(within), cell["a_lane"] * (1 << 32) + cell["a_block"] * ANCHORS + pos), np.full(len(within), anchors[pos]), there[found[within]], held, np.full(len(within), 0 if same else min(last, LONGEST)))
                                for column, x in zip(out, values, strict=False):
                                    column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names)

    return run


def _met(anchors: DataFrame, rows: DataFrame, same: bool) -> DataFrame:
    """Each block of anchors with each block of rows: the anchors are broadcast, once for all blocks, and rows stay where they are."""
    # Blocks of one label alone meet either for positives or for negatives.
    fits = "a_low <= high AND low <= a_high" if same else "NOT (a_low = a_high AND low = high AND a_low = low)"
    return rows.withColumnRenamed("dim", "own_dim").join(F.broadcast(anchors), F.expr(f"own_dim = dim AND {fits}"))


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_turn(parts: list[DataFrame], what: str) -> DataFrame:
    """The parts written one after another, so that the broadcasts of one are gone before the next, and read back as one table."""
    path = new_dir(parts[0].sparkSession, what)
    for part in parts:
        part.write.mode("append").parquet(path)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = BEST, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for (id, label, v) of ``anchors`` against all ``rows``."""
    blocks = stored(packed(rows, ROWS), "vectors")
    asked = packed(anchors, ANCHORS).withColumnsRenamed({c: f"a_{c}" for c in ("lane", "low", "high", "n", "ids", "labels", "cells")})
    numbered = F.row_number().over(Window.partitionBy("a_lane").orderBy("dim", "a_low", "a_high", F.xxhash64("a_ids"))) - 1
    asked = stored(asked.withColumn("a_block", numbered.cast("long")).withColumn("a_lane", F.col("a_lane").cast("long")), "anchors")
    # Files don't tell: blocks pack well.  An id, a label and a window's place and score are held with each anchor.
    size = asked.agg(F.sum(F.octet_length("a_cells") + F.col("a_n") * (16 + 32 * positives))).first()[0] or 0
    parts = -(-size // SENT) or 1

    def turns(df: DataFrame) -> list[DataFrame]:
        return [df.where(F.pmod(F.xxhash64("a_lane", "a_block"), F.lit(parts)) == part) for part in range(parts)]

    def best_of(met: DataFrame, spec: str, same: bool, k: int, *keys: str) -> DataFrame:
        return _first(met.mapInArrow(_cells(spec, same, k), spec), k, *keys)

    near = "anchor long, anchor_id long, id long, score long"
    best = _in_turn([best_of(_met(part, blocks, True), near, True, positives, "anchor") for part in turns(asked)], "positives")
    windows = best.select(F.shiftright("anchor", 32).alias("a_lane"), F.floor(F.col("anchor").bitwiseAND((1 << 32) - 1) / ANCHORS).alias("a_block"), F.struct((F.col("anchor") % ANCHORS).cast("int").alias("pos"), "score").alias("w"))
    windows = windows.groupBy("a_lane", "a_block").agg(F.collect_set("w").alias("windows"))
    far = f"{near}, of long"
    # Neither side of the joins by key is small because its file is.
    asked = asked.join(windows.hint("merge"), ["a_lane", "a_block"])
    found = _in_turn([best_of(_met(part, blocks, False), far, False, negatives, "anchor", "of") for part in turns(asked)], "negatives")
    found = found.select("anchor", F.col("of").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    own = best.select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return own.join(found.hint("merge"), ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, rows.where("id % 100 = 0"))


ORACLE = f"""
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label = r.label AS same, r.id, coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id AND len(a.v) = len(r.v)),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {BEST}),
found AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= {MOST} * score AND {MOST} * score <= {MOST} * positive_score)
SELECT * FROM found WHERE rank <= {NEGATIVES}
"""
