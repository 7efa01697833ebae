"""BM25 of a bounded number of questions over many chunks: each chunk is scored where it stands.

One pass over the texts leaves, for each chunk, a row of its length and its counts of the questions' terms; a second
one, over these rows, sums the parts of all questions a block of chunks at a time.  Pairs of questions and chunks
never become rows: a task keeps, for each question, the best scores that it has met, and passes on what reaches them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.scratch import stored

#: Cells of question and chunk, and parts to be summed, in a block; most (question, term) pairs that are sent to the tasks.
CELLS, PARTS, MOST_PAIRS = 1 << 18, 1 << 20, 200_000
#: Scores are compared to six places: what may round to the last one kept goes along.
ROUNDING = 1e-6


def counted(chunks: DataFrame, tokens: Column, words: pa.Array) -> DataFrame:
    """(chunk_id, len, terms, counts): for each chunk the number of its tokens, and of ``words`` the places of those it has with their counts."""
    shared = chunks.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column("t")
            sizes = lists.value_lengths().to_numpy()
            place = pc.fill_null(pc.index_in(lists.flatten(), value_set=shared.value), -1).to_numpy()
            some = np.flatnonzero(place >= 0)
            keys, counts = np.unique(np.repeat(np.arange(n, dtype=np.int64), sizes)[some] * len(shared.value) + place[some], return_counts=True)
            row, term = np.divmod(keys, len(shared.value))
            cut = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            found = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (term, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(sizes.astype(np.int64)), *found], ["chunk_id", "len", "terms", "counts"])

    rows = chunks.select("chunk_id", tokens.alias("t"))
    return rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, len long, terms array<int>, counts array<int>")


def blocks(batch: pa.RecordBatch, per_term: np.ndarray, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of at most ``rows`` rows whose parts come to about PARTS, and how many postings each row has."""
    sizes = batch.column("terms").value_lengths().to_numpy()
    parts = np.concatenate([[0], np.cumsum(per_term[batch.column("terms").flatten().to_numpy()])])[np.cumsum(sizes)]
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(parts, (parts[at - 1] if at else 0) + PARTS, side="right"))
        stop = min(max(at + 1, stop), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at), sizes[at:stop]
        at = stop


def best(chunks: DataFrame, tokens: Column, terms: DataFrame, n: int, k1: float, b: float) -> DataFrame | None:
    """(q_id, chunk_id, score): of ``chunks`` (chunk_id, text) of different ids at least the ``n`` best by BM25 for each question of ``terms`` (q_id, term).

    None without terms, and where there are more than MOST_PAIRS."""
    asked = terms.distinct().limit(MOST_PAIRS + 1).toArrow()
    if not 0 < asked.num_rows <= MOST_PAIRS:
        return None
    words, q_ids = asked["term"].combine_chunks().unique(), asked["q_id"].combine_chunks().unique()
    rows = stored(counted(chunks, tokens, words), "lists")
    n_all, mean = rows.agg(F.count("*"), F.avg("len")).first()
    # One row a term of the questions, of which there are at most MOST_PAIRS.
    known = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()
    df = np.zeros(len(words))
    df[known["term"].to_numpy()] = known["df"].to_numpy()
    idf = np.log(1 + ((n_all or 0) - df + 0.5) / (df + 0.5))
    place, owner = (pc.index_in(asked[c].combine_chunks(), value_set=v).to_numpy() for c, v in (("term", words), ("q_id", q_ids)))
    per_term = np.bincount(place, minlength=len(words))
    shared = terms.sparkSession.sparkContext.broadcast((q_ids, idf, per_term, np.cumsum(per_term) - per_term, owner[np.argsort(place, kind="stable")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, idf, per_term, first, owners = shared.value
        held = np.full((len(q_ids), n), -1.0)
        for batch in batches:
            for part, sizes in blocks(batch, per_term, max(1, CELLS // len(q_ids))):
                rows = len(sizes)
                term, tf, length = part.column("terms").flatten().to_numpy(), part.column("counts").flatten().to_numpy(), part.column("len").to_numpy()
                row, k = np.repeat(np.arange(rows), sizes), per_term[term]
                value = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / mean))
                to = owners[np.arange(int(k.sum())) + np.repeat(first[term] - (np.cumsum(k) - k), k)]
                # bincount() of nothing is of whole numbers.
                scores = np.bincount(to * rows + np.repeat(row, k), np.repeat(value, k), len(q_ids) * rows).astype(np.float64).reshape(len(q_ids), rows)
                held = np.partition(np.concatenate([held, scores], axis=1), rows, axis=1)[:, rows:]
                # A chunk that has a term of a question has a score above 0.
                q, at = np.nonzero((scores > 0) & (scores >= held.min(axis=1, keepdims=True) - ROUNDING))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), part.column("chunk_id").take(pa.array(at)), pa.array(scores[q, at])], ["q_id", "chunk_id", "score"])

    kinds = [f"{c} {x.schema[c].dataType.simpleString()}" for c, x in (("q_id", terms), ("chunk_id", chunks))]
    return rows.mapInArrow(run, f"{', '.join(kinds)}, score double")
