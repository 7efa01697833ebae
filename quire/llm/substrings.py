"""Substring deduplication by difference-cover anchors.

Positions of a document whose index modulo 13 lies in {0, 1, 3, 9} are cover positions.  For any two
positions some shift below 13 brings both onto cover positions, so two equal runs of 20 words hold an
equal run of 8 words (an anchor) that starts at a cover position of both.

1. Hashes of all anchors are counted; those that occur once are done with.
2. What repeats becomes a filter of fixed size that every task has.  If the repeated anchors are too many
   for it, they are joined back to the documents instead.
3. Anchors that repeat are extended: every run of 20 words around one is hashed (96 bits), and the runs
   of equal hash are ranked by (document, start).  All but the first have started earlier.  A document is
   an id, and where an id has several texts a hash of the text as well.
4. The starts found are joined to the documents, and the words they cover are left out.

A task passes on only its first occurrence of each run and knows of the others that they are repeats, so
a run that a third of all documents share costs one row a task.

Edge cases: a null or empty text has no words; texts of fewer words than a window keep all; rows of equal
id and text are taken for one document, so that equal rows are judged alike, and different texts of one id
for several, in order of their hash; documents without an id come before all others; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.llm.bitset import in_filter, make_filter
from quire.llm.common import table
from quire.llm.wordhash import BLOCK_BYTES, blocks, window_hashes, window_starts, word_hashes, words
from quire.llm.wordmemo import forget

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of the filter, and bits for each repeated anchor below which it isn't used.
FILTER_BYTES, FILTER_BITS = 16 << 20, 16
#: Runs that a task holds before it passes the first of each on.
HELD = 2_000_000
#: Rows of a batch that goes back to Spark.
SENT = 100_000
NO_ID = -(1 << 63)
#: Ids of several texts up to which they are broadcast; beyond, every text is told apart by its hash.
MOST_REUSED = 10_000


def _positions(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of a block: the text that each belongs to, and its index there."""
    owner = np.searchsorted(first, at, side="right") - 1
    return owner, at - first[owner]


def _anchors(first: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that start an anchor at a cover position, and the anchors' hashes."""
    width = window - PERIOD + 1
    at = window_starts(first, width)
    at = at[np.isin(_positions(first, at)[1] % PERIOD, COVER)]
    return at, window_hashes(hashes, at, width)


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text, ...) with a column ``sub`` that tells the texts of an id apart, if any id has several."""
    own = docs.select("id", F.xxhash64("text").alias("h")).groupBy("id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    reused = own.where("low <> high").select("id").limit(MOST_REUSED + 1).collect()
    if not reused:
        return docs
    if len(reused) > MOST_REUSED:
        return docs.withColumn("sub", F.xxhash64("text"))
    several = docs.sparkSession.createDataFrame([(r["id"], True) for r in reused], "id long, several boolean")
    return docs.join(F.broadcast(several), "id", "left").withColumn("sub", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")


def _keys(docs: DataFrame) -> list[str]:
    """The columns that tell documents apart."""
    return ["id", "sub"] if "sub" in docs.columns else ["id"]


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h): hashes of anchors that occur more than once in (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[np.ndarray] = []

        def passed_on() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            # A hash that repeats here is sent twice, so that counting rows is enough.
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(n, 2)).view(np.int64))], ["h"])

        for batch in batches:
            for part in blocks(batch):
                w = words(part.column("text"))
                held.append(_anchors(w.first, word_hashes(w), window)[1])
                if sum(map(len, held)) > HELD:
                    yield passed_on()
        if held:
            yield passed_on()

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 1").select("h")


def anchor_places(docs: DataFrame, window: int) -> DataFrame:
    """(h, id, pos), and ``sub`` if there is one, of all anchors."""
    keys = _keys(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = words(part.column("text"))
                at, h = _anchors(w.first, word_hashes(w), window)
                owner, pos = _positions(w.first, at)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(part.column(k).take(pa.array(owner)) for k in keys), pa.array(pos.astype(np.int32))], ["h", *keys, "pos"])

    return docs.mapInArrow(run, f"h long, {' long, '.join(keys)} long, pos int")


def repeated_starts(docs: DataFrame, window: int = WINDOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(id, pos), and ``sub`` if there is one: starts of runs of ``window`` words of (id, text) that also start earlier."""
    keys = _keys(docs)
    repeated = repeated_anchors(docs, window).persist()
    try:
        small = repeated.count() * FILTER_BITS <= 8 * filter_bytes
        cells = make_filter(repeated, filter_bytes) if small else None
    finally:
        repeated.unpersist()
    if small:
        shared = docs.sparkSession.sparkContext.broadcast(cells)
        marked = docs
    else:
        marks = anchor_places(docs, window).join(repeated_anchors(docs, window), "h").groupBy(*keys).agg(F.collect_set("pos").alias("marks"))
        marked = docs.join(marks, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            h1, h2, pos, *doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((pos, *doc[::-1], h2, h1))
            h1, h2, pos, doc = h1[order], h2[order], pos[order], [x[order] for x in doc]
            same = np.zeros(len(h1), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            # Later occurrences are repeats for sure: they go by their own place, with ~pos as the mark of that.
            at_first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
            later = same & np.any([x != x[at_first] for x in (*doc, pos)], axis=0)
            h1[later] = (sum(x[later] for x in doc) * 1_000_003 + pos[later]) * np.int64(0x5851F42D4C957F2D)
            h2[later] = 0
            pos = np.where(later, ~pos, pos)
            # In order of place again: neighbours in a shuffle block then share most of their bytes.
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            tail = h2.astype(np.int64) << 32 | pos.astype(np.int64) & 0xFFFFFFFF
            for some in (back[k : k + SENT] for k in range(0, len(back), SENT)):
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (h1, tail, *doc)], ["h1", "tail", *keys])

        for batch in batches:
            for part in blocks(batch):
                w = words(part.column("text"))
                hashes = word_hashes(w)
                if small:
                    at, h = _anchors(w.first, hashes, window)
                    at = at[in_filter(shared.value, h)]
                else:
                    marks = part.column("marks")
                    at = np.sort(w.first[:-1][pc.list_parent_indices(marks).to_numpy()] + pc.list_flatten(marks).to_numpy())
                # A run is looked at if one of the anchors that lie in it repeats.
                seen = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(seen, at + 1, 1)
                seen = np.cumsum(seen)
                start = window_starts(w.first, window)
                start = start[seen[np.minimum(start + PERIOD, len(hashes))] > seen[start]]
                owner, pos = _positions(w.first, start)
                doc = [part.column(k).to_numpy(zero_copy_only=False)[owner].astype(np.int64) for k in keys]
                others = word_hashes(w, way=1) if len(start) else hashes
                held.append((window_hashes(hashes, start, window, 0).view(np.int64), (window_hashes(others, start, window, 1) >> np.uint64(33)).astype(np.int32), pos.astype(np.int32), *doc))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from passed_on()
        if held:
            yield from passed_on()

    # ``tail`` holds the hash's other half above the position, which takes a third less of the shuffle.
    runs = marked.mapInArrow(run, f"h1 long, tail long, {' long, '.join(keys)} long").withColumns({"h2": F.shiftright("tail", 32), "pos": F.expr("cast(shiftright(shiftleft(tail, 32), 32) as int)")})
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy(*keys, "pos"))
    return runs.withColumn("place", place).where("pos < 0 or place > 1").select(*keys, F.when(F.col("pos") < 0, F.bitwise_not("pos")).otherwise(F.col("pos")).alias("pos"))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns with the text as zstandard bytes, for the shuffle of whole texts."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for part in blocks(batch):
            at = part.schema.get_field_index("text")
            texts = pa.array([None if t is None else squeeze(t) for t in part.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            yield part.set_column(at, "squeezed", texts)


def _texts(part: pa.RecordBatch) -> list[bytes | None]:
    restore = zstandard.ZstdDecompressor().decompress
    return [None if t is None else restore(t) for t in part.column("squeezed").to_pylist()]


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bytes: int = FILTER_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, squeezed, starts, carried): for each document the starts of its repeated runs, null where it has none.

    ``carried`` is a struct of the columns named in ``carry``, and of the id."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(id_col, *carry).alias("carried")] if carry else []))
    texts = keyed(texts)
    keys = _keys(texts)
    starts = repeated_starts(texts.select(*keys, "text"), window, filter_bytes).groupBy(*keys).agg(F.collect_set("pos").alias("starts"))
    schema = StructType([StructField("squeezed", BinaryType()) if f.name == "text" else f for f in texts.schema])
    return texts.mapInArrow(_squeezed, schema).join(starts, keys, "left").drop("sub")


def kept_words(text: bytes, starts: list[int] | None, window: int) -> tuple[int, list[bytes]]:
    """The number of words of a text, and those that no repeated run covers."""
    found = text.split()
    if not starts:
        return len(found), found
    edge = np.zeros(len(found) + window + 1, np.int32)
    at = np.array(starts)
    at = at[at + window <= len(found)]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    keep = np.cumsum(edge)[: len(found)] == 0
    return len(found), [w for w, k in zip(found, keep.tolist(), strict=True) if k]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, filter_bytes: int = FILTER_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_removed, text): ``text`` is unchanged if all words stay, else the kept ones joined by spaces.

    With ``carry`` also ``carried``, a struct of the columns named there, and of the id."""
    more = ["carried"] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "squeezed", BLOCK_BYTES // 4):
                total, removed, texts = [], [], []
                for text, starts in zip(_texts(part), part.column("starts").to_pylist(), strict=True):
                    n, kept = kept_words(text or b"", starts, window)
                    total.append(n)
                    removed.append(n - len(kept))
                    texts.append(text if n == len(kept) else b" ".join(kept))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), *(part.column(c) for c in more)], ["id", "n_words", "n_removed", "text", *more])

    rows = with_repeats(docs, id_col, text_col, window, filter_bytes, carry)
    schema = StructType().add("id", "long").add("n_words", "long").add("n_removed", "long").add("text", "string")
    for c in more:
        schema.add(c, rows.schema[c].dataType)
    out = rows.mapInArrow(run, schema)
    return out.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def report(docs: DataFrame, window: int = WINDOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per document its words, how many go, and a digest of the kept ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "squeezed", BLOCK_BYTES // 4):
                rows = [kept_words(text or b"", starts, window) for text, starts in zip(_texts(part), part.column("starts").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(k) for n, k in rows], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in rows])], ["id", "n_words", "n_removed", "kept_sha256"])

    out = with_repeats(docs, window=window, filter_bytes=filter_bytes).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same report with every run of words in one dictionary; for tests."""
    first: dict[tuple, tuple[int, int]] = {}
    found = {doc: (text or "").encode().split() for doc, text in docs}
    for doc in sorted(found):
        w = found[doc]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (doc, i))
    out = {}
    for doc, w in found.items():
        gone = {k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (doc, i) for k in range(i, i + window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
