"""Token ids in shards of a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their ranks in the corpus, the most frequent first, so that most take one byte.  Spark
deals the documents to parts by ranges of doc_id, as many as there are bytes for, and a part is cut into
shards of bounded size.  A shard holds documents in ascending order:

    before   ids of the shards before it in its part

    ends     cumulative numbers of ids after each document, unsigned 64-bit little-endian
    control  two bits an id, four ids a byte, low bits first: the id's bytes less one
    data     the ranks' low bytes, little-endian, one to four each

and every set of shards has a table of the id of each rank.  Shards are binary columns of Parquet files,
one row a shard, so Spark's writers commit them and any store that Spark reads can hold them.  Reading
takes numpy only: a table of 256 rows turns control bytes to lengths, and sums of these to places.

Edge cases: null and empty texts hold the end id only; documents without an id come first; rows that
repeat an id are all kept, ordered by a hash of their ids' code bytes, then by these, and may fall into
several parts; an empty table gives no shards and no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import bytes_of, drop_dir, new_dir, stored_small, table
from quire.llm.library_tokens import byte_level
from quire.llm.wordhash import blocks
from quire.llm.wordmemo import forget

END_ID = 0
#: Bytes of code at which a shard ends, which one task holds in memory, and of compressed code for one part, which it sorts.
SHARD_BYTES = 2 << 20
PART_BYTES = 16 << 20
#: Bytes of a row group, which Spark holds whole when it writes one, and when it reads one of few long rows.
GROUP_BYTES = 8 << 20
#: Most ids that a rank table may have: its size is that of a vocabulary, not of the corpus.
MAX_IDS = 4_000_000

DRAFT_SCHEMA = "tally boolean, id long, n long, control binary, data binary"
SHARD_SCHEMA = "part int, place int, before long, n_docs long, n_ids long, doc_ids binary, no_id binary, ends binary, control binary, data binary"
_LENGTHS = np.array([[(byte >> (2 * k) & 3) + 1 for k in range(4)] for byte in range(256)], np.uint8)


def pack(values: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, data bytes, and where each run values[cut[i]:cut[i+1]] begins and ends in both."""
    n = np.diff(cut)
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.concatenate([[0], np.cumsum(-(-n // 4) * 4)])
    codes = np.zeros(padded[-1], np.uint8)
    codes[np.arange(len(values)) + np.repeat(padded[:-1] - cut[:-1], n)] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    octets = np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4)
    ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    return control, octets[np.arange(4) < length[:, None]], padded // 4, ends[cut]


def unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values that pack() was given in runs of ``n``."""
    length = _LENGTHS[control].reshape(-1)
    padded = np.cumsum(-(-n // 4) * 4)
    length = length[np.arange(int(n.sum())) + np.repeat(padded - (-(-n // 4) * 4) - (np.cumsum(n) - n), n)]
    start = np.cumsum(length, dtype=np.int64) - length
    values = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(length > k)
        values[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _octets(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _write(rows: DataFrame, path: str, row_bytes: int = 1) -> None:
    """As Parquet, in row groups of bounded size for rows of up to about ``row_bytes``; compressed bytes are looked at every few rows, by default after 100 to 10,000."""
    most = {"parquet.block.size": GROUP_BYTES, "parquet.block.row.count.limit": max(1, GROUP_BYTES // row_bytes)}
    looks = {"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16}
    rows.write.options(compression="zstd", **most, **looks).parquet(path)


def draft(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(id, text) to draft rows, coded by the ids themselves and with the end id; each task adds a tally, its counts of ids."""
    names = ["tally", "id", "n", "control", "data"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_level(tokenizer_path)
        total = np.zeros(1, np.int64)
        for batch in batches:
            for part in blocks(batch):
                values, cut = tokens.block(part.column("text"))
                values, cut = np.insert(values, cut[1:], END_ID), cut + np.arange(len(cut))
                got = np.bincount(values)
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
                control, data, at, to = pack(values, cut)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, bool)), part.column("id"), pa.array(np.diff(cut)), _binary(control, at), _binary(data, to)], names)
        used = np.flatnonzero(total)
        tally = np.stack([used, total[used]]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([True]), pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([b""]), pa.array([tally])], names)

    return docs.mapInArrow(encode, DRAFT_SCHEMA)


def id_counts(coded: DataFrame) -> DataFrame:
    """(token, n) over all documents of a draft, from the counts of its tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for tally in batch.column("data").to_pylist():
                used, n = np.frombuffer(tally, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], ["token", "n"])

    return coded.where("tally").select("data").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """Ids by falling count, smaller ids first among equals; as many as the vocabulary has at most."""
    rows = counts.orderBy(F.desc("n"), "token").limit(MAX_IDS + 1).select("token").toPandas()["token"].to_numpy(np.uint32)
    if len(rows) > MAX_IDS:
        raise ValueError(f"more than {MAX_IDS} different ids")
    return rows


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> None:
    """Write ``path``/ranks and ``path``/shards; ``path``/draft holds the ids coded as they are meanwhile."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    _write(draft(texts, tokenizer_path).withColumn("tie", F.xxhash64("data")), f"{path}/draft")
    coded = spark.read.schema(f"{DRAFT_SCHEMA}, tie long").parquet(f"{path}/draft")
    ids = rank_table(id_counts(coded))
    spark.createDataFrame(pa.table({"rank": np.arange(len(ids), dtype=np.int64), "token": ids.astype(np.int64)})).write.parquet(f"{path}/ranks")
    ranks = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    ranks[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)
    parts = max(bytes_of(spark, f"{path}/draft") // part_bytes + 1, spark.sparkContext.defaultParallelism)
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    dealt = coded.where("not tally").repartitionByRange(parts, *order).sortWithinPartitions(*order, "data").select("id", "n", "control", "data")
    _write(dealt.mapInArrow(lambda b: _gather(b, shared.value, shard_bytes), SHARD_SCHEMA), f"{path}/shards", shard_bytes)
    drop_dir(spark, f"{path}/draft")


def _gather(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """The ordered draft rows of a part to one row a shard, which ends with the document that fills it."""
    forget()
    part, place, before, size = TaskContext.get().partitionId(), 0, 0, 0
    held: list[pa.RecordBatch] = []

    def shard_row() -> pa.RecordBatch:
        nonlocal place, before, size
        t = pa.Table.from_batches(held)
        n = t.column("n").to_numpy()
        values = ranks[unpack(_octets(t.column("control")), _octets(t.column("data")), n)]
        control, data, _, _ = pack(values, np.array([0, len(values)]))
        doc = t.column("id")
        row = {"part": part, "place": place, "before": before, "n_docs": len(n), "n_ids": int(n.sum()), "doc_ids": pc.fill_null(doc, 0).to_numpy().astype("<i8").tobytes(), "no_id": np.packbits(pc.is_null(doc).to_numpy()).tobytes(), "ends": np.cumsum(n).astype("<u8").tobytes(), "control": control.tobytes(), "data": data.tobytes()}
        held.clear()
        place, before, size = place + 1, before + row["n_ids"], 0
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("place", pa.int32()), *((c, pa.int64()) for c in ("before", "n_docs", "n_ids")), *((c, pa.binary()) for c in ("doc_ids", "no_id", "ends", "control", "data"))]))

    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("data")).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            # The first row that brings the shard to its size ends it.
            done = int(sizes[at - 1]) if at else 0
            stop = min(int(np.searchsorted(sizes, done + shard_bytes - size)) + 1, batch.num_rows)
            held.append(batch.slice(at, stop - at))
            size += int(sizes[stop - 1]) - done
            at = stop
            if size >= shard_bytes:
                yield shard_row()
    if held:
        yield shard_row()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files alone."""
    ids = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("token").toPandas()["token"].to_numpy(np.uint32)
    shared = spark.sparkContext.broadcast(ids)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # Where each part starts: one row a part, small beside its bytes.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored_small(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "token-parts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ids = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                tokens = ids[unpack(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), np.array([row["n_ids"]]))].astype("<u4")
                ends = np.frombuffer(row["ends"], "<u8").astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                none = np.unpackbits(np.frombuffer(row["no_id"], np.uint8))[: len(ends)].astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=none), pa.array(begins + row["start"]), pa.array(ends - begins), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    placed = shards.join(bases, "part").withColumn("start", F.col("base") + F.col("before"))
    return placed.select("n_ids", "doc_ids", "no_id", "ends", "control", "data", "start").mapInArrow(decode, "id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_dir(spark, "token-files")
    write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_shards(spark, path).withColumnRenamed("id", "doc_id")
