"""Token counts from a digest cache.

A count depends on the text and on the tokenizer alone, so the cache is a table keyed by the digests of
both: the SHA-256 of the normalised content and that of the tokenizer's file.  Texts are joined to the
cache by digest; what the cache lacks is reduced to one row a digest, encoded, and appended to the cache
before the counts are joined back.  A cache that a failed job has left behind is valid as it is.

Normalisation here is only that a null is an empty text, for the count has to be the library's for the
text as it stands.

Edge cases: null and empty texts have no bytes and no tokens; copies are encoded once; repeated document
rows stay; other columns are ignored, whatever their names; a text of any length is counted whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from quire.llm.common import new_dir, stored, table
from quire.llm.library_tokens import word_level
from quire.llm.wordhash import blocks

LIMIT = 2048
CACHE_SCHEMA = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at ``path``; an absent one is empty."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_misses(misses: DataFrame, tokenizer_path: str, digest: str) -> DataFrame:
    """(content_sha256, text) to cache rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_level(tokenizer_path)
        for batch in batches:
            for part in blocks(batch):
                counts = np.diff(tokens.block(part.column("text"))[1])
                yield pa.RecordBatch.from_arrays([part.column("content_sha256"), pa.array([digest] * len(counts)), pa.array(counts, pa.int64())], ["content_sha256", "tokenizer_sha256", "n_tokens"])

    return misses.mapInArrow(count, CACHE_SCHEMA)


def with_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for each document; new counts are appended to the cache at ``cache_path``."""
    spark = docs.sparkSession
    digest = tokenizer_digest(tokenizer_path)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("content_sha256", F.sha2("text", 256))
    known = read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == digest)
    wanted = texts.select("content_sha256", "text")
    if not known.isEmpty():
        wanted = wanted.join(known.select("content_sha256"), "content_sha256", "left_anti")
    count_misses(wanted.dropDuplicates(["content_sha256"]), tokenizer_path, digest).write.mode("append").parquet(cache_path)
    # Two jobs that appended the same digest agree on its count.  Written by itself, so that Spark can split the join at a digest that many documents share.
    counts = stored(read_cache(spark, cache_path).where(F.col("tokenizer_sha256") == digest).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return texts.select("id", "content_sha256", F.octet_length("text").cast("long").alias("n_bytes")).join(counts, "content_sha256", "left").select("id", "n_bytes", "n_tokens")


def op8_token_counts(spark: SparkSession, sf_dir: str, cache_path: str | None = None) -> DataFrame:
    """Counts of all documents by the cache at ``cache_path``, or by one of this run alone."""
    import public_tokenizers

    counted = with_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache_path or new_dir(spark, "token-counts"))
    return counted.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
