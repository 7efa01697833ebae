"""A corpus pipeline: language, near copies, repeated passages, benchmark passages, tokens.

Each stage takes the documents that the one before it kept, as written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, language, ngram_join, substrings
from quire.llm.common import small_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts without a letter go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return language.keep_identified(docs, language.fit(docs.where(~language.is_held_out())))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id, and of its texts there the one of least digest.

    Rows of equal id and text are one document; rows without id and words are no copies of anything."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    bare = F.col("doc_id").isNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    keys = (F.coalesce(F.col("doc_id").cast("long"), F.lit(ngram_join.NO_ID)).alias("id"), F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("row"))
    rest = docs.where(~bare)
    rows = ngram_join.clustered(rest.select(*keys, F.col("text").cast("string").alias("text"))).groupBy("id", "row", "n", "digest", "cluster").count()
    # Sets without links stand under themselves, and documents without words each for itself.
    alone = F.when(F.col("n") == 0, F.struct("id", "row")), F.when(F.col("cluster").isNull(), F.struct("n", "digest"))
    kept = stored(rows.groupBy("cluster", *alone).agg(F.min(F.struct("id", "row", "count")).alias("least")).select("least.*"), "kept")
    found = rest.select("*", *keys).join(kept, ["id", "row"], "left_semi")
    found = found if kept.where("count > 1").isEmpty() else found.dropDuplicates(["id", "row"])
    return found.select(*COLUMNS).union(docs.where(bare))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those of which nothing is left go."""
    small_batches(spark)
    kept = substrings.dedup(docs, carry=("lang", "source")).where("n_words = 0 or n_removed < n_words")
    return kept.select("carried.doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover less than a twentieth."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    return found.where(~decontaminate.is_contaminated()).select(F.col("id").alias("doc_id"), "text", "carried.lang", "carried.source", "carried.n_chars")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the tokens are and decode to."""
    import public_tokenizers

    small_batches(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify),
    ("near_copies", one_of_each),
    ("repeats", without_repeats),
    ("benchmark", uncontaminated),
    ("tokens", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
