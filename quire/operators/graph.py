"""Keyed upserts, links, integrity checks, backlogs and write-backs as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators import chunks

#: Rows for which a join of links has one task: what a task holds doesn't grow with the links.
TASK_ROWS = 1_000_000


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last write of each key; a partial aggregate runs before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")


def upserted(known: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``known`` with the rows of ``new`` in place of those of equal key; of several new ones the last by ``order``."""
    last = latest(new.select(*known.columns), key, order).select(*known.columns)
    return known.join(new.select(*key).distinct(), key, "left_anti").select(*known.columns).unionByName(last)


def key_violations(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def links_between(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct links (a, b) of which both ends exist in (a) and (b).

    Large ones are dealt to as many tasks as they have rows for; Spark would put small bytes of many rows together."""
    tasks = max(rows.count() for rows in (links, left, right)) // TASK_ROWS
    if tasks > 1:
        tasks = max(tasks, links.sparkSession.sparkContext.defaultParallelism)
        found = links.repartition(tasks, "a").join(left.repartition(tasks, "a"), "a", "left_semi")
        return found.repartition(tasks, "b").join(right.repartition(tasks, "b"), "b", "left_semi").dropDuplicates(["a", "b"])
    return links.join(left, "a", "left_semi").join(right, "b", "left_semi").dropDuplicates(["a", "b"])


def backlog(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def embed_backlog(rows: DataFrame) -> DataFrame:
    """Chunks that have a text and no vector yet."""
    return rows.where(F.col("embedding").isNull() | (F.size("embedding") == 0)).where(strip(F.coalesce("text", F.lit(""))) != "")


def extract_backlog(chunks: DataFrame, links: DataFrame, sections: DataFrame, docs: DataFrame, done: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, text) of chunks that a document reaches by its sections, not extracted yet and not in the log.

    ``links`` is (section_id, chunk_id), ``sections`` (section_id, doc_id); the least document counts where several reach a chunk."""
    reached = links.select("section_id", "chunk_id").join(sections.select("section_id", "doc_id"), "section_id").join(docs.select("doc_id"), "doc_id", "left_semi")
    owner = reached.groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    open_chunks = backlog(chunks.where("extracted_at is null").select("chunk_id", "text"), done, "chunk_id")
    return open_chunks.join(owner, "chunk_id").select("chunk_id", "doc_id", "text")


def with_embeddings(chunks: DataFrame, vectors: DataFrame, model: str, at: Column) -> DataFrame:
    """``chunks`` with the vectors of (chunk_id, vector) written in; vectors of unknown chunks are dropped."""
    new = vectors.groupBy("chunk_id").agg(F.max("vector").alias("vector"))
    rows = chunks.join(new, "chunk_id", "left")
    old = lambda c, kind: F.col(c) if c in chunks.columns else F.lit(None).cast(kind)
    fresh = F.col("vector").isNotNull()
    return rows.withColumns({"embedding": F.coalesce("vector", old("embedding", "array<float>")), "embedding_model": F.when(fresh, F.lit(model)).otherwise(old("embedding_model", "string")), "embedded_at": F.when(fresh, at).otherwise(old("embedded_at", "string"))}).drop("vector")


def ingest_counts(docs: DataFrame) -> DataFrame:
    """(what, n) for one ingest of documents (doc_id, sections): documents, sections, chunks and links.

    The rows are counted as they pass, in one job that cuts the texts once.  A stage that is run anew because an
    executor was lost counts its rows again; count the written tables where that matters."""
    seen = {what: Observation(what) for what in ("docs", "sections", "chunks", "links")}
    passing = lambda rows, what: rows.observe(seen[what], F.count(F.lit(1)).alias("n"))
    parts = passing(chunks.chunk(passing(chunks.sections(passing(docs, "docs")), "sections")), "chunks")
    passing(chunks.links(parts), "links").write.format("noop").mode("overwrite").save()
    return docs.sparkSession.createDataFrame([(what, one.get["n"]) for what, one in seen.items()], "what string, n long")
