"""The graph's tables loaded in order, and corpus statistics kept up by batches; each batch is one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import graph
from quire.operators.search import tokens
from quire.sources import commits, keyed
from quire.sources.scratch import stored, stored_small

#: The tables of the graph and their keys.
GRAPH = {"docs": ["doc_id"], "sections": ["section_id"], "chunks": ["chunk_id"], "links": ["section_id", "chunk_id"]}


def _with_known(spark: SparkSession, path: str, table: str, new: DataFrame) -> DataFrame:
    """(key): the keys that the table has once ``new`` is in it."""
    known = keyed.current(spark, path, table)
    keys = new.select(*GRAPH[table])
    return (keys if known is None else keys.unionByName(known.select(*GRAPH[table]))).distinct()


def load(spark: SparkSession, path: str, name: str, batch: dict[str, DataFrame], order: list[Column], buckets: int = keyed.BUCKETS) -> bool:
    """Upsert a batch of docs, sections, chunks and links, all in one commit; False if ``name`` is committed already.

    Sections of documents that are neither known nor in the batch are left out, and links of which an end is
    missing; ``order`` says which of several rows of a key is the last."""
    if commits.is_committed(spark, path, name):
        return False
    docs, chunks = batch["docs"].where("doc_id is not null"), batch["chunks"].where("chunk_id is not null")
    sections = stored(batch["sections"].where("section_id is not null").join(_with_known(spark, path, "docs", docs), "doc_id", "left_semi"), "sections")
    links = batch["links"].join(_with_known(spark, path, "sections", sections), "section_id", "left_semi").join(_with_known(spark, path, "chunks", chunks), "chunk_id", "left_semi")
    whole = {"docs": docs, "sections": sections, "chunks": chunks, "links": links.select(*batch["links"].columns)}
    writes = [keyed.staged(whole[t], path, t, key, order, buckets) for t, key in GRAPH.items()]
    commits.commit(spark, path, name, [w for w in writes if w])
    return True


#: Tables of the statistics: the chunks as they were counted, and the sums for each term; "" stands for all chunks.
TEXTS, TERMS = "texts", "terms"


def count_in(chunks: DataFrame, path: str, name: str, order: list[Column], buckets: int = keyed.BUCKETS) -> bool:
    """Bring the statistics up to date with a batch of (chunk_id, text, ...); False if ``name`` is committed already.

    Only the difference is summed: what the batch's chunks have now, less what they had when they were counted
    before.  Of each table the buckets that change are rewritten, and both tables are one commit, so that a batch
    counts once."""
    spark = chunks.sparkSession
    if commits.is_committed(spark, path, name):
        return False
    of_texts, of_terms = (keyed.layout(spark, path, t, buckets) for t in (TEXTS, TERMS))
    # Texts become their distinct tokens before anything is shuffled.
    orders = [c.alias(f"order_{k}") for k, c in enumerate(order)]
    split = chunks.where("chunk_id is not null").select("chunk_id", *orders, tokens(F.col("text")).alias("t"))
    # One text of the distinct tokens, with a blank before each: an array of them takes more bytes in a shuffle.
    split = split.withColumns({"len": F.size("t").cast("long"), "t": F.array_join(F.concat(F.array(F.lit("")), F.array_distinct("t")), " ")})
    last = graph.latest(split, ["chunk_id"], [F.col(f"order_{k}") for k in range(len(order))])
    new = stored(last.select("chunk_id", "len", "t"), "counted", "zstd")
    touched = keyed.touched_by(new, ["chunk_id"], of_texts)
    if not touched:
        commits.commit(spark, path, name, [])
        return True
    old = keyed.current(spark, path, TEXTS, touched)
    share = lambda rows, sign: rows.select(F.explode(F.split("t", " ")).alias("term"), "len", F.lit(sign).alias("sign"))
    delta, rows = share(new, 1), new
    if old is not None:
        # While the ids of a batch are few enough to be broadcast, the known rows stay where they are.
        ids = stored_small(new.select("chunk_id"), "ids")
        delta = delta.unionByName(share(old.join(ids, "chunk_id", "left_semi"), -1))
        rows = old.join(ids, "chunk_id", "left_anti").select(*new.columns).unionByName(new)
    delta = delta.groupBy("term").agg(F.sum("sign").cast("long").alias("df"), F.sum(F.when(F.col("term") == "", F.col("sign") * F.col("len")).otherwise(0)).cast("long").alias("total"))
    delta = stored(delta.where("df <> 0 OR total <> 0"), "difference")
    writes = [keyed.replaced(rows, path, TEXTS, touched, ["chunk_id"], of_texts)]
    if changed := keyed.touched_by(delta, ["term"], of_terms):
        known = keyed.current(spark, path, TERMS, changed)
        sums = delta if known is None else delta.unionByName(known.select("term", "df", "total"))
        # A term that no chunk has any more stays with 0, so that its bucket is never without a folder.
        sums = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        writes.append(keyed.replaced(sums, path, TERMS, changed, ["term"], of_terms))
    commits.commit(spark, path, name, writes)
    return True


def statistics(spark: SparkSession, path: str) -> DataFrame | None:
    """(term, df, total): how many chunks have each term; under "" the number of chunks and the sum of their lengths."""
    rows = keyed.current(spark, path, TERMS)
    return None if rows is None else rows.where("df > 0").select("term", "df", "total")
