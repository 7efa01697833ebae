"""From hits to contexts: titles, neighbours in the section, blocks of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import clean_ws, truncate
from quire.operators.search import TOP
from quire.sources.scratch import stored, stored_small

#: Characters to either side for each place of the window, where chunks have no index.
REACH = 2_000
#: Reaches to a band of a section.
BAND = 128


def hydrated(hits: DataFrame, chunks: DataFrame, sections: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with doc_title, ref_number and section_title filled in where they are blank or absent.

    ``chunks`` is (chunk_id, section_id, section), ``sections`` (section_id, doc_id, title), ``docs`` (doc_id,
    title, ref_number); a chunk in several sections takes the least title of each kind."""
    wanted = hits.select("chunk_id").distinct()
    rows = chunks.select("chunk_id", "section_id", "section").join(stored_small(wanted, "wanted"), "chunk_id", "left_semi")
    rows = rows.join(sections.select("section_id", "doc_id", F.col("title").alias("s_title")), "section_id", "left").join(docs.select("doc_id", F.col("title").alias("d_title"), F.col("ref_number").alias("d_number")), "doc_id", "left")
    found = rows.groupBy("chunk_id").agg(F.min("d_title").alias("new_doc_title"), F.min("d_number").alias("new_ref_number"), F.coalesce(F.min("s_title"), F.min("section")).alias("new_section_title"))
    fields = ("doc_title", "ref_number", "section_title")
    own = lambda c: clean_ws(F.col(c)) if c in hits.columns else F.lit("")
    kept = [c for c in hits.columns if c not in fields]
    return hits.join(found, "chunk_id", "left").select(*kept, *(F.when(own(c) != "", F.col(c) if c in hits.columns else F.lit("")).otherwise(F.coalesce(f"new_{c}", F.lit(""))).alias(c) for c in fields))


def expand(hits: DataFrame, chunks: DataFrame, window: int = 2, by: str = "start_char") -> DataFrame:
    """(q_id, chunk_id, seed_rank): each hit and its neighbours in its section, with the best rank that led there.

    Neighbours are ``window`` places apart by ``chunk_index``, or REACH characters for each by ``start_char``;
    a hit without a section or a place stands for itself.  A section's places are cut into bands as wide as the
    reach: a hit looks in its band and those beside it, so that the chunks of one section join in many tasks."""
    reach = window if by == "chunk_index" else REACH * window
    band = F.greatest(F.lit(1), F.lit(reach))
    seeds = stored(hits.join(chunks.select("chunk_id", "section_id", F.col(by).alias("at")), "chunk_id", "left").select("q_id", "chunk_id", "rank", F.col("section_id").alias("s"), "at"), "seeds")
    places = seeds.where("s is not null and at is not null").groupBy("q_id", "s", "at").agg(F.min("rank").alias("rank"))
    bands = F.sequence(F.floor((F.col("at") - reach) / band), F.floor((F.col("at") + reach) / band))
    places = stored_small(places.withColumn("band", F.explode(bands)), "places")
    rows = chunks.where(F.col("section_id").isNotNull() & F.col(by).isNotNull()).select("chunk_id", "section_id", F.col(by).alias("place"), F.floor(F.col(by) / band).alias("band"))
    near = rows.join(places, (F.col("section_id") == F.col("s")) & (rows["band"] == places["band"]) & F.expr(f"place BETWEEN at - {reach} AND at + {reach}"))
    both = near.select("q_id", "chunk_id", "rank").unionByName(seeds.select("q_id", "chunk_id", "rank"))
    return both.groupBy("q_id", "chunk_id").agg(F.min("rank").alias("seed_rank"))


def siblings(chunks: DataFrame, window: int = 2, by: str = "chunk_index", band: int = BAND) -> DataFrame:
    """(chunk_id, siblings): the ids, in order, that expand() would give each chunk, for all chunks at once.

    The frame goes by value, so gaps in the index count.  A section is cut into bands of ``band`` reaches; the
    places within reach of a band's ends stand there as guests, so that each band is whole by itself and a long
    section runs in many tasks."""
    reach = window if by == "chunk_index" else REACH * window
    wide = band * max(1, reach)
    frame = Window.partitionBy("section_id", "band").orderBy("place").rangeBetween(-reach, reach)
    rows = chunks.select("chunk_id", "section_id", F.col(by).cast("long").alias("place"))
    placed = F.col("section_id").isNotNull() & F.col("place").isNotNull()
    own = F.floor(F.col("place") / wide)
    dealt = rows.where(placed).withColumn("own", own).withColumn("band", F.explode(F.sequence(F.floor((F.col("place") - reach) / wide), F.floor((F.col("place") + reach) / wide))))
    near = dealt.select("chunk_id", "own", "band", F.sort_array(F.collect_list("chunk_id").over(frame)).alias("siblings")).where("own = band").select("chunk_id", "siblings")
    return near.unionByName(rows.where(~placed).select("chunk_id", F.array("chunk_id").alias("siblings")))


def context(hits: DataFrame, chunks: DataFrame, n: int = TOP, most: int = 1600, joint: str = " — ", number_prefix: str = "", default: str = "Context") -> DataFrame:
    """(q_id, context): the first ``n`` hits as blocks in order; a blank id or text uses up its place.

    A block's header has the document's title or else its number, and the section; ``default`` if it has none."""
    fields = ("doc_title", "ref_number", "section_title")
    # Hits come to the texts: these move only where the hits are too many to be broadcast.
    rows = chunks.select("chunk_id", "section", "text").join(stored_small(hits.where(F.col("rank") <= n), "ranked"), "chunk_id")
    title, number, section = (clean_ws(F.col(c)) if c in hits.columns else clean_ws(F.col("section")) if c == "section_title" else F.lit("") for c in fields)
    rows = rows.withColumns({"text": clean_ws(F.col("text")), "cid": clean_ws(F.col("chunk_id").cast("string"))})
    whose = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit(number_prefix), F.nullif(number, F.lit(""))))
    header = F.concat_ws(joint, whose, F.concat(F.lit("Section: "), F.nullif(section, F.lit(""))))
    header = F.when(header == "", F.lit(default)).otherwise(header)
    block = F.concat(header, F.lit("\n[chunk_id="), F.col("cid"), F.lit("]\n"), truncate(F.col("text"), most), F.lit("\n"))
    # As a filter of the rows this would be pushed below the join, and every text be cleaned for it.
    block = F.when((F.col("text") != "") & (F.col("cid") != ""), F.struct("rank", block.alias("block")))
    blocks = rows.groupBy("q_id").agg(F.sort_array(F.collect_list(block)).alias("b")).where("size(b) > 0")
    return blocks.select("q_id", F.regexp_replace(F.array_join(F.col("b.block"), "\n"), r"(?U)^\s+|\s+$", "").alias("context"))
