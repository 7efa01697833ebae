"""Sections to overlapping chunks of characters, with ids that a second run repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_section_title, section_id, short_id, strip, token_count

SPANS = "array<struct<chunk_index:int,text:string,start_char:int,end_char:int>>"


def spans(text: str, size: int = 1000, overlap: int = 200, last: int = 2000) -> list[tuple[int, int]]:
    """Stripped spans of a text: each ends at the first space from ``size`` on, the next goes back by ``overlap``."""
    n, cuts, start = len(text), [], 0
    while start < n:
        aim = start + size
        space = text.find(" ", aim) if aim < n else n
        end = min(aim, n) if space < 0 else space
        rest = n - max(0, end - overlap)
        if n <= last and not cuts or end >= n or rest < size:
            cuts.append((start, n))
            break
        cuts.append((start, end))
        start = max(0, end - overlap)
        if rest <= last:
            cuts.append((start, n))
            break
    moved = []
    for a, b in cuts:
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        if piece := piece.strip():
            moved.append((a, a + len(piece)))
    return moved


def sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a section of (id, sections array<struct<title,text>>); blank ones leave a gap in the index."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode("sections").alias("section_index", "s"))
    rows = rows.select("doc_id", "section_index", clean_section_title(F.col("s.title")).alias("title"), strip(F.coalesce("s.text", F.lit(""))).alias("text"))
    rows = rows.where("text <> ''")
    return rows.withColumn("section_id", section_id(F.col("doc_id"), F.col("section_index")))


def chunk(rows: DataFrame, size: int = 1000, overlap: int = 200, last: int = 2000) -> DataFrame:
    """Chunks of the sections (doc_id, section_index, section_id, title, text)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the size")

    @F.arrow_udf(SPANS)
    def cut(texts: pa.Array) -> pa.Array:
        ends, places, pieces = [0], [], []
        for text in texts.to_pylist():
            found = spans(text, size, overlap, last)
            places += [(k, a, b) for k, (a, b) in enumerate(found)]
            pieces += [text[a:b] for a, b in found]
            ends.append(len(pieces))
        index, start, end = (pa.array(x) for x in np.array(places, np.int32).reshape(-1, 3).T.copy())
        rows = pa.StructArray.from_arrays([index, pa.array(pieces, pa.string()), start, end], ["chunk_index", "text", "start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    out = rows.withColumn("c", F.explode(cut("text"))).select("doc_id", "section_index", "section_id", F.col("title").alias("section"), "c.*")
    return out.withColumns({"chunk_id": short_id(*(F.col(c) for c in ("doc_id", "section_index", "chunk_index", "start_char", "end_char"))), "token_count": token_count(F.col("text"))})


def links(chunks: DataFrame) -> DataFrame:
    """(doc_id, section_id, chunk_id), each once."""
    return chunks.select("doc_id", "section_id", "chunk_id").distinct()
