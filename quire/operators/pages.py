"""Raw pages to document records, their sections and their links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import html
from quire.functions.text import netloc, second, sections_text, short_id, state_text, strip, text_hash
from quire.operators.graph import latest

FIELDS = "struct<canonical_url:string,title:string,author:string,effective_date:string,published_date:string,subjects:array<string>,language:string,sections:array<struct<title:string,text:string>>>"


def _parsed(pages: DataFrame, url_col: str, html_col: str, schema: str, read: Callable[[str, str], object]) -> DataFrame:
    """(url, p): what ``read`` makes of each page.  Pages are independent: nothing is shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"url": frame["url"], "p": [read(u or "", h or "") for u, h in zip(frame["url"], frame["html"], strict=True)]})

    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInPandas(run, f"url string, p {schema}")


def documents(pages: DataFrame, url_col: str = "url", html_col: str = "html", at: Column | None = None) -> DataFrame:
    """One record a page; a page without HTML has no title, no sections and an empty text."""
    rows = _parsed(pages, url_col, html_col, FIELDS, html.document).select("url", "p.*")
    rows = rows.withColumn("text", sections_text(F.col("sections")))
    return rows.select(short_id(F.col("canonical_url")).alias("id"), "url", "canonical_url", netloc(F.col("url")).alias("domain"), "title", "author", "effective_date", "published_date", second(at).alias("retrieved_at"), "subjects", "language", text_hash(F.col("text")).alias("hash"), "sections", F.lit(None).cast("string").alias("raw_html"), "text")


def one_per_id(records: DataFrame) -> DataFrame:
    """Of records with one canonical url the one retrieved last, among equals that of the greatest url."""
    return latest(records, ["id"], [F.col("retrieved_at"), F.col("url")]).select(*records.columns)


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html", list_id: str | None = None, nested: bool = True) -> DataFrame:
    """(page, place, url, state): the linked items of index pages, each url once a page."""
    rows = _parsed(pages, url_col, html_col, "array<struct<url:string,state:string>>", lambda u, h: html.links(u, h, list_id, nested))
    rows = rows.select(F.col("url").alias("page"), F.posexplode("p").alias("place", "item"))
    return rows.select("page", "place", "item.url", state_text(F.col("item.state")).alias("state"))


def first_seen(found: DataFrame) -> DataFrame:
    """(url, state): each linked url once, as the first page and place give it."""
    return found.where(strip(F.col("url")) != "").groupBy("url").agg(F.min_by("state", F.struct("page", "place")).alias("state"))
