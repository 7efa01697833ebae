"""The crawl catalogue: merging new urls, the status rule, status updates and resets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import netloc, short_id, strip
from quire.operators.known import unknown
from quire.sources.scratch import stored

COLUMNS = ("id", "url", "domain", "discoveredat", "status", "state")


def _text(c: str) -> F.Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def merge(known: DataFrame, new: DataFrame, discovered: F.Column) -> DataFrame:
    """Known rows as they are, and one pending row for each new url of (url, state); the least state counts where a url comes twice."""
    fresh = new.where(_text("url") != "").groupBy("url").agg(F.min(F.coalesce("state", F.lit(""))).alias("state"))
    fresh = unknown(stored(fresh, "found"), known, "url")
    rows = fresh.select(short_id(F.col("url")).alias("id"), "url", netloc(F.col("url")).alias("domain"), discovered.alias("discoveredat"), F.lit("pending").alias("status"), "state")
    return known.select(*COLUMNS).unionByName(rows)


def with_rule(catalog: DataFrame) -> DataFrame:
    """Cancelled pages are skipped; what is pending then is the work list."""
    return catalog.withColumn("status", F.when(F.lower(_text("state")) == "cancelled", "skipped").otherwise(F.col("status")))


def reset(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("status", F.lit("pending"))


def with_status(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """``catalog`` with the status of (url, status, place); the update of greatest place counts, unknown urls change nothing.

    Urls are compared without blanks around them, and of several rows of a url the one of least id is updated."""
    new = updates.groupBy(_text("url").alias("key")).agg(F.max_by("status", "place").alias("new_status"))
    first = catalog.groupBy(_text("url").alias("key")).agg(F.min("id").alias("first"))
    rows = catalog.withColumn("key", _text("url")).join(first, "key").join(new, "key", "left")
    status = F.when(F.col("id") == F.col("first"), F.coalesce("new_status", "status")).otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*catalog.columns)
