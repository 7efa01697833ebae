"""Catalogues, document files, line files and logs, with schemas given, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators import catalog, graph

CATALOG = "id string, url string, domain string, discoveredat string, status string, state string"
DOCUMENT = "id string, url string, canonical_url string, domain string, title string, author string, effective_date string, published_date string, retrieved_at string, subjects array<string>, language string, hash string, raw_html string, text string"
SECTIONS = "array<struct<title:string,text:string>>"
DONE = "doc_id string, chunk_id string, done_at string, model string"


def read_catalog_xml(spark: SparkSession, path: str, row_tag: str = "Item") -> DataFrame:
    """The items of a catalogue in XML, trimmed, missing fields empty; items without a url are dropped."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(CATALOG).load(path)
    return rows.select(*(strip(F.coalesce(c, F.lit(""))).alias(c) for c in rows.columns)).where("url <> ''")


def write_catalog_xml(rows: DataFrame, path: str, row_tag: str = "Item", root_tag: str = "Items") -> None:
    """A new snapshot of a catalogue; never write over the folder that ``rows`` is read from."""
    rows.select(*(c.split()[0] for c in CATALOG.split(", "))).write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).mode("overwrite").save(path)


def add_to_catalog(spark: SparkSession, new: DataFrame, path: str, to: str, discovered: F.Column) -> None:
    """The catalogue at ``path``, empty if there is none, with the new urls of (url, state), written to ``to``."""
    write_catalog_xml(catalog.merge(_or_empty(spark, lambda: read_catalog_xml(spark, path), CATALOG), new, discovered), to)


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document a file of JSON; unreadable ones, and those without an id or with sections that are no list, are dropped.

    Elements of the list that are no objects keep their place, without title and text."""
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    fields = [c.split() for c in DOCUMENT.split(", ")]
    element = lambda s: F.when(F.schema_of_variant(s).startswith("OBJECT"), F.struct(F.try_variant_get(s, "$.title", "string").alias("title"), F.try_variant_get(s, "$.text", "string").alias("text")))
    rows = raw.select(v.alias("v")).where("v is not null").withColumn("s", F.try_variant_get("v", "$.sections", "array<variant>"))
    listed = F.col("s").isNotNull() | F.try_variant_get("v", "$.sections", "variant").isNull()
    rows = rows.where(listed).select(*(F.try_variant_get("v", f"$.{c}", kind).alias(c) for c, kind in fields), F.transform(F.coalesce("s", F.array().cast("array<variant>")), element).cast(SECTIONS).alias("sections"))
    return rows.where(strip(F.coalesce("id", F.lit(""))) != "")


def write_documents(records: DataFrame, path: str, order: list[F.Column]) -> None:
    """One row for each document id, the last by ``order``."""
    graph.latest(records, ["id"], order).write.mode("overwrite").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and corrupt ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id): the chunks that a progress log names; without a log, none."""
    rows = _or_empty(spark, lambda: read_lines(spark, path, DONE), DONE)
    return rows.select("chunk_id").where("chunk_id is not null and chunk_id <> ''").distinct()


def append_done(chunks: DataFrame, path: str, model: str, at: F.Column) -> None:
    """Log (doc_id, chunk_id) as done; call it once their results are written."""
    chunks.select(F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"), at.alias("done_at"), F.lit(model).alias("model")).write.mode("append").json(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, to: str, key: list[str], order: list[F.Column]) -> None:
    """The node or edge table at ``path``, if there is one, with ``new`` upserted, as a new snapshot at ``to``."""
    try:
        known = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = new.limit(0)
    graph.upserted(known, new, key, order).write.mode("overwrite").parquet(to)
