"""Answers of a model to entity, date and relation tables, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_ws, entity_type, json_list, json_object, json_text, short_id
from quire.operators.graph import latest


def parsed(responses: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, response) to (chunk_id, doc_id, v): answers that hold a JSON object."""
    return responses.select("chunk_id", "doc_id", json_object(F.col("response")).alias("v")).where("v is not null")


def _elements(answers: DataFrame, path: str) -> DataFrame:
    """(chunk_id, doc_id, place, e): the objects in a list of each answer."""
    rows = answers.select("chunk_id", "doc_id", F.posexplode(json_list(F.col("v"), path)).alias("place", "e"))
    return rows.where(F.schema_of_variant("e").startswith("OBJECT"))


def entity_id(doc_id: Column, kind: Column, name: Column) -> Column:
    return short_id(doc_id, kind, F.lower(name))


def entities(answers: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, place, id, name, type, aliases, evidence_excerpt) of the entities that have a name."""
    e = F.col("e")
    rows = _elements(answers, "$.entities").select("chunk_id", "doc_id", "place", json_text(e, "$.name").alias("name"), entity_type(json_text(e, "$.type")).alias("type"), F.filter(F.transform(json_list(e, "$.aliases"), lambda a: json_text(a)), lambda a: a != "").alias("aliases"), json_text(e, "$.evidence_excerpt").alias("evidence_excerpt"))
    return rows.where("name <> ''").withColumn("id", entity_id(F.col("doc_id"), F.col("type"), F.col("name")))


def dates(answers: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, place, id, value, label, certainty) of the dates that have a value."""
    e = F.col("e")
    rows = _elements(answers, "$.dates").select("chunk_id", "doc_id", "place", *(json_text(e, f"$.{c}").alias(c) for c in ("value", "label", "certainty")))
    return rows.where("value <> ''").withColumn("id", entity_id(F.col("doc_id"), F.lit("Date"), F.col("value")))


def relations(answers: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, place, source_id, target_id, relation_type, evidence_excerpt) of the relations with both ends named."""
    e = F.col("e")
    fields = ("source_entity", "target_entity", "source_type", "target_type", "relation_type", "evidence_excerpt")
    rows = _elements(answers, "$.relationships").select("chunk_id", "doc_id", "place", *(json_text(e, f"$.{c}").alias(c) for c in fields)).where("source_entity <> '' and target_entity <> ''")
    end = lambda which: entity_id(F.col("doc_id"), entity_type(F.col(f"{which}_type")), F.col(f"{which}_entity"))
    return rows.select("chunk_id", "doc_id", "place", end("source").alias("source_id"), end("target").alias("target_id"), F.coalesce(F.nullif("relation_type", F.lit("")), F.lit("RELATED_TO")).alias("relation_type"), "evidence_excerpt")


def _last(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last write of each key, in the order of chunks and of places in their answers."""
    return latest(rows, key, [F.col(c) for c in ("chunk_id", *order, "place")])


def entity_nodes(found: DataFrame, on_dates: DataFrame) -> DataFrame:
    """(id, name, type, aliases, source_doc_id); an answer's dates are written after its entities."""
    own = found.select("id", "name", "type", "aliases", F.col("doc_id").alias("source_doc_id"), "chunk_id", F.lit(0).alias("turn"), "place")
    dated = on_dates.select("id", F.col("value").alias("name"), F.lit("Date").alias("type"), F.array().cast("array<string>").alias("aliases"), F.col("doc_id").alias("source_doc_id"), "chunk_id", F.lit(1).alias("turn"), "place")
    return _last(own.unionByName(dated), ["id"], "turn").select("id", "name", "type", "aliases", "source_doc_id")


def mentions(found: DataFrame) -> DataFrame:
    return latest(found.select("chunk_id", F.col("id").alias("entity_id"), "evidence_excerpt", "place"), ["chunk_id", "entity_id"], [F.col("place")]).drop("place")


def date_mentions(on_dates: DataFrame) -> DataFrame:
    return latest(on_dates.select("chunk_id", F.col("id").alias("entity_id"), "label", "certainty", "place"), ["chunk_id", "entity_id"], [F.col("place")]).drop("place")


def related(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, evidence_excerpt) of relations whose ends are both among the nodes, in whatever order they come."""
    ids = nodes.select("id")
    kept = found.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return _last(kept.select("source_id", "target_id", "relation_type", "evidence_excerpt", "chunk_id", "place"), ["source_id", "target_id", "relation_type"]).select("source_id", "target_id", "relation_type", "evidence_excerpt")


def marked_done(chunks: DataFrame, answers: DataFrame, model: str, at: Column) -> DataFrame:
    """``chunks`` with significance, extract_model and extracted_at set where there is an answer; others keep what they have."""
    done = answers.groupBy("chunk_id").agg(F.max(json_text(F.col("v"), "$.significance")).alias("said"))
    rows = chunks.join(done, "chunk_id", "left")
    old = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    new = {"significance": F.col("said"), "extract_model": F.lit(model), "extracted_at": at}
    return rows.withColumns({c: F.when(F.col("said").isNotNull(), clean_ws(x) if c == "significance" else x).otherwise(old(c)) for c, x in new.items()}).drop("said")
