"""Extraction as a loop that survives failures: model, parsing, tables; each chunk's answer counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from quire.operators import extraction, hooks
from quire.streaming import backlog


def step(model: Callable[[str], str], prompt: Column, good: Callable[[str], bool], at_once: int = 1) -> backlog.Step:
    """A step of a backlog over (chunk_id, doc_id, text, ...): the chunks for which the model gave an object, with its answer."""

    def run(rows: DataFrame) -> DataFrame:
        said = hooks.generate(rows, model, prompt, good, at_once=at_once).where("status = 'ok'").select("chunk_id", "response")
        return rows.select("chunk_id", "doc_id").join(said, "chunk_id")

    return run


def tables(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The graph's tables from all committed answers; None before the first batch."""
    said = backlog.results(spark, path)
    if said is None:
        return None
    answers = extraction.parsed(said)
    found, on_dates = extraction.entities(answers), extraction.dates(answers)
    nodes = extraction.entity_nodes(found, on_dates)
    return {"answers": answers, "entities": nodes, "mentions": extraction.mentions(found), "dates": extraction.date_mentions(on_dates), "relations": extraction.related(extraction.relations(answers), nodes)}
