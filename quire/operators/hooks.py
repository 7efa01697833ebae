"""Models that the caller brings: embedding and generation of texts, batch by batch within Spark tasks.

Each partition calls by itself; write what comes back before it is used twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import json_object

TRIES = 3


def embed(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """(chunk_id, vector) for chunks (chunk_id, text); a batch that gives another number of vectors is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = model(part["text"].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vector": list(vectors)})

    rows = chunks.select("chunk_id", "text")
    return rows.mapInPandas(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, vector array<float>")


def generate(chunks: DataFrame, model: Callable[[str], str], prompt: F.Column, good: Callable[[str], bool], tries: int = TRIES, at_once: int = 1) -> DataFrame:
    """(chunk_id, response, attempts, status) for chunks (chunk_id, text).

    A task has at most ``at_once`` chunks with the model at a time; a model that is called by threads must allow it.

    An answer that is not ``good`` is asked for again, ``tries`` times in all, then it is `bad_json`; an
    exception ends a chunk's attempts as `llm_fail`; a blank text is `ok` with an empty object."""

    def one(text: str, asked: str) -> tuple[str | None, int, str]:
        if not (text or "").strip():
            return "{}", 0, "ok"
        answer = None
        for k in range(1, tries + 1):
            try:
                answer = model(asked)
            except Exception:  # the model is the caller's: whatever it raises, the chunk stays pending
                return None, k, "llm_fail"
            if good(answer):
                return answer, k, "ok"
        return answer, tries, "bad_json"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as threads:
            for frame in frames:
                found = list(threads.map(one, frame["text"], frame["prompt"]))
                yield pd.DataFrame({"chunk_id": frame["chunk_id"].to_numpy(), "response": [x[0] for x in found], "attempts": [x[1] for x in found], "status": [x[2] for x in found]})

    rows = chunks.select("chunk_id", "text", prompt.alias("prompt"))
    out = rows.mapInPandas(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, response string, attempts int, status string")
    # What Spark can't parse stays pending too, whatever the caller's test says.
    bad = (F.col("status") == "ok") & json_object(F.col("response")).isNull()
    return out.withColumn("status", F.when(bad, "bad_json").otherwise(F.col("status")))
