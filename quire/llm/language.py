"""Language identification: words first, then ever shorter character n-grams.

A word that the model knows adds the logarithm of its relative frequency in each language.  A word that
it doesn't know is cut into n-grams of its letters between boundary marks; the longest n of which any
n-gram is known decides, with the mean of the logarithms of those known.  A text's posterior over the
languages comes from the sums over its words.

The model is fitted on a sample of labelled documents, at most MAX_TRAINING of them, those of least hash of
id and text; Spark counts words and n-grams.  Of each language by itself the model holds the most frequent
words and n-grams, at most MAX_KEYS of either, each with its count in every language, and relates them to
all that was counted.  Prediction covers every text, whole.

Edge cases: a null text, or one without a letter, is `und` with score 0; equal scores go to the language
that sorts first; without any training row every text is `und`; repeated rows are predicted one by one;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.wordhash import blocks
from quire.llm.wordmemo import WordMemo, kept

#: Bounds of the training sample, and of the model for each language.
MAX_TRAINING, MAX_KEYS = 8_000, 20_000
LONGEST = 4
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    """Languages, and for each known word and n-gram its place among the rows of log frequencies, which are one array."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    rows: np.ndarray


def _log_rows(rows: list, totals: dict[str, int], languages: list[str], smooth: float) -> tuple[list[str], np.ndarray]:
    """(key, language, count) to the keys and a row for each, of logarithms of shares in each language's total."""
    keys = sorted({r[0] for r in rows})
    at, lang = {k: i for i, k in enumerate(keys)}, {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(keys), len(languages)))
    for key, language, n in rows:
        counts[at[key], lang[language]] += n
    total = np.array([totals.get(x, 0) for x in languages])
    return keys, np.log((counts + smooth) / (total + smooth * max(len(keys), 1))).astype(np.float32)


def _kept_keys(counts: DataFrame, most: int) -> list:
    """(key, lang, n) of the keys that are among the most frequent of some language, with their counts in all."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    keys = counts.withColumn("place", place).where(F.col("place") <= most).select("key").distinct()
    return counts.join(keys, "key", "left_semi").select("key", "lang", "n").collect()


def sample_of(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct rows of (id, text, lang), the same at every run."""
    keyed = rows.withColumns({"k": F.coalesce(F.col("id").cast("string"), F.lit("")), "h": F.xxhash64("text")})
    least = keyed.select("k", "h").distinct().orderBy(F.xxhash64("k", "h"), "k", "h").limit(most)
    return keyed.join(F.broadcast(least), ["k", "h"]).groupBy("k", "h").agg(F.min("lang").alias("lang"), F.first("text").alias("text")).select("text", "lang")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_training: int = MAX_TRAINING, max_keys: int = MAX_KEYS) -> Model:
    """A model of the rows that have a text and a language; give only rows that may be learnt from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    words = sample_of(rows, max_training).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n")).persist()
    try:
        word_totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        marked = words.select("lang", "n", F.concat(F.lit("^"), "key", F.lit("$")).alias("w"))
        sizes = F.sequence(F.lit(1), F.lit(LONGEST))
        cut = F.flatten(F.transform(sizes, lambda k: F.when(F.length("w") >= k, F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.substring(F.col("w"), i, k))).otherwise(F.array().cast("array<string>"))))
        grams = marked.select("lang", "n", F.explode(cut).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n")).persist()
        try:
            size = F.length("key").alias("size")
            gram_totals = {(r["size"], r["lang"]): r["n"] for r in grams.groupBy(size, "lang").agg(F.sum("n").alias("n")).collect()}
            found_words, found_grams = _kept_keys(words, max_keys), _kept_keys(grams, max_keys)
        finally:
            grams.unpersist()
    finally:
        words.unpersist()
    languages = sorted(word_totals)
    by_size = [_log_rows([r for r in found_grams if len(r[0]) == k], {x: n for (size, x), n in gram_totals.items() if size == k}, languages, 0.5) for k in range(1, LONGEST + 1)]
    known = _log_rows(found_words, word_totals, languages, 0.1)
    places = {k: i for i, k in enumerate((k for keys, _ in by_size for k in keys), len(known[0]))}
    return Model(languages, {k: i for i, k in enumerate(known[0])}, places, np.concatenate([x for _, x in (known, *by_size)]))


class Scorer:
    """Sums of log frequencies for texts, through a memo of their blank-separated units."""

    def __init__(self, model: Model):
        self.model = model
        self.none = np.zeros(len(model.languages), np.float32)
        self.memo = WordMemo(self._units, gaps=False)

    def word(self, word: str) -> np.ndarray:
        at = self.model.words.get(word)
        if at is not None:
            return self.model.rows[at]
        marked, grams = f"^{word}$", self.model.grams
        for k in range(LONGEST, 0, -1):
            known = [g for i in range(len(marked) - k + 1) if (g := grams.get(marked[i : i + k])) is not None]
            if known:
                rows = [self.model.rows[g] for g in known]
                return sum(rows[1:], rows[0]) / len(rows)
        return self.none

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.model.languages) + 1
        out = np.zeros((len(units), width), np.float32)
        for i, unit in enumerate(units):
            for word in _WORD.findall(unit.decode().lower()):
                out[i, :-1] += self.word(word)
                out[i, -1] += any(map(str.isalpha, word))
        return out.reshape(-1).view(np.uint32), np.full(len(units), width, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text, and its posterior probability."""
        width = len(self.model.languages) + 1
        looked = self.memo.look_up(texts)
        rows = looked.values.view(np.float32)[looked.start[:, None] + np.arange(width)].astype(np.float64) if len(looked.start) else np.zeros((0, width))
        sums = np.diff(np.concatenate([np.zeros((1, width)), np.cumsum(rows, axis=0)])[looked.first], axis=0)
        if width == 1:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        total = sums[:, :-1]
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        lettered = sums[:, -1] > 0.5
        return [self.model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0)


def _scorer(shared: Broadcast) -> Scorer:
    """The scorer of a broadcast model, which it holds, so that its id stays its own."""
    model = shared.value
    return kept(("language", id(model)), lambda: Scorer(model))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in blocks(batch):
                lang, score = scorer(pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is in some language, with a missing ``lang_col`` filled in; columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            for part in blocks(batch, text_col):
                found, _ = scorer(pc.fill_null(part.column(text_col), ""))
                found = pa.array(found, pa.string())
                at = part.schema.get_field_index(lang_col)
                yield part.set_column(at, lang_col, pc.coalesce(part.column(at), found)).filter(pc.not_equal(found, UNKNOWN))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.where(~is_held_out()))).select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "lang_pred", "score")
