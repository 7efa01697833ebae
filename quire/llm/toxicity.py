"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on windows of ordinary and of toxic text; how many bytes a window
is shorter with the toxic one than with the ordinary one is its distance.  Both end with the same stretch
of ordinary text, so that only what sets the two kinds apart makes a difference: a toxic document is, for
the most part, as ordinary as any other.  For the same reason the trained parts come from chosen windows:
in each of ROUNDS rounds, those KEEP windows of every labelled document, toxic and ordinary, that look the
most toxic so far, judged with dictionaries of the other half of the sample (a window would shorten too well
with its own text).  So the ordinary dictionary learns what has been mistaken for toxic before.

A document's largest distances, how many of its windows reach each of THRESHOLDS, and their means go into a
logistic calibration, on the sample's halves measured crosswise; 0.5 of it is the calibrated threshold.

Dictionaries and calibration are fitted on at most MAX_EACH labelled documents of either class, those of
least hash of the id, and on at most MAX_WINDOWS windows of them a dictionary, those of least hash; scoring
covers every text, whole, by windows of about WINDOW bytes.

Edge cases: a null or empty text has one empty window and gets the calibrated score of that; without
labelled documents of both classes every score is the share of toxic ones, or 0; documents with several
labels count as toxic if one says so; repeated rows are scored one by one, and of labelled documents that
share an id all texts are learnt from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.wordhash import blocks
from quire.llm.wordmemo import forget

MAX_EACH, MAX_WINDOWS = 4_000, 60_000
WINDOW, OVERLAP = 32, 1
#: Bytes of the shared ordinary text, and of each trained part, whose segments and the runs they are chosen by are short.
BASE_BYTES, TRAINED_BYTES, SEGMENT, RUN = 1_000_000, 8 << 10, 8, 6
ROUNDS, KEEP = 3, 4
LEVEL = 5
#: Bytes saved from which on a window counts.
THRESHOLDS = (2, 3, 4)
#: Bytes of a text that are cut into windows at a time.
PIECE = 1 << 16


class Contents(NamedTuple):
    """What the two dictionaries hold: a trained part each, and the text that both end with."""

    ordinary: bytes
    toxic: bytes
    base: bytes


class Model(NamedTuple):
    contents: Contents
    weights: list[float]
    mean: list[float]
    scale: list[float]


def _words(text: str | None) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a piece at a time."""
    data = (text or "").lower().encode()
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + PIECE)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def windows(text: str | None) -> Iterator[list[bytes]]:
    """Runs of words of about WINDOW bytes that share OVERLAP words with the next, a piece of the text at a time."""
    run: list[bytes] = []
    size, none = 0, True
    for words in _words(text):
        out = []
        for word in words:
            run.append(word)
            size += len(word) + 1
            if size >= WINDOW:
                out.append(b" %b " % b" ".join(run))
                run = run[-OVERLAP:] if len(run) > OVERLAP else []
                size = sum(map(len, run)) + len(run)
        if out:
            none = False
            yield out
    if run or none:
        yield [b" %b " % b" ".join(run)]


class Distance:
    """Bytes that the toxic dictionary saves in a window's compressed length, beyond the ordinary one."""

    def __init__(self, contents: Contents):
        forget()
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)

        def of(trained: bytes):
            content = trained + contents.base
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=parameters).compress
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=parameters)
            return zstandard.ZstdCompressor(dict_data=d, compression_params=parameters).compress

        self.ordinary, self.toxic = of(contents.ordinary), of(contents.toxic)

    def __call__(self, part: list[bytes]) -> np.ndarray:
        ordinary, toxic = self.ordinary, self.toxic
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in part), np.int32, len(part))

    def features(self, text: str | None) -> list[float]:
        d = np.concatenate([self(part) for part in windows(text)])
        top = np.sort(d)[::-1][:3].tolist()
        hits = [int((d >= k).sum()) for k in THRESHOLDS]
        return [float(np.log1p(len(d))), *top, *[0] * (3 - len(top)), *np.log1p(hits).tolist(), hits[1] / len(d), float(np.clip(d, 0, None).mean()), float(d.mean())]

    def most_toxic(self, text: str | None, keep: int = KEEP) -> list[bytes]:
        """The distinct windows that save most, if they save anything."""
        best: dict[bytes, int] = {}
        for part in windows(text):
            best.update(zip(part, self(part).tolist(), strict=True))
            best = dict(sorted(((w, n) for w, n in best.items() if n > 0), key=lambda x: (-x[1], x[0]))[:keep])
        return list(best)


N_FEATURES = 7 + len(THRESHOLDS)


def trained(samples: list[bytes]) -> bytes:
    """The content of a dictionary trained on ``samples``, or their own text where there is too little."""
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples, k=SEGMENT, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[:TRAINED_BYTES]


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of a bounded sample, and how many labelled documents there are of each class."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1)").dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(texts.select("id"), "id", "left_semi").persist()
    try:
        totals = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
        least = [r for label in totals for r in marks.where(F.col("toxic") == label).orderBy(F.xxhash64("id"), "id").limit(MAX_EACH).collect()]
    finally:
        marks.unpersist()
    # At most 2 * MAX_EACH rows of an id and a number.
    chosen = docs.sparkSession.createDataFrame(least, marks.schema)
    return texts.join(F.broadcast(chosen), "id").select("text", "toxic"), totals


def _least(rows: DataFrame, most: int) -> list[bytes]:
    """Distinct windows, at most so many, those of least hash, in an order that only they decide."""
    return [bytes(r[0]) for r in rows.distinct().orderBy(F.xxhash64("w"), "w").limit(most).collect()]


def _every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text").to_pylist():
            for part in windows(text):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], ["w"])


def _chosen(rows: DataFrame, contents: Contents) -> DataFrame:
    """(w, toxic): the windows of each document that look the most toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(contents)
        for batch in batches:
            for part in blocks(batch):
                found = [distance.most_toxic(t) for t in part.column("text").to_pylist()]
                toxic = np.repeat(part.column("toxic").to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array([w for x in found for w in x], pa.binary()), pa.array(toxic, pa.int32())], ["w", "toxic"])

    return rows.mapInArrow(run, "w binary, toxic int")


def _measured(rows: DataFrame, contents: Contents) -> DataFrame:
    """(toxic, x): the features of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(contents)
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([distance.features(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))], ["toxic", "x"])

    return rows.mapInArrow(run, "toxic int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the labelled documents; give only rows that may be learnt from."""
    sample, totals = labelled_sample(docs, labels, id_col, text_col, label_col)
    n_toxic, n_ordinary = totals.get(1, 0), totals.get(0, 0)
    share = n_toxic / max(n_toxic + n_ordinary, 1)
    flat = Model(Contents(b"", b"", b""), [float(np.log((share + 1e-6) / (1 - share + 1e-6)))] + [0.0] * N_FEATURES, [0.0] * N_FEATURES, [1.0] * N_FEATURES)
    if not n_toxic or not n_ordinary:
        return flat
    sample = sample.persist()
    try:
        every = lambda rows: _least(rows.select("text").mapInArrow(_every, "w binary"), MAX_WINDOWS)
        halves = [sample.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k) for k in (0, 1)]
        found = [{label: every(half.where(F.col("toxic") == label)) for label in (0, 1)} for half in halves]
        base = b"".join(found[0][0] + found[1][0])[:BASE_BYTES]
        of = lambda w: Contents(trained(w[0]), trained(w[1]), base)
        for _ in range(ROUNDS):
            own = [of(w) for w in found]
            # The windows of one half by what the other has taught.
            best = [_chosen(half, other).persist() for half, other in zip(halves, own[::-1], strict=True)]
            found = [{label: _least(rows.where(F.col("toxic") == label).select("w"), MAX_WINDOWS) for label in (0, 1)} for rows in best]
            for rows in best:
                rows.unpersist()
        own = [of(w) for w in found]
        contents = of({label: found[0][label] + found[1][label] for label in (0, 1)})
        rows = _measured(halves[0], own[1]).union(_measured(halves[1], own[0])).toPandas()
    finally:
        sample.unpersist()
    x, y = np.array(rows["x"].tolist()).reshape(-1, N_FEATURES), rows["toxic"].to_numpy()
    if y.min(initial=1) == y.max(initial=0):
        return flat
    weight = np.where(y == 1, n_toxic / max((y == 1).sum(), 1), n_ordinary / max((y == 0).sum(), 1))
    return Model(contents, *_logistic(x, y, weight / weight.mean()))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float], list[float]]:
    """Weights (the constant first), means and scales of a ridge logistic regression."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w += np.linalg.solve(curve, a.T @ (weight * (y - p)) - 0.05 * w)
    return w.tolist(), mean.tolist(), scale.tolist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        distance = Distance(m.contents)
        w, mean, scale = np.array(m.weights), np.array(m.mean), np.array(m.scale)
        for batch in batches:
            for part in blocks(batch):
                x = np.array([distance.features(t) for t in part.column("text").to_pylist()]).reshape(-1, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(w[0] + (x - mean) / scale @ w[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p)], ["id", "score"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, score double")


def is_held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs.where(~is_held_out()), labels.where(~is_held_out()))
    return score(docs, model).select(F.col("id").alias("doc_id"), is_held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
