"""Streams and committed writes: failures at each place, replays, restarts, and what is left behind."""

import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quire.sources import commits
from quire.streaming import backlog, extract, incremental

ROWS = "chunk_id string, doc_id string, text string"


def pending(spark, at):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(at)


def step(rows):
    return rows.where("text <> 'fail'").select("chunk_id", F.upper("text").alias("said"))


def said(spark, path):
    return sorted((r.chunk_id, r.said) for r in backlog.results(spark, path).collect())


class Dies:
    def __init__(self, times):
        self.left = times

    def __call__(self):
        if self.left:
            self.left -= 1
            raise RuntimeError("killed")


@pytest.fixture
def at(spark, tmp_path):
    spark.createDataFrame([("a", "d", "x"), ("b", "d", "fail"), ("c", "d", "z"), ("c", "d", "z"), (None, "d", "y")], ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    return lambda name: str(tmp_path / name)


def test_batch_that_dies_before_its_commit(spark, at):
    with pytest.raises(StreamingQueryException):
        backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), step, before_commit=Dies(1)).awaitTermination()
    # What it has written doesn't count, and nothing is taken for done.
    assert said(spark, at("out")) == [] and backlog.done(spark, at("out"), "chunk_id", spark.createDataFrame([], ROWS)).count() == 0
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), step).awaitTermination()
    assert said(spark, at("out")) == [("a", "X"), ("c", "Z")]
    assert len(os.listdir(at("out/results"))) == 2
    assert backlog.clean(spark, at("out")) == 2 and said(spark, at("out")) == [("a", "X"), ("c", "Z")]


def test_batch_that_dies_after_its_commit(spark, at):
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), step).awaitTermination()
    # Spark has not noted the batch: it comes again under its number.
    os.remove(at("ck/commits/0"))
    os.path.exists(at("ck/commits/.0.crc")) and os.remove(at("ck/commits/.0.crc"))
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), lambda rows: rows.select("chunk_id", F.lit("again").alias("said")).where("false")).awaitTermination()
    assert said(spark, at("out")) == [("a", "X"), ("c", "Z")]


def test_failed_rows_come_with_the_next_run(spark, at):
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), step).awaitTermination()
    assert [tuple(r) for r in backlog.failed(spark, at("out"), "chunk_id").select("chunk_id", "doc_id", "text").collect()] == [("b", "d", "fail")]
    # A stream with another checkpoint has batches of its own.
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck2"), step).awaitTermination()
    assert said(spark, at("out")) == [("a", "X"), ("c", "Z")]
    # A step that fails anew leaves the row pending, whatever the stream brings.
    spark.createDataFrame([("e", "d", "new"), ("a", "d", "twice")], ROWS).coalesce(1).write.mode("append").parquet(at("in"))
    backlog.backlog_stream(pending(spark, at("in")), at("out"), at("ck"), step).awaitTermination()
    assert said(spark, at("out")) == [("a", "X"), ("c", "Z"), ("e", "NEW")]
    assert backlog.retry(spark, at("out"), lambda rows: rows.select("chunk_id", F.lit("late").alias("said")))
    assert said(spark, at("out")) == [("a", "X"), ("b", "late"), ("c", "Z"), ("e", "NEW")]
    assert not backlog.retry(spark, at("out"), step) and backlog.failed(spark, at("out"), "chunk_id").count() == 0


def test_nothing_pending(spark, at):
    rows = spark.createDataFrame([], ROWS)
    assert backlog.results(spark, at("out")) is None and backlog.failed(spark, at("out"), "chunk_id") is None
    assert backlog.write_batch(rows, at("out"), "one", step) and not backlog.write_batch(rows, at("out"), "one", step)
    assert said(spark, at("out")) == [] and not backlog.retry(spark, at("out"), step)


def test_commits_are_numbered(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        commits.commit(spark, path, f"n{k}", [("x", commits.write(spark.range(k, k + 1), path, "x"), None)])
    commits.write(spark.range(9), path, "x")
    assert sorted((r.number, r.id) for r in commits.committed(spark, path, "x").collect()) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(r.name for r in commits.commits(spark, path).collect()) == ["n0", "n1", "n2"]


def test_url_in_three_batches_across_a_restart(spark, at):
    known = lambda: spark.createDataFrame([("v",)], "url string")
    stream = lambda: spark.readStream.schema("url string, state string").option("maxFilesPerTrigger", 1).parquet(at("urls"))
    found = lambda: sorted((r.url, r.status) for r in backlog.results(spark, at("new")).collect())
    add = lambda rows: spark.createDataFrame(rows, "url string, state string").coalesce(1).write.mode("append").parquet(at("urls"))
    add([("u", None), ("u", "s"), ("v", None), (" ", None), (None, None)])
    add([("u", None), ("w", None)])
    incremental.new_urls(stream(), at("new"), at("ck"), known).awaitTermination()
    assert found() == [("u", "pending"), ("w", "pending")]
    add([("u", "s"), ("x", None), ("w", None)])
    query = incremental.new_urls(stream(), at("new"), at("ck"), known)
    query.awaitTermination()
    assert found() == [("u", "pending"), ("w", "pending"), ("x", "pending")]
    # Of the last batch only the new url got past the state.
    assert sum(p["stateOperators"][0]["customMetrics"]["numDroppedDuplicateRows"] for p in query.recentProgress) == 2, [p["stateOperators"] for p in query.recentProgress]
    # A replayed batch changes nothing and keeps its state.
    last = max(int(x) for x in os.listdir(at("ck/commits")) if x.isdigit())
    for x in os.listdir(at("ck/commits")):
        if x.strip(".").split(".")[0] in (str(last), str(last - 1)):
            os.remove(at(f"ck/commits/{x}"))
    incremental.new_urls(stream(), at("new"), at("ck"), known).awaitTermination()
    assert found() == [("u", "pending"), ("w", "pending"), ("x", "pending")]
    # Without its state, as after the time to live, the stream falls back on what is committed.
    shutil.rmtree(at("ck"))
    incremental.new_urls(stream(), at("new"), at("ck"), known).awaitTermination()
    assert found() == [("u", "pending"), ("w", "pending"), ("x", "pending")]


def test_stream_of_a_file_and_of_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/folder.parquet")
    part = next(x for x in os.listdir(f"{tmp_path}/folder.parquet") if x.startswith("part"))
    shutil.copy(f"{tmp_path}/folder.parquet/{part}", f"{tmp_path}/file.parquet")
    for name in ("folder", "file"):
        stream = incremental.stream_of(spark, f"{tmp_path}/{name}.parquet", rows.schema)
        incremental.batch_stream(stream, f"{tmp_path}/out-{name}", f"{tmp_path}/ck-{name}").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out-{name}").count() == 2


def test_extraction_loop(spark, at):
    rows = spark.createDataFrame([(k, "d", t) for k, t in enumerate(["Ann", "fails", "prose", " ", None, "Bob"])], "chunk_id int, doc_id string, text string")
    lost = {"fails"}

    def model(prompt):
        if prompt in lost:
            raise OSError("gone")
        return "no object" if prompt == "prose" else f'{{"entities": [{{"name": "{prompt}", "type": "people"}}]}}'

    step = extract.step(model, F.col("text"), lambda answer: answer.startswith("{"), at_once=3)
    assert extract.tables(spark, at("said")) is None and backlog.write_batch(rows, at("said"), "one", step)
    names = lambda: sorted((r.name, r.type) for r in extract.tables(spark, at("said"))["entities"].collect())
    assert names() == [("Ann", "Person"), ("Bob", "Person")]
    # Blank texts are done with an empty object; prose and exceptions stay pending.
    assert sorted(r.chunk_id for r in backlog.failed(spark, at("said"), "chunk_id").collect()) == [1, 2]
    backlog.retry(spark, at("said"), extract.step(lambda p: '{"entities": [{"name": "Cy"}]}', F.col("text"), lambda answer: True))
    assert names() == [("Ann", "Person"), ("Bob", "Person"), ("Cy", "Concept")]
    assert extract.tables(spark, at("said"))["mentions"].count() == 4
