"""Keyed tables in buckets, the loader, and statistics kept up by batches."""

import os

import pytest
from pyspark.sql import functions as F

from quire.operators import loading, search
from quire.operators import chunks as C
from quire.operators import graph as G
from quire.sources import commits, keyed


def folders(path):
    return {f"{w}/{b}" for w in os.listdir(path) for b in os.listdir(f"{path}/{w}") if b.startswith("bucket=")}


def test_upsert_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda low, high, v: spark.range(low, high).select(F.col("id").alias("k"), F.lit(v).alias("v"))
    assert keyed.current(spark, path, "t") is None
    keyed.upsert(rows(0, 2000, "old"), path, "t", ["k"], [F.lit(1)])
    before = folders(f"{path}/t")
    assert len(before) == keyed.BUCKETS
    keyed.upsert(rows(1995, 2005, "new"), path, "t", ["k"], [F.lit(1)], name="ten", buckets=7)
    assert 1 <= len(folders(f"{path}/t") - before) <= 10
    got = {r.k: r.v for r in keyed.current(spark, path, "t").collect()}
    assert got == {k: "new" if k >= 1995 else "old" for k in range(2005)}
    # Under its name it counts once.
    assert not keyed.upsert(rows(0, 5, "again"), path, "t", ["k"], [F.lit(1)], name="ten")
    assert keyed.current(spark, path, "t").where("v = 'again'").count() == 0


def test_upsert_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path, row = str(tmp_path), spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, at int")
    keyed.upsert(row, path, "t", ["k"], [F.col("at")])
    real = commits.commit
    monkeypatch.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    new = spark.createDataFrame([(1, "z", 9), (3, "n", 1)], "k int, v string, at int")
    with pytest.raises(RuntimeError):
        keyed.upsert(new, path, "t", ["k"], [F.col("at")], name="x")
    monkeypatch.setattr(commits, "commit", real)
    assert sorted((r.k, r.v) for r in keyed.current(spark, path, "t").collect()) == [(1, "b"), (2, "c")]
    assert keyed.upsert(new, path, "t", ["k"], [F.col("at")], name="x")
    assert sorted((r.k, r.v) for r in keyed.current(spark, path, "t").collect()) == [(1, "z"), (2, "c"), (3, "n")]
    assert keyed.upsert(new.limit(0), path, "t", ["k"], [F.col("at")]) and keyed.current(spark, path, "t").count() == 3


def test_load_in_order(spark, tmp_path):
    path = str(tmp_path)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    batch = lambda docs, sections, chunks, links: {"docs": table(docs, "doc_id string, title string"), "sections": table(sections, "section_id string, doc_id string"), "chunks": table(chunks, "chunk_id string, text string"), "links": table(links, "section_id string, chunk_id string")}
    rows = lambda t: sorted(map(tuple, keyed.current(spark, path, t).select(*sorted(keyed.current(spark, path, t).columns)).collect()))
    one = batch([("d", "old")], [("s1", "d"), ("s2", "none"), (None, "d")], [("c1", "x"), ("c2", "y")], [("s1", "c1"), ("s1", "c1"), ("s2", "c2"), ("s1", "gone")])
    assert loading.load(spark, path, "one", one, [F.lit(1)], 4)
    assert rows("sections") == [("d", "s1")] and rows("links") == [("c1", "s1")] and len(rows("chunks")) == 2
    two = batch([("none", "late"), ("d", "new")], [("s2", "none")], [], [("s2", "c2"), ("s1", "c2")])
    assert loading.load(spark, path, "two", two, [F.lit(1)], 4) and not loading.load(spark, path, "two", one, [F.lit(1)], 4)
    assert rows("docs") == [("d", "new"), ("none", "late")] and rows("links") == [("c1", "s1"), ("c2", "s1"), ("c2", "s2")]


def recount(rows):
    split = rows.select(search.tokens(F.col("text")).alias("t"))
    terms = split.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").count()
    return {r["term"]: (r["count"], 0) for r in terms.collect()} | {"": tuple(split.agg(F.count("*"), F.sum(F.size("t"))).first())}


def test_statistics_of_batches_equal_a_recount(spark, tmp_path):
    path, schema = str(tmp_path), "chunk_id int, text string, at int"
    assert loading.statistics(spark, path) is None
    batches = [[(k, f"w{k % 7} w{k % 3} same, Same", 1) for k in range(60)], [(k, f"other w{k % 7}", 2) for k in range(0, 60, 2)] + [(70, None, 2), (None, "x", 2)], [(k, "", 3) for k in range(0, 20, 4)] + [(71, "only here", 3), (71, "only later", 4)], []]
    now = {}
    for name, rows in enumerate(batches):
        chunks = spark.createDataFrame(rows, schema)
        for _ in range(2):
            loading.count_in(chunks, path, str(name), [F.col("at")], 4)
        now |= {k: (k, t, a) for k, t, a in rows if k is not None}
        want = recount(spark.createDataFrame(list(now.values()), schema))
        assert {r.term: (r.df, r.total) for r in loading.statistics(spark, path).collect()} == want


def test_statistics_touch_few_buckets(spark, tmp_path):
    path = str(tmp_path)
    loading.count_in(spark.range(500).select(F.col("id").alias("chunk_id"), F.concat(F.lit("w"), "id").alias("text")), path, "all", [F.lit(1)])
    before = folders(f"{path}/texts") | folders(f"{path}/terms")
    loading.count_in(spark.createDataFrame([(3, "w3 one")], "chunk_id long, text string"), path, "one", [F.lit(1)])
    new = (folders(f"{path}/texts") | folders(f"{path}/terms")) - before
    assert len(new) <= 3


def test_ingest_counts_in_one_job(spark):
    docs = spark.createDataFrame([("a", [("t", "x " * 3000), ("u", " ")]), ("b", [("v", "y"), ("v", "y")]), ("c", []), ("d", None)], "doc_id string, sections array<struct<title:string,text:string>>")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counts", "counts")
    got = {r.what: r.n for r in G.ingest_counts(docs).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    parts = C.chunk(C.sections(docs))
    assert got == {"docs": 4, "sections": 3, "chunks": parts.count(), "links": C.links(parts).count()}
    # The counting job, with its shuffle, and the one that shows four rows.
    assert len(tracker.getJobIdsForGroup("counts")) <= 3


def test_tokens_move_as_one_text_a_chunk(spark, tmp_path):
    path = str(tmp_path)
    chunks = spark.createDataFrame([(1, "One two, one"), (2, None), (3, "--"), (4, "two")], "chunk_id long, text string")
    loading.count_in(chunks, path, "all", [F.length("text")], 2)
    assert dict(keyed.current(spark, path, loading.TEXTS).select("chunk_id", "t").collect()) == {1: " one two", 2: "", 3: "", 4: " two"}
    assert {tuple(r) for r in loading.statistics(spark, path).collect()} == {("", 4, 4), ("one", 1, 0), ("two", 2, 0)}


def test_a_large_bucket_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        keyed.upsert(spark.range(0, 100_000, 1, 8).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), str(tmp_path), "rows", ["id"], [F.lit(1)], buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(tmp_path.glob("rows/*/bucket=0/*.parquet"))) > 1
    assert keyed.current(spark, str(tmp_path), "rows").distinct().count() == 100_000


def test_graph_load_cuts_the_texts_once(spark, monkeypatch):
    seen, load = [], loading.load

    def watched(spark, path, name, batch, *rest):
        seen.extend(batch.values())
        return load(spark, path, name, batch, *rest)

    monkeypatch.setattr(loading, "load", watched)
    from quire.plans import queries

    queries.graph_load(spark, "/root/testdata/sf0.001")
    assert len(seen) == 8 and not any("posexplode" in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
