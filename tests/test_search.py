"""Ranked retrieval at its joins: the same rows as plain forms, and the plans and row counts that were meant."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import context as K
from quire.operators import grid, lists
from quire.operators import search as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def corpus(spark):
    """Chunks of which a few words are in nearly all and most in few, and questions with both kinds."""
    rng = random.Random(8)
    common, rare = ["alpha", "beta", "gamma"], [f"r{i}x" for i in range(200)]
    texts = [" ".join(rng.choices(common, k=rng.randrange(1, 30)) + rng.sample(rare, 3)) for _ in range(1500)]
    chunks = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "")], "chunk_id int, text string").repartition(5)
    questions = [(q, [*rng.sample(rare, 3), *common[: q % 4]]) for q in range(40)] + [(90, ["alpha"]), (91, ["nowhere"]), (92, ["alpha", "beta-gamma"])]
    return chunks, spark.createDataFrame(questions, "q_id int, words array<string>")


def test_pruned_bm25_equals_all_scores(corpus):
    chunks, questions = corpus
    for n in (3, 20):
        plain = S.by_score(S.text_scores(chunks, questions), n)
        assert rows_of(S.bm25(chunks, questions, n)) == rows_of(plain)


def test_bm25_shuffles_no_pairs(corpus):
    """Each chunk is scored where it stands: nothing is dealt out before the best scores of the tasks."""
    chunks, questions = corpus
    text = plan(S.bm25(chunks, questions, 3))
    assert "MapInArrow" in text and "Join" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 20, 10), (7, 5, 200_000), (43 * 64, 1 << 20, 200_000)])
def test_bm25_in_blocks_and_by_joins_equals_all_scores(corpus, monkeypatch, limits):
    """Small blocks; and with more questions than are sent to tasks, or repeated ids, the joins."""
    for name, value in zip(("CELLS", "PARTS", "MOST_PAIRS"), limits, strict=True):
        monkeypatch.setattr(lists, name, value)
    chunks, questions = corpus
    for some in (chunks, chunks.unionByName(chunks.where("chunk_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" alpha r1x")))), chunks.limit(0)):
        assert rows_of(S.bm25(some, questions, 4)) == rows_of(S.by_score(S.text_scores(some, questions), 4))
    assert S.bm25(chunks, questions.limit(0), 4).count() == 0


def test_pruning_joins_fewer_rows(corpus):
    chunks, questions = corpus
    terms = S.terms_of(questions)
    found = S.impacts(chunks, terms)
    one, two = S.pruned_parts(found, terms, 3)
    every = found.join(terms, "term").count()
    joined = found.join(S.graded(found, terms, 3).where("essential"), "term").count() + two.count()
    assert joined < 0.5 * every and one.count() <= joined


def test_hits_are_counted_once_a_pair(spark, corpus):
    chunks, questions = corpus
    pool = S.by_score(S.text_scores(chunks, questions), 10).drop("rank")
    hits = S.with_hits(pool, chunks, questions)
    text = plan(hits)
    assert "Generate" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # The text is made ready below the join with the questions' words.
    assert text.index("filter(") < text.index("regexp_replace")
    words = dict(questions.collect())
    texts = dict(chunks.collect())
    got = {(r.q_id, r.chunk_id): r.hits for r in hits.collect()}
    assert len(got) == pool.count()
    assert all(n == sum(w in texts[c].split() for w in words[q] if "-" not in w) for (q, c), n in got.items() if q != 92)
    again = pool.join(hits.drop("score"), ["q_id", "chunk_id"])
    assert again.count() == pool.count()


def test_ranking_reads_the_scores_once(spark, corpus):
    chunks, questions = corpus
    asked = questions.select("q_id", F.array_join("words", " ").alias("question"))
    ranked = S.keyword_rank(chunks, asked)
    # What is left of the plan is a join of a written pool with the chunks.
    assert "part" not in plan(ranked).replace("partition", "") and ranked.count() > 0


@pytest.mark.parametrize("lanes", [None, 1, 5])
def test_grid_equals_all_products(spark, monkeypatch, lanes):
    rng = random.Random(4)
    vector = lambda d: [rng.choice((0.0, 0.5, 1.0)) + 0.1 for _ in range(d)]
    chunks = spark.createDataFrame([(f"c{k}", vector(3)) for k in range(400)] + [("other", [1.0, 2.0]), ("none", None), ("empty", [])], "chunk_id string, embedding array<float>").repartition(7)
    queries = spark.createDataFrame([(k, vector(3)) for k in range(60)] + [(900, None)], "q_id int, embedding array<float>").repartition(3)
    found = grid.best(queries, chunks, 7, lanes)
    got = S.by_score(found.select("q_id", "chunk_id", F.round("score", 6).alias("score")), 7)
    assert rows_of(got) == rows_of(S.cosines(chunks.where("size(embedding) = 3"), queries, 7))
    text = plan(grid.best(queries, chunks, 7, lanes))
    assert "Cartesian" not in text and "NestedLoop" not in text and text.count("Scan ExistingRDD") == 1


def test_grid_of_many_questions_is_one_join(spark):
    queries = spark.range(100_000).select(F.col("id").alias("q_id"), F.array(*(F.rand(k).cast("float") for k in range(4))).alias("embedding"))
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(*(F.rand(k + 9).cast("float") for k in range(4))).alias("embedding"))
    found = S.vector_top(chunks, queries, 2)
    assert plan(found).count("MapInArrow") == 2 and found.count() == 200_000


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("abcü ") for _ in range(rng.randrange(0, 9)))
    rows = [(k, part().title() if k % 9 else None, [part() for _ in range(k % 3)] if k % 5 else None) for k in range(300)]
    return spark.createDataFrame(rows, "entity_id int, name string, aliases array<string>"), spark.createDataFrame([(w,) for w in {*(part() for _ in range(150)), "ab", "b", "nowhere", "abcü"}], "word string")


def test_words_within_names_equal_nested_form(names):
    entities, words = names
    nested = entities.join(F.broadcast(words.where("word <> ''")), F.expr("contains(lower(name), word) or exists(aliases, a -> contains(lower(a), word))")).select("entity_id", "word")
    found = S.words_within(entities, words)
    assert rows_of(found) == rows_of(nested) and found.count() > 200
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert S.words_within(entities.limit(0), words).count() == S.words_within(entities, words.limit(0)).count() == 0


@pytest.fixture(scope="module")
def places(spark):
    rng = random.Random(6)
    rows = [(k, "long" if k < 900 else rng.choice(["a", "b", None]), rng.randrange(-50, 1200) if k % 11 else None) for k in range(1100)]
    return spark.createDataFrame(rows, "chunk_id int, section_id string, chunk_index int").withColumn("start_char", F.col("chunk_index") * 700)


@pytest.mark.parametrize("by", ["chunk_index", "start_char"])
def test_bands_give_the_neighbours(places, by):
    reach = 2 if by == "chunk_index" else 4000
    pairs = places.alias("x").join(places.alias("y"), F.expr(f"x.section_id = y.section_id AND y.{by} BETWEEN x.{by} - {reach} AND x.{by} + {reach}")).selectExpr("x.chunk_id AS a", "y.chunk_id AS b")
    want = pairs.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("s"))
    want = want.unionByName(places.join(want, places["chunk_id"] == want["a"], "left_anti").select(F.col("chunk_id").alias("a"), F.array("chunk_id").alias("s")))
    for band in (1, 3, K.BAND):
        assert rows_of(K.siblings(places, by=by, band=band)) == rows_of(want)
    hits = places.where("chunk_id % 7 = 0").select((F.col("chunk_id") % 3).alias("q_id"), "chunk_id", (F.col("chunk_id") % 50).alias("rank"))
    near = hits.join(want, hits["chunk_id"] == want["a"]).select("q_id", F.explode("s").alias("chunk_id"), "rank").groupBy("q_id", "chunk_id").agg(F.min("rank").alias("seed_rank"))
    assert rows_of(K.expand(hits, places, by=by)) == rows_of(near)


def test_a_long_section_runs_in_many_tasks(spark):
    chunks = spark.range(100_000).select(F.col("id").alias("chunk_id"), F.lit("one").alias("section_id"), F.col("id").cast("int").alias("chunk_index"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = K.siblings(chunks, band=500)
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(per_task) >= 3 and sum(per_task) == 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
