"""What tasks hold: batches and row groups of bounded size, models as arrays, memos no longer than needed, and large tasks that pass rows on in parts."""

import gc
import random
import weakref

import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds

import corpus_pipeline
from quire.llm import language, ngram_join, substrings, token_files, wordmemo
from quire.llm.common import new_dir
from quire.llm.library_tokens import byte_level

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_stages_give_workers_small_batches(spark):
    def batch_bytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    had = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    try:
        docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "concat(id, repeat(' word', 4000)) AS text", "'en' AS lang", "'a' AS source", "20000L AS n_chars")
        found = corpus_pipeline.identify(spark, docs, "").mapInArrow(batch_bytes, "n long")
        sizes = [r.n for r in found.collect()]
        assert sum(sizes) > 16 << 20 and max(sizes) < 6 << 20
        spark.conf.set(BATCH, 1 << 20)
        corpus_pipeline.identify(spark, docs, "")
        assert spark.conf.get(BATCH) == str(1 << 20)
    finally:
        spark.conf.unset(BATCH) if had is None else spark.conf.set(BATCH, had)


def test_model_is_one_array(spark):
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnop", k=9)) for _ in range(12000)]
    rows = [(k, " ".join(words[k * 100 : k * 100 + 100]), ("de", "en")[k % 2]) for k in range(120)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = len(model.words) + len(model.grams)
    assert n > 12000 and model.rows.shape == (n, 2) and model.rows.dtype == "float32"
    assert sorted([*model.words.values(), *model.grams.values()]) == list(range(n))


def test_many_runs_of_a_task(spark):
    text = " ".join(f"w{k}" for k in range(4000))
    docs = [(k, text if k % 2 else f"{text} end{k}") for k in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(rows).collect()}
    assert got == substrings.brute_force(docs)


def test_row_groups_of_few_shards(spark, monkeypatch):
    """However many shards a part has, and however well they compress."""
    monkeypatch.setattr(token_files, "GROUP_BYTES", 4000, raising=False)
    monkeypatch.setattr(token_files, "drop_dir", lambda *a: None)
    docs = spark.createDataFrame([(k, f"one and the same text of number {k % 3} " * 20) for k in range(600)], "doc_id long, text string")
    at = new_dir(spark, "files")
    token_files.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), at, shard_bytes=1000)

    def groups(what):
        return [[g.num_rows for g in f.row_groups] for f in ds.dataset(f"{at}/{what}", format="parquet").get_fragments()]

    assert all(max(g) <= 4 for g in groups("shards")) and sum(map(sum, groups("shards"))) > 40
    assert all(max(g) < 100 for g in groups("draft"))
    assert token_files.read_shards(spark, at).where("n_tokens > 0").count() == 600


def test_forgotten_memos_are_freed():
    """At once, though a memo and its function refer to each other, and not when the collector next comes round."""
    gc.disable()
    try:
        for leave in (wordmemo.forget, lambda: wordmemo.kept("another", list)):
            wordmemo.forget()
            held = weakref.ref(byte_level(public_tokenizers.path("byte_bpe_50k.json")))
            assert held() is not None
            leave()
            assert held() is None
    finally:
        gc.enable()


def test_components_take_few_queries(spark, monkeypatch):
    """The driver holds a plan and threads for each: two where a task holds all edges, however long their chains are, and the same result where none does."""
    draw = random.Random(8)
    chain = draw.sample(range(-500, 500), 400)
    pairs = [*zip(chain, chain[1:], strict=False), *((draw.randrange(1000, 1400), draw.randrange(1000, 1400)) for _ in range(250)), (7000, 7000)]
    root = {}

    def up(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((up(a), up(b)))
        root[high] = low
    want = {x: up(x) for x in root if up(x) != x}
    edges = spark.createDataFrame(pairs, "a long, b long")
    store = spark._jsparkSession.sharedState().statusStore()

    def found():
        done = store.executionsCount()
        rows = ngram_join.components(edges)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executionsCount() - done, {r.id: r.component for r in rows.distinct().collect()}

    assert found() == (2, want)
    monkeypatch.setattr(ngram_join, "HELD", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        queries, got = found()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and queries > 4
    assert ngram_join.components(edges.where("a = b")) is None
