"""Registered queries of the document graph over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import catalog, extraction, hooks, loading, pages
from quire.operators import chunks as C
from quire.operators import context as K
from quire.operators import graph as G
from quire.operators import search as S
from quire.plans.oracles import ORACLES, RESPONSE
from quire.sources import keyed
from quire.sources.scratch import new_dir, stored, stored_small
from quire.streaming import backlog, extract, incremental

__all__ = ["ORACLES", "QUERIES", "answers"]

#: What stands before reference numbers in the questions made from the tables.
PREFIX = "Order"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def _asked(spark: SparkSession, d: str, whole: bool = False) -> DataFrame:
    return S.asked(_questions(spark, d), whole=whole)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunk vectors, and as questions those whose id is that of a benchmark item."""
    e = _t(spark, d, "embeddings")
    items = _t(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return e.select(F.col("vec_id").alias("chunk_id"), "embedding"), e.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("q_id"), "embedding")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose sections are their lines."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit("").alias("title"), x.alias("text")))
    return _t(spark, d, "documents").select("doc_id", lines.alias("sections"))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one section each."""
    return _t(spark, d, "documents").select("doc_id", F.array(F.struct(F.lit("").alias("title"), F.col("text").alias("text"))).alias("sections"))


def sections_flatten(spark: SparkSession, d: str) -> DataFrame:
    return C.sections(_lines(spark, d)).select("doc_id", "section_index", "section_id", X.token_count(F.col("text")).alias("token_count"))


SPANS = ("doc_id", "chunk_index", "start_char", "end_char", "chunk_id", "token_count")


def chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk(C.sections(_whole(spark, d))).select(*SPANS)


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: chunks, keyword ranking, neighbours, context for every benchmark question."""
    parts = stored(C.chunk(C.sections(_whole(spark, d))).select("chunk_id", "section_id", "section", "start_char", "text"), "chunks")
    hits = stored(S.keyword_rank(parts, _questions(spark, d)), "hits")
    near = S.top(K.expand(hits, parts), S.TOP, F.col("seed_rank"), F.col("chunk_id")).drop("seed_rank")
    return K.context(near, parts)


def titled_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Keyword ranking where title, number and section count as well as the text; titles are beginnings of benchmark items."""
    items = _t(spark, d, "benchmark").groupBy("item_id").agg(F.min("text").alias("item"))
    docs = _t(spark, d, "documents").withColumn("item_id", F.col("doc_id") % 50).join(items, "item_id", "left")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.substring("item", 1, 80).alias("doc_title"), F.concat(F.lit("6"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")).alias("ref_number"), F.col("lang").alias("section"), "text")
    return S.keyword_rank(chunks, _questions(spark, d)).select("q_id", "chunk_id", "score", "hit_count", "rank")


def title_rules(spark: SparkSession, d: str) -> DataFrame:
    """Section titles without their numbers, states without parentheses, beginnings of texts without an ellipsis."""
    marks = F.array(*(F.lit(m) for m in (". ", ")", " - ", ":", ".1 ", " ")))
    title = F.concat(F.lit(" "), (F.col("doc_id") % 12).cast("string"), F.get(marks, (F.col("doc_id") % 6).cast("int")), F.coalesce("source", F.lit("")))
    state = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" ( "), "lang", F.lit(") "))).when(F.col("doc_id") % 4 == 1, "()").when(F.col("doc_id") % 4 == 2, F.concat(F.lit("("), "lang")).otherwise(F.col("lang"))
    cut = F.concat(F.coalesce(F.col("source"), F.lit("")), F.when(F.col("doc_id") % 3 == 0, " ... ").when(F.col("doc_id") % 3 == 1, "\u2026").otherwise("."))
    return _t(spark, d, "documents").select("doc_id", X.clean_section_title(title).alias("title"), X.state_text(state).alias("state"), X.without_ellipsis(cut).alias("cut"))


def _catalog(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages of even number as the known catalogue, all of them as what was found."""
    rows = _t(spark, d, "pages")
    known = rows.where("page_id % 2 = 0").groupBy("url").agg(F.min(F.expr("CASE page_id % 6 WHEN 0 THEN ' Cancelled ' WHEN 2 THEN 'under review' ELSE '' END")).alias("state"))
    known = known.select(X.short_id(F.col("url")).alias("id"), "url", X.netloc(F.col("url")).alias("domain"), F.lit("2024-01-01T00:00:00Z").alias("discoveredat"), F.lit("parsed").alias("status"), "state")
    return known, rows.select("url", F.lit(None).cast("string").alias("state"))


def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    return catalog.merge(*_catalog(spark, d), F.lit("2024-02-01T00:00:00Z"))


def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    """Reset, the rule for cancelled pages, then updates by url, of which the last counts."""
    updates = _t(spark, d, "pages").where("page_id % 3 = 1").select("url", F.when(F.col("page_id") % 2 == 0, "parsed").otherwise("skipped").alias("status"), F.col("page_id").alias("place"))
    return catalog.with_status(catalog.with_rule(catalog.reset(catalog_merge(spark, d))), updates).select("id", "url", "status", "state")


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.documents(_t(spark, d, "pages"), at=F.lit("2024-01-01").cast("timestamp"))
    return rows.select("id", "url", "canonical_url", "domain", "title", "author", "language", F.size("subjects").alias("n_subjects"), F.size("sections").alias("n_sections"), "hash")


def page_latest(spark: SparkSession, d: str) -> DataFrame:
    return pages.one_per_id(pages.documents(_t(spark, d, "pages"), at=F.lit("2024-01-01").cast("timestamp"))).select("id", "url", "domain")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return pages.links(_t(spark, d, "pages").dropDuplicates(["url", "html"]), nested=False).groupBy("page", "url").agg(F.min("place").alias("place"))


def link_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return pages.first_seen(pages.links(_t(spark, d, "pages"), nested=False))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """User turns, with a reference number after some."""
    number = F.concat(F.lit(f" {PREFIX} 6"), F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0"), F.expr("CASE turn % 4 WHEN 0 THEN concat('-', turn % 10) WHEN 2 THEN '' ELSE ' x' END"))
    said = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", number))
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", said.alias("question"))


def question_rewrite(spark: SparkSession, d: str) -> DataFrame:
    fields = X.rewrite_question(F.col("question"), PREFIX)
    return _turns(spark, d).select("conv_id", "turn", *(F.array_join(c, " ").alias(k) if k == "keywords" else c.alias(k) for k, c in fields.items()))


def ref_filter(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of questions with a reference number, among the documents that answer to it."""
    number = F.concat(F.lit(f" {PREFIX} 600"), (F.col("item_id") % 10).cast("string"), F.expr("CASE item_id % 3 WHEN 0 THEN '' ELSE concat('-', item_id % 3) END"))
    questions = _t(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.concat("text", number).alias("question"))
    docs = _t(spark, d, "documents")
    meta = docs.select(F.col("doc_id").alias("chunk_id"), F.expr("CASE doc_id % 3 WHEN 0 THEN NULL ELSE concat('600', doc_id % 10, '-', doc_id % 3) END").alias("ref_number"), F.expr("concat(coalesce(source, ''), CASE WHEN doc_id % 3 = 0 THEN concat(' 600', doc_id % 10) ELSE '' END)").alias("doc_title"))
    return S.bm25(_chunks(spark, d), S.asked(questions, PREFIX), meta=meta).select("q_id", "chunk_id", "score", "rank")


def _rankings(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All rankings; the texts are scored once by the keywords and once by the whole questions."""
    chunks, asked, vectors = _chunks(spark, d), stored_small(_asked(spark, d), "questions"), stored_small(S.vector_top(*_vectors(spark, d)), "vectors")
    whole, pool = stored_small(S.bm25(chunks, _asked(spark, d, True)), "texts"), stored_small(S.bm25(chunks, asked, S.KEYWORD_POOL), "pool")
    return {
        "keyword": S.by_hits(pool, chunks, asked),
        "rrf": S.rrf(vectors, pool.where(F.col("rank") <= S.TEXT_POOL), chunks, asked),
        "additive": S.additive(vectors, whole),
        "minmax": S.min_max_fusion(vectors, whole),
    }


def all_rankers_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.compared(_rankings(spark, d)).select("q_id", "chunk_id", F.array_join("retrievers", ",").alias("retrievers"), "best_rank")


def entity_rank(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entities, their brands as aliases; orders as chunks; the distinct names as questions."""
    part, line = _t(spark, d, "part"), _t(spark, d, "lineitem")
    entities = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    questions = part.groupBy("p_name").agg(F.min("p_partkey").alias("q_id"), F.min("p_brand").alias("brand")).select("q_id", F.concat_ws(" ", "p_name", F.regexp_replace("brand", "#", "")).alias("question"))
    chunks = _t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("small red "), "o_orderpriority", F.lit(" brand")).alias("text"))
    mentions = line.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    found = S.entity_rank(entities, mentions, chunks, S.asked(questions, most=12))
    return found.select("q_id", "chunk_id", F.col("score").cast("long").alias("score"), F.col("entity_score").cast("long").alias("entity_score"), F.col("hit_bonus").cast("long").alias("hit_bonus"), F.array_join("matched_entities", ",").alias("matched"), "rank")


def _line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as chunks of their order; lightly taxed ones have no section."""
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_tax").alias("tax"), F.min("l_suppkey").alias("l_suppkey"), F.max("l_quantity").alias("quantity"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.when(F.col("tax") >= 0.02, F.col("l_orderkey")).alias("section_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_linenumber") * 1500).alias("start_char"), F.col("l_suppkey").alias("q_id"), "quantity")


def sibling_expand(spark: SparkSession, d: str) -> DataFrame:
    chunks = _line_chunks(spark, d)
    hits = chunks.where("quantity >= 45").select("q_id", "chunk_id", F.col("chunk_index").alias("rank"))
    by_place = K.expand(hits, chunks).select(F.lit("start_char").alias("by"), "*")
    return by_place.unionByName(K.expand(hits, chunks, 1, "chunk_index").select(F.lit("chunk_index").alias("by"), "*"))


def sibling_window(spark: SparkSession, d: str) -> DataFrame:
    return K.siblings(_line_chunks(spark, d)).select("chunk_id", F.array_join(F.col("siblings").cast("array<string>"), ",").alias("siblings"))


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    orders, customer = _t(spark, d, "orders"), _t(spark, d, "customer")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_custkey")).alias("section_id"), F.col("o_orderpriority").alias("section"))
    sections = customer.select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("doc_id"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("title"))
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("doc_id"), F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("title"), F.concat(F.lit("6000-"), F.col("n_regionkey").cast("string")).alias("ref_number"))
    hits = orders.select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 3 == 0, "own").otherwise(" ").alias("section_title"))
    return K.hydrated(hits, chunks, sections, docs)


def hydrate_meta(spark: SparkSession, d: str) -> DataFrame:
    return _hydrated(spark, d).select("q_id", "chunk_id", "doc_title", "ref_number", "section_title")


def context_build(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("section"), F.when(F.col("o_orderkey") % 5 == 0, " \n ").otherwise(F.concat(F.lit("  "), F.repeat(F.concat("o_orderpriority", F.lit(" \n")), 5))).alias("text"))
    hits = S.top(_hydrated(spark, d), S.TOP, F.col("chunk_id"))
    return K.context(hits, chunks, 3, 40, number_prefix=f"{PREFIX} ")


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    rows = context_build(spark, d)
    return rows.select("q_id", X.prompt("Context:\n{context}\nQuestion: {question}\n", context=F.col("context"), question=F.col("q_id")).alias("prompt"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """What a model might have said of each labelled document: whole, fenced, within prose, broken, with odd elements."""
    said = _t(spark, d, "documents").join(_t(spark, d, "labels").select("doc_id", "quality").distinct(), "doc_id").selectExpr("doc_id AS chunk_id", "cast(doc_id % 50 AS string) AS doc_id", f"{RESPONSE} AS response")
    return extraction.parsed(said)


def model_json_entities(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.entities(_answers(spark, d))
    nodes = extraction.entity_nodes(found, extraction.dates(_answers(spark, d)))
    return nodes.select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"), "source_doc_id")


def model_json_mentions(spark: SparkSession, d: str) -> DataFrame:
    return extraction.mentions(extraction.entities(_answers(spark, d)))


def model_json_dates(spark: SparkSession, d: str) -> DataFrame:
    return extraction.date_mentions(extraction.dates(_answers(spark, d)))


def model_json_relations(spark: SparkSession, d: str) -> DataFrame:
    said = _answers(spark, d)
    return extraction.related(extraction.relations(said), extraction.entity_nodes(extraction.entities(said), extraction.dates(said)))


def extraction_written(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    return extraction.marked_done(chunks, _answers(spark, d), "model-a", F.lit("2024-01-01T00:00:00Z")).select("chunk_id", "significance", "extract_model", "extracted_at")


def extraction_loop(spark: SparkSession, d: str) -> DataFrame:
    """The entities of model_json_entities by the loop: a run in which the model fails for some chunks and that dies, the same again, and a retry."""
    at = new_dir(spark, "extraction")
    labels = _t(spark, d, "labels").select("doc_id", "quality").distinct()
    said = _t(spark, d, "documents").join(labels, "doc_id").selectExpr("doc_id AS chunk_id", "cast(doc_id % 50 AS string) AS doc_id", f"{RESPONSE} AS text")

    def fails(prompt: str) -> str:
        if "Topic 3" in prompt:
            raise OSError("gone")
        return prompt

    def dies() -> None:
        raise RuntimeError("before the commit")

    step = lambda model: extract.step(model, F.col("text"), lambda answer: "{" in answer, at_once=4)
    try:
        backlog.write_batch(said, at, "one", step(lambda prompt: prompt), before_commit=dies)
    except RuntimeError:
        pass
    backlog.write_batch(said, at, "one", step(fails))
    backlog.retry(spark, at, step(lambda prompt: prompt))
    return extract.tables(spark, at)["entities"].select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"), "source_doc_id")


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _t(spark, d, "documents").join(e, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", "embedding")


def embed_backlog(spark: SparkSession, d: str) -> DataFrame:
    return G.embed_backlog(_embedded(spark, d)).select("chunk_id")


def extract_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source whose number is odd are in the graph; labelled ones of quality are done."""
    docs = _t(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.when(F.col("doc_id") % 11 == 0, "2024").alias("extracted_at"))
    links = docs.select((F.col("doc_id") % 97).alias("section_id"), F.col("doc_id").alias("chunk_id"))
    sections = docs.select((F.col("doc_id") % 97).alias("section_id"), (F.col("doc_id") % 97 % 10).alias("doc_id")).distinct()
    owners = sections.select("doc_id").distinct().where("doc_id % 2 = 1")
    done = _t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return G.extract_backlog(chunks, links, sections, owners, done).select("chunk_id", "doc_id")


def _model(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def embed_hook(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model, run over the backlog and written back."""
    chunks = _embedded(spark, d)
    vectors = hooks.embed(G.embed_backlog(chunks), _model)
    rows = G.with_embeddings(chunks, vectors, "lengths", F.lit("2024-01-01T00:00:00Z"))
    return rows.select("chunk_id", F.size("embedding").alias("size"), F.col("embedding")[0].cast("double").alias("first"), "embedding_model", "embedded_at")


def generate_hook(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for a model that never answers some prompts in JSON."""
    model = lambda p: f'{{"significance": "{len(p)}"}}' if len(p) % 5 else "no"
    return hooks.generate(_chunks(spark, d), model, X.prompt("Text: {text}", text=F.col("text")), lambda answer: answer.startswith("{"))


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.ingest_counts(_lines(spark, d))


def keyed_upserts(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer by three upserts of parts of the orders, one of them run twice."""
    at, orders = new_dir(spark, "keyed"), _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    for k in (2, 0, 1, 0):
        last = orders.where(F.col("o_orderkey") <= 1_000_000_000).where(F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(3)) == k)
        known = keyed.current(spark, at, "last")
        both = last if known is None else last.unionByName(known.join(last.select("o_custkey"), "o_custkey", "left_semi"))
        keyed.upsert(both, at, "last", ["o_custkey"], [F.col("o_orderkey")], name=f"part-{k}", buckets=16)
    return keyed.current(spark, at, "last").select("o_custkey", "o_orderkey", "o_orderstatus")


def graph_load(spark: SparkSession, d: str) -> DataFrame:
    """Two loads of documents, their lines as sections and chunks: the second brings the documents that sections of the first lack."""
    at, rows = new_dir(spark, "graph"), C.sections(_lines(spark, d))
    # The texts are cut once; what is left of them are ids and sizes.
    parts = stored(rows.select("section_id", "doc_id", F.concat("section_id", F.lit("/c")).alias("chunk_id"), X.token_count(F.col("text")).alias("size")), "parts")
    batch = lambda docs, few: {"docs": docs, "sections": few.select("section_id", "doc_id"), "chunks": few.select("chunk_id", "size"), "links": parts.select("section_id", "chunk_id")}
    docs = _t(spark, d, "documents").select("doc_id")
    loading.load(spark, at, "one", batch(docs.where("doc_id % 2 = 0"), parts.where("doc_id % 3 > 0")), [F.lit(1)], 8)
    loading.load(spark, at, "two", batch(docs.where("doc_id % 2 = 1 and doc_id % 5 > 0"), parts.where("doc_id % 3 = 0 or doc_id % 2 = 1")), [F.lit(1)], 8)
    return keyed.current(spark, at, "links").join(keyed.current(spark, at, "sections"), "section_id").groupBy("doc_id").agg(F.count("*").alias("n_links"))


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document frequencies after three batches: all documents, many of them cut short; those anew; the last again."""
    at, docs = new_dir(spark, "statistics"), _chunks(spark, d)
    cut = docs.withColumn("text", F.when(F.col("chunk_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")))
    loading.count_in(cut.where("chunk_id % 5 > 0"), at, "one", [F.length("text")], 8)
    loading.count_in(docs.where("chunk_id % 3 = 0 OR chunk_id % 5 = 0"), at, "two", [F.length("text")], 8)
    loading.count_in(docs.where("chunk_id % 7 = 0"), at, "three", [F.length("text")], 8)
    loading.count_in(cut, at, "three", [F.length("text")], 8)
    return loading.statistics(spark, at)


def incremental_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of files; its result is that of one batch."""
    at, path = new_dir(spark, "stream"), f"{d}/documents.parquet"
    stream = incremental.stream_of(spark, path, _t(spark, d, "documents").schema)
    whole = stream.select("doc_id", F.array(F.struct(F.lit("").alias("title"), F.col("text").alias("text"))).alias("sections"))
    incremental.ingest_stream(whole, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return incremental.current(spark, f"{at}/out", ["chunk_id"]).select(*SPANS)


def backlog_commits(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as a backlog: a run that dies before its commit, one that ends, a replayed batch, a retry.

    The step fails for toxic documents in the first two runs; each document comes out once, with the run that managed it."""
    at = new_dir(spark, "backlog")
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pending = docs.select(F.col("doc_id").alias("chunk_id"), "text").join(labels.withColumnRenamed("doc_id", "chunk_id"), "chunk_id")
    step = lambda said, all_of_it: lambda rows: rows.where(F.lit(all_of_it) | (F.coalesce("toxic", F.lit(0)) == 0)).select("chunk_id", F.char_length("text").alias("size"), F.lit(said).alias("run"))

    def dies() -> None:
        raise RuntimeError("before the commit")

    try:
        backlog.write_batch(pending, at, "batch-0", step("first", False), before_commit=dies)
    except RuntimeError:
        pass
    backlog.write_batch(pending, at, "batch-0", step("second", False))
    backlog.write_batch(pending, at, "batch-0", step("replayed", True))
    backlog.retry(spark, at, step("retried", True))
    backlog.write_batch(pending, at, "batch-1", step("late", True))
    return backlog.results(spark, at).select("chunk_id", "size", "run")


def doc_hash_dupes(spark: SparkSession, d: str) -> DataFrame:
    text = X.sections_text(F.col("sections"))
    return _lines(spark, d).select("doc_id", X.text_hash(text).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def props_json(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", X.json_text(F.try_parse_json("props"), "$.k").alias("k"), X.json_text(F.try_parse_json("props"), "$.none").alias("none"))


def _fused(how, whole: bool):
    return lambda s, d: how(S.vector_top(*_vectors(s, d)), S.bm25(_chunks(s, d), _asked(s, d, whole))).select("q_id", "chunk_id", "score", "rank")


QUERIES = {
    "sections_flatten": sections_flatten,
    "chunk_spans": chunk_spans,
    "question_keywords": lambda s, d: _questions(s, d).select("q_id", F.array_join(X.keywords(F.col("question")), " ").alias("words")),
    "question_rewrite": question_rewrite,
    "ref_filter": ref_filter,
    "answers": answers,
    "bm25_topk": lambda s, d: S.bm25(_chunks(s, d), _asked(s, d)).select("q_id", "chunk_id", "score", "rank"),
    "keyword_rank": lambda s, d: S.keyword_rank(_chunks(s, d), _questions(s, d)).select("q_id", "chunk_id", "score", "hit_count", "rank"),
    "titled_ranking": titled_ranking,
    "title_rules": title_rules,
    "vector_topk": lambda s, d: S.vector_top(*_vectors(s, d)).select("q_id", "chunk_id", "score", "rank"),
    "rrf_fusion": lambda s, d: S.rrf(S.vector_top(*_vectors(s, d)), S.bm25(_chunks(s, d), _asked(s, d)), _chunks(s, d), _asked(s, d)).select("q_id", "chunk_id", "score", "rank"),
    "additive_fusion": _fused(S.additive, True),
    "minmax_fusion": _fused(S.min_max_fusion, True),
    "all_rankers_overlap": all_rankers_overlap,
    "entity_rank": entity_rank,
    "sibling_expand": sibling_expand,
    "sibling_window": sibling_window,
    "hydrate_meta": hydrate_meta,
    "context_build": context_build,
    "prompt_render": prompt_render,
    "catalog_merge": catalog_merge,
    "catalog_status": catalog_status,
    "page_meta": page_meta,
    "page_latest": page_latest,
    "page_links": page_links,
    "link_first_seen": link_first_seen,
    "doc_latest": lambda s, d: G.latest(_t(s, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], [F.col("event_id")]),
    "doc_hash_dupes": doc_hash_dupes,
    "key_violations": lambda s, d: G.key_violations(_t(s, d, "lineitem").select("l_orderkey"), "l_orderkey"),
    "link_integrity": lambda s, d: G.links_between(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")), _t(s, d, "orders").select(F.col("o_orderkey").alias("a")), _t(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("b"))),
    "model_json_entities": model_json_entities,
    "model_json_mentions": model_json_mentions,
    "model_json_dates": model_json_dates,
    "model_json_relations": model_json_relations,
    "extraction_written": extraction_written,
    "extraction_loop": extraction_loop,
    "embed_backlog": embed_backlog,
    "extract_backlog": extract_backlog,
    "embed_hook": embed_hook,
    "generate_hook": generate_hook,
    "ingest_counts": ingest_counts,
    "incremental_chunks": incremental_chunks,
    "backlog_commits": backlog_commits,
    "keyed_upserts": keyed_upserts,
    "graph_load": graph_load,
    "corpus_statistics": corpus_statistics,
    "props_json": props_json,
}
