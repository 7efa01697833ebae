"""Ranked retrieval for a table of questions: lexical, vector, entity and fused; every limit is per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import keywords, reference, spaced, whole_word
from quire.operators import grid, lists
from quire.sources.scratch import stored, stored_small

K1, B = 1.2, 0.75
#: Pools and weights of the rankers.
KEYWORD_POOL, VECTOR_POOL, TEXT_POOL, ENTITY_POOL, TOP = 80, 25, 60, 20, 8
RRF_K, VECTOR_WEIGHT, TEXT_WEIGHT, HIT_WEIGHT = 60, 1.0, 0.8, 0.15
MOST_NAMES, GRAM = 10, 3
#: How far a sum of scores may be from its rounded form.
ROUNDING = 1e-6


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each question, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("rank") <= n)


def by_score(df: DataFrame, n: int) -> DataFrame:
    return top(df, n, F.desc("score"), F.col("chunk_id"))


def asked(questions: DataFrame, prefix: str | None = None, most: int = 10, whole: bool = False) -> DataFrame:
    """(q_id, words, base, full): what each question (q_id, question) looks for; those that look for nothing are left out.

    ``words`` are the keywords, or without any the reference number after ``prefix``; with ``whole`` the question itself."""
    base, full = reference(F.col("question"), prefix) if prefix else (F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = questions.select("q_id", "question", keywords(F.col("question"), most).alias("words"), base.alias("base"), full.alias("full"))
    number = F.coalesce("full", "base")
    words = F.when(F.lit(whole), F.array("question")).when(F.size("words") > 0, F.col("words")).when(number.isNotNull(), F.array(number)).otherwise(F.array().cast("array<string>"))
    return rows.select("q_id", words.alias("words"), "base", "full").where("size(words) > 0")


def of_reference(base: Column, full: Column, number: Column, title: Column) -> Column:
    """Whether a document's number and title answer to the reference number that a question has, if it has one."""
    number, title = F.coalesce(number, F.lit("")), F.coalesce(title, F.lit(""))
    exact = (number == full) | title.contains(full)
    return F.when(full.isNotNull(), exact).when(base.isNotNull(), number.startswith(F.concat(base, F.lit("-"))) | title.contains(base)).otherwise(True)


def impacts(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, term, part): what each of ``terms`` (q_id, term) adds to the BM25 score of each chunk (chunk_id, text) that has it.

    The chunks are read and split once: with the tokens that some question has, each leaves one row of its
    length under the empty token, which stands for all chunks.  Only these rows are shuffled, and written."""
    wanted = stored_small(terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string")), "terms")
    split = chunks.select("chunk_id", tokens(F.col("text")).alias("t"))
    rows = split.select("chunk_id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term")).join(wanted, "term")
    postings = stored(rows.groupBy("chunk_id", "len", "term").agg(F.count("*").alias("tf")), "postings")
    # One row a term of the questions: how many chunks have it.
    known = stored_small(postings.where("term <> ''").groupBy("term").agg(F.count("*").alias("df")), "known")
    every = postings.where("term = ''").agg(F.count("*").alias("n_all"), F.avg("len").alias("mean"))
    idf = F.log(1 + (F.col("n_all") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return postings.where("term <> ''").join(known, "term").join(F.broadcast(every)).select("chunk_id", "term", part.alias("part"))


def terms_of(questions: DataFrame) -> DataFrame:
    """(q_id, term): the distinct tokens of what questions (q_id, words) look for."""
    return questions.select("q_id", F.explode(F.array_distinct(F.flatten(F.transform("words", tokens)))).alias("term"))


def text_scores(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, chunk_id, score): BM25 of chunks (chunk_id, text) for questions (q_id, words), all there are."""
    terms = stored_small(terms_of(questions), "asked")
    return impacts(chunks, terms).join(terms, "term").groupBy("q_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))


def graded(found: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(q_id, term, essential, bound): which terms of a question a chunk must have one of to be among its ``n`` best.

    A term's parts are bounded by its largest.  The n-th largest part of any one term is a score that n chunks
    reach, so chunks that have only terms of which the bounds add up to less are out; these are the terms of
    least bounds, of which ``bound`` is the sum."""
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("part")))).where(F.col("k") <= n)
    limits = best.groupBy("term").agg(F.max("part").alias("most"), F.coalesce(F.min(F.when(F.col("k") == n, F.col("part"))), F.lit(0.0)).alias("reached"))
    own = Window.partitionBy("q_id")
    rows = terms.join(limits, "term").withColumn("sum", F.sum("most").over(own.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("reached", F.max("reached").over(own)).withColumn("essential", F.col("sum") >= F.col("reached") - ROUNDING)
    return rows.select("q_id", "term", "essential", "reached", F.coalesce(F.max(F.when(~F.col("essential"), F.col("sum"))).over(own), F.lit(0.0)).alias("bound"))


def pruned_parts(found: DataFrame, terms: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(q_id, chunk_id, part) of two joins: what essential terms give, and what the others add to chunks that can still be among the ``n`` best."""
    marked = stored_small(graded(found, terms, n), "graded")
    first = found.join(marked.where("essential"), "term").groupBy("q_id", "chunk_id").agg(F.sum("part").alias("part"), F.max("reached").alias("reached"), F.max("bound").alias("bound"))
    first = stored(first.where(F.col("part") + F.col("bound") >= F.col("reached") - ROUNDING).select("q_id", "chunk_id", "part"), "candidates")
    asked = first.select("q_id", "chunk_id").join(marked.where("NOT essential").select("q_id", "term"), "q_id")
    return first, found.join(asked, ["chunk_id", "term"]).select("q_id", "chunk_id", "part")


def bm25(chunks: DataFrame, questions: DataFrame, n: int = TEXT_POOL, meta: DataFrame | None = None) -> DataFrame:
    """The best ``n`` by BM25; with ``meta`` (chunk_id, ref_number, doc_title) of those that answer to the question's reference.

    Without it, chunks are scored where they stand; for more questions than that is for, chunks that cannot be among
    the best are left out before all their terms are joined.  Neither is for ids that several chunks have."""
    if meta is None and not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
        return by_score(text_scores(chunks, questions), n)
    if meta is None:
        terms = stored_small(terms_of(questions), "asked")
        found = lists.best(chunks, tokens(F.col("text")), terms, n, K1, B)
        if found is not None:
            return by_score(found.select("q_id", "chunk_id", F.round("score", 6).alias("score")), n)
        one, two = pruned_parts(impacts(chunks, terms), terms, n)
        return by_score(one.unionByName(two).groupBy("q_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")), n)
    rows = text_scores(chunks, questions).join(meta.select("chunk_id", "ref_number", "doc_title"), "chunk_id", "left").join(stored_small(questions.select("q_id", "base", "full"), "references"), "q_id")
    return by_score(rows.where(of_reference(F.col("base"), F.col("full"), F.col("ref_number"), F.col("doc_title"))).select("q_id", "chunk_id", "score"), n)


def blob(chunks: DataFrame) -> DataFrame:
    """(chunk_id, blob): title, number and section, where there are such columns, before the text."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_title", "ref_number", "section", "text") if c in chunks.columns]
    return chunks.select("chunk_id", F.concat_ws(" ", *parts).alias("blob"))


def with_hits(candidates: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """``candidates`` (q_id, chunk_id, ...) that are among the chunks, with ``hits``: how many words of its question (q_id, words) each has.

    They are written once, with their words.  A candidate chunk's text is made ready once, before the questions
    come to it, and texts move only where the candidates are too many to be broadcast."""
    pool = stored_small(candidates.join(questions.select("q_id", "words"), "q_id"), "pool")
    texts = blob(chunks).join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", spaced(F.col("blob")).alias("spaced"))
    hits = F.size(F.filter(F.array_distinct("words"), lambda w: whole_word(F.col("spaced"), w)))
    return texts.join(pool, "chunk_id").select(*candidates.columns, hits.alias("hits"))


def keyword_rank(chunks: DataFrame, questions: DataFrame, n: int = TOP, prefix: str | None = None, meta: DataFrame | None = None) -> DataFrame:
    """The pool of best scores, ordered anew by whole-word hits."""
    words = asked(questions, prefix)
    return by_hits(bm25(chunks, words, KEYWORD_POOL, meta), chunks, words, n)


def by_hits(pool: DataFrame, chunks: DataFrame, questions: DataFrame, n: int = TOP) -> DataFrame:
    """``pool`` (q_id, chunk_id, score, rank) ordered anew by whole-word hits of ``questions`` (q_id, words)."""
    hits = with_hits(pool.drop("rank"), chunks, questions).withColumnRenamed("hits", "hit_count")
    return top(hits, n, F.desc("hit_count"), F.desc("score"), F.col("chunk_id"))


def cosines(chunks: DataFrame, queries: DataFrame, n: int = VECTOR_POOL) -> DataFrame:
    """The same as vector_top() in DataFrame operations only, every pair as a row: for few vectors, and to compare with."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = chunks.where("size(embedding) > 0").select("chunk_id", "embedding").join(F.broadcast(queries.where("size(embedding) > 0").select("q_id", F.col("embedding").alias("q"))))
    cosine = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    return by_score(pairs.select("q_id", "chunk_id", F.round((1 + cosine) / 2, 6).alias("score")), n)


def vector_top(chunks: DataFrame, queries: DataFrame, n: int = VECTOR_POOL) -> DataFrame:
    """(q_id, chunk_id, score, rank): (1 + cosine) / 2 of every embedded chunk with each query vector, in blocks of both."""
    found = grid.best(queries.where("size(embedding) > 0").select("q_id", "embedding"), chunks.where("size(embedding) > 0").select("chunk_id", "embedding"), n)
    return by_score(found.select("q_id", "chunk_id", F.round("score", 6).alias("score")), n)


def merged(vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """Both candidate lists side by side; a missing score is 0."""
    v = vectors.select("q_id", "chunk_id", F.col("score").alias("vec_score"), F.col("rank").alias("vec_rank"))
    t = texts.select("q_id", "chunk_id", F.col("score").alias("ft_score"), F.col("rank").alias("ft_rank"))
    return v.join(t, ["q_id", "chunk_id"], "full_outer").fillna(0.0, ["vec_score", "ft_score"])


def rrf(vectors: DataFrame, texts: DataFrame, chunks: DataFrame | None = None, questions: DataFrame | None = None, n: int = TOP) -> DataFrame:
    """Shares of both ranks, and HIT_WEIGHT for each word of ``questions`` (q_id, words) that a candidate has.

    Without ``questions``, as for a question without keywords, there are no hits."""
    share = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    both = merged(vectors, texts)
    if questions is None:
        both = both.withColumn("hits", F.lit(0))
    else:
        both = stored_small(both, "merged")
        both = both.join(with_hits(both.select("q_id", "chunk_id"), chunks, questions), ["q_id", "chunk_id"], "left").fillna(0, ["hits"])
    score = F.round(share(VECTOR_WEIGHT, "vec_rank") + share(TEXT_WEIGHT, "ft_rank") + HIT_WEIGHT * F.col("hits"), 9)
    return by_score(both.select("q_id", "chunk_id", score.alias("score")), n)


def additive(vectors: DataFrame, texts: DataFrame, n: int = TOP) -> DataFrame:
    return by_score(merged(vectors, texts).select("q_id", "chunk_id", F.round(F.col("vec_score") + F.col("ft_score"), 6).alias("score")), n)


def min_max(df: DataFrame) -> DataFrame:
    """Scores of each question stretched to 0..1; equal ones become 1."""
    w = Window.partitionBy("q_id")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    return df.withColumn("score", F.when(span <= 1e-12, 1.0).otherwise((F.col("score") - low) / span))


def min_max_fusion(vectors: DataFrame, texts: DataFrame, n: int = TOP) -> DataFrame:
    both = merged(min_max(vectors.where(F.col("rank") <= n)), min_max(texts.where(F.col("rank") <= n)))
    return by_score(both.select("q_id", "chunk_id", F.round(0.6 * F.col("vec_score") + 0.4 * F.col("ft_score"), 6).alias("score")), n)


def grams(low: Column) -> Column:
    """The distinct GRAM-character pieces of a text; of one that is shorter, the text itself."""
    n = F.char_length(low)
    return F.array_distinct(F.when(n > GRAM, F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM)))).otherwise(F.array(low)))


def words_within(entities: DataFrame, words: DataFrame) -> DataFrame:
    """(entity_id, word): each of ``words`` (word) that occurs, as any part of it, in an entity's lower-cased name or an alias.

    Names stand in lists by their three-character pieces.  A word looks only in the list of its rarest piece,
    and what it finds there is verified; words of fewer characters have the pieces of their own length."""
    texts = entities.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).where("text is not null")
    texts = texts.select("entity_id", F.lower("text").alias("low"))
    asked = words.where("word <> ''").select("word", F.explode(grams(F.col("word"))).alias("gram"))
    asked = stored_small(asked.distinct(), "pieces")
    short = [r[0] for r in asked.where(F.char_length("gram") < GRAM).select(F.char_length("gram")).distinct().collect()]
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(0), F.char_length("low") - k + 1)), lambda i: F.substring("low", i, F.lit(k)))
    found = [F.when(F.char_length("low") >= k, pieces(k)).otherwise(F.array().cast("array<string>")) for k in (GRAM, *short)]
    lists = texts.select("entity_id", "low", F.explode(F.array_distinct(F.concat(*found))).alias("gram")).join(asked.select("gram").distinct(), "gram")
    lists = stored(lists, "lists")
    sizes = asked.join(lists.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left").fillna(0, ["n"])
    # A piece that no name has rules its words out.
    rarest = sizes.groupBy("word").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n > 0").select("word", F.col("r.gram").alias("gram"))
    return lists.join(stored_small(rarest, "rarest"), "gram").where(F.contains("low", "word")).select("entity_id", "word").distinct()


def entity_rank(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, questions: DataFrame, n: int = TOP, meta: DataFrame | None = None) -> DataFrame:
    """Chunks by ten times the summed scores of the entities that they mention, and a point for each keyword within their text.

    ``questions`` is what asked() gives with 12 keywords, ``entities`` (entity_id, name, aliases), ``mentions``
    (chunk_id, entity_id).  An entity's score counts the keywords within its name or an alias; the best
    ENTITY_POOL of each question count."""
    words = stored_small(questions.select("q_id", F.explode("words").alias("word")), "words")
    hits = words_within(entities, words.select("word").distinct()).join(words, "word").groupBy("q_id", "entity_id").agg(F.count_distinct("word").alias("entity_score"))
    best = stored_small(top(hits, ENTITY_POOL, F.desc("entity_score"), F.col("entity_id")).drop("rank"), "entities")
    best = entities.select("entity_id", "name").join(best, "entity_id")
    met = mentions.select("chunk_id", "entity_id").distinct().join(stored_small(best, "named"), "entity_id")
    scored = met.groupBy("q_id", "chunk_id").agg(F.sum("entity_score").alias("entity_score"), F.slice(F.sort_array(F.collect_list("name")), 1, MOST_NAMES).alias("matched_entities"))
    rows = scored.join(chunks.select("chunk_id", "text"), "chunk_id").join(stored_small(questions, "questions"), "q_id")
    if meta is not None:
        rows = rows.join(meta.select("chunk_id", "ref_number", "doc_title"), "chunk_id", "left").where(of_reference(F.col("base"), F.col("full"), F.col("ref_number"), F.col("doc_title")))
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("hit_bonus", F.size(F.filter("words", lambda k: low.contains(k))))
    return by_score(rows.select("q_id", "chunk_id", (10 * F.col("entity_score") + F.col("hit_bonus")).alias("score"), "entity_score", "hit_bonus", "matched_entities"), n)


def compared(rankings: dict[str, DataFrame]) -> DataFrame:
    """(q_id, chunk_id, retrievers, best_rank): which of several rankings have each hit."""
    out = None
    for name, hits in rankings.items():
        one = hits.select("q_id", "chunk_id", "rank", F.lit(name).alias("retriever"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no ranking to compare")
    return out.groupBy("q_id", "chunk_id").agg(F.sort_array(F.collect_set("retriever")).alias("retrievers"), F.min("rank").alias("best_rank"))


def chosen(rankings: dict[str, DataFrame], name: str) -> DataFrame:
    """The ranking of that name."""
    if name not in rankings:
        raise ValueError(f"unknown retriever {name!r}: there are {', '.join(sorted(rankings))}")
    return rankings[name]
