import json

import pytest
from pyspark.sql import functions as F

from quire.functions import html
from quire.functions import text as X
from quire.operators import catalog, extraction, hooks, pages
from quire.operators import chunks as C
from quire.operators import context as K
from quire.operators import graph as G
from quire.operators import search as S
from quire.sources import files
from quire.streaming import incremental


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column(F.col("x"))).collect()]


def test_titles(spark):
    assert values(spark, X.clean_section_title, ["3. Scope", "4.1 Scope", "2) X", "7 X", None]) == ["Scope", "1 Scope", "X", "7 X", ""]


def test_keywords(spark):
    assert values(spark, X.keywords, ["What does the RULE 6000-1 say about e-mail, e-mail?", None]) == [["rule", "6000-1", "e-mail"], []]


def test_reference(spark):
    rows = ["RULE 6000-1", "rule 6000 – 1", "RULE 60001", "RULE 6002", "RULE 6000 5 years", "none", None]
    assert values(spark, lambda x: F.struct(*X.reference(x, "RULE")), rows) == [("6000", "6000-1")] * 3 + [("6002", None), ("6000", "6000-5"), (None, None), (None, None)]


def test_entity_types(spark):
    assert values(spark, X.entity_type, ["people", "organisation", "time", "militaryUnit", " ", None]) == ["Person", "Organization", "Date", "MilitaryUnit", "Concept", "Concept"]


def test_references_need_a_semicolon():
    page = html.document("http://a.b/c", "<html><title>x&amp y &lt;z&gt; &#65;&#66 &amp;lt; &bogus; &</title><body></html>")
    assert page["title"] == "x&amp y <z> A&#66 &lt; &bogus; &"


def test_many_links_have_many_tasks(spark, monkeypatch):
    links = spark.range(600).selectExpr("id % 50 AS a", "id % 70 AS b")
    left, right = spark.range(0, 50, 2).toDF("a"), spark.range(60).toDF("b")
    few = G.links_between(links, left, right)
    monkeypatch.setattr(G, "TASK_ROWS", 10)
    many = G.links_between(links, left, right)
    assert many.rdd.getNumPartitions() == 60 and sorted(map(tuple, many.collect())) == sorted(map(tuple, few.select(*many.columns).collect()))


def test_chunk_id(spark):
    assert values(spark, lambda x: X.short_id(x, F.lit(0), F.lit(0), F.lit(0), F.lit(5)), ["a"]) == ["f478f7b9f45dc12f"]


def test_spans():
    assert C.spans("") == []
    assert len(C.spans("x" * 2000)) == 1
    assert C.spans("x" * 5000) == [(0, 1000), (800, 1800), (1600, 2600), (2400, 3400), (3200, 5000)]
    assert C.spans("x" * 1900 + " " + "y" * 499) == [(0, 2400)]
    assert C.spans("\u00a0 ab ") == [(2, 4)]
    assert len(C.spans("ab " * 667)) == 2


def test_sections_keep_gaps(spark):
    docs = spark.createDataFrame([("d", [("A", "x"), ("B", "  "), ("C", "y")])], "doc_id string, sections array<struct<title string, text string>>")
    assert [(r.section_index, r.section_id) for r in C.sections(docs).orderBy("section_index").collect()] == [(0, "d:s000"), (2, "d:s002")]


CATALOG = "id string, url string, domain string, discoveredat string, status string, state string"


def test_catalog(spark):
    known = spark.createDataFrame([("1", "http://a/x", "a", "t", "parsed", "old")], CATALOG)
    new = spark.createDataFrame([("http://a/x", "new"), ("http://u@b:80/y", None), ("http://u@b:80/y", None), (" ", None), (None, "x")], "url string, state string")
    merged = catalog.merge(known, new, F.lit("now"))
    rows = {r.url: (r.domain, r.status, r.state, r.discoveredat) for r in merged.collect()}
    assert rows == {"http://a/x": ("a", "parsed", "old", "t"), "http://u@b:80/y": ("u@b:80", "pending", "", "now")}
    assert {r.status for r in catalog.reset(merged).collect()} == {"pending"}


def test_catalog_status(spark):
    rows = [("1", " u ", " Cancelled "), ("2", "v", "under review"), ("3", "w", " "), ("4", "w", None)]
    table = spark.createDataFrame([(i, u, "d", "t", "pending", s) for i, u, s in rows], CATALOG)
    assert {r.id: r.status for r in catalog.with_rule(table).collect()} == {"1": "skipped", "2": "pending", "3": "pending", "4": "pending"}
    updates = spark.createDataFrame([("u", "parsed", 1), ("w ", "skipped", 1), ("w", "parsed", 2), ("none", "parsed", 1)], "url string, status string, place int")
    assert {r.id: r.status for r in catalog.with_status(table, updates).collect()} == {"1": "parsed", "2": "pending", "3": "parsed", "4": "pending"}


def test_catalog_files(spark, tmp_path):
    path, to = str(tmp_path / "catalog.xml"), str(tmp_path / "new")
    (tmp_path / "catalog.xml").write_text("<Items><Item><id>1</id><url> http://a/x </url><domain>a</domain><status/><state>é</state></Item><Item><id>2</id><url> </url></Item></Items>")
    assert [tuple(r) for r in files.read_catalog_xml(spark, path).collect()] == [("1", "http://a/x", "a", "", "", "é")]
    new = spark.createDataFrame([("http://b/y", "s")], "url string, state string")
    files.add_to_catalog(spark, new, path, to, F.lit("now"))
    assert {(r.url, r.state) for r in files.read_catalog_xml(spark, to).collect()} == {("http://a/x", "é"), ("http://b/y", "s")}
    files.add_to_catalog(spark, new, str(tmp_path / "absent"), str(tmp_path / "first"), F.lit("now"))
    assert files.read_catalog_xml(spark, str(tmp_path / "first")).count() == 1


def test_document_files(spark, tmp_path):
    docs = [{"id": "a", "title": "é", "subjects": ["s"], "sections": [{"title": "T", "text": "x"}, "no object", {"text": 5}]}, {"id": "b"}, {"id": "c", "sections": "text"}, {"title": "no id"}]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d, indent=1, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{bad")
    got = {r.id: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"].title == "é" and got["a"].subjects == ["s"] and got["b"].sections == []
    assert [(s and s.title, s and s.text) for s in got["a"].sections] == [("T", "x"), (None, None), (None, "5")]
    assert [(r.section_index, r.text) for r in C.sections(files.read_documents(spark, str(tmp_path)), "id").orderBy("section_index").collect()] == [(0, "x"), (2, "5")]


def test_logs_and_tables(spark, tmp_path):
    log = str(tmp_path / "log")
    assert files.read_done(spark, log).count() == 0
    chunks = spark.createDataFrame([("d", "c1"), ("d", "c2")], "doc_id string, chunk_id string")
    for _ in range(2):
        files.append_done(chunks, log, "m", X.second())
    (tmp_path / "log" / "more.json").write_text('{"chunk_id": ""}\n\nnot json\n{"chunk_id": "c3"}\n')
    assert {r[0] for r in files.read_done(spark, log).collect()} == {"c1", "c2", "c3"}
    rows = lambda *x: spark.createDataFrame(x, "id string, v int, at int")
    files.upsert_table(spark, rows(("a", 1, 1), ("a", 2, 2), ("b", 3, 1)), str(tmp_path / "t0"), str(tmp_path / "t1"), ["id"], [F.col("at")])
    files.upsert_table(spark, rows(("a", 9, 0)), str(tmp_path / "t1"), str(tmp_path / "t2"), ["id"], [F.col("at")])
    assert {(r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t2")).collect()} == {("a", 9), ("b", 3)}
    assert X.second is not None and spark.range(1).select(X.second()).first()[0].endswith("Z")


PAGE = """<html lang=" en "><head><title> A &amp; B </title><meta name="dcterms.issued" content=" 2020 "><link rel="x Canonical" href="/c"></head><body><nav><p>no</p></nav>
<main><div><h2>Table of Contents</h2><ol><li>One<li><a>Two</a></ol></div>
<section class="a pagedetails"><h2>Gone</h2><p>x</p></section>
<h2>1. Scope</h2><p>First <b>bold</p><p>Again</p><p>Again</p><ul><li>Item<ul><li>Inner</li></ul></li></ul><script>var t="</p>";</script>
<table><thead><tr><th>Who ...</th><th>What…</th></tr></thead><tbody><tr><td>Who</td><td>What</td></tr><tr><td>A</td><td><ul><li>x</li><li>y</li></ul></td></tr><tr><td>B</td><td>z</td></tr></tbody></table>
<h2>2. Responsibilities</h2><p>before</p><table><tr><td>Role</td><td>Duty</td></tr><tr><td>Chief</td><td>leads</td></tr><tr><td></td><td>none</td></tr></table><h2> </h2><p>lost</p><h2>Empty</h2></main></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame([("http://u@h:8/a/b", PAGE), ("http://h/none", None), ("http://h/plain", "<h1>Only</h1>"), (None, "")], "url string, html string")
    got = {r.url: r for r in pages.documents(rows).collect()}
    d = got["http://u@h:8/a/b"]
    assert (d.title, d.language, d.published_date, d.canonical_url, d.domain, d.subjects, d.raw_html) == ("A & B", "en", "2020", "http://u@h:8/c", "u@h:8", ["One", "Two"], None)
    assert [(s.title, s.text) for s in d.sections] == [("1. Scope", "First bold Again Item Inner Inner Who A What x y Who B What z"), ("Chief", "Chief Duty leads")]
    assert d.text == "1. Scope First bold Again Item Inner Inner Who A What x y Who B What z Chief Chief Duty leads" and len(d.hash) == 64 and len(d.id) == 16
    assert got["http://h/plain"].title == "Only" and got["http://h/none"].sections == [] and got[None].title is None
    same = rows.where("html is not null and url is not null").withColumn("html", F.lit('<link rel="canonical" href="http://h/same">'))
    assert [r.url for r in pages.one_per_id(pages.documents(same, at=F.lit("2024-01-01").cast("timestamp"))).collect()] == ["http://u@h:8/a/b"]


def test_links(spark):
    page = """<ul id="w"><li>A<ul><li><strong><em>(under review)</em></strong> <a href="/x">x</a></li><li><a href=" ">blank</a></li><li><a>none</a></li>
    <li><a href="y#z">y</a><em><strong>( )</strong></em></li><li><a href="/x">again</a></li></ul></li></ul><ul><li><ul><li><a href="/other">o</a></li></ul></li></ul>"""
    rows = spark.createDataFrame([("http://h/a/", page), ("http://h/b/", None)], "url string, html string")
    got = [(r.place, r.url, r.state) for r in pages.links(rows, list_id="w").orderBy("place").collect()]
    assert got == [(0, "http://h/x", "under review"), (1, "http://h/a/y#z", None)]
    assert {r.url for r in pages.first_seen(pages.links(rows)).collect()} == {"http://h/x", "http://h/a/y#z", "http://h/other"}
    assert html.links("http://h/", "<ul><li><a href='q'>q</a></ul>", nested=False) == [{"url": "http://h/q", "state": None}]


def test_json_objects(spark):
    good = '{"a": 1}'
    said = [good, f"```json {good} ```", f"Yes: {good} indeed", f"```json {good}", "none", "{bad", "{'a': 1}", None]
    assert values(spark, lambda x: X.json_text(X.json_object(x), "$.a"), said) == ["1"] * 4 + [""] * 4
    assert values(spark, lambda x: X.json_object(x).isNull(), said) == [False] * 4 + [True] * 4
    odd = ['{"a": 0}', '{"a": false}', '{"a": true}', '{"a": "0"}', '{"a": " x  y "}', '{"a": null}', '{"b": 1}', '{"a": 0.0}', '{"a": 1.5}']
    assert values(spark, lambda x: X.json_text(X.json_object(x), "$.a"), odd) == ["", "", "True", "0", "x y", "", "", "", "1.5"]


def test_extraction(spark):
    answer = json.dumps({"entities": ["text", {"name": " A  b ", "type": "people", "aliases": ["x", "", 5]}, {"name": ""}, {"name": "C"}, {"name": "D"}], "dates": "none", "relationships": [{"source_entity": "c", "target_entity": "D"}, {"source_entity": "C", "target_entity": "A b"}, {"source_entity": "C", "target_entity": "gone"}, {"source_entity": "C"}], "significance": " s "})
    dated = json.dumps({"entities": [], "dates": [{"value": "2020", "label": "l", "certainty": True}, {"value": " "}]})
    said = spark.createDataFrame([("c1", "d", answer), ("c2", "d", dated), ("c3", "d", "no")], "chunk_id string, doc_id string, response string")
    read = extraction.parsed(said)
    found, on_dates = extraction.entities(read), extraction.dates(read)
    nodes = extraction.entity_nodes(found, on_dates)
    assert {(r.name, r.type, tuple(r.aliases)) for r in nodes.collect()} == {("A b", "Person", ("x", "5")), ("C", "Concept", ()), ("D", "Concept", ()), ("2020", "Date", ())}
    assert extraction.mentions(found).count() == 3 and [(r.label, r.certainty) for r in extraction.date_mentions(on_dates).collect()] == [("l", "True")]
    assert [r.relation_type for r in extraction.related(extraction.relations(read), nodes).collect()] == ["RELATED_TO"]
    chunks = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chunk_id string")
    assert {r.chunk_id: (r.significance, r.extract_model) for r in extraction.marked_done(chunks, read, "m", F.lit("t")).collect()} == {"c1": ("s", "m"), "c2": ("", "m"), "c3": (None, None)}


def test_hooks(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in enumerate(["aa", "b", " ", None, "fail", "bad"])], "chunk_id int, text string")
    assert {r.chunk_id: list(r.vector) for r in hooks.embed(chunks.where("chunk_id < 2"), lambda ts: [[float(len(t))] for t in ts], 1).collect()} == {0: [2.0], 1: [1.0]}
    with pytest.raises(Exception, match="texts gave"):
        hooks.embed(chunks.where("chunk_id < 2"), lambda ts: []).collect()

    def model(prompt):
        if "fail" in prompt:
            raise OSError("gone")
        return "no" if "bad" in prompt else "{}"

    got = {r.chunk_id: (r.attempts, r.status) for r in hooks.generate(chunks, model, F.concat(F.lit("p "), F.col("text")), lambda a: a == "{}").collect()}
    assert got == {0: (1, "ok"), 1: (1, "ok"), 2: (0, "ok"), 3: (0, "ok"), 4: (1, "llm_fail"), 5: (3, "bad_json")}


def test_backlogs(spark):
    chunks = spark.createDataFrame([("a", "x", [], None), ("b", "x", [1.0], None), ("c", " ", None, None), ("d", "x", None, "t")], "chunk_id string, text string, embedding array<float>, extracted_at string")
    assert [r.chunk_id for r in G.embed_backlog(chunks).orderBy("chunk_id").collect()] == ["a", "d"]
    links = spark.createDataFrame([("s", x) for x in "abd"] + [("t", "c"), ("t", "a")], "section_id string, chunk_id string")
    sections, docs = spark.createDataFrame([("s", "D"), ("t", "E")], "section_id string, doc_id string"), spark.createDataFrame([("D",)], "doc_id string")
    done = spark.createDataFrame([("b",), ("b",)], "chunk_id string")
    assert [tuple(r) for r in G.extract_backlog(chunks, links, sections, docs, done).collect()] == [("a", "D", "x")]
    new = spark.createDataFrame([("a", [2.0]), ("z", [1.0])], "chunk_id string, vector array<float>")
    assert {r.chunk_id: (r.embedding, r.embedding_model) for r in G.with_embeddings(chunks, new, "m", F.lit("t")).collect()}["a"] == ([2.0], "m")


def test_reference_filter(spark):
    rows = spark.createDataFrame([(None, None, "1-1", "x"), ("6000", "6000-1", "6000-1", ""), ("6000", "6000-1", "6000-2", "on 6000-1"), ("6000", "6000-1", "6000-2", None), ("6000", None, "6000-2", None), ("6000", None, None, "in 6000"), ("6000", None, "60001", "x")], "base string, full string, number string, title string")
    assert [r[0] for r in rows.select(S.of_reference(*(F.col(c) for c in rows.columns))).collect()] == [True, True, True, False, True, True, False]


def test_question_rewrite(spark):
    q = spark.createDataFrame([(1, "What does  the RULE 60001 say about leave?"), (2, "RULE 6002"), (3, "is it"), (4, None)], "q_id int, question string")
    got = {r.q_id: (r.clean_query, r.ref_base, r.ref_full) for r in q.select("q_id", *(c.alias(k) for k, c in X.rewrite_question(F.col("question"), "RULE").items())).collect()}
    assert got == {1: ("RULE 6000-1 rule leave", "6000", "6000-1"), 2: ("RULE 6002 rule", "6002", None), 3: ("is it", None, None), 4: ("", None, None)}
    assert {r.q_id: r.words for r in S.asked(q, "RULE").collect()} == {1: ["rule", "leave"], 2: ["rule"]}


def test_texts(spark):
    assert values(spark, X.without_ellipsis, [" a ...", "a…", "a"]) == ["a", "a", "a"]
    assert values(spark, X.state_text, ["(under review)", " x ", "( )", "", None]) == ["under review", "x", None, None, None]
    assert values(spark, lambda x: X.truncate(x, 3), ["ab cd", "ab", None]) == ["ab", "ab", None]
    assert values(spark, lambda x: X.prompt("Q {{x}} {q}!", q=x), ["a", None]) == ["Q {x} a!", "Q {x} !"]
    hit = lambda x: F.array(*(X.whole_word(X.spaced(x), F.lit(w)) for w in ("red", "e-mail", "-x")))
    assert values(spark, hit, ["Red hired", "red-hot", "hired", "an E-mail.", "e - mail", "a -x", "a-x", "éred"]) == [[True, False, False], [True, False, False], [False] * 3, [False, True, False], [False] * 3, [False, False, True], [False] * 3, [False] * 3]


def test_vector_top_equals_plain_form(spark):
    import random

    rng = random.Random(4)
    rows = [(f"c{k}", [rng.choice((0.0, 0.5, 1.0)) for _ in range(3)]) for k in range(300)] + [("none", None), ("empty", [])]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").where("chunk_id not like 'c1%' or true").repartition(7)
    chunks = chunks.where("embedding is null or size(embedding) = 0 or exists(embedding, x -> x > 0)")
    queries = spark.createDataFrame([(k, [rng.random() for _ in range(3)]) for k in range(5)] + [(9, None)], "q_id int, embedding array<float>")
    got = S.vector_top(chunks, queries, 7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.cosines(chunks, queries, 7).collect())) and len(got) == 35
    assert S.vector_top(chunks, queries.limit(0)).count() == S.vector_top(chunks.limit(0), queries).count() == 0


def test_entity_ranker(spark):
    entities = spark.createDataFrame([(1, "Small Ring", ["band"]), (2, "Cog", ["ring", "RING small"]), (3, "none", None)], "entity_id int, name string, aliases array<string>")
    mentions = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2), ("c", 3)], "chunk_id string, entity_id int")
    chunks = spark.createDataFrame([("a", "x"), ("b", "a small thing"), ("c", "ring")], "chunk_id string, text string")
    asked = S.asked(spark.createDataFrame([(1, "small ring")], "q_id int, question string"), most=12)
    got = [(r.chunk_id, r.score, r.matched_entities) for r in S.entity_rank(entities, mentions, chunks, asked).orderBy("rank").collect()]
    assert got == [("a", 40, ["Cog", "Small Ring"]), ("b", 21, ["Cog"])]


def test_rankers_compared(spark):
    one = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q_id int, chunk_id string, rank int")
    got = {r.chunk_id: (r.retrievers, r.best_rank) for r in S.compared({"x": one, "w": one.where("rank = 2")}).collect()}
    assert got == {"a": (["x"], 1), "b": (["w", "x"], 2)}
    with pytest.raises(ValueError, match="unknown retriever"):
        S.chosen({"x": one}, "y")


def test_fusion(spark):
    lists = lambda rows: spark.createDataFrame([(1, c, s, k) for k, (c, s) in enumerate(rows, 1)], "q_id int, chunk_id string, score double, rank int")
    vec, ft = lists([("a", 0.9), ("b", 0.8)]), lists([("b", 5.0), ("c", 4.0)])
    got = [(r.chunk_id, r.score) for r in S.rrf(vec, ft).orderBy("rank").collect()]
    assert got == [("b", round(1 / 62 + 0.8 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(0.8 / 62, 9))]
    assert [r.score for r in S.min_max(lists([("a", 2.0)])).collect()] == [1.0]


def test_fusion_counts_keyword_hits(spark):
    lists = lambda rows: spark.createDataFrame([(q, c, 0.5, k) for q, cs in rows.items() for k, c in enumerate(cs, 1)], "q_id int, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([("a", "no word"), ("b", "Leave policy, leave"), ("c", "leaves"), ("d", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, ["leave", "policy"])], "q_id int, words array<string>")
    got = [(r.q_id, r.chunk_id, r.score) for r in S.rrf(lists({1: ["a", "c", "x"], 2: ["b"]}), lists({1: ["d", "b"]}), chunks, asked).orderBy("q_id", "rank").collect()]
    assert got == [(1, "b", round(0.8 / 62 + 0.3, 9)), (1, "a", round(1 / 61, 9)), (1, "c", round(1 / 62, 9)), (1, "x", round(1 / 63, 9)), (1, "d", round(0.8 / 61, 9)), (2, "b", round(1 / 61, 9))]


def test_expand_and_context(spark):
    chunks = spark.createDataFrame([(k, "s" if k != 3 else "t", at, "T", "text") for k, at in enumerate([0, 4000, 4001, 0, None])], "chunk_id int, section_id string, start_char int, section string, text string")
    hits = spark.createDataFrame([(1, 0, 1)], "q_id int, chunk_id int, rank int")
    assert {r.chunk_id for r in K.expand(hits, chunks).collect()} == {0, 1}
    assert K.context(hits, chunks).first()["context"].startswith("Section: T\n[chunk_id=0]\ntext")
    # Hits without a section or a place, or that are no chunks, stay.
    more = spark.createDataFrame([(1, 4, 2), (1, 99, 3), (1, 1, 4)], "q_id int, chunk_id int, rank int")
    assert {(r.chunk_id, r.seed_rank) for r in K.expand(hits.union(more), chunks).collect()} == {(0, 1), (1, 1), (4, 2), (99, 3), (2, 4)}
    around = {r.chunk_id: r.siblings for r in K.siblings(chunks, 2, "start_char").collect()}
    assert around == {0: [0, 1], 1: [0, 1, 2], 2: [1, 2], 3: [3], 4: [4]}
    # A blank text uses up its place; long ones are cut; headers take what there is.
    texts = spark.createDataFrame([(1, "", "x" * 1601), (2, "S", " \t\n"), (3, "S", "third"), (4, " ", "fourth")], "chunk_id int, section string, text string")
    ranked = spark.createDataFrame([(1, 1, 1, "Title", ""), (1, 2, 2, "", ""), (2, 4, 1, "", "6000-1"), (2, 3, 2, "", None)], "q_id int, chunk_id int, rank int, doc_title string, ref_number string")
    got = {r.q_id: r.context for r in K.context(ranked, texts, 2, joint=" | ").collect()}
    assert got == {1: "Title\n[chunk_id=1]\n" + "x" * 1600, 2: "6000-1\n[chunk_id=4]\nfourth\n\nSection: S\n[chunk_id=3]\nthird"}


def test_hydration(spark):
    chunks = spark.createDataFrame([("a", "s", "own"), ("b", "none", "own"), ("c", None, None)], "chunk_id string, section_id string, section string")
    sections = spark.createDataFrame([("s", "d", "Scope")], "section_id string, doc_id string, title string")
    docs = spark.createDataFrame([("d", "Doc", "6000-1")], "doc_id string, title string, ref_number string")
    hits = spark.createDataFrame([(1, "a", " "), (1, "b", "kept"), (1, "c", None), (2, "z", "")], "q_id int, chunk_id string, doc_title string")
    got = {r.chunk_id: (r.doc_title, r.ref_number, r.section_title) for r in K.hydrated(hits, chunks, sections, docs).collect()}
    assert got == {"a": ("Doc", "6000-1", "Scope"), "b": ("kept", "", "own"), "c": ("", "", ""), "z": ("", "", "")}


def test_replayed_batches(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.batch_stream(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_later_batches_win(spark, tmp_path):
    at = {x: str(tmp_path / x) for x in ("in", "out", "ck")}
    for v in (1, 2):
        spark.createDataFrame([("a", v), ("b" if v == 1 else "c", v)], "id string, v int").write.mode("append").parquet(at["in"])
        incremental.batch_stream(spark.readStream.schema("id string, v int").parquet(at["in"]), at["out"], at["ck"]).awaitTermination()
    assert {tuple(r) for r in incremental.current(spark, at["out"], ["id"]).collect()} == {("a", 2), ("b", 1), ("c", 2)}
