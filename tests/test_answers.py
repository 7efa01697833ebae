"""Chunks as arrays, blanks at both ends, and contexts that leave the other texts where they stand."""

import re

from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators import chunks as C
from quire.operators import context as K


def test_hits_come_to_the_texts(spark):
    texts = spark.createDataFrame([(k, "S", f" t{k} " if k % 2 else " \n") for k in range(40)], "chunk_id int, section string, text string")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 4, 1), (3, 3, 9)], "q_id int, chunk_id int, rank int")
    got = K.context(hits, texts)
    assert {r.q_id: r.context for r in got.collect()} == {1: "Section: S\n[chunk_id=1]\nt1"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    assert not re.search(r"Filter .*regexp_replace", plan)


def test_strip_and_chunks(spark):
    odd = ["", " \t\n", " a b \n", "a\u0085", "\U0001f600 x\r\n", "\n" * 50 + "y" + " " * 50, "a\nb", None]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", strip(F.col("x")).alias("y"))
    assert [(r.x, r.y) for r in rows.collect()] == [(x, x and x.strip()) for x in odd]
    docs = [(k, [("t", text)]) for k, text in enumerate(["word " * 900, " ", "\U0001f600 " * 700, "é"])]
    docs = spark.createDataFrame(docs, "doc_id int, sections array<struct<title:string,text:string>>")
    got = sorted((r.doc_id, r.chunk_index, r.start_char, r.end_char, r.text) for r in C.chunk(C.sections(docs)).collect())
    whole = {0: ("word " * 900).strip(), 2: ("\U0001f600 " * 700).strip(), 3: "é"}
    assert got == [(k, i, a, b, t[a:b]) for k, t in whole.items() for i, (a, b) in enumerate(C.spans(t))]
    assert C.chunk(C.sections(docs.where("doc_id = 1"))).collect() == []
