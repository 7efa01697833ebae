"""The registered queries over awkward and over empty tables, and the pipeline against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from quire.llm import byte_bpe, decontaminate, ngram_join, substrings
from quire.llm.queries import QUERIES

COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_spot_signatures": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op3_host_reputation": "page_id host path rule verdict",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_language_id": "doc_id held_out lang_pred score",
    "op7_ngram_join": "doc_id n_shingles component_id",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_token_files": "doc_id start n_tokens ids_crc32",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_chosen_paths": "doc_id n_shingles component_id kept",
    "op13_hard_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, h string, id int, score double, shard int"


def written(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with null and repeated ids, null, empty and long texts, ties and clashing columns; and one of empty tables."""
    rng, at, none = random.Random(3), str(tmp_path_factory.mktemp("odd")), str(tmp_path_factory.mktemp("none"))
    line = lambda n: " ".join(rng.choice(("the", "of", "und", "der", "w1", "w2", "w3", "w4", "w5", "w6")) for _ in range(n))
    docs = [(k, line(40), "en" if k % 2 else "de") for k in range(40)] + [(None, line(9), None), (None, None, "en"), (None, "", None), (7, line(30), "en"), (100, None, None), (101, "", "en"), (102, "12 !? \n", "en"), (103, line(60_000), "en"), (104, "x" * 50_000, "de")]
    docs += [docs[3], docs[3], (105, docs[4][1], "de")]
    for where, some in ((at, True), (none, False)):
        keep = lambda rows: rows if some else []  # noqa: E731, B023
        written(spark, where, "documents", keep([(*r, f"s{k}", 0, "x", 1, 0.5, 3) for k, r in enumerate(docs)]), DOCUMENTS)
        written(spark, where, "labels", keep([(k, k % 2, int(k % 3 == 0)) for k in range(40)] + [(3, 1, 1), (None, 1, 1), (5, None, None)]), "doc_id long, quality int, toxic int")
        written(spark, where, "benchmark", keep([(1, docs[2][1]), (1, docs[2][1]), (2, "w1 w2"), (3, None), (None, "w9")]), "item_id long, text string")
        vectors = [(k, [k / 64, 1.0 - k % 3], k % 3) for k in range(220)] + [(None, [1.0, 1.0], 1), (300, None, 1), (301, [None, 1.0], 1), (302, [1.0, 1.0], None), (100, [100 / 64, 0.0], 1)]
        written(spark, where, "embeddings", keep([(*v, 1, "x") for v in vectors]), "vec_id long, embedding array<float>, label int, lane int, id string")
        written(spark, where, "pages", keep([(1, "http://a.b.net/en/x?q", "h"), (1, "http://a.b.net/en/x?q", "h"), (None, None, None), (2, "no", ""), (3, "HTTP://EXAMPLE.com/de/", "x")]), "page_id long, url string, html string")
    return at, none, docs


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, name):
    at, none, docs = tables
    out = QUERIES[name](spark, at)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = out.collect()
    if name.startswith("op13"):
        assert {r.anchor_id for r in rows} == {0, 100, 200} - ({0} if not any(r.anchor_id == 0 for r in rows) else set())
        assert all(80 * r.positive_score <= 100 * r.negative_score <= 100 * r.positive_score for r in rows)
    else:
        assert len(rows) == (5 if name.startswith("op3") else len(docs))
    if "held_out" in out.columns:
        of, rest = (5, 0) if name.startswith("op1") else (4, 2)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in rows)
    if name.startswith("op8"):
        assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and any(r.over_limit for r in rows)
    key = out.columns[0]
    by_id = {}
    for r in rows:
        by_id.setdefault(r[key], []).append(r)
    if name not in ("op3_host_reputation", "op2_spot_signatures", "op10_token_files", "op11_merkle_manifest", "op13_hard_negatives"):
        # Rows that repeat id and text have equal results.
        assert len({tuple(r) for r in by_id[3]}) == 1 and len(by_id[3]) == 3
    assert QUERIES[name](spark, none).count() == 0


def test_counts_from_one_cache(spark, tables, tmp_path):
    """The query over a cache that an earlier run filled encodes nothing, and over a fuller table only what is new."""
    at, none, docs = tables
    cache = str(tmp_path / "cache")
    assert QUERIES["op8_token_counts"](spark, none, cache).count() == 0
    runs = []
    for _ in range(2):
        runs.append(sorted(map(repr, QUERIES["op8_token_counts"](spark, at, cache).collect())))
        assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in docs})
    assert runs[0] == runs[1] == sorted(map(repr, QUERIES["op8_token_counts"](spark, at).collect()))


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)] + ["der", "the"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = line(55), line(30)
    base = line(120).split()
    texts = [None, "", "12 34 !?", "one two"] + [line(50) for _ in range(12)] + [f"{line(8)} {passage} {line(20)}" for _ in range(4)] + [f"{line(5)} {item} {line(9)}", f"{line(900)} {item}", passage]
    for k in range(8):
        near = list(base)
        near[10 * k] = f"n{k}"
        texts.append(" ".join(near))
    texts += texts[6:9]
    rows = [(3 * k, t, ("en", "de", None)[k % 3], "s", len(t or "")) for k, t in enumerate(texts)]
    items = [(1, item), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    written(spark, tmp_path, "benchmark", items, "item_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = {k: t for k, t, *_ in rows if any(map(str.isalpha, t or ""))}
    components = ngram_join.brute_force(list(docs.items()))
    docs = {k: t for k, t in docs.items() if components[k][1] == k}
    removed = substrings.brute_force(list(docs.items()))
    first: dict[tuple, tuple[int, int]] = {}
    for k in sorted(docs):
        w = docs[k].split()
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (k, i))
    for k in list(docs):
        w = docs[k].split()
        gone = {j for i in range(len(w) - 19) if first[tuple(w[i : i + 20])] < (k, i) for j in range(i, i + 20)}
        assert removed[k][1] == len(gone)
        if gone:
            docs[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
        if w and len(gone) == len(w):
            del docs[k]
    judged = decontaminate.brute_force(list(docs.items()), items)
    docs = {k: t for k, t in docs.items() if not judged[k][4]}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    ids = {k: known.encode_ordinary(t) for k, t in docs.items()}
    assert got == {k: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(docs[k].encode()).hexdigest()) for k, x in ids.items()}
    # Every stage did something: junk, copies, a text that is a passage, one with an item.
    assert 0 < len(got) < len(rows) - 10
