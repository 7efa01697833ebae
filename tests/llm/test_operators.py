"""Each operator against brute force or a library, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import byte_bpe, decontaminate, host_reputation, language, ngram_join, spot_signatures, substrings, token_counts, token_files, toxicity, wordmemo
from quire.llm.common import new_dir
from quire.llm.library_tokens import byte_level, word_level

WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and", "la", "der", "die"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared, base = line(60), line(300).split()
    out = [None, "", " \n", "one two", "x" * 3000, line(5000), "日本語 テスト", "A\u00a0B  c\x1cd"]
    for k in range(30):
        near = list(base)
        near[rng.randrange(300)] = f"n{k}"
        out += [line(40), f"{line(10)}\n{shared} {line(10)}", " ".join(near)]
    return out + out[20:24] + [shared]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "en" if k % 2 else None, "s", 1, "z", 3) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, h string, id int").repartition(3)


def pairs(texts):
    return list(enumerate(texts))


def test_decontaminate(spark, docs, texts):
    items = [(1, " ".join(texts[8].split()[5:30])), (2, "w1"), (3, None), (4, "the of"), (5, " ".join(texts[-1].split()[:13]))]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (10, 10_000):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(docs, table, block_words=block).collect()}
        assert got == decontaminate.brute_force(pairs(texts), items)
    repeated = [(0, "b " * 40 + "a " * 30_000), (1, "a"), (2, "a " * 13), (3, "c b b"), (None, "b c b b")]
    items = [(1, "a " * 3_000), (2, "b b"), (2, "b b"), (None, "c b"), (4, "b"), (None, None)]
    tables = [spark.createDataFrame(rows, f"{name}_id long, text string, n_words int, spans string") for name, rows in (("doc", [(*r, 1, "s") for r in [*repeated, repeated[3]]]), ("item", [(*r, 1, "s") for r in items]))]
    for block in (10, 10_000):
        got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(*tables, block_words=block).collect()}
        assert got == decontaminate.brute_force(repeated, items)
    cut = {r.id: (r.text, r.removed) for r in decontaminate.remove_spans(*tables).collect()}
    assert cut[1] == ("a", 0) and cut[3][1] == 3 and cut[None][0].strip() == ""
    cut = {r.id: r.text for r in decontaminate.remove_spans(docs, table.where("item_id = 5")).collect()}
    assert texts[-1].split()[0] not in (cut[len(texts) - 1] or "").split()[:1] and cut[3] == "one two"


def test_substrings(docs, texts):
    for size in (1 << 20, 64):
        got = {r.doc_id: tuple(r)[1:] for r in substrings.report(docs, filter_bytes=size).collect()}
        assert got == substrings.brute_force(pairs(texts))


def test_substrings_of_shared_ids(spark, shared_ids):
    rows, docs = shared_ids
    key = docs.select(F.coalesce("doc_id", F.lit(substrings.NO_ID)), F.xxhash64("text"), "text").distinct().collect()
    number = {(k, t): i for i, (k, _, t) in enumerate(sorted(key, key=lambda r: r[:2]))}
    known = substrings.brute_force([(i, t) for (_, t), i in number.items()])
    own = [known[number[substrings.NO_ID if k is None else k, t]] for k, t in rows]
    for most in (10_000, 0):
        for size in (1 << 20, 64):
            substrings.MOST_REUSED, before = most, substrings.MOST_REUSED
            try:
                got = substrings.dedup(docs, filter_bytes=size, carry=("source",)).collect()
            finally:
                substrings.MOST_REUSED = before
            got = {int(r.carried.source[1:]): (r.carried.doc_id, r.n_words, r.n_removed, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in got}
            assert got == {i: (k, *x) for i, ((k, _), x) in enumerate(zip(rows, own, strict=True))}


def test_ngram_join(docs, texts):
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs).collect()}
    assert got == ngram_join.brute_force(pairs(texts))


@pytest.fixture(scope="module")
def shared_ids(spark, texts):
    """(id, text) rows: null and reused ids with different texts, near copies and equal rows among them."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9], (3, texts[8]), (500, None), (500, "")]
    return rows, spark.createDataFrame([(k, t, "en", f"s{i}", 0) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_ngram_join_of_shared_ids(shared_ids):
    rows, docs = shared_ids
    low = lambda k: ngram_join.NO_ID if k is None else k
    root = ngram_join.brute_force([(i, t) for i, (_, t) in enumerate(rows)])
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i][1]] = min(low(k), least.get(root[i][1], low(k)))
    want = sorted((low(k), root[i][0], least[root[i][1]]) for i, (k, _) in enumerate(rows))
    assert sorted((low(r.id), r.n_shingles, low(r.component_id)) for r in ngram_join.linked(docs).collect()) == want


def test_pipeline_stages_of_shared_ids(spark, texts):
    rows = [(None, texts[8], "en", "a"), (None, texts[11], "en", "b"), (None, texts[11], "en", "c"), (4, texts[11], "en", "d"), (5, texts[14], "de", "e"), (5, texts[17], "en", "f"), (6, texts[10], "en", "g"), (9, texts[13], "en", "h"), (7, texts[10], "en", "i"), (None, None, "en", "j"), (None, " ", "en", "k"), (8, "", "en", "l"), (8, "", "en", "m"), (6, texts[16], "en", "n")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    # Near copies, all of one cluster, are texts 10, 13 and 16; the least digest decides between two of the same id.
    near = min((texts[10], texts[16]), key=lambda t: hashlib.md5(t.encode()).digest())
    want = [(None, texts[8]), (None, texts[11]), (5, texts[14]), (5, texts[17]), (6, near), (None, None), (None, " "), (8, "")]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=order) == sorted(want, key=order)
    assert next(r.lang for r in got if r.text == texts[14]) == "de"
    distinct = [("a", texts[8], "x"), ("b", texts[11], "y"), ("c", texts[14], "z")]
    docs = spark.createDataFrame([(None, t, lang, source, 0) for source, t, lang in distinct], docs.schema)
    got = corpus_pipeline.without_repeats(spark, docs, "").collect()
    assert sorted((r.source, r.lang) for r in got) == [("a", "x"), ("b", "y"), ("c", "z")] and all(r.doc_id is None for r in got)
    assert {r.source: set((r.text or "").split()) <= set(t.split()) for r in got for s, t, _ in distinct if s == r.source} == {"a": True, "b": True, "c": True}


def test_byte_bpe(docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in byte_bpe.digests(docs, path).collect():
        ids = known.encode_ordinary(texts[r.id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.id] or "").encode()).hexdigest())
    back = {r.id: bytes(r.data).decode() for r in byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()}
    assert back == {k: t or "" for k, t in pairs(texts)}


@pytest.mark.parametrize(("file", "tokens"), [("byte_bpe_50k.json", byte_level), ("word_bpe_49k.json", word_level)])
def test_library_tokens(file, tokens, texts):
    path = public_tokenizers.path(file)
    known, rng = Tokenizer.from_file(path), random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "'s", "12", "½", "日本", "\x1c", "\x85", "\u2003", "ing", "!?", "\r\n", "<|endoftext|>", "Σ"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(800)] + texts
    assert [x.tolist() for x in tokens(path)(pa.array(odd, pa.string()))] == [known.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_token_counts(spark, docs, texts):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), new_dir(spark, "cache")
    known = Tokenizer.from_file(path)
    for _ in range(2):
        got = {r.id: (r.n_bytes, r.n_tokens) for r in token_counts.with_counts(docs, path, cache).collect()}
        assert got == {k: (len((t or "").encode()), len(known.encode(t or "", add_special_tokens=False).ids)) for k, t in pairs(texts)}
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts})


def test_token_files(spark, docs, texts):
    path, at = public_tokenizers.path("byte_bpe_50k.json"), new_dir(spark, "files")
    token_files.write_shards(docs, path, at, shard_bytes=500, part_bytes=3000)
    shards = spark.read.parquet(f"{at}/shards").collect()
    assert len({r.part for r in shards}) > 4 and any(r.place > 1 for r in shards)
    assert all(int(token_files._LENGTHS[list(r.control)].reshape(-1)[: r.n_ids].sum(dtype=int)) == len(r.data) for r in shards)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_shards(spark, at).collect()}
    known, start = Tokenizer.from_file(path), 0
    for k, t in pairs(texts):
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[k] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_one_id_in_many_shards(spark):
    path, at = public_tokenizers.path("byte_bpe_50k.json"), new_dir(spark, "files")
    texts = [f"row {k} of one id " * (1 + k % 7) for k in range(300)]
    docs = spark.createDataFrame([(None if k % 2 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    token_files.write_shards(docs, path, at, shard_bytes=400, part_bytes=1000)
    assert spark.read.parquet(f"{at}/shards").where("n_docs > 0").select("part").distinct().count() > 4
    got = sorted(token_files.read_shards(spark, at).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None] * 150 + [5] * 150
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(300)]
    known = Tokenizer.from_file(path)
    want = [zlib.crc32(np.array([*known.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts]
    assert sorted(r.ids_crc32 for r in got) == sorted(want)


def test_token_ids_of_sliced_blocks():
    """Texts that go to the library whole, in a block that is a slice of a batch."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["before é", None, "one\u00a0two", "it's <|endoftext|> here", "", "日本語 x", None, "last\u2003one é", "plain text"]
    known, tokens = Tokenizer.from_file(path), byte_level(path)
    for at in range(len(texts)):
        values, cut = tokens.block(pa.array(texts).slice(at))
        got = [values[a:b].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        assert got == [known.encode(t or "", add_special_tokens=False).ids for t in texts[at:]]


def test_units_that_share_a_hash(monkeypatch):
    """Units whose first hashes agree keep results of their own, within a block and between blocks."""
    real = wordmemo.byte_hashes
    monkeypatch.setattr(wordmemo, "byte_hashes", lambda *a, way=0, **k: real(*a, way=way, **k) if way else real(*a, **k) % np.uint64(5))
    memo = wordmemo.WordMemo(lambda units: wordmemo.ragged([list(u) for u in units]), gaps=False)
    rng = random.Random(2)
    for _ in range(6):
        texts = [" ".join(rng.choice(("ab", "ba", "abc", "cab", "x", "yy", "zz", "w1", "w2")) for _ in range(rng.randrange(9))) for _ in range(12)]
        values, cut = memo.look_up(pa.array([*texts, None])).joined()
        assert [bytes(values[a:b].tolist()).decode() for a, b in zip(cut[:-1], cut[1:], strict=True)] == [t.replace(" ", "") for t in texts] + [""]
    assert 0 < len(memo.keys) <= 5 and len(set(memo.keys.tolist())) == len(memo.keys)


def test_pack_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], np.uint32)
    cut = np.array([0, 0, 3, 7])
    control, data, _, _ = token_files.pack(values, cut)
    assert token_files.unpack(control, data, np.diff(cut)).tolist() == values.tolist()


def test_language(spark):
    rows = [(k, t, lang) for k in range(40) for t, lang in ((f"the house and the river {k}", "en"), (f"das haus und der fluss {k}", "de"))]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the rivers"), (2, "die häuser und flüsse"), (3, None), (4, "12 !?"), (5, "")], "doc_id long, text string")
    assert {r.id: r.lang_pred for r in language.predict(asked, model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und"}


def test_toxicity(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(60)), k % 4 == 0) for k in range(400)]
    rows = [(k, t.replace(" w1", " scoundrel w1", 3) if bad else t, int(bad)) for k, t, bad in rows]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, bad) for k, _, bad in rows], "doc_id long, toxic int")
    got = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs.where("doc_id < 300"), labels.where("doc_id < 300"))).collect()}
    assert sum((got[k] >= 0.5) == bool(bad) for k, _, bad in rows[300:]) >= 95
    assert got[900] == got[901] < 0.5


def test_toxicity_of_phrases(spark):
    rng = random.Random(6)
    # Only the order of common words tells these documents apart.
    phrases = [" ".join(rng.sample(WORDS, 8)) for _ in range(4)]
    text = lambda bad: " ".join(rng.choice(phrases) if bad and k in (2, 5) else rng.choice(WORDS) for k in range(60))
    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, bad) for k, _, bad in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 300"), labels.where("doc_id < 300"))
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[k] >= 0.5) == bool(bad) for k, _, bad in rows[300:]) >= 95


def test_toxicity_of_rare_words(spark):
    rng = random.Random(8)
    # Toxic words share a stem, and nearly each of them occurs in a few documents only.
    plain = lambda: "".join(rng.choice("rstvwxz") + rng.choice("aeiou") for _ in range(3))
    rows = [(k, " ".join("glumpo" + plain()[:3] if k % 4 == 0 and j in (9, 30, 50) else plain() for j in range(60)), int(k % 4 == 0)) for k in range(800)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(k, bad) for k, _, bad in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 600"), labels.where("doc_id < 600"))
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert sum((got[k] >= 0.5) == bool(bad) for k, _, bad in rows[600:]) >= 190


def test_toxicity_query_columns_and_edges(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(40)) + (" scoundrel" * (k % 3 == 0)), k % 3 == 0) for k in range(120)]
    rows += [(None, "w1 w2", False), (7, rows[7][1], False), (500, None, False), (501, "", False), (502, "w1 " * 60_000, False)]
    spark.createDataFrame([(k, t, 1, "x") for k, t, _ in rows], "doc_id long, text string, score int, toxic string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(bad)) for k, _, bad in rows] + [(3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity.op1_toxicity(spark, str(tmp_path))
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(out.select("doc_id", F.lit("w").alias("text")), none)
    assert max(r.score for r in toxicity.score(spark.read.parquet(str(tmp_path / "documents.parquet")), model).collect()) < 1e-5


def test_spot_signatures(spark, docs, texts):
    _, found = spot_signatures.near_pairs(docs, 0.75)
    sets = {r.id: r for r in docs.select(F.col("doc_id").alias("id"), spot_signatures.signatures(F.coalesce("text", F.lit(""))).alias("sigs")).withColumn("f", spot_signatures.fingerprint("sigs")).collect()}
    own = {r.f: set(r.sigs) for r in sets.values()}
    prints = sorted(own)
    want = {frozenset((a, b)) for i, a in enumerate(prints) for b in prints[:i] if len(own[a] & own[b]) >= 0.75 * len(own[a] | own[b])}
    assert {frozenset((r.a, r.b)) for r in found.collect()} == want
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sigs", spot_signatures.signatures(F.col("text")))
    following = {r.id: r.next_text for r in spot_signatures.with_next(rows).collect()}
    assert following == {k: texts[k - 1] or "" for k in range(len(texts))}


def test_hosts(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.Example.NET/en/x?y#z"), (2, "http://example.com/de/"), (3, None), (4, "no url"), (5, "http://b.org/fr/"), (6, "x://net")], "page_id long, url string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, spark.createDataFrame([(1, 1)], "id long, bad int")).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[3][:3] == got[4][:3] == ("", "", None) and got[6][:3] == ("net", "", None)
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.com",), ("com",), ("",)], "host string")
    found = hosts.select(*host_reputation.domain_and_suffix(F.col("host"), ("co.uk",))).collect()
    assert [tuple(r) for r in found] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("b.com", "com"), ("com", "com"), ("", "")]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert ngram_join.linked(none).count() == substrings.report(none).count() == 0
    assert decontaminate.report(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert language.predict(docs, language.fit(none)).where("lang_pred <> 'und'").count() == 0
    at = new_dir(spark, "files")
    token_files.write_shards(none, public_tokenizers.path("byte_bpe_50k.json"), at)
    assert token_files.read_shards(spark, at).count() == 0


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


def test_long_words_of_two_letters(spark):
    """Words that polynomial hashes modulo 2**64 can't tell apart."""
    rows = [(2 * k + j, thue_morse(n, x)) for k, n in enumerate((64, 1024, 4096)) for j, x in enumerate(("ab", "ba"))]
    rows += [(100 + j, " ".join([thue_morse(1024, x)] * 25)) for j, x in enumerate(("ab", "ba"))]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    got = {r.id: r.ids_sha256 for r in byte_bpe.digests(docs, path).collect()}
    assert got == {k: hashlib.sha256(np.array(known.encode_ordinary(t), "<u4").tobytes()).hexdigest() for k, t in rows}
    for file, tokens in (("byte_bpe_50k.json", byte_level), ("word_bpe_49k.json", word_level)):
        library = Tokenizer.from_file(public_tokenizers.path(file))
        assert [x.tolist() for x in tokens(public_tokenizers.path(file))(pa.array([t for _, t in rows]))] == [library.encode(t, add_special_tokens=False).ids for _, t in rows]
    assert {r.doc_id: tuple(r)[1:] for r in substrings.report(docs).collect()} == substrings.brute_force(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs).collect()} == ngram_join.brute_force(rows)
    assert corpus_pipeline.one_of_each(spark, docs, "").count() == len(rows)


def test_ngram_join_of_hot_groups(spark):
    """Near copies of a text by few and by many edits, so that some link with the rest by way of others only."""
    rng = random.Random(11)
    base, passage = [f"b{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = []
    for k in range(160):
        near = list(base)
        for at in rng.sample(range(120), rng.choice((0, 1, 2, 3, 4, 6))):
            near[at] = f"e{rng.randrange(12)}"
        rows.append((k, " ".join(near)))
    # Texts that share a passage and little else, and such that differ in their order.
    rows += [(200 + k, " ".join(passage + [rng.choice(base[:30]) for _ in range(rng.choice((10, 20, 40)))])) for k in range(80)]
    rows += [(300 + k, " ".join(passage[k:] + passage[:k])) for k in range(0, 60, 3)] + [(400 + k, rows[5][1]) for k in range(30)]
    docs = spark.createDataFrame([*rows, (None, " ".join(base))], "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_join.linked(docs.where("doc_id is not null")).collect()}
    assert got == ngram_join.brute_force(rows)
    assert len({c for _, c in got.values()}) > 20


def test_fingerprints_of_edited_texts(spark, tmp_path, texts):
    """All columns of the query against plain Python."""
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in spot_signatures.op2_spot_signatures(spark, str(tmp_path)).collect()}
    anchors = set(spot_signatures.ANCHORS)

    def chains(text):
        ws = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        content = [(i, x) for i, x in enumerate(ws) if x not in anchors]
        after = [[x for j, x in content if j > i][: spot_signatures.CHAIN] for i, w in enumerate(ws) if w in anchors]
        found = {zlib.crc32("".join(f" {x}" for x in c).encode()) for c in after if len(c) == spot_signatures.CHAIN}
        return found or {zlib.crc32((" " + " ".join(ws) + " ").encode())}

    printed = lambda s: "".join(f"{x:08X}" for x in sorted(s))
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[k - 1][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + following[:third]
        own, other, nxt = chains(t), chains(edited), chains(following)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (printed(own), printed(other))
        assert r.near_edited == pytest.approx(len(own & other) / len(own | other)) and r.near_next == pytest.approx(len(own & nxt) / len(own | nxt))


def test_next_documents_of_uneven_ids(spark, monkeypatch):
    """Ids in clusters, far ones, many rows without an id and repeated ids: each row's next text, and even buckets."""
    monkeypatch.setattr(spot_signatures, "BUCKET", 8)
    ids = [*range(700), *range(10**15, 10**15 + 300), -(1 << 63), (1 << 63) - 1, 5, 5, 10**15] + [None] * 500
    rows = [(i, f"text {k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(7).withColumn("sigs", spot_signatures.signatures(F.col("text")))
    placed = spot_signatures.in_buckets(docs)
    tie = {r.text: r.tie for r in placed.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)
    got = spot_signatures.with_next(docs).collect()
    assert {r.text: r.next_text for r in got} == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)} and len(got) == len(rows)
    assert all(r.next_sigs for r in got)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 48
    same = spark.createDataFrame([(None, "a")] * 3 + [(2, "b")] * 2, "id long, text string").withColumn("sigs", spot_signatures.signatures(F.col("text")))
    assert sorted((r.text, r.next_text) for r in spot_signatures.with_next(same).collect()) == [("a", "a"), ("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    assert spot_signatures.with_next(same.limit(0)).count() == 0
