"""Chosen paths against brute force: groups of near copies, chains, frequent shingles, repeated rows; and their bounds."""

import random

import numpy as np
import pytest

from quire.llm import chosen_paths, ngram_join

SCHEMA = "doc_id long, text string, id int, node string, sketch int, k string"


def texts():
    rng = random.Random(11)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    WORDS = [f"w{i}" for i in range(500)]
    out = [None, "", " \n", "one", "one two", "One TWO", "one two three", "x" * 3000, line(8000)]
    # A large group of near copies of one text, near and far, and a chain of which the ends don't link.
    base = line(150).split()
    for k in range(150):
        near = list(base)
        for _ in range(rng.randrange(7)):
            near[rng.randrange(150)] = f"n{k}"
        out.append(" ".join(near))
    chain = line(120).split()
    for k in range(30):
        chain = list(chain)
        chain[4 * k % 120] = f"c{k}"
        out.append(" ".join(chain))
    # A passage that many texts share without linking, and small groups.
    passage = line(60)
    out += [f"{passage} {line(40 + k % 50)}" for k in range(120)]
    for _ in range(25):
        own = line(rng.randrange(3, 90)).split()
        for k in range(rng.randrange(1, 6)):
            near = list(own)
            near[rng.randrange(len(near))] = rng.choice(WORDS)
            out.append(" ".join(near))
    return out + out[20:40] + out[20:22] * 10


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


def components(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "n", 2, "k") for r in rows], SCHEMA).repartition(3)
    return docs, chosen_paths.near_duplicates(docs, **how)


@pytest.mark.parametrize(("levels", "small", "large"), [(chosen_paths.LEVELS, chosen_paths.SMALL, chosen_paths.LARGE), (3, 8, 16), (0, 16, 16)])
def test_equals_brute_force(spark, rows, monkeypatch, levels, small, large):
    monkeypatch.setattr(chosen_paths, "SMALL", small)
    monkeypatch.setattr(chosen_paths, "LARGE", large)
    want = ngram_join.brute_force(rows, chosen_paths.WIDTH, chosen_paths.THRESHOLD)
    got = {r.id: r for r in components(spark, rows, levels=levels)[1].collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())
    groups = {c for _, c in want.values()}
    assert 200 < len(groups) < len(rows) - 100


def test_repeated_and_missing_ids(spark):
    a, b = " ".join(f"w{k}" for k in range(60)), "other words here " * 3
    rows = [(5, a), (5, a), (5, b), (9, a + " x"), (None, b), (None, a), (7, None), (None, None)]
    found = components(spark, rows)[1].collect()
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in found), key=str)
    # Rows without an id come before all others: both groups have one.
    assert got == sorted([(5, 58, None, False)] * 2 + [(5, 3, None, False), (9, 59, None, False), (None, 3, None, True), (None, 58, None, True), (7, 0, 7, True), (None, 0, None, True)], key=str)
    assert components(spark, [])[1].count() == 0


def test_short_sets_meet_in_few_cells(spark):
    """A node of 900 short sets that are of many components is one cell; its rows don't grow with the square of their number."""
    for n, cells, rows in ((20, 1, 899 + 900), (2_000, 4, 4 * (899 + 900))):
        comp = spark.range(900).selectExpr("id", "id AS component", f"{n}L AS n")
        found = chosen_paths.undecided(spark.range(900).selectExpr("1L AS node", "id"), comp)
        assert chosen_paths.near_cells(found).select("cell").distinct().count() == cells
        assert chosen_paths.exact_cells(found).count() == rows


def test_bounds():
    assert chosen_paths.met(100, 9) == 1 and chosen_paths.met(85, 1) > 0.85 > chosen_paths.met(85, 4) > 0.6
    assert (1 - chosen_paths.met(85, chosen_paths.DEPTH)) ** chosen_paths.trees(85) <= 1 - chosen_paths.RECALL
    # Agreeing tokens follow the similarity, and linked pairs are above the bound.
    rng = np.random.default_rng(1)
    shares = []
    for _ in range(400):
        x = rng.integers(-(1 << 63), 1 << 63, 400)
        a, b = np.sort(x[:370]), np.sort(np.concatenate([x[30:]]))
        s = chosen_paths.sketches([a, b])
        shares.append((s[0] == s[1]).sum())
    assert min(shares) >= chosen_paths.least_match(85) and chosen_paths.least_match(100) == chosen_paths.COORDS
    assert abs(np.mean(shares) / chosen_paths.COORDS - 0.85) < 0.01
