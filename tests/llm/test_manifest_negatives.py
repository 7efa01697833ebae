"""The Merkle manifest, chosen paths and hard negatives against brute force, at small blocks too."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives, merkle


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_bijection(levels):
    places = [merkle.address(levels, depth, k) for depth in range(levels) for k in range(merkle.FAN**depth)]
    assert sorted(places) == list(range(merkle.nodes_of(levels)))


def test_layout_keeps_lower_subtrees_together():
    # Four levels are cut in the middle: a node of the third level and its children take 17 places in a row.
    for k in (0, 5, 255):
        children = [merkle.address(4, 3, 16 * k + j) for j in range(16)]
        assert children == list(range(merkle.address(4, 2, k) + 1, merkle.address(4, 2, k) + 17))


def leaves(rows):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_of(*fields, F.translate("text", merkle.UPPER, merkle.LOWER)))
    return rows.select("doc_id", F.col("source").alias("g"), merkle.leaf_of(*fields, F.col("text")).alias("digest"), tampered.alias("tampered"))


@pytest.mark.parametrize("height", [3, 1])
def test_manifest(spark, tmp_path, height):
    rng = random.Random(5)
    rows = [(rng.randrange(300) if rng.random() < 0.9 else None, rng.choice([None, "a", "a", "a", "é", "", "b"]), rng.choice([None, "de"]), rng.choice([None, 3]), rng.choice([None, "", "Ab", "É c"])) for _ in range(700)] + [(5, "z", "l", 1, "Q")] + [(7, "a", "x", 1, "Same")] * 60
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/d")
    got = ordered(merkle.manifest(leaves(spark.read.parquet(f"{tmp_path}/d")), height, 50).collect())
    assert got == ordered(merkle.brute_force(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)
    one = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(merkle.manifest(leaves(one)).collect()) == ordered(merkle.brute_force([(None,) * 5]))
    assert merkle.manifest(leaves(one.limit(0))).count() == 0


EMBEDDINGS = "vec_id long, embedding array<float>, label int, id string, score int, lane long"


def vectors(spark, at, rows, sql=True):
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], EMBEDDINGS).write.parquet(f"{at}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    want = db.execute(hard_negatives.ORACLE).fetchall() if sql else None
    return [tuple(r) for r in hard_negatives.op13_hard_negatives(spark, str(at)).collect()], want


def test_hard_negatives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 300)
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=17) / 4 + (k % 3 == 0)).tolist(), int(k % 4)) for k in range(1500)]
    # Ties, other lengths, odd numbers, no vector, no label, no id; one label alone; a common vector.
    rows += [(2000 + k, rows[0][1], k % 3) for k in range(400)] + [(3000, [1.0], 1), (3100, [2.0], 1), (3101, [2.0], 2), (3200, [], 1), (3201, [], 1), (3203, [], 2)]
    rows += [(3300, None, 1), (3400, [1.0, None], 1), (3500, [float("nan")] * 17, 1), (3501, [float("inf")] * 17, 1), (3600, rows[1][1], None), (None, rows[1][1], 1), (3700, rows[2][1], 77)]
    got, want = vectors(spark, tmp_path, rows)
    assert ordered(got) == ordered(want) and len(got) > 100
    assert len(set(got)) == len(got)


def test_hard_negatives_of_awkward_tables(spark, tmp_path):
    row = (100, [1.0, -1.0], 3)
    got, want = vectors(spark, tmp_path / "none", [])
    assert got == want == []
    got, _ = vectors(spark, tmp_path / "repeats", [row, row, (101, [1.0, -1.0], 3), (102, [1.0, -0.9], 2), (102, [1.0, -0.9], 2)])
    # Both rows of the anchor find one other of their label, and of the other label both rows.
    assert sorted(got) == [(100, 101, k, 102, 131072, 124672) for k in (1, 1, 2, 2)]
    # Scores of more than 64 bits are compared exactly and stand for the greatest that fits.
    big = [(100, [1e15, 1e-3], 1), (101, [1e15, 0.5], 1), (102, [9e14, 0.5], 2), (103, [1e14, 0.5], 2)]
    got, _ = vectors(spark, tmp_path / "big", big, sql=False)
    assert [r[:4] for r in got] == [(100, 101, 1, 102), (100, 101, 2, 103)]


def test_bond_equals_all_products():
    rng = np.random.default_rng(4)
    cells, q = rng.integers(-300, 300, (33, 2000)), rng.integers(-300, 300, 33)
    exact = q @ cells
    low, high = cells.min(axis=1), cells.max(axis=1)
    for first, last in ((-hard_negatives.FAR, hard_negatives.FAR), (10**5, 2 * 10**5), (0, 0)):
        found, scores = hard_negatives.bond(q, cells, low, high, [(first, last)], 5)
        assert (scores == exact[found]).all()
        within = np.flatnonzero((exact >= first) & (exact <= last))
        best = within[np.argsort(-exact[within], kind="stable")][:5]
        assert set(best) <= set(found) and len(found) < 200


def broadcast_rows(spark, done):
    """Rows of each broadcast of the queries after the first ``done``."""
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    for run in (runs.apply(i) for i in range(done, runs.size())):
        values, nodes = store.executionMetrics(run.executionId()), store.planGraph(run.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for metric in (metrics.apply(i) for i in range(metrics.size() if node.name().startswith("BroadcastExchange") else 0)):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    found.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    return found


def test_anchors_are_broadcast_once_and_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=64) / 4 + (k % 3 == 0)).tolist(), int(k % 4)) for k in range(3000)]
    store = spark._jsparkSession.sharedState().statusStore()
    done = store.executionsList().size()
    got, want = vectors(spark, tmp_path / "whole", rows)
    assert ordered(got) == ordered(want) and len(got) > 50
    # Some blocks of 30 anchors, for positives and for negatives, however many blocks of rows there are.
    whole = broadcast_rows(spark, done)
    assert len(whole) == 2 and max(whole) < 12
    monkeypatch.setattr(hard_negatives, "SENT", 4_000, raising=False)
    done = store.executionsList().size()
    got, _ = vectors(spark, tmp_path / "parts", rows, sql=False)
    parts = broadcast_rows(spark, done)
    assert ordered(got) == ordered(want)
    assert len(parts) > 4 and max(parts) < max(whole) and sum(parts) == sum(whole)
