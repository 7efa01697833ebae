"""Anti joins behind a Bloom filter: exact, and nearly all known rows are dropped where they are read."""

import pytest
from pyspark.sql import functions as F

from quire.operators import known


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_unknown_is_exact(spark, n):
    new = spark.range(n).select((F.col("id") * 7).alias("k"), F.lit("x").alias("v")).unionByName(spark.createDataFrame([(None, "none")], "k long, v string"))
    old = spark.range(9000).select((F.col("id") * 3).alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    got = known.unknown(new, old, "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, new.join(old, "k", "left_anti").collect()))
    # Too many keys for a filter: the same rows without one.
    assert sorted(map(str, known.unknown(new, old, "k", most_bits=8).collect())) == sorted(map(str, got.collect()))


def test_known_rows_are_dropped_before_they_move(spark, tmp_path):
    spark.range(400_000).select(F.concat(F.lit("u"), "id").alias("url")).write.parquet(f"{tmp_path}/known")
    old, new = spark.read.parquet(f"{tmp_path}/known"), spark.range(399_000, 401_000).select(F.concat(F.lit("u"), "id").alias("url"))
    words = known.bloom(new, "url", 1 << 16)
    left = known.may_be_among(old, "url", words, 1 << 16)
    assert left.join(new, "url", "left_semi").count() == 1000
    assert left.count() < 0.05 * old.count()
    got = known.unknown(new, old, "url")
    assert sorted(r[0] for r in got.collect()) == sorted(f"u{k}" for k in range(400_000, 401_000))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The filter stands between the scan and whatever moves its rows.
    scan = plan.index("FileScan")
    assert "Subquery" in plan[:scan][plan[:scan].rindex("Exchange") :] and "Cartesian" not in plan and "NestedLoop" not in plan
