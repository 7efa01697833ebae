"""New rows against a huge set of known keys: a Bloom filter of the new keys thins the known ones before they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each new key, and the least and most bits; above that the keys are no small set.
PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
HASHES = 3


def _places(key: Column, bits: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(k)).bitwiseAND(bits - 1) for k in range(HASHES)]


def bloom(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """One row with the filter's words of 64 bits in order, of ``keys``; put together by Spark, each word once."""
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    set_words = places.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = every.unionByName(set_words).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


def may_be_among(rows: DataFrame, key: str, words: DataFrame, bits: int) -> DataFrame:
    """``rows`` whose key the filter ``words`` finds: all that are among its keys, and few others."""
    held = words.scalar()
    bit = lambda p: F.call_function("shiftrightunsigned", F.get(held, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int"))
    found = [bit(p).bitwiseAND(1) == 1 for p in _places(F.col(key), bits)]
    test = found[0]
    for one in found[1:]:
        test = test & one
    return rows.where(test)


def unknown(new: DataFrame, known: DataFrame, key: str, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``new`` whose key ``known`` lacks, exactly; rows without a key are unknown.

    ``new`` is counted, so have it written or kept before if it is dear.  Known keys that the filter of the new
    ones doesn't find can't match and are dropped where they are read; what is left meets in an exact anti join."""
    bits, n = LEAST_BITS, new.count()
    while bits < PER_KEY * n:
        bits *= 2
    if n == 0 or bits > most_bits:
        return new.join(known.select(key), key, "left_anti")
    return new.join(may_be_among(known.select(key), key, bloom(new, key, bits), bits), key, "left_anti")
