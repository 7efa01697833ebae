"""SpotSigs document fingerprints, in DataFrame operations only.

Common words are anchors.  After each anchor the next two content words (anchors between are passed over)
form a chain; the distinct chains of a text, as sorted 32-bit hashes, are its signatures and, written in
hexadecimal, its fingerprint.  A text without chains has one signature, of its normalised words.  The
likeness of two fingerprints is the Jaccard similarity of the signature sets.

near_pairs() compares all documents: sets are parted by length so that a set meets only those of its own
part and the next, each is cut to the rare prefix that a similar set must share, and what is left is
verified.

Edge cases: a null text is an empty one; equal texts have equal fingerprints; the next document of the
last is the first, also where that is the same; rows that repeat an id are ordered by a hash of their
text; documents without an id come last in the descending order; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored_small, table

#: Common words of English, French, German and Spanish.
ANCHORS = """
a an and are as at be by for from he in is it of on or that the this to was with
au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une
als auf das dem den der des die ein eine für ich im in ist mit nicht sich sie und von zu
al con del el en la las lo los no para por se su un una y
""".split()
CHAIN = 2
#: Documents a bucket of the descending order should have, and the quantiles that buckets are laid between.
BUCKET, KNOTS = 2_048, 64
MARK = "\u0001"


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of a text's chains."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    any_anchor = "|".join(sorted(set(anchors), key=lambda w: (-len(w), w)))
    marked = F.regexp_replace(words, f" (?:{any_anchor})(?= )", MARK)
    chains = F.regexp_extract_all(marked, F.lit(f"{MARK}(?={MARK}*((?: [^ {MARK}]+{MARK}*){{{chain}}}))"), 1)
    hashes = F.transform(chains, lambda x: F.crc32(F.translate(x, MARK, "")))
    return F.array_sort(F.array_distinct(F.when(F.size(chains) > 0, hashes).otherwise(F.array(F.crc32(words)))))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(F.transform(signature_set, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def in_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, ...) with a ``tie`` that orders the rows of one id, and a ``bucket`` that rises with id and tie.

    Between quantiles of the ids buckets are of equal width, so that ids may come in clusters; rows without
    an id are cut by their tie.  The number of buckets grows with the rows, which buckets have about BUCKET of."""
    shares = F.array(*(F.lit(k / KNOTS) for k in range(1, KNOTS)))
    s = docs.agg(F.count("*").alias("n"), F.count("id").alias("known"), F.min("id").alias("low"), F.max("id").alias("high"), F.percentile_approx("id", shares, F.lit(50 * KNOTS)).alias("knots")).first()
    edges = sorted({s["low"], s["high"], *s["knots"]}) if s["known"] else [0]
    cuts, slices = s["known"] // (BUCKET * len(edges)) + 1, (s["n"] - s["known"]) // BUCKET + 1
    knots = F.array(*(F.lit(e).cast("long") for e in edges))
    at = F.size(F.filter(knots, lambda e: e <= F.col("id"))) - 1
    # As doubles: these can't overflow, and rounding keeps the order.
    low, high = F.get(knots, at).cast("double"), F.coalesce(F.get(knots, at + 1).cast("double"), F.lit(float(edges[-1]) + 1.0))
    cut = F.floor((F.col("id").cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * cuts)
    known = at * F.lit(cuts).cast("long") + F.least(cut, F.lit(cuts - 1))
    slice_ = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * slices)
    unknown = F.least(slice_, F.lit(slices - 1)) - slices
    return docs.withColumn("tie", F.xxhash64("text")).withColumn("bucket", F.when(F.col("id").isNull(), unknown).otherwise(known))


def with_next(docs: DataFrame) -> DataFrame:
    """(id, text, sigs) with next_text and next_sigs of the document that follows by descending id.

    The first row of each bucket is also dealt to the bucket before it, so no order over all rows is needed."""
    rows = in_buckets(docs)
    # One row a bucket: its first document in descending order, and the bucket whose last document precedes it.
    by_bucket = Window.orderBy("bucket")
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("head"))
    heads = heads.withColumn("guest_of", F.coalesce(F.lead("bucket").over(by_bucket), F.first("bucket").over(by_bucket)))
    heads = stored_small(heads, "heads")
    own, guest = F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("bucket"), F.lit(True).alias("guest"))
    places = F.when(F.struct("id", "tie").eqNullSafe(F.col("head")), F.array(own, guest)).otherwise(F.array(own))
    dealt = rows.join(heads, "bucket", "left").select("id", "tie", "text", "sigs", F.explode(places).alias("at")).select("id", "tie", "text", "sigs", "at.bucket", "at.guest")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    following = dealt.select("id", "text", "sigs", "guest", F.lead(F.struct("text", "sigs")).over(order).alias("following"))
    return following.where("not guest").select("id", "text", "sigs", F.col("following.text").alias("next_text"), F.col("following.sigs").alias("next_sigs"))


def near_pairs(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, fingerprint) of all documents, and (a, b, likeness) between different fingerprints that are similar.

    Documents of equal fingerprints never meet: pairs are between fingerprints."""
    rows = docs.select(F.col(id_col).alias("id"), signatures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sigs")).withColumn("fingerprint", fingerprint("sigs"))
    sets = rows.select("fingerprint", "sigs").dropDuplicates(["fingerprint"]).withColumns({"key": F.xxhash64("fingerprint"), "n": F.size("sigs")})
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-1.0) / F.log(F.lit(threshold))).cast("int")
    occurrences = sets.select("key", "n", part.alias("part"), F.explode("sigs").alias("sig"))
    df = occurrences.groupBy("sig").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "sig"))
    rare = occurrences.join(df, "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    left = rare.select("sig", "part", F.col("key").alias("a"), F.col("n").alias("na"))
    right = rare.select("sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("part").alias("own"))
    met = left.join(right, ["sig", "part"]).where("(part < own or a < b) and a <> b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
    both = met.join(sets.select(F.col("key").alias("a"), F.col("sigs").alias("x"), F.col("fingerprint").alias("fa")), "a").join(sets.select(F.col("key").alias("b"), F.col("sigs").alias("y"), F.col("fingerprint").alias("fb")), "b")
    pairs = both.withColumn("likeness", likeness(F.col("x"), F.col("y"))).where(F.col("likeness") >= threshold).select(F.col("fa").alias("a"), F.col("fb").alias("b"), "likeness")
    return rows.select("id", "fingerprint"), pairs


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sigs", signatures(F.col("text")))).withColumn("n", F.char_length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_sigs", signatures(F.col("edited")))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
