"""N-gram Jaccard join by grouped prefixes.

A document is the set of its distinct five-word shingles, held as sorted 64-bit hashes.  Two documents
link when their Jaccard similarity is at least 0.75.

1. Documents of equal sets fall together under one representative: copies never meet each other again.
2. A set keeps only its rare shingles' prefix: in an order by frequency and hash that all sets share, two
   linked sets have a shingle in common among the first |x| - ceil(0.75 |x|) + 1 of each.  Frequencies
   are counted among the sets that a first look leaves: of the least 35 hundredths of a set's hashes, ten
   hundredths and one at least must occur in other sets, or the set links with none.
3. Sets of identical prefix and size form a group.  Members are verified with the group's first.  Groups,
   not documents, stand in the lists of prefix shingles.
4. In TURNS turns each list is dealt into parts of about three groups, whose first members are verified with
   each other, so that most of what links falls into components before any list is looked at as a whole.
5. What can still link are members of different components.  Pairs of a list's groups go through filters:
   component, size, what both have left from that shingle on, and bitmaps of their sets.  Only pairs with a
   group outside of the list's main component are made, each once for all lists; surviving group pairs are
   expanded to their members of those components, filtered by bitmap again and verified with the whole sets.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer
than five words make one shingle of them all; rows that repeat an id are one document if their texts
agree and otherwise each have that id; documents without an id link like others, under an id below all;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.bitset import filter_bytes_for, in_filter, make_filter
from quire.llm.common import stored, table
from quire.llm.wordhash import blocks, mix, shingle_sets
from quire.llm.wordmemo import forget

WIDTH = 5
THRESHOLD = 75
#: Hundredths of a set that are looked at first beyond its prefix.
EXTRA = 10
#: Frequencies from which on a shingle belongs to a further class of the order.
CLASSES = (2, 4, 16, 64, 256, 1024)
#: Hashes that a task holds before it passes them on.
HELD = 1_000_000
#: Turns in which a few groups of each list are compared at a time, before all that is left.
TURNS = 3
#: Words of 64 bits in a set's bitmap.
BITMAP = 4
BITS = [f"b{k}" for k in range(BITMAP)]
NO_ID = -(1 << 63)
SETS = "id long, n long, digest binary, shingles binary"


def digest_of(x: np.ndarray) -> bytes:
    """128 bits that stand for a sorted set of hashes."""
    u = x.view(np.uint64)
    both = [int(np.bitwise_xor.reduce(mix(u + np.uint64(k)))) ^ int(np.add.reduce(mix(u ^ np.uint64(k)))) << 64 for k in (0x51ED, 0xA3C7)]
    return ((both[0] ^ both[1] << 17) & ((1 << 128) - 1)).to_bytes(16, "little")


def set_keys(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with (n, digest) in place of the text: the size of each set and 128 bits that stand for it."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([len(x) for x in sets], pa.int64()), pa.array([digest_of(x) for x in sets], pa.binary())], [*others, "n", "digest"])

    return docs.mapInArrow(run, docs.select(*others).schema.add("n", "long").add("digest", "binary"))


def prefix_length(n: np.ndarray | int, threshold: int, extra: int = 0) -> np.ndarray | int:
    """How many shingles of a set of ``n`` hold ``extra`` hundredths of n, and one, of any linked set's."""
    return np.minimum(n, n - -(-threshold * n // 100) + -(-extra * n // 100) + 1)


def repeated_heads(docs: DataFrame, width: int, threshold: int, extra: int) -> DataFrame:
    """(h): hashes that more than one set has in its first look; a task counts equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()

        def passed_on() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(h, np.minimum(n, 2)))], ["h"])

        for batch in batches:
            for part in blocks(batch):
                for x in shingle_sets(part.column("text"), width):
                    if len(x) and (key := digest_of(x)) not in seen:
                        seen.add(key)
                        held.append(x[: prefix_length(len(x), threshold, extra)])
                if sum(map(len, held)) > HELD:
                    yield passed_on()
                if len(seen) > HELD:
                    seen.clear()
        if held:
            yield passed_on()

    return docs.select("text").mapInArrow(run, "h long").groupBy("h").count().where("count > 1").select("h")


def able_to_link(docs: DataFrame, width: int, threshold: int, extra: int) -> DataFrame:
    """(id, doc, n, digest, shingles): distinct sets that the first look doesn't rule out, under new ids, with their least document."""
    heads = repeated_heads(docs, width, threshold, extra).persist()
    try:
        cells = make_filter(heads, filter_bytes_for(heads.count()))
    finally:
        heads.unpersist()
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                own: dict[bytes, tuple[int, np.ndarray]] = {}
                for doc, x in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), width), strict=True):
                    size = int(prefix_length(len(x), threshold, extra))
                    if len(x) and in_filter(shared.value, x[:size]).sum() >= max(1, size - prefix_length(len(x), threshold)):
                        key = digest_of(x)
                        if key not in own or doc < own[key][0]:
                            own[key] = doc, x
                rows = list(own.items())
                yield pa.RecordBatch.from_arrays([pa.array([d for _, (d, _) in rows], pa.int64()), pa.array([len(x) for _, (_, x) in rows], pa.int64()), pa.array([k for k, _ in rows], pa.binary()), pa.array([x.tobytes() for _, (_, x) in rows], pa.binary())], ["id", "n", "digest", "shingles"])

    # The limit to a group's first row holds within tasks too: of a set that many documents have, each passes on one.
    least = Window.partitionBy("digest", "n").orderBy("id")
    found = docs.mapInArrow(run, SETS).withColumn("k", F.row_number().over(least)).where("k = 1").drop("k")
    # Under numbers of their own, since several sets may share an id.
    found = stored(found.withColumnRenamed("id", "doc").withColumn("id", F.monotonically_increasing_id()), "able")
    shared.destroy()
    return found


def _bitmap(x: np.ndarray) -> list[int]:
    """BITMAP words of 64 bits: how often the set's hashes fall on each bit, modulo 2."""
    counts = np.bincount((x >> 7) & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def may_differ(x: str, y: str, threshold: int) -> str:
    """SQL: two sets may link by their bitmaps, which differ in no more bits than the sets in hashes; no bitmap rules out nothing."""
    differ = " + ".join(f"bit_count({x}.b{k} ^ {y}.b{k})" for k in range(BITMAP))
    return f"coalesce({100 + threshold} * ({differ}) <= {100 - threshold} * ({x}.n + {y}.n), true)"


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(id, n, shingles, prefix, shared, b0...): the rarest shingles of each set, those that occur once left out.

    ``prefix`` holds them in order, ``shared`` is how many of the set's shingles occur in other sets.

    The order is by class of frequency, then by hash; a class is a filter of the shingles that are as
    frequent, and what a filter finds by mistake only moves a shingle for all sets alike.  Sets of which
    fewer than ``threshold`` hundredths occur in other sets are dropped: none can link."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "shingles"):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(part.column("shingles").to_pylist()), np.int64))], ["h"])

    counts = sets.select("shingles").mapInArrow(explode, "h long").groupBy("h").agg(F.count("*").alias("df")).where("df > 1").persist()
    try:
        sizes = counts.agg(*(F.count_if(F.col("df") >= c).alias(f"c{c}") for c in CLASSES)).first()
        filters = [make_filter(counts.where(F.col("df") >= c).select("h"), filter_bytes_for(sizes[f"c{c}"])) for c in CLASSES]
    finally:
        counts.unpersist()
    held = sets.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "shingles"):
                rows: list[np.ndarray | None] = []
                shared: list[int] = []
                bits: list[list[int]] = []
                for x in (np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()):
                    level = np.sum([in_filter(f, x) for f in held.value], axis=0)
                    # Shingles of this set alone come first in the order; the prefix goes on with the rarest shared ones.
                    left = int(prefix_length(len(x), threshold)) - int((level == 0).sum())
                    order = np.argsort(level, kind="stable")
                    common = order[level[order] > 0]
                    rows.append(x[common[:left]] if left > 0 else None)
                    if left > 0:
                        shared.append(len(common))
                        bits.append(_bitmap(x))
                keep = pa.array([r is not None for r in rows], pa.bool_())
                words = np.array(bits, np.int64).reshape(-1, BITMAP)
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(keep) for c in ("id", "n", "shingles")), pa.array([r for r in rows if r is not None], pa.list_(pa.int64())), pa.array(shared, pa.int64()), *(pa.array(words[:, k]) for k in range(BITMAP))], ["id", "n", "shingles", "prefix", "shared", *BITS])

    found = stored(sets.select("id", "n", "shingles").mapInArrow(run, f"id long, n long, shingles binary, prefix array<long>, shared long, {', '.join(f'{b} long' for b in BITS)}"), "close")
    held.destroy()
    return found


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of pairs of ids whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "left"):
                keep = []
                for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= threshold * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of edges but for the least of each component of theirs, and that least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        x, y = low[low < high], high[low < high]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    hung = root != np.arange(len(ids))
    return ids[hung], ids[root[hung]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same ids as ``edges``: of as many of these as a task holds at a time, each node hangs on the least of its component.

    ``block`` numbers what was held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = TaskContext.get().partitionId() << 32

        def passed_on() -> pa.RecordBatch:
            nonlocal block
            hung, least = stars(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
            held.clear()
            block += 1
            return pa.RecordBatch.from_arrays([pa.array(hung), pa.array(least), pa.array(np.full(len(hung), block))], ["a", "b", "block"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) > HELD:
                yield passed_on()
        if held:
            yield passed_on()

    return edges.select("a", "b").where("a <> b").distinct().mapInArrow(run, "a long, b long, block long")


def components(edges: DataFrame) -> DataFrame | None:
    """(id, component): the least id that each end of ``edges`` (a, b), but for that one, reaches over them; None if there are no edges.

    Tasks hang each node on the least that their own edges reach, which is all where one task held all edges.
    Else alternating steps hang every node on the least neighbour of its own and of its neighbours, until nothing
    changes; the number of rounds grows with the logarithm of the longest chain."""
    links = stored(contracted(edges), "links")
    number = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    *state, first, last = links.agg(*number, F.min("block"), F.max("block")).first()
    if first is None:
        return None
    if first == last:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    links = links.select("a", "b")
    while True:
        # Large star: each node's larger neighbours hang on its least neighbour or itself.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: each node and its smaller neighbours hang on the least of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        links = stored(small, "links")
        before, state = state, [*links.agg(*number).first()]
        if before == state:
            return links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (id, component, ...) with the components merged that ``edges`` (a, b) between ids connect."""
    ends = edges.join(comp.select(F.col("id").alias("a"), F.col("component").alias("x")), "a").join(comp.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
    found = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    if found is None:
        return comp
    roots = found.select(F.col("id").alias("component"), F.col("component").alias("root"))
    rest = [c for c in comp.columns if c not in ("id", "component")]
    return stored(comp.join(roots, "component", "left").select("id", F.coalesce("root", "component").alias("component"), *rest), "components")


def in_several(lists: DataFrame) -> DataFrame:
    """(h, k, main): the lists (h, g, component) whose groups are of several components, how many groups they have, and a frequent component."""
    parts = lists.groupBy("h", "component").agg(F.count("*").alias("k"))
    several = parts.groupBy("h").agg(F.sum("k").alias("k"), F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"))
    return several.where("parts > 1").select("h", "k", "main")


def links(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, component) of the distinct sets that may have links."""
    close = prefixes(sets, threshold)
    # Groups of identical prefix and size, under the least id.
    groups = close.groupBy("n", "prefix", "shared").agg(F.min("id").alias("g"))
    members = stored(close.select("id", "n", "prefix", "shared", *BITS).join(groups, ["n", "prefix", "shared"]).select("id", "g", "n", *BITS), "members")
    lists = groups.select("g", "n", "shared", F.posexplode("prefix").alias("place", "h"))
    lists = stored(lists.select("h", "g", "n", (F.col("shared") - F.col("place")).alias("rest")), "lists")
    comp = members.select("id", F.col("id").alias("component"))
    comp = joined(comp, verified(members.where("g <> id").select(F.col("g").alias("a"), F.col("id").alias("b")), close, threshold))
    # Two groups may meet in a list if their sizes allow it, and if what their sets have from there on does: a
    # linked pair does so at the first shingle that they share.
    may_meet = f"100 * least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) AND {100 + threshold} * least(x.rest, y.rest) >= {threshold} * (x.n + y.n)"
    open_lists = lists
    for turn in range(TURNS):
        # A few groups of a list at a time, dealt anew in each turn, each with the next two there, by their first members.
        rows = open_lists.join(comp.withColumnRenamed("id", "g"), "g")
        rows = stored(rows.join(in_several(rows), "h"), "open")
        few = Window.partitionBy("h", F.pmod(F.xxhash64("g", "h", F.lit(turn)), F.ceil(F.col("k") / 3))).orderBy("g")
        one = F.struct("g", "n", "rest", "component")
        met = rows.select("g", "n", "rest", "component", F.array_compact(F.array(F.lead(one, 1).over(few), F.lead(one, 2).over(few))).alias("next"))
        met = met.select("g", "n", "rest", "component", F.explode("next").alias("y")).alias("x").where(f"x.component <> y.component AND {may_meet}")
        comp = joined(comp, verified(met.select(F.col("g").alias("a"), F.col("y.g").alias("b")).distinct(), close, threshold))
        open_lists = rows.select("h", "g", "n", "rest")
    # What may still link are members of different components: each group stands once for each component that it has members of.
    kinds = members.join(comp, "id").groupBy("g", "component").agg(F.count("*").alias("size"), *(F.min(b).alias(b) for b in BITS))
    kinds = kinds.select("g", "component", *(F.when(F.col("size") == 1, F.col(b)).alias(b) for b in BITS))
    rows = lists.join(kinds, "g")
    rows = stored(rows.join(in_several(rows).drop("k"), "h"), "rows")
    # One of a pair at least is not of the list's main component; of two such, the one of the lesser component comes first.
    left = rows.where("component <> main").alias("x")
    met = left.join(rows.alias("y"), F.expr(f"x.h = y.h AND x.component <> y.component AND (y.component = y.main OR x.component < y.component) AND {may_meet} AND {may_differ('x', 'y', threshold)}"))
    kinds_met = stored(met.select(F.col("x.g").alias("g"), F.col("x.component").alias("component"), F.col("y.g").alias("other_g"), F.col("y.component").alias("other_component")).distinct(), "met")
    # Group pairs to member pairs, which their bitmaps thin out once more.
    one = members.join(comp, "id").alias("x")
    two = members.join(comp, "id").select(F.col("id"), F.col("g").alias("other_g"), F.col("component").alias("other_component"), "n", *BITS).alias("y")
    pairs = kinds_met.join(one, ["g", "component"]).select("other_g", "other_component", F.struct("id", "n", *BITS).alias("x")).join(two, ["other_g", "other_component"]).where(may_differ("x", "y", threshold))
    return joined(comp, verified(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), close, threshold))


def linked_sets(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, extra: int = EXTRA) -> DataFrame:
    """(digest, n, cluster, least) of the sets of (id, text) that may have links: a number for each component, and its least id."""
    able = able_to_link(docs, width, threshold, extra)
    found = able.select("id", "digest", "n", "doc").join(links(able, threshold).withColumnRenamed("component", "cluster"), "id")
    return found.join(found.groupBy("cluster").agg(F.min("doc").alias("least")), "cluster").select("digest", "n", "cluster", "least")


def clustered(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, extra: int = EXTRA) -> DataFrame:
    """(id, text, ...) to one row each with (n, digest, cluster, component) in place of the text.

    ``component`` is the least id; ``cluster`` tells components apart that share one, and is null where only equal sets link."""
    keys = stored(set_keys(docs, width), "keys")
    first = keys.where("n > 0").groupBy("digest", "n").agg(F.min("id").alias("rep"))
    reps = first.join(linked_sets(docs.select("id", "text"), width, threshold, extra), ["digest", "n"], "left").select("digest", "n", "cluster", F.coalesce("least", "rep").alias("component"))
    return keys.join(reps, ["digest", "n"], "left").withColumn("component", F.coalesce("component", "id"))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, extra: int = EXTRA) -> DataFrame:
    """(id, n_shingles, component_id) for every document."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return clustered(texts, width, threshold, extra).select(F.nullif("id", F.lit(NO_ID)).alias("id"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def brute_force(docs: list[tuple[int, str | None]], width: int = WIDTH, threshold: int = THRESHOLD) -> dict[int, tuple[int, int]]:
    """Set sizes and components by comparing all pairs that share a shingle; for tests."""
    fold = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets, where = {}, {}
    for doc, text in docs:
        w = (text or "").encode().translate(fold).split()
        sets[doc] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        for x in sets[doc]:
            where.setdefault(x, []).append(doc)
    root = {doc: doc for doc in sets}

    def up(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    seen = set()
    for own in where.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                        x, y = sorted((up(a), up(b)))
                        root[y] = x
    return {doc: (len(s), up(doc)) for doc, s in sets.items()}
