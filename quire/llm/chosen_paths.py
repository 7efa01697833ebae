"""Near-duplicates by chosen paths: a recursive set similarity join over minwise tokens.

A document is the set of its distinct three-word shingles; two link when their Jaccard similarity is at least
0.85.  Equal sets fall together first.  Each set has a sketch: its least shingle under each of COORDS hashes.

A node holds sets.  At each node one or two of the COORDS are chosen, 1 / 0.85 on average, and the node's sets
part by their minwise tokens there: sets that share one meet again in a child.  A linked pair so has at least
one child in common on average, however deep the tree, while other pairs die out.  Paths begin START levels
below the root, where most nodes hold one set only.  Nodes of at most SMALL sets, or a few times as many short ones, are compared exhaustively.
Larger ones are dealt into parts that are, which soon joins large groups of copies; so no node has to fit into
a task.  In those of at most LARGE sets, what is outside of the main component then meets all of the node's other
sets, part by part; still larger ones are branched, up to LEVELS times.  The trees miss a pair with a chance below 1 - RECALL: a first one joins most
groups, and the others look only at nodes whose sets are not all of one component by then.

All trees go down one level at a time, as one table (node, id).  A node's texts come to it, and their whole sets
are compared there, so that pairs are never shuffled; what is connected already is not compared again, and
pairs of which too few minwise tokens agree, a chance of MISSED for linked ones, are not verified.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; fewer than
three words make one shingle of them all; rows that repeat an id are one document if their texts agree and
otherwise each have that id; documents without an id link like others, under an id below all; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, stored_small, table
from quire.llm.ngram_join import NO_ID, digest_of, joined
from quire.llm.wordhash import blocks, mix, shingle_sets
from quire.llm.wordmemo import forget

WIDTH, THRESHOLD = 3, 85
#: Minwise tokens of a sketch.
COORDS = 64
#: What the trees are sized by: recall of a pair at the threshold, met at this depth.
RECALL, DEPTH = 1 - 1e-6, 4
#: The chance that a pair at the threshold has too few minwise tokens in common to be verified.
MISSED = 1e-9
#: Levels below the root where paths begin, and levels from there on to which nodes are branched.
START, LEVELS = 3, 12
#: Sets of a node, or of a part of a larger one, that are compared exhaustively; SHORT times as many where all have
#: at most SHINGLES together, so that what is held at once is bounded; sets of a node that is not branched.
SMALL, SHORT, SHINGLES, LARGE = 256, 4, 1 << 18, 4_096
KEYS = "id long, n long, digest binary, sketch array<int>"


def more_branches(threshold: int) -> float:
    """The chance of a second branch at a node: branches are 100 / threshold on average."""
    return min(1.0, 100 / threshold - 1)


def met(threshold: int, depth: int) -> float:
    """The chance that a pair at the threshold has a node in common at that depth of a tree."""
    p, second = 1.0, more_branches(threshold)
    for _ in range(depth):
        one = threshold / 100 * p
        p = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return p


def trees(threshold: int, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Trees that miss a pair at the threshold with a chance below 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - met(threshold, depth)))


def least_match(threshold: int, coords: int = COORDS, missed: float = MISSED) -> int:
    """Agreeing minwise tokens below which a pair at the threshold falls with at most that chance."""
    j, below = threshold / 100, 0.0
    for k in range(coords + 1):
        below += math.comb(coords, k) * j**k * (1 - j) ** (coords - k)
        if below > missed:
            return k
    return coords


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """For each of some sets of hashes, none empty, the least value of each of ``coords`` hashes of them, in 32 bits."""
    first = np.cumsum([0, *(len(x) for x in sets[:-1])])
    u = np.concatenate(sets).view(np.uint64)
    seeds = mix(np.arange(1, 2 * coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(sets), coords), np.int32)
    for c in range(coords):
        out[:, c] = (np.minimum.reduceat((u ^ seeds[c]) * (seeds[coords + c] | np.uint64(1)), first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, n, digest, sketch): the size of each set, 128 bits that stand for it, and its minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in blocks(batch):
                sets = shingle_sets(part.column("text"), width)
                n = np.array([len(x) for x in sets])
                values = sketches([x for x in sets if len(x)]).ravel() if n.any() else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum((n > 0) * COORDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array([digest_of(x) for x in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "n", "digest", "sketch"])

    return docs.select("id", "text").mapInArrow(run, KEYS)


def coords_of(node: Column, threshold: int) -> Column:
    """The coordinates that a node's sets part by; they depend on the node alone."""
    first = F.pmod(F.xxhash64(node, F.lit(0)), F.lit(COORDS)).cast("int")
    # A second coordinate is another than the first.
    other = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDS - 1)).cast("int"), F.lit(COORDS)).cast("int")
    second = F.pmod(F.xxhash64(node, F.lit("second")), F.lit(1_000_000)) < int(1_000_000 * more_branches(threshold))
    return F.when(second, F.array(first, other)).otherwise(F.array(first))


def children(node: Column, sketch: Column, threshold: int) -> Column:
    """The nodes below ``node`` that a set of that sketch goes to."""
    return F.transform(coords_of(node, threshold), lambda c: F.xxhash64(node, c, F.element_at(sketch, c + 1)))


def started(sets: DataFrame, first: int, last: int, threshold: int, start: int = START) -> DataFrame:
    """(node, id): where the paths of trees ``first`` to ``last`` begin for each of ``sets`` (id, sketch)."""
    nodes = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda tree: F.xxhash64(F.lit("tree"), tree))
    for _ in range(start):
        nodes = F.flatten(F.transform(nodes, lambda node: children(node, F.col("sketch"), threshold)))
    return sets.select(F.explode(F.array_distinct(nodes)).alias("node"), "id")


def branched(open_rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(node, id): the children of nodes."""
    rows = open_rows.select("node", "id").join(sets.select("id", "sketch"), "id")
    return rows.select(F.explode(children(F.col("node"), F.col("sketch"), threshold)).alias("node"), "id")


def parts_of(k: Column, weight: Column) -> Column:
    """Into how many parts ``k`` sets are dealt that have ``weight`` shingles together."""
    return F.least(F.ceil(k / SMALL), F.greatest(F.ceil(k / (SHORT * SMALL)), F.ceil(weight / SHINGLES)))


def undecided(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """(node, id, component, n, k, parts): rows (node, id) of nodes that hold sets of several components, how many, and in how many parts."""
    rows = rows.join(comp, "id")
    nodes = rows.groupBy("node").agg(F.count("*").alias("k"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high"))
    nodes = nodes.where("low < high").select("node", "k", parts_of(F.col("k"), F.col("weight")).alias("parts"))
    return rows.join(nodes, "node").select("node", "id", "component", "n", "k", "parts")


def near_cells(open_rows: DataFrame) -> DataFrame:
    """(node, cell, id, component, side): nodes as they are, larger ones dealt into parts; all sets of a cell meet."""
    return open_rows.select("node", F.pmod(F.xxhash64("id", "node"), F.col("parts")).alias("cell"), "id", "component", F.lit("all").alias("side"))


def exact_cells(open_rows: DataFrame) -> DataFrame:
    """The same with sides "left" and "right": what is not of a node's main component meets all the node's sets.

    Both are dealt into parts, and each part of one side meets each of the other in a cell."""
    kinds = open_rows.groupBy("node", "component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    nodes = kinds.groupBy("node").agg(F.max(F.struct("size", "component", "weight")).alias("main"), F.sum("size").alias("all"), F.sum("weight").alias("weight"))
    nodes = nodes.select("node", F.col("main.component").alias("main"), parts_of(F.col("all"), F.col("weight")).alias("rights"), parts_of(F.col("all") - F.col("main.size"), F.col("weight") - F.col("main.weight")).alias("lefts"))
    rows = open_rows.drop("n", "k", "parts").join(nodes, "node")
    own = lambda n: F.pmod(F.xxhash64("id", "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = rows.where("component <> main").withColumn("other", every("rights")).select("node", (own("lefts") * F.col("rights") + F.col("other")).alias("cell"), "id", "component", F.lit("left").alias("side"))
    right = rows.withColumn("other", every("lefts")).select("node", (F.col("other") * F.col("rights") + own("rights")).alias("cell"), "id", "component", F.lit("right").alias("side"))
    return left.unionByName(right)


def compared(cells: DataFrame, sets: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(a, b) of linked pairs between sets of different components that a cell brings together.

    ``sets`` is (id, doc, n, digest), ``texts`` (id, text) of documents; what is small is sent to the texts.
    Pairs that the cell has connected already are left out."""
    wanted = stored_small(cells.join(sets.select("id", "doc", "n", "digest"), "id"), "cells")
    rows = texts.withColumnRenamed("id", "doc").join(wanted, "doc")
    rows = rows.repartition("node", "cell").sortWithinPartitions("node", "cell", "side", "id").select("node", "cell", "side", "id", "component", "n", "digest", "text")

    least = least_match(threshold)

    def pairs(side: list[str], ids: list[int], comp: list[int], own: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        if len(ids) < 2:
            return
        # What is on the left comes first, and meets what is on the right.
        lefts, of, n, sketch = side.count("left"), np.array(comp), np.array([len(x) for x in own]), sketches(own)
        # Shingles by small numbers, so that what a set has can be marked.
        values, numbers = np.unique(np.concatenate(own), return_inverse=True)
        ends, marked = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(values), bool)
        for i in range(lefts or len(ids)):
            first = lefts or i + 1
            fits = (of[first:] != of[i]) & (100 * np.minimum(n[first:], n[i]) >= threshold * np.maximum(n[first:], n[i])) & ((sketch[first:] == sketch[i]).sum(axis=1) >= least)
            there = (first + np.flatnonzero(fits)).tolist()
            if there:
                marked[numbers[ends[i] : ends[i + 1]]] = True
            for j in there:
                if of[i] != of[j]:
                    both = int(np.count_nonzero(marked[numbers[ends[j] : ends[j + 1]]]))
                    if 100 * both >= threshold * (n[i] + n[j] - both):
                        of[of == of[j]] = of[i]
                        yield ids[i], ids[j]
            if there:
                marked[numbers[ends[i] : ends[i + 1]]] = False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        key, held = None, ([], [], [], [])

        def passed_on() -> pa.RecordBatch:
            out = list(pairs(*held))
            for column in held:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for part in blocks(batch):
                found = shingle_sets(part.column("text"), width)
                rest = (part.column(c).to_pylist() for c in ("node", "cell", "side", "id", "component", "n", "digest"))
                for x, node, cell, side, one, comp, n, digest in zip(found, *rest, strict=True):
                    if key != (node, cell):
                        yield passed_on()
                        key = node, cell
                    # Another text of that id, or the same row once more.
                    if n != len(x) or digest != digest_of(x) or held[1] and (held[0][-1], held[1][-1]) == (side, one):
                        continue
                    for column, value in zip(held, (side, one, comp, x), strict=True):
                        column.append(value)
        yield passed_on()

    return rows.mapInArrow(run, "a long, b long")


def components_of(texts: DataFrame, sets: DataFrame, width: int, threshold: int, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """(id, component, n) of distinct ``sets`` (id, doc, n, digest, sketch) of the texts (id, text)."""
    comp = sets.select("id", F.col("id").alias("component"), "n")

    def merged(cells: DataFrame) -> DataFrame:
        edges = stored(compared(cells, sets, texts, width, threshold), "edges")
        return comp if edges.isEmpty() else joined(comp, edges)

    # One tree joins most groups.
    found = stored(undecided(started(sets, 0, 0, threshold), comp), "nodes")
    comp = comp if found.isEmpty() else merged(near_cells(found))
    rows = started(sets, 1, trees(threshold, recall) - 1, threshold)
    for level in range(levels + 1):
        found = stored(undecided(rows, comp), "nodes")
        if found.isEmpty():
            break
        comp = merged(near_cells(found))
        left = stored(undecided(found.where("parts > 1").select("node", "id"), comp), "nodes")
        last = left if level == levels else left.where(f"k <= {LARGE}")
        comp = comp if last.isEmpty() else merged(exact_cells(last))
        rows = branched(left.where(f"k > {LARGE}"), sets, threshold)
        if level == levels or left.where(f"k > {LARGE}").isEmpty():
            break
    return comp


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every document; ``kept`` is the document of least id in its component."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = stored(sketched(texts, width), "keys")
    sets = keys.where("n > 0").groupBy("digest", "n", "sketch").agg(F.min("id").alias("doc"))
    # Under numbers of their own, since several sets may share an id.
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()), "distinct")
    # Rows that repeat an id and a text would come to each node again and again.
    repeated = not keys.groupBy("id", "digest").count().where("count > 1").isEmpty()
    comp = components_of(texts.dropDuplicates(["id", "text"]) if repeated else texts, sets, width, threshold, recall, levels)
    found = sets.select("id", "digest", "n", "doc").join(comp.select("id", "component"), "id")
    least = found.groupBy("component").agg(F.min("doc").alias("least"))
    reps = found.join(least, "component").select("digest", "n", "least")
    rows = keys.select("id", "n", "digest").join(reps, ["digest", "n"], "left").select("id", "n", F.coalesce("least", "id").alias("component"))
    return rows.select(F.nullif("id", F.lit(NO_ID)).alias("id"), F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op12_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
