"""A Merkle manifest of a dataset: a 16-ary hash tree for each source, and one over the sources' roots.

Nodes are kept in blocks, aligned subtrees of three levels of runs.  A block is one row; its digests stand in
a van Emde Boas layout: the subtree is split at half its height, the upper part comes first and then the lower
parts from left to right, each laid out the same way.  Where a node is follows by arithmetic from its level
and its number, so that building a block and reading the siblings on a path need no pointers.  A layer's block
roots are the leaves of the next layer, until a tree has one root; the sources' roots are the leaves of the
last tree.

Spark numbers the leaves of each tree: rows are dealt by range of (source, doc_id), counted for each part, and
the parts' counts summed, so that no source has to fit into one task.  Then each layer is one shuffle of its
digests by block.  The way down is one shuffle a layer too: each block gets what stands above its root.

H is the SHA-256 of its inputs one after another, as lower-case hexadecimal; digests go in as that text.  A leaf
is H over doc_id, source, lang, n_chars and text, each `-` if null, else its length in UTF-8 bytes, a colon and
the value.

Edge cases: rows without a source are a source of their own, the first one; rows that repeat an id come in
order of their leaves, those without an id first; a null or empty text is a leaf like others; a source of one
row has that leaf as its root, and with no other source the dataset's root; an empty table has no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import stored, table

#: Nodes of a run, levels of runs in a block.
FAN, HEIGHT = 16, 3
#: Leaves that a task numbers.
PART = 50_000
SIZE = 32
TAIL = "array<struct<at:int,others:array<binary>>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nodes_of(levels: int) -> int:
    """Nodes of a full subtree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


@lru_cache(1 << 16)
def address(levels: int, depth: int, number: int) -> int:
    """Where the node of that number, at that depth below the root, stands in the layout of a subtree of ``levels``."""
    base = 0
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        # Below the cut: past the upper part and the lower parts to the left, then within its own.
        lower = levels - upper
        below = FAN ** (depth - upper)
        base += nodes_of(upper) + number // below * nodes_of(lower)
        levels, depth, number = lower, depth - upper, number % below
    return base


def height_of(n: int) -> int:
    """Levels of runs above ``n`` leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def join_up(digests: list[bytes]) -> bytes:
    """H of digests."""
    return hashlib.sha256("".join(x.hex() for x in digests).encode()).digest()


class Block:
    """A subtree over some leaves, in its layout; ``height`` levels of runs, of which the last of each may be short."""

    def __init__(self, count: int, height: int, cells: bytes | bytearray):
        self.count, self.height, self.cells = count, height, cells

    @classmethod
    def build(cls, leaves: list[bytes], height: int) -> Block:
        block, row = cls(len(leaves), height, bytearray()), leaves
        for depth in range(height, -1, -1):
            for k, digest in enumerate(row):
                at = SIZE * address(height + 1, depth, k)
                if len(block.cells) < at + SIZE:
                    block.cells.extend(bytes(at + SIZE - len(block.cells)))
                block.cells[at : at + SIZE] = digest
            if depth:
                row = [join_up(row[i : i + FAN]) for i in range(0, len(row), FAN)]
        return block

    def node(self, depth: int, number: int) -> bytes:
        at = SIZE * address(self.height + 1, depth, number)
        return bytes(self.cells[at : at + SIZE])

    def path(self, leaf: int) -> list[tuple[int, list[bytes]]]:
        """From a leaf up: its place in the run, and the run's others."""
        found, count = [], self.count
        for depth in range(self.height, 0, -1):
            first = leaf // FAN * FAN
            run = range(first, min(first + FAN, count))
            found.append((leaf - first, [self.node(depth, k) for k in run if k != leaf]))
            leaf, count = leaf // FAN, -(-count // FAN)
        return found


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in (doc_id, source, lang, n_chars, text))), 256))


def numbered(rows: DataFrame, group: str, *order: str, part: int = PART) -> DataFrame:
    """``rows`` with p and n: each row's place in its group by ``order``, from 0, and the group's size.

    No group or value has to fit into one task: equal rows part by their number in the input, which is stored."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "leaves")
    keys = [*dict.fromkeys((group, *order)), "row"]
    parts = rows.count() // part + 1
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stored(placed.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}).drop("row"), "placed")
    counts = placed.groupBy(F.col(group).alias("of"), F.col("part").alias("of_part")).agg(F.count("*").alias("k"), F.min("seq").alias("first"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("of", "of_part", "first", before.alias("before"), F.sum("k").over(Window.partitionBy("of")).alias("n"))
    return placed.join(counts, placed[group].eqNullSafe(counts["of"]) & (placed["part"] == counts["of_part"])).withColumn("p", F.col("seq") - F.col("first") + F.col("before")).drop("of", "of_part", "first", "before", "seq", "part")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal (g, b), which follow each other."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[-1]["g"], held[-1]["b"]) != (row["g"], row["b"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "b").sortWithinPartitions("g", "b", "p")


BLOCKS = "g string, b long, count int, height int, n long, root binary, cells binary"


def layers_of(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of all trees, layer by layer, from leaves (g, p, n, digest); those of one block in their tree end it."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            first = rows[0]
            block = Block.build([r["digest"] for r in rows], min(height, height_of(first["n"])))
            columns = {"g": pa.array([first["g"]], pa.string()), "b": [first["b"]], "count": pa.array([block.count], pa.int32()), "height": pa.array([block.height], pa.int32()), "n": [first["n"]], "root": [block.node(0, 0)], "cells": [bytes(block.cells)]}
            yield pa.RecordBatch.from_pydict(columns)

    layers, rows, most = [], leaves, FAN**height
    while True:
        rows = by_block(rows.select("g", F.floor(F.col("p") / most).alias("b"), "p", "n", "digest"))
        blocks = stored(rows.mapInArrow(built, BLOCKS), "blocks")
        layers.append(blocks)
        higher = blocks.where(F.col("n") > most)
        if higher.isEmpty():
            return layers
        rows = higher.select("g", F.col("b").alias("p"), F.ceil(F.col("n") / most).alias("n"), F.col("root").alias("digest"))


def roots_of(layers: list[DataFrame], height: int) -> DataFrame:
    """(g, root) of each tree."""
    found = None
    for blocks in layers:
        one = blocks.where(F.col("n") <= FAN**height).select("g", "root")
        found = one if found is None else found.unionByName(one)
    return found


def leaf_tails(blocks: DataFrame, height: int) -> DataFrame:
    """(g, p, tail): for each leaf of blocks (g, b, count, height, cells, tail) what stands beside its path up to the last root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.string()), ("p", pa.int64()), ("tail", pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.binary()))])))])
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block = Block(row["count"], row["height"], row["cells"])
                for first in range(0, block.count, 256):
                    places = range(first, min(first + 256, block.count))
                    tails = [[{"at": at, "others": others} for at, others in block.path(k)] + row["tail"] for k in places]
                    yield pa.RecordBatch.from_pydict({"g": [row["g"]] * len(tails), "p": [row["b"] * FAN**height + k for k in places], "tail": tails}, schema)

    return blocks.select("g", "b", "count", "height", "cells", "tail").mapInArrow(run, f"g string, p long, tail {TAIL}")


def with_tails(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the tail of (g, p, tail) that belongs to their roots."""
    return blocks.join(above.select(F.col("g").alias("of"), F.col("p").alias("of_b"), "tail"), F.col("g").eqNullSafe(F.col("of")) & (F.col("b") == F.col("of_b"))).drop("of", "of_b")


def paths_down(layers: list[DataFrame], of_trees: DataFrame, height: int) -> DataFrame:
    """The blocks of the first layer, each with its tail: what stands beside its root's path.

    ``of_trees`` is (g, p, tail) with p = 0: what stands beside each tree's own root."""
    above = of_trees
    for blocks in layers[:0:-1]:
        below = leaf_tails(with_tails(blocks, above), height)
        # Trees that end further down get theirs there: their only block is number 0 of a layer that no block above leads to.
        above = stored(below.unionByName(of_trees.join(blocks.select(F.col("g").alias("of")).distinct(), F.col("g").eqNullSafe(F.col("of")), "left_anti")), "tails")
    return with_tails(layers[0], above)


PROVED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's row comes first, then its leaves."""
    names = [x.split()[0] for x in PROVED.split(", ")]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names[1:])])
    key, block, subroot, first = None, None, "", 0
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["p"] < 0:
                key, block, subroot = (row["g"], row["b"]), Block(row["count"], row["height"], row["cells"]), row["subroot"].hex()
                first = row["first"]
                tail = [(at["at"], [x.hex() for x in at["others"]]) for at in row["tail"]]
                over = "".join("".join(others) for _, others in tail)
                runs = [("".join(others[:at]), "".join(others[at:])) for at, others in tail]
                continue
            if key != (row["g"], row["b"]):
                raise ValueError("a leaf without its block")
            path = [(at, [x.hex() for x in others]) for at, others in block.path(row["p"] - first)]
            siblings = "".join("".join(others) for _, others in path) + over
            digest = (row["tampered"] or row["digest"]).hex()
            for before, after in [*(("".join(others[:at]), "".join(others[at:])) for at, others in path), *runs]:
                digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
            out.append((row["doc_id"], row["digest"].hex(), subroot, hashlib.sha256(siblings.encode()).hexdigest(), digest))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(k).type) for k, c in enumerate(zip(*out, strict=True))], schema=schema)


def manifest(leaves: DataFrame, height: int = HEIGHT, part: int = PART) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for (doc_id, g, digest, tampered) rows.

    ``digest`` is a row's leaf, g the tree that it belongs to, ``tampered`` another leaf to fold in its place, or null."""
    placed = stored(numbered(leaves, "g", "doc_id", "digest", part=part), "numbered")
    layers = layers_of(placed, height)
    trees = roots_of(layers, height).select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("root").alias("digest"))
    trees = stored(numbered(trees, "all", "name", part=part), "trees")
    top = layers_of(trees.select(F.col("all").alias("g"), "p", "n", "digest"), height)
    last = roots_of(top, height).first()
    root = last["root"].hex() if last else None
    start = placed.sparkSession.createDataFrame([("", 0, [])], f"g string, p long, tail {TAIL}")
    of_leaves = leaf_tails(paths_down(top, start, height), height)
    of_trees = trees.join(of_leaves.select(F.col("p").alias("of"), "tail"), F.col("p") == F.col("of")).select(F.col("name").alias("g"), F.lit(0).cast("long").alias("p"), "tail", F.col("digest").alias("subroot"))
    of_trees = stored(of_trees, "subroots")
    blocks = paths_down(layers, of_trees.drop("subroot"), height).join(of_trees.select(F.col("g").alias("of"), "subroot"), F.col("g").eqNullSafe(F.col("of")))
    none = lambda kind: F.lit(None).cast(kind)
    block = F.floor(F.col("p") / FAN**height)
    heads = blocks.select("g", "b", F.lit(-1).cast("long").alias("p"), none("long").alias("doc_id"), none("binary").alias("digest"), none("binary").alias("tampered"), (F.col("b") * FAN**height).alias("first"), "count", "height", "cells", "tail", "subroot")
    rows = placed.select("g", block.alias("b"), "p", "doc_id", "digest", "tampered", none("long").alias("first"), none("int").alias("count"), none("int").alias("height"), none("binary").alias("cells"), none(TAIL).alias("tail"), none("binary").alias("subroot"))
    proved = by_block(heads.unionByName(rows)).mapInArrow(_proved, PROVED)
    return proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_of(*fields, F.translate("text", UPPER, LOWER)))
    return manifest(docs.select("doc_id", F.col("source").cast("string").alias("g"), leaf_of(*fields, F.col("text")).alias("digest"), tampered.alias("tampered")))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The manifest of (doc_id, source, lang, n_chars, text) rows by plain recursion; for tests."""
    import zlib

    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
        paths: list[list] = [[] for _ in leaves]
        level, owners = leaves, [[k] for k in range(len(leaves))]
        while len(level) > 1:
            runs = [range(i, min(i + FAN, len(level))) for i in range(0, len(level), FAN)]
            for run in runs:
                for k in run:
                    for leaf in owners[k]:
                        paths[leaf].append((k - run[0], [level[j] for j in run if j != k]))
            owners = [[leaf for k in run for leaf in owners[k]] for run in runs]
            level = [h(level[k] for k in run) for run in runs]
        return level[0], paths

    of: dict = {}
    for r in rows:
        of.setdefault(r[1], []).append((h(map(code, r)), r))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    done = {s: tree([x for x, _ in sorted(of[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))]) for s in names}
    root, above = tree([done[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above, strict=True):
        for (leaf, r), path in zip(sorted(of[s], key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0])), done[s][1], strict=True):
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            digest = h(map(code, (*r[:4], lower(r[4])))) if odd else leaf
            for at, others in path + up:
                digest = h([*others[:at], digest, *others[at:]])
            out.append((r[0], leaf, done[s][0], root, h(x for _, others in path + up for x in others), digest, digest == root))
    return out
