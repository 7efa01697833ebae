"""Byte-level BPE by ranks, with a segment tree that holds the leftmost pair of least rank.

A leaf of the tree stands for a byte position and holds the rank of the pair that starts there; inner
nodes hold the least key (rank, position) below them, so the root names the next merge.  A merge changes
three leaves: the pair's own, that of the token that vanishes, and that of the live neighbour before it;
each change climbs one path.  Many pieces of about the same length are merged side by side in one array
of trees; a piece of more than 256 bytes has a tree of its own.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded one by
one; pieces of any length take O(n log n) steps; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.wordhash import blocks
from quire.llm.wordmemo import WIDE_BLANKS, Tokens, kept, latin

NO_PAIR = np.int64(1) << 62
#: Pieces of up to so many bytes are merged side by side; ids fit in so many bits.
SIDE_BY_SIDE = 256
ID_BITS = 21


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe(Tokens):
    """Ids of texts under ranks: each match of ``pattern`` is merged by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        blanks = "\t-\r " + WIDE_BLANKS
        exact = pattern.replace("[^\\s", f"[^{blanks}").replace("\\s", f"[{blanks}]").replace("\\S", f"[^{blanks}]")
        self.find_any = regex.compile(exact).findall
        self.find = re.compile(latin(pattern)).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[a] << ID_BITS | ranks[b], rank) for token, rank in ranks.items() for a, b in ((token[:k], token[k:]) for k in range(1, len(token))) if a in ranks and b in ranks)
        self.pair_key = np.array([k for k, _ in pairs], np.int64)
        self.pair_rank = np.array([r for _, r in pairs], np.int64)
        self.pair = dict(pairs)
        size = max(ranks.values()) + 1
        spelt = [b""] * size
        for token, rank in ranks.items():
            spelt[rank] = token
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.spelt_length = np.fromiter(map(len, spelt), np.int64, size)
        self.spelt_start = np.cumsum(self.spelt_length) - self.spelt_length
        super().__init__(True, [])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NO_PAIR where there is no such token."""
        key = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_PAIR)

    def merge_many(self, pieces: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most 2**bits bytes: one array, and the number of each."""
        n, width = len(pieces), 1 << bits
        size = np.fromiter(map(len, pieces), np.int64, n)
        row = np.repeat(np.arange(n), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        # One column of padding stands for "no token" on either side.
        token = np.full((n, width + 1), -1, np.int64)
        token[row, col] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = after - 2
        tree = np.full((n, 2 * width), NO_PAIR, np.int64)
        place = np.arange(width)
        paired = token[:, 1:] >= 0
        leaf = np.full((n, width), NO_PAIR, np.int64)
        leaf[paired] = self._rank(token[:, :-1][paired], token[:, 1:][paired])
        tree[:, width:] = np.where(leaf < NO_PAIR, leaf << bits | place, NO_PAIR)
        for k in range(bits - 1, -1, -1):
            half = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(half[:, ::2], half[:, 1::2])
        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(live):
            key = tree[live, 1]
            at, rank = key & (width - 1), key >> bits
            gone = after[live, at]
            following = after[live, gone]
            token[live, at], token[live, gone] = rank, -1
            after[live, at] = following
            inside = following < width
            before[live[inside], following[inside]] = at[inside]
            ahead = token[live, np.minimum(following, width)]
            self._set(tree, live, gone, np.full(len(live), NO_PAIR), bits)
            self._set(tree, live, at, np.where(ahead >= 0, self._rank(rank, np.maximum(ahead, 0)), NO_PAIR), bits)
            behind = before[live, at]
            some = behind >= 0
            rows, behind = live[some], behind[some]
            self._set(tree, rows, behind, self._rank(token[rows, behind], rank[some]), bits)
            live = live[tree[live, 1] < NO_PAIR]
        kept = token[:, :width] >= 0
        return token[:, :width][kept], kept.sum(1)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, rank: np.ndarray, bits: int) -> None:
        """Point updates: one leaf in each of ``rows``, then the nodes above it."""
        node = place + (1 << bits)
        tree[rows, node] = np.where(rank < NO_PAIR, rank << bits | place, NO_PAIR)
        for _ in range(bits):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def merge_one(self, piece: bytes) -> list[int]:
        """The same for one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, pair = int(NO_PAIR), self.pair
        token = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = pair.get(token[i] << ID_BITS | token[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int, other: int) -> None:
            rank = pair.get(token[place] << ID_BITS | token[other]) if other < n else None
            node = width + place
            tree[node] = none if rank is None else rank * width + place
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            following = after[gone]
            token[at], token[gone], after[at] = rank, -1, following
            if following < n:
                before[following] = at
            put(gone, n)
            put(at, following)
            if before[at] >= 0:
                put(before[at], at)
        return [t for t in token if t >= 0]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, in their order: one array, and the number of each."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (known := self.ranks.get(piece)) is not None:
                out[i] = np.array([known])
            elif len(piece) > SIDE_BY_SIDE:
                out[i] = np.array(self.merge_one(piece))
            else:
                groups.setdefault(max(2, (len(piece) - 1).bit_length()), []).append(i)
        for bits, own in groups.items():
            step = (1 << 21) >> bits
            for k in range(0, len(own), step):
                part = own[k : k + step]
                ids, n = self.merge_many([pieces[i] for i in part], bits)
                ends = np.cumsum(n).tolist()
                for i, a, b in zip(part, [0, *ends], ends):
                    out[i] = ids[a:b]
        lengths = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int64)).astype(np.uint32), lengths

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        order, counts = [], []
        for unit in units:
            text = unit.decode()
            found = (self.find if text.isascii() or max(text) < "ɐ" else self.find_any)(text)
            order += (number.setdefault(p, len(number)) for p in found)
            counts.append(len(found))
        ids, n = self.merge([p.encode() for p in number])
        order = np.array(order, np.int64)
        start, n_each = (np.cumsum(n) - n)[order], n[order]
        ends = np.cumsum(n_each)
        at = np.arange(int(n_each.sum())) + np.repeat(start - (ends - n_each), n_each)
        total = np.concatenate([[0], ends])
        cut = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return ids[at], np.diff(total[cut])

    def whole(self, text: str) -> list[int]:
        return self.units([text.encode()])[0].tolist()

    def decode_block(self, ids: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs of ids, and where those of each run end (with a leading 0)."""
        n = self.spelt_length[ids]
        ends = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(self.spelt_start[ids] - (ends - n), n)
        return self.flat[at], np.concatenate([[0], ends])[cut]


def bpe_of(path: str) -> ByteBpe:
    """The encoder of a rank file."""
    from public_tokenizers import PATTERN

    return kept(("ranks", path), lambda: ByteBpe(read_ranks(path), PATTERN))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks_path)
        for batch in batches:
            for part in blocks(batch):
                ids, cut = bpe.block(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["id", "ids"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                runs = [np.array(x or [], np.int64) for x in batch.column("ids").slice(k, 256).to_pylist()]
                data, cut = bpe.decode_block(np.concatenate(runs), np.concatenate([[0], np.cumsum([len(x) for x in runs])]))
                data = data.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(k, 256), pa.array([data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "data"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(ranks_path)
        for batch in batches:
            for part in blocks(batch):
                ids, cut = bpe.block(part.column("text"))
                data, to = bpe.decode_block(ids, cut)
                octets, back = ids.astype("<u4").tobytes(), data.tobytes()
                of = lambda x, ends: [hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(cut)), pa.array(of(octets, 4 * cut)), pa.array(of(back, to))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).withColumnRenamed("id", "doc_id")
