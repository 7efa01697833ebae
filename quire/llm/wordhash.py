"""Vectorised word and word-window hashes over the bytes of an Arrow string column.

Everything here works on blocks of about a megabyte of UTF-8, so memory follows the block and the
longest single text, never the partition.  Hashes depend on the bytes alone: every executor and every
retry computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The six ASCII blanks that part words, and odd multipliers for polynomial hashes.
BLANKS = b" \t\n\x0b\x0c\r"
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 20
#: Bytes up to which the polynomial hash of a word is used: modulo 2**64, long words of two alternating
#: letters can agree whatever the base is, so longer words are hashed one by one.
LONGEST_WORD = 32

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


class Words(NamedTuple):
    """Words of a block of texts: byte spans into ``data`` and, for text i, words first[i]..first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def blocks(batch: pa.RecordBatch, column: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts come to about ``block_bytes``; one long text makes a slice alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + block_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def words(texts: pa.Array) -> Words:
    """Blank-separated words of each text; a null has none."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, np.zeros(1, np.int64))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    offsets = offsets - low
    inside = ~_IS_BLANK[data]
    # A word starts where a non-blank follows a blank or a text's start, and ends likewise.
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _powers[base] = have if len(have) <= BLOCK_BYTES + 1 else have[: BLOCK_BYTES + 1].copy()
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for many spans at once."""
    total = len(values)
    power = _power(base, total)
    sums = np.empty(total + 1, np.uint64)
    sums[0] = 0
    # The value at i weighs base**(total-1-i), so a span is freed of its place by base**(its end).
    np.cumsum(values * power[:total], out=sums[1:])
    inverse = _power(pow(base, -1, 1 << 64), total)
    return (sums[end] - sums[start]) * inverse[start]


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, way: int = 0) -> np.ndarray:
    """One 64-bit hash for each of the spans data[start:end]; ``lower`` folds A-Z; ``way`` 0 or 1 picks independent functions."""
    values = (_LOWER if lower else _SAME)[data]
    length = end - start
    out = mix(_spans(values + np.uint64(1), start, end, BASES[way]) + mix(length.astype(np.uint64) + np.uint64(way)))
    long = np.flatnonzero(length > LONGEST_WORD)
    if len(long):
        octets = values.astype(np.uint8).data
        out[long] = [xxhash.xxh3_64_intdigest(octets[a:b], way) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def word_hashes(w: Words, lower: bool = False, way: int = 0) -> np.ndarray:
    """The byte_hashes() of all words of a block."""
    return byte_hashes(w.data, w.start, w.end, lower, way)


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words that begin a run of ``width`` words within one text."""
    counts = np.diff(first)
    total = int(first[-1])
    ok = np.arange(total) + width <= np.repeat(first[1:], counts)
    return np.flatnonzero(ok)


def window_hashes(hashes: np.ndarray, start: np.ndarray, width: int, way: int = 0) -> np.ndarray:
    """Hash of the ``width`` words that begin at each of ``start``."""
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix(_spans(hashes, start, start + width, BASES[way]))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each lower-cased text.

    Fewer words make one shingle of them all; a text without words has none."""
    w = words(texts)
    if not len(w.start):
        return [np.zeros(0, np.int64)] * len(texts)
    h = word_hashes(w, lower=True)
    counts = np.diff(w.first)
    out = np.zeros(0, np.uint64)
    starts = window_starts(w.first, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    out = np.concatenate([window_hashes(h, starts, width), mix(_spans(h, w.first[short], w.first[short + 1], BASES[0]) + counts[short].astype(np.uint64))])
    owner = np.concatenate([np.searchsorted(w.first, starts, side="right") - 1, short])
    order = np.lexsort((out, owner))
    out, owner = out[order].view(np.int64), owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.sort(out[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
