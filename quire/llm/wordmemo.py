"""What a function gives for each word of a text, by way of a bounded memo with vectorised look-up.

Words repeat far more often than texts do.  A block of texts is cut into units, each unit hashed, the
distinct hashes looked up in a sorted table, and only units new to this worker process are handed to the
function, in one call.  Results are short runs of unsigned 32-bit numbers, kept in one flat array.

Two units are taken for the same if two independent 64-bit hashes and their byte lengths agree.  Units that
share only the first hash with another one are handed to the function each time.
"""

from __future__ import annotations

import ctypes
import gc
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quire.llm.wordhash import Words, byte_hashes, words

#: Bytes that a memo's arrays may take; a fuller memo starts anew.
MEMO_BYTES = 96 << 20
#: Results longer than this many numbers are not kept, so that memory is bounded.
MEMO_RESULT = 64

#: Blanks beyond ASCII: what splits at ASCII blanks alone can't be trusted next to these.
WIDE_BLANKS = "\u0085   -     　"
Function = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What ``make`` gives; a worker process keeps it until it asks for another key, so that it holds one memo at most."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Worker processes are used again: what has no need of a memo frees the one there may be."""
    if _kept:
        _kept.clear()
        # A memo and its function refer to each other, and glibc keeps what is freed until it is told otherwise.
        gc.collect()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    pa.default_memory_pool().release_unused()


class Looked(NamedTuple):
    """Results of a block: unit i has values[start[i] : start[i] + length[i]]; text t has units first[t]..first[t+1]."""

    values: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All results one after another, and where those of each text end (with a leading 0)."""
        ends = np.cumsum(self.length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start - (ends - self.length), self.length)
        return self.values[at], np.concatenate([[0], ends])[self.first]


def gap_units(w: Words, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans from the end of one word to the end of the next, with a last one for blanks at a text's end."""
    n, counts = len(bounds) - 1, np.diff(w.first)
    begin = np.concatenate([[0], w.end])[:-1]
    some = counts > 0
    begin[w.first[:-1][some]] = bounds[:-1][some]
    last = bounds[:-1].copy()
    last[some] = w.end[w.first[1:][some] - 1]
    tail = np.flatnonzero(last < bounds[1:])
    starts = np.insert(begin, w.first[1:][tail], last[tail])
    ends = np.insert(w.end, w.first[1:][tail], bounds[1:][tail])
    extra = np.zeros(n, np.int64)
    extra[tail] = 1
    return starts, ends, np.concatenate([[0], np.cumsum(counts + extra)])


class WordMemo:
    """``function`` of units: words alone, or words with the blanks before them if ``gaps``."""

    def __init__(self, function: Function, gaps: bool):
        self.function, self.gaps = function, gaps
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.others = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def look_up(self, texts: pa.Array) -> Looked:
        """Results for the units of each text; nulls have none."""
        texts = texts.cast(pa.large_string())
        w = words(texts)
        if self.gaps:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            start, end, first = gap_units(w, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
        else:
            start, end, first = w.start, w.end, w.first
        if not len(start):
            none = np.zeros(0, np.int64)
            return Looked(np.zeros(0, np.uint32), none, none, first)
        size = (end - start).astype(np.int32)
        keys = byte_hashes(w.data, start, end)
        # np.unique with an inverse, by one sort.
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        distinct, sample = ordered[new], order[new]
        inverse = np.empty(len(keys), np.int64)
        inverse[order] = np.cumsum(new) - 1
        other = byte_hashes(w.data, start, end, way=1)
        alone = np.flatnonzero((other != other[sample][inverse]) | (size != size[sample][inverse]))
        inverse[alone] = len(distinct) + np.arange(len(alone))
        distinct, sample = np.concatenate([distinct, keys[alone]]), np.concatenate([sample, alone])
        at = np.searchsorted(self.keys, distinct)
        taken = at < len(self.keys)
        taken[taken] = self.keys[at[taken]] == distinct[taken]
        known = taken.copy()
        known[taken] = (self.others[at[taken]] == other[sample[taken]]) & (self.sizes[at[taken]] == size[sample[taken]])
        # A key has one place in the memo.
        taken[len(distinct) - len(alone) :] = True
        begin, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int32)
        begin[known], length[known] = self.begin[at[known]], self.length[at[known]]
        values = self.flat
        missing = np.flatnonzero(~known)
        if len(missing):
            data = w.data.tobytes()
            got, lengths = self.function([data[a:b] for a, b in zip(start[sample[missing]].tolist(), end[sample[missing]].tolist(), strict=True)])
            begin[missing], length[missing] = self.used + np.cumsum(lengths) - lengths, lengths
            values = self._keep(got, ~taken[missing] & (lengths <= MEMO_RESULT), distinct[missing], other[sample[missing]], size[sample[missing]], begin[missing], length[missing])
        return Looked(values, begin[inverse], length[inverse], first)

    def _keep(self, got: np.ndarray, some: np.ndarray, keys: np.ndarray, others: np.ndarray, sizes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Put new results into the memo, ``some`` of them for good; return the array that holds both old and new."""
        if self.used + len(got) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(got)), np.uint32)])
        self.flat[self.used : self.used + len(got)] = got
        values = self.flat
        self.used += len(got)
        # Keys, sizes, beginnings and lengths take 32 bytes a unit, and twice that while new ones go in.
        if 64 * (len(self.keys) + int(some.sum())) + self.flat.nbytes > MEMO_BYTES:
            self._clear()
            return values
        place = np.searchsorted(self.keys, keys[some])
        self.keys, self.others, self.sizes = np.insert(self.keys, place, keys[some]), np.insert(self.others, place, others[some]), np.insert(self.sizes, place, sizes[some])
        self.begin, self.length = np.insert(self.begin, place, begin[some]), np.insert(self.length, place, length[some])
        return values


def ragged(results: list) -> tuple[np.ndarray, np.ndarray]:
    """A list of runs of numbers as one array and their lengths."""
    lengths = np.fromiter(map(len, results), np.int64, len(results))
    flat = np.fromiter(chain.from_iterable(results), np.uint32, int(lengths.sum()))
    return flat, lengths


def latin(pattern: str) -> str:
    """``pattern`` for Python's own matcher, where it only meets characters below U+0250."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    blanks = re.escape("".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0)))
    inside = pattern.replace("[^\\s\\p{L}\\p{N}]", f"[^{blanks}{kinds['L']}{kinds['N']}]")
    return inside.replace("\\p{L}", f"[{kinds['L']}]").replace("\\p{N}", f"[{kinds['N']}]").replace("\\s", f"[{blanks}]").replace("\\S", f"[^{blanks}]")


class Tokens:
    """Token ids of texts by units; subclasses say what units() and a whole() text give."""

    def __init__(self, gaps: bool, special: list[str]):
        self.apart = "|".join([*special, *([f"[{WIDE_BLANKS}]"] if gaps else [])])
        self.memo = WordMemo(self.units, gaps)

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def whole(self, text: str) -> list[int]:
        raise NotImplementedError

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each text end (with a leading 0)."""
        odd = pc.fill_null(pc.match_substring_regex(texts, self.apart), False).to_numpy(zero_copy_only=False)
        # Arrow's if_else mistakes the bytes of sliced arrays; taking a null place gives a null.
        values, cut = self.memo.look_up(texts.take(pa.array(np.arange(len(texts)), mask=odd)) if odd.any() else texts).joined()
        if odd.any():
            each = [values[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            for k in np.flatnonzero(odd).tolist():
                each[k] = np.array(self.whole(texts[k].as_py()), np.uint32)
            values, cut = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return values, cut

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null is an empty text."""
        values, cut = self.block(texts)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield values[a:b]
