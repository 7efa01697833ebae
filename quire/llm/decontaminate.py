"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are reduced to ASCII-lower-cased words.  The automaton of a block of items holds
every run of words that occurs in an item.  A document's words are streamed through it once; at each
word it gives the longest run ending there that some item contains.  Runs of a whole window (13 words,
or a whole shorter item) are hits.  For each state the automaton knows beforehand which window and which
shorter items end there, so a word costs a bounded number of steps however often it repeats.  Items come in
blocks of bounded size, so an item table of any size is worked through in passes that carry the hits of
earlier blocks along; after every PASSES blocks what was found is written and read again.

Edge cases: a null or empty text has no words and is clean; items without words match nothing; one without an
id counts under an empty id; repeated item rows count once; repeated document rows are judged one by one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import stored, table
from quire.llm.wordmemo import forget

WINDOW = 13
#: Words of items in one automaton: it has at most twice as many states, some 300 bytes each.
BLOCK_WORDS = 200_000
#: Blocks whose automata are with the tasks at a time.
PASSES = 2
#: Part of a document's words, one in so many, from which on hits make it contaminated.
COVERAGE = 20

#: Word bytes are digits, letters and everything beyond ASCII; A-Z become a-z, other bytes blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items whose windows each state completes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.need = window
        reached: list[tuple[int, str, int]] = []
        for item, words in items:
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if n >= window or n == len(words):
                    reached.append((last, item, min(n, window)))
            if words:
                self.need = min(self.need, len(words))
        #: Per state the items of its window-long suffix, and the shorter items that are suffixes of it.
        self.long: dict[int, set[str]] = {}
        self.short: dict[int, set[tuple[int, str]]] = {}
        for state, item, size in reached:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if size == window:
                self.long.setdefault(state, set()).add(item)
            else:
                self.short.setdefault(state, set()).add((size, item))
        #: For each state the suffix that is of window length or ends a shorter item next, itself included; 0 if there is none.
        self.wide, self.output = [0] * len(self.length), [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            link = self.link[state]
            if self.length[state] >= window:
                self.wide[state] = state if self.length[link] < window else self.wide[link]
            self.output[state] = state if state in self.short else self.output[link]

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with such windows."""
        covered = np.zeros(len(words) + 1, np.int32)
        items: set[str] = set()
        if len(words) < self.need or not self.vocabulary:
            return covered[:-1] > 0, items
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        # Only runs of known words that are as long as the shortest window can hold a hit.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= self.need:
                self._stream(ids[a:b].tolist(), int(a), covered, items)
        return np.cumsum(covered[:-1]) > 0, items

    def _stream(self, ids: list[int], base: int, covered: np.ndarray, items: set[str]) -> None:
        nxt, link, length, window, need = self.next, self.link, self.length, self.window, self.need
        wide, output, short, long = self.wide, self.output, self.short, self.long
        seen: set[int] = set()
        state = run = 0
        for at, c in enumerate(ids, base + 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = nxt[state].get(c)
            if to is None:
                continue
            state = to
            run += 1
            if run < need:
                continue
            if run >= window:
                covered[at - run] += 1
                covered[at] -= 1
                if (up := wide[state]) not in seen:
                    seen.add(up)
                    items |= long.get(up, set())
            # Shorter items are shorter than a window, and each suffix here is longer than the next.
            up = output[state]
            while up:
                for size, item in short[up]:
                    if run >= size:
                        covered[at - size] += 1
                        covered[at] -= 1
                        items.add(item)
                up = output[link[up]]


def _spans(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true values, one after another."""
    return np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist()


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``block_words`` words: one row at a time comes to the driver."""
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if words := words_of(text.encode()):
            block.append((item, words))
            size += len(words)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, n_words, spans, items, carried) for every document: ``spans`` are starts and ends of hit words.

    ``carried`` is a struct of the columns named in ``carry``, and of the id."""
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(id_col, *carry).alias("carried")).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}).select("id", "text", "n_words", "spans", "items", "carried")
    schema = out.schema
    for k, block in enumerate(item_blocks(items, item_col, item_text_col, block_words)):
        if k and k % PASSES == 0:
            out = stored(out, "hits")
        shared = spark.sparkContext.broadcast(Automaton(block, window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forget()
            automaton = shared.value
            for batch in batches:
                n_words, spans, found = [], [], []
                for text, had, before in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    flags, hit = automaton.hits(words := words_of(text))
                    for a, b in zip(had[::2], had[1::2], strict=True):
                        flags[a:b] = True
                    n_words.append(len(words))
                    spans.append(_spans(flags))
                    found.append(sorted({*before, *hit}))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string())), batch.column("carried")], ["id", "text", "n_words", "spans", "items", "carried"])

        out = out.mapInArrow(scan, schema)
    return out


def n_hit() -> F.Column:
    return F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated(coverage: int = COVERAGE) -> F.Column:
    return (n_hit() > 0) & (coverage * n_hit() >= F.col("n_words"))


def remove_spans(docs: DataFrame, items: DataFrame, min_span: int = WINDOW, coverage: int = COVERAGE, **options) -> DataFrame:
    """(id, text, removed): hit runs of at least ``min_span`` words cut out, and all hit runs of documents above the coverage limit.

    The remaining words keep the spelling and spacing that the text gives them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, spans, bad in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                gone = 0
                if spans:
                    mask = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    keep, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2], strict=True):
                        if bad or b - a >= min_span:
                            keep.append(text[at : edge[2 * a]])
                            at, gone = edge[2 * b - 1], gone + b - a
                    text = b"".join([*keep, text[at:]])
                texts.append(text)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(removed, pa.int64())], ["id", "text", "removed"])

    found = find_hits(docs, items, **options)
    kind = found.schema["id"].dataType.simpleString()
    return found.select("id", "text", "spans", is_contaminated(coverage).alias("bad")).mapInArrow(cut, f"id {kind}, text string, removed long")


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row a document: words, hit words, items met and whether it is contaminated."""
    found = find_hits(docs, items, **options)
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """The same report by comparing every window with every item; for tests."""
    known: dict[tuple, set[str]] = {}
    for item, text in items:
        if w := words_of((text or "").encode()):
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                known.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    sizes = {len(k) for k in known}
    out = {}
    for doc, text in docs:
        w, hit, found = words_of((text or "").encode()), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if items_here := known.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    found |= items_here
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
