"""Token ids as the tokenizers library gives them, through a memo of units.

The splitting patterns of the two tokenizer files used here never join a non-blank character with a blank
after it, so a text's ids are those of its units.  Texts with blanks beyond ASCII next to others, or with
the strings of special tokens, are handed to the library whole.  A unit of characters below U+0250 whose
pieces the pattern alone determines goes straight to the library's model; others through its whole chain.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from quire.llm.wordmemo import Tokens, kept, latin, ragged

#: Pieces of units kept, and their longest; a fuller memo starts anew.
MEMO_PIECES, MEMO_CHARS = 150_000, 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class LibraryTokens(Tokens):
    """Ids of texts under the tokenizer file at ``path``; ``pattern`` is its splitting pattern, if units may use it."""

    def __init__(self, path: str, gaps: bool, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            special = [re.escape(x["content"]) for x in json.load(f)["added_tokens"]]
        self.find = re.compile(latin(pattern)).findall if pattern else None
        self.pieces: dict[str, list[int]] = {}
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        super().__init__(gaps, special)

    def units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.find is None:
            return ragged(self._encode([u.decode() for u in units]))
        out: list[list[int] | None] = []
        slow: list[str] = []
        tokenize, letters, pieces = self.model.tokenize, self.letters, self.pieces
        for u in units:
            text = u.decode()
            if not text.isascii() and max(text) > "ɏ":
                out.append(None)
                slow.append(text)
                continue
            ids: list[int] = []
            for piece in self.find(text):
                got = pieces.get(piece)
                if got is None:
                    got = [x.id for x in tokenize(piece.encode().decode("latin-1").translate(letters))]
                    if len(piece) <= MEMO_CHARS:
                        pieces[piece] = got
                ids += got
            out.append(ids)
        if len(pieces) > MEMO_PIECES:
            pieces.clear()
        rest = iter(self._encode(slow))
        return ragged([next(rest) if x is None else x for x in out])

    def whole(self, text: str) -> list[int]:
        return self._encode([text])[0]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), 1024):
            out += (x.ids for x in self.tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False))
        return out


def byte_level(path: str) -> LibraryTokens:
    """For a file that keeps blanks and splits by public_tokenizers.PATTERN."""
    from public_tokenizers import PATTERN

    return kept(("byte level", path), lambda: LibraryTokens(path, True, PATTERN))


def word_level(path: str) -> LibraryTokens:
    """For a file that drops blanks and splits at them."""
    return kept(("word level", path), lambda: LibraryTokens(path, False))
