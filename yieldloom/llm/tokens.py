"""Token ids of whole texts under a word-level BPE vocabulary of the ``tokenizers`` library.

The vocabulary's rules never join characters over white space, so a text is cut into its
pre-tokens here and each distinct pre-token is encoded once and kept, packed, in a bounded table.
Texts with characters for which the cutting rules below are not proven equal to the vocabulary's own go
through the library whole. tests/llm/test_tokens_packing.py compares both ways.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: The cutting rules hold for code points up to this one, whose lower case stays among them.
LAST = 0x17F


def _set(prefix: str) -> str:
    return "".join(f"\\u{c:04x}" for c in range(LAST + 1) if unicodedata.category(chr(c)).startswith(prefix))


_SPACE = r"\t-\r \x85\xa0"
_L, _N = _set("L"), _set("N")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")
#: Lower-casing U+0130 gives a combining mark; special tokens start with <|.
_OTHER = re.compile(f"[^\\x00-\\u{LAST:04x}]|\\u0130|<\\|")
_PIECE = 1 << 20
_MOST_WORDS = 1 << 18


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible in
    Latin-1, else one from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (c for c in range(0x100, 0x200))
    return [chr(k) if k in seen else chr(next(others)) for k in range(256)]


_SIGNS = _byte_signs()


class _Words(dict):
    """Packed ids by word, worked out when first asked for."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _MOST_WORDS:
            self.clear()
        signs = word if word.isascii() and word.isprintable() else "".join(map(_SIGNS.__getitem__, word.encode()))
        ids = [t.id for t in self.model.tokenize(signs)]
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class WordTokenizer:
    """``pack`` gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.words = _Words(self.whole.model)

    def _pieces(self, text: str):
        begin = 0
        while len(text) - begin > _PIECE:
            end = text.rfind(" ", begin, begin + _PIECE)
            if end <= begin:
                break
            yield text[begin:end]
            begin = end
        yield text[begin:]

    def pack(self, text: str) -> bytes:
        if _OTHER.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        known = self.words.__getitem__
        return b"".join([b"".join(map(known, _WORD.findall(piece.lower()))) for piece in self._pieces(text)])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker and vocabulary."""
    return WordTokenizer(path)
