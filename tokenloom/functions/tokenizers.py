"""Tokenizers with exact character offsets. A tokenizer is made in the worker from a small picklable description."""

from __future__ import annotations

import functools
import re
import zlib
from typing import NamedTuple, Protocol


class Token(NamedTuple):
    token_id: int
    raw: str
    decoded: str
    start: int
    end: int


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[Token]: ...


class PatternTokenizer(NamedTuple):
    """Pieces of a pattern that covers any text; ids are checksums of the pieces."""

    pattern: str = r" ?[^\W\d_]+|\d+|[\W_]"

    def encode(self, text: str) -> list[Token]:
        return [
            Token(zlib.crc32(m.group().encode("utf-8", "surrogatepass")) & 0x7FFFFFFF, m.group(), m.group(), m.start(), m.end())
            for m in re.finditer(self.pattern, text, re.S)
        ]


@functools.lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer as Fast

    return Fast.from_file(path)


class FileTokenizer(NamedTuple):
    """A tokenizer file; special tokens are added only if asked for."""

    path: str
    add_special_tokens: bool = False
    max_length: int | None = None

    def encode(self, text: str) -> list[Token]:
        fast = _load(self.path)
        e = fast.encode(text, add_special_tokens=self.add_special_tokens)
        n = self.max_length
        return [Token(i, raw, fast.decode([i], skip_special_tokens=False), s, t) for i, raw, (s, t) in zip(e.ids[:n], e.tokens[:n], e.offsets[:n])]
