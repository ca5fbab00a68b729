"""Public byte-level BPE vocabularies, loaded from rank files whose place is a parameter."""

from __future__ import annotations

import base64
import functools
import os

import regex

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts longer than this are encoded in parts.
PART_CHARS = 65_536

#: Places where PATTERN ends a piece whatever stands around them: before white space that follows something else (no
#: alternative has white space after its first character unless it is all white space), and between letter and digit.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """One encoder per worker process and file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """``text`` cut at safe places into parts of about ``part_chars``; a part without such a place stays whole."""
    if len(text) <= part_chars:
        return [text]
    parts, begin = [], 0
    while len(text) - begin > part_chars:
        cut = _SAFE.search(text, begin + part_chars)
        if cut is None or cut.start() >= len(text):
            break
        parts.append(text[begin : cut.start()])
        begin = cut.start()
    parts.append(text[begin:])
    return parts
