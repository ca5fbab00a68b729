"""Lexer labels of a text, as runs."""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from itertools import accumulate

from tokenloom.functions.labels import LEXER_PREFIXES

# Lexer names of the languages; any other language is its own lexer name in lower case.
LEXERS = {"C": "c", "C#": "csharp", "C++": "cpp", "Java": "java", "Javascript": "javascript", "PHP": "php", "Python": "python"}
_BY_LENGTH = sorted(LEXER_PREFIXES, key=len, reverse=True)


@functools.lru_cache(maxsize=64)
def lexer_of(language: str):
    from pygments.lexers import get_lexer_by_name
    from pygments.util import ClassNotFound

    try:
        return get_lexer_by_name(LEXERS.get(language, language.lower()))
    except ClassNotFound:
        raise ValueError(f"no lexer for {language}") from None


@functools.lru_cache(maxsize=4096)
def simple_label(label: str) -> str:
    return next((LEXER_PREFIXES[p] for p in _BY_LENGTH if label.startswith(p)), "other")


def lexer_runs(code: str, language: str) -> list[dict]:
    """Runs {start, end, label, simple} that cover the text in order; later lexer tokens replace earlier ones, and what
    none covers is ``other``."""
    if not code:
        return []
    marks: list[tuple[int, int, str]] = []
    for start, kind, value in lexer_of(language).get_tokens_unprocessed(code):
        end = min(start + len(value), len(code))
        if end <= start:
            continue
        while marks and marks[-1][1] > start:
            a, b, label = marks.pop()
            if a < start:
                marks.append((a, start, label))
        marks.append((start, end, str(kind)))
    out, at = [], 0
    for start, end, label in [*marks, (len(code), len(code), "")]:
        if start > at:
            out.append({"start": at, "end": start, "label": "other", "simple": "other"})
        if end > start:
            out.append({"start": start, "end": end, "label": label, "simple": simple_label(label)})
        at = max(at, end)
    return out


class Touching:
    """Records that overlap a span, in their own order."""

    def __init__(self, records: list[dict]):
        self.records = sorted(enumerate(records), key=lambda r: r[1]["start"])
        self.starts = [r["start"] for _, r in self.records]
        self.reach = list(accumulate((r["end"] for _, r in self.records), max))

    def __call__(self, start: int, end: int) -> list[dict]:
        if not self.records:
            return []
        lo, hi = bisect_right(self.reach, start), bisect_left(self.starts, end)
        if hi - lo == 1:  # by far the most frequent case; the reach of the only one passes the start
            return [self.records[lo][1]]
        if hi <= lo:
            return []
        return [r for _, r in sorted((x for x in self.records[lo:hi] if x[1]["end"] > start), key=lambda x: x[0])]
