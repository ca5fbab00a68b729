"""Which dialects a language has, and the check of one text against all of them."""

from __future__ import annotations

import functools
from typing import NamedTuple

from tokenloom.llm.syntax import grammars, lexers
from tokenloom.llm.syntax.gll import Grammar, recognise

#: Spellings of language names, trimmed and in lower case.
SPELLINGS = {
    "c": "C", "c#": "C#", "csharp": "C#", "cs": "C#", "c++": "C++", "cpp": "C++", "cxx": "C++", "java": "Java",
    "javascript": "JavaScript", "js": "JavaScript", "php": "PHP", "python": "Python", "python3": "Python", "py": "Python",
}

#: language -> (grammar, lexer, its option). A grammar has its dialects, and they run together; one without a name for
#: them has that which stands last.
_LANGUAGES = {
    "C": ("C", lexers.c_like, "c", "c17"),
    "C++": ("CPP", lexers.c_like, "cpp", "c++20"),
    "C#": ("CSHARP", lexers.c_like, "csharp", "c#12"),
    "Java": ("JAVA", lexers.c_like, "java", "java17"),
    "JavaScript": ("JAVASCRIPT", lexers.javascript, None, "es2023"),
    "PHP": ("PHP", lexers.php, None, "php8"),
    "Python": ("PYTHON", lexers.python, None, "python3"),
}


class Verdict(NamedTuple):
    """``valid`` is None where the language is unknown. ``dialect`` is the one that accepts; ``place`` the furthest
    character that a dialect reached."""

    valid: bool | None
    dialect: str | None
    place: int | None


@functools.lru_cache(maxsize=None)
def grammar(name: str) -> Grammar:
    return Grammar(getattr(grammars, name))


def language_of(name: str | None) -> str | None:
    return None if name is None else SPELLINGS.get(name.strip().lower())


def check(text: str, language: str | None) -> Verdict:
    """Is ``text`` a sentence of any dialect of the language (a name of ``_LANGUAGES``)?"""
    if language is None:
        return Verdict(None, None, None)
    name, lexer, option, dialect = _LANGUAGES[language]
    g = grammar(name)
    try:
        tokens = lexer(text, g) if option is None else lexer(text, g, option)
    except lexers.LexError as e:
        return Verdict(False, None, e.args[0])
    place, accepted = _accepting(g, tokens)
    if not accepted:
        return Verdict(False, None, place)
    return Verdict(True, next((d for i, d in enumerate(g.dialects) if accepted >> i & 1), dialect), None)


def _accepting(g: Grammar, tokens: lexers.Tokens) -> tuple[int, int]:
    """(place reached, dialects that accept). With conditional directives a dialect must accept what is read if nothing
    is defined, and every other branch with some choice of the conditions."""
    if tokens.conditionals is None:
        at, accepted = recognise(g, tokens.kinds, tokens.began)
        return tokens.places[at], accepted

    def read(atoms: dict[str, bool]) -> tuple[int, int]:
        kept = tokens.conditionals.kept(atoms, len(tokens.kinds))
        at, accepted = recognise(g, [tokens.kinds[i] for i in kept])
        return tokens.places[kept[at]], accepted

    accepting = g.all
    for atoms, alone in tokens.conditionals.choices():
        place, accepted = read(atoms)
        if accepting & ~accepted and len(alone) > 1:  # perhaps the branches don't go together
            accepted = g.all
            for own in alone:
                place, one = read(own)
                accepted &= one
                if not accepting & accepted:
                    break
        accepting &= accepted
        if not accepting:
            return place, 0
    return place, accepting
