"""Which branches of conditional directives are read together.

A condition is an atom (a macro, or the text of an expression) that holds or not, the opposite of one, or a constant. An
assignment of the atoms settles which branch of every group is read. The first choice has no atom hold; further choices
are made until every branch that can be read at all is in one of them, as many as agree with each other at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_MACRO = re.compile(r"(!?)\s*(?:defined\s*)?\(?\s*([^\W\d]\w*)\s*\)?")
_COMMENT = re.compile(r"/\*.*?\*/|//.*", re.S)


class _Branch:
    """(atom, what it must be) or a constant; first token and the one behind the last; the group around it."""

    __slots__ = ("condition", "begin", "end", "before", "outer")

    def __init__(self, condition: tuple[str, bool] | bool, begin: int, before: list[_Branch], outer: _Branch | None):
        self.condition, self.begin, self.end, self.before, self.outer = condition, begin, begin, before, outer


class Conditionals:
    def __init__(self, family: str):
        self.family = family
        self.branches: list[_Branch] = []
        self._open: list[list[_Branch]] = []
        self._else: list[bool] = []  # per open group: its else has been met

    def _condition(self, name: str, rest: str) -> tuple[str, bool] | bool:
        rest = " ".join(_COMMENT.sub(" ", rest).split())
        if name == "else":
            return True
        m = _MACRO.fullmatch(rest)
        if m is None or rest in ("true", "false"):
            if rest in ("0", "1", "true", "false"):
                return rest in ("1", "true")
            return rest, True
        holds = (m[1] == "") == (not name.endswith("ndef"))
        if m[2] == "__cplusplus" and self.family in ("c", "cpp"):
            return holds == (self.family == "cpp")
        return m[2], holds

    def directive(self, name: str, rest: str, at: int) -> bool:
        """A directive before token ``at``; False if it can't stand here."""
        if name in ("if", "ifdef", "ifndef"):
            self._open.append([])
            self._else.append(False)
            self._begin(self._condition(name, rest), at)
            return True
        if not self._open:
            return False
        self._open[-1][-1].end = at
        if name == "endif":
            self._open.pop()
            self._else.pop()
            return True
        if self._else[-1]:
            return False
        self._else[-1] = name == "else"
        self._begin(self._condition(name, rest), at)
        return True

    def _begin(self, condition: tuple[str, bool] | bool, at: int) -> None:
        group = self._open[-1]
        branch = _Branch(condition, at, list(group), self._open[-2][-1] if len(self._open) > 1 else None)
        group.append(branch)
        self.branches.append(branch)

    def is_dead(self) -> bool:
        """Do we stand in a branch that is never read?"""
        return bool(self._open) and self._needs(self._open[-1][-1]) is None

    def closed(self) -> bool:
        return not self._open

    def _needs(self, branch: _Branch | None) -> dict[str, bool] | None:
        """What the atoms must be for the branch to be read; None if it never is."""
        out: dict[str, bool] = {}
        while branch is not None:
            for b, wanted in [(branch, True), *((b, False) for b in branch.before)]:
                if b.condition is True or b.condition is False:
                    if b.condition is not wanted:
                        return None
                    continue
                atom, sense = b.condition
                if out.setdefault(atom, sense is wanted) is not (sense is wanted):
                    return None
            branch = branch.outer
        return out

    def _read(self, atoms: dict[str, bool]) -> list[_Branch]:
        holds = lambda c: c if isinstance(c, bool) else atoms.get(c[0], False) is c[1]
        read: set[int] = set()
        for b in self.branches:
            if (b.outer is None or id(b.outer) in read) and holds(b.condition) and not any(holds(x.condition) for x in b.before):
                read.add(id(b))
        return [b for b in self.branches if id(b) in read]

    def kept(self, atoms: dict[str, bool], n: int) -> list[int]:
        """Places of the tokens, of ``n``, that are read."""
        read = {id(b) for b in self._read(atoms)}
        out = bytearray(b"\1") * n
        for b in self.branches:
            if id(b) not in read:
                out[b.begin : b.end] = bytes(b.end - b.begin)
        return [i for i in range(n) if out[i]]

    def choices(self) -> Iterator[tuple[dict[str, bool], list[dict[str, bool]]]]:
        """Assignments that together read all branches; with each, what the branches that are new in it need alone."""
        left = {id(b): b for b in self.branches if self._needs(b) is not None}
        for b in self._read({}):
            left.pop(id(b), None)
        yield {}, []
        while left:
            atoms: dict[str, bool] = {}
            for b in left.values():
                needs = self._needs(b)
                if all(atoms.get(k, v) is v for k, v in needs.items()):
                    atoms |= needs
            fresh = [left.pop(id(b)) for b in self._read(atoms) if id(b) in left]
            yield atoms, [self._needs(b) for b in fresh]
