"""A generalised LL recogniser with a graph-structured stack.

Grammars are written as rules of alternatives with groups and ``* + ?``; any context-free grammar without empty loop
bodies is accepted, left-recursive and ambiguous ones too. They are compiled to small programs: match a terminal, call
a rule, branch by the next token, return. A branch whose next token leaves one way open costs no fork, so the parts of
a grammar that are LL(1) run as a plain recursive-descent parser would.

All descriptors of one token are worked off before the next token is read. Calls of a rule at a token share one stack
node whatever called them, and a node returns once per token; nodes behind the token are needed only as long as
something refers to them, so memory follows the nesting of the text, not its length.

Dialects of a language are one grammar and run together on one stack. ``@name`` in a rule lets only that dialect go on;
every descriptor carries the set of dialects it stands for, as a bit mask. Where they agree they are one descriptor, and
descriptors that differ in nothing but the set become one again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

CALL, BRANCH, RETURN, NEWLINE_OK, ONLY = -1, -2, -3, -4, -5
MATCHED, DEAD, OPEN = 1, 0, 2
EOF = "<eof>"
IDENT = "IDENT"

_META = re.compile(r"\s+|(?P<lit>'(?:[^'\\]|\\.)+')|(?P<name>[A-Za-z_@][\w]*)|(?P<op>[=|;()*+?])")


class Grammar:
    """The compiled form of a grammar text. The first rule is the start rule; ``%context`` names words that are
    keywords only where a rule wants them (rule ``Id`` takes them as identifiers elsewhere); ``%dialects`` names the
    dialects, the most likely first. Upper-case names and quoted strings are terminals; ``@asi`` succeeds before a
    closing brace, at the end, or where a line began."""

    def __init__(self, text: str):
        self.context: set[str] = set()
        self.dialects: list[str] = []
        body = []
        for line in text.splitlines():
            if line.startswith("%context"):
                self.context |= set(line.split()[1:])
            elif line.startswith("%dialects"):
                self.dialects = line.split()[1:]
            elif not line.startswith("%%"):
                body.append(line)
        self.all = (1 << max(1, len(self.dialects))) - 1
        self.kinds: dict[str, int] = {EOF: 0, IDENT: 1}
        self._literals: set[str] = set(self.context)
        self._rules: dict[str, object] = {}
        self._parse("\n".join(body))
        if "Id" not in self._rules:
            self._rules["Id"] = ("alt", [("seq", [("t", IDENT)]), *[("seq", [("t", w)]) for w in sorted(self.context)]])
        self._compile()
        #: Words that the lexer must not report as identifiers.
        self.words = {k: n for k, n in self.kinds.items() if k in self._literals and k.isidentifier()}

    def _parse(self, text: str) -> None:
        toks = [m for m in (x.group().strip() for x in _META.finditer(text)) if m]
        pos = 0

        def alt():
            nonlocal pos
            branches = [seq()]
            while toks[pos] == "|":
                pos += 1
                branches.append(seq())
            return ("alt", branches) if len(branches) > 1 else branches[0]

        def seq():
            nonlocal pos
            items = []
            while toks[pos] not in ("|", ";", ")"):
                t = toks[pos]
                pos += 1
                if t == "(":
                    node = alt()
                    pos += 1
                elif t[0] == "'":
                    node = ("t", t[1:-1])
                    self._literals.add(t[1:-1])
                elif t == "@asi":
                    node = ("asi",)
                elif t[0] == "@":
                    node = ("only", 1 << self.dialects.index(t[1:]))
                elif t.isupper():
                    node = ("t", t)
                else:
                    node = ("n", t)
                while toks[pos] in "*+?" and len(toks[pos]) == 1:
                    node = (toks[pos], node)
                    pos += 1
                items.append(node)
            return ("seq", items)

        while pos < len(toks):
            name = toks[pos]
            assert toks[pos + 1] == "=", (name, toks[pos : pos + 4])
            pos += 2
            self._rules[name] = alt()
            assert toks[pos] == ";", (name, toks[pos - 3 : pos + 3])
            pos += 1

    def _kind(self, name: str) -> int:
        return self.kinds.setdefault(name, len(self.kinds))

    def _compile(self) -> None:
        op: list[int] = []
        arg: list = []

        def emit(o: int, a=None) -> int:
            op.append(o)
            arg.append(a)
            return len(op) - 1

        def gen(node) -> None:
            what = node[0]
            if what == "t":
                emit(self._kind(node[1]))
            elif what == "n":
                emit(CALL, node[1])
            elif what == "asi":
                emit(NEWLINE_OK)
            elif what == "only":
                emit(ONLY, node[1])
            elif what == "seq":
                for x in node[1]:
                    gen(x)
            elif what == "alt":
                fork, ends = emit(BRANCH, []), []
                for x in node[1]:
                    arg[fork].append(len(op))
                    gen(x)
                    ends.append(emit(BRANCH, []))
                for e in ends:
                    arg[e].append(len(op))
            elif what == "?":
                fork = emit(BRANCH, [])
                arg[fork].append(len(op))
                gen(node[1])
                arg[fork].append(len(op))
            elif what == "*":
                fork = emit(BRANCH, [])
                arg[fork].append(len(op))
                gen(node[1])
                emit(BRANCH, [fork])
                arg[fork].append(len(op))
            elif what == "+":
                body = len(op)
                gen(node[1])
                fork = emit(BRANCH, [body])
                arg[fork].append(len(op))

        names = list(self._rules)
        entry: dict[str, int] = {}
        owner: list[str] = []
        for name in names:
            entry[name] = emit(BRANCH, [len(op) + 1])
            gen(self._rules[name])
            emit(RETURN)
            owner += [name] * (len(op) - len(owner))
        missing = {a for o, a in zip(op, arg) if o == CALL and a not in entry}
        assert not missing, f"undefined rules: {missing}"

        everything = set(self.kinds.values())
        # Tokens that can come next at each slot, and whether its rule can end without any; to a fixed point.
        first = [set() for _ in op]
        ends = [False] * len(op)
        follow = {n: set() for n in names}
        follow[names[0]] = {0}
        changed = True
        while changed:
            changed = False
            for s in range(len(op) - 1, -1, -1):
                o, f, e = op[s], None, False
                if o >= 0:
                    f = {o}
                elif o == NEWLINE_OK:
                    f, e = everything, ends[s + 1]
                elif o == ONLY:
                    f, e = first[s + 1], ends[s + 1]
                elif o == RETURN:
                    f, e = set(), True
                elif o == BRANCH:
                    f = set().union(*(first[t] for t in arg[s]))
                    e = any(ends[t] for t in arg[s])
                else:
                    a = entry[arg[s]]
                    f = first[a] | first[s + 1] if ends[a] else first[a]
                    e = ends[a] and ends[s + 1]
                    after = first[s + 1] | (follow[owner[s]] if ends[s + 1] else set())
                    if not after <= follow[arg[s]]:
                        follow[arg[s]] |= after
                        changed = True
                if not f <= first[s] or e != ends[s]:
                    first[s] |= f
                    ends[s] = ends[s] or e
                    changed = True

        def ahead(s: int) -> set[int]:
            return first[s] | follow[owner[s]] if ends[s] else first[s]

        for s, o in enumerate(op):
            if o == BRANCH:
                table: dict[int, list[int]] = {}
                for t in arg[s]:
                    for k in ahead(t):
                        table.setdefault(k, []).append(t)
                arg[s] = {k: tuple(v) for k, v in table.items()}
        for s, o in enumerate(op):
            if o == CALL:
                arg[s] = entry[arg[s]]
        self.op, self.arg, self.entry = op, arg, entry
        self.start = entry[names[0]]
        self.closing = {self.kinds[x] for x in ("}", EOF) if x in self.kinds}
        self.first, self.ends, self.follow, self.owner = first, ends, follow, owner
        #: (slot, token, next token) -> what follows without a choice, and the ways of a fork that the next token leaves
        #: open; filled as texts need them.
        self.straight: dict[tuple[int, int, int], tuple] = {}
        self.open: dict[tuple[int, int, int], tuple[int, ...]] = {}
        self._second: dict[tuple[int, int], set[int] | None] = {}

    def second(self, slot: int, t: int) -> set[int] | None:
        """Tokens that can stand behind ``t`` on the ways from ``slot`` that match it; None if that is not known."""
        key = (slot, t)
        if key not in self._second:
            self._second[key] = self._find_second(slot, t)
        return self._second[key]

    def _find_second(self, slot: int, t: int) -> set[int] | None:
        op, arg = self.op, self.arg
        out: set[int] = set()
        seen: set[tuple] = set()
        todo: list[tuple[int, tuple[int, ...]]] = [(slot, ())]
        while todo:
            s, back = state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            if len(back) > 16 or len(seen) > 3000:
                return None
            o = op[s]
            if o >= 0:
                if o == t:
                    out |= self._behind(s + 1, back)
            elif o == RETURN:
                if not back:
                    return None  # the token belongs to whatever called the rule
                todo.append((back[-1], back[:-1]))
            elif o in (NEWLINE_OK, ONLY):
                todo.append((s + 1, back))
            elif o == CALL:
                todo.extend((w, (*back, s + 1)) for w in arg[arg[s]].get(t, ()))
            else:
                todo.extend((w, back) for w in arg[s].get(t, ()))
        return out

    def _behind(self, slot: int, back: tuple[int, ...]) -> set[int]:
        out = set(self.first[slot])
        while self.ends[slot] and back:
            slot, back = back[-1], back[:-1]
            out |= self.first[slot]
        return out | self.follow[self.owner[slot]] if self.ends[slot] else out

    def ways(self, slot: int, t: int, after: int) -> tuple[int, ...]:
        """The ways of a fork that two tokens leave open."""
        key = (slot, t, after)
        found = self.open.get(key)
        if found is None:
            possible = [(w, self.second(w, t)) for w in self.arg[slot].get(t, ())]
            found = self.open[key] = tuple(w for w, tokens in possible if tokens is None or after in tokens)
        return found


def _run_straight(g: Grammar, slot: int, t: int, after: int) -> tuple:
    """What token ``t``, before ``after``, leads to from ``slot`` as long as there is one way: (calls, slot, outcome).

    ``calls`` are the (rule, return slot) met on the way. Outcome: MATCHED, the slot behind the token; RETURN, a rule
    ends at the slot; DEAD; or OPEN, the slot has to be looked at with its node: a fork, a line end, a
    dialect's own, or a rule met twice.
    """
    op, arg = g.op, g.arg
    calls: list[tuple[int, int]] = []
    seen: set[int] = set()
    while True:
        o = op[slot]
        if o >= 0:
            return (tuple(calls), slot + 1, MATCHED) if o == t else ((), slot, DEAD)
        if o == RETURN:
            return tuple(calls), slot, RETURN
        if o in (NEWLINE_OK, ONLY):
            return tuple(calls), slot, OPEN
        rule = arg[slot] if o == CALL else slot
        ways = arg[rule].get(t) or ()
        if len(ways) > 1 and o == BRANCH:
            ways = g.ways(slot, t, after)
        if not ways:
            return (), slot, DEAD
        if len(ways) > 1 or (o == CALL and rule in seen):
            return tuple(calls), slot, OPEN
        if o == CALL:
            seen.add(rule)
            calls.append((rule, slot + 1))
        slot = ways[0]


def recognise(g: Grammar, tokens: Sequence[int], line_began: Sequence[bool] | None = None) -> tuple[int, int]:
    """(place, dialects): -1 and the bits of the dialects in which ``tokens`` (kinds, closed by EOF's) form a sentence of
    ``g``; or the place of the first token that no descriptor can take, and 0. ``line_began[i]``: a line end stands
    before token i.

    A stack node is [edges (return slot, node below), token of its last return, dialects returned with there]. It is of
    one set of dialects: calls of a rule by another set have a node of their own.
    """
    op, arg, closing, straight, opened = g.op, g.arg, g.closing, g.straight, g.open
    root: list = [[], -1, 0]
    now: list[tuple[int, list, int]] = [(g.start, root, g.all)]
    accepted = 0
    n = len(tokens)
    for i, t in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < n else 0
        nxt: list[tuple[int, list, int]] = []
        accepted = 0
        made: list[tuple[tuple[int, int], list]] = []
        if len(now) == 1:  # one descriptor: go on without bookkeeping until it forks
            slot, u, mask = now.pop()
            while True:
                step = straight.get((slot, t, after))
                if step is None:
                    step = straight[slot, t, after] = _run_straight(g, slot, t, after)
                calls, slot, outcome = step
                for rule, back in calls:
                    u = [[(back, u)], -1, 0]
                    made.append(((rule, mask), u))
                if outcome == MATCHED:
                    nxt.append((slot, u, mask))
                    break
                if outcome == RETURN and u is not root and u[1] != i and len(u[0]) == 1 and len(made) < 500:
                    u[1], u[2] = i, mask
                    slot, u = u[0][0]
                    continue
                if outcome != DEAD:
                    now.append((slot, u, mask))
                break
        if now:
            called: dict[tuple[int, int], list] = dict(made)
            forked: dict[tuple[int, int], list] = {}  # (way, node): [dialects that went it, node], so that ids stay theirs
        while now:
            slot, u, mask = now.pop()
            while True:
                o = op[slot]
                if o >= 0:
                    if o == t:
                        nxt.append((slot + 1, u, mask))
                    break
                if o == CALL:
                    rule = arg[slot]
                    ways = arg[rule].get(t)
                    if ways is None:
                        break
                    v = called.get((rule, mask))
                    if v is None:
                        called[rule, mask] = v = [[(slot + 1, u)], -1, 0]
                        u, slot = v, ways[0]
                        continue
                    for r, p in v[0]:
                        if p is u and r == slot + 1:
                            break
                    else:
                        v[0].append((slot + 1, u))
                        if v[1] == i:  # the rule already matched nothing here
                            slot, mask = slot + 1, v[2]
                            continue
                    break
                if o == BRANCH:
                    ways = arg[slot].get(t)
                    if ways is None:
                        break
                    if len(ways) > 1:
                        ways = opened.get((slot, t, after))
                        if ways is None:
                            ways = g.ways(slot, t, after)
                        if not ways:
                            break
                    if len(ways) > 1:
                        for way in ways[1:]:
                            gone = forked.get((way, id(u)))
                            if gone is None:
                                forked[way, id(u)] = [mask, u]
                                now.append((way, u, mask))
                            elif mask & ~gone[0]:
                                now.append((way, u, mask & ~gone[0]))
                                gone[0] |= mask
                        gone = forked.get((ways[0], id(u)))
                        if gone is None:
                            forked[ways[0], id(u)] = [mask, u]
                        else:
                            mask &= ~gone[0]
                            if not mask:
                                break
                            gone[0] |= mask
                    slot = ways[0]
                    continue
                if o == RETURN:
                    if u is root:
                        accepted |= mask
                        break
                    if u[1] == i:
                        mask &= ~u[2]
                        if not mask:
                            break
                        u[2] |= mask
                    else:
                        u[1], u[2] = i, mask
                    edges = u[0]
                    for r, p in edges[1:]:
                        now.append((r, p, mask))
                    slot, u = edges[0]
                    continue
                if o == ONLY:
                    mask &= arg[slot]
                    if not mask:
                        break
                    slot += 1
                    continue
                # NEWLINE_OK
                if t in closing or (line_began is not None and line_began[i]):
                    slot += 1
                    continue
                break
        if t == 0:
            return (-1, accepted) if accepted else (i, 0)
        if not nxt:
            return i, 0
        if len(nxt) > 1:
            merged: dict[tuple[int, int], tuple[int, list, int]] = {}
            for s, u, mask in nxt:
                before = merged.get((s, id(u)))
                merged[s, id(u)] = (s, u, mask if before is None else mask | before[2])
            nxt = list(merged.values())
        now = nxt
    return len(tokens) - 1, 0
