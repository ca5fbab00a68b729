"""Lexers: source text to token kinds of a grammar. A text that can't be cut into tokens raises ``LexError``."""

from __future__ import annotations

import re

from tokenloom.llm.syntax.conditionals import Conditionals
from tokenloom.llm.syntax.gll import IDENT, Grammar


class LexError(ValueError):
    """There is no token at ``args[0]``."""


class Tokens:
    """Kinds, closed by the end mark; the place of each token; whether a line end stands before it. With conditional
    directives these are the tokens of all branches, of which ``conditionals`` tells what is read together."""

    __slots__ = ("kinds", "places", "began", "conditionals")

    def __init__(self, kinds: list[int], places: list[int], began: list[bool] | None = None, conditionals: Conditionals | None = None):
        self.kinds, self.places, self.began, self.conditionals = kinds, places, began, conditionals


def _inner(lexer, text: str, start: int, stop: int, before: str = "", after: str = "") -> tuple[list[int], list[int]]:
    """Tokens of an expression inside a string, without the end mark; an empty one is an error."""
    if not text[start:stop].strip():
        raise LexError(start)
    try:
        tokens = lexer(before + text[start:stop] + after)
    except LexError as e:
        raise LexError(min(stop, max(start, start + e.args[0] - len(before)))) from None
    if tokens.conditionals:
        raise LexError(start)
    return tokens.kinds[:-1], [min(stop, max(start, start + p - len(before))) for p in tokens.places[:-1]]


_IDENT = r"[^\W\d]\w*"
_NUMBER_C = r"""(?:0[xX][\da-fA-F][\da-fA-F']*(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01][01']*
  |(?:\d[\d']*\.?(?:\d[\d']*)?|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]|ll|LL){0,3}(?!\w)"""
_NUMBER_JAVA = r"""(?:0[xX][\da-fA-F][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01][01_]*
  |(?:\d[\d_]*(?:\.(?:\d[\d_]*)?(?![.\w]|$)|\.\d[\d_]*|\.(?=[eEfFdD]))?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)"""
_NUMBER_CS = r"""(?:0[xX][\da-fA-F][\da-fA-F_]*|0[bB][01][01_]*|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)
  (?:[uU][lL]?|[lL][uU]?|[fFdDmM])?(?!\w)"""
_NUMBER_JS = r"""(?:0[xX][\da-fA-F][\da-fA-F_]*n?|0[bB][01][01_]*n?|0[oO][0-7][0-7_]*n?|\d[\d_]*n
  |(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?![\w$])"""
_NUMBER_PHP = r"""(?:0[xX][\da-fA-F][\da-fA-F_]*|0[bB][01][01_]*|0[oO][0-7][0-7_]*|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?!\w)"""
_STRING = r'"(?:[^"\\\n]|\\.)*"'
_CHAR_ONE = r"'(?:[^'\\\n]|\\u+[\da-fA-F]{4}|\\x[\da-fA-F]{1,4}|\\U[\da-fA-F]{8}|\\[0-7]{1,3}|\\.)'"

_DIRECTIVE = re.compile(r"#[ \t]*(\w*)((?:[^\n\\]|\\(?:\r?\n|.))*)", re.S)
_C_DIRECTIVES = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident embed".split())
_CS_DIRECTIVES = frozenset("if else elif endif region endregion define undef warning error line pragma nullable".split())


def _master(number: str, strings: str, chars: str, ops: str, ident: str = _IDENT, comment: str = r"//[^\n]*") -> re.Pattern:
    return re.compile(
        rf"(?P<blank>(?>\s+|{comment}|/\*.*?\*/|\\\r?\n)*+)(?:(?P<str>{strings})|(?P<chr>{chars})|(?P<id>{ident})|(?P<num>{number})|(?P<bad>/\*)|(?P<op>{ops})|(?P<end>\Z)|(?P<hash>\#))"
        .replace("\n  ", ""),
        re.S,
    )


_OPS_C = r"\.\.\.|<<=|->\*|->|\.\*|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|\#\#|[-+*/%&|^~!<>=?:;,.(){}\[\]]"
_OPS_JAVA = r"\.\.\.|<<=|->|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~!<>=?:;,.(){}\[\]@]"
_OPS_CS = r"\.\.|\?\?=|\?\?|\?\.(?!\d)|<<=|->|=>|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~!<>=?:;,.(){}\[\]]"

_RAW_CPP = r'(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|'
_MASTERS = {
    "c": _master(_NUMBER_C, r'(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"', r"(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'", _OPS_C, r"[^\W\d][\w$]*", r"//(?:[^\n\\]|\\.)*"),
    "cpp": _master(_NUMBER_C, _RAW_CPP + r'(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"', r"(?:u8|[uUL])?'(?:[^'\\\n]|\\.)+'", _OPS_C, r"[^\W\d][\w$]*", r"//(?:[^\n\\]|\\.)*"),
    "java": _master(_NUMBER_JAVA, r'"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|' + _STRING, _CHAR_ONE, _OPS_JAVA, r"[^\W\d][\w$]*|\$[\w$]*"),
    "csharp": _master(
        _NUMBER_CS,
        rf'(?:\$@|@\$)"|\$+(?:"{{3,}}|")|(?P<q>"{{3,}})(?!").*?(?<!")(?P=q)(?!")|@"(?:[^"]|"")*"|(?:{_STRING})(?:u8)?',  # of the interpolated ones only the head
        _CHAR_ONE, _OPS_CS, r"@?[^\W\d]\w*",
    ),
}


_NEXT_DIRECTIVE = re.compile(r"^[ \t]*(?=#)", re.M)
_CS_PLAIN = re.compile(rf'@"(?:[^"]|"")*"|{_STRING}|{_CHAR_ONE}', re.S)
_CS_HEAD = re.compile(r'(\$@|@\$)(?=")|(\$+)("{3,}|")')


def _interpolated(text: str, pos: int) -> tuple[int, list[tuple[int, int]]]:
    """End and holes (the expression of each, without alignment and format) of the C# string that begins at ``pos``."""
    head = _CS_HEAD.match(text, pos)
    verbatim, quote, braces = head[1] is not None, head[3] or '"', "{" * head[0].count("$")
    raw, at, n = len(quote) > 2, head.end() + verbatim, len(text)
    holes: list[tuple[int, int]] = []
    while at < n:
        c = text[at]
        if c == '"':
            if raw:
                run = re.compile('"+').match(text, at).end()
                if run - at >= len(quote):
                    return run, holes
                at = run
            elif verbatim and text.startswith('""', at):
                at += 2
            else:
                return at + 1, holes
        elif c == "\\" and not (verbatim or raw):
            at += 2
        elif c == "\n" and not (verbatim or raw):
            raise LexError(at)
        elif c == "{":
            run = re.compile("{+").match(text, at).end()
            if run - at < len(braces) or (not raw and (run - at) % 2 == 0):
                at = run
                continue
            start = at = run
            stop, depth = -1, 0
            while True:
                if at >= n:
                    raise LexError(start)
                c = text[at]
                if stop < 0 and c in "$@\"'":
                    if _CS_HEAD.match(text, at):
                        at = _interpolated(text, at)[0]
                        continue
                    plain = _CS_PLAIN.match(text, at)
                    if plain:
                        at = plain.end()
                        continue
                if stop < 0 and c in "([{":
                    depth += 1
                elif stop < 0 and depth and c in ")]}":
                    depth -= 1
                elif c == "}":
                    break
                elif stop < 0 and not depth and text.startswith("::", at):
                    at += 1
                elif stop < 0 and not depth and c in ",:":
                    stop = at
                at += 1
            holes.append((start, at if stop < 0 else stop))
            if raw and not text.startswith("}" * len(braces), at):
                raise LexError(at)
            at += len(braces) if raw else 1
        else:
            at += 1
    raise LexError(pos)


def c_like(text: str, g: Grammar, family: str) -> Tokens:
    """C, C++, Java, C#. Branches of conditional directives all give their tokens, but those known never to be read. A
    hole of an interpolated string becomes a call of the string with its expression."""
    match = _MASTERS[family].match
    kinds_of, words, ident = g.kinds, g.words, g.kinds[IDENT]
    number, string, char = (g.kinds.get(k, -9) for k in ("NUM", "STR", "CHR"))
    directives = {"c": _C_DIRECTIVES, "cpp": _C_DIRECTIVES, "csharp": _CS_DIRECTIVES}.get(family, frozenset())
    kinds: list[int] = []
    places: list[int] = []
    branches: Conditionals | None = None
    pos = 0
    while True:
        m = match(text, pos)
        if m is None:
            raise LexError(pos)
        what, pos = m.lastgroup, m.end()
        at = m.start(what)
        if what == "id":
            kind = words.get(m[what], ident)
        elif what == "op":
            kind = kinds_of.get(m[what])
            if kind is None:
                raise LexError(at)
        elif what == "num":
            kind = number
        elif what == "str":
            kind = string
            if family == "csharp" and (text[at] == "$" or text.startswith("@$", at)):
                pos, holes = _interpolated(text, at)
                kinds.append(kind)
                places.append(at)
                for start, stop in holes:
                    own, where = _inner(lambda t: c_like(t, g, family), text, start, stop)
                    kinds += [kinds_of["("], kinds_of["("], *own, kinds_of[")"], kinds_of[")"]]
                    places += [start, start, *where, stop, stop]
                continue
        elif what == "chr":
            kind = char
        elif what == "end":
            if branches and not branches.closed():
                raise LexError(at)
            kinds.append(0)
            places.append(at)
            return Tokens(kinds, places, None, branches)
        elif what == "hash" and directives:
            if text[text.rfind("\n", 0, at) + 1 : at].strip() and not m["blank"].endswith("*/"):
                raise LexError(at)
            d = _DIRECTIVE.match(text, at)
            name, pos = d[1], d.end()
            if name and name not in directives and not (branches and branches.is_dead()):
                raise LexError(at)
            if name.startswith(("if", "el", "endif")):
                branches = branches or Conditionals(family)
                if not branches.directive(name, d[2], len(kinds)):
                    raise LexError(at)
                if branches.is_dead():  # to the next directive, whatever stands there
                    m = _NEXT_DIRECTIVE.search(text, pos)
                    pos = m.end() if m else len(text)
            elif branches and branches.is_dead():
                m = _NEXT_DIRECTIVE.search(text, pos)
                pos = m.end() if m else len(text)
            continue
        else:
            raise LexError(at)
        kinds.append(kind)
        places.append(at)


_JS = re.compile(
    rf"""(?P<blank>(?>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)*+)(?:(?P<id>\#?(?:[^\W\d]|[$])[\w$]*)|(?P<num>{_NUMBER_JS})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<bad>/\*)"""
    r"""|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|[-+*/%&|^~!<>=?:;,.(){}\[\]@])|(?P<tick>`)|(?P<end>\Z))""".replace("\n  ", ""),
    re.S,
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)
_VALUE_WORDS = frozenset("this super null true false".split())


def javascript(text: str, g: Grammar) -> Tokens:
    """Whether a slash begins a regular expression follows from the token before it. Templates become
    ``TPL_FULL``, or ``TPL_HEAD`` expression (``TPL_MID`` expression)* ``TPL_TAIL``."""
    kinds_of, words, ident = g.kinds, g.words, g.kinds[IDENT]
    kinds: list[int] = []
    places: list[int] = []
    began: list[bool] = []
    braces: list[bool] = []  # True: a template goes on after the closing brace
    value = False  # the last token ends a value
    pos = 2 if text.startswith("#!") else 0
    if pos:
        pos = (text.find("\n") + 1) or len(text)
    first = True

    def template(at: int, head: bool) -> tuple[str, int]:
        end = _TEMPLATE.match(text, at).end()
        if end >= len(text):
            raise LexError(at)
        if text[end] == "`":
            return ("TPL_FULL" if head else "TPL_TAIL"), end + 1
        braces.append(True)
        return ("TPL_HEAD" if head else "TPL_MID"), end + 2

    while True:
        m = _JS.match(text, pos)
        if m is None:
            raise LexError(pos)
        what, end = m.lastgroup, m.end()
        at = m.start(what)
        newline = first or "\n" in m["blank"] or "\r" in m["blank"]
        first = False
        if what == "id":
            word = m[what]
            kind = words.get(word, ident)
            value = kind == ident or word in _VALUE_WORDS or word in g.context
        elif what == "op":
            op = m[what]
            if op in ("/", "/=") and not value:
                r = _JS_REGEX.match(text, at)
                if r is None:
                    raise LexError(at)
                kind, end, value = kinds_of["REGEX"], r.end(), True
            elif op == "}" and braces and braces[-1]:
                braces.pop()
                name, end = template(end, False)
                kind, value = kinds_of[name], name == "TPL_TAIL"
            else:
                if op == "{":
                    braces.append(False)
                elif op == "}" and braces:
                    braces.pop()
                kind = kinds_of.get(op)
                if kind is None:
                    raise LexError(at)
                value = op in (")", "]", "}") or (op in ("++", "--") and value)
        elif what == "num":
            kind, value = kinds_of["NUM"], True
        elif what == "str":
            kind, value = kinds_of["STR"], True
        elif what == "tick":
            name, end = template(end, True)
            kind, value = kinds_of[name], name == "TPL_FULL"
        elif what == "end":
            kinds.append(0)
            places.append(at)
            began.append(True)
            return Tokens(kinds, places, began)
        else:
            raise LexError(at)
        kinds.append(kind)
        places.append(at)
        began.append(newline)
        pos = end


_PHP_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=|(?=\s))", re.I)
_PHP = re.compile(
    rf"""(?P<blank>(?>\s+|(?://|\#(?!\[))(?:(?!\?>)[^\n])*|/\*.*?\*/)*+)(?:(?P<close>\?>\n?)|(?P<var>\$[^\W\d]\w*)|(?P<here><<<[ \t]*(?P<hq>['"]?)(?P<tag>[^\W\d]\w*)(?P=hq)\r?\n)|(?P<id>\\?{_IDENT}(?:\\{_IDENT})*(?:\\(?=\{{))?)"""
    rf"""|(?P<num>{_NUMBER_PHP})|(?P<str>[bB]?"(?:[^"\\]|\\.)*"|[bB]?'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<bad>/\*)|(?P<cast>\([ \t]*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)[ \t]*\))"""
    r"""|(?P<op>\#\[|\?->|\?\?=|<=>|\*\*=|\.\.\.|===|!==|<<=|>>=|->|=>|::|\+\+|--|<<|>>|<=|>=|==|!=|<>|&&|\|\||\?\?|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\*\*|[-+*/%&|^~!<>=?:;,.(){}\[\]@$])|(?P<end>\Z))""".replace("\n  ", ""),
    re.S | re.I,
)


_PHP_SUBSCRIPT = re.compile(r"\[(?:-?\d+|0[xX][\da-fA-F]+|0[bB][01]+|\$?[^\W\d]\w*)\]")
_PHP_PLAIN = re.compile(r"'(?:[^'\\]|\\.)*'", re.S)
_PHP_NAME = re.compile(r"[^\W\d]\w*")


def _php_holes(text: str, at: int, quote: str, stop: int) -> tuple[int, list[tuple[int, int]]]:
    """End and expressions of the interpolated text from ``at`` to ``quote`` (to ``stop`` if that is empty)."""
    holes: list[tuple[int, int]] = []
    while at < stop:
        c = text[at]
        if c == "\\":
            at += 2
        elif quote and c == quote:
            return at + 1, holes
        elif text.startswith(("{$", "${"), at):
            start, name = at + 1, None
            at += 1
            if c == "$":
                start = at = at + 1
                name = _PHP_NAME.match(text, at)
                if name and name.end() < stop and text[name.end()] in "[}":
                    start = at = name.end() + (text[name.end()] == "[")
            depth = int(bool(name) and start > name.end())
            while at < stop and (depth or text[at] != "}"):
                c = text[at]
                if c == '"':
                    at = _php_holes(text, at + 1, c, stop)[0]
                    continue
                plain = _PHP_PLAIN.match(text, at)
                if plain:
                    at = plain.end()
                    continue
                depth += (c in "([{") - (c in ")]}")
                at += 1
            if at >= stop:
                raise LexError(start)
            if not name or start != name.end():  # else it is but a name
                end = at
                if name and start > name.end():  # a name and its subscript
                    end = text.rfind("]", start, at)
                holes.append((start, end))
            at += 1
        elif c == "$" and (name := _PHP_NAME.match(text, at + 1)):
            at = name.end()
            if at < stop and text[at] == "[":
                subscript = _PHP_SUBSCRIPT.match(text, at, stop)
                if subscript is None:
                    raise LexError(at)
                at = subscript.end()
        else:
            at += 1
    if quote:
        raise LexError(at)
    return stop, holes


def php(text: str, g: Grammar) -> Tokens:
    """Text outside the tags is an ``HTML`` statement; a closing tag ends a statement. An expression inside a string is
    joined to it by ``.``."""
    kinds_of, words, ident = g.kinds, g.words, g.kinds[IDENT]
    kinds: list[int] = []
    places: list[int] = []
    pos, inside = 0, False
    while True:
        if not inside:
            m = _PHP_OPEN.search(text, pos)
            end = m.start() if m else len(text)
            if end > pos:
                kinds.append(kinds_of["HTML"])
                places.append(pos)
            if m is None:
                kinds.append(0)
                places.append(len(text))
                return Tokens(kinds, places)
            if m[0].endswith("="):
                kinds.append(kinds_of["echo"])
                places.append(m.start())
            pos, inside = m.end(), True
        m = _PHP.match(text, pos)
        if m is None:
            raise LexError(pos)
        what, pos = m.lastgroup, m.end()
        at = m.start(what)
        holes = ()
        if what == "id":
            word = m[what]
            kind = kinds_of["QNAME"] if "\\" in word else words.get(word.lower(), ident)
            if kind != ident and kinds and kinds[-1] in (kinds_of["->"], kinds_of["?->"]):
                kind = ident
        elif what == "var":
            kind = kinds_of["VAR"]
        elif what == "here":
            close = re.compile(r"^[ \t]*" + m["tag"] + r"\b", re.M).search(text, pos)
            if close is None:
                raise LexError(at)
            if m["hq"] != "'":
                holes = _php_holes(text, pos, "", close.start())[1]
            kind, pos = kinds_of["STR"], close.end()
        elif what == "op":
            kind = kinds_of.get(m[what])
            if kind is None:
                raise LexError(at)
        elif what == "close":
            kind, inside = kinds_of[";"], False
        elif what == "end":
            kinds.append(0)
            places.append(at)
            return Tokens(kinds, places)
        elif what == "cast":
            kind = kinds_of["CAST"]
        elif what == "num":
            kind = kinds_of["NUM"]
        elif what == "str":
            kind = kinds_of["STR"]
            body = at + (text[at] in "bB")
            if text[body] != "'" and "$" in m[what]:
                pos, holes = _php_holes(text, body + 1, text[body], len(text))
        else:
            raise LexError(at)
        kinds.append(kind)
        places.append(at)
        for start, stop in holes:
            own, where = _inner(lambda t: php(t, g), text, start, stop, "<?php ")
            kinds += [kinds_of["."], kinds_of["("], *own, kinds_of[")"]]
            places += [start, start, *where, stop]


_PY = re.compile(
    r"""(?P<blank>(?>[ \t\f]+|\\\r?\n)*+)(?:(?P<nl>\r\n|\r|\n)|(?P<com>\#[^\r\n]*)"""
    r"""|(?P<fields>(?:[rR][fFtT]|[fFtT][rR]?)(?:'''|\"\"\"|'|"))|(?P<str>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\r\n]|\\.)*'|"(?!"")(?:[^"\\\r\n]|\\.)*"))"""
    r"""|(?P<id>[^\W\d]\w*)|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?P<dec>\d(?:_?\d)*)(?P<frac>\.(?:\d(?:_?\d)*)?)?(?P<exp>[eE][+-]?\d(?:_?\d)*)?(?P<imag>[jJ])?"""
    r"""|\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?P<glued>\w*))"""
    r"""|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>=:;,.(){}\[\]])|(?P<end>\Z))""",
    re.S,
)
_PY_BOTH = re.compile(_PY.pattern.replace(r"(?P<op>", r"(?P<op><>|`|"), re.S)
_PY_NUMBER_OLD = re.compile(r"0[xX][\da-fA-F]+[lL]?(?!\w)|0[bB][01]+[lL]?(?!\w)|0[oO]?[0-7]+[lL]?(?![.\w])|[1-9]\d*[lL](?!\w)|0[lL](?!\w)")
_PY_STRING_OLD = re.compile(r"""[uU][rR](?:'''(?:[^\\]|\\.)*?'''|\"\"\"(?:[^\\]|\\.)*?\"\"\"|'(?!'')(?:[^'\\\r\n]|\\.)*'|"(?!"")(?:[^"\\\r\n]|\\.)*")""", re.S)
_PY_STRING = re.compile(r"""([A-Za-z]{0,2})('''|\"\"\"|'|")""")


_PY_SHOWN = re.compile(r"=\s*(?=[}:]|!(?!=))")


def _formatted(text: str, pos: int) -> tuple[int, list[tuple[int, int]]]:
    """End of the formatted string that begins at ``pos``, and the expression of each of its fields, which may hold
    strings with the same quotes. The end is -1 if there is none or a brace is left over."""
    head = _PY_STRING.match(text, pos)
    quote, raw, at, n = head[2], "r" in head[1].lower(), head.end(), len(text)
    fields: list[tuple[int, int]] = []
    opened: list[list[int]] = []  # of each open field its start, its open brackets, and where its expression ends or -1
    while at < n:
        c = text[at]
        if not opened or opened[-1][2] >= 0:  # in text, or in a format
            if c == "\\":
                named = not raw and text.startswith("N{", at + 1)
                at = (text.find("}", at) + 1 or n) if named else at + (1 if text[at + 1 : at + 2] in ("{", "}") else 2)
            elif not opened and text.startswith(quote, at):
                return at + len(quote), fields
            elif c == "\n" and len(quote) == 1:
                return -1, []
            elif not opened and text.startswith(("{{", "}}"), at):
                at += 2
            elif c == "{":
                opened.append([at + 1, 0, -1])
                at += 1
            elif c == "}":
                if not opened:
                    return -1, []
                start, _, stop = opened.pop()
                fields.append((start, stop))
                at += 1
            else:
                at += 1
            continue
        string = _PY_STRING.match(text, at)
        if string and not (text[at - 1].isalnum() or text[at - 1] == "_"):
            if "f" in string[1].lower() or "t" in string[1].lower():
                at = _formatted(text, at)[0]
            else:
                m = _PY.match(text, at)
                at = m.end() if m and m.lastgroup == "str" else -1
            if at < 0:
                return -1, []
        elif c in "([{":
            opened[-1][1] += 1
            at += 1
        elif opened[-1][1]:
            opened[-1][1] -= c in ")]}"
            at += 1
        elif c == "}":
            fields.append((opened.pop()[0], at))
            at += 1
        elif c == ":" or (c == "!" and text[at + 1 : at + 2] != "="):
            opened[-1][2] = at
            at += 1
        elif c == "=" and (shown := _PY_SHOWN.match(text, at)) and text[at - 1] not in "=!<>":
            opened[-1][2] = at
            at = shown.end()
            if text[at] == "}":
                fields.append((opened[-1][0], opened.pop()[2]))
                at += 1
        else:
            at += 1
    return -1, []


_GLUE_WORDS = frozenset("and or if else in is for not".split())


def python(text: str, g: Grammar) -> Tokens:
    """Lines and indentation become ``NEWLINE``, ``INDENT`` and ``DEDENT``; tabs reach to the next multiple of eight,
    and must agree with tabs of one column. The fields of formatted strings become calls of the string, behind all strings
    that are joined to it. What only one of the dialects has is told apart by its kind."""
    match = _PY_BOTH.match
    kinds_of, words, ident = g.kinds, g.words, g.kinds[IDENT]
    newline, indent, dedent = kinds_of["NEWLINE"], kinds_of["INDENT"], kinds_of["DEDENT"]
    number, string, strings = kinds_of["NUM"], kinds_of["STR"], {kinds_of[k] for k in ("STR", "STRNEW", "STROLD")}
    kinds: list[int] = []
    places: list[int] = []
    levels: list[tuple[int, int]] = [(0, 0)]
    fields: list[tuple[list[int], list[int]]] = []
    depth, start, pos = [], True, 1 if text.startswith("﻿") else 0
    while True:
        m = match(text, pos)
        if m is None:
            raise LexError(pos)
        what, pos = m.lastgroup, m.end()
        if what == "glued":
            what = "num"
        at = m.start(what)
        if what == "com":
            continue
        if what == "nl":
            if depth or start:
                continue
            _put(fields, kinds, places)
            kinds.append(newline)
            places.append(at)
            start = True
            continue
        if what == "end":
            if depth:
                raise LexError(at)
            _put(fields, kinds, places)
            if not start:
                kinds.append(newline)
                places.append(at)
            kinds += [dedent] * (len(levels) - 1) + [0]
            places += [at] * len(levels)
            return Tokens(kinds, places)
        if start:
            start = False
            lead = text[max(text.rfind("\n", 0, at), text.rfind("\r", 0, at)) + 1 : at]
            wide = narrow = 0
            for c in lead:
                if c == "\t":
                    wide, narrow = (wide // 8 + 1) * 8, narrow + 1
                elif c == "\f":
                    wide = narrow = 0
                elif c == " ":
                    wide, narrow = wide + 1, narrow + 1
            if wide > levels[-1][0]:
                if narrow <= levels[-1][1]:
                    raise LexError(at)
                levels.append((wide, narrow))
                kinds.append(indent)
                places.append(at)
            else:
                while wide < levels[-1][0]:
                    levels.pop()
                    kinds.append(dedent)
                    places.append(at)
                if (wide, narrow) != levels[-1]:
                    raise LexError(at)
        if what == "id":
            kind = words.get(m[what], ident)
            if kind == ident and m[what] in ("ur", "uR", "Ur", "UR") and (old := _PY_STRING_OLD.match(text, at)):
                kind, pos = kinds_of["STROLD"], old.end()
        elif what == "op":
            op = m[what]
            if op in "([{":
                depth.append({"(": ")", "[": "]", "{": "}"}[op])
            elif op in ")]}" and (not depth or depth.pop() != op):
                raise LexError(at)
            kind = kinds_of.get(op)
            if kind is None:
                raise LexError(at)
        elif what == "num":
            glued, dec = m["glued"], m["dec"]
            wrong = (glued and glued not in _GLUE_WORDS) or (dec and dec[0] == "0" and dec.strip("0_") and not (m["frac"] or m["exp"] or m["imag"]))
            pos -= len(glued)
            kind = number
            if wrong:
                old = _PY_NUMBER_OLD.match(text, at)
                if old is None:
                    raise LexError(at)
                kind, pos = kinds_of["NUMOLD"], old.end()
            elif not dec and text[at] == "0" and text[at + 1] in "oO" and "_" in text[at:pos]:
                kind = kinds_of["NUMNEW"]
        else:
            kind = string
            if what == "str" and text[at : at + 2].lower() == "rb":
                kind = kinds_of["STRNEW"]
            elif what == "fields":
                kind = kinds_of["STRNEW"]
                pos, found = _formatted(text, at)
                if pos < 0:
                    raise LexError(at)
                for begin, stop in found:
                    own, where = _inner(lambda t: python(t, g), text, begin, stop, "(", "\n)")
                    fields.append(([kinds_of["("], *own[:-1], kinds_of[")"]], [begin, *where[:-1], stop]))
        if fields and kind not in strings:
            _put(fields, kinds, places)
        kinds.append(kind)
        places.append(at)


def _put(fields: list[tuple[list[int], list[int]]], kinds: list[int], places: list[int]) -> None:
    for own, where in fields:
        kinds += own
        places += where
    fields.clear()
