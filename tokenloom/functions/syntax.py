"""Syntax of a snippet on a parser-neutral node table: leaf paths, scopes, declarations and usages.

A parser hands over its tree as nodes in pre-order; all rules below work on that table, so they are the same for every
parser and can be tested without one. All walks are iterative: nesting of any depth is handled.
"""

from __future__ import annotations

import ast
import importlib
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple


class Node(NamedTuple):
    node_id: int
    parent_id: int | None
    field: str | None
    type: str
    named: bool
    start: int
    end: int


# Node types and their roles, by language where they differ.
IDENTIFIER_TYPES = frozenset({"identifier", "name", "variable_name", "simple_identifier"})
NO_IDENTIFIER_TYPES = frozenset({"field_identifier", "property_identifier", "shorthand_property_identifier", "type_identifier", "primitive_type"})
SCOPE_TYPES = frozenset(
    {"module", "program", "translation_unit", "block", "compound_statement", "statement_block", "declaration_list", "class_body", "enum_body", "namespace_body", "catch_clause", "except_clause"}
)
SCOPE_PARTS = (
    "function_definition", "function_declaration", "method_definition", "method_declaration", "constructor_declaration", "class_definition", "class_declaration", "namespace_definition", "lambda",
)
NAMED_DECLARATIONS = {
    "C": {"function": ("function_definition", "function_declarator")},
    "C++": {"function": ("function_definition", "function_declarator", "template_declaration"), "class": ("class_specifier", "struct_specifier"), "namespace": ("namespace_definition",)},
    "Java": {"function": ("method_declaration", "constructor_declaration"), "class": ("class_declaration", "interface_declaration", "enum_declaration")},
    "C#": {
        "function": ("method_declaration", "constructor_declaration"),
        "class": ("class_declaration", "interface_declaration", "struct_declaration", "enum_declaration"),
        "namespace": ("namespace_declaration",),
    },
    "Javascript": {"function": ("function_declaration", "function_expression", "arrow_function", "method_definition"), "class": ("class_declaration",)},
    "PHP": {"function": ("function_definition", "method_declaration"), "class": ("class_declaration", "interface_declaration", "trait_declaration"), "namespace": ("namespace_definition",)},
    "Python": {"function": ("function_definition",), "class": ("class_definition",)},
}
TARGET_WRAPPERS = frozenset({"tuple_pattern", "list_pattern", "object_pattern", "array_pattern", "formal_parameter", "parenthesized_expression", "parenthesized_pattern"})
MEMBER_TYPES = frozenset({"field_expression", "member_expression", "attribute", "subscript_expression"})
MEMBER_FIELDS = frozenset({"property", "field", "attribute"})


def is_identifier(kind: str) -> bool:
    return kind not in NO_IDENTIFIER_TYPES and (kind in IDENTIFIER_TYPES or kind.endswith("identifier"))


def opens_scope(kind: str) -> bool:
    return kind in SCOPE_TYPES or kind.endswith("_block") or any(part in kind for part in SCOPE_PARTS)


class Tree:
    def __init__(self, nodes: Sequence[Node], code: str):
        self.nodes, self.code = list(nodes), code
        self.at = {n.node_id: n for n in self.nodes}
        self.children: dict[int, list[Node]] = {n.node_id: [] for n in self.nodes}
        for n in self.nodes:
            if n.parent_id is not None:
                self.children[n.parent_id].append(n)

    def text(self, n: Node) -> str:
        return self.code[n.start : n.end]

    def fields(self, n: Node, *names: str) -> list[Node]:
        """The first child of each field name."""
        found = []
        for name in names:
            found += [c for c in self.children[n.node_id] if c.field == name][:1]
        return found

    def ancestors(self, n: Node):
        while n.parent_id is not None:
            n = self.at[n.parent_id]
            yield n

    def identifiers(self, n: Node) -> list[Node]:
        """Outermost identifiers under a node, itself included, in order."""
        found, todo = [], [n]
        while todo:
            x = todo.pop()
            if is_identifier(x.type):
                found.append(x)
            else:
                todo.extend(reversed(self.children[x.node_id]))
        return found

    def within(self, inner: Node, outer: Node) -> bool:
        return outer.start <= inner.start and inner.end <= outer.end

    def leaves(self) -> list[tuple[Node, str]]:
        """Non-empty leaves with their path from the root."""
        paths: dict[int, str] = {}
        out = []
        for n in self.nodes:
            paths[n.node_id] = n.type if n.parent_id is None else f"{paths[n.parent_id]} > {n.type}"
            if not self.children[n.node_id] and n.end > n.start:
                out.append((n, paths[n.node_id]))
        return out


def access_kind(tree: Tree, n: Node) -> str:
    """How an identifier is used; the nearest ancestor with a say decides."""
    parent = tree.at[n.parent_id] if n.parent_id is not None else None
    if parent is not None and parent.type in MEMBER_TYPES and n.field in MEMBER_FIELDS:
        return "property"
    for a in tree.ancestors(n):
        if a.type in ("update_expression", "unary_update_expression"):
            return "read_write"
        if a.type in ("augmented_assignment", "augmented_assignment_expression", "assignment", "assignment_expression"):
            target = tree.fields(a, "left", "target")[:1]
            hit = bool(target) and (target[0].node_id == n.node_id or (target[0].type in TARGET_WRAPPERS and tree.within(n, target[0])))
            plain = a.type.startswith("assignment")
            return ("write" if plain else "read_write") if hit else "read"
        if a.type in ("variable_declarator", "init_declarator"):
            if any(tree.within(n, f) for f in tree.fields(a, "name", "declarator")):
                return "write"
            if any(tree.within(n, f) for f in tree.fields(a, "value", "initializer")):
                return "read"
        elif "parameter" in a.type and any(tree.within(n, f) for f in tree.fields(a, "name", "declarator")):
            return "write"
    return "read"


class _Inline(NamedTuple):
    """Nodes of these types, or with one of these parts in their type, declare what stands in the first child of each
    of the fields: ``only_first`` of those alone, all children ``without`` any."""

    kind: str
    fields: tuple[str, ...]
    types: frozenset[str] = frozenset()
    parts: tuple[str, ...] = ()
    language: str | None = None
    only_first: bool = False
    without: bool = False


# What declares a name where it stands; the first that fits counts.
INLINE_DECLARATIONS = (
    _Inline("parameter", ("name", "declarator", "pattern"), parts=("parameter",), without=True),
    _Inline("variable", ("name", "declarator"), frozenset({"variable_declarator", "init_declarator"})),
    _Inline("with_alias", ("alias",), frozenset({"with_item"})),
    _Inline("exception_variable", (), frozenset({"catch_clause", "except_clause"}), without=True),
    _Inline("loop_variable", ("left", "name", "pattern"), parts=("for_statement", "foreach_statement", "enhanced_for_statement"), only_first=True),
    _Inline("implicit_variable", ("left", "target"), frozenset({"assignment"}), language="Python", only_first=True),
    _Inline("implicit_variable", ("left",), frozenset({"assignment_expression"}), language="PHP", only_first=True),
)


def _inline_declaration(tree: Tree, language: str, n: Node) -> tuple[str, list[Node]] | None:
    """Kind and subtrees of the identifiers that a node declares where it stands."""
    for d in INLINE_DECLARATIONS:
        if d.language in (None, language) and (n.type in d.types or any(p in n.type for p in d.parts)):
            found = tree.fields(n, *d.fields)
            return d.kind, (found[:1] if d.only_first else found) or (tree.children[n.node_id] if d.without else [])
    return None


def analyse(nodes: Sequence[Node], code: str, language: str) -> dict:
    """leaves, scopes, declarations and usages of a snippet, as lists of plain dicts."""
    tree = Tree(nodes, code)
    named = {t: kind for kind, types in NAMED_DECLARATIONS.get(language, {}).items() for t in types}
    scopes: list[dict] = []
    declarations: list[dict] = []
    known: set[tuple] = set()
    by_scope: dict[int, list[dict]] = {}

    def new_scope(kind: str, start: int, end: int, parent: dict | None) -> dict:
        i = len(scopes)
        s = {"scope_id": i, "parent_scope_id": parent and parent["scope_id"], "type": kind, "start": start, "end": end, "depth": parent["depth"] + 1 if parent else 0, "ancestors": [i, *(parent["ancestors"] if parent else [])]}
        scopes.append(s)
        return s

    def declare(scope: dict, n: Node, kind: str) -> None:
        name = tree.text(n)
        key = (scope["scope_id"], kind, n.start, n.end, name)
        if name and key not in known:
            known.add(key)
            d = {"name": name, "kind": "variable" if kind == "implicit_variable" else kind, "start": n.start, "end": n.end, "scope_id": scope["scope_id"], "depth": scope["depth"]}
            declarations.append(d)
            by_scope.setdefault(scope["scope_id"], []).append(d)

    def visible(scope: dict, name: str, position: int) -> bool:
        return any(d["name"] == name and d["end"] <= position for s in scope["ancestors"] for d in by_scope.get(s, ()))

    if tree.nodes:
        root = tree.nodes[0]
        todo = [(c, new_scope(root.type, 0, len(code), None)) for c in reversed(tree.children[root.node_id])]
        while todo:
            n, scope = todo.pop()
            if n.type in named:
                # Declared in the scope around the node, not in the one that it opens.
                for field in tree.fields(n, "name", "declarator")[:1]:
                    for x in tree.identifiers(field)[:1]:
                        declare(scope, x, named[n.type])
            if opens_scope(n.type):
                scope = new_scope(n.type, n.start, n.end, scope)
            inline = _inline_declaration(tree, language, n)
            if inline:
                kind, parts = inline
                for part in parts:
                    for x in tree.identifiers(part):
                        if kind not in ("implicit_variable", "loop_variable") or not visible(scope, tree.text(x), x.start):
                            declare(scope, x, kind)
            todo.extend((c, scope) for c in reversed(tree.children[n.node_id]))
        usages = [{"name": tree.text(x), "access": access_kind(tree, x), "start": x.start, "end": x.end} for x in tree.identifiers(root)]
    else:
        usages = []
    leaves = [{"start": n.start, "end": n.end, "label": n.type, "path": path, "name": tree.text(n) if is_identifier(n.type) else ""} for n, path in tree.leaves()]
    return {"leaves": leaves, "scopes": scopes, "declarations": declarations, "usages": usages}


Parser = Callable[[str], tuple[list[Node], bool]]


class ParserRegistry:
    """Parsers by language, made on first use; a failure to make one is kept too. Without a maker of its own a language
    has ``otherwise``, else the default parser."""

    def __init__(self, makers: dict[str, Callable[[], Parser]] | None = None, otherwise: Callable[[], Parser] | None = None):
        self._makers, self._otherwise = makers, otherwise
        self._made: dict[str, Parser | Exception] = {}

    def get(self, language: str) -> Parser:
        if language not in self._made:
            try:
                maker = (self._makers or {}).get(language, self._otherwise)
                self._made[language] = maker() if maker else default_parser(language)
            except Exception as e:
                self._made[language] = e
        found = self._made[language]
        if isinstance(found, Exception):
            raise found
        return found


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def parse_lines(code: str) -> tuple[list[Node], bool]:
    """A tree for any language: lines are blocks, words in them identifiers, and the first word of a line is declared
    there. For text that no grammar is at hand for, and to hold the rules above against a plain account of them."""
    nodes = [Node(0, None, None, "module", True, 0, len(code))]
    at = 0
    for line in code.split("\n"):
        words = list(_WORD.finditer(line))
        if words:
            block = len(nodes)
            nodes.append(Node(block, 0, None, "line_block", True, at, at + len(line)))
            for k, m in enumerate(words):
                span, parent = (at + m.start(), at + m.end()), block
                if k == 0:
                    parent = len(nodes)
                    nodes.append(Node(parent, block, None, "variable_declarator", True, *span))
                nodes.append(Node(len(nodes), parent, None if k else "name", "identifier", True, *span))
        at += len(line) + 1
    return nodes, False


# Grammar modules and the attributes under which they hold their language.
GRAMMAR_MODULES = {
    "C": "tree_sitter_c", "C#": "tree_sitter_c_sharp", "C++": "tree_sitter_cpp", "Java": "tree_sitter_java", "Javascript": "tree_sitter_javascript", "PHP": "tree_sitter_php", "Python": "tree_sitter_python",
}
GRAMMAR_ATTRIBUTES = ("language", "language_php", "language_php_only", "LANGUAGE")


def default_parser(language: str) -> Parser:
    """The grammar's parser where it is installed; for Python else the standard library's."""
    try:
        binding = importlib.import_module("tree_sitter")
        module = importlib.import_module(GRAMMAR_MODULES[language])
    except (ImportError, KeyError):
        if language == "Python":
            return parse_python
        raise ValueError(f"no parser for {language}") from None
    grammar = next(getattr(module, a) for a in GRAMMAR_ATTRIBUTES if hasattr(module, a))
    handle = binding.Language(grammar() if callable(grammar) else grammar)
    try:
        parser = binding.Parser(handle)
    except TypeError:
        parser = binding.Parser()
        parser.language = handle
    return lambda code: _nodes_of(parser.parse(code.encode("utf-8")), code)


def _char_of_byte(code: str) -> Callable[[int], int]:
    if code.isascii():
        return lambda b: min(b, len(code))
    place = []
    for i, c in enumerate(code):
        place += [i] * len(c.encode("utf-8", "surrogatepass"))
    return lambda b: place[b] if b < len(place) else len(code)


def _nodes_of(tree, code: str) -> tuple[list[Node], bool]:
    char = _char_of_byte(code)
    nodes: list[Node] = []
    todo = [(tree.root_node, None, None)]
    while todo:
        n, parent, field = todo.pop()
        i = len(nodes)
        nodes.append(Node(i, parent, field, n.type, n.is_named, char(n.start_byte), char(n.end_byte)))
        todo.extend((c, i, n.field_name_for_child(k)) for k, c in reversed(list(enumerate(n.children))))
    return nodes, bool(tree.root_node.has_error)


# Names of the standard library's node classes in the node table.
_AST_TYPES = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Name": "identifier", "Attribute": "attribute", "Call": "call",
    "Assign": "assignment", "AnnAssign": "assignment", "AugAssign": "augmented_assignment", "For": "for_statement", "AsyncFor": "for_statement", "While": "while_statement", "If": "if_statement",
    "With": "with_statement", "withitem": "with_item", "ExceptHandler": "except_clause", "Lambda": "lambda", "Return": "return_statement", "BinOp": "binary_operator", "BoolOp": "boolean_operator",
    "Compare": "comparison_operator", "UnaryOp": "unary_operator", "Expr": "expression_statement", "Subscript": "subscript", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Tuple": "tuple", "List": "list", "Dict": "dictionary", "Set": "set", "Try": "try_statement", "Pass": "pass_statement",
}
_AST_FIELDS = {"targets": "left", "target": "left", "value": "value", "optional_vars": "alias", "func": "function", "args": "arguments", "iter": "right", "body": "body", "test": "condition"}


def parse_python(code: str) -> tuple[list[Node], bool]:
    """Python by the standard library. Text that it rejects gives a bare module that is marked as faulty."""
    try:
        module = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [Node(0, None, None, "module", True, 0, len(code))], True
    line_starts, at = [], 0
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", code)
    for line in lines:
        line_starts.append(at)
        at += len(line)

    def place(line: int, column: int) -> int:
        text = lines[line - 1]
        return line_starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode("utf-8", "ignore")))

    nodes: list[Node] = []
    todo: list[tuple] = [(module, None, None, 0, len(code))]

    def name_after(start: int, end: int, name: str, last: bool = False) -> tuple[int, int]:
        found = list(re.finditer(rf"\b{re.escape(name)}\b", code[start:end]))
        hit = found[-1 if last else 0] if found else None
        return (start + hit.start(), start + hit.end()) if hit else (start, start)

    while todo:
        x, parent, field, start, end = todo.pop()
        if isinstance(x, tuple):  # a ready node: (type, children)
            kind, children = x
        else:
            kind, children = _AST_TYPES.get(type(x).__name__, re.sub(r"(?<!^)(?=[A-Z])", "_", type(x).__name__).lower()), None
            if isinstance(x, (ast.Tuple, ast.List)) and isinstance(x.ctx, ast.Store):
                kind = "tuple_pattern" if isinstance(x, ast.Tuple) else "list_pattern"
        i = len(nodes)
        nodes.append(Node(i, parent, field, kind, True, start, end))
        if children is None:
            children = _ast_children(x, start, end, place, name_after)
        todo.extend((c, i, f, s, e) for c, f, s, e in reversed(sorted(children, key=lambda c: (c[2], -c[3]))))
    return nodes, False


def _ast_children(x: ast.AST, start: int, end: int, place, name_after) -> list[tuple]:
    def span(n: ast.AST) -> tuple[int, int]:
        return place(n.lineno, n.col_offset), place(n.end_lineno, n.end_col_offset)

    out: list[tuple] = []
    if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        head = span(x.body[0])[0]
        out.append((("identifier", []), "name", *name_after(start, head, x.name)))
    if isinstance(x, ast.Attribute):
        out.append((("identifier", []), "attribute", *name_after(span(x.value)[1], end, x.attr, last=True)))
    if isinstance(x, ast.ExceptHandler) and x.name:
        out.append((("identifier", []), "name", *name_after(start, span(x.body[0])[0], x.name, last=True)))
    for field, value in ast.iter_fields(x):
        group = [v for v in (value if isinstance(value, list) else [value]) if isinstance(v, ast.AST)]
        if isinstance(x, ast.arguments) or not group or field in ("ctx", "op", "ops"):
            continue
        named = _AST_FIELDS.get(field, field)
        if isinstance(x, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and field == "value":
            named = "right"
        if field == "body" and isinstance(value, list) and not isinstance(x, ast.Module):
            s, e = span(group[0])[0], span(group[-1])[1]
            out.append((("block", [(v, None, *span(v)) for v in group]), "body", s, e))
        elif field == "args" and isinstance(value, ast.arguments):
            every = [*value.posonlyargs, *value.args, *([value.vararg] if value.vararg else []), *value.kwonlyargs, *([value.kwarg] if value.kwarg else [])]
            if every:
                inner = []
                for a in every:
                    s, e = span(a)
                    mark = [(("identifier", []), "name", s, s + len(a.arg))]
                    if a.annotation is not None:
                        mark.append((a.annotation, "type", *span(a.annotation)))
                    inner.append((("parameter", mark), None, s, e))
                inner += [(v, "value", *span(v)) for v in [*value.defaults, *[k for k in value.kw_defaults if k is not None]]]
                out.append((("argument_list_declared", inner), "parameters", min(c[2] for c in inner), max(c[3] for c in inner)))
        else:
            for v in group:
                if hasattr(v, "lineno"):
                    out.append((v, named, *span(v)))
                elif isinstance(v, ast.withitem):
                    last = v.optional_vars or v.context_expr
                    out.append((v, named, span(v.context_expr)[0], span(last)[1]))
                elif isinstance(v, ast.comprehension):
                    tail = v.ifs[-1] if v.ifs else v.iter
                    out.append((v, named, span(v.target)[0], span(tail)[1]))
    return out
