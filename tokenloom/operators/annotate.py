"""One row per token of a snippet, with labels, scope, visible names, declaration and last write.

Tokenizing, lexing and parsing need Python, and a snippet stands alone; so all that is known of its tokens is settled in
the same pass over the snippet, and rows leave it complete: nothing is shuffled, and no row carries anything of the
snippet that the table does not ask for. Lookups are by bisection; visible names change at few places of a snippet and
are put together once for each.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions import labels
from tokenloom.functions.syntax import ParserRegistry, analyse
from tokenloom.functions.tokenizers import PatternTokenizer, Tokenizer
from tokenloom.operators.lexing import Touching, lexer_runs

_RUN = "struct<start:bigint,end:bigint,label:string,simple:string>"
_LEAF = "struct<start:bigint,end:bigint,label:string,path:string,name:string>"
_DECLARATION = "struct<name:string,kind:string,start:bigint,end:bigint,scope_id:bigint,depth:bigint>"
_USAGE = "struct<name:string,access:string,start:bigint,end:bigint>"
_SCOPE = "struct<scope_id:bigint,depth:bigint,type:string,ancestors:array<bigint>>"
_TOKEN = (
    f"struct<token_id:bigint,raw:string,decoded:string,start:bigint,end:bigint,runs:array<{_RUN}>,leaves:array<{_LEAF}>,scope:{_SCOPE},"
    f"declared:array<{_DECLARATION}>,used:array<{_USAGE}>,place:bigint>"
)
_PARSED = f"tokens array<{_TOKEN}>, declarations array<{_DECLARATION}>, status string, error string"

#: Keys and columns of the snippet that its token rows carry.
IDENTITY = ("snippet_id", "global_idx", "language", "file_path", "source_snippet_ids", "source_file_paths", "num_fragments")


def _scopes_at(scopes: list[dict], places: list[int]) -> Iterator[dict]:
    """The innermost scope at each of the ascending places; ends count as inside."""
    waiting = sorted(scopes, key=lambda s: s["start"])
    active: list[dict] = []
    best = None
    k = 0
    for p in places:
        changed = best is None or best["end"] < p
        while k < len(waiting) and waiting[k]["start"] <= p:
            active.append(waiting[k])
            k += 1
            changed = True
        if changed:
            active = [s for s in active if s["end"] >= p]
            best = min(active or scopes[:1], key=lambda s: (-s["depth"], s["end"] - s["start"], s["scope_id"]))
        yield best


def parse_snippet(code: str, language: str, tokenizer: Tokenizer, registry: ParserRegistry) -> dict:
    """Everything that is known of a snippet before its tokens become rows. A failing tokenizer, lexer or parser leaves
    its part empty and is told in status and error."""
    empty = {"leaves": [], "scopes": [], "declarations": [], "usages": []}
    status, error = ("empty", "") if not code else ("ok", "")
    found, runs, tokens = empty, [], []
    try:
        tokens = tokenizer.encode(code)
    except Exception as e:
        status, error = "error", str(e) or type(e).__name__
    if code and status != "error":
        try:
            nodes, faulty = registry.get(language)(code)
            found, status = analyse(nodes, code, language), "parsed_with_errors" if faulty else "ok"
        except Exception as e:
            status, error = "error", str(e)
        try:
            runs = lexer_runs(code, language)
        except Exception as e:
            status, error = "error", str(e)
    scopes = found["scopes"] or [{"scope_id": 0, "depth": 0, "type": "root", "start": 0, "end": len(code), "ancestors": [0]}]
    places = [t.start if t.start < len(code) else max(len(code) - 1, 0) for t in tokens]
    order = sorted(range(len(tokens)), key=places.__getitem__)
    slim = {s["scope_id"]: {k: s[k] for k in ("scope_id", "depth", "type", "ancestors")} for s in scopes}
    scope_of = {i: slim[s["scope_id"]] for i, s in zip(order, _scopes_at(scopes, [places[i] for i in order]))}
    near = {name: Touching(records) for name, records in (("runs", runs), ("leaves", found["leaves"]), ("declared", found["declarations"]), ("used", found["usages"]))}
    rows = [
        {"token_id": t.token_id, "raw": t.raw, "decoded": t.decoded, "start": t.start, "end": t.end, "scope": scope_of[i], "place": places[i]}
        | {name: touching(t.start, t.end) for name, touching in near.items()}
        for i, t in enumerate(tokens)
    ]
    return {"tokens": rows, "declarations": found["declarations"], "status": status, "error": error}


def parse_snippets(snippets: DataFrame, tokenizer: Tokenizer | None = None, registry: ParserRegistry | None = None) -> DataFrame:
    """Adds tokens, declarations, status and error to each snippet. Null code is empty; row-local."""
    tokenizer, registry = tokenizer or PatternTokenizer(), registry or ParserRegistry()
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = T._parse_datatype_string(f"struct<{_PARSED.replace(' array<', ':array<').replace(' string', ':string')}>")
    out_schema = T.StructType([*snippets.schema.fields, *parsed.fields])
    shape = to_arrow_schema(out_schema)
    added = shape.names[len(snippets.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts, languages = part.column(at["code"]).to_pylist(), part.column(at["language"]).to_pylist()
                rows = [parse_snippet(c or "", lang or "", tokenizer, registry) for c, lang in zip(texts, languages)]
                columns = [pa.array([r[n] for r in rows], shape.field(n).type) for n in added]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(shape.field(i).type) for i in range(part.num_columns)), *columns], schema=shape)

    return snippets.mapInArrow(run, out_schema)


def _json_list(values: Column) -> Column:
    """A JSON list of texts with a blank behind each comma, non-ASCII kept."""
    parts = F.transform(values, lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def _under(records: list[dict], field: str, start: int, end: int) -> list[tuple[str, int]]:
    """(label, characters) of the records that touch a token."""
    return [(r[field], min(r["end"], end) - max(r["start"], start)) for r in records]


def _winner(votes: Iterable[tuple[str, int]], default: str | None = None) -> str | None:
    """The label of most characters; among equals the one seen first. Empty ones don't vote."""
    counts: dict[str, int] = {}
    for label, n in votes:
        if label:
            counts[label] = counts.get(label, 0) + n
    return max(counts, key=counts.__getitem__) if counts else default


def _voted(records: list[dict], field: str, start: int, end: int) -> str:
    """The winner among records, empty without any; mostly there is but one."""
    if len(records) == 1:
        return records[0][field]
    return _winner(_under(records, field, start, end), "")


def _code_label(runs: list[dict], field: str, start: int, end: int, gives_way: Callable[[str], bool], special: str) -> str:
    if not runs:
        return special
    if len(runs) == 1:
        return runs[0][field]
    votes = _under(runs, field, start, end)
    return _winner([v for v in votes if not gives_way(v[0])]) or _winner(votes, "other")


class _Visible:
    """What can be seen from a scope once some declarations have ended."""

    def __init__(self, declarations: list[dict]):
        self.by_scope: dict[int, list[tuple[int, int, dict]]] = {}
        for i, d in enumerate(declarations):
            self.by_scope.setdefault(d["scope_id"], []).append((d["end"], i, d))
        self.ends = {s: sorted(e for e, *_ in ds) for s, ds in self.by_scope.items()}
        self.known: dict[tuple, tuple[dict[str, dict], list[dict]]] = {}

    def __call__(self, ancestors: list[int], place: int) -> tuple[tuple, dict[str, dict], list[dict]]:
        """A key that stays while nothing changes; declarations by name; and in order of depth, start and name."""
        key = (ancestors[0], *(bisect_right(self.ends[s], place) for s in ancestors if s in self.ends))
        found = self.known.get(key)
        if found is None:
            best: dict[str, tuple] = {}
            for s in ancestors:
                for end, i, d in self.by_scope.get(s, ()):
                    rank = (-d["depth"], -d["start"], i)
                    if end <= place and (d["name"] not in best or rank < best[d["name"]][0]):
                        best[d["name"]] = rank, d
            names = {n: d for n, (_, d) in best.items()}
            found = self.known[key] = names, sorted(names.values(), key=lambda d: (-d["depth"], d["start"], d["name"]))
        return key, *found


def _first_behind(tokens: list[dict]) -> Callable[[int], int | None]:
    """Position of the first token that holds a character, else of the first non-empty one that ends behind it."""
    spans = [(t["start"], t["end"], i) for i, t in enumerate(tokens) if t["start"] < t["end"]]
    ends = [e for _, e, _ in spans]
    if all(a <= b for a, b in zip(ends, ends[1:])):  # then the first that ends behind it is also the first to hold it

        def find(place: int) -> int | None:
            k = bisect_right(ends, place)
            return spans[k][2] if k < len(spans) else None

    else:

        def find(place: int) -> int | None:
            behind = [(not s <= place, i) for s, e, i in spans if e > place]
            return min(behind)[1] if behind else None

    return find


#: White space of names: what the JVM's ``\\s`` and ``\\p{Z}`` match.
_BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _identity(d: dict) -> tuple:
    return d["scope_id"], d["name"], d["start"], d["end"], d["kind"]


def _token_rows(code: str, parsed: dict, shown: Callable[[Sequence], object]) -> Iterator[tuple]:
    """The values of TOKEN_FIELDS of each token, without the distances; ``shown`` renders a list."""
    tokens, status, error = parsed["tokens"], parsed["status"], parsed["error"]
    visible, find = _Visible(parsed["declarations"]), _first_behind(tokens)
    rendered: dict[tuple, tuple] = {}
    places: dict[int, int | None] = {}
    writes: dict[tuple, int] = {}
    for pos, t in enumerate(tokens):
        start, end, scope = t["start"], t["end"], t["scope"]
        text = code[start:end]
        runs, leaves = t["runs"], t["leaves"]
        simple = _code_label(runs, "simple", start, end, ("whitespace", "text").__contains__, "special")
        if start == end:
            full, path, leaf, identifier = "Token.Special", "special", "special", ""
        else:
            full = _code_label(runs, "label", start, end, lambda x: x.startswith("Token.Text"), "Token.Special")
            path, leaf, identifier = _voted(leaves, "path", start, end), _voted(leaves, "label", start, end), _voted(leaves, "name", start, end)
        state, by_name, in_order = visible(scope["ancestors"], t["place"])
        lists = rendered.get(state)
        if lists is None:
            lists = rendered[state] = len(in_order), *(shown([d[f] for d in in_order]) for f in ("name", "kind", "start"))
        name_like = identifier != "" or simple in labels.NAME_LIKE
        name = identifier or text.strip(_BLANKS)
        declared = used = seen = None
        if name_like and name:
            seen = by_name.get(name)
            if start != end:
                declared = next((d for d in t["declared"] if d["name"] == name), None)
                used = next((u for u in t["used"] if u["name"] == name), None)
        meant = declared or seen
        declared_at = last_write = access = None
        if meant:
            if meant["start"] not in places:
                places[meant["start"]] = find(meant["start"])
            declared_at = places[meant["start"]]
        if used:
            access = used["access"]
        writing = access in ("write", "read_write")
        if name:
            key = _identity(meant) if meant else (name,)
            last_write = writes.get(key)
            if writing and end >= used["end"]:  # a write counts from the token that completes the name on
                writes[key] = pos
        yield (
            t["token_id"], pos, text, t["raw"], t["decoded"], start, end, full, simple, path, leaf, status, error, scope["depth"], scope["type"], *lists, name_like, identifier or None,
            seen is not None, declared is not None, seen and seen["kind"], access, access in ("read", "read_write"), writing, access == "read_write", used and used["start"], used and used["end"], declared_at, last_write,
        )


def annotate_tokens(
    snippets: DataFrame, tokenizer: Tokenizer | None = None, registry: ParserRegistry | None = None, include_code: bool = False, json_lists: bool = True, fail_on_error: bool = False
) -> DataFrame:
    """The token annotation table, 42 columns with ``code`` (null unless asked for).

    (language, snippet_id) is unique in ``snippets``. Lists are JSON strings, or arrays with ``json_lists`` off. Null code
    is empty; a snippet without tokens has no rows. A snippet that could not be parsed has status ``error`` on its rows;
    with ``fail_on_error`` it fails the query. Row-local: no shuffle.
    """
    tokenizer, registry = tokenizer or PatternTokenizer(), registry or ParserRegistry()
    from pyspark.sql.pandas.types import to_arrow_schema

    own = snippets.select(*IDENTITY, F.col("code").alias("_code"))
    if json_lists:
        for c in ("source_snippet_ids", "source_file_paths"):
            own = own.withColumn(c, _json_list(F.col(c)))
    fields = [T.StructField(n, T.ArrayType(k) if n in _LISTS and not json_lists else T.StringType() if n in _LISTS else k) for n, k in TOKEN_FIELDS]
    schema = T.StructType([*own.schema.fields[: len(IDENTITY)], *fields, T.StructField("code", T.StringType())])
    shape = to_arrow_schema(schema)
    shown = (lambda x: json.dumps(x, ensure_ascii=False)) if json_lists else list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = batch.column(len(IDENTITY)), batch.column(IDENTITY.index("language")).to_pylist()
            rows: list[tuple] = []
            owner: list[int] = []

            def out() -> pa.RecordBatch:
                of = pa.array(owner, pa.int64())
                columns = [batch.column(i).take(of).cast(shape.field(i).type) for i in range(len(IDENTITY))]
                columns += [pa.array(c, shape.field(len(IDENTITY) + k).type) for k, c in enumerate(zip(*rows))]
                columns.append(texts.take(of) if include_code else pa.nulls(len(rows), pa.string()))
                made = pa.RecordBatch.from_arrays(columns, schema=shape)
                rows.clear()
                owner.clear()
                return made

            for k, (code, language) in enumerate(zip(texts, languages)):
                code = code.as_py() or ""
                parsed = parse_snippet(code, language or "", tokenizer, registry)
                if fail_on_error and parsed["status"] == "error":
                    raise ValueError(f"snippet {batch.column(0)[k].as_py()} in {language}: {parsed['error']}")
                for row in _token_rows(code, parsed, shown):
                    rows.append(row)
                    owner.append(k)
                    if len(rows) >= FLUSH_ROWS:
                        yield out()
            if rows:
                yield out()

    out = own.mapInArrow(run, schema)
    out = out.withColumn("token_name_distance_to_declaration_tokens", F.col("token_pos") - F.col("token_name_declaration_token_pos"))
    out = out.withColumn("token_name_distance_to_last_write_tokens", F.col("token_pos") - F.col("token_name_last_write_token_pos"))
    return out.select(*COLUMNS)


#: Rows that leave the pass together.
FLUSH_ROWS = 5_000

_TEXT, _INT, _FLAG = T.StringType(), T.LongType(), T.BooleanType()
_LISTS = {"in_scope_names": _TEXT, "in_scope_name_kinds": _TEXT, "in_scope_decl_starts": _INT}
#: What the pass gives of a token, in order; of lists the kind of their elements.
TOKEN_FIELDS = [
    ("token_id", _INT), ("token_pos", _INT), ("token_text", _TEXT), ("tokenizer_token", _TEXT), ("token_decoded", _TEXT), ("token_offset_start", _INT), ("token_offset_end", _INT),
    ("pygments_label", _TEXT), ("pygments_simple_label", _TEXT), ("tree_sitter_path", _TEXT), ("tree_sitter_leaf_type", _TEXT), ("tree_sitter_status", _TEXT), ("tree_sitter_error", _TEXT),
    ("scope_depth", _INT), ("scope_node_type", _TEXT), ("num_in_scope_names", _INT), *_LISTS.items(), ("is_name_like_token", _FLAG), ("token_identifier_name", _TEXT),
    ("token_name_is_in_scope", _FLAG), ("token_name_is_decl", _FLAG), ("token_name_scope_kind", _TEXT), ("token_variable_access_kind", _TEXT), ("token_variable_is_read", _FLAG),
    ("token_variable_is_write", _FLAG), ("token_variable_is_read_write", _FLAG), ("token_variable_usage_start", _INT), ("token_variable_usage_end", _INT),
    ("token_name_declaration_token_pos", _INT), ("token_name_last_write_token_pos", _INT),
]

#: The columns of the annotation table, in order.
COLUMNS = [
    *IDENTITY, "token_id", "token_pos", "token_text", "tokenizer_token", "token_decoded", "token_offset_start", "token_offset_end", "pygments_label", "pygments_simple_label",
    "tree_sitter_path", "tree_sitter_leaf_type", "tree_sitter_status", "tree_sitter_error", "scope_depth", "scope_node_type", "num_in_scope_names", "in_scope_names",
    "in_scope_name_kinds", "in_scope_decl_starts", "is_name_like_token", "token_identifier_name", "token_name_is_in_scope", "token_name_is_decl", "token_name_scope_kind",
    "token_variable_access_kind", "token_variable_is_read", "token_variable_is_write", "token_variable_is_read_write", "token_variable_usage_start", "token_variable_usage_end",
    "token_name_declaration_token_pos", "token_name_distance_to_declaration_tokens", "token_name_last_write_token_pos", "token_name_distance_to_last_write_tokens", "code",
]
