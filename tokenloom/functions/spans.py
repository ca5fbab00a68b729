"""Expressions that look tokens up in a snippet's own arrays of spans: runs, scopes, declarations, usages.

The arrays ride in the token's row, so an interval lookup needs neither a join nor a row per character.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.binding import bind


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Spans without their ends share a place."""
    return (a_start < b_end) & (b_start < a_end)


def run_labels(runs: Column, start: Column, end: Column, field: str = "label") -> Column:
    """The labels of the characters [start, end), one per character, from runs (start, end, label) in order."""
    under = F.filter(runs, lambda r: (r["start"] < end) & (r["end"] > start))
    return F.flatten(
        F.transform(under, lambda r: F.array_repeat(r[field], (F.least(r["end"], end) - F.greatest(r["start"], start)).cast("int")))
    )


def innermost_scope(scopes: Column, position: Column) -> Column:
    """The deepest scope around a position, its end included; among equals the shortest, then the first. Without any:
    the first scope."""
    around = F.filter(scopes, lambda s: (s["start"] <= position) & (position <= s["end"]))
    ranked = F.transform(around, lambda s, i: F.struct((-s["depth"]).alias("d"), (s["end"] - s["start"]).alias("w"), i.alias("i"), s.alias("s")))
    return F.coalesce(F.get(F.array_sort(ranked), 0)["s"], F.get(scopes, 0))


def covering(records: Column, name: Column, start: Column, end: Column) -> Column:
    """The first record of this name that overlaps the token."""
    return F.get(F.filter(records, lambda r: (r["name"] == name) & overlaps(start, end, r["start"], r["end"])), 0)


def visible_declarations(declarations: Column, scope: Column, position: Column) -> Column:
    """Declarations seen from a scope at a position: those of the scope and its ancestors that end by then; of one name
    the innermost, there the one that starts last. Ordered by depth descending, start and name."""
    seen = F.filter(declarations, lambda d: (d["end"] <= position) & F.array_contains(scope["ancestors"], d["scope_id"]))
    ranked = F.array_sort(
        F.transform(seen, lambda d, i: F.struct(d["name"].alias("n"), (-d["depth"]).alias("d"), (-d["start"]).alias("s"), i.alias("i"), d.alias("r")))
    )
    first = bind(ranked, lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1)["n"] != x["n"])))
    ordered = F.array_sort(F.transform(first, lambda x: F.struct(x["d"].alias("d"), x["r"]["start"].alias("s"), x["n"].alias("n"), x["r"].alias("r"))))
    return F.transform(ordered, lambda x: x["r"])


def token_at_char(tokens: Column, place: Column) -> Column:
    """Position of the first token (start, end) that holds a character, else of the first non-empty one that ends
    behind it, else null."""
    inside = F.array_position(F.transform(tokens, lambda t: (t["start"] <= place) & (place < t["end"])), True)
    behind = F.array_position(F.transform(tokens, lambda t: (t["end"] > place) & (t["start"] != t["end"])), True)
    return F.coalesce(F.nullif(inside, F.lit(0)), F.nullif(behind, F.lit(0))) - 1
