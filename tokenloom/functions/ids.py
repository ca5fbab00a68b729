"""Expressions on record ids, and names derived from parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_global_idx(idx: Column) -> Column:
    """Every middle part of a dashed id goes: ``1800-Java-1`` becomes ``1800-1``."""
    return F.regexp_replace(idx, "-[^-]+-", "-")


def normalize_snippet_id(raw: Column) -> Column:
    """First and last dashed part; an id without a dash is doubled (``x`` becomes ``x-x``)."""
    parts = F.split(raw, "-")
    return F.concat(F.get(parts, 0), F.lit("-"), F.element_at(parts, -1))


def variant_number(idx: Column) -> Column:
    """The integer behind the last dash, 0 where there is none."""
    tail = F.when(F.contains(idx, F.lit("-")), F.trim(F.substring_index(idx, "-", -1)))
    return F.coalesce(F.when(F.regexp_like(tail, F.lit("^[0-9]+$")), tail.try_cast("long")), F.lit(0).cast("long"))


def group_key(idx: Column) -> Column:
    """The normalised id without its variant: everything before the last dash."""
    return F.regexp_replace(normalize_global_idx(idx), "-[^-]*$", "")


def threshold_column(threshold: float) -> str:
    """Name of the column that counts activations at or above a threshold: 0.1 gives ``sae_active_ge_0_1``."""
    return "sae_active_ge_" + str(float(threshold)).replace("-", "neg_").replace(".", "_")


def spread_or_none(key: Column, seed: int = 0) -> Column:
    """A short fixed name for a record without an id: 15 hex digits of the digest of seed and content."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 15)
