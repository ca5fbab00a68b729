"""Expressions on dense vectors and on lists of (feature id, activation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.binding import bind
from tokenloom.functions.ids import threshold_column


def number_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def top_pairs(vector: Column, k: int, only_positive: bool = True) -> Column:
    """array<struct<feature_id, activation>>: the k greatest entries, ties by position, ids from 0.

    With ``only_positive`` entries at or below zero are left out. Null, NaN: left out. k beyond the width gives all.
    """
    pairs = F.transform(vector, lambda x, i: F.struct((-x.cast("double")).alias("n"), i.cast("long").alias("i")))
    kept = F.filter(pairs, lambda p: p["n"].isNotNull() & ~F.isnan(p["n"]) & ((p["n"] < 0) if only_positive else F.lit(True)))
    best = F.slice(F.array_sort(kept), 1, k)
    return F.transform(best, lambda p: F.struct(p["i"].alias("feature_id"), (-p["n"]).alias("activation")))


def wide_columns(pairs: Column, k: int) -> list[Column]:
    """``top_1_feature_id``, ``top_1_feature_activation``, ... up to k, null beyond the end of the list."""
    out = []
    for r in range(1, k + 1):
        out.append(F.get(pairs, r - 1)["feature_id"].alias(f"top_{r}_feature_id"))
        out.append(F.get(pairs, r - 1)["activation"].alias(f"top_{r}_feature_activation"))
    return out


def _at_least(threshold: float):
    return lambda x: x >= F.lit(float(threshold))


def vector_statistics(vector: Column, pairs: Column, thresholds: Sequence[float] = (0.0, 0.1, 1.0)) -> list[Column]:
    """Statistics of a dense vector: l0 and l1 of its positive part, l2, maximum, mean and population deviation of the
    whole, sum and share of the top entries, the top entry, and counts of entries at or above each threshold."""
    values = F.transform(vector, lambda x: x.cast("double"))
    fold = lambda f: F.aggregate(values, F.lit(0.0), f)
    n = F.size(values)
    total = fold(lambda a, x: a + x)
    mean = F.try_divide(total, n)
    l1 = fold(lambda a, x: a + F.greatest(x, F.lit(0.0)))
    top_sum = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["activation"])
    variance = bind(mean, lambda m: F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)), n))
    out = [
        n.cast("long").alias("sae_width"),
        F.size(F.filter(values, lambda x: x > 0)).cast("long").alias("sae_l0_positive"),
        l1.alias("sae_l1_positive"),
        F.sqrt(fold(lambda a, x: a + x * x)).alias("sae_l2"),
        F.array_max(values).alias("sae_max_activation"),
        mean.alias("sae_mean_activation"),
        F.sqrt(variance).alias("sae_std_activation"),
        top_sum.alias("top_k_activation_sum"),
        F.when(l1 > 0, top_sum / l1).otherwise(F.lit(0.0)).alias("top_k_fraction_of_l1"),
        F.get(pairs, 0)["feature_id"].alias("top_feature_id"),
        F.get(pairs, 0)["activation"].alias("top_feature_activation"),
    ]
    for t in thresholds:
        out.append(F.size(F.filter(values, _at_least(t))).cast("long").alias(threshold_column(t)))
    return out


def feature_ids(df: DataFrame, column: str = "top_k_feature_ids") -> Column:
    """The list of feature ids of a row as array<bigint>: an array as it is, a list written as a string parsed, nulls
    dropped, null an empty list."""
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column)
    if kind == "string":
        value = F.from_json(value, "array<bigint>")
    elif not kind.startswith("array"):
        value = F.array(value.cast("bigint"))
    return F.coalesce(F.filter(value.cast("array<bigint>"), lambda x: x.isNotNull()), F.array().cast("array<bigint>"))


def feature_activations(df: DataFrame, column: str = "top_k_feature_activations") -> Column:
    """The list of activations as array<double>; NaN and nulls are dropped, null is an empty list."""
    kind = df.schema[column].dataType.simpleString()
    value = F.col(column)
    if kind == "string":
        value = F.from_json(value, "array<double>")
    elif not kind.startswith("array"):
        value = F.array(value.cast("double"))
    clean = F.filter(value.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x))
    return F.coalesce(clean, F.array().cast("array<double>"))


def selected_features(df: DataFrame, k: int) -> Column:
    """The first k feature ids of a row: from the list column, else from ``top_1_feature_id`` on until the first column
    that is missing, nulls skipped."""
    if "top_k_feature_ids" in df.columns:
        return F.slice(feature_ids(df), 1, k)
    wide = []
    for r in range(1, k + 1):
        if f"top_{r}_feature_id" not in df.columns:
            break
        wide.append(F.col(f"top_{r}_feature_id").cast("bigint"))
    if not wide:
        raise ValueError("there is neither top_k_feature_ids nor top_1_feature_id")
    return F.filter(F.array(*wide), lambda x: x.isNotNull())


def selected_pairs(df: DataFrame, k: int | None) -> Column:
    """array<struct<feature_id, activation>> of the first k features (all with None). The shorter of the two lists
    counts; without activations they are NaN."""
    ids = feature_ids(df) if k is None else selected_features(df, k)
    if "top_k_feature_activations" not in df.columns:
        return F.transform(ids, lambda i: F.struct(i.alias("feature_id"), F.lit(float("nan")).alias("activation")))
    acts = feature_activations(df)
    n = F.least(F.size(ids), F.size(acts))
    return F.transform(
        F.arrays_zip(F.slice(ids, 1, n).alias("i"), F.slice(acts, 1, n).alias("a")),
        lambda p: F.struct(p["i"].alias("feature_id"), p["a"].alias("activation")),
    )


def activation_of(pairs: Column, feature_id: int, threshold: float | None = None) -> Column:
    """Activation of the first entry of ``feature_id`` at or above the threshold, else null."""
    hit = F.filter(
        pairs,
        lambda p: (p["feature_id"] == feature_id)
        & (F.lit(True) if threshold is None else (p["activation"] >= threshold) & ~F.isnan(p["activation"])),
    )
    return F.get(hit, 0)["activation"]


def snippet_column(df: DataFrame, named: str | None = None) -> str:
    """The column that names the snippet: the given one, else the first of global_idx, code_id, idx."""
    for c in [named] if named else ["global_idx", "code_id", "idx"]:
        if c in df.columns:
            return c
    raise ValueError(f"no snippet id column ({named or 'global_idx, code_id, idx'})")


def token_column(df: DataFrame, named: str = "token_str") -> str:
    """``token_str``, or ``tokenizer_token`` where the table has no other."""
    for c in (named, "tokenizer_token"):
        if c in df.columns:
            return c
    raise ValueError(f"no token column ({named})")
