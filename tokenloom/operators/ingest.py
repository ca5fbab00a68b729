"""From raw records to snippets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.ids import group_key, normalize_global_idx, variant_number


def combine_fragments(items: DataFrame, separator: str = "", code: str = "code") -> DataFrame:
    """Fragments (idx, language, file_path, code) of one base id become a snippet, in order of variant and path.

    snippet_id, global_idx, language, code, file_path (of the first fragment), source_snippet_ids,
    source_file_paths, num_fragments. A null code counts as empty.
    """
    parts = F.array_sort(
        F.collect_list(F.struct(variant_number(F.col("idx")).alias("v"), "file_path", "idx", F.coalesce(F.col(code), F.lit("")).alias("code")))
    )
    grouped = items.groupBy("language", group_key(F.col("idx")).alias("snippet_id")).agg(parts.alias("parts"))
    return grouped.select(
        "snippet_id",
        F.col("snippet_id").alias("global_idx"),
        "language",
        F.array_join(F.transform("parts", lambda p: p["code"]), separator).alias("code"),
        F.get("parts", 0)["file_path"].alias("file_path"),
        F.transform("parts", lambda p: p["idx"]).alias("source_snippet_ids"),
        F.transform("parts", lambda p: p["file_path"]).alias("source_file_paths"),
        F.size("parts").cast("long").alias("num_fragments"),
    )


def single_snippets(items: DataFrame, code: str = "code") -> DataFrame:
    """Each item is a snippet of its own."""
    return items.select(
        F.col("idx").alias("snippet_id"),
        normalize_global_idx(F.col("idx")).alias("global_idx"),
        "language",
        F.col(code).alias("code"),
        "file_path",
        F.array("idx").alias("source_snippet_ids"),
        F.array("file_path").alias("source_file_paths"),
        F.lit(1).cast("long").alias("num_fragments"),
    )


def common_ids(df: DataFrame, id_col: str, source: Sequence[str]) -> DataFrame:
    """Ids that occur in every source that has any (relational division)."""
    pairs = df.where(F.col(id_col).isNotNull()).select(id_col, F.struct(*source).alias("s")).distinct()
    n = pairs.select("s").distinct().agg(F.count(F.lit(1)).alias("n_sources"))
    per = pairs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(n)).where(F.col("n") == F.col("n_sources")).select(id_col)  # one row


def keep_common(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    return df.join(ids, id_col, "left_semi")


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``, which must be total within a key for a fixed result."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") == 1).drop("_rank")


def in_length_band(df: DataFrame, text: str, least: int = 12, most: int = 240) -> DataFrame:
    """Rows whose text, without white space at its ends, has ``least`` to ``most`` characters."""
    n = F.length(F.regexp_replace(text, r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", ""))
    return df.where(n.between(least, most))
