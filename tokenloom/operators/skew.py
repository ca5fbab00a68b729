"""Per-key results where a few keys hold most rows (two-stage salted aggregation).

Heavy keys are found first by a map-side combined count. Their rows get a salt, so each heavy key is spread over
``salts`` reducers; partial results per (key, salt) are then merged per key. Light keys all keep salt 0 and pass the
second stage unchanged. What is reported as heavy is decided on the merged counts. The salt is a hash of the row's own values, not ``rand()``: a task that is run again after a
lost executor must produce the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A heavy-key list larger than this can't occur: at most 1/share keys hold a share of all rows each.
MAX_SHARE_DENOMINATOR = 10_000


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n_rows) of the non-null keys. Counting combines on the map side, so skew costs nothing here."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_all"))


def heavy_keys(df: DataFrame, key: str, share: float = 0.02) -> DataFrame:
    """(key, n_rows) of the keys that hold at least ``share`` of all rows of ``df``, rows with a null key included.

    At most 1/share rows come out; an empty table has none.
    """
    if not 1 / MAX_SHARE_DENOMINATOR <= share <= 1:
        raise ValueError("share must lie between 1/10000 and 1")
    inverse = round(1 / share)
    return (
        key_counts(df, key)
        .crossJoin(F.broadcast(_total(df)))  # one row
        .where(F.col("n_rows") * inverse >= F.col("n_all"))
        .select("key", "n_rows")
    )


def salted(df: DataFrame, key: str, heavy: DataFrame, salts: int, by: Sequence[str]) -> DataFrame:
    """``df`` with ``_salt``: 0 for light keys, 0..salts-1 by a hash of the columns ``by`` for heavy ones.

    ``heavy`` has at most 1/share rows, hence the broadcast.
    """
    marks = F.broadcast(heavy.select(F.col("key").alias("_heavy_key")))
    joined = df.join(marks, df[key] == F.col("_heavy_key"), "left")
    salt = F.when(F.col("_heavy_key").isNotNull(), F.pmod(F.xxhash64(*by), F.lit(salts))).otherwise(F.lit(0))
    return joined.withColumn("_salt", salt.cast("int")).drop("_heavy_key")


def salted_summary(
    df: DataFrame,
    key: str,
    value: str,
    salt_by: Sequence[str],
    share: float = 0.02,
    salts: int = 32,
) -> DataFrame:
    """Count, value count, mean, least and greatest value per key, heavy keys marked.

    Columns: key, n_rows, n_values, mean_value, min_value, max_value, is_heavy. Null keys are left out; null and NaN
    values count as rows but not as values; a key without values has null statistics. Repeated rows count as often as
    they are stored. An empty table gives no rows.
    """
    slim = df.select(
        F.col(key).alias("_key"),
        F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_value"),
        F.xxhash64(*[F.col(c) for c in salt_by]).alias("_spread"),
    ).where(F.col("_key").isNotNull())
    # The share is of all rows; null keys count in it.
    heavy = heavy_keys(df.select(F.col(key).alias("_key")), "_key", share)
    rows = salted(slim, "_key", heavy, salts, ["_spread"])
    partial = rows.groupBy("_key", "_salt").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("_value").alias("v"),
        F.sum("_value").alias("s"),
        F.min("_value").alias("lo"),
        F.max("_value").alias("hi"),
    )
    merged = partial.groupBy("_key").agg(
        F.sum("n").alias("n_rows"),
        F.sum("v").alias("n_values"),
        F.try_divide(F.sum("s"), F.sum("v")).alias("mean_value"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
    )
    is_heavy = F.col("n_rows") * round(1 / share) >= F.col("n_all")
    return merged.crossJoin(F.broadcast(_total(df))).select(  # one row
        F.col("_key").alias("key"), "n_rows", "n_values", "mean_value", "min_value", "max_value", is_heavy.alias("is_heavy")
    )


def heavy_key_report(df: DataFrame, fields: Sequence[str], share: float, salt_by: Sequence[str], salts: int = 32) -> DataFrame:
    """(field_name, key_value) of every key that holds at least ``share`` of all rows, for several fields.

    Each field goes through ``salted_summary``; key values are rendered as strings: unchanged for strings, in decimal
    for integers. Null keys are never reported.
    """
    parts = [
        salted_summary(df.withColumn("_none", F.lit(None).cast("double")), field, "_none", salt_by, share, salts)
        .where("is_heavy")
        .select(F.lit(field).alias("field_name"), F.col("key").cast("string").alias("key_value"))
        for field in fields
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
