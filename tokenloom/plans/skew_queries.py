"""Queries on keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.skew import heavy_key_report, salted_summary
from tokenloom.session import table

HEAVY_SHARE = 0.02


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_features").select("token_text", "top_feature_id", "idx", "token_pos")
    return heavy_key_report(rows, ["token_text", "top_feature_id"], HEAVY_SHARE, ["idx", "token_pos"])


def _summary(spark: SparkSession, d: str, field: str) -> DataFrame:
    rows = table(spark, d, "token_features").select(field, "top_feature_activation", "idx", "token_pos")
    out = salted_summary(rows, field, "top_feature_activation", ["idx", "token_pos"], HEAVY_SHARE)
    return out.select(
        F.col("key").alias(field),
        "n_rows",
        "n_values",
        F.round("mean_value", 6).alias("mean_activation"),
        F.col("min_value").alias("min_activation"),
        F.col("max_value").alias("max_activation"),
        "is_heavy",
    )


def p7_by_token_text(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "token_text")


def p7_by_top_feature(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d, "top_feature_id")


def _summary_sql(field: str) -> str:
    return f"""
        SELECT {field}, count(*) AS n_rows, count(v) AS n_values, round(avg(v), 6) AS mean_activation,
               min(v) AS min_activation, max(v) AS max_activation,
               50 * count(*) >= (SELECT count(*) FROM token_features) AS is_heavy
        FROM (SELECT {field}, CASE WHEN isnan(top_feature_activation) THEN NULL ELSE top_feature_activation END AS v
              FROM token_features) t
        WHERE {field} IS NOT NULL GROUP BY {field}"""


QUERIES = {"p7_found": p7_found, "p7_by_token_text": p7_by_token_text, "p7_by_top_feature": p7_by_top_feature}

SQL = {
    "p7_found": """
        SELECT 'token_text' AS field_name, token_text AS key_value FROM token_features
        WHERE token_text IS NOT NULL GROUP BY token_text
        HAVING 50 * count(*) >= (SELECT count(*) FROM token_features)
        UNION ALL
        SELECT 'top_feature_id', CAST(top_feature_id AS VARCHAR) FROM token_features
        WHERE top_feature_id IS NOT NULL GROUP BY top_feature_id
        HAVING 50 * count(*) >= (SELECT count(*) FROM token_features)""",
    "p7_by_token_text": _summary_sql("token_text"),
    "p7_by_top_feature": _summary_sql("top_feature_id"),
}
