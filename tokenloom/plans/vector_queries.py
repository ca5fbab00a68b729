"""Queries on dense vectors: top entries, wide columns, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.features import top_pairs, vector_statistics, wide_columns
from tokenloom.session import table

K = 8


def _pairs(spark: SparkSession, d: str, k: int = K, positive: bool = True) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding", top_pairs(F.col("embedding"), k, positive).alias("pairs"))


def _lists(df: DataFrame) -> DataFrame:
    ids = F.transform("pairs", lambda p: p["feature_id"])
    acts = F.transform("pairs", lambda p: p["activation"])
    return df.select("vec_id", ids.alias("top_k_feature_ids"), acts.alias("top_k_feature_activations"), F.size("pairs").cast("long").alias("top_k_found"))


def topk_positive(spark: SparkSession, d: str) -> DataFrame:
    return _lists(_pairs(spark, d))


def topk_signed(spark: SparkSession, d: str) -> DataFrame:
    return _lists(_pairs(spark, d, positive=False))


def topk_long(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", F.posexplode("pairs").alias("i", "p")).select("vec_id", (F.col("i") + 1).cast("long").alias("rank_no"), "p.feature_id", "p.activation")


def topk_wide(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("vec_id", *wide_columns(F.col("pairs"), K))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = _pairs(spark, d).select("vec_id", *vector_statistics(F.col("embedding"), F.col("pairs")))
    exact = [c for c, t in stats.dtypes if t != "double"]
    return stats.select(*exact, *[F.round(c, 6).alias(c) for c, t in stats.dtypes if t == "double"])


_TOP = """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    r AS (SELECT vec_id, i, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rank_no FROM e WHERE {cond}),
    t AS (SELECT * FROM r WHERE rank_no <= 8)
"""
_LIST = """
    SELECT v.vec_id, coalesce(list(t.i ORDER BY rank_no) FILTER (t.i IS NOT NULL), []) AS top_k_feature_ids,
           coalesce(list(t.x ORDER BY rank_no) FILTER (t.i IS NOT NULL), []) AS top_k_feature_activations, count(t.i) AS top_k_found
    FROM embeddings v LEFT JOIN t ON t.vec_id = v.vec_id GROUP BY v.vec_id"""
_WIDE = ", ".join(
    f"max(CASE WHEN rank_no = {r} THEN i END) AS top_{r}_feature_id, max(CASE WHEN rank_no = {r} THEN x END) AS top_{r}_feature_activation" for r in range(1, K + 1)
)

QUERIES = {"topk_positive": topk_positive, "topk_signed": topk_signed, "topk_long": topk_long, "topk_wide": topk_wide, "vector_stats": vector_stats}
SQL = {
    "topk_positive": _TOP.format(cond="x > 0") + _LIST,
    "topk_signed": _TOP.format(cond="true") + _LIST,
    "topk_long": _TOP.format(cond="x > 0") + "SELECT vec_id, rank_no, i AS feature_id, x AS activation FROM t",
    "topk_wide": _TOP.format(cond="x > 0") + f"SELECT v.vec_id, {_WIDE} FROM embeddings v LEFT JOIN t ON t.vec_id = v.vec_id GROUP BY v.vec_id",
    "vector_stats": _TOP.format(cond="x > 0")
    + """
        , s AS (SELECT vec_id, count(*) AS sae_width, count(*) FILTER (x > 0) AS sae_l0_positive, sum(greatest(x, 0)) AS l1,
                sqrt(sum(x * x)) AS l2, max(x) AS mx, avg(x) AS mean, stddev_pop(x) AS std, count(*) FILTER (x >= 0) AS sae_active_ge_0_0,
                count(*) FILTER (x >= 0.1) AS sae_active_ge_0_1, count(*) FILTER (x >= 1) AS sae_active_ge_1_0 FROM e GROUP BY vec_id),
        k AS (SELECT vec_id, sum(x) AS ts, max(CASE WHEN rank_no = 1 THEN i END) AS top_feature_id, max(x) AS ta FROM t GROUP BY vec_id)
        SELECT s.vec_id, sae_width, sae_l0_positive, round(l1, 6) AS sae_l1_positive, round(l2, 6) AS sae_l2, round(mx, 6) AS sae_max_activation,
               round(mean, 6) AS sae_mean_activation, round(std, 6) AS sae_std_activation, round(coalesce(ts, 0), 6) AS top_k_activation_sum,
               round(CASE WHEN l1 > 0 THEN ts / l1 ELSE 0 END, 6) AS top_k_fraction_of_l1, top_feature_id, round(ta, 6) AS top_feature_activation,
               sae_active_ge_0_0, sae_active_ge_0_1, sae_active_ge_1_0
        FROM s LEFT JOIN k ON k.vec_id = s.vec_id""",
}
