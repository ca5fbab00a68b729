"""Queries of the feature analysis, over the token feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.features import selected_features
from tokenloom.operators import feature_sets as fs
from tokenloom.operators import feature_stats as st
from tokenloom.plans.token_queries import shown_sql
from tokenloom.session import table

#: A feature that is frequent at every scale.
FEATURE = 7394
SUBSET = [7394, 2303]
LABEL = "keyword"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "token_features")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _finite(df: DataFrame, *columns: str) -> DataFrame:
    """Infinite values and NaN as null, for comparison with SQL."""
    for c in columns:
        df = df.withColumn(c, F.when((F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c)))
    return df


def discriminative_features(spark: SparkSession, d: str) -> DataFrame:
    out = st.discriminative_features(_rows(spark, d), "language", "Python", top_k=5)
    return _rounded(_finite(out, "lift", "in_group_rate", "out_group_rate", "rate_diff"))


def _filtered(spark: SparkSession, d: str, mode: str) -> DataFrame:
    top = 2 if mode == "exact" else 20
    return st.filter_by_features(_rows(spark, d), SUBSET, top, mode).select("idx", "token_pos")


def feature_filter_subset(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "subset")


def feature_filter_exact(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "exact")


def feature_filter_any(spark: SparkSession, d: str) -> DataFrame:
    return _filtered(spark, d, "any")


def rows_with_feature(spark: SparkSession, d: str) -> DataFrame:
    return st.rows_with_feature(_rows(spark, d), FEATURE).select("idx", "token_pos", "feature_activation")


def _weights(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return _rounded(st.token_weights(_rows(spark, d), FEATURE, weight_mode=mode))


def token_weights_count(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, "count")


def token_weights_sum(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, "sum_activation")


def token_weights_mean(spark: SparkSession, d: str) -> DataFrame:
    return _weights(spark, d, "mean_activation")


def display_weights(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(st.display_weights(st.token_weights(_rows(spark, d), FEATURE)))


def feature_languages(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(st.feature_value_counts(_rows(spark, d), FEATURE, "language"))


def feature_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(st.feature_value_counts(_rows(spark, d), FEATURE, "pygments_simple_type"))


def pmi_one(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_finite(st.pmi_one(_rows(spark, d), FEATURE, F.col("pygments_simple_type") == LABEL), "pmi"))


def pmi_all(spark: SparkSession, d: str) -> DataFrame:
    out = st.pmi_all(_rows(spark, d), F.col("pygments_simple_type") == LABEL)
    return _rounded(_finite(out, "pmi", "weighted_pmi"))


def token_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    return fs.token_feature_sets(_rows(spark, d))


def snippet_feature_sets(spark: SparkSession, d: str) -> DataFrame:
    return fs.snippet_feature_sets(_rows(spark, d))


def feature_indicators(spark: SparkSession, d: str) -> DataFrame:
    return fs.feature_indicators(_rows(spark, d))


def selected_features_long(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return rows.select("idx", "token_pos", F.posexplode(selected_features(rows, 5)).alias("i", "feature_id")).select(
        "idx", "token_pos", (F.col("i") + 1).cast("long").alias("rank_no"), "feature_id"
    )


def selected_features_wide(spark: SparkSession, d: str) -> DataFrame:
    """From the wide columns, as in tables without lists."""
    rows = _rows(spark, d).drop("top_k_feature_ids", "top_k_feature_activations")
    return rows.select("idx", "token_pos", selected_features(rows, 5).alias("features"))


def jaccard_snippet(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_finite(fs.concept_overlap(_rows(spark, d)), "mean_jaccard"))


def jaccard_snippet_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_finite(fs.concept_overlap(_rows(spark, d), exclude_same_snippet_id_pairs=False), "mean_jaccard"))


def jaccard_token(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_finite(fs.concept_overlap_tokens(_rows(spark, d)), "mean_jaccard"))


_PAIRS5 = """
    WITH long AS (SELECT *, unnest(list_zip(top_k_feature_ids[1:{k}], top_k_feature_activations[1:{k}])) AS z
                  FROM (SELECT * REPLACE (coalesce(top_k_feature_ids, []) AS top_k_feature_ids,
                        coalesce(top_k_feature_activations, []) AS top_k_feature_activations) FROM token_features) t),
    p AS (SELECT * EXCLUDE (z), z[1] AS f, z[2] AS a FROM long)
"""
_KEEP = "SELECT idx, token_pos FROM token_features WHERE "


def _weight_sql(agg: str) -> str:
    return (
        _PAIRS5.format(k=20)
        + f"SELECT token_str AS token, round({agg}, 6) AS weight FROM p WHERE f = {FEATURE} AND a >= 0 AND token_str <> '' GROUP BY token_str"
    )


def _counts_sql(column: str) -> str:
    return f"""
        SELECT {column}, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM token_features
        WHERE list_contains(top_k_feature_ids, {FEATURE}) AND {column} IS NOT NULL GROUP BY {column}"""


def _jaccard_sql(sets: str, pairs: str) -> str:
    return f"""
        WITH s AS ({sets}),
        j AS (SELECT a.language AS x, b.language AS y, len(list_intersect(a.f, b.f)) AS i, len(a.f) AS na, len(b.f) AS nb
              FROM s a JOIN s b ON {pairs}),
        m AS (SELECT least(x, y) AS language_1, greatest(x, y) AS language_2, avg(CASE WHEN na + nb = 0 THEN 0 ELSE i / (na + nb - i)::DOUBLE END) AS v,
              count(*) AS n FROM j GROUP BY 1, 2),
        l AS (SELECT DISTINCT language FROM s)
        SELECT p.language AS language_1, q.language AS language_2, round(v, 6) AS mean_jaccard, coalesce(n, 0) AS n_pairs
        FROM l p CROSS JOIN l q LEFT JOIN m ON m.language_1 = least(p.language, q.language) AND m.language_2 = greatest(p.language, q.language)"""


_SNIPPET_SETS = """SELECT global_idx AS u, language, list(DISTINCT f) AS f FROM (SELECT global_idx, language, unnest(top_k_feature_ids[1:5]) AS f
    FROM token_features WHERE global_idx IS NOT NULL AND language IS NOT NULL) t GROUP BY 1, 2"""
_TOKEN_SETS = """SELECT token_str AS u, language, coalesce(list(DISTINCT f) FILTER (f IS NOT NULL), []) AS f FROM (
    SELECT token_str, language, unnest(CASE WHEN len(top_k_feature_ids) > 0 THEN top_k_feature_ids[1:5] ELSE [NULL] END) AS f
    FROM token_features WHERE language IS NOT NULL) t GROUP BY 1, 2"""
_ORDERED = "(a.language < b.language OR (a.language = b.language AND a.u < b.u))"


def _union_sql(by: str) -> str:
    return f"""
        SELECT {by}, coalesce(list_sort(list(DISTINCT f) FILTER (f IS NOT NULL)), []) AS features FROM (
          SELECT {by}, unnest(CASE WHEN len(top_k_feature_ids) > 0 THEN top_k_feature_ids[1:5] ELSE [NULL] END) AS f FROM token_features) t
        GROUP BY {by}"""


QUERIES = {
    f.__name__: f
    for f in (
        discriminative_features, feature_filter_subset, feature_filter_exact, feature_filter_any, rows_with_feature, token_weights_count,
        token_weights_sum, token_weights_mean, display_weights, feature_languages, feature_labels, pmi_one, pmi_all, token_feature_sets,
        snippet_feature_sets, feature_indicators, selected_features_long, selected_features_wide, jaccard_snippet, jaccard_snippet_diagonal,
        jaccard_token,
    )
}

SQL = {
    "discriminative_features": _PAIRS5.format(k=5)
    + """
        , tot AS (SELECT count(DISTINCT global_idx) FILTER (coalesce(language = 'Python', false)) AS ti,
                  count(DISTINCT global_idx) FILTER (NOT coalesce(language = 'Python', false)) AS t_o FROM token_features),
        g AS (SELECT f, count(DISTINCT global_idx) FILTER (m) AS ni, count(DISTINCT global_idx) FILTER (NOT m) AS n_o, avg(b) FILTER (m) AS mi,
              avg(b) FILTER (NOT m) AS mo FROM (SELECT f, global_idx, coalesce(language = 'Python', false) AS m, CASE WHEN isnan(a) THEN NULL ELSE a END AS b FROM p) x
              GROUP BY f)
        SELECT f AS feature_id, ni AS in_group_count, n_o AS out_group_count, ti AS in_group_total, t_o AS out_group_total, round(ni / ti, 6) AS in_group_rate,
               round(n_o / t_o, 6) AS out_group_rate, round(ni / ti - n_o / t_o, 6) AS rate_diff,
               CASE WHEN n_o > 0 THEN round((ni / ti) / (n_o / t_o), 6) END AS lift, round(mi, 6) AS in_group_mean_activation,
               round(mo, 6) AS out_group_mean_activation, round(mi - mo, 6) AS activation_diff FROM g, tot WHERE ni >= 1""",
    "feature_filter_subset": _KEEP + "list_has_all(top_k_feature_ids[1:20], [7394, 2303])",
    "feature_filter_exact": _KEEP + "list_has_all(top_k_feature_ids[1:2], [7394, 2303]) AND list_has_all([7394, 2303], top_k_feature_ids[1:2])",
    "feature_filter_any": _KEEP + "list_has_any(top_k_feature_ids[1:20], [7394, 2303])",
    "rows_with_feature": f"""
        SELECT idx, token_pos, list_filter(list_zip(top_k_feature_ids[1:5], top_k_feature_activations[1:5]),
               lambda z: z[1] = {FEATURE} AND z[2] >= 0.1 AND NOT isnan(z[2]))[1][2] AS feature_activation
        FROM token_features WHERE len(list_filter(list_zip(top_k_feature_ids[1:5], top_k_feature_activations[1:5]),
               lambda z: z[1] = {FEATURE} AND z[2] >= 0.1 AND NOT isnan(z[2]))) > 0""",
    "token_weights_count": _weight_sql("count(*)::DOUBLE"),
    "token_weights_sum": _weight_sql("sum(a)"),
    "token_weights_mean": _weight_sql("avg(a)"),
    "display_weights": _PAIRS5.format(k=20)
    + f"""SELECT {shown_sql('token_str')} AS token, round(sum(a), 6) AS weight FROM p WHERE f = {FEATURE} AND a >= 0 AND token_str <> '' GROUP BY 1""",
    "feature_languages": _counts_sql("language"),
    "feature_labels": _counts_sql("pygments_simple_type"),
    "pmi_one": f"""
        WITH c AS (SELECT coalesce(pygments_simple_type = 'keyword', false) AS m,
                   len(list_filter(list_zip(top_k_feature_ids, top_k_feature_activations), lambda z: z[1] = {FEATURE} AND z[2] >= 0 AND NOT isnan(z[2]))) AS h
                   FROM token_features),
        n AS (SELECT count(*) AS n_rows, sum(h)::BIGINT AS n_feature, coalesce(sum(h) FILTER (m), 0)::BIGINT AS n_both, count(*) FILTER (m) AS n_label FROM c)
        SELECT n_rows, n_feature, n_both, n_label, CASE WHEN n_both > 0 AND n_label > 0 THEN
               round(log2((n_both / n_rows) / ((n_feature / n_rows) * (n_label / n_rows))), 6) END AS pmi FROM n""",
    "pmi_all": """
        WITH rn AS (SELECT row_number() OVER () AS r, coalesce(pygments_simple_type = 'keyword', false) AS m, top_k_feature_ids AS i, top_k_feature_activations AS v FROM token_features),
        e AS (SELECT r, m, z[1] AS f, max(z[2]) AS a FROM (SELECT r, m, unnest(list_zip(i, v)) AS z FROM rn) t
              WHERE z[1] IS NOT NULL AND z[2] >= 0 AND NOT isnan(z[2]) GROUP BY r, m, f),
        n AS (SELECT count(*) AS n, count(*) FILTER (m) AS nl FROM rn),
        ms AS (SELECT sum(a) AS mass, coalesce(sum(a) FILTER (m), 0) AS lm FROM e),
        g AS (SELECT f, count(*) AS fc, count(*) FILTER (m) AS jc, sum(a) AS fa, coalesce(sum(a) FILTER (m), 0) AS ja FROM e GROUP BY f)
        SELECT f AS feature_id, fc AS feature_count, jc AS joint_count, round(fc / n, 6) AS p_feature, round(nl / n, 6) AS p_label, round(jc / n, 6) AS p_joint,
               CASE WHEN jc > 0 THEN round(log2((jc / n) / ((fc / n) * (nl / n))), 6) END AS pmi, round(fa, 6) AS feature_activation_mass,
               round(ja, 6) AS joint_activation_mass, round(fa / mass, 6) AS weighted_p_feature, round(lm / mass, 6) AS weighted_p_label,
               round(ja / mass, 6) AS weighted_p_joint, CASE WHEN ja > 0 THEN round(log2((ja / mass) / ((fa / mass) * (lm / mass))), 6) END AS weighted_pmi
        FROM g, n, ms WHERE nl > 0""",
    "token_feature_sets": _union_sql("language, token_str"),
    "snippet_feature_sets": _union_sql("global_idx, language"),
    "feature_indicators": """
        SELECT DISTINCT global_idx, language, unnest(top_k_feature_ids[1:5]) AS feature_id FROM token_features
        WHERE global_idx IS NOT NULL AND language IS NOT NULL""",
    "selected_features_long": """
        SELECT idx, token_pos, unnest(range(1, len(top_k_feature_ids[1:5]) + 1)) AS rank_no, unnest(top_k_feature_ids[1:5]) AS feature_id FROM token_features""",
    "selected_features_wide": """
        SELECT idx, token_pos, list_filter([top_1_feature_id, top_2_feature_id, top_3_feature_id, top_4_feature_id, top_5_feature_id], lambda x: x IS NOT NULL) AS features
        FROM token_features""",
    "jaccard_snippet": _jaccard_sql(_SNIPPET_SETS, _ORDERED + " AND a.u <> b.u"),
    "jaccard_snippet_diagonal": _jaccard_sql(_SNIPPET_SETS, _ORDERED),
    "jaccard_token": _jaccard_sql(_TOKEN_SETS, _ORDERED),
}
