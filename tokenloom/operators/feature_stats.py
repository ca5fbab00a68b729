"""Statistics of sparse features over token rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.features import activation_of, feature_ids, selected_features, selected_pairs, snippet_column, token_column
from tokenloom.functions.labels import display_token

_INF = float("inf")
_NAN = float("nan")


def explode_pairs(df: DataFrame, k: int | None, *keep: Column) -> DataFrame:
    """One row per (feature_id, activation) of the first k features, with the columns ``keep``; empty lists vanish."""
    return df.select(*keep, F.explode(selected_pairs(df, k)).alias("p")).select("*", F.col("p.feature_id"), F.col("p.activation")).drop("p")


def positive_flag(column: Column, values) -> Column:
    """Membership in the positive group; a single value or string is a group of one, null is never in it."""
    if isinstance(values, (str, bytes)) or not isinstance(values, Iterable):
        values = [values]
    return F.coalesce(column.isin(*list(values)), F.lit(False))


def discriminative_features(
    df: DataFrame,
    group_col: str,
    positive_values,
    top_k: int = 5,
    unit_col: str | None = None,
    min_in_group_count: int = 1,
    sort_by: str = "rate_diff",
    ascending: bool = False,
) -> DataFrame:
    """How much more often each feature occurs in units of the positive group than in others.

    A unit with rows of both kinds counts on both sides. Rates are NaN where a side has no unit; lift is infinite where
    the outer rate is zero or NaN; means are over exploded rows, without NaN. Ordered by ``sort_by``, then in-group
    rate and count descending, then feature id; NaN last. Always the same columns, also without rows.
    """
    unit = unit_col or snippet_column(df)
    flag = positive_flag(F.col(group_col), positive_values)
    base = df.select(F.col(unit).alias("unit"), flag.alias("flag"), selected_pairs(df, top_k).alias("pairs"))
    totals = base.agg(
        F.count_distinct(F.when(F.col("flag"), F.col("unit"))).alias("in_total"),
        F.count_distinct(F.when(~F.col("flag"), F.col("unit"))).alias("out_total"),
    )
    long = base.select("unit", "flag", F.explode("pairs").alias("p")).select("unit", "flag", "p.feature_id", "p.activation")
    act = F.when(~F.isnan("activation"), F.col("activation"))
    per = long.groupBy("feature_id").agg(
        F.count_distinct(F.when(F.col("flag"), F.col("unit"))).alias("in_group_count"),
        F.count_distinct(F.when(~F.col("flag"), F.col("unit"))).alias("out_group_count"),
        F.avg(F.when(F.col("flag"), act)).alias("in_group_mean_activation"),
        F.avg(F.when(~F.col("flag"), act)).alias("out_group_mean_activation"),
    )
    rate = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(F.lit(_NAN))
    out = (
        per.where(F.col("in_group_count") >= min_in_group_count)
        .crossJoin(F.broadcast(totals))  # one row
        .withColumn("in_group_rate", rate("in_group_count", "in_total"))
        .withColumn("out_group_rate", rate("out_group_count", "out_total"))
        .withColumn("rate_diff", F.col("in_group_rate") - F.col("out_group_rate"))
        .withColumn(
            "lift",
            F.when((F.col("out_group_rate") > 0) & ~F.isnan("out_group_rate"), F.col("in_group_rate") / F.col("out_group_rate")).otherwise(F.lit(_INF)),
        )
        .withColumn("activation_diff", F.col("in_group_mean_activation") - F.col("out_group_mean_activation"))
        .withColumnsRenamed({"in_total": "in_group_total", "out_total": "out_group_total"})
    )
    down = lambda c: F.when(~F.isnan(c), F.col(c)).desc_nulls_last()
    first = F.when(~F.isnan(sort_by), F.col(sort_by))
    return out.orderBy(first.asc_nulls_last() if ascending else first.desc_nulls_last(), down("in_group_rate"), F.desc("in_group_count"), "feature_id").select(
        "feature_id", "in_group_count", "out_group_count", "in_group_total", "out_group_total", "in_group_rate", "out_group_rate",
        "rate_diff", "lift", "in_group_mean_activation", "out_group_mean_activation", "activation_diff",
    )


def filter_by_features(df: DataFrame, ids: Sequence[int], top_k: int = 20, match_mode: str = "subset") -> DataFrame:
    """Rows whose first k features hold all of ``ids`` (subset), exactly these (exact) or one of them (any)."""
    ids = sorted({int(i) for i in ids})
    if not ids:
        raise ValueError("feature_ids must not be empty")
    have = selected_features(df, top_k)
    want = F.array(*[F.lit(i).cast("bigint") for i in ids])
    subset = F.size(F.array_except(want, have)) == 0
    modes = {"subset": subset, "exact": subset & (F.size(F.array_except(have, want)) == 0), "any": F.arrays_overlap(have, want)}
    if match_mode not in modes:
        raise ValueError(f"match_mode must be one of {sorted(modes)}")
    return df.where(modes[match_mode])


def rows_with_feature(df: DataFrame, feature_id: int, activation_threshold: float = 0.1, top_k: int = 5) -> DataFrame:
    """Rows that have the feature among the first k at or above the threshold, with ``feature_activation``, highest
    first; of equal ones in order of what keys the table has."""
    act = activation_of(selected_pairs(df, top_k), feature_id, activation_threshold)
    keys = [c for c in ("language", "snippet_id", "global_idx", "idx", "token_pos") if c in df.columns]
    return df.withColumn("feature_activation", act).where(F.col("feature_activation").isNotNull()).orderBy(F.desc("feature_activation"), *keys)


def token_weights(
    df: DataFrame,
    feature_id: int,
    activation_threshold: float = 0.0,
    token_col: str = "token_str",
    top_k: int = 20,
    weight_mode: str = "sum_activation",
    drop_empty_tokens: bool = True,
) -> DataFrame:
    """(token, weight) of one feature: count, sum or mean of its activations at or above the threshold per token,
    greatest first. A null token is the empty token."""
    weights = {"count": F.count(F.lit(1)).cast("double"), "sum_activation": F.sum("activation"), "mean_activation": F.avg("activation")}
    if weight_mode not in weights:
        raise ValueError(f"weight_mode must be one of {sorted(weights)}")
    token = F.coalesce(F.col(token_column(df, token_col)).cast("string"), F.lit(""))
    hit = explode_pairs(df, top_k, token.alias("token")).where(
        (F.col("feature_id") == feature_id) & (F.col("activation") >= activation_threshold) & ~F.isnan("activation")
    )
    if drop_empty_tokens:
        hit = hit.where(F.col("token") != "")
    return hit.groupBy("token").agg(weights[weight_mode].alias("weight")).orderBy(F.desc("weight"), "token")


def display_weights(weights: DataFrame, max_words: int | None = None) -> DataFrame:
    """(token, weight) added up by the visible form of the token; the data of a word cloud."""
    out = weights.groupBy(display_token(F.col("token")).alias("token")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "token")
    return out if max_words is None else out.limit(max_words)


def feature_value_counts(df: DataFrame, feature_id: int, column: str) -> DataFrame:
    """(column, n, share): how often each non-null value occurs among rows whose whole list holds the feature."""
    counts = df.where(F.array_contains(feature_ids(df), F.lit(feature_id).cast("bigint")) & F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), column)  # one row


def _log_ratio(joint: Column, expected: Column) -> Column:
    """log2 of joint over expected, minus infinity where nothing is shared."""
    return F.when((joint > 0) & (expected > 0), F.log2(joint / expected)).otherwise(F.lit(-_INF))


def pmi_one(df: DataFrame, feature_id: int, mask: Column, activation_threshold: float = 0.0) -> DataFrame:
    """One row: n_rows, n_feature, n_both, n_label, pmi of one feature and a label. Occurrences are counted, so a
    feature twice in a list counts twice; the whole list counts."""
    mask = F.coalesce(mask, F.lit(False))
    hits = F.size(
        F.filter(selected_pairs(df, None), lambda p: (p["feature_id"] == feature_id) & (p["activation"] >= activation_threshold) & ~F.isnan(p["activation"]))
    )
    counts = df.select(hits.alias("h"), mask.alias("m")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("h"), F.lit(0)).alias("n_feature"),
        F.coalesce(F.sum(F.when(F.col("m"), F.col("h"))), F.lit(0)).alias("n_both"),
        F.count_if("m").alias("n_label"),
    )
    n = F.col("n_rows").cast("double")
    return counts.withColumn("pmi", _log_ratio(F.try_divide(F.col("n_both"), n), F.try_divide(F.col("n_feature"), n) * F.try_divide(F.col("n_label"), n)))


def pmi_all(df: DataFrame, mask: Column, activation_threshold: float = 0.0) -> DataFrame:
    """Binary and activation-weighted PMI of every feature and a label, over the whole lists.

    A feature counts once per row, with its greatest activation at or above the threshold; since a list belongs to one
    row, that is settled inside the row. No row where the label never holds. Highest PMI first.
    """
    mask = F.coalesce(mask, F.lit(False))
    pairs = F.filter(selected_pairs(df, None), lambda p: p["feature_id"].isNotNull() & (p["activation"] >= activation_threshold) & ~F.isnan(p["activation"]))
    base = df.select(mask.alias("m"), pairs.alias("pairs"))
    best = F.transform(
        F.array_distinct(F.transform("pairs", lambda p: p["feature_id"])),
        lambda i: F.struct(
            i.alias("feature_id"),
            F.array_max(F.transform(F.filter("pairs", lambda p: p["feature_id"] == i), lambda p: p["activation"])).alias("activation"),
        ),
    )
    long = base.select("m", F.explode(best).alias("p")).select("m", "p.feature_id", "p.activation")
    per = long.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.count_if("m").alias("joint_count"),
        F.sum("activation").alias("feature_activation_mass"),
        F.coalesce(F.sum(F.when(F.col("m"), F.col("activation"))), F.lit(0.0)).alias("joint_activation_mass"),
    )
    rows = base.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("m").alias("n_label"))
    mass = per.agg(F.sum("feature_activation_mass").alias("mass"), F.sum("joint_activation_mass").alias("label_mass"))
    n, c = F.col("n_rows").cast("double"), F.col
    return (
        per.crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(mass))  # one row each
        .where(c("n_label") > 0)
        .withColumn("p_feature", c("feature_count") / n)
        .withColumn("p_label", c("n_label") / n)
        .withColumn("p_joint", c("joint_count") / n)
        .withColumn("pmi", _log_ratio(c("p_joint"), c("p_feature") * c("p_label")))
        .withColumn("weighted_p_feature", F.try_divide(c("feature_activation_mass"), c("mass")))
        .withColumn("weighted_p_label", F.try_divide(c("label_mass"), c("mass")))
        .withColumn("weighted_p_joint", F.try_divide(c("joint_activation_mass"), c("mass")))
        .withColumn("weighted_pmi", _log_ratio(c("weighted_p_joint"), c("weighted_p_feature") * c("weighted_p_label")))
        .select(
            "feature_id", "feature_count", "joint_count", "p_feature", "p_label", "p_joint", "pmi", "feature_activation_mass",
            "joint_activation_mass", "weighted_p_feature", "weighted_p_label", "weighted_p_joint", "weighted_pmi",
        )
        .orderBy(F.desc("pmi"), F.desc("weighted_pmi"), "feature_id")
    )
