"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import budget, cooccur, encode, leakage, quantiles, setjoin, spans, syntaxcheck, topn
from tokenloom.session import table

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
GROUPS = ["language", "pygments_simple_type"]
METRICS = ["sae_l0_positive", "sae_max_activation"]


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Each token position once; of copies that differ, the greatest."""
    rows = table(spark, d, "token_features")
    return (
        rows.groupBy("idx", "token_pos")
        .agg(F.max(F.struct(*GROUPS, *METRICS)).alias("r"), F.min("written_at").alias("first_written"))
        .select("r.*", "first_written")
    )


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each day's batch, and of all batches together (batch ``all``) from the days' digests, merged."""
    rows = _positions(spark, d).withColumn("batch", F.date_format("first_written", "yyyy-MM-dd"))
    days = quantiles.digest(rows, [*GROUPS, "batch"], METRICS)
    whole = quantiles.merge(days.withColumn("batch", F.lit("all")), [*GROUPS, "batch"])
    out = quantiles.read_percentiles(days.unionByName(whole), [*GROUPS, "batch"], PERCENTILES)
    return out.withColumn("max_rank_error", F.lit(quantiles.RANK_ERROR))  # as a share of n


def p1_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of all batches lies within the stated error of the exact ranks."""
    rows = _positions(spark, d)
    whole = quantiles.read_percentiles(quantiles.digest(rows, GROUPS, METRICS), GROUPS, PERCENTILES)
    return quantiles.rank_check(rows, GROUPS, METRICS, whole).select(*GROUPS, "metric", "n", "percentile", "within")


def _checked(spark: SparkSession, d: str, *more: str) -> DataFrame:
    rows = table(spark, d, "snippets").withColumn("repository", syntaxcheck.repository_of(F.col("file_path")))
    return syntaxcheck.check_files(rows, ["language", "snippet_id", *more], "language", "code")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where(~F.col("valid")).select("language", "snippet_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates per repository and language. Rows delivered twice are alike and merge."""
    files = _checked(spark, d, "repository").distinct()
    hints = syntaxcheck.latest_hint(table(spark, d, "parse_results"), ["language", "snippet_id"])
    return syntaxcheck.invalid_rates(files, ["repository", "language"], hints, ["language", "snippet_id"])


def _top(spark: SparkSession, d: str, n: int) -> DataFrame:
    rows = table(spark, d, "token_features")
    return topn.top_n_per_group(
        rows, "top_feature_id", "top_feature_activation", ["token_str", "idx", "token_pos"], ["idx", "token_pos"], n
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 3).select("top_feature_id", "rank_no", "idx", "token_pos")


def p3_top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 10)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_features")
    return cooccur.associations(rows, "top_k_feature_ids", ["idx", "token_pos"], 10, 10).select("feature_a", "feature_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "token_features")
    found = cooccur.associations(rows, "top_k_feature_ids", ["idx", "token_pos"], 2)
    return found.withColumn("lift", F.round("lift", 6)).withColumn("pmi", F.round("pmi", 6))


def _sequences(spark: SparkSession, d: str, name: str, *more: str) -> DataFrame:
    """The known token count of each sequence, once, with its value of the columns ``more``."""
    rows = table(spark, d, name).groupBy("idx").agg(F.max("seq_len").alias("known"), *[F.max(c).alias(c) for c in more])
    return rows.where(F.col("known").isNotNull())


def _known_of_snippets(spark: SparkSession, d: str) -> DataFrame:
    """_language, _snippet_id, known: the sum over the sequences of a snippet. A sequence without a language is of the
    snippet with its id, if there is but one."""
    only = table(spark, d, "snippets").groupBy("snippet_id").agg(F.count_distinct(F.struct("language")).alias("n"), F.max("language").alias("only"))
    return (
        _sequences(spark, d, "token_features", "language", "snippet_id")
        .hint("merge")
        .join(only.where("n = 1").hint("merge"), "snippet_id", "left")
        .groupBy(F.coalesce("language", "only").alias("_language"), F.col("snippet_id").alias("_snippet_id"))
        .agg(F.sum("known").alias("known"))
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """table_name, text_id, source, language, domain, text, known: each document, text sample and snippet once. A
    snippet's id is unique within its language."""
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select(
        F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("text_id"), "source", F.col("lang").alias("language"), "domain", "text", F.lit(None).cast("long").alias("known")
    )
    latest = lambda *c: F.max(F.struct("written_at", *c)).alias("r")
    samples = (
        table(spark, d, "text_samples").groupBy("idx").agg(latest("source_dataset", "language", "text"))
        .hint("merge")
        .join(_sequences(spark, d, "text_token_features").hint("merge"), "idx", "left")
        .select(F.lit("text_samples"), "idx", F.col("r.source_dataset"), F.col("r.language"), none, F.col("r.text"), "known")
    )
    snippets = (
        table(spark, d, "snippets").groupBy("language", "snippet_id").agg(latest("code"))
        .hint("merge")
        .join(_known_of_snippets(spark, d).hint("merge"), F.col("language").eqNullSafe(F.col("_language")) & (F.col("snippet_id") == F.col("_snippet_id")), "left")
        .select(F.lit("snippets"), "snippet_id", none, "language", none, F.col("r.code"), "known")
    )
    return docs.union(samples).union(snippets)


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return budget.document_tokens(_texts(spark, d), ["table_name", "text_id", "source", "language", "domain", "known"], "text")


def p5_documents(spark: SparkSession, d: str) -> DataFrame:
    """The number of tokens of each text, beside the known one where there is one."""
    return _counted(spark, d).withColumnRenamed("known", "known_tokens")


def p5_tokens(spark: SparkSession, d: str) -> DataFrame:
    return budget.token_budget(_counted(spark, d), ["table_name", "source", "language", "domain"], "known")


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, str, str, int, int, int, int]:
    rows = table(spark, d, "token_sets")
    return rows, "set_id", "top_k_feature_ids", 5, 4, 5, rows.count()  # the count comes from file footers


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.similar_pairs(*_sets(spark, d))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.record_links(*_sets(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.reparameterised(docs, "doc_id", "text", items, "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_documents(table(spark, d, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands in other documents, too."""
    return spans.shared_amounts(table(spark, d, "documents"), "doc_id", "text")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    """Which parts of each document stand in other documents, too."""
    return spans.shared_stretches(table(spark, d, "documents"), "doc_id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text again, from its ids."""
    return encode.decode_column(p8_ids(spark, d), "doc_id")


QUERIES = {
    "p1_percentiles": p1_percentiles,
    "p1_bound": p1_bound,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_top_tokens": p3_top_tokens,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p5_tokens": p5_tokens,
    "p5_documents": p5_documents,
    "p6_found": p6_found,
    "p6_links": p6_links,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_reparameterised": p9_reparameterised,
    "p10_found": p10_found,
    "p10_shared": p10_shared,
    "p10_stretches": p10_stretches,
}
