"""Queries that need Python: lexing, parsing, annotation, encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.syntax import ParserRegistry, parse_lines
from tokenloom.operators.annotate import annotate_tokens, parse_snippets
from tokenloom.operators.encode import SeededProvider, SentEncoder, encode_features, extract_activations, good_rows
from tokenloom.operators.ingest import last_wins
from tokenloom.operators.legacy import code_feature_rows, text_feature_rows
from tokenloom.session import table


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    """Each snippet once, as delivered last."""
    # Parsing costs far more than reading, so tasks are cut finer than by their bytes; the exchange serves the choice of
    # the last delivery, too.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = table(spark, d, "snippets").select("snippet_id", "global_idx", "language", "file_path", "source_snippet_ids", "source_file_paths", "num_fragments", "code", "written_at")
    return last_wins(rows.repartition(tasks, "language", "snippet_id"), ["language", "snippet_id"], ["written_at"]).drop("written_at")


def annotated_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The annotation of all snippets, added up per snippet."""
    rows = annotate_tokens(_snippets(spark, d))
    count = lambda c, n: F.count_if(c).alias(n)
    return rows.groupBy("language", "snippet_id", "tree_sitter_status").agg(
        F.count(F.lit(1)).alias("n_tokens"), count(F.col("is_name_like_token"), "n_names"), count(F.col("token_name_is_decl"), "n_declarations"), count(F.col("token_variable_is_read"), "n_reads"),
        count(F.col("token_variable_is_write"), "n_writes"), F.sum("token_name_distance_to_last_write_tokens").alias("sum_write_distance"), F.max("scope_depth").alias("max_depth"), F.sum("num_in_scope_names").alias("sum_visible"),
        count(F.col("pygments_simple_label") == "keyword", "n_keywords"), count(F.col("pygments_label").startswith("Token.Literal"), "n_literals"), F.sum(F.length("tree_sitter_path")).alias("sum_path"),
        count(F.col("tree_sitter_leaf_type") == "identifier", "n_identifiers"), F.sum(F.length("in_scope_names")).alias("sum_scope_names"), F.sum(F.length("token_text")).alias("n_chars"),
    )


def line_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Paths, names, scopes, declarations and usages of the tokens of all snippets, with lines for blocks."""
    rows = annotate_tokens(_snippets(spark, d), registry=ParserRegistry(otherwise=lambda: parse_lines), json_lists=False).where(F.col("token_identifier_name").isNotNull())
    return rows.select(
        "language", "snippet_id", "token_pos", "token_text", "tree_sitter_path", "tree_sitter_leaf_type", F.col("token_identifier_name").alias("name"), "scope_depth", "scope_node_type", "num_in_scope_names",
        F.get("in_scope_names", 0).alias("in_scope_name"), "token_name_is_in_scope", "token_name_is_decl", F.col("token_variable_access_kind").alias("access"), F.col("token_variable_usage_start").alias("usage_start"),
        F.col("token_name_declaration_token_pos").alias("declared_at"), F.col("token_name_last_write_token_pos").alias("written_at"),
    )


def lexer_labels(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_snippets(_snippets(spark, d)).select("language", F.explode("tokens").alias("t")).select("language", F.explode("t.runs").alias("r"))
    return parsed.groupBy("language", F.col("r.simple").alias("label")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("r.end") - F.col("r.start")).alias("n_chars"))


def parse_statuses(spark: SparkSession, d: str) -> DataFrame:
    return parse_snippets(_snippets(spark, d)).groupBy("language", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("n_tokens"))


def seeded_encoder(spark: SparkSession, inputs: int = 16, width: int = 64, seed: int = 0) -> SentEncoder:
    """Random weights."""
    rng = np.random.default_rng(seed)
    made = {"w": rng.standard_normal((inputs, width)), "b": rng.standard_normal(width), "threshold": np.full(width, 0.5)}
    return SentEncoder(spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in made.items()}))


def _text_samples(spark: SparkSession, d: str) -> DataFrame:
    """Each text sample once, as delivered last."""
    return last_wins(table(spark, d, "text_samples"), ["idx"], ["written_at", "text"]).drop("written_at")


def sparse_features(spark: SparkSession, d: str) -> DataFrame:
    """Text samples to tokens, vectors and sparse features."""
    texts = _text_samples(spark, d).select(F.col("idx").alias("snippet_id"), F.lit("text").alias("language"), F.col("text").alias("code"))
    dense = good_rows(extract_activations(texts, SeededProvider(16), "seeded", 20, sequence=True))
    out = encode_features(dense, seeded_encoder(spark), "seeded", "layer_20", top_k=4)
    return out.select("snippet_id", "token_pos", "token_text", "seq_len", "prev_token_str", "top_k_feature_ids", "top_k_found", "sae_l0_positive", "top_1_feature_id", "top_4_feature_id", "sae_active_ge_0_1", "hook_name")


def sparse_sequences(spark: SparkSession, d: str) -> DataFrame:
    """What of ``sparse_features`` does not depend on the model."""
    found = F.when(F.col("top_k_found") == F.size("top_k_feature_ids"), F.lit(True)).otherwise(F.lit(False))
    rows = sparse_features(spark, d).withColumn("consistent", found & F.col("top_1_feature_id").eqNullSafe(F.get("top_k_feature_ids", 0)) & (F.col("top_k_found") <= F.least(F.lit(4), "sae_l0_positive")))
    return rows.select("snippet_id", "token_pos", "token_text", "seq_len", "prev_token_str", "consistent")


def legacy_text_rows(spark: SparkSession, d: str) -> DataFrame:
    """The older table of text tokens, without the columns that depend on the model."""
    rows = text_feature_rows(_text_samples(spark, d), SeededProvider(16), seeded_encoder(spark), "seeded", 20, "seeded", "layer_20", max_length=32, top_k=3)
    return rows.select(
        "idx", "modality", "source_dataset", "text_label_id", "token_pos", "seq_len", "text_char_len", "token_text", "char_start", "char_end", "char_len", "is_whitespace_token", "prev_token_str", "next_token_str"
    )


def legacy_code_rows(spark: SparkSession, d: str) -> DataFrame:
    """The older table of code tokens, counted by label."""
    samples = _snippets(spark, d).withColumnRenamed("snippet_id", "idx")
    rows = code_feature_rows(samples, SeededProvider(16), seeded_encoder(spark), "seeded", 20, "seeded", "layer_20", top_k=3)
    return rows.groupBy("language", "pygments_simple_type", "pygments_label_id").agg(F.count(F.lit(1)).alias("n"), F.sum("char_len").alias("n_chars"), F.max("seq_len").alias("longest"))


def tokenized_snippets(spark: SparkSession, d: str) -> DataFrame:
    """How many tokens each snippet has in the annotation, and how many characters they cover."""
    parsed = parse_snippets(_snippets(spark, d))
    return parsed.select("language", "snippet_id", F.size("tokens").cast("long").alias("n_tokens"), F.coalesce(F.array_max(F.transform("tokens", lambda t: t["end"])), F.lit(0)).alias("n_chars"))


QUERIES = {f.__name__: f for f in (annotated_tokens, line_tokens, lexer_labels, parse_statuses, sparse_features, sparse_sequences, legacy_text_rows, legacy_code_rows, tokenized_snippets)}

_PIECES = r"' ?[\p{L}\p{Nl}\p{No}]+|\p{Nd}+|[^\p{L}\p{N}]'"
_TEXTS = f"""s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY written_at DESC, text DESC NULLS LAST) AS r FROM text_samples) x WHERE r = 1),
        k AS (SELECT *, regexp_extract_all(text, {_PIECES}) AS p FROM s),
        t AS (SELECT * EXCLUDE (p), unnest(p) AS token_text, unnest(range(len(p))) AS token_pos, len(p) AS n FROM k)"""
SQL = {
    "line_tokens": rf"""
        WITH s AS (SELECT language, snippet_id, row_number() OVER () AS sn, code FROM (SELECT language, snippet_id, arg_max(coalesce(code, ''), written_at) AS code FROM snippets GROUP BY ALL) x),
        kp AS (SELECT sn, regexp_extract_all(code, {_PIECES}) AS p FROM s),
        k AS (SELECT sn, unnest(p) AS t, unnest(range(len(p))) AS pos FROM kp),
        tok AS (SELECT sn, pos, t, sum(length(t)) OVER (PARTITION BY sn ORDER BY pos)::BIGINT AS e FROM k),
        wp AS (SELECT sn, regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*|\n|[^A-Za-z_\n]+') AS p FROM s),
        w0 AS (SELECT sn, unnest(p) AS w, unnest(range(len(p))) AS i FROM wp),
        w1 AS (SELECT *, sum(length(w)) OVER (PARTITION BY sn ORDER BY i)::BIGINT AS e, count(*) FILTER (w = chr(10)) OVER (PARTITION BY sn ORDER BY i) AS line FROM w0),
        w2 AS (SELECT sn, w, e - length(w) AS b, e, line, row_number() OVER (PARTITION BY sn, line ORDER BY i) = 1 AS head FROM w1 WHERE regexp_full_match(w, '[A-Za-z_][A-Za-z0-9_]*')),
        under AS (SELECT t.sn, pos, t, t.e - length(t) AS tb, t.e AS te, w, w2.b, w2.e, line, head, least(t.e, w2.e) - greatest(t.e - length(t), w2.b) AS n
                  FROM tok t JOIN w2 ON w2.sn = t.sn AND w2.b < t.e AND w2.e > t.e - length(t)),
        nm AS (SELECT sn, pos, first(w ORDER BY n DESC, b) AS name FROM (SELECT sn, pos, w, sum(n) AS n, min(b) AS b FROM under GROUP BY ALL) x GROUP BY sn, pos),
        pt AS (SELECT sn, pos, first(head ORDER BY n DESC, b) AS head FROM (SELECT sn, pos, head, sum(n) AS n, min(b) AS b FROM under GROUP BY ALL) x GROUP BY sn, pos),
        us AS (SELECT u.sn, u.pos, min(b) AS b, bool_or(head) AS decl, arg_min(head, b) AS writes, any_value(t) AS t, any_value(tb) AS tb, any_value(line) AS line, any_value(name) AS name
               FROM under u JOIN nm ON nm.sn = u.sn AND nm.pos = u.pos AND nm.name = u.w GROUP BY u.sn, u.pos),
        hd AS (SELECT h.sn, h.line, h.w, h.e, min(u.pos) AS first_pos, min(u.pos) FILTER (u.te >= h.e AND nm.name = h.w) AS done
               FROM w2 h JOIN under u ON u.sn = h.sn AND u.b = h.b JOIN nm ON nm.sn = u.sn AND nm.pos = u.pos WHERE h.head GROUP BY ALL)
        SELECT language, snippet_id, us.pos AS token_pos, us.t AS token_text, 'module > line_block > ' || CASE WHEN pt.head THEN 'variable_declarator > ' ELSE '' END || 'identifier' AS tree_sitter_path,
               'identifier' AS tree_sitter_leaf_type, us.name, 1 AS scope_depth, 'line_block' AS scope_node_type, (hd.e <= tb)::BIGINT AS num_in_scope_names, CASE WHEN hd.e <= tb THEN hd.w END AS in_scope_name,
               hd.e <= tb AND hd.w = us.name AS token_name_is_in_scope, us.decl AS token_name_is_decl, CASE WHEN us.writes THEN 'write' ELSE 'read' END AS access, us.b AS usage_start,
               CASE WHEN us.decl OR (hd.e <= tb AND hd.w = us.name) THEN hd.first_pos END AS declared_at,
               CASE WHEN (us.decl OR (hd.e <= tb AND hd.w = us.name)) AND hd.done < us.pos THEN hd.done END AS written_at
        FROM us JOIN pt ON pt.sn = us.sn AND pt.pos = us.pos JOIN hd ON hd.sn = us.sn AND hd.line = us.line JOIN s ON s.sn = us.sn""",
    "sparse_sequences": f"""
        WITH {_TEXTS} SELECT idx AS snippet_id, token_pos, token_text, n AS seq_len, lag(token_text) OVER (PARTITION BY idx ORDER BY token_pos) AS prev_token_str, true AS consistent FROM t""",
    "legacy_text_rows": rf"""
        WITH {_TEXTS}, c AS (SELECT *, least(n, 32) AS seq_len, sum(length(token_text)) OVER (PARTITION BY idx ORDER BY token_pos)::BIGINT AS char_end FROM t WHERE token_pos < 32)
        SELECT idx, 'text' AS modality, source_dataset, text_label_id, token_pos, seq_len, length(text) AS text_char_len, token_text, char_end - length(token_text) AS char_start, char_end,
               length(token_text) AS char_len, regexp_full_match(token_text, '[\s\x1c-\x1f\x0b\x85\p{{Z}}]+') AS is_whitespace_token,
               lag(token_text) OVER (PARTITION BY idx ORDER BY token_pos) AS prev_token_str, lead(token_text) OVER (PARTITION BY idx ORDER BY token_pos) AS next_token_str FROM c""",
    "tokenized_snippets": f"""
        WITH s AS (SELECT language, snippet_id, arg_max(coalesce(code, ''), written_at) AS code FROM snippets GROUP BY ALL)
        SELECT language, snippet_id, len(regexp_extract_all(code, {_PIECES})) AS n_tokens, length(code) AS n_chars FROM s""",
}
