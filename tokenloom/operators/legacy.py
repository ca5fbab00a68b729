"""The older feature tables of code and of text: one row per token, with labels, sequence and sparse features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import labels, spans
from tokenloom.functions.tokenizers import Tokenizer
from tokenloom.operators.encode import Encoder, Provider, encode_features, extract_activations, good_rows

#: Columns that a sample of either kind may bring along, in order; what it lacks is null.
CODE_SAMPLE = ("idx", "global_idx", "language", "file_path", "problem_desc", "comment")
TEXT_SAMPLE = ("idx", "global_idx", "language", "modality", "file_path", "problem_desc", "comment", "source_dataset", "source_split", "text_label", "text_label_id")


def _filled(samples: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    none = lambda c: F.lit(None).cast("bigint" if c.endswith("_id") else "string").alias(c)
    return samples.select(*[F.col(c) if c in samples.columns else none(c) for c in columns], F.col(text).alias("code"))


def _code_labels() -> tuple[Column, Column]:
    """The lexer's label of a token, full and simple, each that of most characters, among equals the one whose count was
    complete first; characters of white space and plain text give way to others."""
    start, end = F.col("token_offset_start"), F.col("token_offset_end")
    strong = F.filter("runs", lambda r: ~r["simple"].isin("whitespace", "text"))
    telling = F.when(F.size(strong) > 0, strong).otherwise(F.col("runs"))
    voted = lambda field: labels.vote_first_reached(spans.run_labels(telling, start, end, field), F.lit("special"))
    return tuple(F.when(start == end, F.lit("special")).otherwise(voted(f)) for f in ("label", "simple"))


def _features(
    samples: DataFrame, keep: Sequence[str], provider: Provider, encoder: Encoder, model_name: str, layer: int, release: str, encoder_id: str, tokenizer: Tokenizer | None, max_length: int | None,
    top_k: int, only_positive: bool, thresholds: Sequence[float], lexed: bool, include_text: bool,
) -> DataFrame:
    carried = [*keep, *["code"] * include_text]
    dense = extract_activations(samples, provider, model_name, layer, tokenizer=tokenizer, max_context=max_length, truncate=True, sequence=True, keep=carried, lexed=lexed)
    rows = encode_features(good_rows(dense), encoder, release, encoder_id, top_k, only_positive, thresholds, include_code=include_text)
    return rows.withColumns({"token_pos": F.col("token_pos"), "token_str": F.col("tokenizer_token")})


def _ordered(rows: DataFrame, keep: Sequence[str], more: Sequence[str], top_k: int, thresholds: Sequence[float], text: str | None) -> DataFrame:
    from tokenloom.functions.ids import threshold_column

    columns = [
        *keep, "token_pos", "seq_len", "code_char_len", *more, "token_id", "token_str", "token_decoded", "token_text", "char_start", "char_end", "char_len", "is_special_token", "is_whitespace_token",
        "prev_token_str", "next_token_str", "pygments_type", "pygments_simple_type", "pygments_label_id", "top_k_feature_ids", "top_k_feature_activations", "top_k_found", "model_name", "sae_release",
        "sae_id", "hook_name", "sae_width", "sae_l0_positive", "sae_l1_positive", "sae_l2", "sae_max_activation", "sae_mean_activation", "sae_std_activation", "top_k_activation_sum",
        "top_k_fraction_of_l1", "top_feature_id", "top_feature_activation", *(threshold_column(t) for t in thresholds),
    ]
    wide = [f"top_{r}_feature_{what}" for r in range(1, top_k + 1) for what in ("id", "activation")]
    return rows.select(*columns, *wide, *([F.col("code").alias(text)] if text else []))


def code_feature_rows(
    samples: DataFrame, provider: Provider, encoder: Encoder, model_name: str, layer: int, release: str, encoder_id: str, tokenizer: Tokenizer | None = None, max_length: int | None = 256,
    top_k: int = 20, only_positive: bool = True, thresholds: Sequence[float] = (0.0, 0.1, 1.0), include_code: bool = False,
) -> DataFrame:
    """Feature rows of code samples (idx, global_idx, language, file_path, problem_desc, comment, code).

    A sequence is cut after ``max_length`` tokens. Samples that fail, and null or empty code, have no rows. Row-local.
    """
    rows = _features(_filled(samples, CODE_SAMPLE, "code"), CODE_SAMPLE, provider, encoder, model_name, layer, release, encoder_id, tokenizer, max_length, top_k, only_positive, thresholds, True, include_code)
    full, simple = _code_labels()
    rows = rows.withColumn("pygments_type", full).withColumn("pygments_simple_type", simple).withColumn("pygments_label_id", labels.label_id(F.col("pygments_simple_type")))
    return _ordered(rows, CODE_SAMPLE, (), top_k, thresholds, "code" if include_code else None)


def text_feature_rows(
    samples: DataFrame, provider: Provider, encoder: Encoder, model_name: str, layer: int, release: str, encoder_id: str, tokenizer: Tokenizer | None = None, max_length: int | None = 256,
    top_k: int = 20, only_positive: bool = True, thresholds: Sequence[float] = (0.0, 0.1, 1.0), include_text: bool = False,
) -> DataFrame:
    """Feature rows of text samples (idx, global_idx, language, file_path, source_dataset, source_split, text_label,
    text_label_id, text), with modality ``text``. Labels come from the classes of a token's characters. Otherwise as
    ``code_feature_rows``."""
    marked = samples.withColumn("modality", F.lit("text"))
    rows = _features(_filled(marked, TEXT_SAMPLE, "text"), TEXT_SAMPLE, provider, encoder, model_name, layer, release, encoder_id, tokenizer, max_length, top_k, only_positive, thresholds, False, include_text)
    rows = rows.withColumn("pygments_simple_type", labels.select_text_label(labels.char_labels_exact("token_text")))
    full = F.when(F.col("pygments_simple_type") == "special", F.lit("special")).otherwise(F.concat(F.lit("Text."), F.initcap("pygments_simple_type")))
    rows = rows.withColumn("pygments_type", full)
    rows = rows.withColumn("pygments_label_id", labels.label_id(F.col("pygments_simple_type"), labels.TEXT_LABELS)).withColumn("text_char_len", F.col("code_char_len"))
    return _ordered(rows, TEXT_SAMPLE, ("text_char_len",), top_k, thresholds, "text" if include_text else None)
