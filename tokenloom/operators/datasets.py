"""Token-level training items: one row per snippet or text, with ids and labels as parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions import labels, spans
from tokenloom.functions.tokenizers import Tokenizer
from tokenloom.operators.annotate import parse_snippets

#: Label that losses ignore.
IGNORED = -100


def _items(rows: DataFrame, label: Column, domain: tuple[str, ...], max_length: int | None) -> DataFrame:
    tokens = F.col("tokens") if max_length is None else F.slice("tokens", 1, max_length)
    names = F.transform(tokens, lambda t: label(t))
    return (
        rows.withColumn("input_ids", F.transform(tokens, lambda t: t["token_id"]))
        .withColumn("attention_mask", F.transform(tokens, lambda t: F.lit(1).cast("bigint")))
        .withColumn("offsets", F.transform(tokens, lambda t: F.array(t["start"], t["end"])))
        .withColumn("label_names", names)
        .withColumn("labels", F.transform("label_names", lambda n: labels.label_id(n, domain)))
        .withColumn("length", F.size("input_ids").cast("long"))
        .drop("tokens", "declarations")
    )


def code_items(snippets: DataFrame, tokenizer: Tokenizer | None = None, max_length: int | None = None) -> DataFrame:
    """Adds input_ids, attention_mask, offsets, label_names, labels and length to snippets; other columns stay.

    Labels are lexer labels; ties go to the label that reaches its count first. Tokens with an empty span are special.
    A text without tokens has empty lists; status and error tell of a snippet that could not be lexed or parsed.
    """
    label = lambda t: labels.select_code_label(spans.run_labels(t["runs"], t["start"], t["end"], "simple"), seen=False)
    return _items(parse_snippets(snippets, tokenizer), label, labels.CODE_LABELS, max_length)


def pad_items(items: DataFrame, order: list[str], batch_size: int, pad_id: int = 0, side: str = "right") -> DataFrame:
    """``items`` in batches of ``batch_size`` rows in total order, padded to the longest of each batch."""
    from tokenloom.operators.tokens import pad_batches

    return pad_batches(items.drop("attention_mask"), order, "input_ids", "labels", batch_size, pad_id, IGNORED, side)


def text_items(tokens: DataFrame, key: list[str], ids: str = "token_id") -> DataFrame:
    """key, input_ids, label_names, labels: labelled token rows (token_pos, ``ids``, label, label_id) gathered per text.
    A text's own tokens bound the lists."""
    packed = F.array_sort(F.collect_list(F.struct("token_pos", F.col(ids).alias("i"), "label", "label_id")))
    rows = tokens.groupBy(*key).agg(packed.alias("t"))
    pick = lambda f: F.transform("t", lambda x: x[f])
    return rows.select(*key, pick("i").alias("input_ids"), pick("label").alias("label_names"), pick("label_id").alias("labels"))
