"""Documents to token rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.labels import TEXT_LABELS, char_labels, char_labels_exact, label_id, select_text_label
from tokenloom.session import cut_lineage

#: Splits a text into pieces that cover it: words with a blank in front, digits, single other characters.
COVERING_PATTERN = r" ?\p{L}+|\p{N}+|[^\p{L}\p{N}]"


def text_tokens(df: DataFrame, key: list[str], text: str, pattern: str = COVERING_PATTERN) -> DataFrame:
    """key, token_pos, token_text, char_start, char_end: one row per token of each text; repeated rows stay repeated.

    The pieces of a text are cut, and their offsets known, in the row that holds it: nothing is shuffled, and a long
    text costs linear time. ``pattern`` covers every text. Null and empty texts have no tokens.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(len(key))
                lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = lists.flatten()
                ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
                begin = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)  # of each text's pieces
                base = np.repeat(np.r_[np.int64(0), ends][begin], lengths)
                starts = np.r_[np.int64(0), ends[:-1]][: len(ends)] - base
                of = pa.array(np.repeat(np.arange(len(lengths)), lengths))
                place = np.arange(len(ends)) - np.repeat(begin, lengths)
                columns = [*(part.column(i).take(of) for i in range(len(key))), pa.array(place.astype(np.int32)), texts, pa.array(ends - base), pa.array(starts)]
                made = pa.RecordBatch.from_arrays(columns, names=[*key, "token_pos", "token_text", "char_end", "char_start"])
                for k in range(0, made.num_rows, 50_000):
                    yield made.slice(k, 50_000)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "token_pos int, token_text string, char_end bigint, char_start bigint"])
    return df.select(*key, pieces.alias("_pieces")).mapInArrow(run, schema)


def insert_bos(tokens: DataFrame, texts: DataFrame, key: list[str], bos: str = "<bos>") -> DataFrame:
    """Puts a begin mark with an empty span at position 0 of every text, also of texts without tokens; the others move
    up by one."""
    zero = F.lit(0).cast("long")
    marks = texts.select(*key, F.lit(0).alias("token_pos"), F.lit(bos).alias("token_text"), zero.alias("char_end"), zero.alias("char_start"))
    return marks.unionByName(tokens.withColumn("token_pos", F.col("token_pos") + 1))


def label_text_tokens(tokens: DataFrame, exact: bool = False) -> DataFrame:
    """Adds label and label_id of text tokens from the classes of their characters; ``exact`` by Python's rules for
    numerals outside the decimal digits, otherwise inside the JVM."""
    label = select_text_label(char_labels_exact("token_text") if exact else char_labels(F.col("token_text")))
    return tokens.withColumn("label", label).withColumn("label_id", label_id(F.col("label"), TEXT_LABELS))


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in total order. The sort is distributed and kept; a row's number is its place in its
    partition plus the sizes of the partitions before (one small row each)."""
    kept = cut_lineage(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.select(
        F.col("_p").alias("_q"), F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    place = F.col("_before") + F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    return kept.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn(name, place).drop("_p", "_q", "_m", "_before")


def pad_batches(df: DataFrame, order: list[str], ids: str, labels: str, batch_size: int, pad_id: int = 0, label_pad: int = -100, side: str = "right") -> DataFrame:
    """Adds batch and attention_mask, and pads ids and labels to the longest row of each batch of ``batch_size`` rows
    in total order, all on the same side."""
    rows = number_rows(df, order, "_n").withColumn("batch", F.floor(F.col("_n") / batch_size).cast("long"))
    rows = rows.withColumn("_longest", F.max(F.size(ids)).over(Window.partitionBy("batch")))
    gap = F.col("_longest") - F.size(ids)
    fill = lambda value: F.array_repeat(F.lit(value).cast("bigint"), gap)
    join = (lambda a, b: F.concat(a, b)) if side == "right" else (lambda a, b: F.concat(b, a))
    mask = F.transform(ids, lambda _: F.lit(1).cast("bigint"))
    return (
        rows.withColumn("attention_mask", join(mask, fill(0)))
        .withColumn(labels, join(F.col(labels), fill(label_pad)))
        .withColumn(ids, join(F.col(ids), fill(pad_id)))
        .drop("_n", "_longest")
    )
