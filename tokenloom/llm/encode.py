"""Encoding of a corpus with a public tokenizer, and decoding back to text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tokenloom.llm.vocab import BYTE_BPE_50K, TOKENIZER_DIR, encoder, safe_parts


def _ids(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.int32)
    parts = [enc.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype(np.int32)


def encode_column(
    df: DataFrame, key: str, text: str, vocabulary: str = BYTE_BPE_50K, directory: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, ids array<int>) of each row: the ids of ``text`` without special tokens.

    Empty and null texts give an empty list; blank text is encoded like any other; strings that look like special
    tokens are ordinary text. Rows map one to one, repeated rows stay repeated. Row-local: no shuffle, and only two
    columns reach Python.
    """
    path = os.path.join(directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):  # bounds what one output batch holds
                part = batch.slice(at, 2048)
                ids = [_ids(enc, t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int64)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_column(
    df: DataFrame, key: str, ids: str = "ids", vocabulary: str = BYTE_BPE_50K, directory: str = TOKENIZER_DIR
) -> DataFrame:
    """(key, text) of each row, by joining the ids' raw bytes before decoding UTF-8; null ids give null.

    Bytes that form no UTF-8 (ids cut in the middle of a character) become U+FFFD.
    """
    path = os.path.join(directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [None if x is None else enc.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
