"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SNIPPET_FILE = _struct(idx=_S, code=_S, snippet=_S, comment=_S, problem_desc=_S, tokens=T.ArrayType(_S))
SNIPPET = _struct(
    snippet_id=_S, global_idx=_S, language=_S, code=_S, file_path=_S, source_snippet_ids=T.ArrayType(_S), source_file_paths=T.ArrayType(_S), num_fragments=_L
)
TEXT_SAMPLE = _struct(idx=_S, global_idx=_S, language=_S, file_path=_S, text=_S, source_dataset=_S, source_split=_S, text_label=_S, text_label_id=_L)
ACTIVATION = _struct(
    snippet_id=_S, global_idx=_S, language=_S, file_path=_S, source_snippet_ids=_S, source_file_paths=_S, num_fragments=_L, token_id=_L, token_pos=_L, token_text=_S, tokenizer_token=_S, token_decoded=_S,
    token_offset_start=_L, token_offset_end=_L, is_special_token=_B, activation=T.ArrayType(T.FloatType()), activation_dim=_L, model_name=_S, layer=_L, activation_kind=_S, hook_name=_S, code=_S,
)
