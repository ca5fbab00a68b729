"""Dense activations of a model, and their sparse features.

Models are not part of this library. A provider makes activations from token ids; encoder weights come from a file.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tokenloom.functions.ids import threshold_column
from tokenloom.sources.tables import with_metadata
from tokenloom.functions.labels import is_blank_token
from tokenloom.functions.tokenizers import PatternTokenizer, Tokenizer
from tokenloom.operators.lexing import Touching, lexer_runs

#: Given the token ids of one snippet: one vector per token.
Provider = Callable[[list[int]], np.ndarray]
KINDS = ("resid_pre", "resid_mid", "resid_post", "attn_out", "mlp_out")


def hook_name(layer: int, kind: str = "resid_post", named: str | None = None) -> str:
    if named:
        return named
    if kind not in KINDS:
        raise ValueError(f"activation kind must be one of {KINDS}")
    return f"blocks.{layer}.hook_{kind}"


@functools.lru_cache(maxsize=100_000)
def _seeded(seed: int, width: int, i: int) -> np.ndarray:
    return np.random.default_rng([seed, i]).standard_normal(width).astype(np.float32)


class SeededProvider(NamedTuple):
    """Vectors drawn from a seed and the token id: for tests and dry runs."""

    width: int = 16
    seed: int = 0

    def __call__(self, ids: list[int]) -> np.ndarray:
        return np.stack([_seeded(self.seed, self.width, i) for i in ids]) if ids else np.empty((0, self.width), np.float32)


#: Columns of a snippet that its token rows carry.
IDENTITY = ("snippet_id", "global_idx", "language", "file_path", "source_snippet_ids", "source_file_paths", "num_fragments")
_SEQUENCE_COLUMNS = ", code_char_len bigint, seq_len bigint, prev_token_str string, next_token_str string"
_RUN_COLUMN = ", runs array<struct<start:bigint,end:bigint,label:string,simple:string>>"
_ACTIVATION_COLUMNS = (
    "token_id bigint, token_pos bigint, token_text string, tokenizer_token string, token_decoded string, token_offset_start bigint, token_offset_end bigint, "
    "is_special_token boolean, activation array<float>, activation_dim bigint, error string"
)


def extract_activations(
    snippets: DataFrame, provider: Provider, model_name: str, layer: int, kind: str = "resid_post", tokenizer: Tokenizer | None = None,
    max_context: int | None = None, truncate: bool = False, half: bool = False, sequence: bool = False, keep: Sequence[str] = IDENTITY, lexed: bool = False,
) -> DataFrame:
    """One row per token with its vector, and one row with ``error`` and no token for each snippet that failed, so that
    a run goes on and failures can be counted (``good_rows``, ``failed_snippets``).

    A snippet longer than ``max_context`` fails, or is cut with ``truncate``. ``half`` rounds values to half floats.
    ``sequence`` adds code_char_len, seq_len, prev_token_str and next_token_str, ``lexed`` the lexer's runs under each
    token; ``keep`` are the columns of the snippet to carry along, as far as it has them.
    """
    tokenizer = tokenizer or PatternTokenizer()
    identity = [c for c in keep if c in snippets.columns]
    kinds = dict(snippets.dtypes)
    made = _ACTIVATION_COLUMNS + (_SEQUENCE_COLUMNS if sequence else "") + (_RUN_COLUMN if lexed else "")

    def tokens_of(code: str, language: str) -> list[dict]:
        found = tokenizer.encode(code)
        if max_context is not None and len(found) > max_context:
            if not truncate:
                raise ValueError(f"{len(found)} tokens exceed the context of {max_context}")
            found = found[:max_context]
        vectors = np.asarray(provider([t.token_id for t in found]), np.float32)
        if len(vectors) != len(found):
            raise ValueError(f"{len(vectors)} vectors for {len(found)} tokens")
        if half:
            vectors = vectors.astype(np.float16).astype(np.float32)
        raw = [None, *(t.raw for t in found), None]
        under = Touching(lexer_runs(code, language)) if lexed else None
        return [
            {
                "token_id": t.token_id, "token_pos": i, "token_text": code[t.start : t.end], "tokenizer_token": t.raw, "token_decoded": t.decoded, "token_offset_start": t.start,
                "token_offset_end": t.end, "is_special_token": t.start == t.end, "activation": v, "activation_dim": len(v), "error": None,
                "code_char_len": len(code), "seq_len": len(found), "prev_token_str": raw[i], "next_token_str": raw[i + 2], "runs": under(t.start, t.end) if lexed else None,
            }
            for i, (t, v) in enumerate(zip(found, vectors))
        ]

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in identity), made])
    shape = to_arrow_schema(T._parse_datatype_string(schema))
    names = shape.names[len(identity) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                code, language = (row.column(len(identity) + k)[0].as_py() or "" for k in range(2))
                try:
                    found = tokens_of(code, language)
                except Exception as e:
                    found = [dict.fromkeys(names) | {"error": str(e) or type(e).__name__}]
                of = pa.array([0] * len(found), pa.int64())
                same = [row.column(i).take(of).cast(shape.field(i).type) for i in range(len(identity))]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array([f[n] for f in found], shape.field(n).type) for n in names)], schema=shape)

    language = F.col("language") if "language" in snippets.columns else F.lit("")
    rows = snippets.select(*identity, "code", language.alias("_language")).mapInArrow(run, schema)
    return rows.withColumns(
        {"model_name": F.lit(model_name), "layer": F.lit(layer).cast("long"), "activation_kind": F.lit(kind), "hook_name": F.lit(hook_name(layer, kind))}
    )


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error")


def failed_snippets(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull()).select("snippet_id", "language", "error")


class Encoder(Protocol):
    def load(self) -> dict[str, np.ndarray]: ...


class SentEncoder(NamedTuple):
    """Encoder weights as a broadcast variable, for weights that fit the driver; else as ``EncoderFile``."""

    weights: Broadcast

    def load(self) -> dict[str, np.ndarray]:
        return self.weights.value


class EncoderFile(NamedTuple):
    """Encoder weights in an ``.npz`` file that all executors see: w (input x width), b, and where the activation has a
    threshold, ``threshold``; ``b_in`` is taken off the input."""

    path: str

    def load(self) -> dict[str, np.ndarray]:
        return _weights(self.path)


@functools.lru_cache(maxsize=2)
def _weights(path: str) -> dict[str, np.ndarray]:
    with np.load(path) as f:
        return {k: f[k].astype(np.float32) for k in f.files}


def encode_vectors(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    pre = (x - w["b_in"] if "b_in" in w else x) @ w["w"] + w["b"]
    if "threshold" in w:
        return np.where(pre > w["threshold"], pre, 0.0)
    return np.maximum(pre, 0.0)


def top_and_stats(z: np.ndarray, k: int, only_positive: bool, thresholds: Sequence[float]) -> dict[str, list]:
    """Per row the k greatest entries (ties by position) and the statistics of the row."""
    width = z.shape[1]
    k = min(k, width)
    out: dict[str, list] = {n: [] for n in ("ids", "vals")}
    for row in z:
        near = np.arange(width) if k == width else np.flatnonzero(row >= np.partition(row, width - k)[width - k])
        best = near[np.lexsort((near, -row[near]))][:k]
        if only_positive:
            best = best[row[best] > 0]
        out["ids"].append(best.astype(np.int64))
        out["vals"].append(row[best].astype(np.float64))
    positive = np.maximum(z, 0).astype(np.float64)
    d = z.astype(np.float64)
    out |= {
        "sae_width": [width] * len(z), "sae_l0_positive": (z > 0).sum(1).tolist(), "sae_l1_positive": positive.sum(1).tolist(), "sae_l2": np.sqrt((d * d).sum(1)).tolist(), "sae_max_activation": d.max(1).tolist(),
        "sae_mean_activation": d.mean(1).tolist(), "sae_std_activation": d.std(1).tolist(),
    }
    for t in thresholds:
        out[threshold_column(t)] = (z >= t).sum(1).tolist()
    return out


def encode_features(
    activations: DataFrame, encoder: Encoder, release: str, encoder_id: str, top_k: int = 20, only_positive: bool = True,
    thresholds: Sequence[float] = (0.0, 0.1, 1.0), include_code: bool = False, metadata: dict | None = None, isolate: bool = False,
) -> DataFrame:
    """The sparse feature table: per token the top features, statistics, threshold counts and wide columns.

    Row-local: vectors are encoded in blocks next to the data and only the top entries leave Python. Rows with a null
    vector are left out. Names of older tables (char_start, token_str) are understood; what describes the model and is
    missing or null is taken from ``metadata`` (a sidecar). All columns follow from k and the thresholds, not from the
    data. A vector that can't be encoded fails the query; with ``isolate`` its row comes out with ``error`` and without
    features, so that a run goes on (``good_rows``).
    """
    if metadata:
        activations = with_metadata(activations, metadata)
    kept = [c for c in activations.columns if c not in ("activation", "activation_dim", "error") and (include_code or c != "code")]
    kinds = dict(activations.dtypes)
    numbers = ["sae_width bigint", "sae_l0_positive bigint", *(f"{n} double" for n in ("sae_l1_positive", "sae_l2", "sae_max_activation", "sae_mean_activation", "sae_std_activation"))]
    counts = [f"{threshold_column(t)} bigint" for t in thresholds]
    made = ["top_k_feature_ids array<bigint>", "top_k_feature_activations array<double>", *numbers, *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = encoder.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = [np.asarray(v, np.float64) for v in part.column(len(kept)).to_pylist()]
                wrong = [len(v) != len(w["w"]) or bool(np.isnan(v).any()) for v in vectors]
                if any(wrong) and not isolate:
                    raise ValueError(f"a vector is no {len(w['w'])} numbers")
                x = np.stack([np.zeros(len(w["w"]), np.float32) if bad else v.astype(np.float32) for v, bad in zip(vectors, wrong)])
                s = top_and_stats(encode_vectors(x, w), top_k, only_positive, thresholds)
                none = lambda values: [None if bad else v for v, bad in zip(values, wrong)]
                lists = [pa.array(none(s.pop("ids")), pa.list_(pa.int64())), pa.array(none(s.pop("vals")), pa.list_(pa.float64()))]
                rest = [pa.array(none(s[m.split()[0]]), pa.int64() if m.endswith("bigint") else pa.float64()) for m in made[2:]]
                told = [pa.array([f"the vector is no {len(w['w'])} numbers" if bad else None for bad in wrong], pa.string())] * isolate
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *lists, *rest, *told], names=[*kept, *(m.split()[0] for m in made), *["error"] * isolate])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *made, *["error string"] * isolate])
    rows = activations.where(F.col("activation").isNotNull()).select(*kept, "activation").mapInArrow(run, schema)
    return sparse_columns(rows, release, encoder_id, top_k)


def sparse_columns(rows: DataFrame, release: str, encoder_id: str, top_k: int) -> DataFrame:
    """Adds what follows from the top lists and the span of each token."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else F.lit(None)
    start, end = first("char_start", "token_offset_start"), first("char_end", "token_offset_end")
    ids, acts = F.col("top_k_feature_ids"), F.col("top_k_feature_activations")
    total = F.aggregate(acts, F.lit(0.0), lambda a, x: a + x)
    token = first("tokenizer_token", "token_str")
    out = rows.withColumns(
        {
            "char_start": start.cast("long"), "char_end": end.cast("long"), "char_len": (end - start).cast("long"), "tokenizer_token": token.cast("string"),
            "is_special_token": F.coalesce(F.col("is_special_token"), start == end) if "is_special_token" in have else start == end,
            "is_whitespace_token": is_blank_token(first("token_text")), "sae_release": F.lit(release), "sae_id": F.lit(encoder_id), "top_k_found": F.when(ids.isNotNull(), F.size(ids)).cast("long"), "selected_features": ids,
            "top_k_activation_sum": total, "top_k_fraction_of_l1": F.when(F.col("sae_l1_positive") > 0, total / F.col("sae_l1_positive")).otherwise(F.lit(0.0)),
            "top_feature_id": F.get(ids, 0), "top_feature_activation": F.get(acts, 0),
        }
    )
    wide = {}
    for r in range(1, top_k + 1):
        wide[f"top_{r}_feature_id"], wide[f"top_{r}_feature_activation"] = F.get(ids, r - 1), F.get(acts, r - 1)
    return out.withColumns(wide)


def with_sequence_columns(df: DataFrame, keys: Sequence[str] = ("language", "snippet_id"), token: str = "tokenizer_token") -> DataFrame:
    """Adds seq_len, prev_token_str and next_token_str, by the order of token_pos in each sequence."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys).orderBy("token_pos")
    whole = Window.partitionBy(*keys)
    return df.withColumns({"seq_len": F.count(F.lit(1)).over(whole), "prev_token_str": F.lag(token).over(order), "next_token_str": F.lead(token).over(order)})


def feature_on_snippet(df: DataFrame, global_idx: str, language: str, feature_id: int, threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """(token_pos, token, value) of one snippet in order: the data of a coloured view. Fails if there is no such
    snippet; 0 where a token lacks the feature."""
    from tokenloom.functions.features import activation_of, selected_pairs, token_column

    rows = df.where((F.col("global_idx").cast("string") == str(global_idx)) & (F.col("language") == language))
    if rows.isEmpty():
        raise ValueError(f"no snippet {global_idx} in {language}")
    value = F.coalesce(activation_of(selected_pairs(rows, top_k), feature_id, threshold), F.lit(0.0))
    return rows.select("token_pos", F.col(token_column(rows)).alias("token"), value.alias("value")).orderBy("token_pos")
