"""Snippet files, id maps and labelled short texts."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.functions.ids import normalize_global_idx, normalize_snippet_id, spread_or_none
from tokenloom.sources.schema import SNIPPET_FILE

# Keys that the corpus build drops, languages of the corpus.
DROPPED_KEYS = ("bpe", "comment_bpe", "desc_bpe")
LANGUAGES = ("C", "C#", "C++", "Java", "Javascript", "PHP", "Python")
SPLITS = ("train", "test", "val")


def decoded_path(path: Column) -> Column:
    """A file path as it is on disk: ``C%23`` is ``C#``, ``C++`` stays."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_snippets(spark: SparkSession, directory: str, languages: Sequence[str] | None = None, code_field: str = "code", all_keys: bool = False) -> DataFrame:
    """``directory/<language>/<id>.json``, one object per file: the file's keys, global_idx, language, file_path, code.

    Directories of other languages are not listed. A file without the code field fails the query when it is read. The
    known keys are read; with ``all_keys`` any others too, which takes a pass over the files to find them.
    """
    known = T.StructType([*SNIPPET_FILE.fields, *([] if code_field in SNIPPET_FILE.names else [T.StructField(code_field, T.StringType())])])
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    paths = [f"{directory}/{lang}" for lang in languages] if languages is not None else [f"{directory}/*"]
    if all_keys:
        found = reader.json(paths).schema
        known = T.StructType([*known.fields, *(f for f in found.fields if f.name not in known.names and f.name not in ("global_idx", "language", "file_path"))])
    rows = reader.schema(known).json(paths).withColumn("file_path", decoded_path(F.col("_metadata.file_path")))
    missing = F.raise_error(F.concat(F.lit(f"missing code field {code_field} in "), F.col("file_path")))
    return (
        rows.withColumn("code", F.when(F.col(code_field).isNull(), missing.cast("string")).otherwise(F.col(code_field)))
        .withColumn("language", F.element_at(F.split("file_path", "/"), -2))
        .withColumn("global_idx", normalize_global_idx(F.col("idx")))
    )


def read_id_maps(spark: SparkSession, directory: str) -> DataFrame:
    """(pair, language, split, snippet_id) from ``<L1>-<L2>/<split>-<L>-map.jsonl``, blank lines dropped.

    A split counts only if the tokenised code of its pair, ``<split>-<L1>-<L2>-tok*``, lies beside it.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-map.jsonl").text(directory)
    path = decoded_path(F.col("_metadata.file_path"))
    name = F.element_at(F.split(path, "/"), -1)
    rows = lines.select(
        F.element_at(F.split(path, "/"), -2).alias("pair"),
        F.regexp_extract(name, r"^([^-]+)-(.+)-map\.jsonl$", 2).alias("language"),
        F.regexp_extract(name, r"^([^-]+)-", 1).alias("split"),
        F.trim("value").alias("raw"),
    )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*-tok*").load(directory).select("path")
    there = files.select(
        F.element_at(F.split(decoded_path(F.col("path")), "/"), -2).alias("pair"),
        F.regexp_extract(F.element_at(F.split(decoded_path(F.col("path")), "/"), -1), r"^([^-]+)-.*-tok", 1).alias("split"),
    ).distinct()
    return rows.where(F.col("raw") != "").join(there, ["pair", "split"], "left_semi").select("pair", "language", "split", normalize_snippet_id(F.col("raw")).alias("snippet_id"))


# The corpora that are taken where none are named.
DEFAULT_SPECS = (
    {"path": "ag_news", "config": None, "split": "train", "text_field": "text", "label_field": "label"},
    {"path": "glue", "config": "sst2", "split": "train", "text_field": "sentence", "label_field": "label"},
    {"path": "trec", "config": None, "split": "train", "text_field": "text", "label_field": "coarse_label"},
    {"path": "rotten_tomatoes", "config": None, "split": "train", "text_field": "text", "label_field": "label"},
    {"path": "emotion", "config": None, "split": "train", "text_field": "text", "label_field": "label"},
)


def default_specs(root: str) -> list[dict]:
    """The default corpora as tables under ``root``: ``<root>/<path>[-<config>]``."""
    return [{**s, "name": s["path"], "path": "-".join(x for x in (f"{root.rstrip('/')}/{s['path']}", s["config"]) if x)} for s in DEFAULT_SPECS]


def labelled_short_texts(
    spark: SparkSession, specs: Sequence[dict], target_token_rows: int, n_tokens: Column, least: int = 12, most: int = 240, seed: int = 0, max_samples_per_dataset: int = 10_000
) -> DataFrame:
    """Samples of ``short_texts`` of ``least`` to ``most`` characters without white space around, corpus by corpus,
    shuffled within each, at most so many of one, until they have ``target_token_rows`` tokens (0: no limit).

    ``n_tokens`` is the number of tokens of column ``text``; samples without any fall out. Adds it, and running_tokens.
    """
    from tokenloom.operators.ingest import in_length_band
    from tokenloom.operators.windows import token_budget

    texts = short_texts(spark, specs, seed).withColumn("text", F.regexp_replace("text", r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", ""))
    counted = in_length_band(texts, "text", least, most).withColumn("n_tokens", n_tokens.cast("long")).where(F.col("n_tokens") > 0)
    return token_budget(counted, "spec_order", "idx", "n_tokens", target_token_rows, max_samples_per_dataset, seed)


def short_texts(spark: SparkSession, specs: Sequence[dict], seed: int = 0) -> DataFrame:
    """Text samples of several corpora given as {path, config, split, text_field, label_field, label_names, format}.

    Samples carry spec_order, so that the budget can take corpora in order; labels are numbers or names, kept as both
    where they can be. ``label_names`` lists the names of numbers from 0 on; a number outside it has none. The id tells
    corpus, split and place in the shuffled corpus.
    """
    out = None
    for i, spec in enumerate(specs):
        raw = spark.read.format(spec.get("format", "parquet")).load(spec["path"])
        name = ":".join(x for x in (spec.get("name", spec["path"].rstrip("/").rsplit("/", 1)[-1]), spec.get("config")) if x)
        label = F.col(spec["label_field"]).cast("string") if spec.get("label_field") else F.lit(None).cast("string")
        text, number = F.col(spec["text_field"]), label.try_cast("long")
        if spec.get("label_names"):
            names = F.array(*[F.lit(x) for x in spec["label_names"]])
            label = F.when(number.isNull(), label).when(number >= 0, F.get(names, number.cast("int")))
        key = spread_or_none(F.concat_ws("\0", text, label), seed)
        part = raw.select(
            F.lit(i).alias("spec_order"), F.concat_ws("-", F.lit(name), F.lit(spec["split"]), key).alias("idx"), F.concat_ws("-", F.lit(name), key).alias("global_idx"), F.lit("text").alias("language"),
            F.lit(None).cast("string").alias("file_path"), text.alias("text"), F.lit(name).alias("source_dataset"), F.lit(spec["split"]).alias("source_split"), label.alias("text_label"), number.alias("text_label_id"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no corpus given")
    return out


def load_specs(path: str) -> list[dict]:
    """The corpora of a JSON file; each needs path, split and text_field."""
    with open(path, encoding="utf-8") as f:
        specs = json.load(f)
    for s in specs:
        if not {"path", "split", "text_field"} <= s.keys():
            raise ValueError(f"a corpus needs path, split and text_field: {s}")
    return specs


def write_snippet_tree(df: DataFrame, path: str, code_columns: Sequence[str] = ()) -> None:
    """One directory per language, without the dropped keys; the last row of an id must have been chosen before."""
    df.drop(*DROPPED_KEYS).write.mode("overwrite").partitionBy("language").json(path)


def write_snippet_files(df: DataFrame, path: str, order: Sequence[str], idx: str = "idx") -> int:
    """``path/<language>/<base id>.json``, one object per file without the dropped keys, and the number of rows that
    were to be written; of rows with the same language and base id the last in ``order`` stays.

    Files are written by the executors into a folder that all of them share; a file appears when it is complete, so a
    task that is run again replaces it. Rows without an id or a language are left out. An id may not leave its folder.
    """
    from tokenloom.operators.ingest import last_wins

    named = df.withColumn("_id", normalize_snippet_id(F.col(idx))).where(F.col("_id").isNotNull() & F.col("language").isNotNull())
    kept = [c for c in df.columns if c not in (*DROPPED_KEYS, *(c for c in order if c != idx))]
    rows = last_wins(named, ["language", "_id"], order).select("language", "_id", F.to_json(F.struct(*[c for c in kept if c != "language"]), {"ignoreNullFields": "false"}).alias("_json"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if "/" in name or "/" in language or name.startswith("."):
                    raise ValueError(f"{language}/{name} is no file name")
                folder = os.path.join(path, language)
                os.makedirs(folder, exist_ok=True)
                partial = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
                with open(partial, "w", encoding="utf-8") as f:
                    f.write(text + "\n")
                os.replace(partial, os.path.join(folder, f"{name}.json"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    return named.count()
