"""Tables of any of the supported formats, their writers, sidecars and run summaries."""

from __future__ import annotations

import json
import os
import pickle
import shutil
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Formats by file suffix; a path without suffix is a directory of Arrow stream files.
FORMATS = {".jsonl": "jsonl", ".parquet": "parquet", ".arrow": "arrow", "": "hf"}


def infer_format(path: str, requested: str = "auto") -> str:
    if requested != "auto":
        return requested
    suffix = os.path.splitext(path.rstrip("/"))[1]
    if suffix not in FORMATS:
        raise ValueError(f"can't tell the format of {path}")
    return FORMATS[suffix]


def _arrow_batches(path: str) -> Iterator[pa.RecordBatch]:
    with pa.memory_map(path) as source:
        try:
            reader = pa.ipc.open_file(source)
            yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
        except pa.ArrowInvalid:
            source.seek(0)
            yield from pa.ipc.open_stream(source)


def _read_arrow(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Arrow files, each read by one task; half floats become floats. All executors must see the files."""
    from pyspark.sql.pandas.types import from_arrow_schema

    if not files:
        raise ValueError("no arrow files")

    def widened(schema: pa.Schema) -> pa.Schema:
        wide = lambda t: pa.float32() if t == pa.float16() else pa.list_(wide(t.value_type)) if pa.types.is_list(t) else t
        return pa.schema([f.with_type(wide(f.type)) for f in schema])

    first = next(_arrow_batches(files[0]), None)
    if first is None:
        raise ValueError(f"{files[0]} holds no batch")
    shape = widened(first.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in batches:
            for name in names.column(0).to_pylist():
                for batch in _arrow_batches(name):
                    yield from pa.Table.from_batches([batch]).cast(shape).to_batches()

    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files))
    return paths.mapInArrow(run, from_arrow_schema(shape))


def read_table(spark: SparkSession, path: str, fmt: str = "auto", languages: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """A table in jsonl, parquet, arrow or hf (directory of Arrow files), filtered by language, then limited."""
    fmt = infer_format(path, fmt)
    if fmt == "jsonl":
        df = spark.read.json(path)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "arrow":
        df = _read_arrow(spark, [path] if os.path.isfile(path) else sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".arrow")))
    elif fmt == "hf":
        df = _read_arrow(spark, sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".arrow")))
    else:
        raise ValueError(f"unknown format {fmt}")
    if languages is not None:
        df = df.where(F.col("language").isin(*languages))
    return df if max_rows is None else df.limit(max_rows)


def read_activations(spark: SparkSession, path: str, fmt: str = "auto", languages: Sequence[str] | None = None, max_rows: int | None = None) -> DataFrame:
    df = read_table(spark, path, fmt, languages, max_rows)
    if "activation" not in df.columns:
        raise ValueError("the table has no column activation")
    return df


def metadata_path(path: str) -> str:
    return path.rstrip("/") + ".meta.json"


def read_metadata(path: str) -> dict:
    """The sidecar of a table; a missing one is empty."""
    try:
        with open(metadata_path(path), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def with_metadata(df: DataFrame, meta: dict, columns: Sequence[str] = ("model_name", "layer", "activation_kind", "hook_name")) -> DataFrame:
    """Fills the columns, or their nulls, from the sidecar."""
    for c in columns:
        if c in meta:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(meta[c])) if c in df.columns else F.lit(meta[c]))
        elif c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def count_rows(spark: SparkSession, candidates: Sequence[str], explicit: int | None = None) -> int | None:
    """The explicit count, else the rows of the first candidate (pickle, parquet, csv) that exists, else None."""
    if explicit is not None:
        return explicit
    for path in candidates:
        if not os.path.exists(path):
            continue
        suffix = os.path.splitext(path)[1]
        if suffix in (".pkl", ".pickle"):
            import pandas as pd

            return len(pd.read_pickle(path))
        if suffix == ".parquet":
            return spark.read.parquet(path).count()
        if suffix == ".csv":
            return spark.read.option("header", True).option("multiLine", True).csv(path).count()
        raise ValueError(f"can't count the rows of {path}")
    return None


def read_descriptions(spark: SparkSession, folder: str, models: Sequence[str]) -> DataFrame:
    """(model, feature_id, description) of ``explanations-<model>/*.jsonl``; join it to feature ids."""
    out = None
    for model in models:
        rows = spark.read.schema("index string, description string").json(f"{folder}/explanations-{model}/*.jsonl")
        part = rows.select(F.lit(model).alias("model"), F.col("index").try_cast("long").alias("feature_id"), "description")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no model given")
    return out


def describe_feature(spark: SparkSession, feature_id: int, models: Sequence[str], folder: str) -> DataFrame:
    return read_descriptions(spark, folder, models).where(F.col("feature_id") == feature_id)


def _write_arrow(df: DataFrame, path: str, stream: bool) -> tuple[pa.Schema, list[str]]:
    """One Arrow file per partition, written where it is computed, into a folder that all executors share. A file
    appears under its name only when it is complete, so a task that is run again replaces it; the folder takes the place
    of an older one only when all of it is there. Gives the schema and the names of the files."""
    from pyspark.sql.pandas.types import to_arrow_schema

    path = path.rstrip("/")
    fresh, old = (f"{path}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
    os.makedirs(fresh)
    shape = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(fresh, f"part-{context.partitionId():05d}.arrow")
        partial = f"{name}.{context.taskAttemptId()}"
        n = 0
        with pa.OSFile(partial, "wb") as sink, (pa.ipc.new_stream if stream else pa.ipc.new_file)(sink, shape) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(shape))
                n += batch.num_rows
        os.replace(partial, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    if os.path.lexists(path):
        os.rename(path, old)
    os.rename(fresh, path)
    if os.path.isdir(old):
        shutil.rmtree(old)
    elif os.path.lexists(old):
        os.remove(old)
    return shape, sorted(f for f in os.listdir(path) if f.endswith(".arrow"))


def _feature(kind: pa.DataType) -> dict:
    if pa.types.is_list(kind):
        return {"feature": _feature(kind.value_type), "_type": "Sequence"}
    name = {"double": "float64", "float": "float32", "halffloat": "float16"}.get(str(kind), str(kind))
    return {"dtype": name, "_type": "Value"}


def write_table(df: DataFrame, path: str, fmt: str = "auto") -> None:
    """Writes jsonl, parquet, arrow, or hf; what stood there before is replaced.

    hf is a folder of Arrow stream files beside the two JSON files that the datasets library keeps of a saved dataset:
    its columns, and the names of its files. Columns are plain values and lists. That library is not installed here, so
    loading was not tried.
    """
    fmt = infer_format(path, fmt)
    if fmt == "jsonl":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "arrow":
        _write_arrow(df, path, False)
    elif fmt == "hf":
        shape, files = _write_arrow(df, path, True)
        info = {"citation": "", "description": "", "features": {f.name: _feature(f.type) for f in shape}, "homepage": "", "license": ""}
        state = {"_data_files": [{"filename": f} for f in files], "_fingerprint": uuid.uuid4().hex[:16], "_format_columns": None, "_format_kwargs": {}, "_format_type": None, "_output_all_columns": False, "_split": None}
        for name, content in (("dataset_info.json", info), ("state.json", state)):
            with open(os.path.join(path, name), "w", encoding="utf-8") as f:
                json.dump(content, f, indent=2)
    else:
        raise ValueError(f"unknown format {fmt}")


def save_frame(df: DataFrame, path: str) -> None:
    """Saves by suffix: parquet, csv (lists as strings), or pickle for results that fit the driver."""
    suffix = os.path.splitext(path)[1]
    if suffix == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif suffix == ".csv":
        flat = [F.col(n).cast("string").alias(n) if t.startswith(("array", "struct", "map")) else F.col(n) for n, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    elif suffix in (".pkl", ".pickle"):
        with open(path, "wb") as f:
            pickle.dump(df.toPandas(), f)
    else:
        raise ValueError(f"can't save as {path}")


def observed(df: DataFrame, error_column: str = "error") -> tuple[DataFrame, Observation]:
    """``df``, and counts taken while it is computed: n_rows, and n_failed with an error."""
    seen = Observation()
    failed = F.coalesce(F.col(error_column), F.lit("")) != "" if error_column in df.columns else F.lit(False)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(failed).alias("n_failed")), seen


def run_summary(df: DataFrame, snippet: Sequence[str] = ("language", "snippet_id"), status: str | None = "tree_sitter_status") -> dict:
    """Rows, distinct snippets, sorted languages and columns; with a status column also how many snippets have each."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*snippet).alias("s"), F.array_sort(F.collect_set("language")).alias("l")).first()
    out = {"num_rows": row.n, "num_snippets": row.s, "languages": row.l, "columns": df.columns}
    if status and status in df.columns:
        counts = df.select(*snippet, status).distinct().groupBy(status).count().collect()
        out["status_counts"] = {r[status]: r["count"] for r in counts}
    return out


def write_metadata(path: str, summary: dict, **parameters) -> None:
    with open(metadata_path(path), "w", encoding="utf-8") as f:
        json.dump(summary | parameters, f, ensure_ascii=False, indent=2)
